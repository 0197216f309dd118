"""Declarations that stand by themselves: what of a file's context they need as commands (F-22), and theorems from proof states (F-23).

Edge cases: nulls count as empty; a proof state that cannot be read gives no statement but says why in
`error`; names that no declaration has leave a text as it is.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import text
from corpusmill.functions.contexts import IDENTIFIER, PAIRS, SPACE, balanced, needed
from corpusmill.functions.rows import by_slices

_STRINGS = T.ArrayType(T.StringType())
_ENCLOSED = re.compile(r"\[([^\]\n]+)\]")
_DECLARED = re.compile(r"^\s*(?:theorem|lemma|def|abbrev)\s+(?:_root_\.)?([A-Za-z_][A-Za-z0-9_']*)", re.M)
_WORD = re.compile(r"(?<![A-Za-z0-9_.'])[A-Za-z_][A-Za-z0-9_']*")
_EDGE = re.compile(r"\b")
_SORT = re.compile(r"Type(?:\s+[A-Za-z_][A-Za-z0-9_]*)?")
_MEASURE = re.compile(r"(?<![A-Za-z0-9_.])Measure\s+")
# fixed values: what a synthetic local and universe look like, how a local is declared, words of sorts that aren't universes
_MADE = re.compile(r"[A-Za-z_α-ωΑ-Ω][^\s:(),{}\[\]]*?[✝†][⁰¹²³⁴⁵⁶⁷⁸⁹]*")
_MADE_UNIVERSE = re.compile(r"\?u\.(\d+)")
_LOCAL = re.compile(r"(.+?)\s+:\s+(.+)")
_LEVEL = re.compile(r"\b(?:Type|Sort)\s+([^)\],}\n]+|\([^)\n]+\))")
_NOT_LEVELS = frozenset("Type Sort max imax succ".split())


def repaired(fragment: str, source: str, wanted: set[str]) -> str:
    """A fragment whose brackets were cut off, as the last bracket of the source that begins so has it, better one that names what is wanted."""
    if not fragment or not source or balanced(fragment):
        return fragment
    whole = [c.strip() for c in _ENCLOSED.findall(source) if c.startswith(fragment)]
    naming = [c for c in whole if wanted.intersection(IDENTIFIER.findall(c))]
    return (naming or whole or [fragment])[-1]


def standalone_commands(statement: str | None, variables: list[dict], instances: list[str], source: str | None) -> list[str]:
    """Universe and variable commands that a declaration needs when its file is gone: sorts, then instances, then what is of other types."""
    chosen = set(needed(statement, variables, [])["names"])
    got = needed(statement, variables, [repaired((i or "").strip(), source or "", chosen) for i in instances])
    sorts, others = [], []
    for v in variables:
        name, kind = v["name"] or "", _MEASURE.sub("MeasureTheory.Measure ", (v["type"] or "").strip())
        if name not in chosen or not kind or not balanced(kind):
            continue
        how = "instance" if kind.startswith(f"{SPACE} ") else v["binder"]
        left = {"implicit": "{", "instance": "["}.get(how, "(")
        (sorts if _SORT.fullmatch(kind) else others).append(f"variable {left}{name} : {kind}{PAIRS[left]}")
    universes = [f"universe {' '.join(got['universes'])}"] if got["universes"] else []
    return universes + sorts + [f"variable [{i}]" for i in got["instances"]] + others


@by_slices(_STRINGS)
def standalone(statement, variables, instances, source):
    return standalone_commands(statement, variables or [], instances or [], source)


def qualify(value: str | None, namespace: str, source: str | None) -> str | None:
    """The text with the namespace before every name that the source declares; a name may end within a word only at a border of letters."""
    names = set(_DECLARED.findall(source or "")) - set(namespace.split("."))
    if not value or not names:
        return value

    def one(m: re.Match) -> str:
        word = m[0]
        if "'" in word:  # a border lies within
            hit = any(value[m.start() : e] in names and _EDGE.match(value, e) for e in range(m.end(), m.start(), -1))
        else:
            hit = word in names and _EDGE.match(value, m.end())
        return f"{namespace}.{word}" if hit else word

    return _WORD.sub(one, value)


@by_slices(T.StringType())
def qualified(value, namespace, source):
    return qualify(value, namespace or "", source)


def plain_opens(values: Column) -> Column:
    """Opened namespaces without what stands in parentheses over one or more entries.

    The entries are joined, each with an end mark, and one pattern takes out what lies from an entry that
    begins with a parenthesis to the first that ends with one, or to the end.
    """
    coded = F.transform(F.coalesce(values, F.array().cast(_STRINGS)), lambda x: _coded(text.strip(F.coalesce(x, F.lit("")))))
    left = F.split(F.regexp_replace(F.array_join(coded, ""), r"(?s)(?<![^\x01])\(.*?(?:\)\x01|\z)", ""), "\x01", -1)
    return F.transform(F.slice(left, F.lit(1), F.size(left) - 1), lambda x: F.replace(F.replace(x, F.lit("\2a"), F.lit("\1")), F.lit("\2b"), F.lit("\2")))


def _coded(x: Column) -> Column:
    """The entry with an end mark that it doesn't hold itself."""
    return F.concat(F.replace(F.replace(x, F.lit("\2"), F.lit("\2b")), F.lit("\1"), F.lit("\2a")), F.lit("\1"))


def _odd(name: str) -> bool:
    return any(c in "✝†" or unicodedata.category(c) in ("Lm", "No") for c in name)


def _locals(lines: list[str]) -> list[tuple[list[str], str]]:
    """(names, type) of each local; a line that declares nothing goes on with the one before it."""
    out: list[tuple[list[str], list[str]]] = []
    for line in filter(None, map(str.strip, lines)):
        m = None if line.startswith(("⊢", "case ")) else _LOCAL.match(line)
        if m:
            out.append((m[1].split(), [m[2]]))
        elif out:
            out[-1][1].append(line)
        else:
            raise ValueError(f"unrecognized local proof-state line: {line}")
    return [(names, " ".join(kind).strip()) for names, kind in out]


def _binder(names: list[str], kind: str) -> list[str]:
    names = [n for n in names if n != "_"]
    if not names:
        return [f"[{kind}]"]
    if all(n.startswith(("inst", "_inst")) or n == "thisInstance" for n in names):
        return [f"[{n} : {kind}]" for n in names]
    return [f"({' '.join(names)} : {kind})"]


def theorem(state: str | None, record_id: str | None) -> dict:
    """F-23: statement, universes, replacements (name as shown -> name as written) of the theorem that a first proof state shows, or error."""
    out: dict = {"statement": None, "universes": [], "replacements": {}, "error": None}
    before, mark, target = (state or "").rpartition("⊢")
    target = target.strip()
    if not mark or not target:
        return out | {"error": "proof state target is empty" if mark else "proof state has no target marker"}
    shown = "\n".join(x for x in before.splitlines() if not x.strip().startswith("case ")).strip()
    declared = [n for m in map(_LOCAL.match, map(str.strip, shown.splitlines())) if m for n in m[1].split() if _odd(n)]
    renamed = {
        n: f"{'inst_ld' if n.startswith(('inst', '_inst')) else 'ld_local'}_{i}" for i, n in enumerate(dict.fromkeys([*_MADE.findall(f"{shown}\n{target}"), *declared]))
    }
    # one name after the other, also where a name is part of another
    shown, target = (_MADE_UNIVERSE.sub(r"ldu_\1", reduce(lambda t, r: t.replace(*r), renamed.items(), x)) for x in (shown, target))
    try:
        given = [b for names, kind in _locals(shown.splitlines()) for b in _binder(names, kind)]
        both = f"{shown}\n{target}"
        own = {n for names, _ in _locals(both.rpartition("⊢")[0].splitlines()) for n in names}
    except ValueError as e:
        return out | {"error": str(e)}
    levels = [n for m in _LEVEL.finditer(both) for n in IDENTIFIER.findall(m[1]) if n not in _NOT_LEVELS] + re.findall(r"\bldu_\d+\b", both)
    name = "ld_" + (record_id or "").removeprefix("leandojo_")[:24]
    return out | {"statement": f"{' '.join([f'theorem {name}', *given])} : {target}", "universes": [n for n in dict.fromkeys(levels) if n not in own], "replacements": renamed}


THEOREM = T.StructType(
    [
        T.StructField("statement", T.StringType()),
        T.StructField("universes", _STRINGS),
        T.StructField("replacements", T.MapType(T.StringType(), T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)


@F.pandas_udf(THEOREM)
def theorems(state: pd.Series, record_id: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([theorem(s, r) for s, r in zip(state, record_id, strict=True)], columns=THEOREM.names)

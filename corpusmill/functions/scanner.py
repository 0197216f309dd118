"""Scanners that expressions cannot state: strings, line and nested block comments, brackets.

One automaton yields the code outside strings and comments; the Arrow UDFs are built on it. Cheap
built-in predicates come before them, since Spark runs a Python UDF on every row it is given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: words that begin a proof, brackets that nest, placeholders that are no proof
PROOF_WORDS = frozenset("by fun show exact calc match nomatch if let have suffices by_cases by_contra".split())
BRACKETS = {"(": ")", "[": "]", "{": "}", "\u27e8": "\u27e9"}
FORBIDDEN = frozenset(["sorry", "admit", "sorryAx"])
_EVENT = re.compile(r'--[^\n]*|/-|-/|"(?:\\.|[^"\\])*(?:"|\Z)|[()\[\]{}\u27e8\u27e9]|:=', re.S)
_WORD = re.compile(r"[^\W\d](?:\w|')*")


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def pieces(text: str) -> Iterator[tuple[int, str]]:
    """(position, mark) of brackets and := in code; comments and strings are skipped."""
    at = depth = 0
    while m := _EVENT.search(text, at):
        mark, at = m[0], m.end()
        if depth:
            if mark not in ("/-", "-/"):
                # inside a comment quotes, dashes and brackets mean nothing: go on right after the first character
                at = m.start() + (1 if len(mark) != 2 else 1)
                continue
            depth += 1 if mark == "/-" else -1
        elif mark == "/-":
            depth = 1
        elif not mark.startswith(("--", '"')) and mark != "-/":
            yield m.start(), mark


def blank(text: str) -> str:
    """The text with comments and strings as spaces."""
    out, at, depth, begin = [], 0, 0, 0
    while m := _EVENT.search(text, at):
        mark, at = m[0], m.end()
        if depth:
            if mark not in ("/-", "-/"):
                at = m.start() + 1
                continue
            depth += 1 if mark == "/-" else -1
            if not depth:
                out.append(" ")
                begin = at
        elif mark == "/-" or mark.startswith(("--", '"')):
            out.append(text[begin : m.start()])
            if mark == "/-":
                depth = 1
            else:
                out.append(" ")
                begin = at
    if not depth:
        out.append(text[begin:])
    return "".join(out)


def words(text: str) -> list[str]:
    """Identifiers in code (F-02)."""
    return _WORD.findall(blank(text))


def leading_code(text: str) -> str:
    """Without white space and comments in front (F-03)."""
    while True:
        text = text.lstrip()
        if text.startswith("--"):
            text = text.partition("\n")[2]
        elif text.startswith("/-"):
            depth = 0
            for m in re.finditer(r"/-|-/", text):
                depth += 1 if m[0] == "/-" else -1
                if not depth:
                    text = text[m.end() :]
                    break
            else:
                return ""
        else:
            return text


def assignment(text: str) -> int | None:
    """Where the declaration's := stands (F-01); ValueError where several could be it."""
    stack, found = [], []
    for at, mark in pieces(text):
        if mark in BRACKETS:
            stack.append(BRACKETS[mark])
        elif mark == ":=":
            if not stack:
                found.append(at)
        elif stack and stack[-1] == mark:
            stack.pop()
    for at in found:
        first = re.match(r"[A-Za-z_][A-Za-z0-9_']*", leading_code(text[at + 2 :]))
        if first and first[0] in PROOF_WORDS:
            return at
    if len(found) > 1:
        raise ValueError("ambiguous declaration assignment")
    return found[0] if found else None


def split_one(text: str | None) -> tuple[str | None, str | None, str | None]:
    """(statement, proof, error)."""
    if text is None:
        return None, None, None
    code = text.strip()
    if code.startswith("```"):
        code = re.sub(r"\n?```\s*\Z", "", re.sub(r"\A```[^\n]*\n?", "", code)).strip()
    try:
        at = assignment(code)
    except ValueError as e:
        return code, "", str(e)
    if at is None:
        return code, "", None
    return code[:at].rstrip(), re.sub(r"^:=\s*", "", code[at + 2 :].strip()), None


@F.pandas_udf(_strings("statement", "proof", "error"))
def _split(c: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([split_one(t) for t in c], columns=["statement", "proof", "error"])


def split_declaration(df: DataFrame, column: str, into: str = "parts") -> DataFrame:
    """The frame with a struct of statement, proof and error; text without strings, comments, brackets and with at most one := needs no Python."""
    c = F.col(column)
    plain = ~c.rlike(r'"|--|/-|[(\[{⟨]|```|\r') & (F.regexp_count(c, F.lit(":=")) <= 1)
    plain = F.coalesce(plain, F.lit(True))
    strip = lambda x, end: F.regexp_replace(x, r"(?U)\s+$" if end else r"(?U)^\s+|\s+$", "")
    at = F.instr(c, ":=")
    statement = F.when(at > 0, strip(F.regexp_replace(F.substring_index(c, ":=", 1), r"(?U)^\s+", ""), True)).otherwise(strip(c, False))
    proof = F.when(at > 0, strip(F.substring_index(c, ":=", -1), False)).otherwise("")
    fast = df.where(plain).withColumn(into, F.when(c.isNotNull(), F.struct(statement.alias("statement"), proof.alias("proof"), F.lit(None).cast("string").alias("error"))))
    return fast.unionByName(df.where(~plain).withColumn(into, _split(column)))


@F.pandas_udf(T.BooleanType())
def _forbidden(c: pd.Series) -> pd.Series:
    return c.map(lambda t: any(w in FORBIDDEN for w in words(t)))


def flag_forbidden(df: DataFrame, column: str, into: str = "forbidden") -> DataFrame:
    """The frame with a flag for sorry, admit or sorryAx in code (V-03); only rows that hold such a string are scanned."""
    may = F.coalesce(F.col(column).rlike("sorry|admit"), F.lit(False))
    return df.where(~may).withColumn(into, F.lit(False)).unionByName(df.where(may).withColumn(into, _forbidden(column)))


def compose_one(statement: str, proof: str) -> tuple[str | None, str | None]:
    """(declaration, error) of a statement and a proof term, tactic body or matching declaration (F-12)."""
    same = lambda t: re.sub(r"\s+", " ", t).strip()
    head, _, error = split_one(statement)
    proof = re.sub(r"^:=\s*", "", proof.strip())
    if re.match(r"\s*(?:@\[[^\]]*\]\s*)*(?:(?:private|protected|nonrec)\s+)*(?:theorem|lemma|example)(?:\s+|\()", proof):
        own, proof, error = split_one(proof)
        if error or same(own) != same(head):
            return None, "generated declaration does not match target statement"
    if not proof.strip():
        return None, "empty proof RHS"
    if not re.match(r"by(?:\s|$)|(?:fun|show|calc|match|nomatch|if|let)(?:\s|$)|[⟨(@]", proof):
        proof = "by\n" + "\n".join(f"  {x}" if x.strip() else "" for x in proof.strip().splitlines())
    return f"{head} := {proof.strip()}", None


@F.pandas_udf(_strings("code", "error"))
def compose(statement: pd.Series, proof: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([compose_one(s or "", p or "") for s, p in zip(statement, proof, strict=True)], columns=["code", "error"])


def closure(names: dict[str, list[str]], wanted: list[str]) -> list[str]:
    """All variables that the wanted ones depend on, directly or not, in their own order (F-21)."""
    need, todo = set(), list(wanted)
    while todo:
        n = todo.pop()
        if n in names and n not in need:
            need.add(n)
            todo += names[n]
    return [n for n in names if n in need]


@F.pandas_udf(T.ArrayType(T.StringType()))
def dependencies(names: pd.Series, needs: pd.Series, wanted: pd.Series) -> pd.Series:
    """F-21 over columns: names, what each of them needs, and the wanted ones."""
    return pd.Series([closure({n: list(d) for n, d in zip(ns, ds, strict=True)}, list(w)) for ns, ds, w in zip(names, needs, wanted, strict=True)])

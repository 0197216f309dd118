"""Source contexts: the stated cases, an independent reading of random sources, records on exactly one side."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import contexts as C
from corpusmill.operators import contexts as K

DEMO = """import Mathlib.Data.Nat.Basic
open Nat
noncomputable section
namespace Demo
variable {α : Type*}
section Old
local notation "old" => True
end Old
section Local
open scoped BigOperators
/-!
  a comment that must not become part of `open scoped`.
-/
local macro "contextTruth" : term => `(True.intro)
attribute [local simp] Nat.add_zero
variable (obsolete) in
lemma previous : True := by trivial
theorem t : True := by
  exact contextTruth
end Local
end Demo
end
"""


def test_only_what_is_active():
    c = C.active_context(DEMO, 18)
    assert (c["imports"], c["namespaces"], c["sections"], c["open_namespaces"], c["scopes"]) == (["Mathlib.Data.Nat.Basic"], ["Demo"], ["Local"], ["Nat"], ["BigOperators"])
    rendered = "\n".join(c["active_commands"])
    assert "contextTruth" in rendered and not any(x in rendered for x in ('"old"', "a comment", "obsolete"))
    assert c["closing_commands"] == ["end Local", "end Demo", "end"]


def test_nested_scopes_close_inside_out():
    source = "import Mathlib\nnamespace Outer\nsection Local\nnamespace Inner\nvariable {α : Type*}\ntheorem t : True := by trivial\nend Inner\n"
    c = C.active_context(source, 6)
    assert (c["namespaces"], c["sections"], c["closing_commands"]) == (["Outer", "Inner"], ["Local"], ["end Inner", "end Local", "end Outer"])


@pytest.mark.parametrize(
    ("source", "wanted"),
    [
        ("namespace A\nnoncomputable section\nopen Nat\nend\nopen X\n", {"namespaces": ["A"], "open_namespaces": ["X"], "closing_commands": ["end A"]}),
        ("variable (a : Nat)\n  {b c : Int} [Monoid b]\n", {"variable_commands": ["variable (a : Nat)\n  {b c : Int} [Monoid b]"], "local_instances": ["Monoid b"]}),
        ("open scoped B\nopen A A C", {"scopes": ["B"], "open_namespaces": ["A", "C"]}),
        ("end\nend X\nopen Y", {"open_namespaces": ["Y"], "closing_commands": []}),
        ("/- a /- b -/ open Z -/ open W", {"open_namespaces": []}),
        ("/- a -/\nopen W -- note\n-/-\nopen V", {"open_namespaces": ["W", "--", "note"]}),
        ("set_option linter.all false\nset_option maxRecDepth 9", {"active_commands": ["set_option maxRecDepth 9"], "option_commands": ["set_option linter.all false", "set_option maxRecDepth 9"]}),
        ("", {"active_commands": [], "error": None}),
    ],
)
def test_edges(source, wanted):
    got = C.active_context(source, len(source.splitlines()) + 1)
    assert {k: got[k] for k in wanted} == wanted


def test_lines_that_are_not_there():
    assert "positive" in C.active_context("a", 0)["error"] and "exceeds 1" in C.active_context("a", 3)["error"]
    assert C.active_context(None, 1)["error"] and C.active_context("a", None)["error"]


def masked(source):
    """Character by character over the whole file, line breaks kept."""
    out, depth, i = [], 0, 0
    while i < len(source):
        two = source[i : i + 2]
        if two == "/-" or (two == "-/" and depth):
            depth += 1 if two == "/-" else -1
            out.append("  ")
            i += 2
        else:
            out.append(source[i] if not depth or source[i] == "\n" else " ")
            i += 1
    return "".join(out).split("\n")


def brute(source):
    """(active commands, closings) by walking back: a scope is active if what opens after it is closed by itself."""
    lines, seen = source.split("\n"), masked(source)
    word = [s.split("--")[0].split() for s in seen]
    is_open = [bool(re.fullmatch(r"\s*(namespace\s+[\w'.]+|(public\s+)?section(\s+[\w'.]+)?|noncomputable\s+section(\s+[\w'.]+)?)\s*", s.split("--")[0])) for s in seen]
    is_end = [bool(re.fullmatch(r"\s*end(\s+[\w'.]+)?\s*", s.split("--")[0])) for s in seen]
    depth_now, owner, stack = 0, [], [0]
    count = 0
    for o, e in zip(is_open, is_end, strict=True):
        if o:
            count += 1
            stack.append(count)
        elif e and len(stack) > 1:
            stack.pop()
        owner.append(stack[-1])
        depth_now = len(stack)
    alive, commands = set(stack), []
    for i, text in enumerate(lines):
        code = seen[i].strip()
        if is_open[i]:
            if owner[i] in alive:
                commands.append((owner[i], " ".join(w for w in word[i] if w != "public")))
            commands.append(None)
        elif not code or code.startswith("--"):
            continue
        elif is_end[i] and not (owner[i] == 0 and (i == 0 or owner[i - 1] == 0)):
            commands.append(None)
        elif word[i] and word[i][0] == "import":
            commands.append(None)
        elif text[:1].isspace() and commands and commands[-1] is not None and commands[-1][1] is not None and commands[-1][0] == owner[i]:
            commands[-1] = (owner[i], commands[-1][1] + "\n" + text)
        elif code.startswith(C.COMMANDS):
            commands.append((owner[i], text))
        else:
            commands.append(None)
    order = {s: i for i, s in enumerate(stack)}
    kept = [c for c in commands if c and c[0] in alive]
    kept = [c[1].rstrip() for c in sorted(kept, key=lambda c: order[c[0]])]
    flat = lambda c: " ".join(x.strip() for x in c.splitlines())
    assert depth_now == len(stack)
    return [c for c in kept if not flat(c).startswith("set_option linter.") and not flat(c).endswith(" in")]


def test_random_sources_against_another_reading(spark):
    rnd = random.Random(8)
    kinds = ["namespace N{}", "section", "section S{}", "noncomputable section", "end", "end X{}", "open A{}", "open scoped B{}", "variable (x{} : Nat)", "  {{y{} : Int}}", "/- c", "-/ open D{}", "-- open E{}", "theorem t{} : True", "import M{}", "variable (z{}) in", "set_option linter.u{} false", "public section P{}", "", "   "]
    sources = ["\n".join(rnd.choice(kinds).format(rnd.randrange(5)) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, s, len(s.splitlines()) + 1) for i, s in enumerate(sources)], "i int, source string, line int").repartition(3)
    got = {r.i: r.active_commands for r in df.select("i", C.contexts("source", "line").alias("x")).select("i", "x.*").collect()}
    for i, s in enumerate(sources):
        assert got[i] == brute(s), s


RECORD = "record_id long, source string, source_file string, source_commit string, source_line int, raw_declaration string, tactics array<string>, statement string, proof string, imports array<string>, namespace string, source_dataset string, variable_context string"


def record(i, **change):
    base = {
        "record_id": i, "source": DEMO, "source_file": "Demo.lean", "source_commit": "abc", "source_line": 18, "raw_declaration": "theorem t : True := by\n  exact contextTruth", "tactics": [],
        "statement": "⊢ True", "proof": "by\n  exact contextTruth", "imports": ["Mathlib"], "namespace": "A.B", "source_dataset": "LeanDojo", "variable_context": None,
    }
    return tuple((base | change).values())


def test_records_are_on_one_side_and_contexts_replay(spark):
    rows = [
        record(0), record(1, source=None), record(2, source_file=" "), record(3, source_line=None), record(4, source_line=99), record(5, source_line=0), record(6, raw_declaration=None),
        record(7, raw_declaration="theorem t := x := y"), record(8, tactics=["intro h\n\nsimp", " ", None]), record(9, imports=None, namespace=None, source=None),
    ]
    df = K.from_sources(spark.createDataFrame(rows, RECORD))
    good, bad = (x.collect() for x in K.sides(df))
    assert sorted(r.record_id for r in good) == [0, 8] and sorted(r.record_id for r in bad) == [1, 2, 3, 4, 5, 6, 7, 9]
    reasons = {r.record_id: r.reason for r in bad}
    assert "not found" in reasons[1] and "lacks" in reasons[2] and "lacks" in reasons[3] and "exceeds" in reasons[4] and "positive" in reasons[5] and "header" in reasons[6] and "ambiguous" in reasons[7]
    assert all(r.context.recovery_errors == [r.reason] and r.verification_error_type == "missing_context" and not r.context.active_commands for r in bad)
    assert next(r for r in bad if r.record_id == 1).context.namespaces == ["A", "B"]
    by = {r.record_id: r for r in good}
    assert by[0].statement == "theorem t : True" and by[0].proof_state_statement == "⊢ True" and by[8].proof == "by\n  intro h\n\n  simp"

    out = {r.id: r for r in K.assembled(K.applied(df, "env")).collect()}
    whole = out[0].assembled
    assert whole.startswith("open Nat\n\nnoncomputable section\n\nnamespace Demo") and whole.endswith("exact contextTruth\n\nend Local\n\nend Demo\n\nend")
    assert (out[0].namespace, out[0].imports, out[0].source_kind) == ("Demo", ["Mathlib.Data.Nat.Basic"], "leandojo")
    assert out[1].assembled == "namespace A\n\nnamespace B\n\n⊢ True := by\n  exact contextTruth\n\nend B\n\nend A" and out[9].imports is None
    assert len({json.dumps(out[i].context_hashes.asDict()) for i in (0, 1)}) == 2 and out[0].context_hashes == out[8].context_hashes
    assert K.payload(K.applied(df, "env")).where("source_file is null or environment_hash is null or id is null").isEmpty()


def test_partial_contexts_are_never_replayed(spark):
    records = spark.createDataFrame([(1, "theorem t (x : Nat) (h : x = x) : True", None, None, None, "by\n  trivial"), (2, "", ["M"], "c", 4, "x")], "record_id long, statement string, imports array<string>, source_commit string, source_line int, proof string")
    steps = spark.createDataFrame([(1, 1, "later", "trivial", "no goals"), (1, 0, "x : Nat\n_ : Nat\ninst✝ : Ring x\nh : x = x\ncase a : b\n⊢ True", "simp", None)], "record_id long, step int, state_before string, tactic string, state_after string")
    got = {r.record_id: r.context for r in K.from_states(records, steps).collect()}
    assert [v.name for v in got[1].variables] == ["x", "inst✝"] and [v.name for v in got[1].hypotheses] == ["h"] and got[1].local_instances == ["Ring x"]
    assert got[1].recovery_sources == ["proof_state", "statement", "tactic_trace"] and got[2].recovery_sources == [] and got[1].imports == ["Mathlib"] and got[2].imports == ["M"]
    rows = [{"state_before": "x : Nat\n_ : Nat\ninst✝ : Ring x\nh : x = x\ncase a : b\n⊢ True", "tactic": "simp", "state_after": None}, {"state_before": "later", "tactic": "trivial", "state_after": "no goals"}]
    assert got[1].source_hash == hashlib.sha256(json.dumps(rows, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    df = K.from_states(records, steps).withColumns({c: F.lit(None).cast("string") for c in ("namespace", "variable_context", "source_file")}).withColumn("source_dataset", F.lit("InternLM/Lean-Workbook"))
    assert {r.id: r.assembled for r in K.assembled(K.applied(df, "e")).collect()}[1] == "theorem t (x : Nat) (h : x = x) : True := by\n  trivial"


def test_empty_tables(spark):
    assert K.assembled(K.applied(K.from_sources(spark.createDataFrame([], RECORD)), "e")).isEmpty()


def test_bound_names_and_brackets():
    assert C.bound_names("theorem t (a b : Nat) {c : (d : e)} [Inst f] [g : H] (no colon) (i : j : k") == {"a", "b", "c", "g"}
    assert C.bound_names("(x [y : z] : w)") == {"x", "y"} and C.bound_names("") == set()
    assert [C.balanced(x) for x in ("", "(a {b} [c])", "(]", "(", ")", "([)]", "a")] == [True, True, False, False, False, False, True]


def brute_needed(statement, variables):
    free = set(re.findall(r"(?:[^\W\d]|_)[\w']*", statement)) - C.bound_names(statement)
    chosen = {n for n, _ in variables if n in free}
    for _ in variables:
        text = " ".join(k for n, k in variables if n in chosen)
        chosen |= {n for n, _ in variables if n in re.findall(r"(?:[^\W\d]|_)[\w']*", text)}
    return chosen


def test_needed_variables_two_ways(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(200):
        names = [f"v{k}" for k in range(rnd.randint(0, 9))]
        variables = [(rnd.choice(names), rnd.choice(["Type u", "Type*", *(f"Foo {rnd.choice(names)} ({rnd.choice(names)})" for _ in range(4))])) for _ in names]
        statement = "theorem t " + rnd.choice(["", "(v1 : Nat) ", "{v0 v2 : T} "]) + ": " + " ".join(rnd.choices([*names, "z"], k=2))
        rows.append((i, statement, [("explicit", n, "", k) for n, k in variables], [f"Ring {n}" for n in names[:2]] + ["Bad (v1"]))
    rows += [(900, None, None, None), (901, "a", [("explicit", "a", "", "b"), ("explicit", "b", "", "a")], [])]
    df = spark.createDataFrame(rows, "id long, statement string, variables array<struct<binder:string,name:string,raw:string,type:string>>, local_instances array<string>").repartition(3)
    got = {r.id: r.x for r in df.select("id", C.needed_variables("statement", "variables", "local_instances").alias("x")).collect()}
    joined = {}
    for r in K.needed_by_joins(df, "id").collect():
        joined.setdefault(r.id, set()).add(r.name)
    for i, statement, variables, instances in rows:
        want = brute_needed(statement or "", [(v[1], v[3]) for v in variables or []])
        assert set(got[i].closed) == want == joined.get(i, set()) and len(got[i].closed) == len(want)
        assert got[i].instances == [x for x in instances or [] if x.startswith("Ring") and x[5:] in want]
        assert got[i].universes == (["u"] if any(v[1] in want and v[3] == "Type u" for v in variables or []) else [])


def test_joins_read_each_statement_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("statement string, variables array<struct<binder:string,name:string,raw:string,type:string>>")
    def row(i):
        read.add(1)
        return f"theorem t : a{i}", [("explicit", f"a{i}", "", "b c"), ("explicit", "b", "", f"a{i}"), ("explicit", "d", "", "b")]

    df = spark.range(0, 40, 1, 3).withColumn("x", row("id")).select("id", "x.*")
    got = {(r.id, r.name) for r in K.needed_by_joins(df, "id").collect()}
    assert got == {(i, n) for i in range(40) for n in (f"a{i}", "b")} and read.value == 40


def test_spaces_of_measures_come_along():
    variables = [{"name": "α", "type": "Type u"}, {"name": "m", "type": "MeasurableSpace α"}, {"name": "n", "type": "MeasurableSpace β"}]
    assert C.needed("theorem t (f : α) : μ f", variables, ["Foo α", "Foo β"])["names"] == ["α", "m"]
    assert C.needed("theorem t (f : α) : f", variables, [])["names"] == ["α"]

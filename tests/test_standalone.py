"""Declarations that stand by themselves: stated cases, and random rows against plain readings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import standalone as S

STATE = "case h\nα : Type u_1\ninst✝² : Semiring α\na b : α\nh : a = b\n⊢ a + 0 = b"


def test_a_state_becomes_a_theorem():
    got = S.theorem(STATE, "leandojo_0123456789abcdef")
    assert got["statement"] == "theorem ld_0123456789abcdef (α : Type u_1) [inst_ld_0 : Semiring α] (a b : α) (h : a = b) : a + 0 = b"
    assert (got["universes"], got["replacements"], got["error"]) == (["u_1"], {"inst✝²": "inst_ld_0"}, None)


def test_universes_are_neither_sorts_nor_locals():
    got = S.theorem("F : Type u → Type v\nfᴴ : F α\nα : Type u\n⊢ fᴴ = fᴴ", "leandojo_feedface")
    assert got["universes"] == ["u", "v"] and "ld_local_0" in got["statement"] and "fᴴ" not in got["statement"]
    got = S.theorem("β : Sort (max ?u.3 w)\n⊢ Type ?u.12", "r" * 40)
    assert got["universes"] == ["ldu_3", "w", "ldu_12"] and got["statement"].startswith(f"theorem ld_{'r' * 24} (β")
    assert S.theorem("u : Nat\nx : Type u\n⊢ a\ny : Type v\n⊢ b", "r")["universes"] == ["v"]


@pytest.mark.parametrize(
    ("state", "wanted"),
    [
        (None, "proof state has no target marker"),
        ("x : Nat", "proof state has no target marker"),
        ("x : Nat\n⊢  ", "proof state target is empty"),
        ("loose\n⊢ a", "unrecognized local proof-state line: loose"),
        ("⊢ a", "theorem ld_r : a"),
        ("f :\n  x\ng : A\n   → B\n⊢ a", "unrecognized local proof-state line: f :"),
        ("g : A\n   → B\n\n_ : C\ninst inst_1 : D\n⊢ a\n  b", "theorem ld_r (g : A → B) [C] [inst : D] [inst_1 : D] : a\n  b"),
        ("x✝ : A\nx✝¹ : x✝\n⊢ x✝¹", "theorem ld_r (ld_local_0 : A) (ld_local_0¹ : ld_local_0) : ld_local_0¹"),
    ],
)
def test_states(state, wanted):
    got = S.theorem(state, "r")
    assert (got["error"] or got["statement"]) == wanted and (got["error"] is None) == wanted.startswith("theorem")


def test_cut_fragments():
    source = "variable [Foo (Bar α)] [Foo (Bar β)]\n[Foo (Baz\nγ)]"
    assert S.repaired("Foo (Bar", source, {"α"}) == "Foo (Bar α)" and S.repaired("Foo (Bar", source, {"δ"}) == "Foo (Bar β)"
    assert S.repaired("Foo (Baz", source, set()) == "Foo (Baz" and S.repaired("Foo", source, {"α"}) == "Foo" and S.repaired("(", "", set()) == "("


def variable(name, kind, binder="explicit"):
    return {"binder": binder, "name": name, "type": kind}


def test_commands_of_a_declaration():
    variables = [variable("f", "α → β"), variable("α", "Type u", "implicit"), variable("β", "Type*", "implicit"), variable("μ", "Measure α"), variable("m", "MeasurableSpace α", "implicit"), variable("x", "γ")]
    got = S.standalone_commands("theorem t : f = f ∧ μ = μ", variables, ["Ring (M", "Ring β", "Ring γ"], "variable [Ring (M α)]")
    assert got == [
        "universe u", "variable {α : Type u}", "variable [Ring (M α)]", "variable [Ring β]", "variable (f : α → β)", "variable {β : Type*}", "variable (μ : MeasureTheory.Measure α)", "variable [m : MeasurableSpace α]",
    ]
    assert S.standalone_commands(None, [], [], None) == [] == S.standalone_commands("theorem t : f", [variable("f", "(a"), variable("f", " ")], [], None)


def by_alternatives(value, namespace, source):
    names = sorted({m[1] for m in re.finditer(r"(?m)^\s*(?:theorem|lemma|def|abbrev)\s+(?:_root_\.)?([A-Za-z_][A-Za-z0-9_']*)", source)} - set(namespace.split(".")), key=len, reverse=True)
    return re.sub(rf"(?<![A-Za-z0-9_.'])(?:{'|'.join(map(re.escape, names))})\b", lambda m: f"{namespace}.{m[0]}", value) if names else value


def test_names_are_qualified(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        word = lambda: "".join(rnd.choice("ab_'1α.") for _ in range(rnd.randint(1, 4)))
        source = "\n".join(f"{rnd.choice(['theorem', '  def', 'lemma', 'axiom'])} {rnd.choice(['', '_root_.'])}{word()} : x" for _ in range(rnd.randint(0, 6)))
        rows.append((i, " ".join(word() for _ in range(12)), rnd.choice(["N", "a.b"]), source))
    df = spark.createDataFrame([*rows, (900, None, "N", "def a"), (901, "a", "N", None), (902, "", "N", "def a")], "id long, v string, n string, s string")
    got = {r.id: r.q for r in df.select("id", S.qualified("v", "n", "s").alias("q")).collect()}
    assert all(got[i] == by_alternatives(v, n, s) for i, v, n, s in rows) and sum(got[i] != v for i, v, _, _ in rows) > 50
    assert (got[900], got[901], got[902]) == (None, "a", "")


def test_plain_opens(spark):
    cases = [
        (["Nat", "Set", "(a", "b", "c)", "Foo"], ["Nat", "Set", "Foo"]), (["(a)", "B"], ["B"]), (["(a", "B"], []), ([" X ", None, "(", ")", "Y)"], ["X", "", "Y)"]),
        (["(a", "(b", "c)", "D"], ["D"]), ([], []), (None, []), (["()", "(", "x\1y)", "\1\2a\2", "a)("], ["\1\2a\2", "a)("]), (["(x\1)\1y", "z)", ""], [""]),
    ]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v array<string>")
    assert {r.i: r.x for r in df.select("i", S.plain_opens(F.col("v")).alias("x")).collect()} == {i: w for i, (_, w) in enumerate(cases)}


def test_columns_of_theorems_and_commands(spark):
    rows = [(1, STATE), (2, None), (3, "")]
    got = {r.i: r.x for r in spark.createDataFrame(rows, "i long, s string").select("i", S.theorems("s", F.lit("leandojo_x")).alias("x")).collect()}
    assert all(got[i].asDict() == S.theorem(s, "leandojo_x") for i, s in rows)
    df = spark.createDataFrame([(1, "t : a", [("explicit", "a", "Nat")], ["R a"], None), (2, None, None, None, None)], "i int, s string, v array<struct<binder:string,name:string,type:string>>, l array<string>, f string")
    assert {r.i: r.x for r in df.select("i", S.standalone("s", "v", "l", "f").alias("x")).collect()} == {1: ["variable [R a]", "variable (a : Nat)"], 2: []}

"""Scanners, text functions, hashes and scores on hand-written rows."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import hashing, scanner, scoring, text
from corpusmill.operators import gates, stats, traces
from corpusmill.operators.attempts import mcnemar


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("code", "statement", "proof"),
    [
        ("theorem t : 1 = 1 := by rfl", "theorem t : 1 = 1", "by rfl"),
        ("theorem t : let x := 1; x = 1 := by simp", "theorem t : let x := 1; x = 1", "by simp"),
        ("theorem t (x : Nat := 1) : x = x := rfl", "theorem t (x : Nat := 1) : x = x", "rfl"),
        ('theorem t : s = ":=" := by rfl', 'theorem t : s = ":="', "by rfl"),
        ("theorem t : a -- := no\n = b := fun x => x", "theorem t : a -- := no\n = b", "fun x => x"),
        ("theorem t : a /- /- := -/ := -/ = b := by simp", "theorem t : a /- /- := -/ := -/ = b", "by simp"),
        ("theorem t : a = b", "theorem t : a = b", ""),
        ("```lean\ntheorem t : a := by x\n```", "theorem t : a", "by x"),
    ],
)
def test_split(spark, code, statement, proof):
    df = spark.createDataFrame([(code,), (None,)], "code string")
    got = scanner.split_declaration(df, "code").where("code is not null").select("parts.*").first()
    assert (got.statement, got.proof, got.error) == (statement, proof, None)


def test_split_is_ambiguous():
    assert scanner.split_one("theorem t : let x := 1; let y := 2; x = y")[2]


@pytest.mark.parametrize(
    ("source", "expected"),
    [("by sorry", True), ("by admit", True), ("exact sorryAx foo", True), ("by simp -- sorry", False), ('exact "admit" /- /- sorry -/ x -/', False), ("mysorry", False), ("", False)],
)
def test_forbidden(spark, source, expected):
    df = spark.createDataFrame([(source,)], "proof string")
    assert scanner.flag_forbidden(df, "proof").first().forbidden is expected


def test_compose():
    assert scanner.compose_one("theorem t : a := by sorry", "simp\nring")[0] == "theorem t : a := by\n  simp\n  ring"
    assert scanner.compose_one("theorem t : a", "theorem t : b := x")[1]
    assert scanner.compose_one("theorem t : a", "theorem t :  a := by x")[0] == "theorem t : a := by x"
    assert scanner.compose_one("theorem t : a", " ")[1] == "empty proof RHS"


def test_closure():
    assert scanner.closure({"a": [], "b": ["a"], "c": ["b"], "d": []}, ["c"]) == ["a", "b", "c"]


def test_unicode_text(spark):
    assert one(spark, text.strip(F.lit("   a b \u0085"))) == "a b"
    df = spark.createDataFrame([("é",), ("abc",), (None,)], "t string")
    assert {r.t for r in text.nfc(df, "t").collect()} == {"é", "abc"} | {None}
    assert one(spark, text.normalize_lexical(F.lit("a \t b  \r\n c\t\r"))) == "a b\n c"
    assert one(spark, text.lines(F.lit("a\r\nb\n\nc\n"))) == ["a", "b", "", "c"]
    assert one(spark, text.tokens(F.lit("foo.bar' := x1 -> ℕ 12 \U0001d538"))) == ["foo.bar'", ":=", "x1", "->", "ℕ", "12", "\U0001d538"]


def test_hashes(spark):
    a, b = (one(spark, hashing.statement(F.lit(s))) for s in ("theorem foo : x = 1 :=", "theorem  bar :  x = 1"))
    assert a == b == hashlib.sha256(b"theorem <DECL_NAME> : x = 1").hexdigest()
    assert one(spark, hashing.structural(F.lit("lemma a : x = 1"))) == one(spark, hashing.structural(F.lit("theorem b : x  =  1 :=")))
    assert one(spark, hashing.length_prefixed(F.lit("ab"))) == hashlib.sha256(b"\0\0\0\0\0\0\0\2ab").hexdigest()
    assert one(spark, hashing.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    assert one(spark, hashing.jaccard(F.array(F.lit("a")), F.array().cast("array<string>"))) == 0.0


@pytest.mark.parametrize(("initial", "total", "attempts", "route"), [(5, 5, 8, "mastered"), (1, 1, 8, "active_pass8"), (0, 0, 8, "need_pass16_topup"), (0, 1, 16, "active_after_topup"), (0, 0, 16, "need_pass32_topup"), (0, 0, 32, "hard_bank"), (4, 9, 32, "active_pass8")])
def test_routes(spark, initial, total, attempts, route):
    assert one(spark, scoring.route(F.lit(initial), F.lit(total), F.lit(attempts))) == route


@pytest.mark.parametrize(("n", "c", "k"), [(32, 0, 4), (32, 32, 8), (32, 30, 4), (32, 5, 8), (8, 1, 8)])
def test_unbiased(spark, n, c, k):
    want = 0.0 if c == 0 else 1.0 if n - c < k else 1 - math.comb(n - c, k) / math.comb(n, k)
    assert one(spark, scoring.unbiased_pass(F.lit(n), F.lit(c), k)) == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize(("s", "a"), [(0, 0), (1, 8), (8, 8), (5, 32)])
def test_priority(spark, s, a):
    lb = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    want = sum(math.comb(8, i) * math.exp(lb(i + s + 1, 8 - i + a - s + 1) - lb(s + 1, a - s + 1)) for i in range(1, 5))
    assert one(spark, scoring.rollout_priority(F.lit(s), F.lit(a))) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(("a", "b"), [(0, 0), (3, 3), (1, 9), (20, 4)])
def test_mcnemar(spark, a, b):
    n, k = a + b, min(a, b)
    want = 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    assert one(spark, mcnemar(F.lit(a), F.lit(b))) == pytest.approx(want, abs=1e-12)


def test_percentile_rules_differ(spark):
    df = spark.createDataFrame([(float(v),) for v in (10, 20, 30, 40)], "v double")
    r = stats.ranked_percentiles(df, "v", [0.5]).first()
    assert (r.half_even, r.floor, r.ceil, r.median) == (30.0, 20.0, 20.0, 25.0)
    assert stats.ranked_percentiles(df.where("v > 99"), "v", [0.5]).count() == 0


def test_islands_and_gaps(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["a", "a", "b", "a", None, None, "a"])], "i long, id string")
    got = [r.island for r in traces.islands(df, "id", "i").orderBy("i").collect()]
    assert got == [1, 1, 2, 3, 4, 4, 5]
    wide = spark.createDataFrame([(i * 40_000, x) for i, x in enumerate("aabba")], "i long, id string")
    assert [r.island for r in traces.islands(wide, "id", "i").orderBy("i").collect()] == [1, 1, 2, 2, 3]


def test_rank_factors(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([-1.0, -2.0, -1.0, float("nan")])], "g int, i int, v double")
    tie = [r.f for r in df.select("i", traces.tie_rank_factor("v", "g", 0.3).alias("f")).orderBy("i").collect()]
    assert tie == pytest.approx([1 - 0.3 * 2.5 / 3, 1 - 0.3 * 1 / 3, 1 - 0.3 * 2.5 / 3, 1.0])
    by_index = [r.f for r in df.select("i", traces.index_rank_factor("v", "i", "g", 0.3).alias("f")).orderBy("i").collect()]
    assert by_index == pytest.approx([0.7, 0.9, 0.8, 1.0])


def test_gates(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "id int, v int")
    got = {r.id: r.violations for r in gates.violated(df, {"small": F.col("v") < 8}, ["id"]).collect()}
    assert got == {2: ["small"], 3: ["small"]}
    with pytest.raises(gates.GateError):
        gates.enforce(gates.violated(df, {"small": F.col("v") < 8}, ["id"]), "rows")
    assert gates.schema_equals(df, "id int, v string") == ["v: int for string"]


def test_runs(spark):
    assert one(spark, text.line_run(F.lit("a\na\n\n a \nb"))) == 3
    assert one(spark, text.char_run(F.lit("aaabbb\n\n\n\nc"))) == 4
    assert one(spark, text.output_class(F.lit(" "))) == "empty"
    assert one(spark, text.output_class(F.lit("by x\nby y"))) == "multiple_proofs"
    assert one(spark, text.output_class(F.lit("a b c " * 20))) == "repetitive_output"
    assert one(spark, text.output_class(F.lit("```x"))) == "unterminated_code_fence"


def test_values_of_a_batch_become_objects_by_slices(monkeypatch):
    """An Arrow batch of 1,000 texts is turned into Python objects 64 rows at a time; nulls, structs and empty batches pass."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from corpusmill.functions import rows, text

    seen = []
    made = rows.by_slices(T.StructType([T.StructField("x", T.StringType()), T.StructField("n", T.ArrayType(T.LongType()))]))(lambda a, b: seen.append(a) or {"x": a, "n": [b]})
    texts = pa.array([None, *map(str, range(999))])
    sizes = []
    monkeypatch.setattr(rows.pa, "concat_arrays", lambda parts: sizes.extend(map(len, parts)) or pa.chunked_array(parts).combine_chunks())
    got = made.func(texts, pa.array(range(1000)))
    assert max(sizes) == rows.SLICE == 64 and sum(sizes) == len(seen) == 1000
    assert got[0].as_py() == {"x": None, "n": [0]} and got[-1].as_py() == {"x": "998", "n": [999]}
    assert len(made.func(texts[:0], texts[:0])) == 0
    assert text._nfc.func(pa.array(["é", None])).to_pylist() == ["é", None]

"""Operators that are tables of rules: each document takes one of the stated rows, and the SQL states what that row gives."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import hashing, scanner, scoring
from corpusmill.operators import dedup, gates, records, traces
from corpusmill.operators import selection as S
from corpusmill.plans.registry import query


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float):
        return f"{x!r}::DOUBLE"
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def by_rows(name: str, inputs: str, outputs: Sequence[str], rows: Sequence[tuple[tuple, tuple]], op: Callable[[], Sequence[Column]]) -> None:
    """Row i of (input values, expected values) goes to the documents whose id is i modulo their number; op gives the outputs as columns."""
    values = ", ".join(f"({i}, {', '.join(map(_literal, want))})" for i, (_, want) in enumerate(rows))
    sql = f"WITH c(i, {', '.join(outputs)}) AS (VALUES {values}) SELECT doc_id, {', '.join(outputs)} FROM documents JOIN c ON doc_id % {len(rows)} = i"

    @query(name, sql)
    def _(t):
        known = t.spark.createDataFrame([(i, *given) for i, (given, _) in enumerate(rows)], f"i long, {inputs}")
        taken = t.documents.select("doc_id").join(F.broadcast(known), F.col("doc_id") % len(rows) == F.col("i"))
        return taken.select("doc_id", *(c.alias(o) for o, c in zip(outputs, op(), strict=True)))


# what each message says, and the class that it belongs to by the list of classes
by_rows(
    "f29_failure_classes", "message string, timed_out boolean, has_errors boolean", ["class"],
    [
        (("error: (deterministic) timeout at whnf", False, True), ("timeout",)),
        (("anything", True, True), ("timeout",)),
        (("Pantograph server closed the connection", False, False), ("environment_error",)),
        (("pantograph said nothing more", False, False), ("unknown",)),
        (("Unknown identifier `exp`", False, True), ("version_incompatible_identifier",)),
        (("Unknown constant `one_le_rpow`", False, True), ("version_incompatible_identifier",)),
        (("Unknown identifier `h₁`", False, True), ("missing_hypothesis",)),
        (("Unknown identifier `this`", False, True), ("missing_hypothesis",)),
        (("Unknown identifier `xs`", False, True), ("missing_local_variable",)),
        (("Unknown constant `Nat.foo`", False, True), ("missing_import",)),
        (("Unknown constant `_root_.foo`", False, True), ("missing_import",)),
        (("unknown identifier 'x'", False, True), ("reference_elaboration_error",)),
        (("error: unexpected token ':='", False, True), ("reference_syntax_error",)),
        (("expected a term; syntax is wrong", False, True), ("reference_syntax_error",)),
        (("invalid `≤` notation", False, True), ("source_extraction_corruption",)),
        (("unsolved goals\n⊢ a = b", False, True), ("reference_unsolved_goals",)),
        (("linarith failed to find a contradiction", False, True), ("reference_tactic_failure",)),
        (("simp made no progress", False, True), ("reference_tactic_failure",)),
        (("No goals to be solved", False, True), ("reference_tactic_failure",)),
        (("unknown namespace `Foo`", False, True), ("missing_namespace",)),
        (("unknown parser declaration", False, True), ("missing_local_notation",)),
        (("type mismatch", False, True), ("reference_elaboration_error",)),
        (("type mismatch", False, False), ("unknown",)),
        ((None, None, None), ("unknown",)),
    ],
    lambda: [scoring.failure_class(F.col("message"), F.col("timed_out"), F.col("has_errors"))],
)

_FLAGS = ("success", "timed_out", "extraction_error", "forbidden_token", "environment_error", "internal_error")


def _run(message: str | None, *flags: str) -> tuple:
    return (message, *(f in flags for f in _FLAGS))


by_rows(
    "f30_run_status", "message string, " + ", ".join(f"{f} boolean" for f in _FLAGS), ["status", "detail"],
    [
        (_run("unsolved goals", "success"), ("success", "none")),
        (_run("unsolved goals", "timed_out", "internal_error"), ("timeout", "timeout")),
        (_run("  ", "extraction_error"), ("extraction_error", "empty_generation")),
        (_run("\n\t\u00a0", "extraction_error"), ("extraction_error", "empty_generation")),
        (_run("two fences", "extraction_error"), ("extraction_error", "proof_extraction_failed")),
        (_run("sorry", "forbidden_token"), ("forbidden_token", "forbidden_declaration")),
        (_run("", "environment_error"), ("environment_error", "environment_unavailable")),
        (_run("no such module", "environment_error"), ("environment_error", "missing_import")),
        (_run("failed to import Mathlib"), ("environment_error", "missing_import")),
        (_run("the Pantograph  server is gone"), ("environment_error", "environment_unavailable")),
        (_run("boom", "internal_error"), ("internal_error", "internal_exception")),
        (_run("environment lost", "internal_error"), ("environment_error", "environment_unavailable")),
        (_run("error: unsolved goals\n⊢ False"), ("unsolved_goals", "unsolved_goals")),
        (_run("unexpected token 'end'"), ("syntax_error", "unexpected_token")),
        (_run("parser error"), ("syntax_error", "parser_error")),
        (_run("expected closing token"), ("syntax_error", "parser_error")),
        (_run("unknown identifier 'foo'"), ("elaboration_error", "unknown_identifier")),
        (_run("Unknown constant 'Nat.bar'"), ("elaboration_error", "unknown_constant")),
        (_run("invalid field notation, type is a constant"), ("elaboration_error", "invalid_field")),
        (_run("tactic 'simp' failed"), ("tactic_error", "tactic_execution_failed")),
        (_run("no goals to be solved"), ("tactic_error", "tactic_execution_failed")),
        (_run("application type mismatch"), ("elaboration_error", "application_type_mismatch")),
        (_run("type mismatch"), ("elaboration_error", "type_mismatch")),
        (_run("failed to synthesize instance"), ("elaboration_error", "failed_to_synthesize")),
        (_run("motive is not correct"), ("elaboration_error", "unclassified_elaboration")),
        (_run(None), ("elaboration_error", "unclassified_elaboration")),
    ],
    lambda: (lambda x: [x["status"], x["detail"]])(scoring.diagnostics_status(F.col("message"), **{f: F.col(f) for f in _FLAGS})),
)

_joined = lambda x, *names: [F.array_join(x[n], "|") for n in names]

by_rows(
    "f15_preamble_lines", "lines array<string>, header string", ["imports", "context", "unknown"],
    [
        ((["Mathlib", "open Nat", "mystery command"], None), ("Mathlib", "open Nat|mystery command", "mystery command")),
        ((["import Mathlib.Data", "Mathlib.Data", " import  Aesop "], None), ("Mathlib.Data|Aesop", "", "")),
        ((["end Foo", "section", "sections"], None), ("", "end Foo|section|sections", "end Foo")),
        ((["variables (x : Nat)", "universes u", "notation a", "include h", "omit h"], None), ("", "variables (x : Nat)|universes u|notation a|include h|omit h", "")),
        ((["Mathlib.Data_x.Foo'", "Mathlib.data", "mathlib"], None), ("Mathlib.Data_x.Foo'", "Mathlib.data|mathlib", "Mathlib.data|mathlib")),
        ((["local notation x", "local instance y", "local z"], None), ("", "local notation x|local instance y|local z", "local z")),
        ((["noncomputable section", "set_option a true", "attribute [simp] b", ""], None), ("", "noncomputable section|set_option a true|attribute [simp] b", "")),
        (([], "import A\nMathlib\nopen B\n\nwhat"), ("A", "Mathlib|open B|what", "Mathlib|what")),
        ((["B", "opened"], "import B\nimport C"), ("B|C", "opened", "opened")),
        ((["open scoped Topology", "namespace N", "universe u v"], "variable (n)"), ("", "open scoped Topology|namespace N|universe u v|variable (n)", "")),
        ((["import "], "import "), ("", "import|import", "import|import")),
    ],
    lambda: _joined(records.preamble(F.col("lines"), F.col("header")), "imports", "context", "unknown"),
)

by_rows(
    "f13_wrapped_sources", "declaration string, context array<string>, namespace string, label string", ["wrapped"],
    [
        (("theorem t : a := b ", None, None, None), ("theorem t : a := b\n",)),
        (("t", ["open X"], None, None), ("open X\n\nt\n",)),
        (("t", ["section", " namespace A ", ""], None, None), ("section\nnamespace A\n\nt\n\nend\nend\n",)),
        (("t", ["section B", "end B"], None, None), ("section B\nend B\n\nt\n",)),
        (("t", ["end", "end", "section"], None, None), ("end\nend\nsection\n\nt\n\nend\n",)),
        (("t", ["noncomputable section"], None, None), ("noncomputable section\n\nt\n",)),
        (("t", ["sections", "namespaces"], None, None), ("sections\nnamespaces\n\nt\n",)),
        (("t", None, "N", None), ("namespace N\n\nt\n\nend N\n",)),
        (("t", None, None, "row 7"), ("-- label: row 7\nt\n",)),
        (("t", ["namespace M"], "N", "x"), ("namespace N\n\nnamespace M\n\n-- label: x\nt\n\nend\n\nend N\n",)),
        (("t", ["namespace M", "section", "end", "section S"], None, None), ("namespace M\nsection\nend\nsection S\n\nt\n\nend\nend\n",)),
    ],
    lambda: [records.wrapped_source(F.col("declaration"), F.col("context"), F.col("namespace"), F.col("label"))],
)

by_rows(
    "f34_proof_rewards", "proof string, forbidden boolean, compiled boolean, tokens int, reference_tokens int", ["format", "compile", "brevity", "reward"],
    [
        (("by simp", False, True, 5, 10), (0.1, 1.0, 0.05, 1.15)),
        (("by simp", False, True, 10, 10), (0.1, 1.0, 0.0, 1.1)),
        (("by simp", False, True, 20, 10), (0.1, 1.0, 0.0, 1.1)),
        (("by simp", False, True, 5, None), (0.1, 1.0, 0.0, 1.1)),
        (("by simp", False, True, 5, 0), (0.1, 1.0, 0.0, 1.1)),
        (("by simp", False, False, 5, 10), (0.1, 0.0, 0.0, 0.1)),
        (("by sorry", True, True, 5, 10), (0.0, 0.0, 0.0, 0.0)),
        (("  ", False, True, 0, 10), (0.0, 0.0, 0.0, 0.0)),
        ((None, False, True, 0, 10), (0.0, 0.0, 0.0, 0.0)),
        (("by omega", False, True, 1, 100), (0.1, 1.0, 0.099, 1.199)),
        (("by ring", False, True, 3, 4), (0.1, 1.0, 0.025, 1.125)),
    ],
    lambda: (lambda x: [F.round(x[n], 9).cast("decimal(12,3)").cast("double") for n in ("format", "compile", "brevity", "reward")])(
        scoring.reward(F.col("proof"), F.col("forbidden"), F.col("compiled"), F.col("tokens"), F.col("reference_tokens"))
    ),
)

by_rows(
    "p30_reconstruction_reasons",
    "recovered boolean, found boolean, steps int, contiguous boolean, final_state string, proof string, forbidden boolean, full_name string", ["reason"],
    [
        ((True, True, 2, True, "no goals", "by simp", False, "A.b"), (None,)),
        ((False, False, 0, False, "", None, True, "_private.x"), ("invalid_syntax",)),
        ((True, False, 0, True, "no goals", "p", False, "A"), ("missing_context",)),
        ((True, True, 0, False, "no goals", "p", False, "A"), ("empty_proof",)),
        ((True, True, 3, False, "no goals", "p", False, "A"), ("corrupt_tactic_trace",)),
        ((True, True, 3, True, "⊢ x", "p", False, "A"), ("unsolved_goals",)),
        ((True, True, 3, True, None, "p", False, "A"), ("unsolved_goals",)),
        ((True, True, 3, True, " no goals ", "", False, "A"), ("empty_proof",)),
        ((True, True, 3, True, "no goals", None, True, "A"), ("empty_proof",)),
        ((True, True, 3, True, "no goals", "p", True, "A._private.b"), ("forbidden_declaration",)),
        ((True, True, 3, True, "no goals", "p", False, "A._private.b"), ("private_declaration",)),
        ((True, True, 3, True, "no goals", "p", False, "A.private"), (None,)),
    ],
    lambda: [F.regexp_replace(records.reconstruction_reason(*(F.col(c) for c in ("recovered", "found", "steps", "contiguous", "final_state", "proof", "forbidden", "full_name"))), "_text$", "")],
)


def _leaks(place: str, rows: Sequence[tuple[tuple, str]]) -> None:
    """A row of (proof, completion, text, reference_proof, reference_proof_hash), and the fields of the place's list that it gives away."""
    values = ", ".join(f"({i}, {_literal(want)})" for i, (_, want) in enumerate(rows))

    @query(f"v07_leaks_{place}", f"WITH c(i, leaked) AS (VALUES {values}) SELECT doc_id, leaked FROM documents JOIN c ON doc_id % {len(rows)} = i")
    def _(t):
        names = "proof string, completion string, text string, reference_proof string, reference_proof_hash string"
        known = t.spark.createDataFrame([(i, *given) for i, (given, _) in enumerate(rows)], f"i long, {names}")
        taken = t.documents.select("doc_id").join(F.broadcast(known), F.col("doc_id") % len(rows) == F.col("i"))
        return taken.select("doc_id", F.array_join(gates.leaked_fields(taken, place), ",").alias("leaked"))


_GIVEN = [(None,) * 5, ("p", None, None, None, None), (" \n\t", "c", "\n", None, "h"), (None, None, "t", "r", None), ("p", "c", "t", "r", "h")]
_leaks("benchmark", list(zip(_GIVEN, ["", "proof", "completion", "text,reference_proof", "proof,completion,text,reference_proof"], strict=True)))
_leaks("rollout", list(zip(_GIVEN, ["", "proof", "completion", "reference_proof", "proof,completion,reference_proof"], strict=True)))
_leaks("trainer", [(g, "proof,completion,text,reference_proof") for g in _GIVEN])
_leaks("reference_only", list(zip(_GIVEN, ["", "proof", "proof,completion,reference_proof_hash", "reference_proof", "proof,completion,reference_proof,reference_proof_hash"], strict=True)))


@query("v21_leakage_policy", """
WITH p AS (SELECT doc_id % 3 AS part, sha256(text) AS h FROM documents),
o AS (SELECT 'train_validation' AS pair, count(*) AS n FROM (SELECT h FROM p WHERE part = 0 INTERSECT SELECT h FROM p WHERE part = 1) x
  UNION ALL SELECT 'train_benchmark', count(*) FROM (SELECT h FROM p WHERE part = 0 INTERSECT SELECT h FROM p WHERE part = 2) x
  UNION ALL SELECT 'validation_benchmark', count(*) FROM (SELECT h FROM p WHERE part = 1 INTERSECT SELECT h FROM p WHERE part = 2) x)
SELECT pair, n AS count FROM o WHERE n > 0 AND pair <> 'train_benchmark'""")
def _(t):
    p = t.documents.select((F.col("doc_id") % 3).alias("part"), hashing.exact(F.col("text")).alias("h"))
    shared = lambda name, a, b: p.where(f"part = {a}").select("h").intersect(p.where(f"part = {b}").select("h")).agg(F.lit(name).alias("pair"), F.count("*").alias("count"))
    overlaps = shared("train_validation", 0, 1).unionByName(shared("train_benchmark", 0, 2)).unionByName(shared("validation_benchmark", 1, 2))
    return gates.leakage_violations(overlaps, train_benchmark=True)


@query("h18_payload_hashes", """
SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":' || to_json(lang) || ',"n_chars":' || n_chars || ',"source":' || to_json(source) || '}') AS payload_sha256 FROM documents""")
def _(t):
    rows = t.documents.select("doc_id", "lang", "n_chars", "source").withColumn("generation_payload_sha256", F.lit("old"))
    return rows.select("doc_id", hashing.payload(rows, "generation_payload_sha256").alias("payload_sha256"))


@query("a10_cross_source_statistics", """
WITH d AS (SELECT doc_id, doc_id % 2 AS side, sha256(text) AS pair, sha256(lang || n_chars) AS statement, sha256(source) AS proof FROM documents),
x AS (SELECT a.doc_id, EXISTS (SELECT 1 FROM d b WHERE b.side <> a.side AND b.pair = a.pair) AS e, EXISTS (SELECT 1 FROM d b WHERE b.side <> a.side AND b.statement = a.statement) AS s,
  EXISTS (SELECT 1 FROM d b WHERE b.side <> a.side AND b.proof = a.proof AND b.statement <> a.statement) AS p FROM d a WHERE a.side = 0)
SELECT count(*) FILTER (e) AS exact_duplicate_records, count(*) FILTER (s) AS theorem_overlap_records, count(*) FILTER (p) AS same_proof_different_statement_records FROM x""")
def _(t):
    d = t.documents.select((F.col("doc_id") % 2).alias("side"), hashing.exact(F.col("text")).alias("pair"), hashing.exact(F.concat("lang", F.col("n_chars").cast("string"))).alias("statement"), hashing.exact(F.col("source")).alias("proof"))
    return dedup.cross_source_statistics(d.where("side = 0"), d.where("side = 1"))


@query("a14_proof_homogeneity", """
WITH f AS (SELECT sha256(text) AS p, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, p) AS k FROM f)
SELECT CAST(sum(n) AS BIGINT) AS "rows", count(*) AS unique_proofs, CAST(sum(n - 1) AS BIGINT) AS duplicates, round(sum(n - 1) / sum(n)::DOUBLE, 9) AS duplicate_ratio,
  round(sum(n) FILTER (k <= 10) / sum(n)::DOUBLE, 9) AS top10_coverage, round(sum(n) FILTER (k <= 50) / sum(n)::DOUBLE, 9) AS top50_coverage FROM r""")
def _(t):
    return dedup.homogeneity(t.documents.select(hashing.exact(F.col("text")).alias("proof")), "proof")


@query("a35_original_success_counts", """
WITH {ATT}, v AS (SELECT problem_id, count(*) AS n, count(*) FILTER (success) AS successes FROM att WHERE attempt_index < 4 GROUP BY 1)
SELECT problem_id, successes, n = 4 AS covered FROM v""")
def _(t):
    made = t.attempts.where("attempt_index < 4").select(F.col("event_id").alias("generation_id"), F.col("problem_id").alias("statement_id"))
    verified = t.attempts.where("attempt_index < 4").select(F.col("event_id").alias("generation_id"), F.col("success").alias("verified"))
    out = dedup.success_counts(made, verified, 4)
    return out.select(F.col("statement_id").alias("problem_id"), "successes", "covered")


_ZERO = """
WITH {ATT}, h AS (SELECT problem_id, count(*) FILTER (success AND attempt_index >= 8) AS hs, count(*) FILTER (attempt_index >= 8) AS ha, count(*) FILTER (attempt_index < 8) AS n, bool_or(success AND attempt_index < 8) AS hit FROM att GROUP BY 1),
c AS (SELECT problem_id, hs, round(list_sum(list_transform([1, 2, 3, 4], lambda k: exp(lgamma(9) - lgamma(k + 1) - lgamma(9 - k) + lgamma(k + hs + 1) + lgamma(8 - k + ha - hs + 1) - lgamma(8 + ha + 2)
  - lgamma(hs + 1) - lgamma(ha - hs + 1) + lgamma(ha + 2)))), 7) AS priority, sha256('9:' || problem_id) AS tie FROM h WHERE n = 8 AND NOT hit)
"""


def _histories(t):
    return t.attempts.groupBy("problem_id").agg(
        F.count_if(F.expr("success and attempt_index >= 8")).alias("hs"), F.count_if(F.expr("attempt_index >= 8")).alias("ha"),
        F.count_if(F.expr("attempt_index < 8")).alias("n"), F.bool_or(F.expr("success and attempt_index < 8")).alias("hit"),
    ).where("n = 8 and not hit")


@query("o13_topup_by_posterior", _ZERO + "SELECT problem_id, hs > 0 AS seen, priority FROM c ORDER BY priority DESC, hs > 0 DESC, tie, problem_id LIMIT 64")
def _(t):
    return S.topup(_histories(t), 9, "problem_id", 64).select("problem_id", (F.col("hs") > 0).alias("seen"), "priority")


@query("o13_second_topup", _ZERO + "SELECT problem_id, priority FROM c WHERE hs > 0 ORDER BY priority DESC, tie, problem_id LIMIT 32")
def _(t):
    return S.topup(_histories(t).where("hs > 0"), 9, "problem_id", 32).select("problem_id", "priority")


_INTERPOLATED = """CASE WHEN s = 0 OR x >= 5 THEN 0.0 WHEN x <= 1 THEN 1.3
  ELSE [1.3, 1.1, 0.8, 0.6, 0.0][CAST(floor(x) AS INT)] * (1 - (x - floor(x))) + [1.3, 1.1, 0.8, 0.6, 0.0][CAST(least(ceil(x), 5) AS INT)] * (x - floor(x)) END"""


@query("f36_difficulty_weights", f"""
WITH {{ATT}}, g AS (SELECT problem_id, attempt_index // 16 AS half, count(*) FILTER (success) AS s, count(*) AS a FROM att GROUP BY 1, 2),
x AS (SELECT *, 8.0 * s / a AS x FROM g WHERE a = 16),
w AS (SELECT problem_id, half, {_INTERPOLATED} AS difficulty FROM x)
SELECT problem_id, CAST(half AS INT) AS half, round(difficulty, 9)::DOUBLE AS difficulty, 0.5::DOUBLE AS mass_scale,
  round(CASE WHEN e = 0 THEN 0 ELSE least(1.5, 16.0 / e) END, 9)::DOUBLE AS step_scale FROM (SELECT *, count(*) FILTER (difficulty > 0) OVER (PARTITION BY problem_id) AS e FROM w) z""")
def _(t):
    g = t.attempts.groupBy("problem_id", F.floor(F.col("attempt_index") / 16).cast("int").alias("half")).agg(F.count_if("success").alias("s"), F.count("*").alias("a")).where("a = 16")
    g = g.withColumn("difficulty", scoring.difficulty_weight(F.col("s"), F.col("a")))
    e = g.groupBy("problem_id").agg(F.count_if(F.col("difficulty") > 0).alias("e"))
    return g.join(e, "problem_id").select("problem_id", "half", F.round("difficulty", 9).alias("difficulty"), scoring.mass_scale(F.col("a")).alias("mass_scale"), F.round(scoring.step_scale(F.col("e")), 9).alias("step_scale"))


@query("w10_shaped_advantages", f"""
WITH {{ATT}}, v AS (SELECT problem_id, attempt_index, success, CASE WHEN event_type <> 'view' THEN -floor(value / 10) END AS v, count(*) OVER (PARTITION BY problem_id) AS a,
  count(*) FILTER (success) OVER (PARTITION BY problem_id) AS s FROM att),
r AS (SELECT *, 8.0 * s / a AS x, row_number() OVER (PARTITION BY problem_id ORDER BY v DESC NULLS LAST, attempt_index) - 1 AS k, count(v) OVER (PARTITION BY problem_id) AS n FROM v WHERE a = 32),
y AS (SELECT problem_id, attempt_index, CASE WHEN success THEN ({_INTERPOLATED}) * 0.25 * CASE WHEN v IS NULL THEN 1.0 ELSE 1.0 - 0.125 * (n - k) / n END ELSE 0.0 END AS y FROM r)
SELECT problem_id, attempt_index, round(y - avg(y) OVER (PARTITION BY problem_id), 9)::DOUBLE AS advantage FROM y""")
def _(t):
    sums = t.attempts.groupBy("problem_id").agg(F.count_if("success").alias("s"), F.count("*").alias("a")).where("a = 32")
    x = t.attempts.join(sums, "problem_id").withColumn("v", F.when(F.col("event_type") != "view", (-F.floor(F.col("value") / 10)).cast("double")))
    x = x.withColumn("factor", traces.index_rank_factor("v", "attempt_index", "problem_id", 0.125))
    return x.select("problem_id", "attempt_index", F.round(traces.shaped(F.col("success"), F.col("s"), F.col("a"), F.col("factor"), "problem_id"), 9).alias("advantage"))


_CONTEXT = "imports array<string>, namespaces array<string>, sections array<string>, open_namespaces array<string>, variables array<struct<name:string,type:string>>, active_commands array<string>, source_hash string, recovery_method string"
_HASHES = ("imports_hash", "namespace_hash", "scope_hash", "variable_context_hash", "context_hash")
_CONTEXTS = [
    (["Mathlib"], ["A"], [], ["Nat"], [("x", "Nat")], ["open Nat"], "h", "scan"),
    (["Mathlib", "Aesop"], ["A"], [], ["Nat"], [("x", "Nat")], ["open Nat"], "h", "scan"),
    (["Mathlib"], ["A", "B"], [], ["Nat"], [("x", "Nat")], ["open Nat"], "h", "scan"),
    (["Mathlib"], ["A"], ["s"], ["Nat"], [("x", "Nat")], ["open Nat"], "h", "scan"),
    (["Mathlib"], ["A"], [], ["Real"], [("x", "Nat")], ["open Nat"], "h", "scan"),
    (["Mathlib"], ["A"], [], ["Nat"], [("y", "ℝ → ℝ")], ["open Nat"], "h", "scan"),
    (["Mathlib"], ["A"], [], ["Nat"], [("x", "Nat")], [], "h", "scan"),
    (["Mathlib"], ["A"], [], ["Nat"], [("x", "Nat")], ["open Nat"], None, "scan"),
    (["Mathlib"], ["A"], [], ["Nat"], [("x", "Nat")], ["open Nat"], "h", ""),
    (["a\"b\\c"], [], [], [], [], ["é\n"], None, ""),
]


def _context_json(imports, namespaces, sections, opened, variables, active, source_hash, method) -> tuple[str, ...]:
    """The hashes by the standard library, from the documented layout of each part."""
    sha = lambda x: hashlib.sha256(json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    namespace = {"lexical": namespaces, "sections": sections}
    scope = {"open_namespaces": opened, "scopes": [], "local_notations": [], "local_attributes": [], "options": []}
    known = {"variables": [{"name": n, "type": k} for n, k in variables], "hypotheses": [], "variable_commands": [], "local_instances": []}
    whole = {"namespace": namespace, "scope": scope, "variables": known, "active_commands": active, "closing_commands": [], "source_hash": source_hash, "recovery_method": method}
    return sha(imports), sha(namespace), sha(scope), sha(known), sha(whole)


@query("h15_context_hashes", "WITH c(i, " + ", ".join(_HASHES) + ") AS (VALUES " + ", ".join(f"({i}, {', '.join(map(_literal, _context_json(*x)))})" for i, x in enumerate(_CONTEXTS)) + f") SELECT doc_id, {', '.join(_HASHES)} FROM documents JOIN c ON doc_id % {len(_CONTEXTS)} = i")
def _(t):
    known = t.spark.createDataFrame([(i, *x) for i, x in enumerate(_CONTEXTS)], f"i long, {_CONTEXT}")
    taken = t.documents.select("doc_id").join(F.broadcast(known), F.col("doc_id") % len(_CONTEXTS) == F.col("i"))
    return taken.select("doc_id", records.context_hashes(taken).alias("x")).select("doc_id", *(f"x.{h}" for h in _HASHES))


_NAMES = ["a", "b", "c", "d", "e"]
by_rows(
    "f21_dependencies", "names array<string>, needs array<array<string>>, wanted array<string>", ["needed"],
    [
        ((_NAMES, [[], ["a"], ["b"], [], ["e"]], ["c"]), ("a|b|c",)),
        ((_NAMES, [[], ["a"], ["b"], [], ["e"]], ["e", "d"]), ("d|e",)),
        ((_NAMES, [["e"], ["a"], ["b"], ["c"], ["d"]], ["a"]), ("a|b|c|d|e",)),
        ((_NAMES, [[], [], [], [], []], []), ("",)),
        ((_NAMES, [[], ["z"], [], [], []], ["b", "z"]), ("b",)),
        ((["x"], [["x"]], ["x", "x"]), ("x",)),
        (([], [], ["a"]), ("",)),
    ],
    lambda: [F.array_join(scanner.dependencies(F.col("names"), F.col("needs"), F.col("wanted")), "|")],
)

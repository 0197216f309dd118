"""Queries over the whole texts of all documents; those without SQL are tested by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import hashing, scanner, text
from corpusmill.operators import attempts as A
from corpusmill.operators import dedup, gates, leakage
from corpusmill.operators import selection as S
from corpusmill.plans.registry import query


@query("j08_token_similarity")
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("id"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\s]+"), F.lit(0))).alias("tokens"))
    return leakage.similar_sets(rows, rows).withColumn("score", F.round("score", 9))


@query("j12_key_and_field_gate", """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right_only' WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'flag' END AS reason
FROM (SELECT doc_id, (n_chars % 2)::INT AS flag FROM documents) d FULL JOIN (SELECT doc_id, quality AS flag FROM labels) l ON d.doc_id = l.doc_id
WHERE d.doc_id IS NULL OR l.doc_id IS NULL OR d.flag IS DISTINCT FROM l.flag""")
def _(t):
    left = t.documents.select("doc_id", (F.col("n_chars") % 2).cast("int").alias("flag"))
    return gates.mismatched(left, t.labels.select("doc_id", F.col("quality").alias("flag")), "doc_id", "flag")


def _halves(df, *columns):
    """Hashes of the two halves of each text, as statement s and proof p."""
    mid = F.floor(F.length("text") / 2).cast("int")
    return df.select(*columns, hashing.exact(F.left("text", mid)).alias("s"), hashing.exact(F.substr("text", mid + 1)).alias("p"))


#: The same in DuckDB.
_HALVES = "sha256(left(text, length(text) // 2)) AS s, sha256(substr(text, length(text) // 2 + 1)) AS p"


def _leaks(t, *levels):
    """Protected: all of benchmark, and the documents that labels hold for evaluation; level 0 by id, 1 by exact and 2 by normalised text."""
    keys = lambda df, kind, id_, *more: text.nfc(df.withColumn("k1", hashing.exact(F.col("text"))), "text").select(
        *more, F.concat(F.lit(kind), F.col(id_)).alias("k0"), "k1", hashing.normalized(F.col("text")).alias("k2"), hashing.theorem_group(F.col("text")).alias("theorem_group_id")
    )
    c = keys(t.documents, "documents:", "doc_id", F.col("doc_id").alias("id"))
    held = c.join(t.labels.select(F.col("doc_id").alias("id")), "id", "left_semi").drop("id")  # the hashes are shuffled, not the texts
    protected = keys(t.benchmark, "benchmark:", "item_id").unionByName(held)
    return leakage.levels(c, protected, {k: f"k{k}" for k in levels})


@query("j06_leakage_levels")
def _(t):
    return _leaks(t, 0, 1, 2).select("id", F.array_join(F.col("levels").cast("array<string>"), ",").alias("levels"), "removed")


@query("j09_group_removal")
def _(t):
    """Whole groups that go because one of their members is protected by id, text or normalised text."""
    return _leaks(t, 0, 1, 2).where("removed").groupBy("theorem_group_id").agg(F.count("*").alias("removed"))


@query("j07_structural_matches")
def _(t):
    """Documents whose tokens, without kind and name of the declaration, are those of a benchmark item."""
    form = lambda df, i: text.nfc(df.select(i, "text"), "text").select(i, hashing.structural(F.col("text")).alias("h"))
    return form(t.documents, "doc_id").join(form(t.benchmark, "item_id").select("h").distinct(), "h", "left_semi").select("doc_id")


@query("h13_token_jaccard", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ ]+') AS w FROM documents),
d AS (SELECT doc_id, list_distinct(w[1:len(w) // 2]) AS a, list_distinct(w[len(w) // 2 + 1:]) AS b FROM w)
SELECT doc_id, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END, 9) AS score FROM d""")
def _(t):
    d = t.documents.select("doc_id", F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)).alias("w"))
    mid = F.floor(F.size("w") / 2).cast("int")
    a, b = F.slice("w", F.lit(1), mid), F.slice("w", mid + 1, F.size("w") - mid)
    return d.select("doc_id", F.when(F.col("w").isNotNull(), F.round(hashing.jaccard(a, b), 9)).alias("score"))


@query("a03_role_dedup", f"""
WITH d AS (SELECT doc_id, {_HALVES} FROM documents)
SELECT doc_id, row_number() OVER (PARTITION BY s, p ORDER BY doc_id) = 1 AS kept_pair, row_number() OVER (PARTITION BY s ORDER BY doc_id) = 1 AS kept_statement FROM d""")
def _(t):
    rows = dedup.first_wins(_halves(t.documents, "doc_id"), ["s", "p"], "doc_id").withColumnRenamed("kept", "kept_pair")
    return dedup.first_wins(rows, ["s"], "doc_id").select("doc_id", "kept_pair", F.col("kept").alias("kept_statement"))


@query("a05_duplicate_groups")
def _(t):
    rows = text.nfc(t.documents.withColumn("exact", hashing.exact(F.col("text"))), "text").withColumn("normalized", hashing.normalized(F.col("text")))
    return dedup.duplicate_groups(rows, {0: ["doc_id"], 1: ["source", "n_chars"], 3: ["lang", "normalized"], 4: ["exact"]}, "doc_id")


@query("a07_variants", f"""
WITH d AS (SELECT {_HALVES} FROM documents)
SELECT 'statement' AS side, s AS key, count(DISTINCT p) AS variants, count(*) AS "rows" FROM d GROUP BY 2 HAVING count(DISTINCT p) >= 2
UNION ALL SELECT 'proof', p, count(DISTINCT s), count(*) FROM d GROUP BY 2 HAVING count(DISTINCT s) >= 2""")
def _(t):
    rows = _halves(t.documents)
    one = dedup.variants(rows, "s", "p").select(F.lit("statement").alias("side"), F.col("s").alias("key"), "variants", "rows")
    return one.unionByName(dedup.variants(rows, "p", "s").select(F.lit("proof").alias("side"), F.col("p").alias("key"), "variants", "rows"))


@query("a08_same_proof_statements", f"""
WITH d AS (SELECT {_HALVES} FROM documents) SELECT p AS proof, count(DISTINCT s) AS variants, count(*) AS "rows" FROM d GROUP BY 1 HAVING count(DISTINCT s) >= 2""")
def _(t):
    return dedup.variants(_halves(t.documents).withColumnRenamed("p", "proof"), "proof", "s")


@query("j05_cross_source_overlap", f"""
WITH d AS (SELECT doc_id, {_HALVES} FROM documents), a AS (SELECT * FROM d WHERE doc_id % 2 = 0), b AS (SELECT * FROM d WHERE doc_id % 2 = 1)
SELECT doc_id, (s, p) IN (SELECT (s, p) FROM b) AS pair, s IN (SELECT s FROM b) AS statement, p IN (SELECT p FROM b) AS proof FROM a""")
def _(t):
    d = _halves(t.documents, "doc_id")
    out = d.where("doc_id % 2 = 0")
    for name, keys in (("pair", ["s", "p"]), ("statement", ["s"]), ("proof", ["p"])):
        out = out.join(d.where("doc_id % 2 = 1").select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left")
    return out.select("doc_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("pair", "statement", "proof")))


@query("u02_union_then_dedup", """
WITH u AS (SELECT 0 AS f, doc_id AS i, sha256(text) AS k FROM documents UNION ALL SELECT 1, item_id, sha256(text) FROM benchmark)
SELECT f AS file, i AS id, row_number() OVER (PARTITION BY k ORDER BY f, i) = 1 AS kept FROM u""")
def _(t):
    side = lambda df, f, i: df.select(F.lit(f).alias("file"), F.col(i).alias("id"), hashing.exact(F.col("text")).alias("k"))
    u = side(t.documents, 0, "doc_id").unionByName(side(t.benchmark, 1, "item_id")).withColumn("idx", F.struct("file", "id"))
    return dedup.first_wins(u, ["k"], "idx").select("file", "id", "kept")


@query("o22_diverse_selection", """
WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY sha256('15:' || doc_id), doc_id) > 1 AS again FROM documents)
SELECT doc_id, again FROM r ORDER BY again, sha256('15:' || doc_id), doc_id LIMIT 300""")
def _(t):
    return S.diverse(t.documents.select("doc_id", hashing.exact(F.col("text")).alias("body")), "body", 15, "doc_id", 300).select("doc_id", "again")


@query("o23_balanced_selection", """
WITH n AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY sha256(text) ORDER BY sha256('16:' || doc_id), doc_id) AS nth FROM documents),
t AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('16:' || doc_id), doc_id) AS turn FROM n WHERE nth <= 5)
SELECT doc_id, lang FROM t ORDER BY turn, lang, doc_id LIMIT 200""")
def _(t):
    return S.balanced(t.documents.select("doc_id", "lang", hashing.exact(F.col("text")).alias("body")), "body", "lang", 5, 200, 16, "doc_id").select("doc_id", "lang")


@query("a33_paired_bootstrap")
def _(t):
    """95 % intervals of pass@1 and pass@4 between the first and the last attempts of 32, as in a31, from 10,000 draws."""
    solved = lambda low, k: F.bool_or(F.col("success") & F.col("attempt_index").between(low, low + k - 1))
    ends = {f"{side}{k}": solved(low, k).alias(f"{side}{k}") for k in (1, 4) for side, low in (("x", 0), ("y", 28))}
    both = t.attempts.where(F.col("problem_id").isNotNull()).groupBy("problem_id").agg(*ends.values())
    return A.paired_intervals(both, {k: (F.col(f"x{k}"), F.col(f"y{k}")) for k in (1, 4)}, 7)


@query("v03_forbidden_tokens")
def _(t):
    return scanner.flag_forbidden(t.documents.select("doc_id", "text"), "text").select("doc_id", "forbidden")


@query("f01_split_declaration")
def _(t):
    return scanner.split_declaration(t.documents.select("doc_id", "text"), "text").select("doc_id", "parts.statement", "parts.proof")


def _over_texts(name, f):
    query(name)(lambda t: t.documents.select("doc_id", f(F.col("text"))))


_over_texts("v01_declaration_prefix", lambda c: text.declaration_prefix(c).alias("declared"))
_over_texts("f06_proof_bodies", lambda c: text.proof_rhs(c).alias("proof"))
_over_texts("f08_proof_format", lambda c: text.proof_format(c).alias("format"))
_over_texts("f25_extracted_proofs", lambda c: text.extract_proof(c).alias("proof"))
_over_texts("f32_tactic_signatures", lambda c: F.array_join(text.tactic_signature(c), ",").alias("signature"))
_over_texts("h07_theorem_group", lambda c: hashing.theorem_group(c).alias("theorem_group_id"))
_over_texts("h11_structural_fingerprints", lambda c: hashing.structural(c).alias("fingerprint"))

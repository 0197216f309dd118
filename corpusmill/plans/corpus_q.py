"""Queries over the corpus: fingerprints, deduplication, leakage, lengths, manifests, texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import hashing, scanner, text
from corpusmill.operators import dedup, gates, leakage, traces
from corpusmill.operators.places import placed
from corpusmill.plans.registry import query

_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: The lexical form in DuckDB for texts whose line ends and blanks are ASCII.
_LEX = r"trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ' || chr(9) || chr(10))"
_TOKENS = r"regexp_extract_all(" + _LEX + r", '[A-Za-z_\x{80}-\x{ffff}][0-9A-Za-z_''.\x{80}-\x{ffff}]*|[0-9]+|:=|=>|->|[^\s]')"


@query("h01_exact_hash", "SELECT doc_id, sha256(text) AS exact_hash FROM documents")
def _(t):
    return t.documents.select("doc_id", hashing.exact(F.col("text")).alias("exact_hash"))


@query("h02_statement_hash", rf"SELECT doc_id, sha256(trim(regexp_replace(text, '{_WS}', ' ', 'g'), ' ')) AS statement_hash FROM documents")
def _(t):
    return t.documents.select("doc_id", hashing.statement_prep(F.col("text")).alias("statement_hash"))


@query("h03_proof_hash", rf"SELECT doc_id, sha256(trim(regexp_replace(text, '{_WS}', ' ', 'g'), ' ')) AS proof_hash FROM documents")
def _(t):
    return t.documents.select("doc_id", hashing.proof(F.col("text")).alias("proof_hash"))


@query("h04_json_hash", """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","missing":null,"source":"' || source || '"}') AS json_hash FROM documents""")
def _(t):
    return t.documents.select("doc_id", hashing.json_hash(source=F.col("source"), doc_id=F.col("doc_id"), lang=F.col("lang"), missing=F.lit(None).cast("string")).alias("json_hash"))


@query("h05_normalized_hash", f"SELECT doc_id, sha256({_LEX}) AS normalized_hash FROM documents")
def _(t):
    return text.nfc(t.documents, "text").select("doc_id", hashing.normalized(F.col("text")).alias("normalized_hash"))


@query("h08_source_identity", """
SELECT doc_id, sha256('{"qualified_name":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '"n' || doc_id || '"' END || ',"repository_commit":null,"source_file":"' || source || '","source_span":"{}"}') AS source_identity_hash FROM documents""")
def _(t):
    name = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("n"), F.col("doc_id")))
    none = F.lit(None).cast("string")
    return t.documents.select("doc_id", hashing.source_identity(none, F.col("source"), name, none).alias("source_identity_hash"))


@query("h09_premise_sets", """
SELECT conv_id, sha256(string_agg(role, ',' ORDER BY role)) AS premise_hash, count(*) AS premises FROM (SELECT DISTINCT conv_id, role FROM conversations) x GROUP BY 1""")
def _(t):
    p = t.conversations.groupBy("conv_id").agg(hashing.premises(F.collect_list("role")).alias("p"))
    return p.select("conv_id", hashing.exact(F.array_join("p", ",")).alias("premise_hash"), F.size("p").cast("long").alias("premises"))


@query("h12_lexical_tokens", f"SELECT doc_id, CAST(len({_TOKENS}) AS INT) AS n_tokens, sha256(array_to_string({_TOKENS}, ' ')) AS token_hash FROM documents")
def _(t):
    tok = text.tokens(text.normalize_lexical(F.col("text")))
    return t.documents.select("doc_id", F.size(tok).alias("n_tokens"), hashing.exact(F.array_join(tok, " ")).alias("token_hash"))


@query("h14_attestation", "SELECT doc_id, sha256(doc_id || '|' || lang || '||' || source) AS attestation_id FROM documents")
def _(t):
    return t.documents.select("doc_id", hashing.attestation(F.col("doc_id"), F.col("lang"), F.lit(None), F.col("source")).alias("attestation_id"))


@query("h17_environment_hash", """
SELECT doc_id, sha256(unhex(printf('%016x', octet_length(encode(lang)))) || encode(lang) || unhex(printf('%016x', octet_length(encode(source)))) || encode(source)) AS environment_hash FROM documents""")
def _(t):
    return t.documents.select("doc_id", hashing.length_prefixed(F.col("lang"), F.col("source")).alias("environment_hash"))


@query("h19_chunk_set_hash", "SELECT lang, sha256(string_agg(doc_id || ':' || sha256(text) || chr(10), '' ORDER BY doc_id || ':' || sha256(text) || chr(10))) AS chunk_hash FROM documents GROUP BY 1")
def _(t):
    line = F.concat(F.col("doc_id"), F.lit(":"), hashing.exact(F.col("text")), F.lit("\n"))
    return t.documents.groupBy("lang").agg(hashing.exact(F.array_join(F.array_sort(F.collect_list(line)), "")).alias("chunk_hash"))


@query("h21_comment_stripped_hash", r"""
SELECT conv_id, turn, sha256(trim(regexp_replace(regexp_replace(regexp_replace(role || ' /- a' || chr(10) || 'b -/ ' || turn || ' -- end', '(?s)/-.*?-/', '', 'g'), '--[^\n]*', '', 'g'), '\s+', ' ', 'g'), ' ')) AS hash FROM conversations""")
def _(t):
    s = F.concat(F.col("role"), F.lit(" /- a\nb -/ "), F.col("turn"), F.lit(" -- end"))
    bare = F.regexp_replace(F.regexp_replace(s, r"(?s)/-.*?-/", ""), r"--[^\n]*", "")
    return t.conversations.select("conv_id", "turn", hashing.exact(text.collapse(bare)).alias("hash"))


@query("h22_id_list_hashes", """
SELECT lang, sha256('[' || string_agg('"' || doc_id || '"', ',' ORDER BY doc_id) || ']') AS json_hash, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY doc_id)) AS line_hash FROM documents GROUP BY 1""")
def _(t):
    ids = F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string"))
    g = t.documents.groupBy("lang").agg(ids.alias("ids"))
    return g.select("lang", hashing.exact(F.to_json("ids")).alias("json_hash"), hashing.exact(F.array_join("ids", "\n")).alias("line_hash"))


@query("h24_record_ids", "SELECT doc_id, 'stmt_' || left(sha256(text), 24) AS statement_id, 'ldv2_' || left(sha256(source || ':' || doc_id), 24) AS record_id FROM documents")
def _(t):
    one = F.concat(F.lit("stmt_"), F.left(hashing.exact(F.col("text")), F.lit(24)))
    two = F.concat(F.lit("ldv2_"), F.left(hashing.exact(F.concat_ws(":", "source", "doc_id")), F.lit(24)))
    return t.documents.select("doc_id", one.alias("statement_id"), two.alias("record_id"))


@query("a01_first_wins", """
SELECT doc_id, k AS kept, CASE WHEN NOT k THEN 'duplicate_content' WHEN length(text) < 50 THEN 'too_short' WHEN lang = 'es' THEN 'unsupported' ELSE 'accepted' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 AS k FROM documents) x""")
def _(t):
    rows = dedup.first_wins(t.documents.withColumn("key", hashing.exact(F.col("text"))), ["key"], "doc_id")
    reason = F.when(~F.col("kept"), "duplicate_content").when(F.length("text") < 50, "too_short").when(F.col("lang") == "es", "unsupported").otherwise("accepted")
    return rows.select("doc_id", "kept", reason.alias("reason"))


@query("a02_unique_ids", """
WITH x AS (SELECT doc_id, source AS id, source || CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) > 1 THEN '::' || left(sha256(text || chr(0) || lang), 12) ELSE '' END AS c FROM documents)
SELECT doc_id, c || CASE WHEN row_number() OVER (PARTITION BY c ORDER BY doc_id) > 1 THEN '-' || row_number() OVER (PARTITION BY c ORDER BY doc_id) ELSE '' END AS unique_id FROM x""")
def _(t):
    return dedup.disambiguate(t.documents, "source", "doc_id", "text", "lang").select("doc_id", "unique_id")


@query("a04_quarantine_pointer", """
SELECT doc_id, CASE WHEN row_number() OVER w > 1 THEN first_value(doc_id) OVER w END AS duplicate_of FROM documents WINDOW w AS (PARTITION BY sha256(text) ORDER BY doc_id)""")
def _(t):
    return dedup.pointer(t.documents.withColumn("key", hashing.exact(F.col("text"))), ["key"], "doc_id", "doc_id").select("doc_id", "duplicate_of")


_LEVELS = {0: ["doc_id"], 1: ["source", "n_chars"], 3: ["lang", "head"], 4: ["exact"]}


@query("a06_canonical_pick", """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY sha256(text) ORDER BY (lang = 'en')::INT DESC, doc_id % 3 DESC, doc_id DESC) AS INT) AS rank FROM documents""")
def _(t):
    scores = [(F.col("lang") == "en").cast("int"), F.col("doc_id") % 3]
    return dedup.canonical(t.documents.withColumn("key", hashing.exact(F.col("text"))), ["key"], scores, "doc_id").select("doc_id", "rank")


@query("a09_dedup_statistics", """
WITH g AS (SELECT sha256(text) AS k, count(*) AS n FROM documents GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS records, count(*) AS canonical, count(*) FILTER (n >= 2) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, max(n) AS largest_group FROM g""")
def _(t):
    g = t.documents.groupBy(hashing.exact(F.col("text")).alias("k")).agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("records"), F.count("*").alias("canonical"), F.count_if(F.col("n") >= 2).alias("duplicate_groups"), F.sum(F.col("n") - 1).alias("duplicate_rows"), F.max("n").alias("largest_group"))


@query("a12_duplicates_within_split", "SELECT lang AS split, sha256(text) AS hash, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return dedup.repeated_keys(t.documents.select(F.col("lang").alias("split"), hashing.exact(F.col("text")).alias("hash")), "split", "hash")


@query("a13_proof_distribution", """
WITH g AS (SELECT text, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, f) AS r FROM g)
SELECT CAST(sum(n) AS BIGINT) AS proofs, count(*) AS unique_proofs, round(sum(n) FILTER (r <= 10) / sum(n)::DOUBLE, 9) AS top10, round(sum(n) FILTER (r <= 20) / sum(n)::DOUBLE, 9) AS top20,
 round(sum(n) FILTER (r <= 50) / sum(n)::DOUBLE, 9) AS top50, round(1 - count(*) / sum(n)::DOUBLE, 9) AS duplicate_ratio FROM r""")
def _(t):
    g = t.documents.groupBy("text").agg(F.count("*").alias("n"), F.min("doc_id").alias("f"))
    top = g.select("n", "f").orderBy(F.desc("n"), "f").limit(50).withColumn("r", F.row_number().over(_all(F.desc("n"), F.col("f"))))
    tops = top.agg(*(F.sum(F.when(F.col("r") <= k, F.col("n"))).alias(f"s{k}") for k in (10, 20, 50)))
    total = g.agg(F.sum("n").alias("proofs"), F.count("*").alias("unique_proofs"))
    out = total.crossJoin(tops)  # one row each
    return out.select("proofs", "unique_proofs", *(F.round(F.col(f"s{k}") / F.col("proofs"), 9).alias(f"top{k}") for k in (10, 20, 50)), F.round(1 - F.col("unique_proofs") / F.col("proofs"), 9).alias("duplicate_ratio"))


def _all(*order):
    from pyspark.sql import Window

    return Window.orderBy(*order)


@query("a15_manifest_summary", """
SELECT source, count(*) AS records, CAST(sum(n_chars) AS BIGINT) AS chars, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 9) AS row_share, round(sum(n_chars) / (SELECT sum(n_chars) FROM documents)::DOUBLE, 9) AS char_share,
 count(DISTINCT lang) AS langs, max(n_chars) AS longest FROM documents GROUP BY 1""")
def _(t):
    d = t.documents
    total = d.agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    g = d.groupBy("source").agg(F.count("*").alias("records"), F.sum("n_chars").alias("chars"), F.count_distinct("lang").alias("langs"), F.max("n_chars").alias("longest"))
    g = g.crossJoin(F.broadcast(total))  # one row
    return g.select("source", "records", "chars", F.round(F.col("records") / F.col("n"), 9).alias("row_share"), F.round(F.col("chars") / F.col("c"), 9).alias("char_share"), "langs", "longest")


@query("a16_corpus_report", "SELECT lang, count(*) AS records, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts, count(*) FILTER (n_chars >= 2000) AS long_records FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("records"), F.count_distinct("source").alias("sources"), F.count_distinct("text").alias("texts"), F.count_if(F.col("n_chars") >= 2000).alias("long_records"))


_REASON = "CASE WHEN text = '' THEN 'empty' WHEN n_chars > 8000 THEN 'too_long' WHEN n_chars < 100 THEN 'too_short' WHEN lang = 'es' THEN 'language' ELSE 'accepted' END"


@query("a18_rejection_counters", f"SELECT source, {_REASON} AS reason, count(*) AS n FROM documents GROUP BY 1, 2")
def _(t):
    return t.documents.groupBy("source", _reason().alias("reason")).agg(F.count("*").alias("n"))


def _reason():
    n = F.col("n_chars")
    return F.when(F.col("text") == "", "empty").when(n > 8000, "too_long").when(n < 100, "too_short").when(F.col("lang") == "es", "language").otherwise("accepted")


@query("a45_length_filter", f"SELECT {_REASON} AS reason, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(_reason().alias("reason")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))


@query("a46_overlength_split", "SELECT doc_id, CASE WHEN n_chars > 4096 THEN 'overlength' ELSE 'kept' END AS side, greatest(0, n_chars - 4096) AS excess FROM documents")
def _(t):
    return t.documents.select("doc_id", F.when(F.col("n_chars") > 4096, "overlength").otherwise("kept").alias("side"), F.greatest(F.lit(0).cast("long"), F.col("n_chars") - 4096).alias("excess"))


@query("a51_examples_per_reason", f"SELECT reason, doc_id, CAST(place AS INT) AS place FROM (SELECT {_REASON} AS reason, doc_id, row_number() OVER (PARTITION BY {_REASON} ORDER BY doc_id) AS place FROM documents) x WHERE place <= 5")
def _(t):
    return traces.top_each(t.documents.withColumn("reason", _reason()), "reason", 5, "doc_id").select("reason", "doc_id", "place")


@query("j01_exclude_known", "SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 'excluded' ELSE 'kept' END AS side FROM documents d")
def _(t):
    known = t.labels.select("doc_id").distinct()
    semi = t.documents.join(known, "doc_id", "left_semi").select("doc_id", F.lit("excluded").alias("side"))
    return semi.unionByName(t.documents.join(known, "doc_id", "left_anti").select("doc_id", F.lit("kept").alias("side")))


@query("j02_exclusion_hashes", "SELECT DISTINCT coalesce(CASE WHEN doc_id % 2 = 0 THEN sha256(text) END, sha256(text || lang)) AS hash FROM documents")
def _(t):
    stored = F.when(F.col("doc_id") % 2 == 0, hashing.exact(F.col("text")))
    return t.documents.select(F.coalesce(stored, hashing.exact(F.concat("text", "lang"))).alias("hash")).distinct()


@query("j03_split_overlap", """
WITH l AS (SELECT sha256(text) AS hash, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS left_ids FROM documents WHERE doc_id % 3 = 0 GROUP BY 1),
r AS (SELECT sha256(text) AS hash, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS right_ids FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1)
SELECT * FROM l JOIN r USING (hash)""")
def _(t):
    d = t.documents.withColumn("hash", hashing.exact(F.col("text")))
    return dedup.overlap(d.where("doc_id % 3 = 0"), d.where("doc_id % 3 <> 0"), "hash", "doc_id")


@query("j04_disjointness", """
SELECT 'text' AS kind, count(*) AS shared FROM (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 INTERSECT SELECT sha256(text) FROM documents WHERE doc_id % 3 <> 0) x
UNION ALL SELECT 'id', count(*) FROM (SELECT doc_id FROM documents WHERE doc_id % 3 = 0 INTERSECT SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) y""")
def _(t):
    d = t.documents.withColumn("hash", hashing.exact(F.col("text")))
    shared = lambda c, kind: d.where("doc_id % 3 = 0").select(c).intersect(d.where("doc_id % 3 <> 0").select(c)).agg(F.lit(kind).alias("kind"), F.count("*").alias("shared"))
    return shared("hash", "text").unionByName(shared("doc_id", "id"))


@query("j15_three_way_split", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.quality = 1 THEN 'verified' ELSE 'failed' END AS state FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _(t):
    j = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("quality").isNull(), "missing").when(F.col("quality") == 1, "verified").otherwise("failed").alias("state"))


@query("j21_reason_trace", """
SELECT CASE WHEN l.doc_id IS NULL THEN 'unverified' WHEN l.toxic = 1 THEN 'rejected_toxic' WHEN l.quality = 0 THEN 'rejected_quality' WHEN d.n_chars > 4096 THEN 'overlength' ELSE 'accepted' END AS reason, count(*) AS n
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def _(t):
    j = t.documents.select("doc_id", "n_chars").join(t.labels.withColumn("known", F.lit(True)), "doc_id", "left")
    reason = F.when(F.col("known").isNull(), "unverified").when(F.col("toxic") == 1, "rejected_toxic").when(F.col("quality") == 0, "rejected_quality").when(F.col("n_chars") > 4096, "overlength").otherwise("accepted")
    return j.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("u03_id_sets", """
WITH a AS (SELECT doc_id FROM labels WHERE quality = 1), b AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) x UNION ALL SELECT 'intersection', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) x
UNION ALL SELECT 'difference', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x""")
def _(t):
    a, b = (t.labels.where(f"{c} = 1").select("doc_id") for c in ("quality", "toxic"))
    n = lambda df, op: df.agg(F.lit(op).alias("op"), F.count("*").alias("n"))
    return n(a.union(b).distinct(), "union").unionByName(n(a.intersect(b), "intersection")).unionByName(n(a.subtract(b), "difference"))


@query("p01_first_text", """SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 4 = 0 THEN '   ' WHEN doc_id % 4 = 1 THEN NULL ELSE ' a' || doc_id || ' ' END), ''), nullif(trim(lang), ''), source) AS first_text,
 CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) || '.5' END AS identifier FROM documents""")
def _(t):
    odd = F.when(F.col("doc_id") % 4 == 0, "   ").when(F.col("doc_id") % 4 == 1, F.lit(None)).otherwise(F.concat(F.lit(" a"), F.col("doc_id"), F.lit(" ")))
    number = F.concat(F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, ".0").otherwise(".5"))
    return t.documents.select("doc_id", text.first_text(odd, F.col("lang"), F.col("source")).alias("first_text"), text.identifier(F.lit(" "), number).alias("identifier"))


@query("p22_role_rows", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'train' WHEN doc_id % 3 = 1 THEN 'eval' ELSE 'discovery' END AS role, CASE WHEN doc_id % 3 < 2 THEN right(text, 20) END AS proof, CASE WHEN doc_id % 3 = 2 THEN right(text, 20) END AS reference_proof FROM documents""")
def _(t):
    role = F.when(F.col("doc_id") % 3 == 0, "train").when(F.col("doc_id") % 3 == 1, "eval").otherwise("discovery")
    rows = t.documents.select("doc_id", role.alias("role"), F.right("text", F.lit(20)).alias("p"))
    shown = F.col("role").isin("train", "eval")
    return rows.select("doc_id", "role", F.when(shown, F.col("p")).alias("proof"), F.when(~shown, F.col("p")).alias("reference_proof"))


@query("p28_reject_reasons", r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9_])(the|sorry)([^A-Za-z0-9_]|$)') THEN 'forbidden' WHEN NOT regexp_matches(text, '^[A-Z]') THEN 'prefix' WHEN n_chars > 6000 THEN 'assembly' END AS reason FROM documents""")
def _(t):
    word = F.col("text").rlike(r"(^|[^A-Za-z0-9_])(the|sorry)([^A-Za-z0-9_]|$)")
    return t.documents.select("doc_id", F.when(word, "forbidden").when(~F.col("text").rlike("^[A-Z]"), "prefix").when(F.col("n_chars") > 6000, "assembly").alias("reason"))


@query("v06_row_validity", """
SELECT doc_id, concat_ws(',', CASE WHEN NOT n_chars > 200 THEN 'length' END, CASE WHEN NOT lang IN ('en', 'de') THEN 'lang' END, CASE WHEN NOT source <> 'src3' THEN 'source' END) AS violations FROM documents
WHERE NOT (n_chars > 200 AND lang IN ('en', 'de') AND source <> 'src3')""")
def _(t):
    rules = {"length": F.col("n_chars") > 200, "lang": F.col("lang").isin("en", "de"), "source": F.col("source") != "src3"}
    return gates.violated(t.documents, rules, ["doc_id"]).withColumn("violations", F.array_join("violations", ","))


@query("v08_attestation_gate", "SELECT count(*) FILTER (l.quality IS DISTINCT FROM 1) AS unverified, count(DISTINCT d.lang) AS environments, count(*) FILTER (l.quality IS DISTINCT FROM 1) = 0 AND count(DISTINCT d.lang) = 1 AS passed FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(t):
    j = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    bad, env = F.count_if(~F.col("quality").eqNullSafe(1)), F.count_distinct("lang")
    return j.agg(bad.alias("unverified"), env.alias("environments"), ((bad == 0) & (env == 1)).alias("passed"))


@query("v09_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return dedup.repeated_keys(t.lineitem, "l_orderkey", "l_linenumber")


@query("v23_imports_covered", "SELECT doc_id, doc_id % 3 <> 1 AS covered FROM documents")
def _(t):
    imports = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("Mathlib.Data.Nat"), F.lit("Mathlib"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("Mathlib2.X"))).otherwise(F.array().cast("array<string>"))
    return t.documents.select("doc_id", gates.imports_covered(imports, ["Mathlib"]).alias("covered"))


@query("v26_forbidden_context", r"""
SELECT doc_id, CAST(strpos(text, 'the ') AS INT) AS at, substr(text, greatest(1, strpos(text, 'the ') - 10), 24) AS context FROM documents WHERE contains(text, 'the ')""")
def _(t):
    at = F.instr("text", "the ")
    return t.documents.where(F.col("text").contains("the ")).select("doc_id", at.alias("at"), F.substr("text", F.greatest(F.lit(1), at - 10), F.lit(24)).alias("context"))


@query("f09_imports_and_body", r"""SELECT doc_id, 'Mathlib,A' || doc_id % 3 AS imports, 'open Nat' || chr(10) || 'theorem x' AS body FROM documents""")
def _(t):
    src = F.concat(F.lit("import Mathlib\nimport A"), F.col("doc_id") % 3, F.lit("\nimport Mathlib\nopen Nat\ntheorem x"))
    ls = text.lines(src)
    imports = F.array_distinct(F.transform(F.filter(ls, lambda x: x.startswith("import ")), lambda x: F.substr(x, F.lit(8))))
    body = F.array_join(F.filter(ls, lambda x: ~x.startswith("import ")), "\n")
    return t.documents.select("doc_id", F.array_join(imports, ",").alias("imports"), body.alias("body"))


@query("f24_file_names", r"SELECT doc_id, left(regexp_replace(text, '[^A-Za-z0-9_.-]+', '_', 'g'), 120) AS file_name FROM documents")
def _(t):
    return t.documents.select("doc_id", text.file_name(F.col("text")).alias("file_name"))


@query("f26_output_classes")
def _(t):
    return t.documents.select("doc_id", text.output_class(F.coalesce("text", F.lit(""))).alias("output_class"))


@query("w01_run_islands", """
WITH x AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx, role FROM conversations),
n AS (SELECT idx, role, CASE WHEN role IS DISTINCT FROM lag(role) OVER (ORDER BY idx) OR idx = 0 THEN 1 ELSE 0 END AS n FROM x)
SELECT idx, CAST(sum(n) OVER (ORDER BY idx) AS BIGINT) AS island FROM n""")
def _(t):
    rows = placed(t.conversations, "conv_id", "turn").withColumn("idx", F.col("place") - 1)
    return traces.islands(rows, "role", "idx").select("idx", "island")


@query("w02_trajectories", """
SELECT conv_id, count(*) AS n_steps, string_agg(role, '>' ORDER BY turn) AS path, max(turn) - min(turn) + 1 = count(*) AS continuous FROM conversations GROUP BY 1""")
def _(t):
    s = traces.ordered_steps(t.conversations, "conv_id", "turn", "role")
    return s.select("conv_id", F.size("steps").cast("long").alias("n_steps"), F.array_join(F.transform("steps", lambda x: x["role"]), ">").alias("path"), traces.continuous(F.col("steps"), "turn").alias("continuous"))


@query("w04_state_gaps", """
SELECT conv_id, turn, row_number() OVER w > 1 AND left(role, 1) IS DISTINCT FROM lag(right(role, 1)) OVER w AS gap FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def _(t):
    rows = t.conversations.select("conv_id", "turn", F.left("role", F.lit(1)).alias("b"), F.right("role", F.lit(1)).alias("a"))
    return traces.contiguous(rows, "conv_id", "turn", "b", "a").select("conv_id", "turn", "gap")

"""Queries over record adapters and projections, and what is left of scalars, gates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import hashing, scanner, text
from corpusmill.operators import gates
from corpusmill.operators import records as R
from corpusmill.plans.registry import query


@query("p03_imports_shape", "SELECT doc_id, doc_id % 4 <> 2 AS valid FROM documents")
def _(t):
    k = F.col("doc_id") % 4
    return t.documents.select("doc_id", R.imports_valid(F.when(k == 0, '["A","B"]').when(k == 1, "A").when(k == 2, "[1, {]")).alias("valid"))


@query("p05_workbook_rows", """
SELECT 'w' || doc_id AS id, 'theorem t' || doc_id % 5 || ' : a = b' AS statement, 'by simp' AS proof, sha256('theorem t' || doc_id % 5 || ' : a = b') AS statement_hash, sha256('by simp') AS proof_hash FROM documents""")
def _(t):
    rows = t.documents.select(F.concat(F.lit(" w"), F.col("doc_id")).alias("id"), F.concat(F.lit("theorem t"), F.col("doc_id") % 5, F.lit(" : a = b := by sorry")).alias("formal_statement"), F.lit(":= by simp").alias("tactic"))
    return R.workbook(rows)


@query("p06_benchmark_rows", "SELECT doc_id FROM documents WHERE doc_id % 3 IN (0, 1) AND n_chars > 1000")
def _(t):
    split = F.when(F.col("doc_id") % 3 == 0, "valid").when(F.col("doc_id") % 3 == 1, "test").otherwise("train")
    return R.benchmark_rows(t.documents.select("doc_id", split.alias("split"), (F.col("n_chars") > 1000).alias("verified"))).select("doc_id")


@query("p07_generic_rows", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'own ' || doc_id ELSE 'theorem t : a' END AS statement, CASE WHEN doc_id % 3 = 0 THEN 'by own' ELSE 'by code' END AS proof FROM documents")
def _(t):
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("own "), F.col("doc_id"))).otherwise(" ").alias("statement"), F.when(F.col("doc_id") % 3 == 0, "by own").alias("proof"), F.lit("theorem t : a := by code").alias("code"))
    return R.generic(rows).select("doc_id", "statement", "proof")


@query("p09_statement_only", "SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'proof' WHEN 2 THEN 'proof,solution' ELSE '' END AS proof_fields FROM documents")
def _(t):
    k = F.col("doc_id") % 3
    rows = t.documents.select("doc_id", F.when(k > 0, "p").otherwise("  ").alias("proof"), F.when(k == 2, "s").alias("solution"))
    return R.statement_only(rows, ["proof", "solution", "trace"]).select("doc_id", F.array_join("proof_fields", ",").alias("proof_fields"))


@query("p18_sft_pairs", "SELECT doc_id AS id, 'theorem t' || doc_id || ' :=' || chr(10) AS prompt, CASE WHEN doc_id % 2 = 0 THEN 'by simp' ELSE 'by' || chr(10) || '  exact h' END AS completion FROM documents")
def _(t):
    return R.sft_pair(t.documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("theorem t"), F.col("doc_id")).alias("statement"), F.when(F.col("doc_id") % 2 == 0, "by simp").otherwise("h").alias("proof")))


@query("p21_evaluation_rows", "SELECT item_id AS id, text AS statement, 'grpo' AS data_stage, 'train' AS split, 'evaluation_data' AS schema_version FROM benchmark")
def _(t):
    return R.evaluation_row(t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("statement")))


@query("p24_state_transitions", "SELECT doc_id AS id, CASE WHEN quality = 1 AND toxic = 0 THEN 'verified' ELSE 'quarantined' END AS status, CASE WHEN quality = 1 AND toxic = 0 THEN sha256(doc_id || '|env') END AS attestation_id FROM labels")
def _(t):
    rows = t.labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("statement_verified"), (F.col("toxic") == 0).alias("proof_verified"), F.lit("env").alias("environment"))
    return R.transition(rows).select("id", "status", "attestation_id")


@query("p25_annotated_manifest", "SELECT doc_id, lang, 'documents' AS manifest_source, 'e1' AS experiment FROM documents")
def _(t):
    return R.annotate(t.documents.select("doc_id", "lang", F.lit(1.0).alias("weight")), "documents", "e1")


@query("p29_quarantine_reasons", "SELECT doc_id, CASE WHEN text = '' THEN 'missing_text' WHEN source = 'src3' THEN 'blocked_source' WHEN lang NOT IN ('en', 'de') THEN 'unsupported' WHEN n_chars < 300 THEN 'short' END AS reason FROM documents")
def _(t):
    rules = {"missing_text": F.col("text") == "", "blocked_source": F.col("source") == "src3", "unsupported": ~F.col("lang").isin("en", "de"), "short": F.col("n_chars") < 300}
    return t.documents.select("doc_id", R.first_match(rules).alias("reason"))


@query("p31_rejection_classes", "WITH {ATT} SELECT CASE WHEN contains(diagnostics, 'unknown') THEN 'unknown' WHEN contains(diagnostics, 'mismatch') THEN 'type' WHEN diagnostics <> '' THEN 'other' ELSE 'none' END AS class, count(*) AS n FROM att GROUP BY 1")
def _(t):
    d = F.col("diagnostics")
    kind = R.first_match({"unknown": d.contains("unknown"), "type": d.contains("mismatch"), "other": d != ""}, "none")
    return t.attempts.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query("f02_code_identifiers", "SELECT doc_id, 'exact,foo' || doc_id || ',bar''' AS words FROM documents")
def _(t):
    words = F.pandas_udf(lambda c: c.map(lambda s: ",".join(scanner.words(s))), "string")
    code = F.concat(F.lit("exact foo"), F.col("doc_id"), F.lit(' /- sorry /- x -/ -/ "admit" bar\' -- end'))
    return t.documents.select("doc_id", words(code).alias("words"))


@query("f04_unfenced", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'by simp' ELSE 'plain' END AS body FROM documents")
def _(t):
    return t.documents.select("doc_id", text.strip_fence(F.when(F.col("doc_id") % 2 == 0, "```lean\nby simp\n```").otherwise("plain")).alias("body"))


@query("f05_placeholders", "SELECT doc_id, 'theorem t : a' AS statement FROM documents")
def _(t):
    k = F.col("doc_id") % 4
    s = F.when(k == 0, "theorem t : a := by sorry").when(k == 1, "theorem t : a := by\n  admit ").when(k == 2, "theorem t : a sorry").otherwise(" theorem t : a")
    return t.documents.select("doc_id", text.strip_placeholder(s).alias("statement"))


@query("f07_statement_equivalence", "SELECT doc_id, doc_id % 2 = 0 AS same FROM documents")
def _(t):
    a, b = F.lit("theorem t :  a\n = b"), F.when(F.col("doc_id") % 2 == 0, "theorem t : a = b").otherwise("theorem t : a = c")
    return t.documents.select("doc_id", (text.collapse(a) == text.collapse(b)).alias("same"))


@query("f10_last_declaration", "SELECT doc_id, 'open Nat' || chr(10) || 'theorem a : x' AS context, 'theorem b' || doc_id || ' : y' AS target FROM documents")
def _(t):
    s = F.concat(F.lit("open Nat\ntheorem a : x\ntheorem b"), F.col("doc_id"), F.lit(" : y"))
    return t.documents.select("doc_id", R.split_last_declaration(s).alias("x")).select("doc_id", "x.context", "x.target")


@query("f18_proof_lengths", "SELECT doc_id, length(text) AS chars, CAST(len(regexp_extract_all(text, '[0-9]+')) AS INT) AS numbers FROM documents")
def _(t):
    return t.documents.select("doc_id", F.length("text").cast("long").alias("chars"), F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("numbers"))


@query("f19_hypotheses", "SELECT conv_id, turn, 'a b:Nat;h:a = ' || turn AS locals FROM conversations")
def _(t):
    state = F.concat(F.lit("a b : Nat\nh : a = "), F.col("turn"), F.lit("\n⊢ goal : Prop"))
    rows = t.conversations.select("conv_id", "turn", R.hypotheses(state).alias("h"))
    return rows.select("conv_id", "turn", F.array_join(F.transform("h", lambda x: F.concat_ws(":", F.array_join(x["names"], " "), x["type"])), ";").alias("locals"))


@query("f41_prompt_sections", "SELECT doc_id, 'Informal=' || lang || '|Lean statement=' || source AS sections FROM documents")
def _(t):
    p = F.concat(F.lit("### Informal\n"), F.col("lang"), F.lit("\n\n### Lean statement\n"), F.col("source"), F.lit("\n"))
    return t.documents.select("doc_id", F.array_join(F.transform(R.prompt_parts(p), lambda x: F.concat_ws("=", x["title"], x["body"])), "|").alias("sections"))


@query("f45_module_names", "SELECT page_id, 'Mathlib.P' || page_id % 5 || '.X' || page_id AS module FROM pages")
def _(t):
    return t.pages.select("page_id", R.module_name(F.concat(F.lit("./Mathlib/P"), F.col("page_id") % 5, F.lit("/X"), F.col("page_id"), F.lit(".lean"))).alias("module"))


@query("f46_declaration_names", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'foo.bar' || doc_id END AS name FROM documents")
def _(t):
    return t.documents.select("doc_id", R.declaration_name(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("-- x\n lemma foo.bar"), F.col("doc_id"), F.lit("(x) : y"))).otherwise("open Nat")).alias("name"))


@query("f47_legacy_diagnostics", "WITH {ATT} SELECT event_id, CAST(CASE WHEN diagnostics <> '' THEN 1 ELSE 0 END AS INT) AS errors, 1 AS warnings FROM att")
def _(t):
    x = R.legacy_diagnostics(F.concat_ws("\n", "diagnostics", F.lit("a: warning: unused")))
    return t.attempts.select("event_id", F.size(x["errors"]).alias("errors"), F.size(x["warnings"]).alias("warnings"))


@query("h06_normalized_pairs", "SELECT doc_id, sha256('a b' || chr(10) || 'c') AS hash FROM documents")
def _(t):
    return t.documents.select("doc_id", hashing.normalized(F.concat(F.lit("  a \t b  \r\nc"), F.repeat(F.lit(" "), (F.col("doc_id") % 3).cast("int")))).alias("hash"))


@query("h16_cache_keys", """SELECT doc_id, sha256('{"environment":"e1","proof":null,"statement":"' || source || '","timeout":30}') AS cache_key FROM documents""")
def _(t):
    return t.documents.select("doc_id", hashing.json_hash(statement=F.col("source"), proof=F.lit(None).cast("string"), environment=F.lit("e1"), timeout=F.lit(30)).alias("cache_key"))


@query("v02_verified_scope", "SELECT d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1 AND d.lang = 'en'")
def _(t):
    return t.documents.where("lang = 'en'").join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id")


@query("v12_length_gate", "SELECT doc_id, n_chars - 8000 AS over FROM documents WHERE n_chars > 8000")
def _(t):
    return t.documents.where("n_chars > 8000").select("doc_id", (F.col("n_chars") - 8000).alias("over"))


@query("v15_lineage_gate", "WITH {ATT} SELECT event_id, concat_ws(',', CASE WHEN attempt_index % 7 = 3 THEN 'cycle' END, CASE WHEN attempt_index % 11 = 4 THEN 'policy' END) AS violations FROM att WHERE attempt_index % 7 = 3 OR attempt_index % 11 = 4")
def _(t):
    a = t.attempts.withColumn("cycle", F.when(F.col("attempt_index") % 7 != 3, "c1")).withColumn("policy", F.when(F.col("attempt_index") % 11 == 4, "other").otherwise("p1"))
    rules = {"cycle": F.col("cycle").eqNullSafe("c1"), "policy": F.col("policy").eqNullSafe("p1")}
    return gates.violated(a, rules, ["event_id"]).withColumn("violations", F.array_join("violations", ","))


@query("v19_regression_gate", "WITH {ATT} SELECT count(*) FILTER (success AND attempt_index < 16) AS before, count(*) FILTER (success AND attempt_index >= 16) AS after, count(*) FILTER (success AND attempt_index >= 16) >= 0.98 * count(*) FILTER (success AND attempt_index < 16) AS passed FROM att")
def _(t):
    b, a = F.count_if(F.expr("success and attempt_index < 16")), F.count_if(F.expr("success and attempt_index >= 16"))
    return t.attempts.agg(b.alias("before"), a.alias("after"), (a >= 0.98 * b).alias("passed"))


@query("v24_golden_set_shape", "SELECT lang, count(*) AS n, count(*) = count(DISTINCT doc_id) AS unique_ids, count(*) = 10 AS whole FROM documents WHERE doc_id < 40 GROUP BY 1")
def _(t):
    return t.documents.where("doc_id < 40").groupBy("lang").agg(F.count("*").alias("n"), (F.count("*") == F.count_distinct("doc_id")).alias("unique_ids"), (F.count("*") == 10).alias("whole"))


@query("v25_proof_free_prompts", "SELECT doc_id, doc_id % 2 = 0 AS proof_free FROM documents")
def _(t):
    p = F.concat(F.lit("theorem t := by "), F.when(F.col("doc_id") % 2 == 0, "sorry").otherwise("simp"))
    return t.documents.select("doc_id", (text.strip(F.substring_index(p, ":= by", -1)) == "sorry").alias("proof_free"))


@query("j13_verification_reuse", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND l.quality = 1 THEN 'reused' ELSE 'to_verify' END AS work FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(t):
    known = t.labels.where("quality = 1").select("doc_id", F.lit("reused").alias("w"))
    return t.documents.select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("w", F.lit("to_verify")).alias("work"))


@query("a11_leakage_statistics", "SELECT count(*) FILTER (h) AS level_1_records, count(*) FILTER (NOT h) AS retained_records FROM (SELECT sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 20 = 0) AS h FROM documents) x")
def _(t):
    d = t.documents.select("doc_id", hashing.exact(F.col("text")).alias("k"))
    j = d.join(d.where("doc_id % 20 = 0").select("k").distinct().withColumn("h", F.lit(True)), "k", "left")
    return j.agg(F.count_if(F.coalesce("h", F.lit(False))).alias("level_1_records"), F.count_if(F.col("h").isNull()).alias("retained_records"))


@query("a17_reconstruction_report", "SELECT coalesce(CASE WHEN n_chars < 200 THEN 'short' WHEN lang = 'fr' THEN 'language' END, 'kept') AS reason, count(*) AS n, round(1 - count(DISTINCT text) / count(*)::DOUBLE, 9) AS duplicate_ratio FROM documents GROUP BY 1")
def _(t):
    reason = R.first_match({"short": F.col("n_chars") < 200, "language": F.col("lang") == "fr"}, "kept")
    return t.documents.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.round(1 - F.count_distinct("text") / F.count("*"), 9).alias("duplicate_ratio"))


@query("a39_throughput", "SELECT event_type, round(avg(value), 6) AS mean, median(value) AS median, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.median("value").alias("median"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("o27_batch_seeds", "SELECT doc_id, 20260909 + doc_id // 8 * 8 AS seed FROM documents")
def _(t):
    return t.documents.select("doc_id", (20260909 + F.floor(F.col("doc_id") / 8) * 8).alias("seed"))

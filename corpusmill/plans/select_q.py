"""Queries over selections, schedules, joins with gates, and declarations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import hashing, scanner, text
from corpusmill.operators import gates, leakage, stats, traces
from corpusmill.operators import selection as S
from corpusmill.operators.places import placed
from corpusmill.plans.registry import query


def _key(seed, *parts):
    return "sha256('" + str(seed) + "'" + "".join(f" || ':' || {p}" for p in parts) + ")"


@query("o01_hash_shuffle_head", f"SELECT doc_id FROM documents ORDER BY {_key(11, 'doc_id')}, doc_id LIMIT 100")
def _(t):
    return S.hash_head(t.documents.select("doc_id"), 11, "doc_id", 100)


@query("o02_tiebreak_keys", f"SELECT doc_id, {_key(20260909, 'doc_id')} AS key2, {_key(5, chr(39) + 'zero-fill' + chr(39), 'doc_id')} AS key3 FROM documents")
def _(t):
    return t.documents.select("doc_id", hashing.order_key(20260909, F.col("doc_id")).alias("key2"), hashing.order_key(5, F.lit("zero-fill"), F.col("doc_id")).alias("key3"))


@query("o05_uniform_sample", f"SELECT event_id FROM events ORDER BY {_key(3, 'event_id')}, event_id LIMIT 250")
def _(t):
    return S.hash_head(t.events.select("event_id"), 3, "event_id", 250)


@query("o06_train_validation_split", f"""
WITH n AS (SELECT count(*) AS n FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY {_key(7, 'doc_id')}) AS r FROM documents)
SELECT doc_id, r <= least(greatest(round_even(n * 0.1, 0), 1), n - 1) AS validation FROM r, n""")
def _(t):
    return S.split(t.documents.select("doc_id"), 7, "doc_id", 0.1)


@query("o07_budget_with_cooldown", f"""
WITH r AS (SELECT user_id AS id, sum(value) AS priority, count(*) FILTER (event_type = 'purchase') AS wins FROM events GROUP BY 1),
p AS (SELECT id, row_number() OVER (ORDER BY priority DESC, {_key(1, 'id')}) AS place FROM r WHERE wins % 5 <> 0)
SELECT id, CAST(place AS INT) AS place, CASE WHEN place <= 40 THEN 'selected' ELSE 'deferred' END AS state FROM p""")
def _(t):
    # the SQL adds doubles event after event, so users whose exact sums are equal may differ in the last bit; a running sum adds in that order and streams a user's rows
    in_order = W.partitionBy("user_id").orderBy("event_id")
    so_far = F.sum("value").over(in_order.rowsBetween(W.unboundedPreceding, 0))
    # the last row by its number: ids that are null or there twice would name no row, or one whose sum is not whole yet
    events = t.events.select("user_id", "event_type", so_far.alias("so_far"), F.row_number().over(in_order).alias("nth"))
    r = events.groupBy(F.col("user_id").alias("id")).agg(F.max_by("so_far", "nth").alias("priority"), F.count_if(F.col("event_type") == "purchase").alias("wins"))
    return S.budget(r.where("wins % 5 <> 0"), 40, F.desc("priority"), hashing.order_key(1, F.col("id"))).select("id", "place", "state")


_QUOTA = f"""
WITH r AS (SELECT user_id AS id, count(*) FILTER (event_type = 'purchase') % 5 AS s FROM events GROUP BY 1),
b AS (SELECT id, CASE WHEN s <= 2 THEN 'sparse' WHEN s = 3 THEN 'middle' ELSE 'boundary' END AS bucket FROM r),
q AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {_key(9, 'bucket', 'id')}) AS p, CASE bucket WHEN 'sparse' THEN 32 WHEN 'middle' THEN 19 ELSE 13 END AS quota FROM b),
one AS (SELECT id, bucket FROM q WHERE p <= quota),
rest AS (SELECT id, bucket FROM q WHERE p > quota ORDER BY CASE bucket WHEN 'sparse' THEN 0 WHEN 'middle' THEN 1 ELSE 2 END, {_key(9, chr(39) + 'remainder' + chr(39), 'id')} LIMIT greatest(0, 64 - (SELECT count(*) FROM one)))
"""


def _buckets(t):
    s = F.count_if(F.col("event_type") == "purchase") % 5
    return t.events.groupBy(F.col("user_id").alias("id")).agg(s.alias("s")).select("id", F.when(F.col("s") <= 2, "sparse").when(F.col("s") == 3, "middle").otherwise("boundary").alias("bucket"))


@query("o08_quota_with_fill", _QUOTA + "SELECT * FROM one UNION ALL SELECT * FROM rest")
def _(t):
    return S.quota_fill(_buckets(t), "bucket", {"sparse": 32, "middle": 19, "boundary": 13}, 64, 9, "id")


@query("o09_schedule", f"""
WITH r AS (SELECT user_id AS id, count(*) FILTER (event_type = 'purchase') % 3 AS rank FROM events GROUP BY 1), p AS (SELECT id, row_number() OVER (ORDER BY rank, {_key(2, 'id')}) - 1 AS p FROM r)
SELECT id, CAST(p % 16 AS INT) AS step_index, CAST(p // 16 AS INT) AS slot_index FROM p""")
def _(t):
    r = t.events.groupBy(F.col("user_id").alias("id")).agg((F.count_if(F.col("event_type") == "purchase") % 3).alias("rank"))
    return S.schedule(r, 16, "rank", hashing.order_key(2, F.col("id"))).select("id", "step_index", "slot_index")


@query("o10_zero_fillers", f"""
WITH r AS (SELECT user_id AS id, count(*) FILTER (event_type = 'purchase') AS s FROM events GROUP BY 1)
SELECT id, s % 2 = 0 AS hard_bank FROM r ORDER BY s % 2 = 0, {_key(4, chr(39) + 'zero-fill' + chr(39), 'id')} LIMIT 20""")
def _(t):
    r = t.events.groupBy(F.col("user_id").alias("id")).agg(F.count_if(F.col("event_type") == "purchase").alias("s"))
    return r.select("id", (F.col("s") % 2 == 0).alias("hard_bank")).orderBy("hard_bank", hashing.order_key(4, F.lit("zero-fill"), F.col("id"))).limit(20)


@query("o11_screen_ranking", f"""
WITH r AS (SELECT o_custkey AS id, count(*) AS visits, max(o_totalprice) AS priority FROM orders GROUP BY 1),
c AS (SELECT c_custkey AS id, coalesce(visits, 0) AS visits, coalesce(priority, 0) AS priority, CASE WHEN visits IS NULL THEN 0 WHEN visits <= 10 THEN 1 ELSE 2 END AS tier FROM customer LEFT JOIN r ON r.id = c_custkey)
SELECT id, CAST(tier AS INT) AS tier, visits FROM c ORDER BY tier, CASE WHEN tier = 2 THEN visits ELSE 0 END, priority DESC, {_key(6, 'id')} LIMIT 512""")
def _(t):
    r = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("v"), F.max("o_totalprice").alias("p"))
    c = t.customer.select(F.col("c_custkey").alias("id")).join(r, "id", "left")
    tier = F.when(F.col("v").isNull(), 0).when(F.col("v") <= 10, 1).otherwise(2)
    c = c.select("id", tier.alias("tier"), F.coalesce("v", F.lit(0)).alias("visits"), F.coalesce("p", F.lit(0.0)).alias("priority"))
    return c.orderBy("tier", F.when(F.col("tier") == 2, F.col("visits")).otherwise(0), F.desc("priority"), hashing.order_key(6, F.col("id"))).limit(512).select("id", "tier", "visits")


@query("o12_topup_selection", f"""
WITH {{ATT}}, g AS (SELECT problem_id FROM att WHERE attempt_index < 8 GROUP BY 1 HAVING NOT bool_or(success) AND count(DISTINCT attempt_index) = 8 AND count(*) = 8)
SELECT problem_id FROM g ORDER BY {_key(8, chr(39) + 'topup' + chr(39), 'problem_id')} LIMIT 128""")
def _(t):
    eight = t.attempts.where("attempt_index < 8").groupBy("problem_id").agg(F.bool_or("success").alias("any"), F.count("*").alias("n"), F.sort_array(F.collect_set("attempt_index")).alias("seen"))
    ok = (F.col("n") == 8) & (F.col("seen") == F.sequence(F.lit(0), F.lit(7))) & ~F.col("any")
    return eight.where(ok).select("problem_id").orderBy(hashing.order_key(8, F.lit("topup"), F.col("problem_id"))).limit(128)


@query("o14_stratified_nearest", f"""
WITH r AS (SELECT user_id AS id, count(*) FILTER (event_type = 'purchase') / count(*)::DOUBLE AS rate, user_id % 4 AS k FROM events GROUP BY 1),
p AS (SELECT id, 's' || k AS stratum, row_number() OVER (PARTITION BY k ORDER BY abs(rate - 0.25), {_key(12, 'id')}) AS place FROM r)
SELECT id, stratum, CAST(place AS INT) AS place FROM p WHERE place <= CASE stratum WHEN 's0' THEN 8 WHEN 's1' THEN 12 WHEN 's2' THEN 8 ELSE 4 END""")
def _(t):
    r = t.events.groupBy(F.col("user_id").alias("id")).agg((F.count_if(F.col("event_type") == "purchase") / F.count("*")).alias("rate"))
    r = r.withColumn("stratum", F.concat(F.lit("s"), F.col("id") % 4))
    return S.quotas(r, "stratum", {"s0": 8, "s1": 12, "s2": 8, "s3": 4}, F.abs(F.col("rate") - 0.25), hashing.order_key(12, F.col("id"))).select("id", "stratum", "place")


@query("o15_aligned_pool", f"""
WITH r AS (SELECT p_partkey AS id, p_retailprice AS priority FROM part WHERE p_size < 20), n AS (SELECT count(*) // 16 * 16 AS n FROM r),
p AS (SELECT id, row_number() OVER (ORDER BY priority DESC, id) AS place FROM r)
SELECT id, CASE WHEN place <= n THEN 'selected' ELSE 'holdout' END AS side FROM p, n""")
def _(t):
    r = t.part.where("p_size < 20").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("priority"))
    n = r.count() // 16 * 16
    return S.budget(r, n, F.desc("priority"), "id").select("id", F.when(F.col("state") == "selected", "selected").otherwise("holdout").alias("side"))


@query("o16_repeat_allocation", f"""
WITH r AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY {_key(13, 's_suppkey')}) AS p, count(*) OVER () AS n FROM supplier) SELECT id, CAST(1000 // n + CASE WHEN p <= 1000 % n THEN 1 ELSE 0 END AS INT) AS repeat FROM r""")
def _(t):
    return S.repeats(t.supplier.select(F.col("s_suppkey").alias("id")), 1000, 13, "id")


@query("o17_modulo_shards", "SELECT doc_id, CAST(doc_id % 4 AS BIGINT) AS shard, CAST(doc_id // 4 AS BIGINT) AS within FROM documents")
def _(t):
    return S.modulo_shards(t.documents.select("doc_id"), "doc_id", 4)


@query("o18_token_budget", "SELECT doc_id, least(2048, 8192 - n_chars) AS budget, least(2048, 8192 - n_chars) > 0 AS allowed FROM documents")
def _(t):
    b = F.least(F.lit(2048).cast("long"), 8192 - F.col("n_chars"))
    return t.documents.select("doc_id", b.alias("budget"), (b > 0).alias("allowed"))


@query("o19_bounded_windows", "SELECT conv_id, turn, CAST((row_number() OVER (ORDER BY conv_id, turn) - 1) // 5 AS BIGINT) AS window_id FROM conversations")
def _(t):
    return S.windows(t.conversations.select("conv_id", "turn"), 5, "conv_id", "turn")


@query("o20_matched_mixture", """
WITH a AS (SELECT doc_id, lang || n_chars % 50 AS g FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id, lang || n_chars % 50 AS g FROM documents WHERE doc_id % 2 = 1),
fa AS (SELECT g, min(doc_id) AS id FROM a GROUP BY 1 ORDER BY id LIMIT 20), fb AS (SELECT g, min(doc_id) AS id FROM b WHERE g NOT IN (SELECT g FROM fa) GROUP BY 1 ORDER BY id LIMIT 20)
SELECT 'first' AS side, id FROM fa UNION ALL SELECT 'second', id FROM fb""")
def _(t):
    d = t.documents.select("doc_id", F.concat("lang", (F.col("n_chars") % 50).cast("string")).alias("g"))
    first = lambda df: df.groupBy("g").agg(F.min("doc_id").alias("id"))
    fa = first(d.where("doc_id % 2 = 0")).orderBy("id").limit(20)
    fb = first(d.where("doc_id % 2 = 1").join(fa, "g", "left_anti")).orderBy("id").limit(20)
    return fa.select(F.lit("first").alias("side"), "id").unionByName(fb.select(F.lit("second").alias("side"), "id"))


@query("o21_greedy_token_mixture")
def _(t):
    rows = t.documents.select((F.col("doc_id") % 2).cast("int").alias("source_rank"), F.col("doc_id").alias("id"), F.concat("lang", (F.col("n_chars") % 50).cast("string")).alias("theorem_group_id"), F.col("n_chars").alias("tokens"))
    return S.greedy_budget(rows, {0: 12_000, 1: 8_000})


@query("o24_sequential_roles", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_key(17, 'doc_id')}, doc_id) AS p FROM documents)
SELECT doc_id, CASE WHEN p <= 500 THEN 'train' WHEN p <= 600 THEN 'eval' WHEN p <= 650 THEN 'discovery' END AS role FROM r""")
def _(t):
    return S.ranges(t.documents.select("doc_id"), {"train": 500, "eval": 100, "discovery": 50}, 17, "doc_id")


@query("o25_weighted_draws")
def _(t):
    return S.weighted_draws(t.supplier.select(F.col("s_suppkey").alias("id"), F.abs("s_acctbal").alias("w")), "w", 18, 500)


@query("o28_first_seen_order", "SELECT o_custkey AS id, min(o_orderkey) AS first_seen, count(*) >= 4 AS whole FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("first_seen"), (F.count("*") >= 4).alias("whole"))


@query("j10_reorder_by_list", "SELECT o.o_orderkey, CAST(i AS INT) AS place FROM (SELECT unnest([5, 3, 3000000, 1, 4]) AS k, unnest([0, 1, 2, 3, 4]) AS i) l LEFT JOIN orders o ON o.o_orderkey = l.k")
def _(t):
    ids = t.spark.range(1).select(F.posexplode(F.array(*(F.lit(x).cast("long") for x in (5, 3, 3000000, 1, 4)))).alias("place", "k"))
    return ids.join(t.orders.select("o_orderkey"), F.col("k") == F.col("o_orderkey"), "left").select("o_orderkey", "place")


@query("j11_one_to_one_mapping", """
WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 2 = 1)
SELECT a.doc_id AS old_id, count(b.doc_id) AS matches, count(b.doc_id) = 1 AS exact FROM a LEFT JOIN b USING (h) GROUP BY 1""")
def _(t):
    d = t.documents.select("doc_id", hashing.exact(F.col("text")).alias("h"))
    b = d.where("doc_id % 2 = 1").groupBy("h").agg(F.count("*").alias("n"))
    j = d.where("doc_id % 2 = 0").join(b, "h", "left").select(F.col("doc_id").alias("old_id"), F.coalesce("n", F.lit(0)).alias("matches"))
    return j.withColumn("exact", F.col("matches") == 1)


@query("j16_missing_ids", "SELECT DISTINCT l_partkey + 1990 AS p_partkey FROM lineitem WHERE l_partkey + 1990 NOT IN (SELECT p_partkey FROM part)")
def _(t):
    return gates.missing(t.lineitem.select((F.col("l_partkey") + 1990).alias("p_partkey")), t.part, "p_partkey")


@query("j17_history_default", "SELECT c_custkey, coalesce(max(o_totalprice), 1.0) AS priority, count(o_orderkey) AS visits FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    h = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("p"), F.count("*").alias("v"))
    return t.customer.select("c_custkey").join(h, "c_custkey", "left").select("c_custkey", F.coalesce("p", F.lit(1.0)).alias("priority"), F.coalesce("v", F.lit(0)).alias("visits"))


@query("j18_exact_cover", "SELECT c_custkey, 'left_only' AS reason FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    return gates.mismatched(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey")


@query("j20_positional_gate", """
WITH a AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS i, role FROM conversations), b AS (SELECT row_number() OVER (ORDER BY conv_id, turn DESC) - 1 AS i, role FROM conversations)
SELECT a.i AS row_index, 'role' AS reason FROM a JOIN b USING (i) WHERE a.role IS DISTINCT FROM b.role""")
def _(t):
    rows = lambda o: placed(t.conversations, "conv_id", o).select((F.col("place") - 1).alias("row_index"), "role")
    return gates.mismatched(rows("turn"), rows(F.desc("turn")), "row_index", "role")


@query("f12_composed_theorems", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'theorem t : a = b := by' || chr(10) || '  simp' || chr(10) || '  ring' WHEN 1 THEN 'theorem t : a = b := fun x => x' END AS code, CASE WHEN doc_id % 3 = 2 THEN 'empty proof RHS' END AS error FROM documents")
def _(t):
    p = F.when(F.col("doc_id") % 3 == 0, "simp\nring").when(F.col("doc_id") % 3 == 1, ":= fun x => x").otherwise(" ")
    return t.documents.select("doc_id", scanner.compose(F.lit("theorem t : a = b := by sorry"), p).alias("x")).select("doc_id", "x.code", "x.error")


@query("f16_generation_prompts", "SELECT doc_id, 'import M' || chr(10) || chr(10) || 'open ' || lang || chr(10) || chr(10) || 'theorem t' || doc_id || ' := by sorry' AS prompt FROM documents")
def _(t):
    parts = F.array(F.lit("import M"), F.concat(F.lit("open "), F.col("lang")), F.lit("import M"), F.concat(F.lit("theorem t"), F.col("doc_id"), F.lit(" := by sorry")))
    return t.documents.select("doc_id", F.array_join(F.array_distinct(parts), "\n\n").alias("prompt"))


@query("f17_completions", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'by simp' ELSE 'by' || chr(10) || '  exact foo' END AS completion FROM documents")
def _(t):
    return t.documents.select("doc_id", text.completion(F.when(F.col("doc_id") % 2 == 0, " by simp ").otherwise("foo")).alias("completion"))


@query("p11_namespace_prefixes", "SELECT DISTINCT host, CASE WHEN n >= i THEN array_to_string(list_slice(parts, 1, i), '.') END AS prefix FROM (SELECT split_part(url, '/', 3) AS host, string_split(split_part(url, '/', 3), '.') AS parts, len(string_split(split_part(url, '/', 3), '.')) AS n FROM pages) p, generate_series(1, 8) s(i) WHERE i <= n")
def _(t):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    return t.pages.select(host.alias("host"), F.explode(text.prefixes(host)).alias("prefix")).distinct()


@query("p26_migration_rules", "SELECT doc_id, replace(lang || ':' || source, 'src1', 'legacy') AS context, concat_ws(',', CASE WHEN lang = 'en' THEN 'rule_lang' END, CASE WHEN contains(source, 'src1') THEN 'rule_source' END) AS rules FROM documents")
def _(t):
    rules = F.array_compact(F.array(F.when(F.col("lang") == "en", F.lit("rule_lang")), F.when(F.col("source").contains("src1"), F.lit("rule_source"))))
    return t.documents.select("doc_id", F.replace(F.concat_ws(":", "lang", "source"), F.lit("src1"), F.lit("legacy")).alias("context"), F.array_join(rules, ",").alias("rules"))


@query("p27_acceptance", "SELECT doc_id, CASE WHEN quality = 1 THEN 'elaborated' WHEN toxic = 1 THEN 'failed' ELSE 'warning_only' END AS status, quality = 1 OR toxic = 0 AS accepted FROM labels")
def _(t):
    status = F.when(F.col("quality") == 1, "elaborated").when(F.col("toxic") == 1, "failed").otherwise("warning_only")
    return t.labels.select("doc_id", status.alias("status"), ((F.col("quality") == 1) | (F.col("toxic") == 0)).alias("accepted"))


@query("f42_source_prefix", "SELECT conv_id, string_agg(left(role, 3), chr(10) ORDER BY turn) AS prefix FROM conversations WHERE turn < 3 GROUP BY 1")
def _(t):
    g = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("lines"))
    return g.select("conv_id", F.array_join(F.transform(F.slice("lines", 1, 3), lambda x: F.left(x, F.lit(3))), "\n").alias("prefix"))


@query("f31_message_severity", "WITH {ATT} SELECT event_id, CAST(CASE WHEN diagnostics <> '' THEN 1 ELSE 0 END AS INT) AS errors, 1 AS warnings FROM att")
def _(t):
    m = F.array(F.col("diagnostics"), F.lit("warning: unused variable"))
    count = lambda p: F.size(F.filter(m, lambda x: x.startswith(p)))
    return t.attempts.select("event_id", count("error:").alias("errors"), count("warning:").alias("warnings"))


@query("v22_trace_errors", """
WITH x AS (SELECT conv_id, count(*) AS n, max(turn) AS m, bool_or(role = 'system') AS s FROM conversations GROUP BY 1)
SELECT conv_id, concat_ws(',', CASE WHEN n < 3 THEN 'short' END, CASE WHEN m + 1 <> n THEN 'index' END, CASE WHEN s THEN 'system' END) AS errors FROM x""")
def _(t):
    g = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("m"), F.bool_or(F.col("role") == "system").alias("s"))
    errors = F.array_compact(F.array(F.when(F.col("n") < 3, F.lit("short")), F.when(F.col("m") + 1 != F.col("n"), F.lit("index")), F.when(F.col("s"), F.lit("system"))))
    return g.select("conv_id", F.array_join(errors, ",").alias("errors"))


@query("v13_label_supervision", """
WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN -100 ELSE length(text) % 50 END AS l FROM conversations)
SELECT conv_id, count(*) FILTER (l <> -100) AS supervised, arg_max(l, turn) <> -100 AS last_supervised, bool_or(l = -100) AS has_masked FROM c GROUP BY 1""")
def _(t):
    c = t.conversations.select("conv_id", "turn", F.when(F.col("role") == "user", -100).otherwise(F.length("text") % 50).alias("l"))
    g = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "l"))), lambda x: x["l"]).alias("labels"))
    return g.select("conv_id", F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("supervised"), (F.element_at("labels", -1) != -100).alias("last_supervised"), F.exists("labels", lambda x: x == -100).alias("has_masked"))


@query("o29_verification_order", "WITH {ATT} SELECT problem_id, CAST(attempt_index AS INT) AS attempt_index, CAST((problem_id * 32 + attempt_index) % 8 AS BIGINT) AS worker FROM att")
def _(t):
    return t.attempts.select("problem_id", "attempt_index", ((F.col("problem_id") * 32 + F.col("attempt_index")) % 8).alias("worker"))


@query("k05_cache_upsert", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM documents")
def _(t):
    old = t.documents.select("doc_id", F.lit("old").alias("version"))
    new = t.documents.where("doc_id % 3 = 0").select("doc_id", F.lit("new").alias("version"))
    return old.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)


@query("k13_manifest_compare", "SELECT k AS key, 'value' AS reason FROM (SELECT DISTINCT lang AS k FROM documents) x WHERE k IN ('de', 'fr')")
def _(t):
    m = t.documents.select(F.col("lang").alias("key")).distinct()
    one = m.withColumn("value", F.lit("a"))
    return gates.mismatched(one, m.withColumn("value", F.when(F.col("key").isin("de", "fr"), "b").otherwise("a")), "key", "value")


@query("w03_trace_validation", """
SELECT conv_id, max(turn) - min(turn) + 1 = count(*) AS continuous, arg_max(role, turn) = 'assistant' AS closed FROM conversations GROUP BY 1""")
def _(t):
    s = traces.ordered_steps(t.conversations, "conv_id", "turn", "role")
    return s.select("conv_id", traces.continuous(F.col("steps"), "turn").alias("continuous"), (F.element_at("steps", -1)["role"] == "assistant").alias("closed"))


@query("a41_group_percentiles", """
WITH v AS (SELECT lang, list(n_chars ORDER BY n_chars) AS v, count(*) AS n FROM documents GROUP BY 1)
SELECT lang, v[CAST(round_even((n - 1) * 0.9, 0) AS INT) + 1] AS half_even, v[CAST(floor((n - 1) * 0.9) AS INT) + 1] AS floor90, v[CAST(ceil(0.9 * n) AS INT)] AS ceil90 FROM v""")
def _(t):
    g = t.documents.groupBy("lang").agg(F.sort_array(F.collect_list("n_chars")).alias("v"))
    return g.select("lang", stats.half_even(F.col("v"), 0.9).alias("half_even"), stats.floor(F.col("v"), 0.9).alias("floor90"), stats.ceil(F.col("v"), 0.9).alias("ceil90"))

"""Queries that write a table in some form and scan it, and queries that run over a stream to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import dedup
from corpusmill.operators import records as R
from corpusmill.plans.registry import Tables, query
from corpusmill.sources import json_arrays, records, sinks
from corpusmill.sources.shared import folder
from corpusmill.streaming import attempts as stream

CONVERSATION = "conv_id long, turn long, role string, text string"


@query("i02_jsonl_scan", "SELECT conv_id, turn, role, text FROM conversations")
def _(t):
    path = folder(t.spark, "rows") + ".jsonl"
    sinks.write_jsonl(t.conversations, path)
    return records.read(t.spark, path, CONVERSATION)


@query("i03_json_list_scan", "SELECT role, count(*) AS n FROM conversations GROUP BY 1")
def _(t):
    path = folder(t.spark, "lists")
    # one list under "train" for each conversation, and no list over all
    lists = t.conversations.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("train"))
    lists.select(F.to_json(F.struct("train")).alias("value")).repartition(8).write.text(path)
    rows = t.spark.read.text(path).select(F.explode(F.from_json("value", "train array<struct<turn long, role string>>")["train"]).alias("r"))
    return rows.groupBy("r.role").agg(F.count("*").alias("n"))


@query("i04_csv_scan", "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text FROM conversations")
def _(t):
    path = folder(t.spark, "rows")
    t.conversations.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return records.csv(t.spark, path)


@query("i05_parquet_scan", "SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def _(t):
    return t.lineitem.where("l_discount > 0.05").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("i08_strict_jsonl_scan", "SELECT doc_id, quality, toxic FROM labels")
def _(t):
    path = folder(t.spark, "labels")
    sinks.write_jsonl(t.labels, path)
    return records.strict_jsonl(t.spark, path, "doc_id long, quality int, toxic int")


@query("i09_tolerant_attempt_log", "WITH {ATT} SELECT problem_id, CAST(attempt_index AS INT) AS attempt_index, true AS success FROM att WHERE attempt_index < 4")
def _(t):
    path = folder(t.spark, "log")
    a = t.attempts.where("attempt_index < 4").select("problem_id", "attempt_index")
    twice = a.select(F.to_json(F.struct("problem_id", "attempt_index", F.lit(False).alias("success"))).alias("value"), "problem_id", "attempt_index", F.lit(0).alias("o"))
    twice = twice.union(a.select(F.lit("{broken").alias("value"), "problem_id", "attempt_index", F.lit(1)))
    twice = twice.union(a.select(F.to_json(F.struct("problem_id", "attempt_index", F.lit(True).alias("success"))), "problem_id", "attempt_index", F.lit(2)))
    twice.repartition(4, "problem_id").sortWithinPartitions("problem_id", "attempt_index", "o").select("value").write.text(path)
    return records.attempt_log(t.spark, path, "problem_id long, attempt_index int, success boolean")


@query("i10_json_array_objects", "SELECT doc_id, lang, source, sha256(text) AS text_sha256 FROM documents")
def _(t):
    path = folder(t.spark, "arrays")
    json_arrays.write(t.documents.select("doc_id", "lang", "source", "text"), path)
    rows = json_arrays.read(t.spark, path, "doc_id long, lang string, source string, text string", range_bytes=8 << 20)
    return rows.select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"))


@query("i11_wanted_declarations", "SELECT conv_id AS path, role AS full_name, max(turn) AS code FROM conversations WHERE role <> 'user' GROUP BY 1, 2")
def _(t):
    corpus = t.conversations.orderBy("conv_id", "turn").select(F.col("conv_id").alias("path"), F.array(F.struct(F.col("role").alias("full_name"), F.col("turn").alias("code"))).alias("premises"))
    wanted = t.conversations.where("role <> 'user'").select(F.col("conv_id").alias("path"), F.col("role").alias("full_name"))
    return records.corpus_declarations(corpus, wanted).select("path", "full_name", "code")


@query("i12_generation_files", "WITH {ATT} SELECT problem_id, CAST(attempt_index AS INT) AS attempt_index, proof FROM att WHERE attempt_index < 3")
def _(t):
    path = folder(t.spark, "generations")
    sinks.shard_by_problem(t.attempts.where("attempt_index < 3").select("problem_id", "attempt_index", "proof"), path)
    return records.generations(t.spark, path, "problem_id long, attempt_index int, proof string", "*.json").select("problem_id", "attempt_index", "proof")


@query("i16_rollout_rows", "SELECT doc_id AS row_index, source || CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) > 1 THEN '-' || doc_id ELSE '' END AS id, lang AS prompt FROM documents")
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("row_index"), F.col("source").alias("id"), F.col("lang").alias("prompt"), F.lit("hidden").alias("completion"))
    return records.rollout(rows, "sft")


@query("k02_content_digest_is_stable", "SELECT true AS same, count(*) AS n FROM labels")
def _(t):
    one, two = sinks.content_digest(t.labels), sinks.content_digest(t.labels.repartition(7))
    return t.labels.agg(F.lit(one == two).alias("same"), F.count("*").alias("n"))


@query("k06_problem_shards", "WITH {ATT} SELECT CAST(problem_id AS VARCHAR) AS problem, count(*) AS n FROM att GROUP BY 1")
def _(t):
    path = folder(t.spark, "shards")
    sinks.shard_by_problem(t.attempts.select("problem_id", "attempt_index"), path)
    # each line names its problem
    return t.spark.read.schema("attempt_index int, problem string").json(path).groupBy("problem").agg(F.count("*").alias("n"))


@query("k10_rejected_side_output", "SELECT CASE WHEN n_chars < 200 THEN 'short' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    kept, rejected = sinks.rejected_and_kept(t.documents.select("doc_id", F.when(F.col("n_chars") < 200, "short").alias("reason")), "reason")
    count = lambda df: df.groupBy("reason").agg(F.count("*").alias("n"))
    return count(kept).unionByName(count(rejected))


@query("k12_file_manifest")
def _(t):
    path = folder(t.spark, "bundle")
    t.labels.repartition(4).write.json(path)
    manifest = sinks.file_manifest(t.spark, path)
    return manifest.agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).crossJoin(sinks.verify_manifest(manifest, t.spark, path).agg(F.count("*").alias("changed")))  # one row each


LOG = "event_id long, problem_id long, attempt_index int, success boolean, ts timestamp"


def _log(t):
    path = folder(t.spark, "log")
    t.attempts.select("event_id", "problem_id", "attempt_index", "success", "ts").repartition(6, "problem_id").write.parquet(path)
    return stream.read_log(t.spark, path, LOG, files_each=2)


def _to_end(t, frame):
    """The rows that a stream has appended once it has read all there is."""
    path = folder(t.spark, "appended")
    q = frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", folder(t.spark, "stream")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(frame.schema).parquet(path)


@query("t01_rows_at_completion", "WITH {ATT} SELECT problem_id, 32 AS attempts, count(*) FILTER (success) AS successes FROM att GROUP BY 1 HAVING count(*) = 32")
def _(t):
    return _to_end(t, stream.when_complete(_log(t), 32))


@query("t02_once_for_each_key", "WITH {ATT} SELECT problem_id, CAST(attempt_index AS INT) AS attempt_index FROM att")
def _(t):
    twice = _log(t)
    return _to_end(t, stream.once(twice.unionByName(_log(t))).select("problem_id", "attempt_index"))


@query("t04_resumed_receipts", "WITH {ATT} SELECT count(*) AS receipts, count(DISTINCT problem_id) AS problems FROM att")
def _(t):
    path, checkpoint = folder(t.spark, "receipts"), folder(t.spark, "stream")
    log = _log(t)
    for _ in range(2):  # the second run finds nothing new
        stream.resume(log, path, checkpoint).awaitTermination()
    return t.spark.read.parquet(path).agg(F.count("*").alias("receipts"), F.count_distinct("problem_id").alias("problems"))


@query("t07_lagged_scale_stream")
def _(t):
    path = folder(t.spark, "groups")
    r = F.when(F.col("success"), 1.0).otherwise(0.0)
    t.attempts.groupBy("problem_id").agg(F.sum((r - 0.2) * (r - 0.2)).alias("square_sum"), F.count("*").alias("n")).select(F.lit(1).cast("long").alias("run"), F.col("problem_id").alias("group_id"), "square_sum", "n").repartition(1).write.parquet(path)
    groups = stream.read_log(t.spark, path, "run long, group_id long, square_sum double, n long")
    return _to_end(t, stream.lagged_scale(groups))


@query("p10_reference_only_rows", "SELECT doc_id, 'reference_proof' AS proof_fields FROM documents WHERE doc_id % 2 = 0")
def _(t):
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "x").alias("reference_proof"))
    return R.statement_only(rows, ["proof", "reference_proof"]).where(F.size("proof_fields") > 0).select("doc_id", F.array_join("proof_fields", ",").alias("proof_fields"))

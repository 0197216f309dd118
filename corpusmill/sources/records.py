"""Scans of records: JSONL, JSON, CSV, Parquet, attempt logs, generations, receipts, time series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators.gates import enforce

# fixed values: roles of protected files, in the order in which they are tried
ROLES = ("eval", "monitor", "benchmark", "miniF2F", "strict_unseen", "unseen", "discovery_gate", "anchor_gate", "full500", "reserve")
#: Splits of the two-file source (I-06).
SPLITS = {"train": "wkbk_1009.parquet", "valid": "minif2f_valid.jsonl", "validation": "minif2f_valid.jsonl", "test": "minif2f_test.jsonl"}
KINDS = {"workbook": "lean_workbook", "minif2f": "minif2f", "numina": "numinamath", "kimina": "kimina", "leandojo": "leandojo", "mathlib": "current_mathlib"}
_ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_adapter(kind: str, adapter: Callable[[DataFrame], DataFrame]) -> None:
    """P-04: a frame-to-frame adapter for a kind of dataset."""
    _ADAPTERS[kind] = adapter


def adapt(df: DataFrame, kind: str) -> DataFrame:
    """The adapter of a kind; without one, the frame as it is."""
    return _ADAPTERS.get(kind, lambda x: x)(df)


def dataset_kind(name: str) -> str:
    """I-07: the kind whose alias the name holds."""
    low = name.lower().replace("-", "").replace("_", "")
    return next((v for k, v in KINDS.items() if k.replace("_", "") in low), "generic")


def split_file(split: str) -> str:
    """I-06."""
    if split not in SPLITS:
        raise ValueError(f"unsupported split {split!r}")
    return SPLITS[split]


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """I-01: by suffix; production paths name a schema."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "jsonl":
        return jsonl(spark, path, schema)
    if kind == "json":
        return json_list(spark, path, schema)
    if kind == "csv":
        return csv(spark, path, schema)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported source {path!r}")


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """I-02: one record in each line; blank lines are skipped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def json_list(spark: SparkSession, path: str, schema: str | None = None, keys=("data", "train", "validation", "test")) -> DataFrame:
    """I-03: a top-level list, or the first list under one of the keys; a file is a row here (larger arrays: json_arrays)."""
    if not schema:
        raw = spark.read.option("multiLine", True).json(path)
        found = [k for k in keys if k in raw.columns and raw.schema[k].dataType.typeName() == "array"]
        return raw.select(F.explode(found[0]).alias("r")).select("r.*") if found else raw
    text = spark.read.text(path, wholetext=True)
    wrapped = ", ".join(f"{k} array<struct<{schema}>>" for k in keys)
    top = F.from_json("value", f"array<struct<{schema}>>")
    inner = F.from_json("value", f"struct<{wrapped}>")
    rows = F.when(F.ltrim(F.col("value")).startswith("["), top).otherwise(F.coalesce(*(inner[k] for k in keys)))
    return text.select(F.explode(rows).alias("r")).select("r.*")


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """I-04, I-17: with a header; strings unless a schema says otherwise."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """I-08: fails on a line that isn't a JSON object."""
    lines = spark.read.text(path).where(text.strip(F.col("value")) != "")
    enforce(lines.where(F.coalesce(~F.col("value").rlike(r"^\s*\{"), F.lit(True)) | F.from_json("value", "map<string,string>").isNull()), f"{path} has lines that are not objects")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def attempt_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """I-09: corrupt lines are dropped; of rows with one problem and attempt the last written stays."""
    reader = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    rows = reader.json(path).select("*", F.col("_metadata.file_path").alias("_file")).withColumn("_line", F.monotonically_increasing_id())
    rows = rows.where("_corrupt_record is null and problem_id is not null")
    last = F.row_number().over(W.partitionBy("problem_id", "attempt_index").orderBy(F.desc("_file"), F.desc("_line")))
    return rows.withColumn("_n", last).where("_n = 1").drop("_corrupt_record", "_file", "_line", "_n")


def generations(spark: SparkSession, folder: str, schema: str, pattern: str = "problem_*.jsonl") -> DataFrame:
    """I-12: all files below a folder; a key in two of them fails."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(folder)
    enforce(rows.groupBy("problem_id", "attempt_index").count().where("count > 1"), "attempts repeat")
    return rows


def line_addressed(spark: SparkSession, bindings: DataFrame, path: str) -> DataFrame:
    """I-13: bindings (path, line) with the text of that line (from 1).

    Files are read in byte ranges; a line's number is its place in its range after the lines of the ranges before it.
    """
    read = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    read = read.withColumn("nth", F.monotonically_increasing_id())
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    starts = read.groupBy("path", "start").agg(F.count("*").alias("n")).select("path", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    lines = read.withColumn("nth", F.row_number().over(W.partitionBy("path", "start").orderBy("nth"))).join(starts, ["path", "start"])
    return bindings.join(lines.select("path", (F.col("nth") + F.col("first")).cast("int").alias("line"), "text"), ["path", "line"], "left")


def benchmark(spark: SparkSession, path: str, schema: str, limit: int | None = None, forbidden=("proof", "completion", "target")) -> DataFrame:
    """I-15: problems in file order; target columns and repeated ids fail."""
    from corpusmill.operators.gates import columns_present

    rows = jsonl(spark, path, schema).withColumn("row_index", F.monotonically_increasing_id())
    if bad := columns_present(rows, list(forbidden)):
        raise ValueError(f"benchmark rows carry targets: {bad}")
    enforce(rows.groupBy("id").count().where("count > 1"), "problem ids repeat")
    return rows.orderBy("row_index").limit(limit) if limit is not None else rows


def rollout(rows: DataFrame, kind: str) -> DataFrame:
    """I-16: minimal sft or grpo rows (row_index, id, prompt, ...); proofs are hidden or refused, repeated ids get their index."""
    if kind == "grpo" and "proof" in rows.columns:
        enforce(rows.where(text.strip(F.col("proof")) != "").select("id"), "grpo rows carry proofs")
    again = F.row_number().over(W.partitionBy("id").orderBy("row_index")) > 1
    named = rows.withColumn("id", F.when(again, F.concat_ws("-", "id", "row_index")).otherwise(F.col("id")))
    return named.drop("completion", "proof")


def corpus_declarations(corpus: DataFrame, wanted: DataFrame) -> DataFrame:
    """I-11: premises of corpus rows (path, premises array<struct<full_name, code>>) that are wanted; of one key the later row wins."""
    rows = corpus.withColumn("row", F.monotonically_increasing_id()).select("path", "row", F.explode("premises").alias("p")).select("path", "row", "p.*")
    found = rows.join(wanted.select("path", "full_name").distinct(), ["path", "full_name"], "left_semi")
    last = F.row_number().over(W.partitionBy("path", "full_name").orderBy(F.desc("row")))
    return found.withColumn("n", last).where("n = 1").drop("n", "row")


def protected(spark: SparkSession, paths: list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """I-18: rows of many files, and an inventory of records and role by file."""
    rows = spark.read.schema(schema).json(sorted(set(paths))).select("*", F.col("_metadata.file_path").alias("path"))
    role = F.lit("evaluation_protected")
    for term in reversed(ROLES):
        role = F.when(F.lower("path").contains(term.lower()), term).otherwise(role)
    return rows, rows.groupBy("path").agg(F.count("*").alias("records")).withColumn("role", role)

"""I-10: arrays of JSON objects, larger than a task may hold, as a scan of byte ranges.

A file is read by Spark's text source in ranges, cut after each closing brace. Such a cut never parts an escape, so all
that a reader must know where its range begins is whether it is in a string and how deep. Both come from sums: a first
scan gives each range its number of quotes and its change of depth for either beginning, sums of these over the
ranges before it tell how it begins, and a second scan cuts its objects. What stands across a border is put together
from the ranges' ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.operators.gates import enforce
from corpusmill.sources.shared import materialise

RANGE = 64 << 20
#: Ranges whose beginnings are broadcast; above, pieces are shuffled to theirs.
SENT = 200_000
BLANK = "[ \\t\\r\\n]*"
PIECE = "path string, start long, quotes int, outside int, inside int"


def read(spark: SparkSession, path: str, schema: str | None = None, range_bytes: int = RANGE) -> DataFrame:
    """The objects of the top-level arrays in files: by schema, else as text in `value`.

    `path`, `start` and `nth` give an object's place in file order. An element that is no object, a file that is no
    array or ends early, and text after an array fail. An empty array and an empty file have no rows; null is a missing
    field. A single object has to fit a task, and the objects that stand across borders of one file are put in order
    together (at most two for a range).
    """
    pieces = _pieces(spark, path, range_bytes)
    states = materialise(_begins(pieces.drop("value").mapInArrow(_sums, "path string, start long, quotes long, depth0 long, depth1 long")), "ranges")
    # the reader's brace after the last piece is one too many, so a whole array ends at -1
    last = states.groupBy("path").agg(F.max_by("after", "start").alias("depth"), F.max_by("odd_after", "start").alias("odd"))
    enforce(last.where("depth <> -1 or odd"), "files that are not one whole JSON array")
    begins = states.select(F.col("path").alias("p"), F.col("start").alias("s"), "odd", "depth")
    on = (F.col("path") == F.col("p")) & (F.col("start") == F.col("s"))
    if states.count() <= SENT:
        known = pieces.join(F.broadcast(begins), on, "left")
    else:
        known = pieces.withColumn("n", F.monotonically_increasing_id()).join(begins.hint("shuffle_merge"), on, "left").repartition("path", "start").sortWithinPartitions("path", "start", "n")
    cut = known.select(*pieces.columns, "odd", "depth").mapInArrow(_cut, "path string, start long, nth long, part string, value string")
    rows = _joined(materialise(cut, "objects"))
    if schema is None:
        return rows
    return rows.select("path", "start", "nth", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("path", "start", "nth", "r.*")


def write(df: DataFrame, path: str) -> None:
    """Each task's rows as one array in a file, an object to a line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(_bracketed, "value string").write.text(path)


def _pieces(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """Text up to each closing brace with its unescaped quotes, and what it adds to the depth if it begins outside or inside a string."""
    # the sizes of ranges are settings of the session that a scan was made in; both scans need the same ones
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", range_bytes)
    own.conf.set("spark.sql.files.openCostInBytes", range_bytes)
    scan = own.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    name = f"pieces_{uuid.uuid4().hex}"
    scan.createGlobalTempView(name)
    found = spark.table(f"global_temp.{name}")
    spark.catalog.dropGlobalTempView(name)
    plain = F.regexp_replace(F.concat("value", F.lit("}")), r"(?s)\\.", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    return found.select("path", "start", quotes.alias("quotes"), _depth(plain).alias("outside"), _depth(F.concat(F.lit('"'), plain)).alias("inside"), "value")


def _depth(text: Column) -> Column:
    """Opened less closed brackets outside strings."""
    bare = F.regexp_replace(text, r'"[^"]*("|\z)', "")
    return F.length(F.translate(bare, "]}", "")) - F.length(F.translate(bare, "[{", ""))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(path, start, first row, row after the last) of the ranges in a batch."""
    if not batch.num_rows:
        return
    path, start = batch.column("path"), batch.column("start")
    new = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(start[1:], start[:-1]))
    edges = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
    for i, j in zip(edges, edges[1:]):
        yield path[i].as_py(), start[i].as_py(), i, j


def _odd_before(quotes: np.ndarray, odd: int) -> np.ndarray:
    """Whether each piece begins in a string."""
    return (odd + np.cumsum(quotes) - quotes) % 2 == 1


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range: quotes, and the change of depth if it begins outside (0) or inside (1) a string."""
    found: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        quotes, outside, inside = (batch.column(c).to_numpy().astype(np.int64) for c in ("quotes", "outside", "inside"))
        for path, start, i, j in _runs(batch):
            sums = found.setdefault((path, start), np.zeros(3, np.int64))
            odd = _odd_before(quotes[i:j], int(sums[0]))
            sums += (quotes[i:j].sum(), np.where(odd, inside[i:j], outside[i:j]).sum(), np.where(odd, outside[i:j], inside[i:j]).sum())
    if found:
        rows = [{"path": p, "start": s, "quotes": int(q), "depth0": int(a), "depth1": int(b)} for (p, s), (q, a, b) in found.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("start", "quotes", "depth0", "depth1"))]))


def _begins(sums: DataFrame) -> DataFrame:
    """How each range begins (odd: in a string; depth) and how it ends."""
    upto = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    odd = sums.withColumn("q", F.sum("quotes").over(upto)).withColumn("odd", (F.col("q") - F.col("quotes")) % 2 == 1)
    change = odd.withColumn("change", F.when(F.col("odd"), F.col("depth1")).otherwise(F.col("depth0"))).withColumn("after", F.sum("change").over(upto))
    return change.select("path", "start", "odd", (F.col("after") - F.col("change")).alias("depth"), (F.col("q") % 2 == 1).alias("odd_after"), "after")


OUT = pa.schema([("path", pa.string()), ("start", pa.int64()), ("nth", pa.int64()), ("part", pa.string()), ("value", pa.string())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects with the text before them (part null), and of each range what belongs to the one before it ('tail', or 'middle' if it
    doesn't end here) and what it leaves open ('head')."""
    here, odd, depth, nth, open_, kind = None, 0, 0, 0, [], "head"

    def left():
        return [(*here, nth, "middle" if kind == "tail" else "head", "".join(open_))] if open_ else []

    for batch in batches:
        out = []
        quotes, outside, inside = (batch.column(c).to_numpy().astype(np.int64) for c in ("quotes", "outside", "inside"))
        for path, start, i, j in _runs(batch):
            if (path, start) != here:
                out += left()
                at, deep = batch.column("odd")[i].as_py(), batch.column("depth")[i].as_py()
                if at is None:
                    raise RuntimeError(f"no sums for the range of {path} at {start}: the file changed between two scans")
                here, odd, depth, nth, open_ = (path, start), int(at), deep, 0, []
                kind = "head" if start == 0 or (depth == 1 and not odd) else "tail"
            before = _odd_before(quotes[i:j], odd)
            depths = depth + np.cumsum(np.where(before, inside[i:j], outside[i:j]))
            closed = (depths == 1) & ((before + quotes[i:j]) % 2 == 0)
            for text, whole in zip(batch.column("value").slice(i, j - i).to_pylist(), closed.tolist()):
                open_ += (text, "}")
                if whole:
                    out.append((path, start, nth, "tail" if kind == "tail" else None, "".join(open_)))
                    nth, open_, kind = nth + 1, [], "head"
            odd, depth = (odd + int(quotes[i:j].sum())) % 2, int(depths[-1])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), OUT)], schema=OUT)
    if here is not None and (rest := left()):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rest), OUT)], schema=OUT)


def _joined(cut: DataFrame) -> DataFrame:
    """The objects, those across borders put together, each without what stands before it."""
    owner = F.last(F.when(F.col("part") == "head", F.struct("start", "nth")), ignorenulls=True).over(W.partitionBy("path").orderBy("start", "nth"))
    parts = cut.where("part is not null").withColumn("owner", owner)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "nth", "value"))), lambda x: x["value"]), "")
    whole = parts.groupBy("path", "owner").agg(text.alias("value"), F.bool_or(F.col("part") == "tail").alias("closed"))
    whole = whole.select("path", F.col("owner.start").alias("start"), F.col("owner.nth").alias("nth"), "value", "closed")
    rows = cut.where("part is null").select("path", "start", "nth", "value", F.lit(True).alias("closed")).unionByName(whole)
    first = (F.col("start") == 0) & (F.col("nth") == 0)
    opens = F.when(first, F.col("value").rlike(rf"^{BLANK}\[{BLANK}\{{")).otherwise(F.col("value").rlike(rf"^{BLANK},{BLANK}\{{"))
    # the last piece of a file has the reader's brace behind it
    ends = F.when(first, F.col("value").rlike(rf"^{BLANK}\[{BLANK}\]{BLANK}\}}$")).otherwise(F.col("value").rlike(rf"^{BLANK}\]{BLANK}\}}$"))
    wrong = F.raise_error(F.concat(F.lit("not an array of objects: "), F.col("path"), F.lit(" near "), F.left("value", F.lit(80)))).cast("boolean")
    kept = rows.where(F.when(F.col("closed") & opens, True).when(~F.col("closed") & ends, False).otherwise(wrong))
    return kept.select("path", "start", "nth", F.substring("value", F.locate("{", F.col("value")), F.length("value")).alias("value"))


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A comma before each value but the first, which has the opening bracket; the closing one ends the last."""
    held, sign = None, "["
    for batch in batches:
        out = []
        for text in batch.column("value").to_pylist():
            if held is not None:
                out.append(held)
            held, sign = sign + text, ","
        if out:
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
    if held is not None:
        yield pa.RecordBatch.from_pydict({"value": pa.array([held + "]"], pa.string())})

"""Shared folder, materialisation and connected components for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A node with more edges than this, and than a thousandth of all, is looked up by broadcast: at most 2,000 nodes are.
HUB, HUB_SHARE = 256, 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where that is unset and the master is local."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own is None and spark.sparkContext.getCheckpointDir() is not None:
        own = spark.sparkContext.getCheckpointDir()
    if own is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is unset, and with master {master} no local folder is shared")
        own = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what materialise wrote for these frames; nothing that is still to be read may depend on them."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free(df: DataFrame, *names: str) -> list[str]:
    """These names, each with underscores added until no column of df has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


_KEPT: dict[str, Callable[[], None]] = {}


def turn_to(name: str, clear: Callable[[], None] | None = None) -> None:
    """In a Python worker, before a task: what other operators have kept there from task to task is given up.

    Workers are used again by whatever comes next; without this one that has encoded texts would hold its
    words while it scores others. clear forgets what the operator of this name keeps.
    """
    others = [k for k in _KEPT if k != name]
    for k in others:
        _KEPT.pop(k)()
    if clear is not None:
        if _KEPT.get(name, clear) != clear:
            _KEPT[name]()
        _KEPT[name] = clear
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
            trim(0)


def spread(n_bytes: int, per_task: int, least: int) -> int:
    """Number of tasks for n_bytes of input at per_task bytes each."""
    return max(least, -(-int(n_bytes) // per_task))


def text_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes in one text column, over all rows."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0))).first()[0])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _with(edges: DataFrame, low: DataFrame, n_edges: int) -> DataFrame:
    """edges joined with low (a, m, deg) on a; nodes of many edges are looked up by broadcast, so none of them fills one task."""
    many = max(HUB, n_edges // HUB_SHARE)
    hubs = low.where(F.col("deg") > many).select(F.col("a").alias("hub"), F.col("m").alias("at_hub"))
    seen = edges.join(F.broadcast(hubs), F.col("a") == F.col("hub"), "left")
    hot = seen.where("hub is not null").select("a", "b", F.col("at_hub").alias("m"))
    cold = seen.where("hub is null").select("a", "b").join(low.where(F.col("deg") <= many).select("a", "m"), "a")
    return hot.union(cold.select("a", "b", "m"))


def _stars(edges: DataFrame) -> tuple[int, bool]:
    """(number of edges, whether each node points to one other node, and that to none)."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("from"), F.lit(0).alias("to")).union(edges.select("b", F.lit(0), F.lit(1)))
    each = ends.groupBy("node").agg(F.sum("from").alias("from"), F.max("to").alias("to"))
    n, bad = each.agg(F.coalesce(F.sum("from"), F.lit(0)), F.count_if(F.expr("`from` > 1 or (`from` = 1 and to = 1)"))).first()
    return int(n), bad == 0


def stars(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b): each node of undirected edges (a long, b long) but the smallest of its component points to that one; a written table.

    Alternates large-star and small-star steps until all is stars; each step is one grouped
    minimum and one join, and is written to the shared folder. The neighbours of a hub stay spread
    over the tasks (see `_with`). Self loops and nulls are dropped; nodes without edges are absent.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = materialise(edges.distinct(), "cc")
    for _ in range(max_rounds):
        n, done = _stars(now)
        if done:
            break
        # large star: each neighbour above u points to the smallest node around u
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("deg"))
        large = _with(both, low, n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = materialise(large.distinct(), "cc")
        # small star: what points down from u points to the smallest of it, u too
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("deg"))
        small = _with(large, least, n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        last, now = now, materialise(small.distinct(), "cc")
        discard(last, large)
    else:
        raise RuntimeError("connected components did not settle")
    return now


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a long, b long): (node, component), the smallest node that is reachable."""
    return of_stars(stars(edges))


def of_stars(now: DataFrame) -> DataFrame:
    """(node, component) of what stars returns."""
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)

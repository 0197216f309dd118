"""Trajectories: runs of equal ids, ordered steps, contiguity, rank factors, group shaping and lagged scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import scoring
from corpusmill.operators.places import placed
from corpusmill.sources.shared import materialise


def islands(df: DataFrame, id_: str, order: str, by: str | None = None) -> DataFrame:
    """W-01: a number for each run of consecutive rows with one id.

    Without `by` the whole table is one sequence: a window over all rows is a single task, so the
    sequence is cut by ranges of the order first, and run numbers are offset by what stands before.
    """
    if by is not None:
        w = W.partitionBy(by).orderBy(order)
        new = F.coalesce(~F.col(id_).eqNullSafe(F.lag(id_).over(w)) | (F.row_number().over(w) == 1), F.lit(True))
        return df.withColumn("__new", new.cast("int")).withColumn("island", F.sum("__new").over(w)).drop("__new")
    block = 1 << 16
    parts = df.withColumn("__part", F.floor(F.col(order) / block))
    w = W.partitionBy("__part").orderBy(order)
    cut = parts.withColumn("__new", (~F.col(id_).eqNullSafe(F.lag(id_).over(w)) & (F.row_number().over(w) > 1)).cast("int"))
    ends = parts.groupBy("__part").agg(F.min_by(id_, order).alias("f"), F.max_by(id_, order).alias("l"))
    runs = cut.groupBy("__part").agg(F.sum("__new").alias("s")).join(ends, "__part")
    e = W.orderBy("__part")  # one row for 65 536 of the order
    runs = runs.withColumn("__join", (~F.col("f").eqNullSafe(F.lag("l").over(e)) | (F.row_number().over(e) == 1)).cast("int"))
    runs = runs.withColumn("__off", F.sum(F.col("__join") + F.coalesce(F.lag("s").over(e), F.lit(0))).over(e.rowsBetween(W.unboundedPreceding, 0)))
    return cut.join(runs.select("__part", "__off"), "__part").withColumn("island", F.col("__off") + F.sum("__new").over(w)).drop("__part", "__new", "__off")


def ordered_steps(df: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """W-02, W-05: the steps of each trajectory in order."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("steps"))


def continuous(steps: Column, order: str) -> Column:
    """W-03: indices rise by one."""
    return F.forall(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(2)) - 1), lambda i: (F.size(steps) < 2) | (F.element_at(steps, i + 1)[order] == F.element_at(steps, i)[order] + 1))


def contiguous(df: DataFrame, key: str, order: str, before: str, after: str) -> DataFrame:
    """W-04: steps whose state before isn't the state after the step before."""
    w = W.partitionBy(key).orderBy(order)
    return df.withColumn("gap", F.row_number().over(w).__gt__(1) & ~F.col(before).eqNullSafe(F.lag(after).over(w)))


def top_each(df: DataFrame, group: str, n: int, *order: Column | str) -> DataFrame:
    """W-06, A-51: the first n of each group."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)


def tie_rank_factor(value: str, group: str, beta: float) -> Column:
    """W-07: descending ranks from 0, ties averaged; values that aren't finite are neutral and uncounted."""
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf"))
    x = F.when(finite, F.col(value))
    w = W.partitionBy(group)
    n = F.count(x).over(w)
    rank = F.rank().over(w.orderBy(x.desc_nulls_last())) - 1 + (F.count(x).over(W.partitionBy(group, x)) - 1) / 2
    return F.when(finite, 1.0 - beta * (n - rank) / n).otherwise(1.0)


def index_rank_factor(value: str, index: str, group: str, beta: float) -> Column:
    """W-08: the same, ties by index."""
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf"))
    x = F.when(finite, F.col(value))
    w = W.partitionBy(group)
    rank = F.row_number().over(w.orderBy(x.desc_nulls_last(), index)) - 1
    n = F.count(x).over(w)
    return F.when(finite, 1.0 - beta * (n - rank) / n).otherwise(1.0)


def centred(reward: Column, group: str) -> Column:
    """W-09: less the mean of the group."""
    return reward - F.avg(reward).over(W.partitionBy(group))


def shaped(success: Column, successes: Column, attempts: Column, factor: Column, group: str) -> Column:
    """W-10: weight x mass x factor for a success, nothing for a failure, less the mean of the group."""
    value = F.when(success, scoring.difficulty_weight(successes, attempts) * scoring.mass_scale(attempts) * factor).otherwise(0.0)
    return centred(value, group)


def lagged_scale(df: DataFrame, group: str, value: str, per_window: int = 16, decay: float = 0.9, initial: float = 0.5, epsilon: float = 1e-4) -> DataFrame:
    """W-11, T-07 in batch: window w is scaled by an average of the root mean squares of the windows before it.

    A window is so many groups, counted as they come in the order of their ids; only the last one can be short.
    A window takes the scale s to decay s + (1 - decay) rms, or leaves it if it is short; BLOCK windows together
    take it to p s + q. So blocks are folded side by side, their (p, q), one row each, in order, and then each
    block once more from the scale it begins with.
    """
    each = df.groupBy(group).agg(F.sum(F.col(value) * F.col(value)).alias("squares"), F.count("*").alias("n"))
    sums = placed(each, group).groupBy(F.floor((F.col("place") - 1) / per_window).alias("window_id")).agg(
        F.greatest(F.sqrt(F.sum("squares") / F.sum("n")), F.lit(epsilon)).alias("rms"), F.count("*").alias("groups")
    )
    blocks = sums.groupBy(F.floor(F.col("window_id") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("window_id", "rms", "groups"))).alias("w"))
    blocks = materialise(blocks, "windows")
    step = lambda s, y: F.when(y["groups"] < per_window, s).otherwise(decay * s + (1 - decay) * y["rms"])
    through = lambda s0, scale: F.aggregate("w", F.lit(s0), lambda s, y: F.when(y["groups"] < per_window, s).otherwise(decay * s + (scale * y["rms"])))
    scale, starts = initial, []
    for r in blocks.select("block", through(1.0, 0.0).alias("p"), through(0.0, 1 - decay).alias("q")).orderBy("block").toLocalIterator():
        starts.append((r["block"], float(scale)))
        scale = r["p"] * scale + r["q"]
    begin = df.sparkSession.createDataFrame(starts, "block long, start double")
    kind = "array<struct<window_id:bigint,scale:double,rms:double>>"
    first = F.struct(F.col("start").alias("s"), F.array().cast(kind).alias("out"))
    carried = F.aggregate(
        "w", first,
        lambda a, y: F.struct(step(a["s"], y).alias("s"), F.concat(a["out"], F.array(F.struct(y["window_id"].alias("window_id"), a["s"].alias("scale"), y["rms"].alias("rms")))).alias("out")),
        lambda a: a["out"],
    )
    return blocks.join(F.broadcast(begin), "block").select(F.explode(carried).alias("x")).select("x.*")


#: Windows that are folded together.
BLOCK = 512

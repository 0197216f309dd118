"""Places of rows in an order, found without sorting a whole table, or a whole group, in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.sources.shared import materialise

#: Ranges into which the numbers of a group, or the rows of a table, are cut.
RANGES = 256


def numbered(df: DataFrame, group: str, number: str, name: str) -> DataFrame:
    """0-based place of each row of a group in the order of a whole number, as `name`.

    The number's range is cut into RANGES equal parts; a part of a group is numbered by itself, after
    the rows of the parts before it, so a group with a third of all rows is spread over many tasks.
    """
    low, high = df.agg(F.min(number), F.max(number)).first()
    width = max(1, math.ceil((high - low + 1) / RANGES)) if low is not None else 1
    cut = df.withColumn("__part", F.floor((F.col(number) - F.lit(low)) / width).cast("int"))
    counts = cut.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("__group"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = cut.withColumn("__row", F.row_number().over(W.partitionBy(group, "__part").orderBy(number)) - 1)
    on = F.col(group).eqNullSafe(F.col("__group")) & F.col("__part").eqNullSafe(F.col("__p"))
    return placed.join(starts, on).withColumn(name, F.col("__row") + F.col("__start")).drop("__part", "__row", "__group", "__p", "__start")


def _ranged(df: DataFrame, order: tuple[Column | str, ...], value: Column) -> tuple[DataFrame, DataFrame]:
    """(rows in ranges of the order, written, with __part; __p, __start: the sum of value over the ranges before each)."""
    spark = df.sparkSession
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).withColumn("__part", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    sums = sorted((r["__part"], r["__n"]) for r in ranged.groupBy("__part").agg(F.sum(value).alias("__n")).collect())  # one row for each range
    starts, start = [], 0
    for part, n in sums:
        starts.append((part, float(start)))
        start += n
    return ranged, F.broadcast(spark.createDataFrame(starts, "__p int, __start double"))


def placed(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """1-based place of each row in an order over the whole table, as `name`.

    Rows are dealt by ranges of the order and written; each range is numbered after the rows of those
    before it. The counts of the ranges, one row for each, are all that meets in one task.
    """
    ranged, starts = _ranged(df, order, F.lit(1))
    rows = ranged.withColumn("__row", F.row_number().over(W.partitionBy("__part").orderBy(*order)))
    return rows.join(starts, F.col("__part") == F.col("__p")).withColumn(name, (F.col("__row") + F.col("__start")).cast("long")).drop("__part", "__row", "__p", "__start")


def running_sum(df: DataFrame, value: str, *order: Column | str, name: str = "running") -> DataFrame:
    """Sum of value over a row and all before it in an order over the whole table, as `name`."""
    ranged, starts = _ranged(df, order, F.col(value))
    rows = ranged.withColumn("__row", F.sum(value).over(W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    return rows.join(starts, F.col("__part") == F.col("__p")).withColumn(name, F.col("__row") + F.col("__start")).drop("__part", "__row", "__p", "__start")

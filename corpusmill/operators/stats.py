"""The four percentile rules, and length statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.shared import materialise


def _at(values: Column, index: Column) -> Column:
    last = F.size(values) - 1
    return F.element_at(values, (F.least(F.greatest(index, F.lit(0)), last) + 1).cast("int"))


def half_even(values: Column, q: float) -> Column:
    """A-40: of sorted values, the one at (n - 1) q rounded half to even."""
    return _at(values, F.bround((F.size(values) - 1) * F.lit(q), 0).cast("int"))


def floor(values: Column, q: float) -> Column:
    """A-41: at the whole part of (n - 1) q."""
    return _at(values, F.floor((F.size(values) - 1) * F.lit(q)).cast("int"))


def ceil(values: Column, q: float) -> Column:
    """A-42: at q n rounded up, less one."""
    return _at(values, (F.ceil(F.lit(q) * F.size(values)) - 1).cast("int"))


def ranked_percentiles(df: DataFrame, column: str, qs: Sequence[float]) -> DataFrame:
    """All four rules at each q, from counts of distinct values: no task and no driver sees all rows.

    One row for each q: half_even, floor, ceil, and for q = 0.5 the median.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    counts = materialise(counts, "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return df.sparkSession.createDataFrame([], "q double, half_even double, floor double, ceil double, median double")
    import math

    wanted = {}
    for q in qs:
        x = (total - 1) * q
        wanted[q] = [round(x), int(x), max(0, min(total - 1, math.ceil(q * total) - 1))]
    middle = [(total - 1) // 2, total // 2]
    ranks = sorted({r for v in wanted.values() for r in v} | set(middle))
    found = dict(_values_at(counts, ranks))
    rows = [(q, *(float(found[r]) for r in v), (found[middle[0]] + found[middle[1]]) / 2 if q == 0.5 else None) for q, v in wanted.items()]
    return df.sparkSession.createDataFrame(rows, "q double, half_even double, floor double, ceil double, median double")


def _values_at(counts: DataFrame, ranks: list[int]) -> list[tuple[int, float]]:
    """Values at 0-based ranks: bins of the value range are narrowed round by round, with bounded results; one job a round."""
    low, high = counts.agg(F.min("v"), F.max("v")).first()
    spans = {r: (float(low), float(high), 0) for r in ranks}  # value range, rows before it; open ranges are equal or apart
    bins = 256
    while True:
        open_ = sorted({s for s in spans.values() if s[0] < s[1]})
        if not open_:
            return [(r, s[0]) for r, s in spans.items()]
        slots = []
        for i, (lo, hi, _) in enumerate(open_):
            width = (hi - lo) / bins
            slot = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
            slots.append(F.when(F.col("v").between(lo, hi), F.struct(F.lit(i).alias("i"), slot.cast("long").alias("b"))))
        got = counts.withColumn("at", F.coalesce(*slots)).where("at is not null").groupBy("at").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        parts = {s: sorted((r for r in got if r["at"]["i"] == i), key=lambda r: r["at"]["b"]) for i, s in enumerate(open_)}
        for r, s in spans.items():
            if s[0] < s[1]:
                before = s[2]
                for x in parts[s]:
                    if r < before + x["n"]:
                        spans[r] = (float(x["lo"]), float(x["hi"]), before)
                        break
                    before += x["n"]


def length_summary(df: DataFrame, column: str, limit: int) -> DataFrame:
    """A-44, A-45: count, mean, extremes and the share over a limit."""
    return df.agg(
        F.count(column).alias("rows"), F.avg(column).alias("mean"), F.min(column).alias("shortest"), F.max(column).alias("longest"),
        F.count_if(F.col(column) > limit).alias("over_limit"), (F.count_if(F.col(column) > limit) / F.count(column)).alias("over_ratio"),
    )

"""Deterministic selection, sampling, quotas, budgets, shards and schedules in hash order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import hashing, scoring
from corpusmill.operators.places import placed, running_sum


def place(*order: Column | str, by: Sequence[str]) -> Column:
    """1-based place in an order within groups; over a whole table see places.placed."""
    return F.row_number().over(W.partitionBy(*by).orderBy(*order))


def hash_head(df: DataFrame, seed: int, id_: str, n: int) -> DataFrame:
    """O-01, O-04, O-05: n rows in hash order (Spark keeps the n best of each task only)."""
    return df.orderBy(hashing.order_key(seed, F.col(id_)), id_).limit(n)


def split(df: DataFrame, seed: int, id_: str, ratio: float) -> DataFrame:
    """O-06: a validation flag for clamp(round(n ratio), 1, n - 1) ids by hash order; rows of one id go together.

    The cut is found from counts of hash prefixes, then of the one prefix it falls in, so no task sorts all ids.
    """
    key = hashing.order_key(seed, F.col(id_))
    keyed = df.withColumn("__key", key)
    ids = keyed.select("__key").distinct()
    n = ids.count()
    want = min(max(round(n * ratio), 1), n - 1) if n > 1 else 0
    prefix, before = "", 0
    while want and len(prefix) < 64:
        under = ids.where(F.col("__key").startswith(prefix))
        step = 4 if len(prefix) + 4 <= 64 else 64 - len(prefix)
        got = sorted((r["p"], r["count"]) for r in under.groupBy(F.left("__key", F.lit(len(prefix) + step)).alias("p")).count().collect())
        for p, c in got:
            if before + c >= want:
                prefix = p
                break
            before += c
        if before + c == want:
            break
    return keyed.withColumn("validation", F.left("__key", F.lit(max(1, len(prefix)))) <= F.lit(prefix) if want else F.lit(False)).drop("__key")


def quotas(df: DataFrame, stratum: str, wanted: dict[str, int], *order: Column | str) -> DataFrame:
    """O-08, O-14: the first rows of each stratum up to its quota."""
    quota = F.coalesce(*(F.when(F.col(stratum) == k, v) for k, v in wanted.items()), F.lit(0))
    return df.withColumn("place", place(*order, by=[stratum])).where(F.col("place") <= quota)


def quota_fill(df: DataFrame, stratum: str, wanted: dict[str, int], slots: int, seed: int, id_: str) -> DataFrame:
    """O-08: quotas, then the rest of the slots by stratum and a second hash order."""
    rank = F.coalesce(*(F.when(F.col(stratum) == k, i) for i, k in enumerate(wanted)), F.lit(len(wanted)))
    first = quotas(df, stratum, wanted, hashing.order_key(seed, F.col(stratum), F.col(id_)), id_).drop("place")
    left = slots - first.count()
    rest = df.join(first.select(id_), id_, "left_anti").orderBy(rank, hashing.order_key(seed, F.lit("remainder"), F.col(id_)), id_).limit(max(0, left))
    return first.unionByName(rest)


def budget(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """O-07: the best n, and the others as deferred."""
    return placed(df, *order).withColumn("state", F.when(F.col("place") <= n, "selected").otherwise("deferred"))


def schedule(df: DataFrame, steps: int, *order: Column | str) -> DataFrame:
    """O-09: place p goes to step p mod steps, slot p div steps."""
    p = F.col("__place") - 1
    return placed(df, *order, name="__place").withColumn("step_index", (p % steps).cast("int")).withColumn("slot_index", F.floor(p / steps).cast("int")).drop("__place")


def repeats(df: DataFrame, total: int, seed: int, id_: str) -> DataFrame:
    """O-16: repeats that sum up to the budget: the quotient for all, one more for the first remainder in hash order."""
    n = df.count()
    q, r = divmod(total, n) if n else (0, 0)
    return placed(df, hashing.order_key(seed, F.col(id_)), id_, name="__place").withColumn("repeat", F.lit(q) + (F.col("__place") <= r).cast("int")).drop("__place")


def modulo_shards(df: DataFrame, index: str, n: int) -> DataFrame:
    """O-17."""
    return df.withColumn("shard", F.col(index) % n).withColumn("within", F.floor(F.col(index) / n))


def windows(df: DataFrame, depth: int, *order: Column | str) -> DataFrame:
    """O-19: bounded windows over an order."""
    return placed(df, *order, name="__place").withColumn("window_id", F.floor((F.col("__place") - 1) / depth)).drop("__place")


def diverse(df: DataFrame, body: str, seed: int, id_: str, n: int) -> DataFrame:
    """O-22: distinct bodies first, then the rest, both in hash order."""
    key = hashing.order_key(seed, F.col(id_))
    return df.withColumn("again", place(key, id_, by=[body]) > 1).orderBy("again", key, id_).limit(n)


def balanced(df: DataFrame, body: str, signature: str, cap: int, n: int, seed: int, id_: str) -> DataFrame:
    """O-23: at most cap rows of a body, round-robin over signatures."""
    key = hashing.order_key(seed, F.col(id_))
    few = df.withColumn("nth", place(key, id_, by=[body])).where(F.col("nth") <= cap)
    return few.withColumn("turn", place(key, id_, by=[signature])).orderBy("turn", signature, id_).limit(n)


def ranges(df: DataFrame, sizes: dict[str, int], seed: int, id_: str) -> DataFrame:
    """O-24: consecutive ranges of the hash order as roles."""
    low, role = 0, F.lit(None).cast("string")
    for name, size in sizes.items():
        role = F.when((F.col("__place") > low) & (F.col("__place") <= low + size), name).otherwise(role)
        low += size
    return placed(df, hashing.order_key(seed, F.col(id_)), id_, name="__place").withColumn("role", role).drop("__place")


def topup(df: DataFrame, seed: int, id_: str, n: int) -> DataFrame:
    """O-13: the n rows (hs, ha: successes and attempts so far) of highest posterior priority; those with a success first, then in hash order."""
    priority = F.round(scoring.rollout_priority(F.col("hs"), F.col("ha")), 7)
    return df.withColumn("priority", priority).orderBy(F.desc("priority"), F.desc(F.col("hs") > 0), hashing.order_key(seed, F.col(id_)), id_).limit(n)


def weighted_draws(df: DataFrame, weight: str, seed: int, draws: int) -> DataFrame:
    """O-25: draws with replacement by weight: hash-uniform points joined to cumulative ranges, dealt by bins of the range.

    Weights that are not finite and above zero are an error.
    """
    w = F.col(weight).cast("double")
    bad = df.where(w.isNull() | F.isnan(w) | (w <= 0) | (w == float("inf"))).count()
    if bad:
        raise ValueError(f"{bad} weights are not finite and above zero")
    total = df.agg(F.sum(w)).first()[0]
    if total is None:
        return df.sparkSession.createDataFrame([], "draw long").join(df.select("id"), F.lit(False))
    cum = running_sum(df, weight, "id", name="__high").withColumn("low", (F.col("__high") - w) / total).withColumn("high", F.col("__high") / total)
    cum = cum.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") * 1024), F.least(F.floor(F.col("high") * 1024), F.lit(1023)))))
    u = F.conv(F.left(hashing.order_key(seed, F.col("draw")), F.lit(12)), 16, 10).cast("double") / float(16**12)
    points = df.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("u", u).withColumn("bin", F.floor(F.col("u") * 1024))
    return points.join(cum, "bin").where("u >= low and u < high").select("draw", "id")


def greedy_budget(df: DataFrame, targets: dict[int, int]) -> DataFrame:
    """O-21: (source_rank, id, theorem_group_id, tokens) rows picked for each source's target of tokens.

    Each pick is the row that brings the sum closest to the target, ties by id as text, of a theorem group
    that no pick of this or an earlier source has; the first pick that would come no closer ends a source.
    Rows of one group and source that differ are all candidates until one of them is picked.

    While what is left is larger than every row, the closest row is the largest; after that it is the
    one next to what is left. So each source is read in slices of descending tokens, at most `_SLICE`
    rows at once, and only the picks are held.
    """
    spark = df.sparkSession
    picked: list[tuple[int, str]] = []
    groups: set[str] = set()
    rows = df.select("source_rank", F.col("id").cast("string").alias("id"), F.col("theorem_group_id").cast("string").alias("g"), F.col("tokens").cast("long").alias("tokens"))
    for source, target in sorted(targets.items()):
        own, running = rows.where(F.col("source_rank") == source), 0
        while running < target:
            left = target - running
            free_rows = own
            if groups:
                free_rows = own.join(F.broadcast(spark.createDataFrame([(g,) for g in groups], "g string")), "g", "left_anti")
            near = free_rows.withColumn("gap", F.abs(F.lit(left) - F.col("tokens"))).orderBy("gap", "id").limit(_SLICE).collect()
            if not near:
                break
            done = False
            # rows of one gap order stay the closest while what is left moves by whole picks of larger rows only
            largest = near[0].tokens <= left and all(r.tokens <= left for r in near)
            for r in near:
                left = target - running
                if r.g in groups:
                    continue
                if r is not near[0] and not (largest and r.tokens <= left):
                    break
                if running and abs(left) <= abs(left - r.tokens):
                    done = True
                    break
                picked.append((source, r.id))
                groups.add(r.g)
                running += r.tokens
                if running >= target:
                    break
            if done:
                break
    chosen = spark.createDataFrame(picked, "source_rank int, chosen string")
    return df.join(F.broadcast(chosen), (df["source_rank"] == chosen["source_rank"]) & (df["id"].cast("string") == chosen["chosen"]), "left_semi")


#: Rows of a source that greedy_budget looks at in one job.
_SLICE = 2000

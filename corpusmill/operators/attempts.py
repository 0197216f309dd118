"""Analytics over attempt logs: one row for each (problem_id, attempt_index), with success and what went wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import hashing, scoring

#: Indices of a bootstrap that one row stands for, and about how many a task draws.
BLOCK, TASK = 1 << 16, 1 << 22


def by_problem():
    return W.partitionBy("problem_id")



def problem_summary(attempts: DataFrame) -> DataFrame:
    """A-19: attempts, successes, rate and the attempts in order."""
    return attempts.groupBy("problem_id").agg(
        F.count("*").alias("attempts"),
        F.count_if("success").alias("successes"),
        (F.count_if("success") / F.count("*")).alias("success_rate"),
        F.array_sort(F.collect_list(F.struct("attempt_index", "success"))).alias("ordered"),
    )


def pass_at_k(attempts: DataFrame, ks: Sequence[int] = scoring.K_VALUES) -> DataFrame:
    """A-20 and A-21: of all problems, solved within the first k recorded attempts, and the unbiased estimate."""
    first = attempts.withColumn("place", F.row_number().over(by_problem().orderBy("attempt_index")))
    each = first.groupBy("problem_id").agg(
        F.count("*").alias("n"), F.count_if("success").alias("c"), F.min(F.when(F.col("success"), F.col("place"))).alias("hit")
    )
    out = each.select(
        F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(F.col("hit") <= k, F.lit(False)).alias("solved"), scoring.unbiased_pass(F.col("n"), F.col("c"), k).alias("u")) for k in ks))).alias("x")
    ).select("x.*")
    return out.groupBy("k").agg(
        F.count("*").alias("problems"), F.count_if("solved").alias("prefix_solved"), F.avg(F.col("solved").cast("double")).alias("prefix_rate"), F.avg("u").alias("unbiased_rate")
    )


def success_histogram(attempts: DataFrame, k: int) -> DataFrame:
    """A-22: problems by successes of k, zero-filled."""
    each = attempts.groupBy("problem_id").agg(F.count_if("success").alias("successes")).groupBy("successes").agg(F.count("*").alias("n"))
    bins = attempts.sparkSession.range(k + 1).withColumnRenamed("id", "successes")
    return bins.join(each, "successes", "left").select(F.concat(F.col("successes"), F.lit(f"/{k}")).alias("bin"), F.coalesce("n", F.lit(0)).alias("problems"))


def flattened(attempts: DataFrame) -> DataFrame:
    """A-24: attempts with the rates of their problem."""
    return attempts.select(
        "problem_id", "attempt_index", "success",
        F.count_if("success").over(by_problem()).alias("problem_successes"), F.count("*").over(by_problem()).alias("problem_attempts"),
        (F.count_if("success").over(by_problem()) / F.count("*").over(by_problem())).alias("problem_rate"),
    )


def diversity(attempts: DataFrame, proof: str) -> DataFrame:
    """A-27: repeats within a problem, pair collisions, unique proofs; one row."""
    n = attempts.groupBy("problem_id", proof).count()
    each = n.groupBy("problem_id").agg(F.sum("count").alias("a"), F.count("*").alias("u"), F.sum(F.expr("count * (count - 1) / 2")).alias("same"))
    unique = n.select(proof).distinct().agg(F.count("*").alias("global_unique"))
    return each.agg(
        F.sum(F.col("a") - F.col("u")).alias("duplicate_attempts"),
        (F.sum("same") / F.sum(F.expr("a * (a - 1) / 2"))).alias("pair_collision_rate"),
        F.count_if(F.col("u") == 1).alias("all_identical"),
        F.avg("u").alias("mean_unique"),
    ).crossJoin(unique)  # one row each


def mcnemar(discordant_a: Column, discordant_b: Column) -> Column:
    """A-32: exact two-sided p; the tail is summed from its largest term down, so nothing over- or underflows early."""
    n, k = discordant_a + discordant_b, F.least(discordant_a, discordant_b)
    start = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.lit(0.0).alias("total"))
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k.cast("long")), start,
        lambda a, i: F.struct((a["term"] * (n - i) / (i + 1)).alias("term"), (a["total"] + a["term"]).alias("total")),
        lambda a: a["total"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def paired_counts(x: Column, y: Column) -> list[Column]:
    """What `paired` counts over rows in which x and y say whether either model solved a problem."""
    return [
        F.count("*").alias("problems"), F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_left"),
        F.count_if(~x & y).alias("only_right"), F.count_if(~x & ~y).alias("neither"),
    ]


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """J-22, A-31, A-32: (problem_id, solved) of two models on the same problems; one row."""
    both = left.select("problem_id", F.col("solved").alias("x")).join(right.select("problem_id", F.col("solved").alias("y")), "problem_id")
    out = both.agg(*paired_counts(F.col("x"), F.col("y")))
    return out.withColumn("delta", (F.col("only_right") - F.col("only_left")) / F.col("problems")).withColumn("p_value", mcnemar(F.col("only_left"), F.col("only_right")))


def bootstrap(values: DataFrame, seed: int, draws: int) -> DataFrame:
    """A-33: (row 0..n-1, value) resampled by hash-derived index; mean of each draw.

    Draws are dealt over the rows by an equality join on the drawn index, so the work is draws x n rows and no cross product of the values.
    """
    n = values.agg(F.max("row") + 1).first()[0] or 0
    picks = values.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))) if n else None
    if picks is None:
        return values.sparkSession.createDataFrame([], "draw long, mean double")
    at = F.conv(F.left(hashing.order_key(seed, F.col("draw"), F.col("i")), F.lit(8)), 16, 10).cast("long") % n
    return picks.withColumn("row", at).join(values, "row").groupBy("draw").agg(F.avg("value").alias("mean"))


def paired_interval(left: DataFrame, right: DataFrame, seed: int, draws: int = 10_000, level: float = 0.95) -> DataFrame:
    """A-33: (problem_id, solved) of two models: mean difference right - left, and the bootstrap interval of it over all draws; one row."""
    both = left.select("problem_id", F.col("solved").alias("x")).join(right.select("problem_id", F.col("solved").alias("y")), "problem_id")
    return paired_intervals(both, {0: (F.col("x"), F.col("y"))}, seed, draws, level).drop("k")


def paired_intervals(both: DataFrame, pairs: dict[int, tuple[Column, Column]], seed: int, draws: int = 10_000, level: float = 0.95) -> DataFrame:
    """A-33 for several comparisons k over the same problems, one row of `both` each: the intervals of y - x; one row for each k.

    A difference is -1, 0 or 1, so problems are numbered by their difference and three counts say what a drawn index is worth; no row is joined.
    All comparisons take the same indices, so each is drawn once.
    """
    counts = both.agg(*(F.struct(*paired_counts(x, y)).alias(str(k)) for k, (x, y) in pairs.items())).first().asDict()
    n, spark = next(iter(counts.values())).problems, both.sparkSession
    if not n:
        return spark.createDataFrame([(k, 0, None, None, None) for k in pairs], "k int, problems long, delta double, low double, high double")
    # rows of at most BLOCK indices, in tasks of about TASK of them
    row = -(-n // BLOCK)
    tasks = max(4 * spark.sparkContext.defaultParallelism, draws * n // TASK)
    blocks = spark.range(0, draws * row, 1, min(tasks, draws * row)).select(F.floor(F.col("id") / row).alias("draw"), (F.col("id") % row * BLOCK).alias("first"))
    picks = blocks.select("draw", F.explode(F.sequence("first", F.least(F.col("first") + (BLOCK - 1), F.lit(n - 1)))).alias("i"))
    picks = picks.select("draw", (F.conv(F.left(hashing.order_key(seed, F.col("draw"), F.col("i")), F.lit(8)), 16, 10).cast("long") % n).alias("at"))
    worth = lambda c: F.when(F.col("at") < c.only_left, -1).when(F.col("at") < c.only_left + c.only_right, 1).otherwise(0)
    sums = picks.groupBy("draw").agg(*(F.sum(worth(c)).alias(k) for k, c in counts.items())).agg(*(F.sort_array(F.collect_list(k)).alias(k) for k in counts))
    tail = round((1 - level) / 2, 12)
    place = lambda k, q: F.element_at(F.col(k), int(q * (draws - 1)) + 1) / F.lit(n)
    delta = lambda c: F.lit((c.only_right - c.only_left) / n)
    each = (F.struct(F.lit(int(k)).alias("k"), F.lit(n).cast("long").alias("problems"), delta(c).alias("delta"), place(k, tail).alias("low"), place(k, 1 - tail).alias("high")) for k, c in counts.items())
    return sums.select(F.inline(F.array(*each)))


def resume_work(problems: DataFrame, k: int, done: DataFrame) -> DataFrame:
    """J-14: (problem_id, attempt_index) still to do."""
    grid = problems.select("problem_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("attempt_index"))
    return grid.join(done.select("problem_id", "attempt_index"), ["problem_id", "attempt_index"], "left_anti")


def canceled_after_success(attempts: DataFrame, arrival: str) -> DataFrame:
    """T-03 in batch: attempts that arrive after a success of their problem."""
    before = by_problem().orderBy(arrival).rowsBetween(W.unboundedPreceding, -1)
    return attempts.withColumn("canceled", F.coalesce(F.max("success").over(before), F.lit(False)))


def complete(attempts: DataFrame, k: int) -> DataFrame:
    """V-18: problems whose attempts aren't exactly 0 to k - 1."""
    got = attempts.groupBy("problem_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("attempt_index")).alias("seen"))
    return got.where(~((F.col("n") == k) & (F.col("seen") == F.sequence(F.lit(0), F.lit(k - 1))))).select("problem_id", "n")


def routes(attempts: DataFrame) -> DataFrame:
    """F-37 over attempts: first-eight and all successes, and the route of each problem."""
    place = F.row_number().over(by_problem().orderBy("attempt_index"))
    each = attempts.withColumn("place", place).groupBy("problem_id").agg(
        F.count_if(F.expr("success and place <= 8")).alias("initial"), F.count_if("success").alias("total"), F.count("*").alias("attempts")
    )
    return each.withColumn("route", scoring.screen_route(F.col("initial"), F.col("total"), F.col("attempts")))


def staged(receipts: dict[str, DataFrame], stages: Sequence[tuple[str, int, int]]) -> DataFrame:
    """U-01: the receipts of all stages (name, offset, attempts a problem), numbered on from stage to stage; the number within the stage stays as source_attempt_index."""
    out = None
    for name, offset, _ in stages:
        part = receipts[name].withColumns({"source_attempt_index": F.col("attempt_index"), "stage": F.lit(name)}).withColumn("attempt_index", (F.col("attempt_index") + offset).cast("int"))
        out = part if out is None else out.unionByName(part)
    return out


def stage_violations(merged: DataFrame, stages: Sequence[tuple[str, int, int]]) -> DataFrame:
    """U-01: (problem_id, attempt_index, stage, reason) of what `staged` may not hold: numbers outside a stage, attempts there twice, problems with too few or many."""
    wanted = F.create_map(*(F.lit(x) for name, _, n in stages for x in (name, n)))[F.col("stage")]
    row = lambda df, index, reason: df.select("problem_id", index.cast("int").alias("attempt_index"), "stage", F.lit(reason).alias("reason"))
    outside = row(merged.where((F.col("source_attempt_index") < 0) | (F.col("source_attempt_index") >= wanted) | F.col("source_attempt_index").isNull()), F.col("attempt_index"), "invalid local attempt")
    twice = merged.groupBy("problem_id", "attempt_index").agg(F.count("*").alias("n"), F.min("stage").alias("stage")).where("n > 1")
    counts = merged.groupBy("problem_id", "stage").agg(F.count("*").alias("n")).where(F.col("n") != wanted)
    return outside.unionByName(row(twice, F.col("attempt_index"), "duplicate merged attempt")).unionByName(row(counts, F.lit(None), "incomplete per-problem attempt set"))

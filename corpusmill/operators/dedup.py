"""Order-aware deduplication, identity repair, canonical choice and overlap audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """A-01, A-03: the rows with a flag for the first of each key; null is a key like any other."""
    return df.withColumn("kept", F.row_number().over(W.partitionBy(*keys).orderBy(order)) == 1)


def pointer(df: DataFrame, keys: Sequence[str], order: str, id_: str) -> DataFrame:
    """A-04: each row with the id of the survivor of its key; null for the survivor itself."""
    w = W.partitionBy(*keys).orderBy(order)
    first = F.first(id_).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("duplicate_of", F.when(F.row_number().over(w) > 1, first))


def disambiguate(df: DataFrame, id_: str, order: str, *keys: str) -> DataFrame:
    """A-02: a repeated id gets 12 hex digits of its content key; equal results a running number."""
    again = F.row_number().over(W.partitionBy(id_).orderBy(order)) > 1
    digest = F.left(F.sha2(F.concat_ws("\x00", *(F.col(k).cast("string") for k in keys)), 256), F.lit(12))
    named = df.withColumn("__id", F.when(again, F.concat(F.col(id_), F.lit("::"), digest)).otherwise(F.col(id_)))
    n = F.row_number().over(W.partitionBy("__id").orderBy(order))
    return named.withColumn("unique_id", F.when(n > 1, F.concat(F.col("__id"), F.lit("-"), n)).otherwise(F.col("__id"))).drop("__id")


def duplicate_groups(df: DataFrame, levels: dict[int, Sequence[str]], id_: str) -> DataFrame:
    """A-05: groups of two or more for each level's key, with their ids in order."""
    out = None
    for level, keys in levels.items():
        groups = df.groupBy(*keys).agg(F.count("*").alias("record_count"), F.array_join(F.array_sort(F.collect_list(F.col(id_))), ",").alias("record_ids"))
        groups = groups.where("record_count >= 2").select(F.lit(level).alias("level"), "record_count", "record_ids")
        out = groups if out is None else out.unionByName(groups)
    return out


def canonical(df: DataFrame, keys: Sequence[str], scores: Sequence[Column], id_: str) -> DataFrame:
    """A-06: rank 1 of each key is canonical: highest scores, then the largest id."""
    order = [s.desc() for s in scores] + [F.col(id_).desc()]
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def variants(df: DataFrame, key: str, value: str, least: int = 2) -> DataFrame:
    """A-07, A-08: keys with several values."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("variants"), F.count("*").alias("rows")).where(F.col("variants") >= least)


def overlap(left: DataFrame, right: DataFrame, key: str, id_: str) -> DataFrame:
    """J-03: keys on both sides with the ids of each side."""
    side = lambda df, name: df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(id_)), ",").alias(name))
    return side(left, "left_ids").join(side(right, "right_ids"), key)


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """V-09: keys that aren't unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def cross_source_statistics(left: DataFrame, right: DataFrame) -> DataFrame:
    """A-10: rows of left (pair, statement, proof) whose pair, whose statement, and whose proof under another statement, right has too."""
    has = lambda *keys: right.select(*keys).distinct()
    proofs = right.groupBy("proof").agg(F.min("statement").alias("low"), F.max("statement").alias("high"))
    out = left.join(has("pair").withColumn("e", F.lit(True)), "pair", "left").join(has("statement").withColumn("s", F.lit(True)), "statement", "left").join(proofs, "proof", "left")
    return out.agg(
        F.count_if("e").alias("exact_duplicate_records"), F.count_if("s").alias("theorem_overlap_records"),
        F.count_if((F.col("low") != F.col("statement")) | (F.col("high") != F.col("statement"))).alias("same_proof_different_statement_records"),
    )


def homogeneity(df: DataFrame, proof: str) -> DataFrame:
    """A-14: how much of a manifest its most frequent proofs cover."""
    f = df.groupBy(proof).agg(F.count("*").alias("n"))
    top = lambda k: f.orderBy(F.desc("n"), proof).limit(k).agg(F.sum("n").alias(f"top{k}"))
    all_ = f.agg(F.sum("n").alias("rows"), F.count("*").alias("unique_proofs"), F.sum(F.col("n") - 1).alias("duplicates"))
    one = all_.withColumn("key", F.lit(1)).join(top(10).withColumn("key", F.lit(1)), "key").join(top(50).withColumn("key", F.lit(1)), "key")  # a row each
    share = lambda c: F.round(F.col(c) / F.greatest(F.col("rows"), F.lit(1)), 9)
    return one.select("rows", "unique_proofs", "duplicates", share("duplicates").alias("duplicate_ratio"), share("top10").alias("top10_coverage"), share("top50").alias("top50_coverage"))


def success_counts(generations: DataFrame, verifications: DataFrame, per_id: int) -> DataFrame:
    """A-35: successes of each statement over its verified generations, and whether there are exactly so many of them."""
    return verifications.join(generations, "generation_id").groupBy("statement_id").agg(F.count_if("verified").alias("successes"), (F.count("*") == per_id).alias("covered"))

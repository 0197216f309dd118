"""The registered queries for the reference's operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans import attempts_q, contexts_q, corpus_q, io_q, layers_q, records_q, rules_q, select_q, whole_q  # noqa: F401
from corpusmill.plans.registry import QUERIES, SQL, Query


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["pass_at_k"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL

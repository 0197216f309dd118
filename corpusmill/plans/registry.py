"""Where queries and their SQL are noted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.places import numbered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Attempts at one problem, and how far apart the numbers of a user's problems are.
K, PROBLEMS = 32, 1_000_000_000


class Tables:
    """The driver's tables by name, and the views that the operators are bound to."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def attempts(self) -> DataFrame:
        """All events as attempts: of each user 32 in a row at one problem, the next 32 at that user's next."""
        placed = numbered(self.events, "user_id", "event_id", "place")
        return placed.select(
            (F.col("user_id") + F.floor(F.col("place") / K) * PROBLEMS).alias("problem_id"), (F.col("place") % K).cast("int").alias("attempt_index"),
            "event_id", "event_type", "value", "ts",
            (F.col("event_type") == "purchase").alias("success"),
            ((F.col("event_type") == "error") & (F.col("value") > 100)).alias("timed_out"),
            diagnostics(F.col("event_type")).alias("diagnostics"),
            F.concat(F.col("event_type"), F.floor(F.col("value") / 40).cast("string")).alias("proof"),
        )


#: What an attempt's compiler might have said, by the type of its event.
DIAGNOSTICS = {
    "view": "error: unknown identifier 'foo.bar'",
    "click": "error: type mismatch, term has type Nat but is expected to have type Int",
    "signup": "error: linarith failed to find a contradiction",
    "error": "error: unexpected token ':='; expected command",
}


def diagnostics(c):
    out = F.lit("")
    for k, v in DIAGNOSTICS.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in DIAGNOSTICS.items()) + " ELSE '' END"
ATT = f"""att AS (
  SELECT user_id + (place // {K}) * {PROBLEMS} AS problem_id, CAST(place % {K} AS INTEGER) AS attempt_index, event_id, event_type, value, ts, event_type = 'purchase' AS success,
         event_type = 'error' AND value > 100 AS timed_out, {_CASE} AS diagnostics,
         event_type || CAST(CAST(floor(value / 40) AS BIGINT) AS VARCHAR) AS proof
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events) e)"""


def query(name: str, sql: str | None = None):
    """Register a function of Tables under a name, with its SQL if SQL can state it."""

    def note(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql.replace("{ATT}", ATT)
        return f

    return note

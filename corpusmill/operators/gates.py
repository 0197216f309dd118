"""Gates: a gate returns the rows that violate it, and `enforce` fails if there are any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text


class GateError(ValueError):
    """A gate had violations."""


def enforce(violations: DataFrame, what: str) -> None:
    """Fail closed: one action, and the first violations in the message."""
    rows = violations.limit(5).collect()
    if rows:
        raise GateError(f"{what}: {[r.asDict() for r in rows]}")


def violated(df: DataFrame, rules: dict[str, Column], keep: list[str]) -> DataFrame:
    """V-05, V-06, V-15 to V-17: rows that break rules (null counts as broken), with the names of those."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    return df.withColumn("violations", broken).where(F.size("violations") > 0).select(*keep, "violations")


def mismatched(left: DataFrame, right: DataFrame, key: str, *fields: str) -> DataFrame:
    """J-12, J-18 to J-20, K-13, V-10: keys that only one side has, or whose fields differ (null equals null)."""
    x = left.select(F.col(key), F.lit(True).alias("__l"), *(F.col(f).alias(f"l_{f}") for f in fields))
    y = right.select(F.col(key), F.lit(True).alias("__r"), *(F.col(f).alias(f"r_{f}") for f in fields))
    both = x.join(y, key, "full_outer")
    reason = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only")
    for f in fields:
        reason = reason.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), f)
    return both.withColumn("reason", reason).where("reason is not null").select(key, "reason")


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """J-16: wanted keys that aren't there."""
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti")


# fixed values: fields that give a proof away; each place has its own list
LEAK_FIELDS = {
    "benchmark": ("proof", "completion", "text", "reference_proof"),
    "rollout": ("proof", "completion", "reference_proof"),
    "trainer": ("proof", "completion", "text", "reference_proof"),
    "reference_only": (
        "proof", "verified_proof", "completion", "reference_proof", "reference_proof_hash", "reference_proof_length_tokens",
        "reference_proof_length_characters", "reference_proof_length_lines", "has_reference_proof",
    ),
}
#: Where a column that is there is enough; elsewhere a value is needed.
BY_COLUMN = frozenset({"trainer"})
#: Where any value that is not null is enough, a blank one too.
BY_VALUE = frozenset({"reference_only"})


def leaked_fields(df: DataFrame, place: str) -> Column:
    """V-07: fields of a place's list that a row gives away, in the order of the list."""
    fields = [c for c in LEAK_FIELDS[place] if c in df.columns]
    if not fields:
        return F.array().cast("array<string>")
    if place in BY_COLUMN:
        return F.array(*map(F.lit, fields))
    given = lambda c: F.col(c).isNotNull() if place in BY_VALUE else text.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""
    return F.array_compact(F.array(*(F.when(given(c), F.lit(c)) for c in fields)))


def leakage_violations(overlaps: DataFrame, **allowed: bool) -> DataFrame:
    """V-21: (pair, count) of overlaps that are not allowed: train_validation, train_benchmark, validation_benchmark."""
    return overlaps.where((F.col("count") > 0) & ~F.col("pair").isin(*[k for k, v in allowed.items() if v] or [""]))


def columns_present(df: DataFrame, forbidden: list[str]) -> list[str]:
    """V-07 at plan time: forbidden columns that the frame has."""
    return [c for c in forbidden if c in df.columns]


def schema_equals(df: DataFrame, ddl: str) -> list[str]:
    """V-05 at plan time: differences from a closed schema."""
    from pyspark.sql.types import StructType

    want = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(ddl).fields}
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [f"{k}: {have.get(k)} for {want.get(k)}" for k in sorted(want.keys() | have.keys()) if want.get(k) != have.get(k)]


def imports_covered(imports: Column, allowed: list[str]) -> Column:
    """V-23: each import is allowed, or below an allowed one."""
    return F.forall(imports, lambda m: F.lit(False) if not allowed else _any(m, allowed))


def _any(m: Column, allowed: list[str]) -> Column:
    out = F.lit(False)
    for a in allowed:
        out = out | (m == a) | m.startswith(a + ".")
    return out

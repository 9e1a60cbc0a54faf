"""Storage identity: one stored copy of equal payloads, and values that may be used once only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_copy(df: DataFrame, content: list[str], ordinal: str, into: str = "stored_at") -> DataFrame:
    """df with the least ordinal of the rows of equal content: aggregated, then joined back, so that a payload that many
    rows share is not sorted in one task."""
    firsts = df.groupBy(*(F.col(c).alias(f"__{c}") for c in content)).agg(F.min(ordinal).alias(into))
    on = F.lit(True)
    for c in content:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(firsts, on).drop(*(f"__{c}" for c in content))


def reused(df: DataFrame, value: str, ordinal: str) -> DataFrame:
    """(value, uses, first_use) of values used more than once."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("uses"), F.min(ordinal).alias("first_use")).where("uses > 1")


def within_row_unique(values: str):
    """Whether the members of an array differ."""
    return F.size(F.array_distinct(values)) == F.size(values)


def ranked_once(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(ordinal)
    return df.withColumn("use", F.row_number().over(order))

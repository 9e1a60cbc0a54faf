"""Integrity: digests, comparison with stored digests, comparison of key sets and of whole relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc32(*parts: Column) -> Column:
    return F.crc32(F.concat(*parts) if len(parts) > 1 else parts[0])


def sha256(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)


def status(stored: Column, computed: Column, meta: Column | None = None) -> Column:
    """'meta' for arrays without data, 'ok', 'mismatch', or 'missing' where no digest is stored."""
    base = F.when(stored.isNull(), "missing").when(stored == computed, "ok").otherwise("mismatch")
    return base if meta is None else F.when(meta, "meta").otherwise(base)


def strict(df: DataFrame, name: str, stored: str, computed: str) -> DataFrame:
    """df, with an error that names the row, the digest expected and that found where they differ."""
    said = F.concat(F.lit("hash mismatch in "), F.col(name), F.lit(": expected "), F.col(stored), F.lit(", got "), F.col(computed))
    return df.withColumn(computed, F.when(F.col(stored).eqNullSafe(F.col(computed)), F.col(computed)).otherwise(F.raise_error(said).cast("string")))


def verify_module(catalog: DataFrame, module: DataFrame, name: str, digest: str) -> DataFrame:
    """(name, present, matches) for every name of the catalog: absent names don't match."""
    other = module.select(F.col(name).alias("__name"), F.col(digest).alias("__digest"), F.lit(True).alias("__there"))
    met = catalog.join(other, F.col(name) == F.col("__name"), "left")
    there = F.coalesce(F.col("__there"), F.lit(False))
    return met.select(name, there.alias("present"), (there & F.col(digest).eqNullSafe(F.col("__digest"))).alias("matches"))


def all_match(verified: DataFrame) -> DataFrame:
    return verified.agg(F.coalesce(F.bool_and("matches"), F.lit(True)).alias("all_match"), F.count_if(~F.col("matches")).alias("failed"))


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one of two relations has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def compare(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys..., status): 'left', 'right', 'equal' or 'differs' for every key of either relation."""
    a = left.select(*keys, F.struct(*values).alias("__a"))
    b = right.select(*keys, F.struct(*values).alias("__b"))
    same = reduce(lambda x, y: x & y, (F.col(f"__a.{v}").eqNullSafe(F.col(f"__b.{v}")) for v in values), F.lit(True))
    said = F.when(F.col("__b").isNull(), "left").when(F.col("__a").isNull(), "right").when(same, "equal").otherwise("differs")
    return a.join(b, keys, "full").select(*keys, said.alias("status"))

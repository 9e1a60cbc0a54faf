"""Joins that reading and writing archives imply: routing to modules, persistence, positions in keyed blobs, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import layout

PARAM, BUFFER, STATE_DICT = 0, 1, 2


def load_route(catalog: DataFrame, modules: DataFrame, name: str, module: str, kind: str | None = None) -> DataFrame:
    """catalog joined with modules(module) on the name up to its last dot, with ``attribute``, what follows it, and
    ``register``, 'parameter' or 'buffer'. Names without a dot belong to the root module ''. A row of the third kind is
    an error: nested state has no module."""
    parts = F.split(F.col(name), "\\.")
    routed = catalog.withColumn("module_path", F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".")).withColumn("attribute", F.element_at(parts, -1))
    if kind:
        how = F.when(F.col(kind) == PARAM, "parameter").when(F.col(kind) == BUFFER, "buffer")
        routed = routed.withColumn("register", how.otherwise(F.raise_error(F.lit("nested state can't be loaded into a module")).cast("string")))
    return routed.join(modules, F.col("module_path") == F.col(module))


def module_order(arrays: DataFrame, module: str, is_buffer: str, position: str, persistent: Column, all_buffers: bool = False) -> DataFrame:
    """arrays with the ordinal at which each is written: modules in their order, of each the parameters before the
    buffers, each in the order of position; buffers that are not persistent are left out unless all_buffers. Counts of
    modules are summed first and then rows are numbered within each, so no task sorts all arrays."""
    kept = arrays if all_buffers else arrays.where(~F.col(is_buffer) | persistent)
    sizes = kept.groupBy(F.col(module).alias("__module")).agg(F.count(F.lit(1)).alias("__n")).withColumn("__all", F.lit(0))
    bases = layout.offsets(sizes, "__n", "__module", ["__all"], into="__base", run=4096).select("__module", "__base")
    turn = F.row_number().over(Window.partitionBy(module).orderBy(is_buffer, position))
    numbered = kept.withColumn("__turn", turn).join(bases, F.col(module) == F.col("__module"))
    return numbered.withColumn("ordinal", (F.col("__base") + F.col("__turn") - 1).cast("bigint")).drop("__module", "__base", "__turn")


def persistent_only(rows: DataFrame, is_buffer: Column, persistent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are no buffers, or buffers that the persistent set holds."""
    kept = persistent.select(*keys).distinct().withColumn("__kept", F.lit(True))
    return rows.join(kept, keys, "left").where(~is_buffer | F.coalesce(F.col("__kept"), F.lit(False))).drop("__kept")


def skip_existing(rows: DataFrame, existing: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    return rows if force else rows.join(existing.select(*keys), keys, "left_anti")


def locate(positions: DataFrame, blobs: DataFrame, position: str, begin: str, bucket: int, length: str | None = None) -> DataFrame:
    """positions with the blob that starts last at or before each: an equi-join on buckets of the position instead of a
    comparison of all pairs.

    With a length column a blob is listed in every bucket that it touches, and a position beyond its end finds nothing.
    """
    last = F.col(begin) + (F.col(length) - 1 if length else F.lit(0))
    spread = blobs.withColumn("__b", F.explode(F.sequence(F.expr(f"{begin} div {bucket}"), F.floor(last / bucket).cast("bigint"))))
    asked = positions.withColumn("__b", F.expr(f"{position} div {bucket}"))
    near = (F.col(begin) <= F.col(position)) & ((F.col(position) <= last) if length else F.lit(True))
    return asked.join(spread, "__b").where(near).drop("__b")


def enrich(rows: DataFrame, info: DataFrame, key: str, renames: dict[str, str]) -> DataFrame:
    """rows with columns overwritten by those of info(key, ...) that renames names, where these are not null or empty."""
    other = info.select(F.col(key).alias("__key"), *(F.col(v).alias(f"__{k}") for k, v in renames.items()))
    met = rows.join(other, F.col(key) == F.col("__key"), "left")
    return met.withColumns({k: F.coalesce(F.nullif(F.col(f"__{k}"), F.lit("")), F.col(k)) for k in renames}).drop("__key", *(f"__{k}" for k in renames))

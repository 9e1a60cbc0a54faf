"""Archives in stores of keyed blobs: a key ends in the position at which its bytes begin.

A store is a DataFrame (key, data); how it is kept is up to Spark (a table, files, a connector). Keys are
``prefix:name:position``; the part before the first record is ``prefix:header:0``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import relate, select


def index_blobs(store: DataFrame, prefix: str) -> DataFrame:
    """(key, begin, length) of a prefix's blobs, in the order of their positions."""
    keyed = store.where(F.col("key").startswith(f"{prefix}:"))
    return keyed.select("key", select.numeric_suffix("key").alias("begin"), F.octet_length("data").cast("bigint").alias("length")).orderBy("begin")


def as_blobs(records: DataFrame, prefix: str) -> DataFrame:
    """(key, data) of records(name, header_offset, header, data_offset, data): two blobs for each record."""
    key = lambda at: F.concat_ws(":", F.lit(prefix), F.col("name"), F.col(at).cast("string"))
    both = F.array(
        F.struct(key("header_offset").alias("key"), F.col("header").alias("data")), F.struct(key("data_offset").alias("key"), F.col("data").alias("data"))
    )
    return records.select(F.inline(both))


def new_blobs(blobs: DataFrame, store: DataFrame, prefix: str, force: bool = False) -> DataFrame:
    """The blobs to put: those whose keys the store lacks, header and payload each for itself; all with force, and the
    archive's header always."""
    header = F.col("key") == f"{prefix}:header:0"
    return relate.skip_existing(blobs.where(~header), store, ["key"], force).unionByName(blobs.where(header))


def range_of(store: DataFrame, prefix: str, begin: int, end: int) -> DataFrame:
    """(begin, data) of the pieces that make up begin <= position < end, cut to that range, in order."""
    pieces = store.where(F.col("key").startswith(f"{prefix}:")).withColumn("at", select.numeric_suffix("key"))
    met = pieces.where((F.col("at") < end) & (F.col("at") + F.octet_length("data") > begin))
    low = F.greatest(F.lit(begin) - F.col("at"), F.lit(0)).cast("int")
    size = (F.least(F.lit(end) - F.col("at"), F.octet_length("data").cast("bigint")).cast("int")) - low
    return met.select(F.greatest(F.col("at"), F.lit(begin)).cast("bigint").alias("begin"), F.substring(F.col("data"), low + 1, size).alias("data")).orderBy("begin")

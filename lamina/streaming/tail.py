"""Archives as they arrive in a folder: a stream of catalogs or payload chunks, and rates of a log by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.sources.archive import decode_files


def tail(spark: SparkSession, folder: str, relation: str = "catalog", pattern: str = "*", files_per_trigger: int = 16) -> DataFrame:
    """A streaming DataFrame of a relation of every archive that appears in folder, each read once."""
    files = (
        spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger)
        .schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    )
    return decode_files(files, relation)


def rates(events: DataFrame, ts: str, keys: list[str], value: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and keys; rows later than late are dropped by the watermark. Works on streams and tables."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    grouped = timed.groupBy(F.window(ts, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "n", "total")

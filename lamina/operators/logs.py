"""Throughput logs: parsing, enrichment, masks, labels and the statistics drawn from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a log row.
LOG_SCHEMA = (
    "nodename string, region string, link_speed string, cpu_name string, gpu_name string, gpu_gb int, scheme string, duration double, "
    "total_bytes_read bigint, rate double, source string, raw_read boolean, force_http boolean, lazy_load boolean, plaid_mode boolean, "
    "plaid_buffers int, verify_hash boolean, cached string, read_size bigint, buffer_size bigint"
)
#: Schemes that addresses name, those left out of the comparison of local reads, the buffer compared.
SCHEMES = ("http", "https", "s3", "s3s", "file", "redis")
REMOTE_SCHEMES = ("s3", "redis", "s3s", "https")
COMPARED_BUFFER = 16 << 20


def parse_lines(lines: DataFrame, column: str = "value", schema: str = LOG_SCHEMA) -> DataFrame:
    """Rows of the lines that begin with { and end with }, typed by an explicit schema."""
    text = F.trim(F.col(column))
    return lines.where(text.startswith("{") & text.endswith("}")).select(F.from_json(text, schema).alias("row")).select("row.*")


def read_logs(spark, *paths: str, schema: str = LOG_SCHEMA) -> DataFrame:
    return parse_lines(spark.read.text(list(paths)), "value", schema)


def present_nodes(info: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return info.join(rows.select(key).distinct(), key, "left_semi")


def complete_rows(df: DataFrame, subset: list[str], kinds: dict[str, str]) -> DataFrame:
    """Rows without nulls in the subset, with columns cast to the types that kinds names."""
    return df.na.drop(subset=subset).withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def zero_filled(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0)).cast("int")


def local_reads(buffer: Column, scheme: Column, verified: Column, cached: Column, raw: Column, plaid: Column, link: Column) -> Column:
    """Rows that compare local reads: the usual buffer, no remote scheme, not verified, HTTP only if cached or raw, no
    or two plaid buffers; or any row of scheme torch; and in either case a 40G link."""
    own = (buffer == COMPARED_BUFFER) & ~scheme.isin(*REMOTE_SCHEMES) & ~verified & ((scheme != "http") | cached | raw) & plaid.isin(0, 2)
    return (own | (scheme == "torch")) & (link == "40G")


def counts_by(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*(F.count(c).alias(f"n_{c}") for c in columns))


def rate_by(df: DataFrame, keys: list[str], rate: Column) -> DataFrame:
    """Mean and sample deviation of a rate."""
    return df.groupBy(*keys).agg(F.count(rate).alias("n"), F.avg(rate).alias("mean_rate"), F.stddev_samp(rate).alias("sd_rate"))


def letter_values(df: DataFrame, keys: list[str], value: str, depth: int = 3) -> DataFrame:
    """The median and pairs of quantiles at 1/4, 1/8, ... down to depth halvings, interpolated."""
    shares = [0.5] + [x for k in range(2, depth + 1) for x in (0.5**k, 1 - 0.5**k)]
    names = ["median"] + [f"{side}_{2**k}" for k in range(2, depth + 1) for side in ("lower", "upper")]
    return df.groupBy(*keys).agg(*(F.percentile(value, s).alias(n) for s, n in zip(shares, names, strict=True)))


def clip(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Rows between two quantiles. The bounds are one row, broadcast."""
    bounds = F.broadcast(df.agg(F.percentile(value, low).alias("__low"), F.percentile(value, high).alias("__high")))
    return df.join(bounds, F.col(value).between(F.col("__low"), F.col("__high"))).drop("__low", "__high")


def summary(df: DataFrame, keys: list[str], value: str, shares: tuple[float, ...] = (0.25, 0.5, 0.9, 0.99)) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), *(F.percentile(value, s).alias(f"p{round(100 * s)}") for s in shares))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """(bin, n) over equal widths between the least and the largest value; the largest falls in the last bin."""
    ends = F.broadcast(df.agg(F.min(value).alias("__low"), F.max(value).alias("__high")))
    at = F.floor((F.col(value) - F.col("__low")) * bins / (F.col("__high") - F.col("__low")))
    place = F.when(F.col("__high") == F.col("__low"), 0).otherwise(F.least(F.lit(bins - 1), at)).cast("bigint")
    return df.join(ends).where(F.col(value).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def category_order(df: DataFrame, column: str, first: list[str]) -> DataFrame:
    """(category, position): those of first that occur, in that order, then the rest sorted."""
    rank = reduce(lambda out, x: F.when(F.col(column) == x[1], F.lit(x[0])).otherwise(out), reversed(list(enumerate(first))), F.lit(len(first)))
    present = df.select(column).distinct().withColumn("__rank", rank)
    from pyspark.sql import Window

    position = F.row_number().over(Window.orderBy("__rank", column))
    return present.select(F.col(column).alias("category"), position.cast("bigint").alias("position"))


def scheme_of(source: Column, force_http: Column) -> Column:
    """The scheme of an address: torch for .pt files, file for other paths, local for HTTP on this host, s3s for S3
    unless HTTP is forced."""
    named = F.substring_index(source, "://", 1)
    base = F.when(named.isin(*SCHEMES), named).when(source.endswith(".pt"), "torch").otherwise("file")
    return F.when((base == "http") & source.contains("localhost"), "local").when((base == "s3") & ~F.coalesce(force_http, F.lit(False)), "s3s").otherwise(base)


def peer_of(source: Column, cached_by: Column) -> Column:
    """Who served the bytes: the cache if one is named, this host, the address's host, or the file system."""
    host = F.regexp_extract(source, r"//([^/:]*)", 1)
    return F.coalesce(cached_by, F.when(source.contains("localhost"), "localhost").when(source.contains("//"), host).otherwise("filesystem"))


def write_logs(df: DataFrame, path: str) -> None:
    """One JSON object to a line."""
    df.write.mode("append").json(path)

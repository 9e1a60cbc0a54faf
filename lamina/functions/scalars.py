"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Item size in bytes of each numpy type code.
ITEM_SIZES = {
    "b1": 1, "i1": 1, "u1": 1, "i2": 2, "u2": 2, "f2": 2, "i4": 4, "u4": 4, "f4": 4, "i8": 8, "u8": 8, "f8": 8, "c8": 8, "c16": 16,
    "V1": 1, "V2": 2, "V4": 4, "V8": 8,
}
DEFAULT_REDIS_PORT = 6379
DAY = 86400


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def human_bytes(count: Column | str, decimal: bool = True) -> Column:
    """'12.3 MB' (steps of 1000) or '11.7 MiB' (steps of 1024), 'bytes' below the first step, up to PB. The unit is chosen
    before rounding. Quotients are doubles, one division for each unit, and are rounded as these are, halves to even."""
    step = 1000.0 if decimal else 1024.0
    units = ("bytes", "KB", "MB", "GB", "TB", "PB") if decimal else ("bytes", "KiB", "MiB", "GiB", "TiB", "PiB")
    values = [_col(count).cast("double")]
    for _ in units[1:]:
        values.append(values[-1] / step)
    out = None
    for value, unit in reversed(list(zip(values, units, strict=True))):
        text = F.concat(_tenths(value), F.lit(f" {unit}"))
        out = text if out is None else F.when(value < step, text).otherwise(out)
    return out


def _tenths(value: Column) -> Column:
    """A double with one digit after the point: the number of halves of a tenth below its fraction, compared exactly, as
    twenty times the fraction is sixteen times plus four times, and neither of these is rounded."""
    whole = F.floor(value).cast("bigint")
    rest = value - F.floor(value).cast("double")
    above = lambda m: (rest * 16 - m > -rest * 4) | ((rest * 16 - m == -rest * 4) & (m.isin(3, 7, 11, 15, 19)))
    tenths = F.size(F.filter(F.array(*(F.lit(float(m)) for m in range(1, 20, 2))), above))
    return F.concat((whole + F.floor(tenths / 10)).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"))


def element_count(shape: Column | str) -> Column:
    """Product of the dimensions; 1 for no dimensions, null for a null shape."""
    return F.aggregate(_col(shape), F.lit(1).cast("bigint"), lambda n, d: n * d.cast("bigint"))


def item_size(numpy_dtype: Column | str) -> Column:
    """Bytes of an element; null for types that don't exist."""
    code = F.regexp_replace(_col(numpy_dtype), "^[<>|=]", "")
    table = F.create_map(*(F.lit(x) for pair in ITEM_SIZES.items() for x in pair))
    return F.try_element_at(table, code)


def full_length(data_length: Column | str, numpy_dtype: Column | str, shape: Column | str) -> Column:
    """Bytes once read: the stored length or, if that is 0, what the shape says (an array declared without data)."""
    stored = _col(data_length).cast("bigint")
    return F.when(stored > 0, stored).otherwise(item_size(numpy_dtype).cast("bigint") * element_count(shape))


def split_dtype(dtype: Column | str) -> tuple[Column, Column]:
    """(numpy type, type name after the NUL or null) of a stored type string."""
    parts = F.split(_col(dtype), "\\x00", -1)
    return F.element_at(parts, 1), F.when(F.size(parts) > 1, F.element_at(parts, 2))


def is_opaque(numpy_dtype: Column | str) -> Column:
    return _col(numpy_dtype).rlike("V")


def decoder_dtype(numpy_dtype: Column | str) -> Column:
    """The integer type through which an opaque type is read."""
    return F.regexp_replace(_col(numpy_dtype), "V", "i")


def named_dtype(torch_dtype: Column | str) -> Column:
    """What follows 'torch.'; an error for any other string, null for null."""
    d = _col(torch_dtype)
    name = F.regexp_extract(d, r"^torch\.([A-Za-z0-9_]+)$", 1)
    return F.when(d.isNull(), F.lit(None).cast("string")).when(name != "", name).otherwise(F.raise_error(F.concat(F.lit("not a type name: "), d)).cast("string"))


def nickname(value: Column | str, names: dict[str, str]) -> Column:
    """The short name of a value, or the value."""
    v = _col(value)
    if not names:
        return v
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), v), v)


def redis_uri(uri: Column | str) -> Column:
    """struct(host, port, prefix) of redis://host[:port]/prefix; null fields for another scheme."""
    u = _col(uri)
    ok = F.lower(F.regexp_extract(u, r"^([A-Za-z]+)://", 1)) == "redis"
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z]+://(?:[^@/]*@)?([^:/?#]+)", 1))
    port = F.regexp_extract(u, r"^[A-Za-z]+://(?:[^@/]*@)?[^:/?#]+:([0-9]+)", 1)
    prefix = F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*/*([^?#]*)", 1)
    return F.struct(
        F.when(ok, host).alias("host"), F.when(ok, F.when(port != "", port.cast("int")).otherwise(DEFAULT_REDIS_PORT)).alias("port"), F.when(ok, prefix).alias("prefix")
    )


def s3_uri(uri: Column | str) -> Column:
    """struct(bucket, key) of s3://bucket/key; null fields for another scheme."""
    u = _col(uri)
    ok = F.lower(u).startswith("s3://")
    return F.struct(F.when(ok, F.regexp_extract(u, r"^[^:]+://([^/]*)", 1)).alias("bucket"), F.when(ok, F.regexp_extract(u, r"^[^:]+://[^/]*/+(.*)$", 1)).alias("key"))


def endpoint_host(endpoint: Column | str) -> Column:
    e = _col(endpoint)
    return F.lower(F.regexp_extract(e, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)", 1))


def needs_virtual_host(endpoint: Column | str, hosts: tuple[str, ...]) -> Column:
    """Whether an endpoint is one of the hosts, given in lower case, that accept virtual-host addressing only."""
    return endpoint_host(endpoint).isin(*hosts)


def is_accelerated(endpoint: Column | str) -> Column:
    """Whether a part of the host name is 'accel', which calls for the older request signature."""
    return F.array_contains(F.split(endpoint_host(endpoint), "\\."), "accel")


def aligned_expiry(epoch_seconds: Column | str) -> Column:
    """The start of the day plus two days: equal for all calls within a day, so signed addresses can be cached."""
    t = _col(epoch_seconds).cast("bigint")
    return t - F.pmod(t, F.lit(DAY).cast("bigint")) + F.lit(2 * DAY).cast("bigint")


def mode_label(*parts: Column) -> Column:
    """The labels that are not null or empty, one to a line, or 'default'."""
    kept = F.filter(F.array(*(p.cast("string") for p in parts)), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise("default")


def tick_bounds(low: Column | str, high: Column | str, step: int) -> Column:
    """struct(lower, upper): the multiples of step around a range."""
    lo, hi, s = _col(low).cast("bigint"), _col(high).cast("bigint"), F.lit(step).cast("bigint")
    return F.struct((lo - F.pmod(lo, s)).alias("lower"), (hi + F.pmod(-hi, s)).alias("upper"))

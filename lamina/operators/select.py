"""Selection: predicates on names, subtrees, limits with a cursor, point lookups, requested order, top-k, byte ranges."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def name_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Names that begin with the prefix; sources that take predicates get it as one."""
    return df.where(F.col(column).startswith(prefix))


def name_match(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Names that the pattern matches from their start on."""
    return df.where(F.col(column).rlike(f"^(?:{pattern})"))


def name_filter(df: DataFrame, column: str, keep: Callable[[str], object]) -> DataFrame:
    """Names for which an arbitrary Python function is true, in Arrow batches; each name of a batch is asked once."""

    @F.arrow_udf(T.BooleanType())
    def kept(names: pa.Array) -> pa.Array:
        coded = names.dictionary_encode()
        truth = [bool(keep(n)) for n in coded.dictionary.to_pylist()]
        return pa.array([None if k is None else truth[k] for k in coded.indices.to_pylist()], pa.bool_())

    return df.where(kept(F.col(column)))


def subtree(df: DataFrame, path: str, prefix: list) -> DataFrame:
    """Rows whose path array begins with the prefix."""
    if not prefix:
        return df
    return df.where(F.slice(F.col(path), 1, len(prefix)) == F.array(*map(F.lit, prefix)))


def read_limit(df: DataFrame, order: str, n: int = -1, after=None, where: Column | None = None) -> DataFrame:
    """The first n rows by order that satisfy where, beyond the cursor after; -1: all, 0: none.

    The cursor is the last row's order value, so a reader resumes without rereading; any other negative n is an error.
    """
    if n < -1:
        raise ValueError("the number of rows must be -1, 0 or positive")
    if where is not None:
        df = df.where(where)
    if after is not None:
        df = df.where(F.col(order) > F.lit(after))
    return df.orderBy(order) if n < 0 else df.orderBy(order).limit(n)


def exactly_one(df: DataFrame) -> DataFrame:
    """df if it has one row, else an error when it runs; counted and checked where the rows are."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    met = df.agg(F.count(F.lit(1)).alias("n"), F.first(row).alias("row"))
    wrong = F.concat(F.lit("expected one row, found "), F.col("n").cast("string"))
    return met.select(F.when(F.col("n") == 1, F.col("row")).otherwise(F.raise_error(wrong).cast(met.schema["row"].dataType)).alias("row")).select("row.*")


def top_level(df: DataFrame, path: str, ordinal: str) -> DataFrame:
    """(key, first): distinct first path components in order of first appearance."""
    return df.groupBy(F.col(path)[0].alias("key")).agg(F.min(ordinal).alias("first")).orderBy("first")


def requested(df: DataFrame, request: DataFrame, key: str, position: str) -> DataFrame:
    """The rows of df that a request table asks for, in the request's order."""
    return df.join(request, key).orderBy(position)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def file_order(df: DataFrame, ordinal: str) -> DataFrame:
    return df.orderBy(ordinal)


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """(key..., n) of keys that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def numeric_suffix(key: str) -> Column:
    """The number after the last colon of a key."""
    return F.element_at(F.split(F.col(key), ":"), -1).cast("bigint")


def byte_range(data: Column | str, begin: int = 0, end: int | None = None) -> Column:
    """Bytes begin <= k < end of a binary column."""
    if begin < 0 or (end is not None and end <= begin):
        raise ValueError("a byte range must begin at 0 or later and end after its begin")
    c = F.col(data) if isinstance(data, str) else data
    return F.substring(c, begin + 1, (1 << 31) - 1 if end is None else end - begin)


def plain_only(df: DataFrame, opaque: str, allow_raw: bool) -> DataFrame:
    """df, with an error on rows of opaque type unless raw data is allowed."""
    if allow_raw:
        return df
    return df.where(F.coalesce(F.assert_true(~F.col(opaque), F.lit("opaque type: raw data must be allowed")).cast("string").isNull(), F.lit(True)))

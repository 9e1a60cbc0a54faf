"""Tables as arrays: rows of vectors, columns and texts in the form that archives are written from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.BinaryType())
def _float32(vectors: pa.Array) -> pa.Array:
    return pa.array([None if not v.is_valid else np.asarray(v.values, "<f4").tobytes() for v in vectors], pa.binary())


def vectors(df: DataFrame, key: str, vector: str, prefix: str = "vec.") -> DataFrame:
    """One float32 array for each row of a table of vectors, in the order of key."""
    return df.select(
        F.col(key).cast("int").alias("ordinal"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("name"), F.lit(None).cast("string").alias("path_json"),
        F.lit(0).alias("tensor_type"), F.lit(0).alias("module_idx"), F.lit("<f4").alias("numpy_dtype"), F.lit(None).cast("string").alias("torch_dtype"),
        F.array(F.size(vector).cast("bigint")).alias("shape"), _float32(F.col(vector)).alias("data"),
    )


def texts(df: DataFrame, key: str, text: str, prefix: str = "text.") -> DataFrame:
    """One byte array for each row of a table of texts; null is an array declared without data, of no elements."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return df.select(
        F.col(key).cast("int").alias("ordinal"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("name"), F.lit(None).cast("string").alias("path_json"),
        F.lit(1).alias("tensor_type"), F.lit(0).alias("module_idx"), F.lit("|u1").alias("numpy_dtype"), F.lit(None).cast("string").alias("torch_dtype"),
        F.array(F.octet_length(raw).cast("bigint")).alias("shape"), raw.alias("data"),
    )

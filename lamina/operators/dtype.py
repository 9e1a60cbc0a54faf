"""Element types: decoding payload bytes, casts, and the types that numpy lacks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stored as integers of equal size under another name; exponent and mantissa bits, exponent bias, and
#: whether the type has infinities, for those that are floating.
FLOATS = {
    "bfloat16": (8, 7, 127, True),
    "float8_e5m2": (5, 2, 15, True),
    "float8_e4m3fn": (4, 3, 7, False),
    "float8_e5m2fnuz": (5, 2, 16, False),
    "float8_e4m3fnuz": (4, 3, 8, False),
    "float8_e8m0fnu": (8, 0, 127, False),
}
#: Types that can't be stored.
UNSUPPORTED = ("qint8", "quint8", "qint32", "quint4x2", "quint2x4")


def small_floats(name: str) -> np.ndarray:
    """The value of every bit pattern of an 8-bit floating type, computed from its layout."""
    exponent_bits, mantissa_bits, bias, infinite = FLOATS[name]
    bits = np.arange(256)
    if name == "float8_e8m0fnu":
        return np.where(bits == 255, np.nan, 2.0 ** (bits - float(bias))).astype(np.float32)
    sign = np.where(bits >> 7, -1.0, 1.0)
    exponent, mantissa = (bits >> mantissa_bits) & ((1 << exponent_bits) - 1), bits & ((1 << mantissa_bits) - 1)
    scale = 2.0**-mantissa_bits
    value = sign * np.where(exponent > 0, 2.0 ** (exponent - float(bias)) * (1 + mantissa * scale), 2.0 ** (1.0 - bias) * mantissa * scale)
    if infinite:
        top = exponent == (1 << exponent_bits) - 1
        value = np.where(top & (mantissa == 0), sign * np.inf, np.where(top, np.nan, value))
    elif name.endswith("fnuz"):
        value = np.where(bits == 128, np.nan, value)
    else:
        value = np.where((bits & 127) == 127, np.nan, value)
    return value.astype(np.float32)


def decode(data: bytes, numpy_dtype: str, torch_dtype: str | None = None) -> np.ndarray:
    """Elements of a payload, flat. Opaque floats become float32, complex halves float32 pairs seen as complex64;
    other opaque types come as integers of their size."""
    if torch_dtype is None:
        return np.frombuffer(data, np.dtype(numpy_dtype))
    name = torch_dtype.removeprefix("torch.")
    if name in UNSUPPORTED:
        raise NotImplementedError(f"type {torch_dtype} can't be decoded")
    if name == "bfloat16":
        return (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32)
    if name in FLOATS:
        return small_floats(name)[np.frombuffer(data, np.uint8)]
    if name == "complex32":
        return np.frombuffer(data, "<f2").astype(np.float32).view(np.complex64)
    return np.frombuffer(data, np.dtype(numpy_dtype.replace("V", "i")))


def as_doubles(values: np.ndarray) -> np.ndarray:
    """Elements as float64; of complex numbers the real parts."""
    return (values.real if np.iscomplexobj(values) else values).astype(np.float64)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _bfloat16(vectors: pa.Array) -> pa.Array:
    values = np.asarray(vectors.flatten(), np.float32)
    cut = (values.view(np.uint32) & np.uint32(0xFFFF0000)).view(np.float32)
    sizes = np.array([0 if not v.is_valid else len(v) for v in vectors], np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(cut))


def bfloat16_values(vectors: Column | str) -> Column:
    """A float array with each element cut to its upper 16 bits; null counts as empty."""
    return _bfloat16(F.col(vectors) if isinstance(vectors, str) else vectors)


def needs_gradient(numpy_dtype: Column, torch_dtype: Column) -> Column:
    """Whether elements are floating or complex, whatever holds them."""
    return F.coalesce(torch_dtype.rlike("float|complex"), numpy_dtype.rlike("[fc][0-9]+$"))

"""Models as protocol buffers: modules of named attributes, which are modules, arrays or scalars.

The wire format is written and read here; files of such messages are read with Spark as binary files.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.operators.dtype import decode

# Numbers of the message fields and of the element types.
DTYPES = {
    1: "float32", 2: "float64", 3: "float16", 4: "bfloat16", 5: "complex32", 6: "complex64", 7: "complex128", 8: "uint8", 9: "int8",
    10: "int16", 11: "int32", 12: "int64", 13: "bool", 14: "quint8", 15: "qint8", 16: "qint32", 17: "quint4x2",
}
CODES = {name: k for k, name in DTYPES.items()}
TENSOR = {"dtype": 1, "shape": 2, "data": 3, "attr_type": 4}
ATTRIBUTE = {"name": 1, "module": 3, "tensor": 4, "string": 5, "int64": 6, "float": 7, "bool": 8}
MODULE = {"name": 1, "names": 2, "attributes": 3}
KINDS = {0: "parameter", 1: "buffer"}


@dataclass
class Tensor:
    dtype: str
    shape: tuple[int, ...]
    data: bytes
    attr_type: int | None = None

    def values(self) -> np.ndarray:
        """The array; types that numpy lacks come as decode gives them."""
        if self.dtype.startswith("q"):
            raise NotImplementedError(f"type {self.dtype} can't be decoded")
        if self.dtype in ("bfloat16", "complex32"):
            return decode(self.data, "<V2", f"torch.{self.dtype}").reshape(self.shape)
        return np.frombuffer(self.data, np.dtype(self.dtype)).reshape(self.shape)


@dataclass
class Module:
    name: str = ""
    names: list[str] = field(default_factory=list)
    attributes: list[tuple[str, Any]] = field(default_factory=list)


def _varint(n: int) -> bytes:
    n, out = n & (1 << 64) - 1, bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _sized(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def encode_tensor(t: Tensor) -> bytes:
    out = _varint(TENSOR["dtype"] << 3) + _varint(CODES[t.dtype])
    if t.shape:
        out += _sized(TENSOR["shape"], b"".join(map(_varint, t.shape)))
    if t.data:
        out += _sized(TENSOR["data"], t.data)
    return out if t.attr_type is None else out + _varint(TENSOR["attr_type"] << 3) + _varint(t.attr_type)


def encode_module(m: Module) -> bytes:
    out = _sized(MODULE["name"], m.name.encode()) if m.name else b""
    out += b"".join(_sized(MODULE["names"], n.encode()) for n in m.names)
    for name, value in m.attributes:
        body = _sized(ATTRIBUTE["name"], name.encode()) if name else b""
        if isinstance(value, Module):
            body += _sized(ATTRIBUTE["module"], encode_module(value))
        elif isinstance(value, Tensor):
            body += _sized(ATTRIBUTE["tensor"], encode_tensor(value))
        elif isinstance(value, str):
            body += _sized(ATTRIBUTE["string"], value.encode())
        elif isinstance(value, bool):
            body += _varint(ATTRIBUTE["bool"] << 3) + _varint(int(value))
        elif isinstance(value, int):
            body += _varint(ATTRIBUTE["int64"] << 3) + _varint(value)
        elif isinstance(value, float):
            body += _varint(ATTRIBUTE["float"] << 3 | 5) + struct.pack("<f", value)
        else:
            raise TypeError(f"attribute {name!r} is a {type(value).__name__}")
        out += _sized(MODULE["attributes"], body)
    return out


def _fields(raw: bytes):
    at = 0

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            if at >= len(raw) or shift > 63:
                raise ValueError("a message ends within a number")
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(raw):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(wire)
            size = varint() if wire == 2 else size
            if size is None or at + size > len(raw):
                raise ValueError("a message ends within a field")
            at += size
            yield number, raw[at - size : at]


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def decode_tensor(raw: bytes) -> Tensor:
    out = Tensor("", (), b"")
    for number, value in _fields(raw):
        if number == TENSOR["dtype"]:
            out.dtype = DTYPES.get(value, "")
        elif number == TENSOR["shape"]:
            out.shape += tuple(_signed(n) for n in ([value] if isinstance(value, int) else _packed(value)))
        elif number == TENSOR["data"]:
            out.data = value
        elif number == TENSOR["attr_type"]:
            out.attr_type = value
    return out


def _packed(raw: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for b in raw:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(n)
            n = shift = 0
    return out


def decode_module(raw: bytes) -> Module:
    out = Module()
    for number, value in _fields(raw):
        if number == MODULE["name"]:
            out.name = value.decode()
        elif number == MODULE["names"]:
            out.names.append(value.decode())
        elif number == MODULE["attributes"]:
            name, found = "", None
            for part, x in _fields(value):
                if part == ATTRIBUTE["name"]:
                    name = x.decode()
                elif part == ATTRIBUTE["module"]:
                    found = decode_module(x)
                elif part == ATTRIBUTE["tensor"]:
                    found = decode_tensor(x)
                elif part == ATTRIBUTE["string"]:
                    found = x.decode()
                elif part == ATTRIBUTE["int64"]:
                    found = _signed(x)
                elif part == ATTRIBUTE["float"]:
                    found = struct.unpack("<f", x)[0]
                elif part == ATTRIBUTE["bool"]:
                    found = bool(x)
            out.attributes.append((name, found))
    return out


def tensors(m: Module, prefix: str = "") -> list[tuple[str, Tensor]]:
    """(dotted name, array) of a module and all below it, in order."""
    out = []
    for name, value in m.attributes:
        # A root module is an attribute without a name.
        full = ".".join(x for x in (prefix, name) if x)
        out += tensors(value, full) if isinstance(value, Module) else [(full, value)] if isinstance(value, Tensor) else []
    return out


ROWS = "path string, ordinal int, name string, dtype string, shape array<bigint>, kind string, data binary"


def read_models(files: DataFrame) -> DataFrame:
    """Arrays of model files, given as path and content."""

    def rows(batches):
        for batch in batches:
            out = {k: [] for k in ("path", "ordinal", "name", "dtype", "shape", "kind", "data")}
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (name, t) in enumerate(tensors(decode_module(content))):
                    for column, value in zip(out, (path, k, name, t.dtype, list(t.shape), KINDS.get(t.attr_type), t.data), strict=True):
                        out[column].append(value)
            types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    return files.select("path", "content").mapInArrow(rows, ROWS)

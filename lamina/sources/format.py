"""The binary layout of archives: encoding and decoding, on bytes and file objects, with no Spark in it."""

from __future__ import annotations

import hashlib
import io
import json
import math
import struct
import zlib
from dataclasses import dataclass, field
from typing import BinaryIO

from lamina.functions.scalars import ITEM_SIZES

# Fixed values of the format.
MAGIC = b"|TZR|"
VERSIONS = (1, 2, 3, 4)
FLAG_ENCRYPTED = 1
INDEX_SPACE = 256 * 1024
PARAM, BUFFER, STATE_DICT = 0, 1, 2
CRC32, SHA256 = 0, 1
KDF, PARALLEL, SEQUENTIAL = 1, 2, 3
ARGON2ID = 1
PATH_MARK = 0x1E
NONCE_BYTES, MAC_BYTES = 24, 16


class FormatError(ValueError):
    """The bytes are no archive, or one that can't be read."""


class Cursor:
    """Bounds-checked reading of little-endian fields from bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise FormatError(f"{n} bytes expected at {self.at}, {len(self.data) - self.at} there")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str) -> int:
        return struct.unpack("<" + code, self.take(struct.calcsize("<" + code)))[0]

    def sized(self, code: str) -> bytes:
        return self.take(self.number(code))

    def shape(self) -> tuple[int, ...]:
        n = self.number("B")
        return struct.unpack(f"<{n}I", self.take(4 * n))


# Names


def encode_path(path: tuple) -> bytes:
    """A single string as it is; other paths as a mark and a compact JSON array."""
    check_path(path)
    if len(path) == 1 and isinstance(path[0], str):
        return path[0].encode()
    return bytes([PATH_MARK]) + json.dumps(list(path), separators=(",", ":")).encode("ascii")


def check_path(path: tuple) -> None:
    if not path:
        raise FormatError("empty path")
    for step in path:
        if isinstance(step, bool) or not isinstance(step, str | int):
            raise FormatError(f"neither a string nor a whole number: {step!r}")
        if isinstance(step, int) and step < 0:
            raise FormatError(f"negative index {step}")


def decode_path(raw: bytes) -> tuple:
    if not raw:
        raise FormatError("empty path")
    if raw[0] != PATH_MARK:
        return (raw.decode(),)
    text = raw[1:]
    if not (text.startswith(b"[") and text.endswith(b"]")):
        raise FormatError("a structured name must be an array")
    if b"\n" in text or b"\r" in text:
        raise FormatError("line break in a structured name")

    def refuse(*_):
        raise FormatError("only strings and whole numbers may stand in a structured name")

    try:
        path = tuple(json.loads(text, object_hook=refuse, parse_float=refuse, parse_constant=refuse))
    except RecursionError:
        raise FormatError("a structured name is nested too deeply") from None
    except json.JSONDecodeError as e:
        raise FormatError(f"a structured name is no JSON: {e}") from None
    check_path(path)
    return path


# Types


def split_dtype(dtype: str) -> tuple[str, str | None]:
    parts = dtype.split("\0")
    if len(parts) > 2:
        raise FormatError("more than one NUL in a type")
    return parts[0], parts[1] if len(parts) == 2 else None


def itemsize(numpy_dtype: str) -> int:
    try:
        return ITEM_SIZES[numpy_dtype.lstrip("<>|=")]
    except KeyError:
        raise FormatError(f"unknown type {numpy_dtype!r}") from None


# File header


@dataclass
class FileHeader:
    version: int
    encrypted: bool
    tensor_bytes: int
    tensor_count: int

    def pack(self) -> bytes:
        flags = (FLAG_ENCRYPTED if self.encrypted and self.version >= 4 else 0).to_bytes(32, "little")
        return MAGIC + struct.pack("<I32sQ8xQ", self.version, flags, self.tensor_bytes, self.tensor_count)

    @property
    def has_crypt(self) -> bool:
        """Whether records have a crypt block."""
        return self.version == 3 or (self.version >= 4 and self.encrypted)


def read_header(file: BinaryIO, accepted: tuple[int, ...] = VERSIONS) -> FileHeader:
    raw = Cursor(file.read(len(MAGIC) + 60))
    if raw.data[: len(MAGIC)] != MAGIC:
        raise FormatError("not an archive: it doesn't begin as one")
    raw.take(len(MAGIC))
    version = raw.number("I")
    if version not in accepted:
        raise FormatError(f"version {version} is not among those that can be read: {', '.join(map(str, accepted))}")
    flags = int.from_bytes(raw.take(32), "little")
    if flags > FLAG_ENCRYPTED:
        raise FormatError(f"unknown feature flags {flags:#x}")
    total = raw.number("Q")
    raw.take(8)
    return FileHeader(version, version == 3 or bool(flags & FLAG_ENCRYPTED), total, raw.number("Q"))


# Index


def check_limits(name: bytes, dtype: bytes, shape: tuple[int, ...]) -> None:
    if len(dtype) > 255:
        raise FormatError("a type's name must be shorter than 256 bytes")
    if len(name) > 0xFFFF or len(shape) > 255 or any(not 0 <= d < 1 << 32 for d in shape):
        raise FormatError("a name, or a shape, is too large for its field")


@dataclass
class Entry:
    path: tuple
    tensor_type: int
    dtype: str
    shape: tuple[int, ...]
    header_offset: int
    data_offset: int
    data_length: int

    def pack(self) -> bytes:
        name, dtype = encode_path(self.path), self.dtype.encode()
        check_limits(name, dtype, self.shape)
        return (
            struct.pack("<H", len(name)) + name + struct.pack("<BB", self.tensor_type, len(dtype)) + dtype
            + struct.pack(f"<B{len(self.shape)}I", len(self.shape), *self.shape) + struct.pack("<QQQ", self.header_offset, self.data_offset, self.data_length)
        )

    @property
    def full_length(self) -> int:
        return self.data_length or itemsize(split_dtype(self.dtype)[0]) * math.prod(self.shape)

    @property
    def is_meta(self) -> bool:
        return not self.data_length and self.full_length > 0


def read_index(file: BinaryIO, count: int) -> list[Entry]:
    """Entries in file order; repeated names, leaves above other leaves and layers of both kinds are errors."""
    from lamina.operators.tree import check_paths

    (length,) = struct.unpack("<Q", _exactly(file, 8))
    raw, out = Cursor(_exactly(file, length)), []
    if count and not length:
        raise FormatError("empty index")
    for _ in range(count):
        path, kind = decode_path(raw.sized("H")), raw.number("B")
        dtype, shape = raw.sized("B").decode(), raw.shape()
        out.append(Entry(path, kind, dtype, shape, raw.number("Q"), raw.number("Q"), raw.number("Q")))
    try:
        check_paths([e.path for e in out])
    except ValueError as e:
        raise FormatError(str(e)) from None
    return out


def _exactly(file: BinaryIO, n: int) -> bytes:
    out = file.read(n)
    if len(out) != n:
        raise FormatError(f"{n} bytes expected, {len(out)} there")
    return out


# Crypt blocks


@dataclass
class Crypt:
    """How a payload is encrypted; scheme is None for payloads that are not."""

    scheme: str | None = None
    chunk_size: int | None = None
    nonce: bytes | None = None
    macs: list[bytes] = field(default_factory=list)
    kdf: tuple[int, int, int, bytes] | None = None

    def pack(self) -> bytes:
        chunks = []
        if self.kdf:
            ops, mem, alg, salt = self.kdf
            chunks.append(struct.pack("<HHQQiH", KDF, ARGON2ID, ops, mem, alg, len(salt)) + salt)
        if self.scheme == "parallel":
            chunks.append(struct.pack("<HQ24sQ", PARALLEL, self.chunk_size, self.nonce, len(self.macs)) + b"".join(self.macs))
        elif self.scheme == "sequential":
            chunks.append(struct.pack("<H24s16s", SEQUENTIAL, self.nonce, self.macs[0]))
        body = struct.pack("<H", len(chunks)) + b"".join(struct.pack("<Q", len(c)) + c for c in chunks)
        return struct.pack("<Q", len(body)) + body


def read_crypt(raw: bytes) -> Crypt:
    at, out = Cursor(raw), Crypt()
    for _ in range(at.number("H")):
        chunk = Cursor(at.sized("Q"))
        kind = chunk.number("H")
        if kind == KDF:
            if out.kdf:
                raise FormatError("two key derivations")
            if (method := chunk.number("H")) != ARGON2ID:
                raise FormatError(f"unknown key derivation {method}")
            out.kdf = (chunk.number("Q"), chunk.number("Q"), chunk.number("i"), chunk.sized("H"))
        elif kind in (PARALLEL, SEQUENTIAL):
            if out.scheme:
                raise FormatError("two ciphers")
            if kind == PARALLEL:
                out.scheme, out.chunk_size, out.nonce = "parallel", chunk.number("Q"), chunk.take(NONCE_BYTES)
                if out.chunk_size % 64 or out.chunk_size < 1024:
                    raise FormatError(f"chunks of {out.chunk_size} bytes: not a multiple of 64 from 1024 on")
                out.macs = [chunk.take(MAC_BYTES) for _ in range(chunk.number("Q"))]
            else:
                out.scheme, out.nonce, out.macs = "sequential", chunk.take(NONCE_BYTES), [chunk.take(MAC_BYTES)]
        else:
            raise FormatError(f"unknown crypt chunk {kind}")
    return out


# Records


@dataclass
class Record:
    entry: Entry
    module_idx: int
    header_size: int
    crc32: int | None
    sha256: bytes | None
    header_zeroed: bytes
    crypt: Crypt | None


def pack_record(path: tuple, tensor_type: int, module_idx: int, dtype: str, shape: tuple[int, ...], data: bytes, crypt: Crypt | None, plain: bytes | None = None) -> tuple[bytes, int]:
    """(header, header size) of a record whose digests are those of the plain payload."""
    name, kind = encode_path(path), dtype.encode()
    if tensor_type != STATE_DICT and not (len(path) == 1 and isinstance(path[0], str)):
        raise FormatError("only nested state has structured names")
    check_limits(name, kind, shape)
    front = struct.pack("<HBH", module_idx, tensor_type, len(name)) + name + struct.pack("<B", len(kind)) + kind + struct.pack(f"<B{len(shape)}I", len(shape), *shape)
    with_crc = not (crypt and crypt.scheme)
    count, size = (2, 6 + 34) if with_crc else (1, 34)
    block = crypt.pack() if crypt else b""
    end = struct.pack("<q", len(data))
    total = 8 + len(front) + 3 + size + len(block) + len(end)
    hashes = lambda crc, sha: struct.pack("<HB", size + 1, count) + (struct.pack("<BBI", CRC32, 4, crc) if with_crc else b"") + struct.pack("<BB32s", SHA256, 32, sha)
    start = struct.pack("<Q", total) + front
    zeroed = start + hashes(0, b"") + end
    plain = data if plain is None else plain
    crc = zlib.crc32(plain, zlib.crc32(zeroed))
    sha = hashlib.sha256(zeroed + plain).digest()
    return start + hashes(crc, sha) + block + end, total


def read_record(file: BinaryIO, has_crypt: bool, entry: Entry | None = None) -> Record | None:
    """The record header at the file's position; None at the end mark."""
    head = file.read(8)
    if len(head) < 8:
        raise FormatError("the archive ends before its end mark")
    (size,) = struct.unpack("<Q", head)
    if size == 0:
        return None
    at = Cursor(head + _exactly(file, size - 8), 8)
    module_idx, kind = at.number("H"), at.number("B")
    path = decode_path(at.sized("H"))
    if kind not in (PARAM, BUFFER, STATE_DICT):
        raise FormatError(f"unknown kind of array {kind}")
    if kind != STATE_DICT and not (len(path) == 1 and isinstance(path[0], str)):
        raise FormatError("only nested state has structured names")
    dtype, shape = at.sized("B").decode(), at.shape()
    hash_at = at.at + 2
    block = Cursor(at.sized("H"))
    zeroed, crc, sha = bytearray(at.data), None, None
    for _ in range(block.number("B")):
        which = block.number("B")
        value = block.sized("B")
        zeroed[hash_at + block.at - len(value) : hash_at + block.at] = bytes(len(value))
        if which == CRC32 and len(value) == 4:
            crc = int.from_bytes(value, "little")
        elif which == SHA256 and len(value) == 32:
            sha = value
        else:
            raise FormatError(f"unknown digest {which} of {len(value)} bytes")
    crypt, crypt_at = None, at.at
    if has_crypt:
        crypt = read_crypt(at.sized("Q"))
    header0 = bytes(zeroed[:crypt_at]) + bytes(zeroed[at.at :])
    length = at.number("q")
    if length < 0:
        raise FormatError("negative length")
    made = Entry(path, kind, dtype, shape, entry.header_offset if entry else -1, entry.data_offset if entry else -1, length)
    return Record(made, module_idx, size, crc, sha, header0, crypt)


def check_payload(record: Record, plain: bytes) -> None:
    """Raises where a digest of the record isn't that of the payload."""
    if record.sha256 is not None and hashlib.sha256(record.header_zeroed + plain).digest() != record.sha256:
        raise FormatError(f"hash mismatch in {record.entry.path}: SHA-256")
    if record.crc32 is not None and zlib.crc32(plain, zlib.crc32(record.header_zeroed)) != record.crc32:
        raise FormatError(f"hash mismatch in {record.entry.path}: CRC32")


def needed_version(opaque: bool, encrypted: bool, meta: bool) -> int:
    return max(1, 2 if opaque else 1, 3 if encrypted else 1, 4 if meta else 1)


def write_archive(arrays: list[tuple], file: BinaryIO, index_space: int = INDEX_SPACE, seal=None) -> FileHeader:
    """Writes (path, type, module, dtype, shape, data) rows; data None declares an array without data. seal turns a
    plain payload into (payload, Crypt)."""
    entries, records, at = [], [], len(MAGIC) + 60 + 8 + index_space
    meta = any(a[5] is None for a in arrays)
    version = needed_version(any("\0" in a[3] for a in arrays), seal is not None, meta)
    for path, kind, module, dtype, shape, data in arrays:
        numpy_dtype = split_dtype(dtype)[0]
        if data and len(data) != itemsize(numpy_dtype) * math.prod(shape):
            raise FormatError(f"{path}: {len(data)} bytes don't fill {shape} of {dtype!r}")
        plain = data or b""
        body, crypt = (seal(plain) if plain else (b"", Crypt())) if seal else (plain, None)
        header, size = pack_record(path, kind, module, dtype, shape, body, crypt, plain)
        entries.append(Entry(path, kind, dtype, shape, at, at + size, len(body)))
        records.append(header + body)
        at += size + len(body)
    index = b"".join(e.pack() for e in entries)
    if len(index) > index_space:
        raise FormatError(f"metadata overflow: the index takes {len(index)} bytes of {index_space}")
    header = FileHeader(version, seal is not None, sum(e.data_length for e in entries), len(entries))
    file.write(header.pack() + struct.pack("<Q", index_space) + index.ljust(index_space, b"\0"))
    for r in records:
        file.write(r)
    file.write(bytes(8))
    return header


def to_bytes(arrays: list[tuple], **options) -> bytes:
    out = io.BytesIO()
    write_archive(arrays, out, **options)
    return out.getvalue()

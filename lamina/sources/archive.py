"""A Spark data source of archives: ``spark.read.format("array_archive").option("relation", ...).load(path)``.

Relations: archive_info and catalog read headers and indexes only; headers reads record headers; reads tells what each
task's range of payloads took; chunks reads payloads in pieces; elements decodes them, in Arrow batches. Payload
relations are cut into byte-balanced contiguous ranges, one to a task.

Options: path (several divided by commas, local globs allowed); nameRegex, namePrefix and names (a JSON array), which
choose arrays in the index before any payload is read; readers (ranges to an archive, by default one for each 64 MiB),
chunkBytes, verify (check digests while reading payloads), keyFile (a file with the raw key or, with keyKind=passphrase,
the passphrase of encrypted archives). Writing: encrypt (with keyFile), indexBytes (by default as many as the index
needs), parts (a folder with one archive from each task instead of one archive, whose payloads the commit would copy).

The reader takes no predicates from Spark: version 4.1 keeps those it pushes to a Python source with the table, so two
branches of a plan over one DataFrame would both read by the predicates of the second.

Paths are of file systems that all nodes mount, or HTTP addresses; archives in object stores are read by decode_files().
"""

from __future__ import annotations

import glob
import io
import itertools
import json
import os
import re
import shutil
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lamina import schema as schemas
from lamina.operators import crypto, dtype
from lamina.operators.layout import cuts_by_cost
from lamina.sources import format as codec
from lamina.sources.streams import open_stream

FORMAT = "array_archive"
CHUNK, RANGE = 2 << 20, 64 << 20
#: Rows of a batch of elements, and of metadata.
BATCH = 1 << 16


def name_of(path: tuple) -> str:
    return path[0] if len(path) == 1 and isinstance(path[0], str) else codec.encode_path(path)[1:].decode()


def path_row(path: tuple) -> list[tuple]:
    return [("key", p, None) if isinstance(p, str) else ("index", None, p) for p in path]


def path_json(path: tuple) -> str:
    return json.dumps(list(path), separators=(",", ":"), ensure_ascii=False)


def catalog_row(archive: str, ordinal: int, e: codec.Entry) -> tuple:
    numpy_dtype, torch_dtype = codec.split_dtype(e.dtype)
    size = codec.itemsize(numpy_dtype)
    numel = 1
    for d in e.shape:
        numel *= d
    return (
        archive, ordinal, name_of(e.path), path_json(e.path), path_row(e.path), e.tensor_type, numpy_dtype, torch_dtype, "V" in numpy_dtype,
        list(e.shape), numel, size, e.header_offset, e.data_offset, e.data_length, e.full_length, e.is_meta,
    )


def header_row(archive: str, ordinal: int, e: codec.Entry, r: codec.Record) -> tuple:
    crypt = None
    if r.crypt and r.crypt.scheme:
        crypt = (r.crypt.kdf, r.crypt.scheme, r.crypt.chunk_size, r.crypt.nonce, r.crypt.macs)
    return (*catalog_row(archive, ordinal, e), r.module_idx, r.header_size, r.crc32, r.sha256.hex() if r.sha256 else None, r.header_zeroed, crypt)


def open_archive(file, secret=None) -> tuple[codec.FileHeader, list[codec.Entry]]:
    """Header and index. A key for an archive that isn't encrypted is an error, as is none for one that is."""
    header = codec.read_header(file)
    return header, codec.read_index(file, header.tensor_count)


def check_mode(header: codec.FileHeader, secret) -> None:
    if header.encrypted and secret is None:
        raise crypto.CryptographyError("the archive is encrypted and no key is given")
    if not header.encrypted and secret is not None:
        raise crypto.CryptographyError("a key is given but the archive is not encrypted")


def payload(file, header: codec.FileHeader, entry: codec.Entry, secret=None, verify: bool = False) -> tuple[codec.Record, bytes]:
    """Record and plain payload of an entry; an array without data is read as zeros."""
    file.seek(entry.header_offset)
    record = codec.read_record(file, header.has_crypt, entry)
    if record is None:
        raise codec.FormatError(f"no record for {entry.path}")
    if entry.is_meta:
        return record, bytes(entry.full_length)
    file.seek(entry.data_offset)
    body = codec._exactly(file, entry.data_length)
    if record.crypt and record.crypt.scheme:
        body = crypto.opened(body, record.crypt, crypto.key_for(record.crypt, secret))
    if verify:
        codec.check_payload(record, body)
    return record, body


def rows_of(relation: str, archive: str, file, header: codec.FileHeader, chosen: list[tuple[int, codec.Entry]], secret=None, verify=False, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of a relation other than elements for chosen (ordinal, entry) pairs."""
    if relation == "archive_info":
        yield archive, header.version, header.encrypted, header.tensor_bytes, header.tensor_count
        return
    for ordinal, e in chosen:
        if relation == "catalog":
            yield catalog_row(archive, ordinal, e)
        elif relation == "reads":
            began, size = time.perf_counter(), 0
            for _, x in chosen:
                size += len(payload(file, header, x, secret, verify)[1])
            status = getattr(getattr(file, "raw", file), "cache_status", None)
            yield archive, chosen[0][0], chosen[-1][0], len(chosen), size, time.perf_counter() - began, status or None
            return
        elif relation == "headers":
            file.seek(e.header_offset)
            yield header_row(archive, ordinal, e, codec.read_record(file, header.has_crypt, e))
        else:
            _, body = payload(file, header, e, secret, verify)
            for k in range(0, len(body), chunk):
                yield archive, ordinal, name_of(e.path), k // chunk, k, body[k : k + chunk]


def element_batches(archive: str, ordinal: int, e: codec.Entry, body: bytes, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The elements of one array with their coordinates, BATCH at a time."""
    values = dtype.as_doubles(dtype.decode(body, *codec.split_dtype(e.dtype)))
    dims = np.array(e.shape, np.int64)
    strides = np.cumprod([1, *e.shape[:0:-1]], dtype=np.int64)[::-1][: len(dims)]
    for begin in range(0, len(values), BATCH):
        part = values[begin : begin + BATCH]
        at = np.arange(begin, begin + len(part), dtype=np.int64)
        coord = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(dims)), pa.array((at[:, None] // strides % dims).ravel() if len(dims) else np.zeros(0, np.int64)))
        same = lambda x, kind: pa.array([x], kind).take(pa.array(np.zeros(len(part), np.int8)))  # noqa: E731, B023
        columns = [same(archive, pa.string()), same(ordinal, pa.int32()), same(name_of(e.path), pa.string()), pa.array(at), coord, pa.array(part)]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def batches_of(
    schema: pa.Schema, relation: str, archive: str, file, header: codec.FileHeader, chosen: list[tuple[int, codec.Entry]], secret=None, verify=False, chunk: int = CHUNK
) -> Iterator[pa.RecordBatch]:
    """Arrow batches of a relation for chosen (ordinal, entry) pairs; a batch holds at most about one payload range."""
    if relation == "elements":
        for ordinal, e in chosen:
            yield from element_batches(archive, ordinal, e, payload(file, header, e, secret, verify)[1], schema)
        return
    rows, size = [], 0
    for row in rows_of(relation, archive, file, header, chosen, secret, verify, chunk):
        rows.append(row)
        size += len(row[-1]) if relation == "chunks" else 0
        if len(rows) >= BATCH or size >= RANGE // 4:
            yield _row_batch(rows, schema)
            rows, size = [], 0
    if rows:
        yield _row_batch(rows, schema)


def _row_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([_named(v, f.type) for v in c], f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _named(value, kind: pa.DataType):
    """A value with its tuples that stand for structs as dicts."""
    if pa.types.is_struct(kind) and value is not None:
        values = value if isinstance(value, tuple | list) else [getattr(value, f.name) for f in kind]
        return {f.name: _named(v, f.type) for f, v in zip(kind, values, strict=True)}
    if pa.types.is_list(kind) and value is not None:
        return [_named(v, kind.value_type) for v in value]
    return value


@dataclass
class Slice(InputPartition):
    archive: str
    ordinals: tuple[int, int]


class ArchiveReader(DataSourceReader):
    def __init__(self, relation: str, options: dict, schema: pa.Schema):
        self.relation, self.options, self.schema = relation, options, schema
        self.names = frozenset(json.loads(options["names"])) if "names" in options else None
        self.files = [f for part in options["path"].split(",") for f in (sorted(glob.glob(part)) if any(c in part for c in "*?[") else self._inside(part))]

    @staticmethod
    def _inside(path: str) -> list[str]:
        return sorted(os.path.join(path, f) for f in os.listdir(path) if not f.startswith((".", "_"))) if os.path.isdir(path) else [path]

    def _keeps(self, name: str) -> bool:
        pattern = self.options.get("nameregex")
        return (not pattern or re.match(pattern, name) is not None) and name.startswith(self.options.get("nameprefix", "")) and (self.names is None or name in self.names)

    def _secret(self):
        path = self.options.get("keyfile")
        if not path:
            return None
        with open(path, "rb") as file:
            raw = file.read()
        return raw.decode() if self.options.get("keykind") == "passphrase" else raw

    def partitions(self):
        out = []
        for archive in self.files:
            if self.relation in ("archive_info", "catalog"):
                out.append(Slice(archive, (0, 1 << 62)))
                continue
            with open_stream(archive) as file:
                header, entries = open_archive(file)
            if self.relation != "headers":
                check_mode(header, self._secret())
            chosen = [(k, e) for k, e in enumerate(entries) if self._keeps(name_of(e.path))]
            if not chosen:
                continue
            sizes = [e.full_length + 512 for _, e in chosen]
            parts = int(self.options.get("readers", 0)) or max(1, sum(sizes) // RANGE)
            for _, group in itertools.groupby(zip(chosen, cuts_by_cost(sizes, parts), strict=True), key=lambda x: x[1]):
                ordinals = [k for (k, _), _ in group]
                out.append(Slice(archive, (ordinals[0], ordinals[-1] + 1)))
        return out or [Slice("", (0, 0))]

    def read(self, partition):
        if not partition.archive:
            return
        with open_stream(partition.archive) as file:
            header, entries = open_archive(file)
            begin, end = partition.ordinals
            chosen = [(k, e) for k, e in enumerate(entries[begin:end], begin) if self._keeps(name_of(e.path))]
            verify = self.options.get("verify", "false").lower() == "true"
            yield from batches_of(self.schema, self.relation, partition.archive, file, header, chosen, self._secret(), verify, int(self.options.get("chunkbytes", CHUNK)))


@dataclass
class Part(WriterCommitMessage):
    path: str
    #: (ordinal, path, type, dtype, shape, offset in the part, header size, payload length, nonce count and first nonce)
    records: list


class ArchiveWriter(DataSourceArrowWriter):
    """Tasks encode records, digests and all, into part files; the commit sums their lengths in the order of ordinal
    into offsets, and writes header, index and records under a temporary name that becomes the archive at the end. With
    the option parts each task's records become an archive of their own, and the commit only renames the folder."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.path = local_path(options["path"])
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator):
        seal = None
        if self.options.get("encrypt", "false").lower() == "true":
            secret = ArchiveReader._secret(self)
            if secret is None:
                raise crypto.CryptographyError("encryption needs a key file")
            key, kdf = crypto.derive(secret, cost=self.options.get("cost", "moderate")) if isinstance(secret, str) else (secret, None)
            seal = crypto.sealer(key, kdf)
        os.makedirs(self.parts, exist_ok=True)
        path, records, at = f"{self.parts}/{uuid.uuid4().hex}", [], 0
        with open(path, "wb") as out:
            for r in (r for batch in iterator for r in batch.to_pylist()):
                steps = tuple(json.loads(r["path_json"])) if r.get("path_json") else (r["name"],)
                kind = r["numpy_dtype"] + (f"\0{r['torch_dtype']}" if r.get("torch_dtype") else "")
                shape, plain = tuple(r["shape"] or ()), r["data"] or b""
                size = codec.itemsize(r["numpy_dtype"])
                for d in shape:
                    size *= d
                if r["data"] is not None and len(plain) != size:
                    raise codec.FormatError(f"{steps}: {len(plain)} bytes don't fill {shape} of {kind!r}")
                body, crypt = (seal(plain) if plain else (b"", codec.Crypt())) if seal else (plain, None)
                header, head = codec.pack_record(steps, r["tensor_type"] or 0, r.get("module_idx") or 0, kind, shape, body, crypt, plain)
                out.write(header)
                out.write(body)
                nonces = (crypt.nonce, len(crypt.macs)) if crypt and crypt.scheme else None
                records.append((r["ordinal"], steps, r["tensor_type"] or 0, kind, shape, at, head, len(body), r["data"] is None and size > 0, nonces))
                at += head + len(body)
        if not self._in_parts():
            return Part(path, records)
        if records:
            self._assemble([(path, *r) for r in records], f"{path}.arr")
        os.remove(path)
        return Part("", [(0, ("nonces",), 0, "", (), 0, 0, 0, False, r[9]) for r in records if r[9]])

    def _in_parts(self) -> bool:
        return self.options.get("parts", "false").lower() == "true"

    def commit(self, messages) -> None:
        found = [m for m in messages if m is not None]
        rows = [(m.path, *r) for m in found for r in m.records]
        spans = sorted((int.from_bytes(r[10][0], "little"), r[10][1]) for r in rows if r[10])
        if any(a + n > b for (a, n), (b, _) in itertools.pairwise(spans)):
            raise crypto.CryptographyError("a nonce would be used twice")
        os.makedirs(self.parts, exist_ok=True)
        if self._in_parts():
            if os.path.isdir(self.path):
                shutil.rmtree(self.path)
            os.replace(self.parts, self.path)
            return
        made = f"{self.parts}/archive"
        self._assemble(rows, made)
        os.replace(made, self.path)
        shutil.rmtree(self.parts)

    def _assemble(self, rows: list[tuple], made: str) -> None:
        """An archive of the records (part file, *record), at the path made."""
        rows = sorted(rows, key=lambda r: r[1])
        if len({r[1] for r in rows}) != len(rows):
            raise codec.FormatError("ordinals repeat")
        encrypted = self.options.get("encrypt", "false").lower() == "true"

        def entries(begin: int) -> list[codec.Entry]:
            out = []
            for _, _, steps, kind, dt, shape, _, head, length, _, _ in rows:
                out.append(codec.Entry(steps, kind, dt, shape, begin, begin + head, length))
                begin += head + length
            return out

        # An index is as long for one begin of the records as for another.
        needed = sum(len(e.pack()) for e in entries(0))
        space = int(self.options.get("indexbytes", max(codec.INDEX_SPACE, needed)))
        if needed > space:
            raise codec.FormatError(f"metadata overflow: the index takes {needed} bytes of {space}")
        placed = entries(len(codec.MAGIC) + 60 + 8 + space)
        from lamina.operators.tree import check_paths

        check_paths([e.path for e in placed])
        version = codec.needed_version(any("\0" in e.dtype for e in placed), encrypted, any(r[9] for r in rows))
        with open(made, "wb") as out:
            out.write(codec.FileHeader(version, encrypted, sum(e.data_length for e in placed), len(placed)).pack())
            out.write(struct.pack("<Q", space) + b"".join(e.pack() for e in placed).ljust(space, b"\0"))
            files = {p: open(p, "rb") for p in {r[0] for r in rows}}  # noqa: SIM115
            try:
                for path, *_, begin, head, length, _, _ in rows:
                    files[path].seek(begin)
                    _copy(files[path], out, head + length)
            finally:
                for f in files.values():
                    f.close()
            out.write(bytes(8))

    def abort(self, messages) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


def local_path(path: str) -> str:
    """A path that open() understands; an error for stores that only Spark reads."""
    path = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" in path:
        raise ValueError(f"archives are written to mounted file systems only, not to {path}")
    return path


def _copy(source, target, n: int) -> None:
    while n:
        got = source.read(min(n, 8 << 20))
        if not got:
            raise OSError("a part file is shorter than its records")
        target.write(got)
        n -= len(got)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _options(self) -> dict:
        options = {k.lower(): v for k, v in self.options.items()}
        if options.get("compress", "false").lower() == "true":
            raise ValueError("the format has no compression")
        if "path" not in options:
            raise ValueError("a path is needed")
        return options

    def schema(self) -> str:
        relation = self.options.get("relation", "catalog")
        if relation not in schemas.RELATIONS:
            raise ValueError(f"relation {relation!r} is not among {sorted(schemas.RELATIONS)}")
        return schemas.RELATIONS[relation]

    def reader(self, schema):
        options = self._options()
        return ArchiveReader(self.options.get("relation", "catalog"), options, to_arrow_schema(schema))

    def writer(self, schema, overwrite):
        return ArchiveWriter(self._options(), overwrite)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(ArchiveSource)
    return spark


def read(spark: SparkSession, path: str, relation: str = "catalog", **options) -> DataFrame:
    """A relation of archives; names, a list, goes as JSON."""
    if "names" in options:
        options = options | {"names": json.dumps(list(options["names"]))}
    return register(spark).read.format(FORMAT).options(relation=relation, **{k: str(v) for k, v in options.items()}).load(path)


def write(arrays: DataFrame, path: str, force: bool = True, **options) -> bool:
    """Writes rows of arrays (see schema.ARRAYS, and ordinal) as one archive; without force an archive that is there and
    not empty is left alone. Whether it was written."""
    if not force and os.path.exists(path) and os.path.getsize(path):
        return False
    register(arrays.sparkSession)
    arrays.write.format(FORMAT).mode("append").options(**{k: str(v) for k, v in options.items()}).save(path)
    return True


def decode_files(files: DataFrame, relation: str = "catalog", chunk: int = CHUNK, verify: bool = False) -> DataFrame:
    """A relation of archives that Spark's own file systems read: files has path and content, as format binaryFile and
    its stream give them. Archives of up to 2 GiB, one to a row."""
    schema = to_arrow_schema(_parse_datatype_string(schemas.RELATIONS[relation]))

    def decode(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = io.BytesIO(content)
                header, entries = open_archive(file)
                yield from batches_of(schema, relation, path, file, header, list(enumerate(entries)), None, verify, chunk)

    return files.select("path", "content").mapInArrow(decode, schemas.RELATIONS[relation])


def copy(spark: SparkSession, source: str, target: str, key_file: str | None = None, new_key_file: str | None = None, **options) -> DataFrame:
    """Writes an archive again with another key, or with one or none where it had none or one, payloads read, verified
    and written by tasks; the catalog of the copy. Names, order, types and kinds stay; arrays without data stay so."""
    keyed = {"keyFile": key_file} if key_file else {}
    head = read(spark, source, "headers")
    whole = read(spark, source, "chunks", verify="true", chunkBytes=1 << 30, **keyed).select(F.col("ordinal").alias("at"), "data")
    met = head.join(whole, F.col("ordinal") == F.col("at"), "left")
    plain = F.when(F.col("is_meta"), F.lit(None).cast("binary")).otherwise(F.coalesce("data", F.lit(b"")))
    arrays = met.select(
        "ordinal", "name", "path_json", F.col("tensor_type").cast("int").alias("tensor_type"), "module_idx", "numpy_dtype", "torch_dtype", "shape", plain.alias("data")
    )
    write(arrays, target, **options, **({"encrypt": "true", "keyFile": new_key_file} if new_key_file else {}))
    return read(spark, target)

"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import itertools
import re
import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which separates words everywhere in this subpackage.
BLANK = b" \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch of documents.
BATCH_BYTES = 4 << 20
#: Bytes of a table that is broadcast at most.
BROADCAST_BYTES = 16 << 20
#: A key with more than one in so many rows is hot; there are fewer hot keys than this, whatever the table.
HOT = 2000
_ids = itertools.count()


def fresh(*stems: str, taken: list[str]) -> list[str]:
    """Column names made from the stems that clash with none of those taken (names are compared without case)."""
    used, out = {c.lower() for c in taken}, []
    for stem in stems:
        name, k = f"__{stem}", 0
        while name.lower() in used:
            k += 1
            name = f"__{stem}_{k}"
        used.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of a name, whatever its letters."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one serves only where the session names none and all runs in
    one process, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lamina-checkpoint-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """df cut from its lineage: written as Parquet under the shared folder and read again, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{next(_ids)}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made and no later plan reads, and lets Spark drop the shuffle files of plans that
    are forgotten, so that the disk holds one step's data at a time."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, getattr(df, "written_at", None)
        if path:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    gc.collect()
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def broadcast_if_small(measured: DataFrame, texts: list[str]):
    """F.broadcast if the rows of a written table, with the texts named and a hundred bytes for all else, take at most
    BROADCAST_BYTES; otherwise what gives its argument back. For tables of one row for each such row."""
    size = reduce(lambda x, y: x + y, (F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(100))
    return F.broadcast if (measured.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else (lambda df: df)


def keyed_join(rows: DataFrame, keys: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """rows joined with keys, which has one row for each key and in n how many of the total rows have it. Hot keys, of
    which there are fewer than HOT, are broadcast, so that their rows stay where they are; the others meet by shuffle."""
    much = max(1, total // HOT)
    hot = F.broadcast(keys.where(F.col(n) > much))
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(keys.where(F.col(n) <= much), on))


def salted_join(rows: DataFrame, keys: DataFrame, on: list[str], n: str, total: int, salts: int = 64) -> DataFrame:
    """What keyed_join gives, for rows that are dear to make: they are made once. Rows of hot keys are dealt to as many
    tasks as there are salts, and the hot keys, fewer than HOT, to each of them."""
    salt, hot = fresh("salt", "hot", taken=[*rows.columns, *keys.columns])
    much = max(1, total // HOT)
    few = F.broadcast(keys.where(F.col(n) > much).select(*on, F.lit(True).alias(hot)))
    dealt = rows.join(few, on, "left").withColumn(salt, F.when(F.col(hot), F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(0)).drop(hot)
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col(n) > much, salts - 1).otherwise(0).cast("bigint")))
    return dealt.join(keys.withColumn(salt, every), [*on, salt]).drop(salt)


_held: dict = {}


def held(key=None, build=None):
    """What build() makes, kept for the next call with the same key. A worker keeps one such thing at a time: another key,
    or none, lets go of it, as workers go on from operator to operator."""
    if key not in _held:
        _held.clear()
        if build is None:
            return None
        _held[key] = build()
    return _held[key]


def lean(work):
    """A function over Arrow arrays that gives back the memory it freed, which allocators would keep for a worker's life."""

    @functools.wraps(work)
    def run(*arrays):
        try:
            return work(*arrays)
        finally:
            trim()

    return run


def trim() -> None:
    """Gives memory that is free to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session to Arrow batches of BATCH_BYTES at most, a row at least. Batches are held several times over, as
    text, Python strings and results, by each worker and its JVM, and Spark's own bound suits short rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir, in a session of bounded Arrow batches."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, end to end, and the len + 1 offsets into them; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    blob = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return blob[off[0] : off[-1]], off - off[0]


def portions(texts: pa.Array, most_bytes: int = 4 << 20, most_rows: int = 1 << 14):
    """Consecutive (begin, end) runs of rows of at most about most_bytes of text and most_rows each, one row at least."""
    lengths = np.asarray(pc.binary_length(texts).fill_null(0).cast(pa.int64()))
    begin, total = 0, 0
    for k, n in enumerate(lengths):
        if k > begin and (total + n > most_bytes or k - begin >= most_rows):
            yield begin, k
            begin, total = k, 0
        total += int(n)
    if begin < len(lengths):
        yield begin, len(lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit numbers (xor-shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)



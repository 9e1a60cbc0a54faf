"""Lines that many documents share: all but one document lose them.

Documents are exploded into lines, lines are normalised to keys and the keys hashed (128 bits), once: the hashes are
written and read twice. Distinct documents are counted per hash in two combined steps, (hash, document) and then hash,
so a line that sits in a third of all documents is summed where it is read. Hashes over the threshold are joined back to
the written rows, the few that make up much of all rows by broadcast and the others by shuffle, and the positions to
drop are gathered per document, which then is reassembled from the lines that stay, in order.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.util import fresh, held, keyed_join, portions, quoted, table, trim, written

MIN_CHARS, MIN_DOCUMENTS = 20, 3
_BLANKS = " \t\n\x0b\x0c\r"

KEYED = "doc_id {kind}, of bigint, pos int, h binary"


def line_keys(texts: pa.Array, least_chars: int = MIN_CHARS):
    """(row, position, hash of the key) of every line of a string array whose key has least_chars code points."""
    lines = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    row, flat = pc.list_parent_indices(lines), pc.list_flatten(lines)
    counts = pc.fill_null(pc.list_value_length(lines), 0)
    first = pc.subtract(pc.cumulative_sum(counts), counts)
    keys = pc.ascii_trim(flat, _BLANKS)
    long = pc.indices_nonzero(pc.greater_equal(pc.utf8_length(keys), least_chars))
    row = row.take(long)
    pos = pc.subtract(long.cast(pa.int64()), first.cast(pa.int64()).take(row))
    # ascii_lower changes A-Z alone.
    keys = pc.ascii_lower(keys.take(long)).cast(pa.large_binary())
    return row, pos, pa.array([xxhash.xxh3_128_digest(k) for k in keys.to_pylist()], pa.binary())


def _hashed(batches, least_chars: int):
    held()
    for batch in batches:
        ids, of, texts = batch.column(0), batch.column(1), batch.column(2)
        for begin, end in portions(texts):
            row, pos, h = line_keys(texts.slice(begin, end - begin), least_chars)
            yield pa.RecordBatch.from_arrays([ids.slice(begin, end - begin).take(row), of.slice(begin, end - begin).take(row), pos.cast(pa.int32()), h], ["doc_id", "of", "pos", "h"])
        trim()


def drop_shared_lines(docs: DataFrame, least_documents: int = MIN_DOCUMENTS, least_chars: int = MIN_CHARS) -> DataFrame:
    """docs with text replaced by its lines that stay and two more columns, ``n_lines`` (before) and ``n_dropped``
    (columns of these names in docs are replaced).

    A key of at least least_chars code points found in at least least_documents distinct doc_ids loses all its lines
    except in the largest doc_id that holds it (there all of them stay). Null or empty text is one empty line, and its
    text becomes empty. Rows without doc_id are not counted and keep all lines. Rows that repeat a doc_id count as one
    document, and each of them loses its own lines with the key, or none if it is the largest. Other columns pass
    through, whatever their names. An empty table gives an empty result; a very long text is split whole, one at a time.
    Whole documents pass one shuffle, on (doc_id, hash of text).
    """
    docs = docs.drop("n_lines", "n_dropped")
    key_id, key_of, dropped = fresh("id", "of", "drop", taken=docs.columns)
    asked = docs.where("doc_id IS NOT NULL AND text <> ''").select("doc_id", F.xxhash64("text").alias("of"), "text")
    hashed = written(asked.mapInArrow(lambda batches: _hashed(batches, least_chars), KEYED.format(kind=docs.schema["doc_id"].dataType.simpleString())), "lines")
    seen = hashed.groupBy("h", "doc_id").agg(F.count(F.lit(1)).alias("rows")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("stays"), F.sum("rows").alias("rows"))
    shared = written(seen.where(F.col("n") >= least_documents).select("h", "stays", "rows"), "shared")
    gone = keyed_join(hashed, shared, ["h"], "rows", hashed.count()).where("doc_id <> stays")
    gone = gone.groupBy(F.col("doc_id").alias(key_id), F.col("of").alias(key_of)).agg(F.collect_set("pos").alias(dropped))
    met = docs.join(gone, (F.col("doc_id") == F.col(key_id)) & (F.xxhash64("text") == F.col(key_of)), "left")
    # Texts that keep all lines don't leave the JVM; the others take time in proportion to their lines.
    stay = F.coalesce(_reassemble(F.when(F.col(dropped).isNotNull(), F.col("text")), F.col(dropped)), F.col("text"), F.lit(""))
    return met.select(
        *(quoted(c) if c != "text" else stay.alias("text") for c in docs.columns),
        (F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"))) + 1).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(dropped), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


@F.arrow_udf(T.StringType())
def _reassemble(texts: pa.Array, dropped: pa.Array) -> pa.Array:
    """Texts without the lines at the positions dropped; null for a null text."""
    out = []
    for text, positions in zip(texts, dropped, strict=True):
        gone = set(positions.as_py()) if text.is_valid else None
        out.append(None if gone is None else "\n".join([line for k, line in enumerate(text.as_py().split("\n")) if k not in gone]))
    return pa.array(out, pa.string())


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents, in the cases of drop_shared_lines."""
    kept = drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))

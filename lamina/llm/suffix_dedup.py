"""Exact removal of byte passages that also stand earlier in the corpus.

1. Every document's anchors (see anchors) are counted by the hash of their bytes; anchors of hashes that occur once
   are forgotten. A passage of ``length`` bytes that occurs twice has an anchor, with the passage in its context.
2. Anchors with equal contexts form a class; the first of a class in corpus order represents it. The contexts of all
   others are repeats as a whole.
3. Classes of one hash but different contexts share a part at most. Their representatives' contexts are read from the
   text and sent to the task of their hash, sorted by it. There each hash's suffixes become an enhanced suffix array,
   whose common-prefix interval tree gives the maximal repeats with all their occurrences (see repeats); all but the
   first occurrence of each go.
4. Hashes with more than CROWD classes, such as the edge of a passage that a third of all documents quote, are never
   gathered: their contexts are cut into stretches of ``length`` bytes, the roots of the interval trees, and the first
   place of each is found by aggregation.

Corpus order is (doc_id, text hash, position).
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.anchors import GRAM, anchors, text_anchors
from lamina.llm.repeats import maximal_groups
from lamina.llm.shingles import prefix_hash, range_hash
from lamina.llm.util import discard, held, keyed_join, portions, salted_join, table, trim, utf8, written

LENGTH = 100
#: Most classes of one hash that one task gathers (1.4 MB of contexts).
CROWD = 8192
#: Bytes of text whose hashes a worker holds at once, about: some twenty arrays of eight bytes for each.
PORTION = 1 << 18
#: Stands for a null doc_id.
NO_ID = -(1 << 63)


def tag(text: str | None) -> int:
    """31 bits of a text, to tell apart rows of one doc_id."""
    return zlib.crc32((text or "").encode("utf-8", "surrogatepass")) >> 1


def _anchor_rows(batches, length: int, full: bool):
    held()
    for batch in batches:
        docs, texts, tags = batch.column(0), batch.column(1), batch.column(2)
        for begin, end in portions(texts, PORTION):
            blob, off = utf8(texts.slice(begin, end - begin))
            parts = text_anchors(blob, length, PORTION) if end - begin == 1 else [anchors(blob, off, length)]
            own = tags.to_numpy(zero_copy_only=False)[begin:end].astype(np.int64) if full else None
            for text, at, gram, context, _, _ in parts:
                columns = {"g": gram.view(np.int64)}
                if full:
                    columns |= {"c": context.view(np.int64), "doc": docs.to_numpy(zero_copy_only=False)[begin:end][text].astype(np.int64), "at": (own[text] << 32) + at}
                yield pa.RecordBatch.from_pydict(columns)
        trim()


def _anchor_table(docs: DataFrame, length: int, full: bool) -> DataFrame:
    schema = "g long, c long, doc long, at long" if full else "g long"
    return docs.mapInArrow(lambda batches: _anchor_rows(batches, length, full), schema)


def _flat(lists: pa.Array):
    """(row of each member, members) of a list array; members of structs as arrays by name, as 64-bit numbers."""
    lengths = np.asarray(pc.list_value_length(lists).fill_null(0).cast(pa.int64()))
    members, row = lists.flatten(), np.repeat(np.arange(len(lists)), lengths)
    number = lambda x: np.asarray(x.cast(pa.int64()).to_numpy(zero_copy_only=False), np.int64)
    if pa.types.is_struct(members.type):
        return row, {f.name: number(c) for f, c in zip(members.type, members.flatten(), strict=True)}
    return row, number(members)


def _union(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of intervals in each row, touching ones joined, in order."""
    if not len(row):
        return row, begin, end
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order], end[order]
    # Rows are laid out one after another, so that one running maximum serves them all.
    shift = row * (int(end.max()) + 2)
    upto = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], begin[1:] + shift[1:] > upto[:-1]])
    at = np.flatnonzero(new)
    return row[at], begin[at], (upto - shift)[np.append(at[1:], len(row)) - 1]


def _context(size: int, at: int, length: int) -> tuple[int, int]:
    return max(0, at - (length - GRAM)), min(size, at + length)


SPAN = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _by_group(batches, length: int):
    """Spans that repeat, from contexts (g, doc, at, left, right) sorted by g; a group's rows may span batches."""
    g, rows = None, []

    def close():
        rows.sort(key=lambda r: (r[0], r[1]))
        reach: dict[int, tuple[int, int]] = {}
        for behind, ahead, members in maximal_groups([r[3] for r in rows], [r[2] for r in rows], length):
            first = min(members)
            for k in members:
                if k != first:
                    # All repeats of a member hold its anchor, so together they are one span.
                    most = reach.get(k, (0, 0))
                    reach[k] = (max(behind, most[0]), max(ahead, most[1]))
        for k, (behind, ahead) in reach.items():
            doc, at = rows[k][:2]
            yield doc, at >> 32, (at & 0xFFFFFFFF) - behind, (at & 0xFFFFFFFF) + ahead

    out = []
    for batch in batches:
        for key, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if key != g:
                out.extend(close())
                g, rows = key, []
            rows.append(row)
            if len(out) > 50_000:
                yield _span_batch(out)
                out = []
    out.extend(close())
    yield _span_batch(out)


def _span_batch(rows) -> pa.RecordBatch:
    a = np.array(rows, np.int64).reshape(-1, 4)
    return pa.RecordBatch.from_pydict({n: a[:, k] for k, n in enumerate(("doc", "tag", "begin", "end"))})


def _stretches(batches, length: int):
    """(g, hash, doc, at, begin) of every stretch of length bytes of contexts (g, doc, at, left, right)."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for g, doc, at, left, right in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            blob = np.frombuffer(left + right, np.uint8)
            begin = np.arange(len(blob) - length + 1)
            out[0].append(np.full(len(begin), g))
            out[1].append(range_hash(prefix_hash(blob), begin, begin + length).view(np.int64))
            out[2].append(np.full(len(begin), doc))
            out[3].append(at - len(left) + begin)
        yield pa.RecordBatch.from_pydict({n: np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for n, x in zip(("g", "h", "doc", "at"), out, strict=True)})


def _ready(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text, tag): doc_id with a number for null, and what tells apart rows that repeat one."""
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "doc_id", "text").withColumn("tag", F.expr("shiftright(crc32(CAST(coalesce(text, '') AS BINARY)), 1)"))


def _anchored(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame, int]:
    """Written tables of the anchors (g, c, doc, at) of docs(doc, tag, text) whose bytes occur more than once, and of
    their classes (g, c, n, first), and how many anchors there are."""
    lean = docs.select("doc", "text", "tag")
    often = written(_anchor_table(lean, length, False).groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    discard(docs)
    total = often.agg(F.sum("n")).first()[0] or 0
    rows = written(salted_join(_anchor_table(lean, length, True), often, ["g"], "n", total).select("g", "c", "doc", "at"), "anchors")
    discard(often)
    classes = written(rows.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "at")).alias("first")), "classes")
    discard(docs)
    return rows, classes, total


def marked(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(i_doc, i_tag, whole, parts) for the documents of docs(doc, tag, text) that hold repeats: the positions of the
    anchors whose contexts repeat as a whole, and (position, hash, whether the hash is crowded) of those to compare with
    other contexts."""
    rows, classes, total = _anchored(docs, length)
    sizes = classes.groupBy("g").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    later = keyed_join(rows, classes.where("n > 1").select("g", "c", "first", "n"), ["g", "c"], "n", total).where("doc <> first.doc OR at <> first.at").select("doc", "at", F.lit(False).alias("asks"))
    asks = keyed_join(classes.select("g", "first"), sizes, ["g"], "classes", classes.count()).select("first.doc", "first.at", F.lit(True).alias("asks"), "g", (F.col("classes") > CROWD).alias("crowd"))
    marks = later.select("doc", "at", "asks", F.lit(None).cast("long").alias("g"), F.lit(False).alias("crowd")).unionByName(asks)
    info = marks.selectExpr("doc AS i_doc", "shiftright(at, 32) AS i_tag", "CAST(at & 4294967295 AS INT) AS p", "asks", "g", "crowd").groupBy("i_doc", "i_tag").agg(
        F.collect_list(F.when(~F.col("asks"), F.col("p"))).alias("whole"),
        F.collect_list(F.when(F.col("asks"), F.struct("p", "g", "crowd"))).alias("parts"),
    )
    info = written(info, "marks")
    discard(rows, classes)
    return info


PIECE = T.ArrayType(
    T.StructType([T.StructField("g", T.LongType()), T.StructField("at", T.LongType()), T.StructField("left", T.BinaryType()), T.StructField("right", T.BinaryType()), T.StructField("crowd", T.BooleanType())])
)


def _pieces(length: int):
    @F.arrow_udf(PIECE)
    def cut(texts: pa.Array, tagged: pa.Array, parts: pa.Array) -> pa.Array:
        out = []
        for text, t, asked in zip(texts, tagged.to_pylist(), parts.to_pylist(), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass") if asked else b""
            rows = []
            for x in asked or ():
                a, b = _context(len(raw), x["p"], length)
                rows.append({"g": x["g"], "at": (t << 32) + x["p"], "left": raw[a : x["p"]], "right": raw[x["p"] : b], "crowd": x["crowd"]})
            out.append(rows)
        return pa.array(out, pa.list_(pa.struct([("g", pa.int64()), ("at", pa.int64()), ("left", pa.binary()), ("right", pa.binary()), ("crowd", pa.bool_())])))

    return cut


CUT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("spans", SPAN), T.StructField("kept", T.BinaryType()), T.StructField("kept_sha256", T.StringType())])


def _cutter(length: int, keep: bool):
    @F.arrow_udf(CUT)
    def cut(texts: pa.Array, whole: pa.Array, more: pa.Array) -> pa.Array:
        raws = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.array([len(r) for r in raws], np.int64)
        row, place = _flat(whole)
        more_row, found = _flat(more)
        begin = np.concatenate([np.maximum(place - (length - GRAM), 0), found["begin"]])
        end = np.concatenate([np.minimum(place + length, sizes[row]), found["end"]])
        row, begin, end = _union(np.concatenate([row, more_row]), begin, end)
        first = np.searchsorted(row, np.arange(len(raws) + 1))
        out = []
        for k, raw in enumerate(raws):
            spans = list(zip(begin[first[k] : first[k + 1]].tolist(), end[first[k] : first[k + 1]].tolist(), strict=True))
            rest, at = [], 0
            for a, b in spans:
                rest.append(raw[at:a])
                at = b
            kept = b"".join([*rest, raw[at:]])
            out.append({"n_bytes": len(raw), "spans": [{"begin": a, "end": b} for a, b in spans], "kept": kept if keep else None, "kept_sha256": hashlib.sha256(kept).hexdigest()})
        fields = [("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary()), ("kept_sha256", pa.string())]
        return pa.array(out, pa.struct(fields))

    return cut


def cut_repeats(docs: DataFrame, length: int = LENGTH, keep: bool = True) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, kept_sha256) for every row of docs(doc_id, text): the byte spans removed, in order,
    and the bytes that remain (null unless keep).

    A byte goes if a string of length bytes that covers it also starts earlier: in a smaller doc_id, or earlier in the
    same document. Strings are judged on the input and never cross documents. Null text is empty. A null doc_id comes
    before all others. Rows that repeat a doc_id with another text come in the order of a hash of their texts; rows
    that repeat both are one document and lose the same bytes. Texts shorter than length lose nothing. An empty table
    gives an empty result. Very long texts are hashed in steps. Positions within a text are below 2**31.
    """
    ready = _ready(docs)
    info = marked(ready, length)
    here = (F.col("doc") == F.col("i_doc")) & (F.col("tag") == F.col("i_tag"))
    asking = ready.join(info.where("size(parts) > 0").select("i_doc", "i_tag", "parts"), here)
    pieces = written(asking.select("doc", F.explode(_pieces(length)("text", "tag", "parts")).alias("x")).select("x.g", "doc", "x.at", "x.left", "x.right", "x.crowd"), "contexts")
    discard(docs)
    columns = ["g", "doc", "at", "left", "right"]
    grouped = pieces.where("NOT crowd").select(*columns).repartition("g").sortWithinPartitions("g")
    found = grouped.mapInArrow(lambda batches: _by_group(batches, length), "doc long, tag long, begin long, end long")
    crowded = pieces.where("crowd").select(*columns).mapInArrow(lambda batches: _stretches(batches, length), "g long, h long, doc long, at long")
    firsts = written(crowded.groupBy("g", "h").agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
    repeats = salted_join(crowded, firsts, ["g", "h"], "n", firsts.agg(F.sum("n")).first()[0] or 0).where("doc <> first.doc OR at <> first.at")
    repeats = repeats.selectExpr("doc", "shiftright(at, 32) AS tag", "at & 4294967295 AS begin", f"(at & 4294967295) + {length} AS end")
    more = found.unionByName(repeats).groupBy(F.col("doc").alias("m_doc"), F.col("tag").alias("m_tag")).agg(
        F.collect_set(F.struct(F.col("begin").cast("int").alias("begin"), F.col("end").cast("int").alias("end"))).alias("more")
    )
    all_ = info.select("i_doc", "i_tag", "whole").join(more, (F.col("i_doc") == F.col("m_doc")) & (F.col("i_tag") == F.col("m_tag")), "left")
    spans = written(all_.select("i_doc", "i_tag", "whole", "more"), "spans")
    discard(pieces, info, firsts)
    met = ready.join(spans, here, "left")
    return met.select("doc_id", _cutter(length, keep)("text", "whole", "more").alias("c")).select("doc_id", "c.*")


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, begin, end): every removed span; see cut_repeats."""
    return cut_repeats(docs, length, keep=False).select("doc_id", F.inline("spans"))


GROUPS = "bytes binary, g long, doc long, at long, behind int, ahead int"


def _group_members(batches, length: int):
    """(digest of the bytes, g, doc, at, left and right extension) of every member of the maximal repeats among contexts
    (g, doc, at, left, right, crowd) sorted by g, whole contexts included; of crowded hashes the members of the roots."""
    g, rows, out = None, [], []

    def add(row, behind, ahead):
        doc, at, left, right, _ = row
        out.append((hashlib.md5(left[len(left) - behind :] + right[:ahead]).digest(), g, doc, at, behind, ahead))

    def close():
        for row in rows:
            add(row, len(row[2]), len(row[3]))
        for behind, ahead, members in maximal_groups([r[3] for r in rows], [r[2] for r in rows], length):
            for k in members:
                add(rows[k], behind, ahead)

    def batch_of():
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["bytes", "g", "doc", "at", "behind", "ahead"])

    for batch in batches:
        for key, *row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if key != g:
                close()
                g, rows = key, []
            if row[4]:
                for behind in range(max(0, length - len(row[3])), min(len(row[2]), length - GRAM) + 1):
                    add(row, behind, length - behind)
                add(row, len(row[2]), len(row[3]))
            else:
                rows.append(row)
            if len(out) > 50_000:
                yield batch_of()
                out = []
    close()
    yield batch_of()


def maximal_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(repeat, doc_id, begin, end) of every occurrence, the first included, of every maximal repeat of at least length
    bytes in docs(doc_id, text); repeat is a digest of its bytes.

    Repeats are maximal within the contexts of their anchors (see anchors): no byte can be added on either side, within
    length - GRAM bytes before and length after an anchor, without losing an occurrence. So each string of length bytes
    that occurs twice lies in a repeat with exactly its occurrences, and a longer passage is a chain of overlapping
    repeats. Of hashes with more than CROWD contexts the strings of length bytes themselves, and whole contexts, are
    given. The cases of cut_repeats hold; rows that repeat doc_id and text are one document.
    """
    ready = _ready(docs).distinct()
    rows, classes, _ = _anchored(ready, length)
    sizes = classes.groupBy("g").agg(F.count(F.lit(1)).alias("classes"))
    asked = keyed_join(classes, sizes, ["g"], "classes", classes.count()).where("n > 1 OR classes > 1")
    parts = asked.selectExpr("first.doc AS i_doc", "shiftright(first.at, 32) AS i_tag", f"struct(CAST(first.at & 4294967295 AS INT) AS p, g, classes > {CROWD} AS crowd) AS part")
    parts = parts.groupBy("i_doc", "i_tag").agg(F.collect_list("part").alias("parts"))
    met = ready.join(parts, (F.col("doc") == F.col("i_doc")) & (F.col("tag") == F.col("i_tag")))
    pieces = met.select("doc", F.explode(_pieces(length)("text", "tag", "parts")).alias("x")).select("x.g", "doc", "x.at", "x.left", "x.right", "x.crowd")
    # Contexts of a crowded hash need not meet: they are dealt by document.
    dealt = pieces.repartition(F.col("g"), F.when(F.col("crowd"), F.xxhash64("doc", "at"))).sortWithinPartitions("g")
    members = dealt.mapInArrow(lambda batches: _group_members(batches, length), GROUPS)
    first = classes.select(F.col("g").alias("c_g"), "c", F.col("first.doc").alias("c_doc"), F.col("first.at").alias("c_at"))
    of_class = members.join(first, (F.col("g") == F.col("c_g")) & (F.col("doc") == F.col("c_doc")) & (F.col("at") == F.col("c_at"))).select("bytes", "behind", "ahead", "c_g", "c")
    every = of_class.join(rows, (F.col("c_g") == F.col("g")) & (of_class["c"] == rows["c"]))
    place = every.selectExpr("bytes", "doc", "shiftright(at, 32) AS tag", "CAST(at & 4294967295 AS INT) - behind AS begin", "CAST(at & 4294967295 AS INT) + ahead AS end").distinct()
    place = written(place, "occurrences")
    many = place.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = keyed_join(place, many, ["bytes"], "n", place.count())
    return kept.select(F.hex("bytes").alias("repeat"), F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "begin", "end")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents, in the cases of cut_repeats."""
    cut = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")

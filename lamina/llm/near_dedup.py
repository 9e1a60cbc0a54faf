"""Near duplicates by BagMinHash: signatures of weighted shingle bags, bands, and an exact check of multiset overlap.

Signatures. A shingle that occurs w times is the weight range (0, w], cut at powers of two: (0, 1], (1, 2], (2, 4] ...
On each piece runs a Poisson process of points whose rate is the piece's width; every point has a time, a place in
the signature and, found by halving the piece again and again, a weight. Points above w don't count. A place of the
signature keeps its earliest point. The points depend only on shingle, piece and number, so two bags agree in a place
with a probability equal to their weighted Jaccard similarity. Points are generated in order of time and only up to
the time by which all places are almost surely filled; bags for which that fails go on to twice the time.

Classes. Documents with the same words are one node from the start. Nodes that share a band meet in a bucket. In each
bucket everyone is compared with its leader, the node that meets most others in all its buckets, such as the original
of many edited copies. Multisets of shingles are compared exactly, as sorted 64-bit hashes of (shingle, occurrence),
which are made once for each node that meets another. Where a bucket still holds nodes of different components, the
nodes outside its largest component are compared with all others in blocks of bounded size: no pair is made that isn't a
link, and no bucket has to fit into a task.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.graph import components
from lamina.llm.shingles import shingle_hashes, word_hashes
from lamina.llm.util import discard, fresh, held, lean, mix64, portions, quoted, table, utf8, written

SHINGLE, SIMILARITY = 5, 0.8
PLACES, BANDS, ROWS = 128, 25, 5
#: Pairs whose signatures agree in fewer places are not compared: of 128 places 102.4 agree in the mean at 0.8, with a
#: deviation of 4.5, so a link is lost here with a probability below 1e-15, and by the bands with 5e-5.
LEAST_AGREE = 64
#: Points made at once while signatures are built.
BLOCK = 1 << 18
#: Nodes, and shingles of all nodes, on either side of a block of comparisons, about.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1 << 20


def signatures(text: np.ndarray, hashes: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """(n, places) 32-bit names of the earliest points, for bags given as (text, hash) of every shingle; 0 for empty bags."""
    if not len(text):
        return np.zeros((n, places), np.uint32)
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(text)))
    text, hashes = text[at], hashes[at]
    total = np.bincount(text, weight, n)
    # One process for each piece (0, 1], (1, 2], (2, 4] ... that begins below the weight.
    owner, seed, width, bound = [text], [hashes], [np.ones(len(text), np.int64)], [weight]
    low = 1
    while (wide := np.flatnonzero(weight > low)).size:
        owner.append(text[wide])
        seed.append(mix64(hashes[wide] + np.uint64(low)))
        width.append(np.full(len(wide), low))
        bound.append(weight[wide] - low)
        low *= 2
    owner, seed, width, bound = map(np.concatenate, (owner, seed, width, bound))
    names = np.zeros(n * places, np.uint32)
    open_, margin = np.flatnonzero(total > 0), 4.0
    while len(open_):
        until = np.zeros(n)
        until[open_] = (np.log(places) + margin) * places / total[open_]
        when = np.full(n * places, np.inf)
        mine = np.flatnonzero(until[owner] > 0)
        for begin in range(0, len(mine), BLOCK):
            _fill(mine[begin : begin + BLOCK], owner, seed, width, bound, until, when, names, places)
        filled = np.isfinite(when.reshape(n, places)).all(axis=1)
        open_, margin = open_[~filled[open_]], margin * 2 + 8
    return names.reshape(n, places)


def _fill(active, owner, seed, width, bound, until, when, names, places) -> None:
    time, number, shift = np.zeros(len(active)), 0, (48 - np.log2(width).astype(np.int64)).astype(np.uint64)
    while len(active):
        step = int(np.clip(BLOCK // len(active), 1, 256))
        draw = mix64(seed[active][:, None] + (np.arange(number, number + step, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(1)))
        gaps = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[active][:, None]
        times = time[:, None] + np.cumsum(gaps, axis=1)
        more = mix64(draw ^ np.uint64(0xE7037ED1A0B428DB))
        # Halving a piece of width 2**k takes the first k of 48 bits; the other 16 choose the place.
        level = (more >> np.uint64(16) >> shift[active][:, None]).astype(np.int64)
        counts = (times <= until[owner[active]][:, None]) & (level < bound[active][:, None])
        slot = (owner[active][:, None] * places + (more & np.uint64(0xFFFF)).astype(np.int64) % places)[counts]
        t, name = times[counts], (draw[counts] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        np.minimum.at(when, slot, t)
        first = when[slot] == t
        names[slot[first]] = name[first]
        number += step
        on = times[:, -1] <= until[owner[active]]
        active, time = active[on], times[on, -1]


def bands_of(names: np.ndarray) -> np.ndarray:
    """(n, BANDS) 64-bit keys, each of its own ROWS places."""
    out = np.zeros((len(names), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + names[:, k : BANDS * ROWS : ROWS])
    return out.view(np.int64)


SKETCH_TYPE = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("names", T.BinaryType())])


@F.arrow_udf(SKETCH_TYPE)
@lean
def sketch(texts: pa.Array) -> pa.Array:
    """128 bits of the words of each text, as CONTENT gives them, and its bands and signature."""
    held()
    nodes, bands, names = [], [], []
    for begin, end in portions(texts, 1 << 19):
        part = texts.slice(begin, end - begin)
        blob, off = utf8(part)
        raw = memoryview(blob)
        nodes += [hashlib.md5(b" ".join(bytes(raw[a:b]).split())).digest() for a, b in zip(off, off[1:], strict=False)]
        text, hashes = shingle_hashes(*word_hashes(blob, off), SHINGLE)
        some = np.bincount(text, minlength=end - begin) > 0
        signs = signatures(text, hashes, end - begin)
        keys = bands_of(signs)
        bands += [keys[k] if some[k] else [] for k in range(end - begin)]
        names += [row.astype(np.uint16).tobytes() for row in signs]
    return pa.StructArray.from_arrays([pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(names, pa.binary())], ["node", "bands", "names"])


@F.arrow_udf(T.IntegerType())
def agreeing(a: pa.Array, b: pa.Array) -> pa.Array:
    """In how many places two signatures agree."""
    x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint16).reshape(-1, PLACES) for s in (a, b))
    return pa.array((x == y).sum(axis=1).astype(np.int32))


def bag(text: str) -> Counter:
    words = text.encode("utf-8", "surrogatepass").split()
    if len(words) < SHINGLE:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*(words[k:] for k in range(SHINGLE)), strict=False))


def overlap(a: Counter, b: Counter) -> tuple[int, int]:
    """Sizes of the intersection and the union of two multisets."""
    if len(b) < len(a):
        a, b = b, a
    common = sum(min(n, b[g]) for g, n in a.items() if g in b)
    return common, a.total() + b.total() - common


@F.arrow_udf(T.BooleanType())
def similar(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether two multisets of shingles, as elements() gives them, have a Jaccard similarity of SIMILARITY or more."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
        x, y = (x, y) if len(x) < len(y) else (y, x)
        common = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x) if len(y) else 0
        out.append(100 * common >= round(100 * SIMILARITY) * (len(x) + len(y) - common))
    return pa.array(out, pa.bool_())


#: 128 bits of the words of a text, as SQL: blanks of any kind and number count as one.
CONTENT = r"unhex(md5(trim(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' '))))"


def content_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (doc_id, node) of every row of docs(doc_id, text), and (node, own, class_id, first): for every
    distinct content the least doc_id that has it, the least doc_id of its class and the least content of its class.
    Works as near_classes describes."""
    rows = written(docs.select("doc_id", sketch("text").alias("s")).select("doc_id", "s.node", "s.bands", "s.names"), "sketches")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("own"), F.min_by(F.struct("bands", "names"), F.struct("doc_id")).alias("s"))
    nodes = written(nodes.select("node", "own", "s.bands", "s.names"), "nodes")
    of_rows = rows.select("doc_id", "node")
    keys = nodes.where("size(bands) > 0").select("node", F.explode("bands").alias("key"))
    shared = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys")
    # Rows of a key are few columns wide, and AQE splits the partitions of hot keys.
    buckets = written(keys.join(shared, "key"), "buckets")
    if buckets.isEmpty():
        classes = written(nodes.select("node", "own", F.col("own").alias("class_id"), F.col("node").alias("first")), "classes")
        discard(nodes, shared, buckets)
        return of_rows, classes
    wanted = nodes.join(buckets.select("node").distinct(), "node").select(F.col("node").alias("of"), "own")
    texts = docs.select("doc_id", F.expr(CONTENT).alias("node"), "text").join(wanted, (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("own")))
    # Repeated rows of a document only repeat its pairs, which are made distinct below.
    bags = written(texts.select("node", elements("text").alias("e")), "bags")

    def check(pairs: DataFrame) -> DataFrame:
        """Those of pairs(a, b) that are links."""
        left, right = (nodes.select(F.col("node").alias(x), F.col("names").alias(f"names_{x}")) for x in "ab")
        near = written(pairs.join(left, "a").join(right, "b").where(agreeing("names_a", "names_b") >= LEAST_AGREE).select("a", "b"), "near")
        left, right = (bags.select(F.col("node").alias(x), F.col("e").alias(f"e_{x}")) for x in "ab")
        found = written(near.join(left, "a").join(right, "b").where(similar("e_a", "e_b")).select("a", "b").distinct(), "found")
        discard(near)
        return found

    meets = buckets.groupBy("node").agg(F.sum("n").alias("met"))
    leaders = buckets.join(meets, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("top")).selectExpr("key", "top.node AS a")
    led = buckets.join(leaders, "key").where("node <> a")
    links = check(led.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct())
    known = written(buckets.join(components(links), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "known")
    more = written(_block_links(known, bags), "more")
    labels = components(links.unionByName(more))
    least = nodes.join(labels, "node").groupBy("component").agg(F.min("own").alias("least"), F.min("node").alias("least_node"))
    classes = nodes.join(labels, "node", "left").join(least, "component", "left")
    classes = written(classes.select("node", "own", F.coalesce("least", "own").alias("class_id"), F.coalesce("least_node", "node").alias("first")), "classes")
    discard(nodes, shared, buckets, bags, links, known, more, labels)
    return of_rows, classes


@F.arrow_udf(T.BinaryType())
@lean
def elements(texts: pa.Array) -> pa.Array:
    """The multiset of shingles of each text as a sorted array of 64-bit hashes of (shingle, number of the occurrence)."""
    out = []
    for begin, end in portions(texts, 1 << 19):
        text, hashes = shingle_hashes(*word_hashes(*utf8(texts.slice(begin, end - begin))), SHINGLE)
        order = np.lexsort((hashes, text))
        text, hashes = text[order], hashes[order]
        new = np.concatenate([[True], (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])])[: len(text)]
        run = np.maximum.accumulate(np.where(new, np.arange(len(text)), 0))
        own = mix64(hashes + (np.arange(len(text)) - run).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.lexsort((own, text))
        bounds = np.searchsorted(text, np.arange(end - begin + 1))
        out += [own[order][a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
    return pa.array(out, pa.binary())


def _block_links(known: DataFrame, bags: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of different components that share a bucket of known(key, node, component): for each
    node outside a bucket's largest component the most similar of the linked nodes of every other component."""
    mixed = known.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    size = bags.select(F.col("node").alias("of"), F.expr("CAST(octet_length(e) div 8 AS BIGINT)").alias("size"))
    members = written(known.join(mixed, "key").join(size, F.col("node") == F.col("of")).drop("of"), "mixed")
    sums = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    # Blocks of members and, of those outside the largest component, of nodes that look for links.
    blocks = lambda n, size: f"CAST(greatest(ceil({n} / {BLOCK_NODES}), ceil({size} / {BLOCK_SHINGLES})) AS INT)"
    plan = sums.groupBy("key").agg(F.max(F.struct("n", "component", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    plan = plan.selectExpr("key", "top.component AS top", f"{blocks('n', 'size')} AS rows", f"{blocks('(n - top.n)', '(size - top.size)')} AS columns")
    placed = members.select("key", "node", "component").join(plan, "key").selectExpr(
        "*", "CAST(pmod(xxhash64(node, key), rows) AS INT) AS r", "CAST(pmod(xxhash64(key, node), columns) AS INT) AS c", "component <> top AS looks", "rows * columns = 1 AS alone"
    )
    there = placed.selectExpr("key", "r", "explode(sequence(0, columns - 1)) AS c", "node", "component", "looks AND alone AS looks", "true AS member")
    asking = placed.where("looks AND NOT alone").selectExpr("key", "explode(sequence(0, rows - 1)) AS r", "c", "node", "component", "looks", "false AS member")
    loaded = there.unionByName(asking).join(bags.select(F.col("node").alias("of"), "e"), F.col("node") == F.col("of")).drop("of")
    dealt = loaded.repartition("key", "r", "c").sortWithinPartitions("key", "r", "c")
    return dealt.select("key", "r", "c", "node", "component", "looks", "member", "e").mapInArrow(_compare_blocks, "a binary, b binary").distinct()


def _compare_blocks(batches):
    """Rows sorted by block; a block's rows may span batches."""
    block, rows = None, []
    for batch in batches:
        found: list[tuple[bytes, bytes]] = []
        for key, r, c, *row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
            if (key, r, c) != block:
                found += _links_in(rows)
                block, rows = (key, r, c), []
            rows.append(row)
        yield _link_batch(found)
    yield _link_batch(_links_in(rows))


def _link_batch(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])


def _links_in(rows) -> list[tuple[bytes, bytes]]:
    members = [r for r in rows if r[3]]
    if len(members) < 1:
        return []
    sets = [np.frombuffer(r[4], np.uint64) for r in members]
    sizes = np.array([len(x) for x in sets])
    everything, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    names: dict[bytes, int] = {}
    component = np.array([names.setdefault(r[1], len(names)) for r in members])
    out = []
    for node, own, looks, _, e in rows:
        mine = np.frombuffer(e, np.uint64)
        if not looks or not len(mine):
            continue
        at = np.minimum(np.searchsorted(mine, everything), len(mine) - 1)
        common = np.bincount(owner[mine[at] == everything], minlength=len(sets))
        union = sizes + len(mine) - common
        good = np.flatnonzero((100 * common >= round(100 * SIMILARITY) * union) & (component != names.get(own, -1)))
        best: dict[int, int] = {}
        for k in good[np.argsort(common[good] / union[good], kind="stable")]:
            best[component[k]] = k
        out += [(min(node, members[k][0]), max(node, members[k][0])) for k in best.values()]
    return out


def near_classes(docs: DataFrame) -> DataFrame:
    """docs with two more columns: ``content`` (128 bits of the words) and ``class_id``, the least doc_id of the class;
    columns of these names in docs are replaced.

    Two documents are linked if their multisets of five-word shingles have a Jaccard similarity of 0.8 or more; a text
    of one to four words is one shingle; texts without words (null, empty) are copies of one another. Classes are the
    connected components. Words are compared as they are. Rows that repeat a doc_id are classed by their own text.
    Null doc_ids are no class's least unless it has no other; then class_id is null. An empty table gives an empty
    result; very long texts are hashed whole, in steps, and compared like others. Ties among signatures don't matter, as all
    comparisons are exact. Pairs of similarity 0.8 share a band with probability 0.99995, more similar ones almost surely.
    """
    docs = docs.drop("content", "class_id")
    (of,) = fresh("of", taken=docs.columns)
    classes = content_classes(docs.select("doc_id", "text"))[1].select(F.col("node").alias(of), "class_id")
    return docs.withColumn("content", F.expr(CONTENT)).join(classes, F.col("content") == F.col(of), "left").drop(of)


def row_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, content) of every row of docs(doc_id, text), as near_classes gives them, without reading the
    texts once more."""
    of_rows, classes = content_classes(docs)
    return of_rows.join(classes, "node").select("doc_id", "class_id", F.col("node").alias("content"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The document of least doc_id of each class, with its own columns, whatever their names; rows that repeat it all
    stay. Of a class whose rows all lack doc_id one row stays: of least content, then first by its JSON. See near_classes
    for all other cases."""
    content, of, least, first, row = fresh("content", "of", "least", "first", "row", taken=docs.columns)
    classes = content_classes(docs.select("doc_id", "text"))[1].select(F.col("node").alias(of), F.col("class_id").alias(least), F.col("first").alias(first))
    keyed, same = docs.withColumn(content, F.expr(CONTENT)), F.col(content) == F.col(of)
    columns = [quoted(c) for c in docs.columns]
    kept = keyed.join(classes, same & (F.col("doc_id") == F.col(least))).select(*columns)
    unnamed = keyed.where("doc_id IS NULL").join(classes.where(F.col(least).isNull() & (F.col(of) == F.col(first))), same)
    whole = F.struct(*columns)
    chosen = unnamed.groupBy(content).agg(F.min_by(whole, F.to_json(whole)).alias(row))
    return kept.unionByName(chosen.select(*(F.col(row).getField(c).alias(c) for c in docs.columns)))


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents with its class, in the cases of near_classes."""
    return row_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", F.hex("content").alias("content"))

"""Approximate nearest neighbours by inner product on robust-pruned directed graphs.

Vectors are dealt to shards by their length, so that no shard holds vectors more than twice as long as others, and then
by a hash; each shard is one graph, built by one task and stored as one row. Shards grow with the table, so that the
beams, not the number of shards, carry most of its growth. A graph is built over directions, the vectors at length one:
points enter in growing batches; a greedy beam search from a fixed start proposes neighbours of each new point, and
relaxed distance pruning keeps those that no kept neighbour is closer to by the factor ALPHA, so that edges stay short
and diverse; the reversed edges are added and pruned alike. A query runs a beam search in every shard, in the order of
inner products; the best of all shards are ranked by their exact inner products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.util import table, written

#: Distinct vectors of a shard, about: the least, the most, and the number of shards of one length beyond which they grow
#: from the least to the most. Degree; beam widths while building and searching; the factor of pruning.
SHARD, LARGEST, SHARDS = 8192, 65536, 64
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 40, 64, 160, 1.15
#: Results of a query; queries that meet a shard in one task.
TOP, GROUP = 20, 32768
#: Queries whose beams run side by side, nodes expanded at once, and the largest batch of new points.
ABREAST, EXPAND, BATCH = 256, 4, 512


class Graph:
    """points (n, d) with edges (n, DEGREE), -1 where there are fewer."""

    def __init__(self, points: np.ndarray, edges: np.ndarray, start: int):
        self.points, self.edges, self.start = points, edges, start
        self.norms = np.einsum("nd,nd->n", points, points)

    def by_product(self, points: np.ndarray) -> Graph:
        """The same graph over other points, searched for the largest inner products: its distances are -2 times these,
        but for a number that only depends on the query."""
        other = Graph(points, self.edges, self.start)
        other.norms = np.zeros(len(points), points.dtype)
        return other

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances), each (queries, beam), nearest first; -1 and infinity where fewer were reached."""
        n, q = len(self.points), len(queries)
        ids = np.full((q, beam), -1, np.int64)
        far = np.full((q, beam), np.inf, np.float32)
        done = np.zeros((q, beam), bool)
        seen = np.zeros(q * n, bool)
        own = np.einsum("qd,qd->q", queries, queries)
        ids[:, 0] = self.start
        far[:, 0] = own + self.norms[self.start] - 2 * queries @ self.points[self.start]
        seen[np.arange(q) * n + self.start] = True
        active = np.arange(q)
        while len(active):
            wait = np.where(done[active] | (ids[active] < 0), np.inf, far[active])
            pick = np.argpartition(wait, min(EXPAND, beam) - 1, axis=1)[:, :EXPAND]
            good = np.isfinite(np.take_along_axis(wait, pick, axis=1))
            some = good.any(axis=1)
            active, pick, good = active[some], pick[some], good[some]
            if not len(active):
                break
            row, slot = np.nonzero(good)
            done[active[row], pick[row, slot]] = True
            near = self.edges[ids[active[row], pick[row, slot]]]
            who = np.repeat(active[row], near.shape[1])
            near = near.ravel()
            key = who[near >= 0] * n + near[near >= 0]
            key = np.unique(key[~seen[key]])
            if not len(key):
                continue
            seen[key] = True
            who, near = key // n, key % n
            dist = own[who] + self.norms[near] - 2 * np.einsum("kd,kd->k", queries[who], self.points[near])
            begin = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            count = np.diff(np.append(begin, len(who)))
            wide = count.max()
            place = np.arange(len(who)) - np.repeat(begin, count)
            line = np.repeat(np.arange(len(begin)), count)
            more_ids = np.full((len(begin), wide), -1, np.int64)
            more_far = np.full((len(begin), wide), np.inf, np.float32)
            more_ids[line, place], more_far[line, place] = near, dist
            at = who[begin]
            all_far = np.concatenate([far[at], more_far], axis=1)
            order = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            far[at] = np.take_along_axis(all_far, order, axis=1)
            ids[at] = np.take_along_axis(np.concatenate([ids[at], more_ids], axis=1), order, axis=1)
            done[at] = np.take_along_axis(np.concatenate([done[at], np.zeros_like(more_ids, bool)], axis=1), order, axis=1)
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1)

    def prune(self, who: np.ndarray, ids: np.ndarray, alpha: float) -> np.ndarray:
        """(len(who), DEGREE) neighbours of the points who, chosen from candidates ids (-1: none): the nearest first, then
        each next one that is nearer to the point than alpha times its distance from any chosen before."""
        c = self.points[np.maximum(ids, 0)]
        size = self.norms[np.maximum(ids, 0)]
        own = self.norms[who][:, None] + size - 2 * np.einsum("bmd,bd->bm", c, self.points[who])
        own[(ids < 0) | (ids == who[:, None])] = np.inf
        order = np.argsort(own, axis=1, kind="stable")
        own, ids, c, size = (np.take_along_axis(x, order, axis=1) for x in (own, ids, np.arange(ids.shape[1])[None].repeat(len(ids), 0), size))
        vectors = self.points[np.maximum(ids, 0)]
        between = size[:, :, None] + size[:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
        alive = np.isfinite(own)
        alive[:, 1:] &= ids[:, 1:] != ids[:, :-1]
        out = np.full((len(who), DEGREE), -1, np.int32)
        row = np.arange(len(who))
        for k in range(DEGREE):
            first = alive.argmax(axis=1)
            some = alive[row, first]
            if not some.any():
                break
            out[some, k] = ids[row, first][some]
            alive &= between[row, first] * alpha * alpha > own
            alive[row, first] = False
        return out


def build(points: np.ndarray, alpha: float = ALPHA) -> Graph:
    """A graph over points; the order of entry is that of the points, from the one nearest to their mean."""
    n = len(points)
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin()) if n else 0
    graph = Graph(points, np.full((n, DEGREE), -1, np.int32), start)
    rest = np.delete(np.arange(n), start) if n else np.zeros(0, int)
    at = 0
    while at < len(rest):
        who = rest[at : at + min(BATCH, max(1, at))]
        at += len(who)
        found, _ = graph.search(points[who], BUILD_BEAM)
        if len(who) > 1:
            # Points of one batch don't see each other in the graph yet: each also gets the nearest few of its batch.
            near = graph.norms[who][None] - 2 * points[who] @ points[who].T
            np.fill_diagonal(near, np.inf)
            few = np.argpartition(near, min(8, len(who) - 1) - 1, axis=1)[:, : min(8, len(who) - 1)]
            found = np.concatenate([found, who[few]], axis=1)
        edges = graph.prune(who, found, alpha)
        graph.edges[who] = edges
        source, target = np.repeat(who, DEGREE)[edges.ravel() >= 0], edges.ravel()[edges.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        begin = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, int)
        count = np.diff(np.append(begin, len(target)))
        free = (graph.edges[target[begin]] < 0).sum(axis=1) if len(begin) else np.zeros(0, int)
        fits = count <= free
        place = np.arange(len(target)) - np.repeat(begin, count)
        roomy = np.repeat(fits, count)
        graph.edges[target[roomy], (DEGREE - np.repeat(free, count) + place)[roomy]] = source[roomy]
        crowded = np.flatnonzero(~fits)
        # Fullest last, in pieces, so that few rows are as wide as the widest.
        crowded = crowded[np.argsort(count[crowded], kind="stable")]
        for k in range(0, len(crowded), ABREAST):
            part = crowded[k : k + ABREAST]
            new = np.full((len(part), count[part].max()), -1, np.int64)
            for line, x in enumerate(part):
                new[line, : count[x]] = source[begin[x] : begin[x] + count[x]]
            hubs = target[begin[part]]
            graph.edges[hubs] = graph.prune(hubs, np.concatenate([graph.edges[hubs], new], axis=1), alpha)
    return graph


def directions(vectors: np.ndarray) -> np.ndarray:
    """Vectors at length one; scaled first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def reduced(vectors: np.ndarray) -> np.ndarray:
    """Vectors over their largest component, in single precision, for beams."""
    return (vectors / np.abs(vectors).max(initial=1e-300)).astype(np.float32)


INDEX = "dim int, band int, shard long, vectors binary, edges binary, start long, ids binary, first binary"


def _index(key, rows):
    """One row for a shard, from rows (dim, band, shard, vec_id, embedding): equal vectors are one point with several ids."""
    dim, band, shard = (k.as_py() for k in key)
    ids = rows["vec_id"].to_numpy()
    vectors = np.asarray(rows["embedding"].combine_chunks().flatten(), np.float64).reshape(-1, dim)
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    points, at = np.unique(vectors, axis=0, return_inverse=True)
    by = np.argsort(at, kind="stable")
    ids, first = ids[by], np.searchsorted(at[by], np.arange(len(points) + 1))
    # A fixed shuffle: points must not enter in sorted order.
    mix = np.random.default_rng(5).permutation(len(points))
    graph = build(directions(points[mix]))
    edges = np.full((len(points), DEGREE), -1, np.int32)
    edges[mix] = np.where(graph.edges >= 0, mix[np.maximum(graph.edges, 0)], -1)
    row = {"dim": dim, "band": band, "shard": shard, "vectors": points.tobytes(), "edges": edges.tobytes(), "start": int(mix[graph.start]), "ids": ids.tobytes(), "first": first.astype(np.int64).tobytes()}
    return pa.table({k: pa.array([v], {"dim": pa.int32(), "band": pa.int32(), "shard": pa.int64(), "start": pa.int64()}.get(k, pa.binary())) for k, v in row.items()})


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part."""
    ok = "vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    return rows.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _band(embedding: str) -> str:
    """SQL for the power of two below the length of a vector, scaled first so that no square overflows or vanishes."""
    most = f"array_max(transform({embedding}, x -> abs(x)))"
    return f"CAST(floor(log2({most}) + log2(aggregate(transform({embedding}, x -> x / {most}), CAST(0 AS DOUBLE), (a, x) -> a + x * x)) / 2) AS INT)"


def build_index(rows: DataFrame, shard: int = SHARD, keep: int = TOP + 1, largest: int = LARGEST) -> DataFrame:
    """One row for every shard, all rows of rows(vec_id, embedding) that take part indexed: those whose id isn't null and
    whose vector is neither null, empty nor zero and has only finite components. Of equal vectors the keep smallest ids
    are stored: no larger one can be among the first keep - 1 results that are not the query itself. That choice is made
    before rows are dealt to shards, so a vector that many rows share doesn't crowd its shard. Vectors of different sizes
    are indexed apart. Repeated rows count once; an empty table gives an empty index."""
    same = Window.partitionBy("embedding").orderBy("vec_id")
    few = usable(rows).distinct().withColumn("turn", F.row_number().over(same)).where(F.col("turn") <= keep).drop("turn")
    banded = written(few.select(F.size("embedding").alias("dim"), F.expr(_band("embedding")).alias("band"), "vec_id", "embedding"), "vectors")
    size = F.greatest(F.lit(shard), F.least(F.lit(max(shard, largest)), F.ceil(F.col("n") / SHARDS)))
    shards = banded.groupBy("dim", "band").agg(F.count(F.lit(1)).alias("n")).select(F.col("dim").alias("s_dim"), F.col("band").alias("s_band"), F.ceil(F.col("n") / size).alias("shards"))
    met = banded.join(shards, (F.col("dim") == F.col("s_dim")) & (F.col("band") == F.col("s_band")))
    dealt = met.select("dim", "band", F.pmod(F.xxhash64("embedding"), F.col("shards")).alias("shard"), "vec_id", "embedding")
    return written(dealt.groupBy("dim", "band", "shard").applyInArrow(_index, INDEX), "index")


FOUND = "query_id long, query_hash long, vec_id long, score double"


def _search(top: int, beam: int):
    def search(index, blocks):
        out: list[list] = [[], [], [], []]
        if index.num_rows and blocks.num_rows:
            row = {k: v[0] for k, v in index.to_pydict().items()}
            vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
            ids, first = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["first"], np.int64)
            graph = Graph(reduced(vectors), np.frombuffer(row["edges"], np.int32).reshape(-1, DEGREE), row["start"])
            graph = graph.by_product(graph.points)
            asked, hashes = blocks["query_id"].to_numpy(), blocks["query_hash"].to_numpy()
            queries = np.asarray(blocks["query"].combine_chunks().flatten(), np.float64).reshape(-1, row["dim"])
            scaled = directions(queries)
            for a in range(0, len(queries), ABREAST):
                near, _ = graph.search(scaled[a : a + ABREAST], min(beam, max(2 * top + 2, len(vectors))))
                for k, found in enumerate(near):
                    found = found[found >= 0]
                    score = (vectors[found] * queries[a + k]).sum(axis=1)
                    # The best points first; of a point's ids the smaller first.
                    order = np.argsort(-score, kind="stable")[: top + 1]
                    found, score = found[order], score[order]
                    many = first[found + 1] - first[found]
                    own = ids[np.concatenate([np.arange(first[x], first[x + 1]) for x in found])]
                    score = np.repeat(score, many)
                    other = own != asked[a + k]
                    own, score = own[other], score[other]
                    order = np.lexsort((own, -score))[:top]
                    out[0].append(np.full(len(order), asked[a + k]))
                    out[1].append(np.full(len(order), hashes[a + k]))
                    out[2].append(own[order])
                    out[3].append(score[order])
        kinds = (np.int64, np.int64, np.int64, np.float64)
        return pa.table({n: np.concatenate([np.zeros(0, t), *x]).astype(t) for n, x, t in zip(("query_id", "query_hash", "vec_id", "score"), out, kinds, strict=True)})

    return search


def search_index(index: DataFrame, queries: DataFrame, top: int = TOP, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the top nearest found in index for each of queries(vec_id, embedding), ranked by
    exact inner product, ties by smaller vec_id; the query's own id is left out.

    Queries take part like the rows of an index. They are dealt to groups of about GROUP; each group meets each shard of
    its dimension in a task of its own, which holds one shard and one group. Queries that repeat an id with another
    vector are ranked apart. Fewer candidates than top give fewer rows. Without queries, or rows, the result is empty.
    """
    asked = usable(queries).distinct().select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("query_hash"))
    groups = max(1, -(-asked.count() // GROUP))
    parts = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    key = ["dim", "band", "shard"]
    left = index.withColumn("part", parts)
    shards = index.select(*(F.col(c).alias(f"q_{c}") for c in key)).withColumn("q_part", parts)
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    right = dealt.join(shards, (F.col("dim") == F.col("q_dim")) & (F.col("part") == F.col("q_part"))).select("q_dim", "q_band", "q_shard", "q_part", "query_id", "query_hash", "query")
    met = left.groupBy(*key, "part").cogroup(right.groupBy("q_dim", "q_band", "q_shard", "q_part")).applyInArrow(_search(top, beam), FOUND)
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op4_graph_search(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every query (vec_id divisible by 20) among all rows of embeddings, in the cases of search_index."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search_index(build_index(rows), rows.where("vec_id % 20 = 0"))

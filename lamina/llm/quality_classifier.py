"""A quality classifier: votes of the nearest labelled texts in a latent-semantic space.

Texts become counts of hashed terms: words, word endings, and terms for the shape of a text (how long it is with how
many different words, how much of it is punctuation). A bounded sample of labelled texts gives term weights and, by
a truncated singular value decomposition, a latent space. Their vectors and labels are broadcast; every document is
compared with all of them, in blocks, and the labels of the most similar are weighted by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.shingles import run_hashes, words
from lamina.llm.util import fresh, held, lean, portions, table, utf8

#: Hashed terms: words, endings of words, shapes.
WORDS, ENDINGS, SHAPES = 3072, 768, 256
TERMS = WORDS + ENDINGS + SHAPES
#: Bounds of what is collected and broadcast: labelled texts of each label, latent dimensions.
SAMPLE_EACH, LATENT = 2048, 48
NEIGHBOURS, SHARPNESS = 24, 8
THRESHOLD, FOLDS = 0.3, 5
#: Texts, and bytes of texts, whose counts a worker holds at once, about: a text has TERMS counts of four bytes.
ROWS, BYTES = 512, 1 << 20
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def counts(texts: pa.Array) -> np.ndarray:
    """(texts, TERMS) counts; every text has terms for its shape, an empty one too."""
    blob, off = utf8(texts)
    n = len(off) - 1
    begin, end, first = words(blob, off)
    sizes = np.diff(first)
    text = np.repeat(np.arange(n), sizes)
    out = np.zeros((n, TERMS), np.float32)
    flat = out.reshape(-1)
    word = (run_hashes(blob, begin, end) % np.uint64(WORDS)).astype(np.int64)
    ending = WORDS + (run_hashes(blob, np.maximum(begin, end - 3), end) % np.uint64(ENDINGS)).astype(np.int64)
    for term in (word, ending):
        flat += np.bincount(text * TERMS + term, minlength=n * TERMS).astype(np.float32)
    different = (out[:, :WORDS] > 0).sum(axis=1)
    length = np.minimum(np.log2(sizes + 1).astype(int), 15)
    variety = np.minimum(8 * different // np.maximum(np.minimum(sizes, WORDS), 1), 7)
    marks = np.diff(np.searchsorted(np.flatnonzero(_PUNCTUATION[blob]), off))
    share = np.minimum(np.sqrt(marks / np.maximum(off[1:] - off[:-1], 1)) * 32, 31).astype(int)
    at = np.arange(n)
    out[at, WORDS + ENDINGS + length * 8 + variety] = 1
    out[at, WORDS + ENDINGS + 128 + share] = 1
    out[at, WORDS + ENDINGS + 192 + variety] = 1
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, rows: np.ndarray) -> np.ndarray:
        return _unit(weighted(rows, self.weights) @ self.basis)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Share of label 1 among the most similar labelled texts, weighted by similarity. Similarities count in steps of
        1e-9, and of equal ones the first in the model, so that a score doesn't depend on the block of a text."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        steps = np.rint(self.latent(rows).astype(np.float64) @ self.vectors.T.astype(np.float64) * 1e9).astype(np.int64)
        k, n = min(NEIGHBOURS, steps.shape[1]), steps.shape[1]
        key = steps * n - np.arange(n)
        top = np.sort(np.argpartition(-key, k - 1, axis=1)[:, :k], axis=1)
        weight = np.maximum(np.take_along_axis(steps, top, axis=1) * 1e-9, 1e-6) ** SHARPNESS
        return np.clip((weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1), 0, 1)


def weighted(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Damped counts times term weights; words, endings and shapes each of length one."""
    x = np.log1p(rows) * weights
    for a, b in ((0, WORDS), (WORDS, WORDS + ENDINGS), (WORDS + ENDINGS, TERMS)):
        x[:, a:b] = _unit(x[:, a:b])
    return x


def fit(rows: np.ndarray, labels: np.ndarray, latent: int = LATENT) -> Model:
    """A model from counts and 0/1 labels: inverse document frequencies, then the leading right singular vectors by
    subspace iteration from a fixed start."""
    weights = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 1).astype(np.float32)
    x = weighted(rows, weights)
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((TERMS, latent + 16)).astype(np.float32))[0]
    for _ in range(6):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    if len(rows):
        turn = np.linalg.svd(x @ basis, full_matrices=False)[2]
        basis = basis @ turn[:latent].T
    model = Model(weights, basis.astype(np.float32)[:, :latent], np.zeros((0, latent), np.float32), labels.astype(np.float64))
    if len(rows):
        model.vectors = model.latent(rows)
    return model


@F.arrow_udf(T.BinaryType())
def packed_counts(texts: pa.Array) -> pa.Array:
    """Counts of each text as pairs of term and count."""
    out = []
    for begin, end in portions(texts, BYTES, ROWS):
        for row in counts(texts.slice(begin, end - begin)):
            at = np.flatnonzero(row)
            out.append(np.stack([at.astype(np.float32), row[at]]).tobytes())
    return pa.array(out, pa.binary())


def held_out(doc_id: str = "doc_id"):
    """Whether a document is never learned from: crc32 of its id as text, modulo FOLDS, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH) -> Model:
    """A model learned from labelled documents that are not held out: for each label the each documents of least hash
    of the id. Only counts and labels of these reach the driver. Rows without id, or of a label other than 0 and 1, are
    left out; of rows that repeat an id the least label, and the least counts, stand for it."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~F.coalesce(held_out(), F.lit(True))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ranked = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for q in (0, 1)]
    chosen = F.broadcast(ranked[0].unionByName(ranked[1]).withColumnRenamed("doc_id", "of"))
    met = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("of"))
    rows = met.select("doc_id", "quality", packed_counts("text").alias("c")).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("c").alias("c")).orderBy("doc_id").collect()
    x = np.zeros((len(rows), TERMS), np.float32)
    for k, r in enumerate(rows):
        at, value = np.frombuffer(r.c, np.float32).reshape(2, -1)
        x[k, at.astype(int)] = value
    return fit(x, np.array([r.quality for r in rows]))


def with_quality_score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """docs with a score from 0 to 1, higher where label 1 is likelier; a column named like into is replaced, all others
    pass through. Null and empty texts are scored by their shape; very long ones whole, one at a time. Repeated rows get
    equal scores; of equally similar neighbours the first in the model count. With a model of no labels every score is
    0.5; an empty table gives an empty one. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    @lean
    def score(texts: pa.Array) -> pa.Array:
        held()
        own = [shared.value.score(counts(texts.slice(a, b - a))) for a, b in portions(texts, BYTES, ROWS)]
        return pa.array(np.concatenate([np.zeros(0), *own]), pa.float64())

    return docs.withColumn(into, score(F.col("text")))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents, in the cases of with_quality_score. A row without id counts as held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    (score,) = fresh("score", taken=docs.columns)
    scored = with_quality_score(docs, train(docs, table(spark, sf_dir, "labels")), score)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(True)).alias("held_out"), F.col(score).alias("score"), F.when(F.col(score) >= THRESHOLD, 1).otherwise(0).alias("predicted"))

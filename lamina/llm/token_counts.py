"""Token counts: an exact histogram of encoded lengths and what its suffix sums answer.

Documents are encoded once for their length; lengths are aggregated to a histogram before any shuffle. With
docs(L) and tokens(L) the sums over lengths of L or more, a context limit L truncates the corpus to
tokens(<L) + L * docs(L) tokens; the same sums give totals and quantiles.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.util import fresh, held, lean, table, written

#: Distinct pieces whose token count a worker remembers; the memory is emptied when full.
MEMORY = 250_000
#: Lengths are summed in runs of this many, so no window runs over all lengths at once.
RUN = 4096


def _counter(path: str):
    return held(("counter", path), lambda: _made_counter(path))


def _made_counter(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding, regex.compile(PATTERN).findall, {}


def count_tokens(texts: list[str | None], path: str) -> np.ndarray:
    """Encoded length of each text; 0 for null. A piece of the splitting pattern is encoded once and remembered."""
    encoding, pieces, known = _counter(path)
    out = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if text:
            found = pieces(text)
            try:
                out[k] = sum(map(known.__getitem__, found))
            except KeyError:
                total = 0
                for piece in found:
                    n = known.get(piece)
                    if n is None:
                        n = len(encoding.encode_ordinary(piece))
                        if len(piece) <= 64:
                            if len(known) >= MEMORY:
                                known.clear()
                            known[piece] = n
                    total += n
                out[k] = total
    return out


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def with_token_count(docs: DataFrame, into: str = "n_tokens", path: str | None = None) -> DataFrame:
    """docs with the encoded length of text, 0 for null or empty; a column named like into is replaced, all others pass
    through. Very long texts are encoded whole, one at a time. Repeated rows get equal lengths; an empty table gives an
    empty one. Nothing is shuffled."""
    path = path or default_ranks()

    @F.arrow_udf("bigint")
    @lean
    def lengths(texts: pa.Array) -> pa.Array:
        return pa.array(count_tokens(texts.to_pylist(), path))

    return docs.withColumn(into, lengths(F.col("text")))


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(length, n_docs): how many documents have each encoded length. Repeated rows each count; an empty table gives
    an empty histogram; null and empty texts have length 0."""
    (length,) = fresh("length", taken=docs.columns)
    return with_token_count(docs.select("text"), length, path).groupBy(F.col(length).alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram: n_docs and n_tokens of that length, docs_from and tokens_from (L or more),
    docs_total, tokens_total, docs_upto (L or less) and its share of all in millionths, of which quantiles are read, and
    truncated_total, the tokens left when every document is cut to L. An empty histogram gives none.

    Sums run inside runs of RUN lengths and over the totals of the runs; the rows of a run, like the number of runs,
    are bounded by the longest document, not by the corpus.
    """
    own = histogram.withColumn("run", F.expr(f"length div {RUN}")).withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    runs = own.groupBy("run").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    after = Window.orderBy(F.col("run").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = runs.select(
        F.col("run"),
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(everything).alias("docs_total"),
        F.sum("t").over(everything).alias("tokens_total"),
    )
    within = Window.partitionBy("run").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        own.withColumn("d_in", F.sum("n_docs").over(within)).withColumn("t_in", F.sum("n_tokens").over(within)).join(later, "run")
        .selectExpr(
            "length", "n_docs", "n_tokens", "d_in + d_after AS docs_from", "t_in + t_after AS tokens_from", "docs_total", "tokens_total",
            "docs_total - (d_in + d_after) + n_docs AS docs_upto", "(1000000 * (docs_total - (d_in + d_after) + n_docs)) div docs_total AS upto_ppm",
            "tokens_total - (t_in + t_after) + length * (d_in + d_after) AS truncated_total",
        )
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_total, docs_over): the corpus cut to each of the limits, exactly, whether or not a
    document has that length: the suffix sums at the least length that isn't below a limit are those of the limit. Every
    length looks for the largest limit that isn't above it, so no length is read for more than one. Limits are whole
    numbers from 0 on, each answered once; without documents there are no answers."""
    asked = sorted({int(x) for x in limits} | {0})
    given = F.array(*(F.lit(x).cast("bigint") for x in asked))
    above = F.array_max(F.filter(given, lambda x: x <= F.col("length")))
    row = F.struct("docs_from", "tokens_from", "n_docs", "length", "docs_total", "tokens_total")
    first = sums.select(above.alias("context_limit"), "length", row.alias("row")).groupBy("context_limit").agg(F.min_by("row", "length").alias("row"))
    every = sums.sparkSession.createDataFrame([(x,) for x in asked], "context_limit bigint").join(F.broadcast(first), "context_limit", "left")
    onward = Window.orderBy("context_limit").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_ = Window.orderBy("context_limit").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = every.withColumn("of", F.first("row", ignorenulls=True).over(onward)).withColumn("tokens", F.max("row.tokens_total").over(all_)).where("tokens IS NOT NULL")
    docs, tokens = F.coalesce("of.docs_from", F.lit(0)), F.coalesce("of.tokens_from", F.lit(0))
    same = F.when(F.col("of.length") == F.col("context_limit"), F.col("of.n_docs")).otherwise(0)
    return found.where(F.col("context_limit").isin([int(x) for x in limits])).select(
        "context_limit", (F.col("tokens") - tokens + F.col("context_limit") * docs).alias("truncated_total"), (docs - same).alias("docs_over")
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least that share of documents does not exceed."""
    asked = sums.select(F.explode(F.array(*map(F.lit, shares))).alias("share"), "length", "docs_upto", "docs_total")
    return asked.where("docs_upto >= share * docs_total").groupBy("share").agg(F.min("length").alias("length"))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """The suffix sums of documents at every length that one of them has, in the cases of length_histogram."""
    # The histogram is read three times by its sums: it is written once, so that texts are encoded once.
    return suffix_sums(written(length_histogram(table(spark, sf_dir, "documents")), "lengths"))

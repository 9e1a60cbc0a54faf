"""Quality rules whose limits adapt to each language and source.

Every document gets a handful of counts (``quality_stats``). Each ratio made from them is put into a log-linear
bucket (32 buckets per power of two, so a bucket is at most 1/32 wide of its value); bucket counts per language
and source are a quantile sketch that merges by addition (``ratio_sketch``): groups merge into languages and
languages into the corpus. Quartiles read off the sketches give limits for every group (``fences``): so many spreads
beyond the upper quartile and, for word length, below the lower one. Groups of few documents fall back to their language
and then to the corpus, and no group's limit may be more than SLACK times that of its language, nor a language's that of
the corpus, so that a bad source can't set its own. Documents are joined with the limits of their group
(``quality_verdicts``).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.util import BLANK, broadcast_if_small, fresh, held, lean, quoted, table, written

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5

#: name: numerator, denominator, scale of the integer ratio, spreads beyond the quartile, least spread. The least spread is
#: the grain of a ratio (one symbol in a hundred words), for groups in which half of all documents have the same.
RULES = {
    "symbols": ("n_symbols", "n_words", 1000, 6, 10),
    "word_length": ("word_chars", "n_words", 1000, 12, 100),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 6, 60),
    "repeats": ("n_repeat_words", "n_words", 1000, 6, 25),
}
#: Rules with a lower limit too.
TWO_SIDED = ("word_length",)
#: How many times its language's limit a group's may be, and a language's the corpus's.
SLACK = 2
#: Salts of the join of documents and limits where these are too many to broadcast.
SALTS = 32
#: Groups of fewer documents take the fence of their language, small languages that of the corpus.
LEAST_DOCUMENTS = 200
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
STATS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in STATS])


def count_stats(text: str | None) -> tuple[int, ...]:
    """The counts named in STATS of one text; n_lines counts lines with a word."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    blanks = len(raw) - len(raw.translate(None, BLANK))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
        seen = Counter(windows)
        if len(seen) < len(windows):
            covered = bytearray(n)
            mark = b"\1" * WINDOW
            for k, window in enumerate(windows):
                if seen[window] > 1:
                    covered[k : k + WINDOW] = mark
            repeated = sum(covered)
    return n, len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated, len(lines)


@F.arrow_udf(STATS_TYPE)
@lean
def _stats(texts: pa.Array) -> pa.Array:
    held()
    rows = np.array([count_stats(t.as_py()) for t in texts], np.int64).reshape(-1, len(STATS))
    return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(STATS))], list(STATS))


def quality_stats(docs: DataFrame, into: str) -> DataFrame:
    """docs with a struct column of the counts; a null or empty text has counts of 0, a very long one is counted whole.
    Repeated rows have the same counts; an empty table gives an empty one."""
    # Called once for each row: as what it gives can't be known beforehand, Spark evaluates it in one place.
    return docs.withColumn(into, _stats.asNondeterministic()(F.col("text")))


def ratio(rule: str, stats: str):
    """The integer ratio of a rule: scale * numerator / denominator, rounded down; 0 where the denominator is 0."""
    top, bottom, scale = RULES[rule][:3]
    return F.expr(f"CASE WHEN {stats}.{bottom} > 0 THEN (CAST({scale} AS BIGINT) * {stats}.{top}) div {stats}.{bottom} ELSE CAST(0 AS BIGINT) END")


def bucket(value: str) -> str:
    """SQL for the lower end of a value's log-linear bucket: values under 64 keep their own."""
    shift = f"greatest(length(bin({value})) - 6, 0)"
    return f"shiftleft(shiftright({value}, {shift}), {shift})"


def ratio_sketch(docs: DataFrame, stats: str, counted) -> DataFrame:
    """Bucket counts (rule, lang, source, bucket, n) of the documents for which counted holds. One shuffle of
    pre-aggregated buckets: a hot source adds no more rows than any other."""
    values = F.array(*(F.struct(F.lit(r).alias("rule"), ratio(r, stats).alias("value")) for r in RULES))
    return (
        docs.where(counted)
        .select("lang", "source", F.explode(values).alias("x"))
        .selectExpr("x.rule AS rule", "lang", "source", f"{bucket('x.value')} AS bucket")
        .groupBy("rule", "lang", "source", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fences(sketch: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, high_<rule>..., low_<rule>...): for each group of the sketch the largest and least ratio that pass.

    Quartiles are the buckets that hold the ceil(n/4)-th, ceil(n/2)-th and ceil(3n/4)-th document. A high limit is
    upper + factor * max(upper - middle, least spread), a low one lower - factor * max(middle - lower, least spread), 0
    at least. The sketches of a language, and of the corpus, are sums of those of their groups. Sums run over buckets,
    of which there are few thousand at most in a group.
    """
    factor, grain = (F.create_map(*(x for r, rule in RULES.items() for x in (F.lit(r), F.lit(rule[k]).cast("bigint"))))[F.col("rule")] for k in (3, 4))

    def limits(level: list[str], tag: str) -> DataFrame:
        merged = sketch.groupBy("rule", *level, "bucket").agg(F.sum("n").alias("n"))
        group = Window.partitionBy("rule", *level)
        running = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        known = merged.withColumn("upto", F.sum("n").over(running)).withColumn("total", F.sum("n").over(group))
        quartile = lambda k: F.min(F.when(F.expr(f"4 * upto >= {k} * total"), F.col("bucket")))
        read = known.groupBy("rule", *level).agg(quartile(1).alias("q1"), quartile(2).alias("q2"), quartile(3).alias("q3"), F.max("total").alias("total"))
        high = F.col("q3") + factor * F.greatest(F.col("q3") - F.col("q2"), grain)
        low = F.greatest(F.col("q1") - factor * F.greatest(F.col("q2") - F.col("q1"), grain), F.lit(0).cast("bigint"))
        return read.select(F.col("rule").alias(f"{tag}_rule"), *(F.col(c).alias(f"{tag}_{c}") for c in level), F.col("total").alias(f"{tag}_total"), high.alias(f"{tag}_high"), low.alias(f"{tag}_low"))

    def held(own: str, above: str) -> list:
        enough = F.col(f"{own}_total") >= least
        return [
            F.when(enough, F.least(F.col(f"{own}_high"), SLACK * F.col(f"{above}_high"))).otherwise(F.col(f"{above}_high")).alias(f"{own}_high"),
            F.when(enough, F.greatest(F.col(f"{own}_low"), F.expr(f"{above}_low div {SLACK}"))).otherwise(F.col(f"{above}_low")).alias(f"{own}_low"),
        ]

    corpus, language, own = limits([], "c"), limits(["lang"], "l"), limits(["lang", "source"], "g")
    language = language.join(F.broadcast(corpus), F.col("l_rule") == F.col("c_rule")).select("l_rule", "l_lang", *held("l", "c"))
    known = own.join(language, (F.col("g_rule") == F.col("l_rule")) & F.col("g_lang").eqNullSafe(F.col("l_lang"))).select("g_rule", "g_lang", "g_source", *held("g", "l"))
    pick = lambda r, side: F.max(F.when(F.col("g_rule") == r, F.col(f"g_{side}"))).alias(f"{side}_{r}")
    return known.groupBy(F.col("g_lang").alias("lang"), F.col("g_source").alias("source")).agg(*(pick(r, "high") for r in RULES), *(pick(r, "low") for r in TWO_SIDED))


def base_failed(stats: str):
    return F.expr(f"{stats}.n_words < {MIN_WORDS} OR 100 * {stats}.n_repeat_words > {MOST_REPEATED_PERCENT} * {stats}.n_words")


def _judged(rated: DataFrame, limits: DataFrame) -> DataFrame:
    """rated(lang, source, quality, base_failed, ...) with kept; limits is a written table of fences()."""
    columns = [*rated.columns, "kept"]
    named = dict(zip(limits.columns, fresh(*limits.columns, taken=columns), strict=True))
    limits_, side = limits.withColumnsRenamed(named), broadcast_if_small(limits, ["lang", "source"])
    same = F.col("lang").eqNullSafe(F.col(named["lang"])) & F.col("source").eqNullSafe(F.col(named["source"]))
    if side is F.broadcast:
        joined = rated.join(side(limits_), same, "left")
    else:
        salt, of = fresh("salt", "of_salt", taken=[*columns, *named.values()])
        dealt = rated.withColumn(salt, F.pmod(F.xxhash64(*(quoted(c) for c in rated.columns if c not in ("lang", "source"))), F.lit(SALTS)))
        joined = dealt.join(limits_.withColumn(of, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), same & (F.col(salt) == F.col(of)), "left")
    passes = ~F.col("base_failed")
    for r in RULES:
        passes = passes & (ratio(r, "quality") <= F.col(named[f"high_{r}"]))
    for r in TWO_SIDED:
        passes = passes & (ratio(r, "quality") >= F.col(named[f"low_{r}"]))
    return joined.withColumn("kept", F.coalesce(passes, F.lit(False))).select(*map(quoted, columns))


def _rated(docs: DataFrame) -> DataFrame:
    return quality_stats(docs.drop("quality", "base_failed", "kept"), "quality").withColumn("base_failed", base_failed("quality"))


def _limits(rated: DataFrame, least: int) -> DataFrame:
    # Three levels read the sketch: it is written, so that texts are counted once.
    return written(fences(written(ratio_sketch(rated, "quality", ~F.col("base_failed")), "sketch"), least), "limits")


def quality_limits(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """The written table of fences() for docs(text, lang, source). Only bucket counts are shuffled."""
    rated = _rated(docs.select("text", "lang", "source"))
    return _limits(rated, least)


def quality_verdicts(docs: DataFrame, least: int = LEAST_DOCUMENTS, keep_text: bool = True) -> DataFrame:
    """docs with three more columns: the struct of counts, whether the fixed base rules fail, whether the document is
    kept. They are named ``quality``, ``base_failed`` and ``kept``; columns of these names in docs are replaced.

    Needs text, lang and source; other columns pass through whatever their names. Null text counts as empty, which
    the base rules reject. Null lang or source form groups like any value. Repeated rows each count; equal ratios are
    judged alike. An empty table gives an empty result. Very long texts are counted whole, one at a time. Only documents
    that pass the base rules enter the sketches. With keep_text texts are read and counted twice, once for the sketches
    and once for the joined filter; without it the counts are written in between, and the result has no text. No text
    is shuffled or written, unless the limits of all groups take more than util.BROADCAST_BYTES.
    """
    if keep_text:
        return _judged(_rated(docs), quality_limits(docs, least))
    rated = written(_rated(docs).drop("text"), "quality")
    return _judged(rated, _limits(rated, least))


def quality_filter(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """The documents kept, with their own columns, whatever their names: see quality_verdicts. Columns named quality,
    base_failed or kept survive under other names meanwhile."""
    own = dict(zip(docs.columns, fresh(*(f"own_{k}" for k in range(len(docs.columns))), taken=docs.columns), strict=True))
    aliased = [quoted(c).alias(c if c in ("text", "lang", "source") else own[c]) for c in docs.columns]
    judged = _judged(_rated(docs.select(*aliased)), quality_limits(docs, least))
    return judged.where("kept").select(*(F.col(c if c in ("text", "lang", "source") else own[c]).alias(c) for c in docs.columns))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents, in the cases of quality_verdicts."""
    rated = quality_verdicts(table(spark, sf_dir, "documents"), keep_text=False)
    return rated.selectExpr("doc_id", *(f"quality.{c} AS {c}" for c in STATS[:5]), "base_failed", "kept")

"""Mixing sources to target weights over a tree of domains, languages and sources, with DataFrame operations only.

A token budget flows down the tree. At each node it is shared among the children by weight; a child that can't use its
share (its leaves hold too few tokens even when read in the most epochs allowed) is given all it can use, and what it
leaves goes to its siblings by weight. As a child's limit is the sum over its whole subtree, a shortage moves to the
siblings first and to other branches of the ancestors only when all siblings are full. All of this is exact integer
arithmetic on one row per node.

A leaf reads its documents in whole epochs and then a prefix of one more, in the order of a seeded hash of that
epoch: the documents whose running token total stays within what is left. The running total is taken in two steps, by
hash bucket and then within the one bucket in which the budget ends, so that no task sorts a whole leaf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.util import WORD_PATTERN, broadcast_if_small, fresh, quoted, table, written

#: Hash buckets of a leaf, by the first hex digits of the hash.
BUCKET_DIGITS = 3

#: The default tree: domains of the sources by number, and weights; nodes not named weigh 1. A source without a number at
#: its end, or with one beyond INT, is of the last domain.
DOMAIN = "CASE try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'reference' ELSE 'forum' END"
WEIGHTS = {("web",): 5, ("reference",): 3, ("forum",): 2, **{(d, lang): w for d in ("web", "reference", "forum") for lang, w in (("en", 6), ("de", 2), ("fr", 2), ("es", 2))}}
SEED, BUDGET_PERCENT, MOST_EPOCHS = 17, 80, 3

LEVELS = ("domain", "lang", "source")


def _same(names, prefix: str, of: str = "") -> Column:
    """Whether the columns named, of the struct of if given, equal those with the prefix; nulls equal nulls."""
    return reduce(lambda x, y: x & y, (F.col(f"{of}.{n}" if of else n).eqNullSafe(F.col(prefix + n)) for n in names))


def _share(children: DataFrame, parent: list[str], node: str) -> DataFrame:
    """children(parent..., node, weight, most, budget) with budget replaced by each child's own: filled in the order of
    most / weight, children are full while most * (weights not yet full) <= (budget left) * weight. The order is exact for
    weights below 10**9: quotients of such weights that differ do so within the 19 decimals of the division."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    order = Window.partitionBy(*parent).orderBy(wide("most") / wide("weight"), F.col(node))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = children.withColumn("used", F.coalesce(F.sum("most").over(before), F.lit(0)).cast("bigint")).withColumn("weights", F.sum("weight").over(onward))
    full = ranked.withColumn("full", wide("most") * wide("weights") <= (wide("budget") - wide("used")) * wide("weight"))
    whole = Window.partitionBy(*parent)
    rest = full.withColumn("taken", F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(whole), F.lit(0)).cast("bigint")).withColumn(
        "open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    )
    part = F.expr("CAST((CAST(budget - taken AS DECIMAL(19,0)) * CAST(weight AS DECIMAL(19,0))) div CAST(open AS DECIMAL(19,0)) AS BIGINT)")
    return rest.withColumn("budget", F.when(F.col("full"), F.col("most")).otherwise(part)).drop("used", "weights", "full", "taken", "open")


def budgets(leaves: DataFrame, weights: dict[tuple, int], budget: Column, most_epochs: int) -> DataFrame:
    """leaves(domain, lang, source, supply) with most (supply in all epochs) and budget, the tokens to take from each.

    A leaf without tokens gets nothing. Weights must be positive; nodes that weights doesn't name weigh 1. Rounding
    down leaves less than one token for each child unspent.
    """
    spark = leaves.sparkSession
    known = leaves.withColumn("most", F.col("supply") * most_epochs).withColumn("total", F.sum("supply").over(Window.partitionBy(F.lit(0)))).withColumn("budget", budget)
    above: list[str] = []
    for depth, level in enumerate(LEVELS, 1):
        named = [(*path, int(w)) for path, w in weights.items() if len(path) == depth]
        names = list(LEVELS[:depth])
        nodes = known.groupBy(*names).agg(F.sum("most").alias("most"), F.max("budget").alias("budget"))
        if named:
            given = F.broadcast(spark.createDataFrame(named, ",".join(f"g_{n} string" for n in names) + ", given bigint"))
            nodes = nodes.join(given, _same(names, "g_"), "left").select(*names, "most", "budget", F.coalesce("given", F.lit(1)).cast("bigint").alias("weight"))
        else:
            nodes = nodes.withColumn("weight", F.lit(1).cast("bigint"))
        shared = _share(nodes, above, level).select(*(F.col(n).alias(f"s_{n}") for n in names), F.col("budget").alias("own"))
        known = known.drop("budget").join(shared, _same(names, "s_")).withColumnRenamed("own", "budget").drop(*(f"s_{n}" for n in names))
        above = names
    return known.drop("total")


def mix(
    docs: DataFrame, domain: str = DOMAIN, weights: dict[tuple, int] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, most_epochs: int = MOST_EPOCHS, seed: int = SEED, tokens: str | None = None
) -> DataFrame:
    """The rows of docs chosen, one for each epoch in which a document is read, with columns ``n_tokens`` (the unit of
    budgets) and ``epoch`` (from 0); columns of these names in docs are replaced, all others pass through, whatever
    their names.

    Needs doc_id, text, lang and source. domain is SQL over the columns of docs, and so is tokens, a count for each row
    such as one that token_counts adds; by default words are counted, which SQL can. Null domain, lang or source are
    nodes like any value; null or empty text has no tokens and is chosen whenever its place in the order comes within
    the budget; a null doc_id is hashed as an empty string. Rows with the same doc_id, or hash, in a leaf are in or out
    together. A text longer than what is left of a budget ends its prefix. An empty table gives an empty result. Plans
    have one row for each leaf and are broadcast, so that no text is shuffled; where they take more than
    util.BROADCAST_BYTES they are joined by shuffle, and AQE splits hot leaves.
    """
    tag, units, h, bucket, at, cut, copies, turn = fresh("leaf", "units", "hash", "bucket", "at", "cut", "copies", "turn", taken=[*docs.columns, "n_tokens", "epoch"])
    counted = F.coalesce(F.expr(tokens) if tokens else F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")
    ready = docs.withColumn(tag, F.struct(F.expr(domain).alias("domain"), F.col("lang").alias("lang"), F.col("source").alias("source")))
    lean = written(ready.select("doc_id", counted.alias(units), tag), "mix")
    leaves = lean.groupBy(tag).agg(F.sum(units).alias("supply")).select(f"{tag}.*", "supply")
    shares = written(budgets(leaves, weights, F.expr(f"CAST(total * {int(budget_percent)} / 100 AS BIGINT)"), most_epochs), "shares")
    plan = shares.selectExpr(
        "domain AS p_domain", "lang AS p_lang", "source AS p_source", "CASE WHEN supply > 0 THEN budget div supply ELSE 0 END AS p_whole",
        "CASE WHEN supply > 0 THEN budget % supply ELSE 0 END AS p_rest",
    )
    p = dict(zip(plan.columns, fresh(*plan.columns, taken=[*docs.columns, tag, units, h, bucket, at, cut, copies, turn, "n_tokens", "epoch"]), strict=True))
    plan, whole, rest = plan.withColumnsRenamed(p), p["p_whole"], p["p_rest"]
    leaf, side = [p[f"p_{n}"] for n in LEVELS], broadcast_if_small(shares, list(LEVELS))
    here = reduce(lambda x, y: x & y, (F.col(f"{tag}.{n}").eqNullSafe(F.col(c)) for n, c in zip(LEVELS, leaf, strict=True)))

    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(whole).cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    place = lean.join(side(plan), here).withColumn(h, order).withColumn(bucket, F.substring(h, 1, BUCKET_DIGITS))
    by_bucket = place.groupBy(*leaf, bucket).agg(F.sum(units).alias("tokens"), F.max(rest).alias("rest"))
    running = Window.partitionBy(*leaf).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The bucket in which a leaf's budget ends, and what is left for it; none if all buckets fit.
    ends = (
        by_bucket.withColumn("upto", F.sum("tokens").over(running)).where("upto > rest").groupBy(*leaf)
        .agg(F.min(F.struct(F.col(bucket).alias("b"), (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left"))).alias("e"))
        .select(*(F.col(c).alias(f"e_{n}") for n, c in zip(LEVELS, leaf, strict=True)), "e.b", "e.left")
    )
    last = place.join(side(ends), _same(LEVELS, "e_", tag) & (F.col(bucket) == F.col("b")))
    inside = Window.partitionBy(tag).orderBy(h).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # For each leaf the last hash that is still in: everything with a smaller or equal hash is read once more.
    limits = (
        last.withColumn(at, F.sum(units).over(inside)).groupBy(tag)
        .agg(F.max(F.when(F.col(at) <= F.col("left"), F.col(h))).alias("in_bucket"), F.max("b").alias("b"))
        .select(*(F.col(f"{tag}.{n}").alias(f"c_{n}") for n in LEVELS), F.coalesce("in_bucket", "b").alias("c_cut"))
    )
    in_limits = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"c_{n}")) for n, c in zip(LEVELS, leaf, strict=True)))
    full = plan.join(limits, in_limits, "left").select(*leaf, whole, F.coalesce("c_cut", F.lit("g")).alias(cut))
    chosen = ready.join(side(full), here).withColumn(copies, F.col(whole) + F.when(order <= F.col(cut), 1).otherwise(0)).where(F.col(copies) > 0)
    read = chosen.withColumn(turn, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(copies) - 1)))
    # Tokens are counted again only in the rows chosen.
    return read.select(*(quoted(c) for c in docs.columns if c.lower() not in ("n_tokens", "epoch")), counted.alias("n_tokens"), F.col(turn).alias("epoch"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """The chosen rows of documents without their texts, in the cases of mix."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", F.expr(DOMAIN).alias("domain"), "lang", "source", "n_tokens", "epoch")

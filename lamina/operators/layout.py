"""Layout: totals, offsets, admission by memory, chunks, and cutting an ordered list into balanced contiguous parts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Versions of the format by feature.
BASE, OPAQUE, ENCRYPTED, META = 1, 2, 3, 4


def totals(df: DataFrame, length: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("tensors"), F.sum(length).cast("bigint").alias("total_bytes"))


def version(opaque: Column, encrypted: Column, meta: Column) -> Column:
    """The least version that a row needs; the maximum over rows is that of the archive."""
    return F.greatest(F.lit(BASE), F.when(opaque, OPAQUE).otherwise(BASE), F.when(encrypted, ENCRYPTED).otherwise(BASE), F.when(meta, META).otherwise(BASE))


def offsets(df: DataFrame, length: str, order: str, by: list[str], start: int = 0, into: str = "offset", run: int | None = None) -> DataFrame:
    """df with the running sum of the lengths before each row, within by.

    Groups are archives, whose indexes are short. For longer ones run cuts a whole-numbered order into runs of that many
    values: sums go over the runs first and then within each, so no task sorts a whole group.
    """
    if run is None:
        before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(into, F.coalesce(F.sum(length).over(before), F.lit(0)).cast("bigint") + start)
    cut = df.withColumn("__run", F.expr(f"{order} div {int(run)}"))
    runs = cut.groupBy(*by, "__run").agg(F.sum(length).alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__run").alias("__of"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*by, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    on = F.col("__run") == F.col("__of")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    summed = cut.withColumn("__in", F.coalesce(F.sum(length).over(within), F.lit(0))).join(bases, on)
    return summed.withColumn(into, (F.col("__in") + F.col("__base")).cast("bigint") + start).select(*df.columns, into)


def header_offsets(segments: list[tuple[str, Column]]) -> list[Column]:
    """Where each of consecutive segments begins, as columns named after them."""
    at, out = F.lit(0).cast("bigint"), []
    for name, size in segments:
        out.append(at.alias(f"{name}_at"))
        at = at + size
    return [*out, at.alias("end_at")]


def admitted(df: DataFrame, size: str, tie: str, k: int, allowed: int, by: list[str]) -> DataFrame:
    """(by..., readers): how many of the k largest sizes, taken from the largest on, stay below allowed in sum; one at least."""
    order = Window.partitionBy(*by).orderBy(F.col(size).desc(), F.col(tie))
    ranked = df.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= k)
    running = ranked.withColumn("upto", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return running.groupBy(*by).agg(F.greatest(F.lit(1), F.count_if(F.col("upto") < allowed)).cast("bigint").alias("readers"))


def greedy_parts(df: DataFrame, weight: str, order: str, by: list[str], parts: int, into: str = "part", run: int | None = None) -> DataFrame:
    """df with the part of each row: an item goes to the part in which the middle of its weight lies, at most one new
    part is opened with an item, and no part lies beyond the last. No loop: running counts, sums and a running minimum.

    For long groups run cuts a whole-numbered order into runs of that many values: sums and minima go over the runs first
    and then within each, so no task sorts a whole group.
    """
    cut = df.withColumn("__run", F.expr(f"{order} div {int(run)}") if run else F.lit(0).cast("bigint"))
    same = lambda: reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in [*by, "__run"]))
    key = [F.col(c).alias(f"__of_{c}") for c in [*by, "__run"]]
    before = Window.partitionBy(*(f"__of_{c}" for c in by)).orderBy("__of___run").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(f"__of_{c}" for c in by))
    runs = cut.groupBy(*key).agg(F.count(F.lit(1)).alias("__c"), F.sum(weight).cast("bigint").alias("__w"))
    bases = runs.select(
        *(f"__of_{c}" for c in [*by, "__run"]), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__i0"), F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__p0"),
        F.sum("__c").over(whole).alias("__n"), F.sum("__w").over(whole).alias("__s"),
    )
    within = Window.partitionBy(*by, "__run").orderBy(order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = cut.withColumn("__i", (F.row_number().over(within) - 1).cast("bigint")).withColumn("__p", F.sum(weight).over(upto).cast("bigint"))
    placed = numbered.join(bases, same()).withColumn("__i", F.col("__i") + F.col("__i0")).withColumn("__p", F.col("__p") + F.col("__p0"))
    x = f"(least(__n, {int(parts)}) * (2 * __p - {weight}))"
    middle = placed.withColumn("__g", F.expr(f"CASE WHEN __s = 0 THEN 0L ELSE greatest(0L, {x} div (2 * __s) + CASE WHEN {x} % (2 * __s) <> 0 THEN 1L ELSE 0L END - 1L) END"))
    middle = middle.withColumn("__slack", F.col("__g") - F.col("__i")).drop(*(f"__of_{c}" for c in [*by, "__run"]))
    least = middle.groupBy(*key).agg(F.min("__slack").alias("__m")).select(*(f"__of_{c}" for c in [*by, "__run"]), F.min("__m").over(before).alias("__m0"))
    met = middle.withColumn("__slack", F.min("__slack").over(upto)).join(least, same())
    slack = F.least(F.col("__slack"), F.coalesce("__m0", F.col("__slack")))
    part = F.when((F.col("__s") == 0) | (F.least("__n", F.lit(parts)) <= 1), F.lit(0)).otherwise(F.least(F.col("__i") + 1, F.col("__i") + slack, F.least("__n", F.lit(parts)) - 1))
    return met.select(*(F.col(f"`{c}`") for c in df.columns if c != into), part.cast("bigint").alias(into))


def best_cuts(weights: list[int], parts: int) -> list[int]:
    """The part of each item when the largest part is as small as can be: a bisection over the largest sum, then parts
    filled from the left without leaving fewer items than parts."""
    n = len(weights)
    parts = min(parts, n)
    if parts <= 1:
        return [0] * n
    low, high = max(weights), sum(weights)
    while low < high:
        most, used, total = (low + high) // 2, 1, 0
        for w in weights:
            if total + w > most:
                used, total = used + 1, 0
            total += w
        low, high = (low, most) if used <= parts else (most + 1, high)
    out, part, total = [], 0, 0
    for k, w in enumerate(weights):
        if k and part < parts - 1 and (total + w > low or n - k <= parts - 1 - part):
            part, total = part + 1, 0
        total += w
        out.append(part)
    return out


def best_parts(df: DataFrame, weight: str, order: str, by: str, parts: int) -> DataFrame:
    """(by, order, weight, part): the cut with the least largest part, one task for each group. A group is the index of
    one archive, which its fixed index region keeps to a few thousand rows; longer lists take greedy_parts."""
    kept = df.select(by, order, weight)

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        return rows.assign(part=best_cuts([int(w) for w in rows[weight]], parts))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + ", part bigint"
    return kept.groupBy(by).applyInPandas(cut, schema)


#: The estimated cost of the exact cut beyond which the greedy one is taken, and the estimate's terms.
COST_LIMIT, COST_SCALE, COST_POWERS, COST_FACTOR = 100, 5000, (1.6565, 0.617), 1.75e-4


def exact_is_cheap(n: int, parts: int, limit: int = COST_LIMIT) -> bool:
    """Whether n weights are cut exactly: into three parts or more, at an estimated cost within the limit."""
    parts = min(n, parts)
    return parts > 2 and round(max(parts * n / COST_SCALE, n ** COST_POWERS[0] * parts ** COST_POWERS[1] * COST_FACTOR)) <= limit


def greedy_cuts(weights: list[int], parts: int) -> list[int]:
    """The part of each item as greedy_parts gives it, for short lists."""
    total, k = sum(weights), min(len(weights), parts)
    out, upto, slack = [], 0, None
    for i, w in enumerate(weights):
        upto += w
        middle = max(0, -(-k * (2 * upto - w) // (2 * total)) - 1) if total else 0
        slack = middle - i if slack is None else min(slack, middle - i)
        out.append(0 if not total or k <= 1 else min(i + 1, i + slack, k - 1))
    return out


def cuts_by_cost(weights: list[int], parts: int, limit: int = COST_LIMIT) -> list[int]:
    return (best_cuts if exact_is_cheap(len(weights), parts, limit) else greedy_cuts)(weights, parts)


def balanced_parts(df: DataFrame, weight: str, order: str, by: str, parts: int, limit: int = COST_LIMIT) -> DataFrame:
    """(by, order, weight, part): each group cut exactly where that is estimated to be cheap, greedily elsewhere. The
    estimate bounds what one task gathers to a few thousand rows."""
    kept = df.select(by, order, weight)
    sized = kept.groupBy(F.col(by).alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    k = F.least("__n", F.lit(parts))
    cost = F.round(F.greatest(k * F.col("__n") / COST_SCALE, F.pow("__n", F.lit(COST_POWERS[0])) * F.pow(k, F.lit(COST_POWERS[1])) * COST_FACTOR))
    judged = kept.join(sized.withColumn("__exact", (k > 2) & (cost <= limit)), F.col(by).eqNullSafe(F.col("__of")))
    exact = best_parts(judged.where("__exact").select(by, order, weight), weight, order, by, parts)
    return exact.unionByName(greedy_parts(judged.where("NOT __exact").select(by, order, weight), weight, order, [by], parts))


def best_marks(ends: np.ndarray, total: int, parts: int) -> list[int] | None:
    """The parts - 1 different values of ends, which ascend and are below total, whose largest gap, from 0 on and up to
    total, is as small as can be: a bisection over the gap, then the farthest marks that leave enough. None if too few."""
    cuts = parts - 1
    if len(ends) < cuts:
        return None

    def filled(most: int) -> list[int] | None:
        out, at, last = [], 0, -1
        for j in range(cuts):
            i = min(int(np.searchsorted(ends, at + most, side="right")) - 1, len(ends) - cuts + j)
            if i <= last:
                return None
            at, last = int(ends[i]), i
            out.append(at)
        return out if total - at <= most else None

    low, high = -(-total // parts), largest_gap([int(x) for x in ends[:cuts]], total)
    while low < high:
        most = (low + high) // 2
        low, high = (low, most) if filled(most) is not None else (most + 1, high)
    return filled(low)


def largest_gap(marks: list[int], total: int) -> int:
    return max(b - a for a, b in zip([0, *marks], [*marks, total], strict=True))


def least_parts(df: DataFrame, weight: str, order: str, by: str, parts: int) -> DataFrame:
    """(by, total, largest, marks): the exact cut of groups of any length into contiguous parts with the least largest one.

    marks are the running sums at which all parts but the last end. Rows of equal order, a whole number, stay together,
    no part is empty or only of zeros, and groups that can't be cut so give no row; rows without group, order or weight
    take no part. A group's order is cut into about as many runs as a run has rows. Sums of runs give a cut at their
    ends, so a limit G of the largest part; as the j-th mark of a best cut lies between total - (parts - j) * G and j * G,
    rows are only looked at in runs that reach there. Orders that crowd in few runs, or single rows as heavy as a part,
    leave more of a group to one task, but never change the result.
    """
    if parts < 2:
        raise ValueError("a cut makes two parts at least")
    kept = df.select(F.col(by).alias("__by"), F.col(order).alias("__order"), F.col(weight).cast("bigint").alias("__w")).dropna()
    sized = kept.groupBy(F.col("__by").alias("__of")).agg(F.count(F.lit(1)).alias("__n"), F.min("__order").alias("__low"), F.max("__order").alias("__high"))
    width = sized.select("__of", F.expr("(__high div 2 - __low div 2) div (cast(sqrt(__n) AS bigint) + 1) + 1").alias("__width"))
    cut = kept.join(width, F.col("__by") == F.col("__of")).select("__by", F.expr("__order div 2 div __width").alias("__run"), "__order", "__w")
    down, up = F.sum(F.least("__w", F.lit(0))).alias("__down"), F.sum(F.greatest("__w", F.lit(0))).alias("__up")
    runs = cut.groupBy("__by", "__run").agg(F.sum("__w").alias("__w"), down, up)

    def near(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__run")
        upto = rows["__w"].cumsum()
        base, total = upto - rows["__w"], int(upto.iloc[-1])
        marks = best_marks(np.unique(upto[upto < total]), total, parts)
        reached = np.full(len(rows), marks is None)
        if marks is not None:
            limit = largest_gap(marks, total)
            for j in range(1, parts):
                reached |= ((base + rows["__up"] >= total - (parts - j) * limit) & (base + rows["__down"] <= j * limit)).to_numpy()
        return rows.assign(__base=base, __total=total)[reached][["__by", "__run", "__base", "__total"]]

    kind = kept.schema["__by"].dataType.simpleString()
    chosen = runs.groupBy("__by").applyInPandas(near, f"__by {kind}, __run bigint, __base bigint, __total bigint")
    chosen = chosen.select(F.col("__by").alias("__of"), F.col("__run").alias("__of_run"), "__base", "__total")
    within = Window.partitionBy("__by", "__run").orderBy("__order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = cut.join(chosen, (F.col("__by") == F.col("__of")) & (F.col("__run") == F.col("__of_run")))
    ends = met.select("__by", "__total", (F.sum("__w").over(within) + F.col("__base")).alias("__upto"))

    def marked(rows: pd.DataFrame) -> pd.DataFrame:
        total = int(rows["__total"].iloc[0])
        marks = best_marks(np.unique(rows["__upto"][rows["__upto"] < total]), total, parts)
        found = [] if marks is None else [(rows["__by"].iloc[0], total, largest_gap(marks, total), marks)]
        return pd.DataFrame(found, columns=["__by", "total", "largest", "marks"])

    out = ends.groupBy("__by").applyInPandas(marked, f"__by {kind}, total bigint, largest bigint, marks array<bigint>")
    return out.select(F.col("__by").alias(by), "total", "largest", "marks")


def chunk_plan(df: DataFrame, length: str, chunk: int) -> DataFrame:
    """df with a row for each chunk: chunk_idx, chunk_offset, chunk_length; none for length 0."""
    if chunk < 1:
        raise ValueError("chunks must have a byte at least")
    count = F.expr(f"({length} + {chunk} - 1) div {chunk}")
    exploded = df.where(F.col(length) > 0).withColumn("chunk_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
    at = F.col("chunk_idx") * chunk
    return exploded.withColumn("chunk_offset", at).withColumn("chunk_length", F.least(F.lit(chunk).cast("bigint"), F.col(length) - at))

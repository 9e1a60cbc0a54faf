"""Nested structures as rows of paths, and back.

A path is an array of struct(kind, key, idx): kind 'key' for mappings, 'index' for sequences.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATH = "array<struct<kind:string,key:string,idx:int>>"


def key_step(c: Column) -> Column:
    return F.struct(F.lit("key").alias("kind"), c.cast("string").alias("key"), F.lit(None).cast("int").alias("idx"))


def index_step(c: Column) -> Column:
    return F.struct(F.lit("index").alias("kind"), F.lit(None).cast("string").alias("key"), c.cast("int").alias("idx"))


def path_text(path: str) -> Column:
    """A path as compact JSON text: strings quoted, indexes bare."""
    quoted = lambda s: F.when(s["kind"] == "key", F.to_json(F.array(s["key"]))).otherwise(F.concat(F.lit("["), s["idx"].cast("string"), F.lit("]")))
    parts = F.transform(F.col(path), lambda s: F.regexp_replace(quoted(s), r"^\[|\]$", ""))
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def flatten(obj: Any, prefix: tuple = ()) -> list[tuple[tuple, Any]]:
    """(path, leaf) of every leaf of nested mappings and sequences, depth first."""
    if isinstance(obj, Mapping):
        bad = next((k for k in obj if not isinstance(k, str)), None)
        if bad is not None:
            raise TypeError(f"keys of mappings must be strings, not {type(bad).__name__}")
        steps = obj.items()
    elif isinstance(obj, Sequence) and not isinstance(obj, str | bytes):
        steps = enumerate(obj)
    elif not prefix:
        raise TypeError(f"not a mapping or a sequence: {type(obj).__name__}")
    else:
        return [(prefix, obj)]
    return [leaf for k, v in steps for leaf in flatten(v, (*prefix, k))]


def restructure(leaves: list[tuple[tuple, Any]], lists: bool = True) -> Any:
    """The nested object of (path, leaf) rows: a layer of strings is a dict, one of numbers a list in the order of its
    numbers with gaps closed (a dict of numbers unless lists); a layer of both, a repeated path, or a leaf above other
    leaves is an error."""
    check_paths([p for p, _ in leaves])
    root: dict = {}
    for path, leaf in leaves:
        at = root
        for step in path[:-1]:
            at = at.setdefault(step, {})
        at[path[-1]] = _Leaf(leaf)

    def close(layer):
        if isinstance(layer, _Leaf):
            return layer.value
        if layer and lists and isinstance(next(iter(layer)), int):
            return [close(layer[k]) for k in sorted(layer)]
        return {k: close(v) for k, v in layer.items()}

    return close(root)


class _Leaf:
    def __init__(self, value):
        self.value = value


def check_paths(paths: list[tuple]) -> None:
    """Raises for repeated paths, leaves above other leaves, and layers of both strings and numbers."""
    leaves, kinds, inner = set(), {}, set()
    for path in paths:
        if not path:
            raise ValueError("empty path")
        if path in leaves:
            raise ValueError(f"repeated path {path}")
        leaves.add(path)
        for k, step in enumerate(path):
            kind = kinds.setdefault(path[:k], type(step))
            if kind is not type(step):
                raise ValueError(f"strings and numbers in one layer at {path[:k]}")
            if k:
                inner.add(path[:k])
    if both := leaves & inner:
        raise ValueError(f"both a leaf and a branch: {sorted(map(repr, both))[0]}")


def repeated_paths(df: DataFrame, path: str) -> DataFrame:
    return df.groupBy(path).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(path, F.lit("repeated").alias("conflict"))


def branch_leaves(df: DataFrame, path: str) -> DataFrame:
    """Leaves whose path is a proper prefix of another path: an equi-join on exploded prefixes."""
    longer = df.where(F.size(path) > 1)
    prefixes = longer.select(F.explode(F.expr(f"transform(sequence(1, size({path}) - 1), k -> slice({path}, 1, k))")).alias(path))
    return df.select(path).distinct().join(prefixes.distinct(), path, "left_semi").select(path, F.lit("leaf and branch").alias("conflict"))


def mixed_layers(df: DataFrame, path: str) -> DataFrame:
    """Parents whose children are both keys and indexes."""
    layers = df.select(F.explode(F.expr(f"transform(sequence(1, size({path})), k -> struct(slice({path}, 1, k - 1) AS parent, {path}[k - 1].kind AS kind))")).alias("x"))
    return layers.groupBy(F.col("x.parent").alias(path)).agg(F.count_distinct("x.kind").alias("kinds")).where("kinds > 1").select(path, F.lit("mixed layer").alias("conflict"))


def conflicts(df: DataFrame, path: str) -> DataFrame:
    return repeated_paths(df, path).unionByName(branch_leaves(df, path)).unionByName(mixed_layers(df, path))


def below(df: DataFrame, path: str, prefix: list[Column]) -> DataFrame:
    """Rows whose path begins with the steps of prefix, with these taken off; a leaf at the prefix has an empty path."""
    n = len(prefix)
    steps = F.array(*prefix).cast(PATH) if n else F.array().cast(PATH)
    return df.where(F.slice(path, 1, max(n, 1)) == steps if n else F.lit(True)).withColumn(path, F.slice(path, n + 1, F.greatest(F.size(path) - n, F.lit(0))))


def prune(df: DataFrame, selected: DataFrame, path: str) -> DataFrame:
    """The leaves of df whose paths selected(path) has; branches left without leaves have no rows."""
    return df.join(selected.select(path).distinct(), path, "left_semi")


def gather_list(df: DataFrame, parent: list[str], index: str, value: Column) -> DataFrame:
    """(parent..., items): the values of each parent's indexed children in the order of their indexes, gaps closed."""
    pair = F.struct(F.col(index).alias("i"), value.alias("v"))
    return df.groupBy(*parent).agg(F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["v"]).alias("items"))

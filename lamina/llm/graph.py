"""Connected components of links between documents, in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.util import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b): the least node that it is connected with.

    Each round gives every node the least label among its own, its neighbours' and that of the node its label names,
    so labels also jump along chains. Sums and joins only: no group of links meets in one task.
    """
    pairs = written(links.select("a", "b").unionByName(links.selectExpr("b AS a", "a AS b")).where("a <> b").distinct(), "links")
    labels = written(pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    table = labels
    while True:
        seen = pairs.join(labels, pairs["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        jump = labels.selectExpr("node AS via", "component AS beyond")
        moved = labels.join(seen, labels["node"] == seen["a"]).join(jump, F.col("component") == F.col("via"))
        moved = written(moved.select("node", F.col("component").alias("before"), F.least("component", "near", "beyond").alias("component")), "labels")
        discard(table)
        table, labels = moved, moved.select("node", "component")
        if moved.where("component <> before").isEmpty():
            discard(pairs)
            labels.written_at = moved.written_at
            return labels

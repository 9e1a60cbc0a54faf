"""Sessions with what the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lamina.sources.archive import register

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(builder: SparkSession.Builder | None = None, **settings: str) -> SparkSession:
    """A session of the builder's, or the current one's, cluster with the archive source registered."""
    return register((builder or SparkSession.builder).config(map=SETTINGS | settings).getOrCreate())

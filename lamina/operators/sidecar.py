"""Objects that refer to arrays kept beside them: (object_id, storage) pairs and a catalog, joined on the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import dedupe, layout


def save(objects: DataFrame, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(references, storages) of objects(object_id, ordinal, content...): equal content is stored once, under the index
    that counts the stored ones in their order; references keep each object's index."""
    firsts = dedupe.first_copy(objects, content, "ordinal", "stored_at")
    one = firsts.where("ordinal = stored_at").withColumns({"__one": F.lit(1).cast("bigint"), "__all": F.lit(0)})
    storages = layout.offsets(one, "__one", "ordinal", ["__all"], into="storage_idx", run=4096).withColumn("storage_idx", F.col("storage_idx").cast("int")).drop("__one", "__all")
    index = storages.select(F.col("stored_at").alias("__at"), "storage_idx")
    references = firsts.join(index, F.col("stored_at") == F.col("__at")).select("object_id", "storage_idx")
    return references, storages.drop("stored_at", "object_id")


def load(references: DataFrame, catalog: DataFrame) -> DataFrame:
    """references joined with a catalog whose paths begin with the storage's index."""
    stored = catalog.withColumn("__idx", F.col("path")[0]["idx"])
    return references.join(stored, F.col("storage_idx") == F.col("__idx"), "left").drop("__idx")

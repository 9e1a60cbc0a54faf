"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the pipeline writes it as Parquet and reads it again as
the next stage's docs. All but the last return the columns of documents, with n_chars counted anew where text changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import bpe, line_dedup, mixing, near_dedup, quality_rules
from lamina.llm.util import bounded_batches, quoted, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, in the cases of quality_rules.quality_filter: null, empty and very short
    texts go, null languages and sources are groups, repeated rows are judged alike, an empty table stays empty."""
    bounded_batches(spark)
    return quality_rules.quality_filter(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them, in the cases of line_dedup.drop_shared_lines. Documents keep
    their rows, even those left empty; null text becomes empty, n_chars is counted anew."""
    bounded_batches(spark)
    return line_dedup.drop_shared_lines(docs).select(*(quoted(c) if c != "n_chars" else F.length("text").cast("bigint").alias("n_chars") for c in docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, in the cases of near_dedup.drop_near_duplicates: texts without
    words, null or empty, are one group, rows that repeat the document that stays all stay."""
    bounded_batches(spark)
    return near_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen for the target weights, once for each epoch in which they are read, in the cases of mixing.mix.
    Its unit is words: tokens are known only after the last stage."""
    bounded_batches(spark)
    return mixing.mix(docs).select(*map(quoted, docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the text these decode to, in the cases of bpe.encode_texts and decode_ids:
    null and empty texts have no ids, very long ones are encoded whole."""
    bounded_batches(spark)
    encoded = bpe.with_round_trip(docs.select("doc_id", "lang", "source", "text"), "bpe")
    return encoded.select("doc_id", "lang", "source", "bpe.ids", "bpe.decoded", F.size("bpe.ids").cast("bigint").alias("n_tokens"))


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL has neither BagMinHash classes nor BPE; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

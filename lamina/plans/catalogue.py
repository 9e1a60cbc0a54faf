"""Queries over the reference tables and the SQL that must give the same rows.

Each query applies one operator of the library to whole tables. Vectors and texts stand for arrays: a row of embeddings
is a float32 array of its length, a row of documents an array of bytes.
"""

from __future__ import annotations

import io
import json
import os
import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina import archive as facade
from lamina.functions import scalars as fn
from lamina.operators import crypto, dedupe, layout, logs, relate, select, tree, verify
from lamina.sources import archive, model_proto, npy, pack
from lamina.sources import format as codec

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes(docs: DataFrame) -> DataFrame:
    """documents with n_bytes, the length of the text in UTF-8."""
    return docs.withColumn("n_bytes", F.octet_length("text").cast("bigint"))


# Totals, offsets and layout


@query("SELECT label, count(*) AS tensors, sum(4 * len(embedding))::BIGINT AS total_bytes, max(4 * len(embedding))::BIGINT AS largest FROM embeddings GROUP BY label")
def catalog_totals(spark, sf_dir):
    """Vectors as float32 arrays: count, bytes and the largest by label."""
    sized = table(spark, sf_dir, "embeddings").withColumn("length", fn.full_length(F.lit(0), F.lit("<f4"), F.array(F.size("embedding"))))
    return sized.groupBy("label").agg(F.count(F.lit(1)).alias("tensors"), F.sum("length").alias("total_bytes"), F.max("length").alias("largest"))


@query("""SELECT label, vec_id, 4 * len(embedding)::BIGINT AS length,
    coalesce(sum(4 * len(embedding)) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 262217 AS "offset" FROM embeddings""")
def catalog_offsets(spark, sf_dir):
    """Where each vector's record would begin in an archive of its label: the running sum of lengths after the index."""
    sized = table(spark, sf_dir, "embeddings").select("label", "vec_id", (F.size("embedding") * 4).cast("bigint").alias("length"))
    return layout.offsets(sized, "length", "vec_id", ["label"], start=262217)


@query("""SELECT o_orderkey, 0::BIGINT AS start_at, 13::BIGINT AS name_at, 13 + strlen(o_orderpriority) AS dtype_at,
    13 + strlen(o_orderpriority) + 1 + strlen(o_orderstatus) AS shape_at, 13 + strlen(o_orderpriority) + 1 + strlen(o_orderstatus) + 5 AS end_at FROM orders""")
def header_offsets(spark, sf_dir):
    """Segments of a record header whose name and type are the texts of a row."""
    size = lambda c: F.octet_length(c).cast("bigint")
    segments = [("start", F.lit(13).cast("bigint")), ("name", size("o_orderpriority")), ("dtype", 1 + size("o_orderstatus")), ("shape", F.lit(5).cast("bigint"))]
    return table(spark, sf_dir, "orders").select("o_orderkey", *layout.header_offsets(segments))


_COLUMNS = {"l_orderkey": 8, "l_partkey": 8, "l_suppkey": 8, "l_linenumber": 4, "l_quantity": 8, "l_extendedprice": 8, "l_discount": 8, "l_tax": 8}


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS numel, {s} AS itemsize, count({c}) * {s} AS total_bytes FROM lineitem" for c, s in _COLUMNS.items()))
def column_catalog(spark, sf_dir):
    """Columns of a table as one-dimensional arrays."""
    counted = table(spark, sf_dir, "lineitem").agg(*(F.count(c).alias(c) for c in _COLUMNS))
    rows = counted.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("numel"), F.lit(s).alias("itemsize")) for c, s in _COLUMNS.items()))))
    return rows.withColumn("total_bytes", F.col("numel") * F.col("itemsize"))


@query("""SELECT lang, greatest(1, count(*) FILTER (WHERE upto < 200000))::BIGINT AS readers FROM (
    SELECT lang, sum(n) OVER (PARTITION BY lang ORDER BY n DESC, doc_id ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY lang ORDER BY n DESC, doc_id) AS turn
    FROM (SELECT lang, doc_id, strlen(text) AS n FROM documents)) WHERE turn <= 8 GROUP BY lang""")
def ram_admission(spark, sf_dir):
    """How many of each language's eight largest texts fit in memory together."""
    return layout.admitted(_bytes(table(spark, sf_dir, "documents")), "n_bytes", "doc_id", 8, 200_000, ["lang"])


@query("""WITH a AS (SELECT lang, doc_id, strlen(text) AS w FROM documents),
    b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, (sum(w) OVER (PARTITION BY lang ORDER BY doc_id))::BIGINT AS p, (sum(w) OVER (PARTITION BY lang))::BIGINT AS s,
        least(8, count(*) OVER (PARTITION BY lang)) AS k FROM a),
    c AS (SELECT *, CASE WHEN s = 0 THEN 0 ELSE greatest(0, (k * (2 * p - w)) // (2 * s) + CASE WHEN (k * (2 * p - w)) % (2 * s) <> 0 THEN 1 ELSE 0 END - 1) END AS g FROM b)
    SELECT lang, doc_id, w AS n_bytes, CASE WHEN s = 0 OR k <= 1 THEN 0 ELSE least(i + 1, i + min(g - i) OVER (PARTITION BY lang ORDER BY doc_id), k - 1) END::BIGINT AS part FROM c""")
def greedy_partition(spark, sf_dir):
    """Each language's texts cut into eight contiguous parts of about equal bytes."""
    return layout.greedy_parts(_bytes(table(spark, sf_dir, "documents")).select("lang", "doc_id", "n_bytes"), "n_bytes", "doc_id", ["lang"], 8, run=64)


@query("""WITH a AS (SELECT p_size, p_partkey, p_size * (p_partkey % 7 + 1) AS w FROM part),
    b AS (SELECT *, sum(w) OVER (PARTITION BY p_size ORDER BY p_partkey) AS upto, sum(w) OVER (PARTITION BY p_size) AS total FROM a)
    SELECT p_size, min(greatest(upto, total - upto))::BIGINT AS largest FROM b GROUP BY p_size""")
def exact_partition(spark, sf_dir):
    """The least largest of two contiguous parts, by group."""
    weighted = table(spark, sf_dir, "part").select("p_size", "p_partkey", (F.col("p_size") * (F.col("p_partkey") % 7 + 1)).alias("weight"))
    parts = layout.best_parts(weighted, "weight", "p_partkey", "p_size", 2)
    return parts.groupBy("p_size", "part").agg(F.sum("weight").alias("total")).groupBy("p_size").agg(F.max("total").alias("largest"))


@query("""WITH a AS (SELECT p_size, p_partkey, p_size * (p_partkey % 7 + 1) AS w FROM part),
    b AS (SELECT p_size, sum(w) OVER (PARTITION BY p_size ORDER BY p_partkey) AS upto, sum(w) OVER (PARTITION BY p_size) AS total FROM a)
    SELECT x.p_size, min(greatest(x.upto, y.upto - x.upto, x.total - y.upto))::BIGINT AS largest FROM b x JOIN b y ON x.p_size = y.p_size AND x.upto < y.upto AND y.upto < y.total GROUP BY x.p_size""")
def balanced_partition(spark, sf_dir):
    """The least largest of three contiguous parts, by group, however long the groups are."""
    weighted = table(spark, sf_dir, "part").select("p_size", "p_partkey", (F.col("p_size") * (F.col("p_partkey") % 7 + 1)).alias("weight"))
    return layout.least_parts(weighted, "weight", "p_partkey", "p_size", 3).select("p_size", "largest")


@query("""SELECT doc_id, n_bytes, k AS chunk_idx, 2048 * k AS chunk_offset, least(2048, n_bytes - 2048 * k) AS chunk_length FROM (
    SELECT doc_id, n_bytes, unnest(range((n_bytes + 2047) // 2048)) AS k FROM (SELECT doc_id, strlen(text) AS n_bytes FROM documents))""")
def chunk_plan(spark, sf_dir):
    return layout.chunk_plan(_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes"), "n_bytes", 2048)


@query("""SELECT l_returnflag, max(greatest(1, CASE WHEN l_linestatus = 'F' THEN 2 ELSE 1 END, CASE WHEN l_discount > 0.09 THEN 3 ELSE 1 END, CASE WHEN l_tax = 0 THEN 4 ELSE 1 END))::INTEGER AS version,
    bit_or(CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END | CASE WHEN l_tax = 0 THEN 2 ELSE 0 END)::INTEGER AS flags FROM lineitem GROUP BY l_returnflag""")
def version_reduce(spark, sf_dir):
    """The format version that a set of arrays needs, and the union of their feature flags."""
    encrypted, meta = F.col("l_discount") > 0.09, F.col("l_tax") == 0
    flags = F.when(encrypted, 1).otherwise(0).bitwiseOR(F.when(meta, 2).otherwise(0))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.max(layout.version(F.col("l_linestatus") == "F", encrypted, meta)).alias("version"), F.bit_or(flags).alias("flags"))


@query("SELECT event_type, count(*) AS tensors, sum(strlen(props))::BIGINT AS total_bytes FROM events GROUP BY event_type")
def written_totals(spark, sf_dir):
    return layout.totals(table(spark, sf_dir, "events").withColumn("n", F.octet_length("props").cast("bigint")), "n", "event_type")


# Selection


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small')")
def filter_prefix(spark, sf_dir):
    return select.name_prefix(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "small")


@query("SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^(?:[A-Z]+ (ANODIZED|PLATED)|S.*L$|[a-m])')")
def filter_regex(spark, sf_dir):
    return select.name_match(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", "[A-Z]+ (ANODIZED|PLATED)|S.*L$|[a-m]")


@query("SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '[135]$')")
def filter_callable(spark, sf_dir):
    """An arbitrary Python predicate on names."""
    return select.name_filter(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", _odd_end)


def _odd_end(name: str) -> bool:
    return name[-1:] in ("1", "3", "5")


@query("SELECT page_id, string_split(url, '/') AS path FROM pages WHERE string_split(url, '/')[1:3] = (SELECT string_split(min(url), '/')[1:3] FROM pages)")
def subtree_filter(spark, sf_dir):
    """Pages below the first host, addresses seen as paths."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.split("url", "/").alias("path"))
    first = table(spark, sf_dir, "pages").agg(F.min("url")).first()[0] or ""
    return select.subtree(pages, "path", first.split("/")[:3])


@query("""SELECT '[' || turn || ',"' || role || '"]' AS path_json, strlen(text) AS n_bytes FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)""")
def tree_below(spark, sf_dir):
    """What lies below one conversation, its own step taken off the paths."""
    path = F.array(tree.key_step(F.col("conv_id")), tree.index_step(F.col("turn")), tree.key_step(F.col("role")))
    rows = table(spark, sf_dir, "conversations").select(path.alias("path"), F.octet_length("text").cast("bigint").alias("n_bytes"))
    first = table(spark, sf_dir, "conversations").agg(F.min("conv_id")).first()[0]
    return tree.below(rows, "path", [tree.key_step(F.lit(first))]).select(tree.path_text("path").alias("path_json"), "n_bytes")


@query("""SELECT '["' || conv_id || '",' || turn || ']' AS path_json, count(*) AS n FROM conversations WHERE role = 'user' OR turn = 0 GROUP BY ALL""")
def tree_prune(spark, sf_dir):
    """Leaves of conversations that a selection names."""
    rows = table(spark, sf_dir, "conversations").withColumn("path", F.array(tree.key_step(F.col("conv_id")), tree.index_step(F.col("turn")), tree.key_step(F.col("role"))))
    kept = tree.prune(rows.select("path"), rows.where("role = 'user' OR turn = 0"), "path").withColumn("path", F.slice("path", 1, 2))
    return kept.groupBy("path").agg(F.count(F.lit(1)).alias("n")).select(tree.path_text("path").alias("path_json"), "n")


@query("""SELECT doc_id, '["' || lang || '",' || doc_id || ',"' || source || '"]' AS path_json, 3 AS depth FROM documents""")
def path_codec(spark, sf_dir):
    """Paths written as structured names and parsed again."""

    @F.arrow_udf("array<string>")
    def coded(langs: pa.Array, ids: pa.Array, sources: pa.Array) -> pa.Array:
        paths = [codec.decode_path(codec.encode_path(p)) for p in zip(langs.to_pylist(), ids.to_pylist(), sources.to_pylist(), strict=True)]
        return pa.array([[json.dumps(list(p), separators=(",", ":")), str(len(p))] for p in paths], pa.list_(pa.string()))

    rows = table(spark, sf_dir, "documents").select("doc_id", coded("lang", "doc_id", "source").alias("x"))
    return rows.select("doc_id", F.col("x")[0].alias("path_json"), F.col("x")[1].cast("int").alias("depth"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100")
def read_limit(spark, sf_dir):
    """A limited read, the limit being the feature."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return select.read_limit(orders, "o_orderkey", 100, where=F.col("o_orderstatus") == "F").drop("o_orderstatus")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 50")
def read_resume(spark, sf_dir):
    """A limited read that goes on where another stopped."""
    return select.read_limit(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 50, after=1000)


@query("SELECT * FROM customer WHERE c_custkey = (SELECT max(c_custkey) FROM customer)")
def point_get(spark, sf_dir):
    """One array by name; none or several would be an error."""
    customers = table(spark, sf_dir, "customer")
    last = customers.agg(F.max("c_custkey").alias("c_custkey"))
    return select.exactly_one(customers.join(F.broadcast(last), "c_custkey", "left_semi"))


@query("SELECT o.o_orderkey, o.o_custkey, c.c_acctbal AS position FROM orders o JOIN customer c ON o.o_orderkey = c.c_custkey")
def requested_order(spark, sf_dir):
    """Rows that another table asks for, in its order."""
    request = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_orderkey"), F.col("c_acctbal").alias("position"))
    return select.requested(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), request, "o_orderkey", "position")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 8")
def topk_largest(spark, sf_dir):
    return select.top_k(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 8, F.col("n_chars").desc(), F.col("doc_id"))


@query("SELECT source AS key, min(doc_id) AS first FROM documents GROUP BY source")
def top_level_keys(spark, sf_dir):
    paths = table(spark, sf_dir, "documents").select(F.array("source", "lang").alias("path"), "doc_id")
    return select.top_level(paths, "path", "doc_id")


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return select.duplicates(table(spark, sf_dir, "part"), "p_brand", "p_size")


@query("SELECT s_suppkey, substring(s_name, 3, 6) AS part FROM supplier")
def byte_range(spark, sf_dir):
    """Bytes 2 to 8 of names, which are plain ASCII."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", select.byte_range(F.col("s_name").cast("binary"), 2, 8).cast("string").alias("part"))


# Integrity


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def payload_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", verify.sha256(F.col("text").cast("binary")).alias("digest"))


@query("""WITH RECURSIVE bits AS (SELECT b, 0 AS k, b::BIGINT AS c FROM (SELECT unnest(range(256)) AS b)
        UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
    lookup AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8)
    SELECT c_custkey, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c_name) + 1), lambda i: ascii(c_name[i])::BIGINT)),
        lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS digest FROM customer, lookup""")
def payload_crc32(spark, sf_dir):
    """CRC-32 of names, which are plain ASCII; the SQL runs its table of 256 remainders over their bytes."""
    return table(spark, sf_dir, "customer").select("c_custkey", verify.crc32(F.col("c_name").cast("binary")).alias("digest"))


@query()
def payload_crc32_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", verify.crc32(F.col("text").cast("binary")).alias("digest"))


@query("""SELECT doc_id, CASE WHEN n_chars = 0 THEN 'meta' WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 3 THEN 'mismatch' ELSE 'ok' END AS status FROM documents""")
def verify_hash(spark, sf_dir):
    """Texts against stored digests, some of which are absent and some wrong."""
    digest = verify.sha256(F.col("text").cast("binary"))
    stored = F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 7 == 3, F.lit("0" * 64)).otherwise(digest)
    return table(spark, sf_dir, "documents").select("doc_id", verify.status(stored, digest, F.col("n_chars") == 0).alias("status"))


@query("SELECT s_name, s_suppkey % 11 <> 0 AS present, s_suppkey % 11 <> 0 AND s_suppkey % 3 <> 0 AS matches FROM supplier")
def verify_module(spark, sf_dir):
    """Names of an archive against a module that lacks some arrays and holds others changed."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.sha2(F.col("s_acctbal").cast("string"), 256).alias("digest"))
    changed = F.when(F.col("s_suppkey") % 3 == 0, F.reverse("digest")).otherwise(F.col("digest"))
    return verify.verify_module(rows, rows.where("s_suppkey % 11 <> 0").withColumn("digest", changed), "s_name", "digest")


@query("""SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)
    UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 EXCEPT SELECT doc_id FROM labels)""")
def key_diff(spark, sf_dir):
    return verify.key_difference(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").where("doc_id % 3 <> 0"), "doc_id")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'left' WHEN c_custkey % 10 = 1 THEN 'right' WHEN c_nationkey % 4 = 0 THEN 'differs' ELSE 'equal' END AS status FROM customer""")
def state_compare(spark, sf_dir):
    """Two states key by key."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    other = rows.where("c_custkey % 10 <> 0").withColumn("c_name", F.when(F.col("c_nationkey") % 4 == 0, F.upper(F.concat("c_name", F.lit("x")))).otherwise(F.col("c_name")))
    return verify.compare(rows.where("c_custkey % 10 <> 1"), other, ["c_custkey"], ["c_name", "c_acctbal"])


# Joins


@query("SELECT o_orderkey, o_orderkey || '.' || o_custkey || '.weight' AS name, o_orderkey || '.' || o_custkey AS module_path, 'weight' AS attribute, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def load_route(spark, sf_dir):
    """Names split at their last dot and joined with modules."""
    names = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(".", "o_orderkey", "o_custkey", F.lit("weight")).alias("name"))
    modules = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    modules = modules.select(F.concat_ws(".", "o_orderkey", "o_custkey").alias("module"), "c_mktsegment")
    return relate.load_route(names, modules, "name", "module").select("o_orderkey", "name", "module_path", "attribute", "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R' OR EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'P')")
def persistent_filter(spark, sf_dir):
    """All that are no buffers, and the buffers that the persistent set names."""
    persistent = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return relate.persistent_only(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), F.col("l_returnflag") == "R", persistent, ["l_orderkey"]).drop("l_returnflag")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def skip_existing(spark, sf_dir):
    existing = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return relate.skip_existing(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), existing, ["c_custkey"])


@query("""SELECT c_nationkey, c_custkey, (row_number() OVER (ORDER BY c_nationkey, c_custkey % 3 = 0, c_custkey) - 1)::BIGINT AS ordinal FROM customer WHERE c_custkey % 3 <> 0 OR c_acctbal > 0""")
def module_order(spark, sf_dir):
    """The order in which a tree of modules is written: of each its parameters, then its persistent buffers."""
    arrays = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (F.col("c_custkey") % 3 == 0).alias("is_buffer"), (F.col("c_acctbal") > 0).alias("persistent"))
    return relate.module_order(arrays, "c_nationkey", "is_buffer", "c_custkey", F.col("persistent")).select("c_nationkey", "c_custkey", "ordinal")


@query("""WITH b AS (SELECT doc_id, strlen(text) AS len, coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_at FROM documents),
    p AS (SELECT o_orderkey, o_custkey * 997 AS position FROM orders)
    SELECT o_orderkey, position, doc_id, position - begin_at AS within FROM p ASOF JOIN b ON p.position >= b.begin_at WHERE position < begin_at + len""")
def blob_lookup(spark, sf_dir):
    """Positions in the joined texts, and the text that holds each."""
    docs = _bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes").withColumn("store", F.lit("documents"))
    blobs = layout.offsets(docs, "n_bytes", "doc_id", ["store"], into="begin_at", run=256).where("n_bytes > 0")
    asked = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 997).alias("position"))
    return relate.locate(asked, blobs, "position", "begin_at", 1 << 14, "n_bytes").select("o_orderkey", "position", "doc_id", (F.col("position") - F.col("begin_at")).alias("within"))


@query("SELECT doc_id, lang || ':text:' || (doc_id * 37 % 1009) AS key, doc_id * 37 % 1009 AS begin_at FROM documents")
def blob_keys(spark, sf_dir):
    """Keys of a blob store in the order of the number they end in."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(":", "lang", F.lit("text"), F.col("doc_id") * 37 % 1009).alias("key"))
    return keyed.withColumn("begin_at", select.numeric_suffix("key")).orderBy("begin_at")


@query("""SELECT o.o_orderkey, coalesce(nullif(CASE WHEN n.n_nationkey % 5 = 0 THEN '' ELSE n.n_name END, ''), o.o_orderpriority) AS region, o.o_orderstatus
    FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def log_enrich(spark, sf_dir):
    """A column overwritten by that of another table where it is not empty."""
    info = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    info = info.select("c_custkey", F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.col("n_name")).alias("name"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("region"), "o_orderstatus")
    return relate.enrich(rows.withColumnRenamed("o_custkey", "c_custkey"), info, "c_custkey", {"region": "name"}).drop("c_custkey")


# Nested structures


@query("""SELECT '["' || conv_id || '",' || turn || ',"' || role || '"]' AS path_json, strlen(text) AS n_bytes FROM conversations""")
def tree_flatten(spark, sf_dir):
    """Conversations as paths: a key, an index, a key."""
    path = F.array(tree.key_step(F.col("conv_id")), tree.index_step(F.col("turn")), tree.key_step(F.col("role")))
    rows = table(spark, sf_dir, "conversations").select(path.alias("path"), F.octet_length("text").cast("bigint").alias("n_bytes"))
    return rows.select(tree.path_text("path").alias("path_json"), "n_bytes")


@query("SELECT conv_id, string_agg(role || '=' || strlen(text), '|' ORDER BY turn, role, text) AS items FROM conversations GROUP BY conv_id")
def tree_restructure(spark, sf_dir):
    """Turns gathered into lists in the order of their indexes."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("place"), F.concat_ws("=", "role", F.octet_length("text")).alias("v"))
    return tree.gather_list(rows, ["conv_id"], "place", F.col("v")).select("conv_id", F.array_join("items", "|").alias("items"))


@query("""WITH p AS (SELECT [r_name] AS path FROM region UNION ALL SELECT [r_name, n_name] FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT [n_name] FROM nation UNION ALL SELECT [n_name] FROM nation WHERE n_nationkey % 2 = 0)
    SELECT array_to_string(path, '/') AS path, 'repeated' AS conflict FROM p GROUP BY p.path HAVING count(*) > 1
    UNION ALL SELECT array_to_string(path, '/'), 'leaf and branch' FROM (SELECT DISTINCT path FROM p) q WHERE EXISTS (SELECT 1 FROM p WHERE len(p.path) > len(q.path) AND p.path[1:len(q.path)] = q.path)
    UNION ALL SELECT '', 'mixed layer'""")
def path_conflicts(spark, sf_dir):
    """Paths that no nested structure can hold together: repeated ones, leaves above leaves, keys beside indexes."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    step = tree.key_step
    both = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = (
        region.select(F.array(step(F.col("r_name"))).alias("path")).unionByName(both.select(F.array(step(F.col("r_name")), step(F.col("n_name"))).alias("path")))
        .unionByName(nation.select(F.array(step(F.col("n_name"))).alias("path"))).unionByName(nation.where("n_nationkey % 2 = 0").select(F.array(step(F.col("n_name"))).alias("path")))
    )
    mixed = tree.mixed_layers(rows.unionByName(region.where("r_regionkey = 0").select(F.array(tree.index_step(F.lit(0))).alias("path"))), "path")
    found = tree.repeated_paths(rows, "path").unionByName(tree.branch_leaves(rows, "path")).unionByName(mixed)
    return found.select(F.array_join(F.transform("path", lambda s: s["key"]), "/").alias("path"), "conflict")


# Elements and types


@query("SELECT vec_id, i - 1 AS flat_index, (i - 1) // 8 AS row_idx, (i - 1) % 8 AS col_idx, embedding[i]::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def elements_explode(spark, sf_dir):
    """Elements of vectors seen as matrices eight wide, with their coordinates."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    i = F.col("i").cast("bigint")
    return rows.select("vec_id", i.alias("flat_index"), F.floor(i / 8).alias("row_idx"), (i % 8).alias("col_idx"), F.col("x").cast("double").alias("value"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice::FLOAT::DOUBLE AS price, l_quantity::INTEGER AS quantity FROM lineitem")
def cast_dtype(spark, sf_dir):
    """A cast on read: double to float32, seen as double again."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("float").cast("double").alias("price"), F.col("l_quantity").cast("int").alias("quantity"))


@query("""WITH x AS (SELECT vec_id, i - 1 AS flat_index, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
    e AS (SELECT *, CASE WHEN v = 0 THEN 0 WHEN abs(v) / 2.0 ** floor(log2(abs(v))) < 1 THEN floor(log2(abs(v))) - 1
        WHEN abs(v) / 2.0 ** floor(log2(abs(v))) >= 2 THEN floor(log2(abs(v))) + 1 ELSE floor(log2(abs(v))) END AS k FROM x)
    SELECT vec_id, flat_index, CASE WHEN v = 0 THEN v ELSE sign(v) * floor(abs(v) / 2.0 ** (greatest(k, -126) - 7)) * 2.0 ** (greatest(k, -126) - 7) END AS value FROM e""")
def bf16_truncate(spark, sf_dir):
    """Vectors cut to bfloat16 by their upper 16 bits: towards zero at the eighth binary digit, as the SQL reckons."""
    from lamina.operators.dtype import bfloat16_values

    cut = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(bfloat16_values("embedding")).alias("flat_index", "value"))
    return cut.select("vec_id", F.col("flat_index").cast("bigint").alias("flat_index"), F.col("value").cast("double").alias("value"))


@query("""SELECT n_nationkey, coalesce(c.n, 0) AS elements, CASE WHEN c.n IS NULL THEN [0.0::DOUBLE, 0.0, 0.0, 0.0] ELSE c.v END AS value
    FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n, [min(c_acctbal), max(c_acctbal)] AS v FROM customer WHERE c_nationkey % 3 = 0 GROUP BY c_nationkey) c ON n_nationkey = c_nationkey""")
def meta_zero_fill(spark, sf_dir):
    """Arrays declared without data are read as zeros."""
    stored = table(spark, sf_dir, "customer").where("c_nationkey % 3 = 0").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.array(F.min("c_acctbal"), F.max("c_acctbal")).alias("v"))
    met = table(spark, sf_dir, "nation").join(stored, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return met.select("n_nationkey", F.coalesce("n", F.lit(0)).cast("bigint").alias("elements"), F.coalesce("v", F.array_repeat(F.lit(0.0), 4)).alias("value"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS stored_at FROM documents")
def storage_dedupe(spark, sf_dir):
    """Equal texts are stored once, where the first of them is."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return dedupe.first_copy(rows, ["digest"], "doc_id").drop("digest")


@query("SELECT user_id, count(*) AS uses, min(event_id) AS first_use FROM events GROUP BY user_id HAVING count(*) > 1")
def nonce_reuse(spark, sf_dir):
    """Values that must be used once but are not."""
    return dedupe.reused(table(spark, sf_dir, "events"), "user_id", "event_id")


# Scalars


@query("""WITH n AS (SELECT doc_id, (n_chars * n_chars * 53)::DOUBLE AS n FROM documents)
    SELECT doc_id, CASE WHEN n < 1000 THEN printf('%3.1f bytes', n) WHEN n / 1000 < 1000 THEN printf('%3.1f KB', n / 1000) WHEN n / 1000 / 1000 < 1000 THEN printf('%3.1f MB', n / 1000 / 1000)
        WHEN n / 1000 / 1000 / 1000 < 1000 THEN printf('%3.1f GB', n / 1000 / 1000 / 1000) ELSE printf('%3.1f TB', n / 1000 / 1000 / 1000 / 1000) END AS decimal_size,
    CASE WHEN n < 1024 THEN printf('%3.1f bytes', n) WHEN n / 1024 < 1024 THEN printf('%3.1f KiB', n / 1024) WHEN n / 1024 / 1024 < 1024 THEN printf('%3.1f MiB', n / 1024 / 1024)
        WHEN n / 1024 / 1024 / 1024 < 1024 THEN printf('%3.1f GiB', n / 1024 / 1024 / 1024) ELSE printf('%3.1f TiB', n / 1024 / 1024 / 1024 / 1024) END AS binary_size FROM n""")
def human_bytes(spark, sf_dir):
    sized = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * F.col("n_chars") * 53).alias("n"))
    return sized.select("doc_id", fn.human_bytes("n").alias("decimal_size"), fn.human_bytes("n", False).alias("binary_size"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS host, 6379 AS port, regexp_extract(url, '^[a-z]+://[^/?#]*/*([^?#]*)', 1) AS prefix FROM pages""")
def uri_parts(spark, sf_dir):
    """Parts of addresses, read as those of a keyed store."""
    store = fn.redis_uri(F.regexp_replace("url", "^[a-z]+://", "redis://")).alias("u")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), store).select("page_id", "scheme", "u.*")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '<V2' ELSE '<f4' END AS numpy_dtype, CASE WHEN p_size % 3 = 0 THEN 'bfloat16' END AS named, p_size % 3 = 0 AS opaque,
    CASE WHEN p_size % 3 = 0 THEN '<i2' ELSE '<f4' END AS decoder, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 4 END AS itemsize FROM part""")
def type_strings(spark, sf_dir):
    """Stored type strings taken apart: numpy type, type name, whether opaque, the type that decodes it, item size."""
    stored = F.when(F.col("p_size") % 3 == 0, F.lit("<V2\0torch.bfloat16")).otherwise(F.lit("<f4"))
    first, second = fn.split_dtype("stored")
    rows = table(spark, sf_dir, "part").select("p_partkey", stored.alias("stored")).select("p_partkey", first.alias("numpy_dtype"), second.alias("torch_dtype"))
    return rows.select("p_partkey", "numpy_dtype", fn.named_dtype("torch_dtype").alias("named"), fn.is_opaque("numpy_dtype").alias("opaque"), fn.decoder_dtype("numpy_dtype").alias("decoder"), fn.item_size("numpy_dtype").alias("itemsize"))


@query("""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host FROM pages)
    SELECT page_id, host, host = (SELECT min(host) FROM h) AS virtual, list_contains(string_split(host, '.'), 'accel') AS accelerated FROM h""")
def endpoint_classes(spark, sf_dir):
    """Hosts of addresses, and whether they call for virtual addressing or the older signature."""
    pages = table(spark, sf_dir, "pages")
    first = pages.agg(F.min(fn.endpoint_host("url"))).first()[0] or ""
    return pages.select("page_id", fn.endpoint_host("url").alias("host"), fn.needs_virtual_host("url", (first,)).alias("virtual"), fn.is_accelerated("url").alias("accelerated"))


@query("SELECT event_id, epoch(ts)::BIGINT - epoch(ts)::BIGINT % 86400 + 172800 AS expiry FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def aligned_expiry(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fn.aligned_expiry(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("expiry"))


@query("SELECT event_id, floor(value)::BIGINT - floor(value)::BIGINT % 128 AS lower, floor(value)::BIGINT + 1000 + (128 - (floor(value)::BIGINT + 1000) % 128) % 128 AS upper FROM events WHERE value >= 0")
def tick_bounds(spark, sf_dir):
    low = F.floor("value").cast("bigint")
    return table(spark, sf_dir, "events").where("value >= 0").select("event_id", fn.tick_bounds(low, low + 1000, 128).alias("t")).select("event_id", "t.*")


@query("SELECT event_type, CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' ELSE event_type END AS short, count(*) AS n FROM events GROUP BY ALL")
def nicknames(spark, sf_dir):
    named = table(spark, sf_dir, "events").select("event_type", fn.nickname("event_type", {"click": "c", "view": "v"}).alias("short"))
    return named.groupBy("event_type", "short").agg(F.count(F.lit(1)).alias("n"))


# Logs


@query("SELECT json_extract(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL")
def log_parse(spark, sf_dir):
    """Lines of a log parsed by an explicit schema; lines that are no objects fall out."""
    lines = table(spark, sf_dir, "events").select(F.concat(F.lit("  "), "props").alias("value"))
    noise = lines.limit(3).select(F.lit("# no object").alias("value"))
    return logs.parse_lines(lines.unionByName(noise), schema="k bigint").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def present_nodes(spark, sf_dir):
    """Rows of a table of nodes that a log mentions."""
    seen = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return logs.present_nodes(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), seen, "n_nationkey")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 4 <> 0 THEN user_id END, 0)::INTEGER AS plaid FROM events")
def zero_filled(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("plaid"))
    return rows.select("event_id", logs.zero_filled("plaid").alias("plaid"))


@query("SELECT event_id, user_id::INTEGER AS user_id, (CASE WHEN event_id % 5 <> 0 THEN event_id END)::DOUBLE AS size FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0")
def complete_rows(spark, sf_dir):
    """Rows without nulls in two columns, cast; nulls elsewhere don't matter."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("size"))
    return logs.complete_rows(rows, ["user_id", "size"], {"user_id": "int", "size": "double"})


@query("""SELECT event_type AS nodename, count(*) AS n, round(avg(value), 6) AS mean_rate, count(*) FILTER (WHERE event_id % 2 = 0) AS lazy FROM events GROUP BY event_type""")
def log_files(spark, sf_dir):
    """Log rows written as JSON lines into two folders, and both read again by the schema of logs."""
    folder = scratch(spark)
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("nodename"), F.col("value").alias("rate"), (F.col("event_id") % 2 == 0).alias("lazy_load"))
    logs.write_logs(rows.where("lazy_load"), f"{folder}/a")
    logs.write_logs(rows.where("NOT lazy_load"), f"{folder}/b")
    read = logs.read_logs(spark, f"{folder}/a", f"{folder}/b")
    return read.groupBy("nodename").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rate"), 6).alias("mean_rate"), F.count_if("lazy_load").alias("lazy"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, sf_dir):
    return logs.value_counts(table(spark, sf_dir, "events"), "event_type")


@query("""SELECT event_id, coalesce(nullif(concat_ws(chr(10), CASE WHEN event_id % 2 = 0 THEN 'lazy_load' END, CASE WHEN event_id % 3 = 0 THEN event_type END), ''), 'default') AS mode FROM events""")
def mode_labels(spark, sf_dir):
    lazy, kind = F.when(F.col("event_id") % 2 == 0, "lazy_load"), F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", fn.mode_label(lazy, kind).alias("mode"))


_SCHEMES = ["file", "http", "s3", "torch", "redis", "https", "local"]


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 16777216 ELSE 8388608 END AS buffer,
    list_extract(['file', 'http', 's3', 'torch', 'redis', 'https', 'local'], (l_partkey % 7 + 1)::INTEGER) AS scheme, l_returnflag = 'R' AS verified, l_linestatus = 'F' AS cached,
    l_discount > 0.05 AS raw, l_linenumber - 1 AS plaid, CASE WHEN l_suppkey % 2 = 0 THEN '40G' ELSE '10G' END AS link FROM lineitem)
    SELECT l_orderkey, l_linenumber FROM r WHERE ((buffer = 16777216 AND scheme NOT IN ('s3', 'redis', 's3s', 'https') AND NOT verified AND (scheme <> 'http' OR cached OR raw) AND plaid IN (0, 2)) OR scheme = 'torch') AND link = '40G'""")
def compound_mask(spark, sf_dir):
    """The mask that selects comparable local reads, over columns made from those of a table."""
    scheme = F.element_at(F.array(*map(F.lit, _SCHEMES)), (F.col("l_partkey") % 7 + 1).cast("int"))
    keep = logs.local_reads(
        F.when(F.col("l_quantity") > 25, 16 << 20).otherwise(8 << 20), scheme, F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", F.col("l_discount") > 0.05,
        F.col("l_linenumber") - 1, F.when(F.col("l_suppkey") % 2 == 0, "40G").otherwise("10G"),
    )
    return table(spark, sf_dir, "lineitem").where(keep).select("l_orderkey", "l_linenumber")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice / l_quantity), 6) AS mean_rate, round(stddev_samp(l_extendedprice / l_quantity), 6) AS sd_rate FROM lineitem GROUP BY ALL")
def rate_by_mode(spark, sf_dir):
    rates = logs.rate_by(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_extendedprice") / F.col("l_quantity"))
    return rates.withColumns({c: F.round(c, 6) for c in ("mean_rate", "sd_rate")})


@query("SELECT event_type, count(user_id) AS n_user_id, count(CASE WHEN value > 10 THEN value END) AS n_value FROM events GROUP BY event_type")
def counts_by_mode(spark, sf_dir):
    return logs.counts_by(table(spark, sf_dir, "events").withColumn("value", F.when(F.col("value") > 10, F.col("value"))), "event_type", ["user_id", "value"])


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.25), 9) AS lower_4, round(quantile_cont(value, 0.75), 9) AS upper_4,
    round(quantile_cont(value, 0.125), 9) AS lower_8, round(quantile_cont(value, 0.875), 9) AS upper_8 FROM events GROUP BY event_type""")
def letter_values(spark, sf_dir):
    found = logs.letter_values(table(spark, sf_dir, "events"), ["event_type"], "value")
    return found.select("event_type", *(F.round(c, 9).alias(c) for c in found.columns[1:]))


@query("SELECT event_id, value FROM events WHERE value BETWEEN (SELECT quantile_cont(value, 0.02) FROM events) AND (SELECT quantile_cont(value, 0.98) FROM events)")
def percentile_clip(spark, sf_dir):
    return logs.clip(table(spark, sf_dir, "events").select("event_id", "value"), "value")


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.9) AS p90, quantile_cont(l_quantity, 0.99) AS p99 FROM lineitem GROUP BY l_returnflag")
def lib_summary(spark, sf_dir):
    return logs.summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity").withColumn("mean", F.round("mean", 6))


@query("""SELECT bin, count(*) AS n FROM (SELECT least(49, floor((value - lo) * 50 / (hi - lo)))::BIGINT AS bin FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)) GROUP BY bin""")
def histogram50(spark, sf_dir):
    return logs.histogram(table(spark, sf_dir, "events"), "value")


@query("""SELECT event_type AS category, row_number() OVER (ORDER BY CASE event_type WHEN 'view' THEN 0 WHEN 'absent' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, event_type) AS position FROM (SELECT DISTINCT event_type FROM events)""")
def category_order(spark, sf_dir):
    return logs.category_order(table(spark, sf_dir, "events"), "event_type", ["view", "absent", "click"])


@query("""SELECT l_linenumber AS plaid_buffers, round(avg(l_extendedprice), 6) AS mean_rate FROM lineitem WHERE l_linenumber >= 2 GROUP BY l_linenumber""")
def line_means(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber >= 2").groupBy(F.col("l_linenumber").alias("plaid_buffers"))
    return rows.agg(F.round(F.avg("l_extendedprice"), 6).alias("mean_rate"))


@query("""SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 'https' WHEN starts_with(url, 'http://') THEN 'http' ELSE 'file' END AS scheme,
    regexp_extract(url, '//([^/:]*)', 1) AS peer FROM pages""")
def scheme_and_peer(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", logs.scheme_of(F.col("url"), F.lit(True)).alias("scheme"), logs.peer_of(F.col("url"), F.lit(None).cast("string")).alias("peer"))


# Archives


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share. Archives are files that tasks and driver open by name,
    so it must be on a file system that all nodes mount; a temporary one serves only where the session names none and all
    runs in one process."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp()
    out = f"{archive.local_path(named)}/{uuid.uuid4().hex}"
    os.makedirs(out)
    return out


_ELEMENTS = "SELECT 'vec.' || vec_id AS name, i - 1 AS flat_index, embedding[i]::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"


@query(_ELEMENTS)
def archive_roundtrip(spark, sf_dir):
    """Vectors written as one archive, read again as elements, digests checked on the way."""
    path = f"{scratch(spark)}/vectors.arr"
    archive.write(pack.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), path)
    return archive.read(spark, path, "elements", verify="true").select("name", "flat_index", "value")


@query(_ELEMENTS)
def archive_parts(spark, sf_dir):
    """Vectors written as a folder of archives, one from each task, and read as elements of them all."""
    path = f"{scratch(spark)}/vectors"
    archive.write(pack.vectors(table(spark, sf_dir, "embeddings").repartition(4, "vec_id"), "vec_id", "embedding"), path, parts="true")
    return archive.read(spark, path, "elements", verify="true").select("name", "flat_index", "value")


@query("SELECT 1 AS version, false AS encrypted, sum(4 * len(embedding))::BIGINT AS tensor_bytes, count(*) AS tensor_count FROM embeddings")
def archive_info(spark, sf_dir):
    """The file header of an archive of vectors."""
    path = f"{scratch(spark)}/vectors.arr"
    archive.write(pack.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), path)
    return archive.read(spark, path, "archive_info").select("version", "encrypted", "tensor_bytes", "tensor_count")


@query("""SELECT (row_number() OVER (ORDER BY doc_id) - 1)::INTEGER AS ordinal, 'text.' || doc_id AS name, '["text.' || doc_id || '"]' AS path_json, '|u1' AS numpy_dtype,
    strlen(text) AS numel, 1 AS itemsize, strlen(text) AS data_length, strlen(text) AS deserialized_length,
    (coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS bytes_before FROM documents""")
def archive_catalog(spark, sf_dir):
    """The index of an archive of texts: payloads lie in the order of ids, each after all before it and their headers."""
    path = f"{scratch(spark)}/texts.arr"
    archive.write(pack.texts(table(spark, sf_dir, "documents"), "doc_id", "text"), path)
    head = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = archive.read(spark, path, "catalog")
    start = F.min("header_offset").over(Window.partitionBy("archive"))
    before = F.col("data_offset") - start - F.sum(F.col("data_offset") - F.col("header_offset")).over(head)
    return rows.select("ordinal", "name", "path_json", "numpy_dtype", "numel", "itemsize", "data_length", "deserialized_length", before.cast("bigint").alias("bytes_before"))


@query("SELECT 'vec.' || vec_id AS name, 4 * len(embedding)::BIGINT AS data_length FROM embeddings WHERE 'vec.' || vec_id IN ('vec.3', 'vec.44') OR starts_with('vec.' || vec_id, 'vec.1')")
def archive_filters(spark, sf_dir):
    """Names chosen in the index by set, by prefix and by pattern, and by predicates over one DataFrame in two branches."""
    path = f"{scratch(spark)}/vectors.arr"
    archive.write(pack.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), path)
    found = [archive.read(spark, path, "catalog", names=["vec.3", "vec.44"]), archive.read(spark, path, "catalog", namePrefix="vec.1"), archive.read(spark, path, "catalog", nameRegex=r"vec\.(3|44)$")]
    rows = archive.read(spark, path, "catalog")
    found += [rows.where(F.col("name").isin("vec.3", "vec.44")), select.name_prefix(rows, "name", "vec.1")]
    return reduce(DataFrame.unionByName, found).select("name", "data_length").distinct()


@query("SELECT 'text.' || doc_id AS name, strlen(text) AS data_length, true AS intact FROM documents")
def headers_verify(spark, sf_dir):
    """Texts written as one archive; the stored digests against those that expressions compute from header and payload."""
    path = f"{scratch(spark)}/texts.arr"
    archive.write(pack.texts(table(spark, sf_dir, "documents"), "doc_id", "text"), path)
    chunks = archive.read(spark, path, "chunks", chunkBytes=1 << 30).select("name", "data")
    both = archive.read(spark, path, "headers").join(chunks, "name", "left").withColumn("data", F.coalesce("data", F.lit(b"")))
    whole = (F.col("header_zeroed"), F.col("data"))
    return both.select("name", "data_length", ((verify.sha256(*whole) == F.col("sha256")) & (verify.crc32(*whole) == F.col("crc32"))).alias("intact"))


def _keyed(spark, secret: bytes | None = None) -> tuple[str, str]:
    """A new folder and a file in it that holds the secret, or a random key."""
    folder = scratch(spark)
    with open(f"{folder}/key", "wb") as file:
        file.write(secret or crypto.random_key())
    return folder, f"{folder}/key"


@query(_ELEMENTS)
def encrypt_roundtrip(spark, sf_dir):
    """Vectors written as an encrypted archive and read with the key, which a file holds."""
    folder, key = _keyed(spark)
    archive.write(pack.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), f"{folder}/vectors.arr", encrypt="true", keyFile=key)
    return archive.read(spark, f"{folder}/vectors.arr", "elements", keyFile=key, verify="true").select("name", "flat_index", "value")


@query(_ELEMENTS)
def encrypt_passphrase(spark, sf_dir):
    """Vectors sealed under a key derived from a passphrase, each task's with a salt of its own in the records."""
    folder, key = _keyed(spark, b"a passphrase")
    archive.write(pack.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), f"{folder}/vectors.arr", encrypt="true", keyFile=key, keyKind="passphrase", cost="min")
    return archive.read(spark, f"{folder}/vectors.arr", "elements", keyFile=key, keyKind="passphrase", verify="true").select("name", "flat_index", "value")


@query("""SELECT '["' || r_name || '",' || (row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1) || ']' AS name, 0::BIGINT AS flat_index, n_nationkey::DOUBLE AS value
    FROM nation JOIN region ON n_regionkey = r_regionkey""")
def state_dict_roundtrip(spark, sf_dir):
    """A nested structure of arrays, one list for each region, saved by the mapping facade and read as elements."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()
    state: dict[str, list] = {}
    for r in rows:
        state.setdefault(r.r_name, []).append(np.array([r.n_nationkey], "<i4"))
    path = f"{scratch(spark)}/state.arr"
    facade.save(state, path)
    return archive.read(spark, path, "elements", verify="true").select("name", "flat_index", "value")


@query("SELECT true AS written, false AS again, count(*) AS arrays FROM embeddings WHERE label = 0")
def write_once(spark, sf_dir):
    """An archive that is there is left alone unless told otherwise."""
    path = f"{scratch(spark)}/vectors.arr"
    rows = pack.vectors(table(spark, sf_dir, "embeddings").where("label = 0"), "vec_id", "embedding")
    written, again = archive.write(rows, path, force=False), archive.write(rows.limit(1), path, force=False)
    return archive.read(spark, path, "catalog").agg(F.count(F.lit(1)).alias("arrays")).select(F.lit(written).alias("written"), F.lit(again).alias("again"), "arrays")


@query(_ELEMENTS)
def encrypt_copy(spark, sf_dir):
    """A plain archive of vectors copied to an encrypted one, that to a plain one, and this read."""
    folder, key = _keyed(spark)
    archive.write(pack.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), f"{folder}/plain.arr")
    archive.copy(spark, f"{folder}/plain.arr", f"{folder}/sealed.arr", new_key_file=key)
    archive.copy(spark, f"{folder}/sealed.arr", f"{folder}/again.arr", key_file=key)
    return archive.read(spark, f"{folder}/again.arr", "elements", verify="true").select("name", "flat_index", "value")


@query("SELECT sum(4 * len(embedding))::BIGINT AS bytes, count(*) AS arrays, true AS timed FROM embeddings")
def archive_reads(spark, sf_dir):
    """What tasks counted while they read the payloads of an archive."""
    path = f"{scratch(spark)}/vectors.arr"
    archive.write(pack.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), path)
    reads = archive.read(spark, path, "reads", readers=3)
    return reads.agg(F.sum("bytes").alias("bytes"), F.sum("arrays").alias("arrays"), F.bool_and(F.col("seconds") > 0).alias("timed"))


@query("SELECT label, 'layer.v' || vec_id AS name, 'float32' AS dtype, len(embedding) AS n, 'parameter' AS kind, round(list_sum(embedding::DOUBLE[]), 6) AS digest FROM embeddings")
def model_roundtrip(spark, sf_dir):
    """Vectors of each label written as one model message, and the arrays of all messages."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")

    def encode(group: pa.Table) -> pa.Table:
        arrays = [(f"v{k}", model_proto.Tensor("float32", (len(v),), np.asarray(v, "<f4").tobytes(), 0)) for k, v in zip(group["vec_id"].to_pylist(), group["embedding"].to_pylist(), strict=True)]
        root = model_proto.Module("", [], [("", model_proto.Module("", [], [("layer", model_proto.Module("", [], arrays))]))])
        return pa.table({"path": [str(group["label"][0].as_py())], "content": pa.array([model_proto.encode_module(root)], pa.binary())})

    read = model_proto.read_models(rows.groupBy("label").applyInArrow(encode, "path string, content binary"))
    found = read.select(F.col("path").cast("int").alias("label"), "name", "dtype", F.col("shape")[0].alias("n"), "kind", _floats("data").alias("x"))
    total = F.aggregate("x", F.lit(0.0).cast("double"), lambda a, v: a + v)
    return found.select("label", "name", "dtype", "n", "kind", F.round(total, 6).alias("digest"))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _floats(payloads: pa.Array) -> pa.Array:
    return pa.array([np.frombuffer(x, "<f4").astype(float) for x in payloads.to_pylist()], pa.list_(pa.float64()))


@query("SELECT 'v' || vec_id AS path, '<f4' AS dtype, i - 1 AS flat_index, embedding[i]::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def npy_roundtrip(spark, sf_dir):
    """Vectors as single-array files, and their elements."""

    @F.arrow_udf("binary")
    def saved(vectors: pa.Array) -> pa.Array:
        out = []
        for v in vectors:
            np.save(file := io.BytesIO(), np.asarray(v.values, "<f4"))
            out.append(file.getvalue())
        return pa.array(out, pa.binary())

    files = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("path"), saved("embedding").alias("content"))
    return npy.read_arrays(files).select("path", "dtype", "flat_index", "value")

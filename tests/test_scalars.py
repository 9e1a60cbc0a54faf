import pytest
from pyspark.sql import functions as F

from lamina.functions import scalars as fn
from lamina.operators import logs, relate, select, verify


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_sizes(spark):
    """Against C-style formatting of the same divisions, halves and near halves of tenths among them."""
    n = [0, 999, 1000, 1250, 12250, 12350, 12450, 999_949, 999_950, 999_999, 10**15, 5 * 10**18, 1088, 11_264_000 // 10 * 11] + [50 + 100 * k for k in range(10, 60)] + [k * 1024 + 512 // (k % 9 + 1) for k in range(1, 40)]

    def said(x, step, units):
        x = float(x)
        for unit in units[:-1]:
            if x < step:
                return f"{x:3.1f} {unit}"
            x /= step
        return f"{x:3.1f} {units[-1]}"

    rows = spark.createDataFrame([(x,) for x in n], "n long").select("n", fn.human_bytes("n").alias("a"), fn.human_bytes("n", False).alias("b")).collect()
    for r in rows:
        assert r.a == said(r.n, 1000.0, ["bytes", "KB", "MB", "GB", "TB", "PB"]) and r.b == said(r.n, 1024.0, ["bytes", "KiB", "MiB", "GiB", "TiB", "PiB"])


def test_types(spark):
    a, b = fn.split_dtype(F.lit("<V2\0torch.bfloat16"))
    r = one(spark, a.alias("a"), b.alias("b"), fn.is_opaque(F.lit("<V2")).alias("o"), fn.decoder_dtype(F.lit("<V2")).alias("d"), fn.item_size(F.lit("<f4")).alias("s"), fn.item_size(F.lit("<x9")).alias("n"),
            fn.full_length(F.lit(0), F.lit("<V2"), F.array(F.lit(3), F.lit(2))).alias("m"), fn.full_length(F.lit(7), F.lit("|u1"), F.array(F.lit(7))).alias("k"), fn.element_count(F.array().cast("array<int>")).alias("e"),
            fn.named_dtype(F.lit("torch.float16")).alias("t"))
    assert tuple(r) == ("<V2", "torch.bfloat16", True, "<i2", 4, None, 12, 7, 1, "float16")
    with pytest.raises(Exception, match="not a type name"):
        one(spark, fn.named_dtype(F.lit("float16")))


def test_addresses(spark):
    r = one(spark, fn.redis_uri(F.lit("redis://H:7000/a/b")).alias("a"), fn.redis_uri(F.lit("redis://h/x")).alias("b"), fn.redis_uri(F.lit("http://h/x")).alias("c"), fn.s3_uri(F.lit("s3://bucket/a/b.c")).alias("d"),
            fn.needs_virtual_host(F.lit("https://Store.Example"), ("store.example",)).alias("v"), fn.is_accelerated(F.lit("http://accel.region.example.com")).alias("x"), fn.aligned_expiry(F.lit(86400 * 3 + 5)).alias("t"))
    assert tuple(r.a) == ("h", 7000, "a/b") and tuple(r.b) == ("h", 6379, "x") and tuple(r.c) == (None, None, None) and tuple(r.d) == ("bucket", "a/b.c")
    assert r.v and r.x and r.t == 86400 * 5


def test_labels_and_ticks(spark):
    r = one(spark, fn.mode_label(F.lit(None), F.lit("")).alias("a"), fn.mode_label(F.lit("x"), F.lit(2)).alias("b"), fn.tick_bounds(F.lit(130), F.lit(257), 128).alias("t"), fn.nickname(F.lit("q"), {"p": "r"}).alias("n"))
    assert (r.a, r.b, tuple(r.t), r.n) == ("default", "x\n2", (128, 384), "q")


def test_selection_errors(spark):
    df = spark.range(3)
    for bad in (lambda: select.read_limit(df, "id", -2), lambda: select.byte_range(F.lit(b"abc"), 2, 2), lambda: select.byte_range(F.lit(b"abc"), -1)):
        with pytest.raises(ValueError):
            bad()
    assert select.read_limit(df, "id", 0).count() == 0 and select.read_limit(df, "id").count() == 3
    assert one(spark, select.byte_range(F.lit(b"abcdef"), 2).alias("x")).x == b"cdef"
    with pytest.raises(Exception, match="found 3"):
        select.exactly_one(df).collect()
    with pytest.raises(Exception, match="opaque"):
        select.plain_only(df.withColumn("o", F.col("id") == 1), "o", False).collect()
    assert select.plain_only(df.withColumn("o", F.lit(False)), "o", False).count() == 3


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text('noise\n{"nodename": "n1", "rate": 2.5, "plaid_buffers": null}\n {"nodename": "n2"} \n{broken\n')
    rows = logs.read_logs(spark, str(tmp_path / "a.log")).collect()
    assert [(r.nodename, r.rate) for r in rows] == [("n1", 2.5), ("n2", None)]
    schemes = spark.createDataFrame([("http://localhost/x",), ("s3://b/k",), ("m.pt",), ("/a/b",), ("https://h:80/x",)], "s string")
    got = [tuple(r) for r in schemes.select(logs.scheme_of(F.col("s"), F.lit(False)), logs.peer_of(F.col("s"), F.lit(None).cast("string"))).collect()]
    assert got == [("local", "localhost"), ("s3s", "b"), ("torch", "filesystem"), ("file", "filesystem"), ("https", "h")]


def test_strict_digests_and_routes(spark):
    df = spark.createDataFrame([("a", "1", "1"), ("b", "1", "2")], "name string, stored string, got string")
    assert verify.strict(df.where("name = 'a'"), "name", "stored", "got").count() == 1
    with pytest.raises(Exception, match="hash mismatch in b"):
        verify.strict(df, "name", "stored", "got").collect()
    rows = spark.createDataFrame([("m.sub.w", 0), ("top", 1)], "name string, kind int")
    modules = spark.createDataFrame([("m.sub",), ("",)], "module string")
    assert {(r.attribute, r.register) for r in relate.load_route(rows, modules, "name", "module", "kind").collect()} == {("w", "parameter"), ("top", "buffer")}
    with pytest.raises(Exception, match="nested state"):
        relate.load_route(rows.withColumn("kind", F.lit(2)), modules, "name", "module", "kind").collect()

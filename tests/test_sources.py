import functools
import http.server
import io
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.archive import Archive
from lamina.operators import crypto, sidecar, tree
from lamina.sources import archive, blobs, model_proto, pack
from lamina.sources import format as codec
from lamina.sources.streams import open_stream
from lamina.streaming import tail


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(k, [float(k), float(k) / 2, -1.0]) for k in range(40)]
    return spark.createDataFrame(rows, "vec_id int, embedding array<float>")


@pytest.fixture(scope="module")
def path(vectors, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("archives") / "v.arr")
    assert archive.write(pack.vectors(vectors.repartition(3), "vec_id", "embedding"), out)
    assert not archive.write(pack.vectors(vectors, "vec_id", "embedding"), out, force=False)
    return out


def test_relations(spark, path, vectors):
    info = archive.read(spark, path, "archive_info").first()
    assert (info.version, info.encrypted, info.tensor_bytes, info.tensor_count) == (1, False, 480, 40)
    names = [r.name for r in archive.read(spark, path).orderBy("ordinal").collect()]
    assert names == [f"vec.{k}" for k in range(40)]
    elements = archive.read(spark, path, "elements", readers=3)
    assert elements.count() == 120 and elements.agg(F.sum("value")).first()[0] == vectors.select(F.sum(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x))).first()[0]
    assert archive.read(spark, path, "chunks", chunkBytes=5, verify="true").count() == 120


def test_names_are_chosen_in_the_index(spark, path):
    """By options before payloads are read; predicates are Spark's, each branch of a plan has its own."""
    found = archive.read(spark, path, "chunks")
    one, many = found.where("name = 'vec.7'"), found.where(F.col("name").startswith("vec.3"))
    assert one.count() == 1 and many.count() == 11 and one.unionByName(many).count() == 12
    assert found.where(F.col("name").isin("vec.1", "vec.2")).count() == 2
    assert archive.read(spark, path, "chunks", nameRegex=r"vec\.[12]$").count() == 2
    assert archive.read(spark, path, "chunks", names=["vec.1", "vec.2", "other"]).count() == 2
    assert archive.read(spark, path, "chunks", namePrefix="vec.3", nameRegex=r".*[01]$").count() == 2


def test_digests_with_expressions(spark, path):
    both = archive.read(spark, path, "headers").join(archive.read(spark, path, "chunks").select("name", "data"), "name")
    whole = F.concat("header_zeroed", "data")
    assert both.where((F.sha2(whole, 256) == F.col("sha256")) & (F.crc32(whole) == F.col("crc32"))).count() == 40


def test_reader_agrees_with_the_facade(path):
    with Archive(path, verify=True) as a:
        assert a["vec.3"].tolist() == [3.0, 1.5, -1.0] and a.total_bytes == 480


@pytest.mark.skipif(not crypto.available(), reason="libsodium is not installed")
def test_encrypted_copy(spark, vectors, tmp_path):
    key = tmp_path / "key"
    key.write_bytes(b"k" * 32)
    out = str(tmp_path / "e.arr")
    archive.write(pack.vectors(vectors, "vec_id", "embedding"), out, encrypt="true", keyFile=key)
    assert archive.read(spark, out, "archive_info").first().encrypted
    assert archive.read(spark, out, "chunks", keyFile=key, verify="true").count() == 40
    with pytest.raises(Exception, match="no key"):
        archive.read(spark, out, "chunks").count()


def test_sessions_that_push(spark, path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = archive.read(spark, path, "chunks")
        assert rows.where("name = 'vec.7'").unionByName(rows.where("name = 'vec.8'")).select("name").distinct().count() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert spark.read.format("array_archive").load(path).where("name = 'vec.7'").count() == 1


def test_folders_and_copies(spark, vectors, path, tmp_path):
    folder = str(tmp_path / "parts")
    for _ in range(2):
        archive.write(pack.vectors(vectors.repartition(5, "vec_id"), "vec_id", "embedding"), folder, parts="true")
    assert len(os.listdir(folder)) == 5 and archive.read(spark, folder, "elements").count() == 120
    odd = spark.createDataFrame([(0, "b", None, 1, 3, "<V2", "torch.bfloat16", [2], bytearray(b"abcd")), (1, "m", None, 0, 4, "<f4", None, [3], None), (2, "e", None, 0, 4, "<f4", None, [0], bytearray())],
                                "ordinal int, name string, path_json string, tensor_type int, module_idx int, numpy_dtype string, torch_dtype string, shape array<bigint>, data binary")
    archive.write(odd, str(tmp_path / "odd.arr"))
    copied = archive.copy(spark, str(tmp_path / "odd.arr"), str(tmp_path / "copy.arr"))
    assert sorted(map(str, copied.drop("archive").collect())) == sorted(map(str, archive.read(spark, str(tmp_path / "odd.arr")).drop("archive").collect()))
    with pytest.raises(Exception, match="mounted"):
        archive.write(odd, "hdfs://store/x.arr")


def test_cuts_by_cost():
    from lamina.operators import layout

    weights = [2, 8, 10, 5, 5]
    assert layout.cuts_by_cost(weights, 3) == [0, 0, 1, 2, 2] and layout.exact_is_cheap(5, 3) and not layout.exact_is_cheap(5, 2) and not layout.exact_is_cheap(100_000, 8)
    assert layout.greedy_cuts(weights, 2) == layout.cuts_by_cost(weights, 2) and sorted(set(layout.cuts_by_cost([1] * 100_000, 8))) == list(range(8))


def test_writer_errors(spark, vectors, tmp_path):
    wrong = pack.vectors(vectors, "vec_id", "embedding")
    with pytest.raises(Exception, match="overflow"):
        archive.write(wrong, str(tmp_path / "x.arr"), indexBytes=64)
    with pytest.raises(Exception, match="don't fill"):
        archive.write(wrong.withColumn("shape", F.array(F.lit(9).cast("bigint"))), str(tmp_path / "y.arr"))
    assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="no compression"):
        archive.write(wrong, str(tmp_path / "z.arr"), compress="true")


def test_files_through_spark_and_stream(spark, path):
    folder = os.path.dirname(path)
    assert archive.decode_files(spark.read.format("binaryFile").load(path)).count() == 40
    q = tail.tail(spark, folder, "catalog", "*.arr").writeStream.format("memory").queryName("tailed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tailed").count() == 40


def test_rates(spark):
    rows = spark.sql("SELECT timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) AS ts, id % 2 AS k, 1.0 AS v FROM range(20)")
    got = tail.rates(rows, "ts", ["k"], "v").collect()
    assert sum(r.n for r in got) == 20 and len(got) == 8


class Ranges(http.server.SimpleHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        data = open(self.translate_path(self.path), "rb").read()
        if r := self.headers.get("Range"):
            a, b = r.removeprefix("bytes=").split("-")
            data = data[int(a) : int(b) + 1 if b else None]
            self.send_response(206)
        else:
            self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.send_header("X-Cache-Status", "HIT")
        self.end_headers()
        try:
            self.wfile.write(data)
        except (BrokenPipeError, ConnectionResetError):
            pass

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def served(path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Ranges, directory=os.path.dirname(path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/{os.path.basename(path)}"
    server.shutdown()


def test_http_ranges(spark, served, path):
    raw = open(path, "rb").read()
    with open_stream(served, begin=3, end=20) as f:
        assert f.read() == raw[3:20] and f.raw.cache_status == "HIT"
    with open_stream(served) as f:
        assert f.read(5) == raw[:5] and f.seek(262217) and f.read(10) == raw[262217:262227]
        f.seek(1)
        assert f.read(3) == raw[1:4]
    assert archive.read(spark, served, "chunks", verify="true").count() == 40
    with pytest.raises(ValueError):
        open_stream(served, begin=5, end=5)
    with pytest.raises(ValueError):
        open_stream(served, "wb")
    with pytest.raises(ValueError):
        open_stream("x", "r")


def test_http_requests_are_repeated(tmp_path):
    (tmp_path / "x").write_bytes(b"abcdef")
    seen = []

    class Flaky(Ranges):
        def do_GET(self):  # noqa: N802
            seen.append(self.path)
            if len(seen) == 1 or self.path == "/gone":
                self.send_error(503 if len(seen) == 1 else 404)
            else:
                super().do_GET()

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Flaky, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with open_stream(f"http://127.0.0.1:{server.server_port}/x", begin=1, end=4) as f:
        assert f.read() == b"bcd" and len(seen) == 2
    with pytest.raises(OSError, match="404"):
        open_stream(f"http://127.0.0.1:{server.server_port}/gone").read()
    assert len(seen) == 3
    server.shutdown()


def test_blobs(spark):
    data = bytes(range(100))
    store = spark.createDataFrame([(f"t:a:{k}", bytearray(data[k : k + 30])) for k in (60, 0, 30)] + [("t:b:90", bytearray(data[90:]))], "key string, data binary")
    index = blobs.index_blobs(store, "t").collect()
    assert [r.begin for r in index] == [0, 30, 60, 90]
    assert b"".join(bytes(r.data) for r in blobs.range_of(store, "t", 25, 95).collect()) == data[25:95]
    new = spark.createDataFrame([("t:a:0", bytearray(b"x")), ("t:c:200", bytearray(b"y")), ("t:header:0", bytearray(b"h"))], "key string, data binary")
    assert {r.key for r in blobs.new_blobs(new, store, "t").collect()} == {"t:c:200", "t:header:0"}
    assert blobs.new_blobs(new, store, "t", force=True).count() == 3


def test_model_messages(spark, tmp_path):
    t = model_proto.Tensor("float32", (2, 2), np.arange(4, dtype="f4").tobytes(), 0)
    m = model_proto.Module("root", ["r"], [("w", t), ("sub", model_proto.Module("s", [], [("b", model_proto.Tensor("bfloat16", (1,), b"\x80\x3f", 1)), ("n", -5), ("f", 0.5), ("on", True), ("s", "é")]))])
    back = model_proto.decode_module(model_proto.encode_module(m))
    assert back == m and back.attributes[0][1].values().tolist() == [[0, 1], [2, 3]] and back.attributes[1][1].attributes[0][1].values().tolist() == [1.0]
    (tmp_path / "m.pb").write_bytes(model_proto.encode_module(m))
    rows = model_proto.read_models(spark.read.format("binaryFile").load(str(tmp_path / "m.pb"))).orderBy("ordinal").collect()
    assert [(r.name, r.dtype, r.kind) for r in rows] == [("w", "float32", "parameter"), ("sub.b", "bfloat16", "buffer")]
    rooted = model_proto.Module("", [], [("", model_proto.Module("", [], [("weight", t), ("sub", model_proto.Module("", [], [("bias", t)]))]))])
    assert [n for n, _ in model_proto.tensors(rooted)] == ["weight", "sub.bias"]
    with pytest.raises(ValueError):
        model_proto.decode_module(b"\x0a\x05ab")
    with pytest.raises(NotImplementedError):
        model_proto.Tensor("qint8", (1,), b"a").values()


def test_sidecar(spark):
    objects = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y"), ("c", 2, "x")], "object_id string, ordinal int, digest string")
    references, storages = sidecar.save(objects, ["digest"])
    assert {(r.object_id, r.storage_idx) for r in references.collect()} == {("a", 0), ("b", 1), ("c", 0)} and storages.count() == 2
    catalog = spark.createDataFrame([([("index", None, 0)], 8), ([("index", None, 1)], 9)], f"path {tree.PATH}, n int")
    assert {(r.object_id, r.n) for r in sidecar.load(references, catalog).collect()} == {("a", 8), ("b", 9), ("c", 8)}


def test_path_conflicts(spark):
    rows = spark.createDataFrame([([("key", "a", None)],), ([("key", "a", None), ("index", None, 0)],), ([("key", "b", None)],), ([("key", "b", None)],), ([("key", "a", None), ("key", "k", None)],)], f"path {tree.PATH}")
    assert sorted(r.conflict for r in tree.conflicts(rows, "path").collect()) == ["leaf and branch", "mixed layer", "repeated"]
    assert rows.select(tree.path_text("path").alias("t")).collect()[1].t == '["a",0]'


def test_stream_of_bytes():
    out = io.BytesIO()
    codec.write_archive([(("x",), 2, 0, "|u1", (3,), b"abc")], out)
    out.seek(0)
    assert Archive(out)["x"].tobytes() == b"abc"

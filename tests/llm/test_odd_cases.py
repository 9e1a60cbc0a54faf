"""Clashing names, very long and very many short texts, hot keys, and the registered queries against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_groups import brute_classes, brute_repeats
from test_texts import brute_lines
from tokenizers import Tokenizer

import corpus_pipeline
from lamina.llm import anchors, bpe, graph_search, license_scan, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, queries, shingles, suffix_dedup, token_counts, util
from lamina.llm.sql import mixing_sql, quality_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd_names(small):
    """small with columns whose names have dots and marks, or are those that operators make up."""
    made = ["__limit_symbols", "__high_symbols", "__lang", "__source", "__own_0", "__salt", "__leaf", "__turn", "__of", "__content", "__row", "__drop", "p_domain", "g", "node", "bpe", "quality.kept", "a.b", "tick`s", "Größe x"]
    return small.where("doc_id IS NULL OR doc_id <> 35").select("*", *(F.lit(f"own {k}").alias(n) for k, n in enumerate(made)))


def test_odd_names(odd_names):
    n = odd_names.count()
    more = {
        "quality": quality_rules.quality_verdicts(odd_names),
        "lean": quality_rules.quality_verdicts(odd_names, keep_text=False),
        "lines": line_dedup.drop_shared_lines(odd_names),
        "classes": near_dedup.near_classes(odd_names),
        "ids": bpe.encode_texts(odd_names),
        "tokens": token_counts.with_token_count(odd_names),
        "licenses": license_scan.scan_licenses(odd_names),
    }
    for name, out in more.items():
        row = util.quoted("tick`s"), util.quoted("a.b"), util.quoted("__limit_symbols")
        assert out.count() == n and {tuple(r) for r in out.select(*row).collect()} == {("own 18", "own 17", "own 0")}, name
    for out in (quality_rules.quality_filter(odd_names), near_dedup.drop_near_duplicates(odd_names), mixing.mix(odd_names).drop("n_tokens", "epoch")):
        rows = out.collect()
        assert out.columns == odd_names.columns and rows and all(r["a.b"] == "own 17" and r["__leaf"] == "own 6" for r in rows)
    assert suffix_dedup.cut_repeats(odd_names).count() == n and token_counts.length_histogram(odd_names).agg(F.sum("n_docs")).first()[0] == n


def test_stages_with_odd_names(spark, odd_names):
    docs = odd_names
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = util.written(out, "stage")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count() > 0


def test_limits_by_salted_join(small, monkeypatch):
    want, mixed = (sorted(map(str, f(small).collect())) for f in (quality_rules.quality_verdicts, mixing.mix))
    monkeypatch.setattr(util, "BROADCAST_BYTES", -1)
    assert sorted(map(str, quality_rules.quality_verdicts(small).collect())) == want
    assert sorted(map(str, mixing.mix(small).collect())) == mixed


def test_every_rule_rejects(spark):
    """Each rule rejects what only it can; a source with much junk doesn't set its own limit; clean rows stay."""
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("lo", "rami", "sten", "t")]
    text = lambda k, n=80: " ".join(w + (f"{j}" if j % 3 == 0 else "") for j, w in enumerate(random.Random(k).choices(words, k=n)))
    rows = [(k, text(k), "en", f"src{k % 2}") for k in range(600)]
    rows += [(1000 + k, " ".join(w + "&&" * (j % 2) for j, w in enumerate(text(k).split())), "en", "junk" if k % 3 == 0 else "src0") for k in range(30)]
    rows += [(2000 + k, text(k), "en", "junk") for k in range(300)] + [(3000 + k, " ".join(w + "##%%" for w in text(k).split()), "en", "junk") for k in range(140)]
    rows += [(4000, " ".join(w * 6 for w in text(1).split()), "en", "src0"), (4001, " ".join("ab"[j % 2] + "cd"[j // 2 % 2] * (j % 5 == 0) for j in range(60)), "en", "src1")]
    rows += [(4002, "\n".join(x for k in range(12) for x in (f"own {k} {words[k]} {words[k + 9]} {k * k} of {k + 50}", f"- {words[k % 3]}")), "en", "src0")]
    rows += [(4003, text(3, 85) + " " + " ".join(f"u{j}" for j in range(10)) + " " + " ".join(text(3, 85).split()[4:12]), "en", "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    by = {r.doc_id: r for r in quality_rules.quality_verdicts(docs).collect()}
    assert not [k for k in by if k >= 1000 and k != 4001 and by[k].base_failed]
    assert not any(by[k].kept for k in by if 1000 <= k < 2000 or 3000 <= k < 4000), "symbols"
    assert not by[4000].kept and not by[4002].kept and not by[4003].kept
    assert all(by[k].kept for k in range(600)) and all(by[k].kept for k in range(2000, 2300))
    q = by[4002].quality
    assert 1000 * q.n_dup_lines // q.n_lines > 360 and 100 * q.n_repeat_words <= 20 * q.n_words
    q = by[4003].quality
    assert q.n_dup_lines == 0 and 150 < 1000 * q.n_repeat_words // q.n_words <= 200


def test_short_words_are_rejected(spark):
    rows = [(k, " ".join(f"{w}{j}" for j, w in enumerate(["lorem", "ipsum", "dolor"] * 12)), "en", "s") for k in range(250)] + [(900, " ".join(chr(97 + j % 26) for j in range(25)), "en", "s")]
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[900].base_failed and not got[900].kept and got[1].kept


def test_hashes_in_steps(monkeypatch):
    r = np.random.default_rng(0)
    text = b" ".join(bytes(r.integers(97, 123, n).astype(np.uint8)) for n in r.integers(1, 12, 3000)) + b" " + b"w" * 5000 + b" end"
    blob = np.frombuffer(text, np.uint8)
    begin, end, _ = shingles.words(blob, np.array([0, len(blob)]))
    want = shingles.range_hash(shingles.prefix_hash(blob), begin, end)
    for step in (64, 1000, 1 << 20):
        monkeypatch.setattr(shingles, "STEP", step)
        assert (shingles.run_hashes(blob, begin, end) == want).all()
    want = anchors.anchors(blob, np.array([0, len(blob)]), 100)
    for step in (150, 1000, 1 << 20):
        got = [np.concatenate(x) for x in zip(*anchors.text_anchors(blob, 100, step), strict=True)]
        assert all((a == b).all() for a, b in zip(got, want, strict=True))


def test_very_long_texts_need_little_memory(spark):
    """Working memory beside a text of 12 MB: a few times its bytes, where whole arrays of hashes took seventy times."""
    r = np.random.default_rng(1)
    words = np.array([f"{w:x}" for w in r.integers(0, 1 << 30, 50_000)])
    text = " ".join(r.choice(words, 1_400_000))
    batch = pa.RecordBatch.from_pydict({"doc": pa.array([1]), "text": pa.array([text]), "tag": pa.array([5])})
    for work, most in (
        (lambda: sum(len(b) for b in suffix_dedup._anchor_rows([batch], 100, True)), 10),
        (lambda: quality_classifier.counts(pa.array([text])), 14),
        (lambda: near_dedup.shingle_hashes(*near_dedup.word_hashes(*util.utf8(pa.array([text]))), 5), 14),
        (lambda: len(token_counts.count_tokens([text], token_counts.default_ranks())), 25),
    ):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * len(text) + (40 << 20), (peak / len(text), most)
    assert max(map(len, (x for x in shingles._powers.values()))) < 4 << 20


def test_many_short_texts_are_bounded():
    texts = pa.array(["w"] * 10_000)
    assert max(b - a for a, b in util.portions(texts, quality_classifier.BYTES, quality_classifier.ROWS)) <= quality_classifier.ROWS
    assert [x for a, b in util.portions(texts, 1 << 20, 300) for x in (b,)][-1] == 10_000


@pytest.mark.parametrize("hot", [1, 50])
def test_joins_with_hot_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(util, "HOT", hot)
    rows = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 0, id % 97) AS k")
    keys = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 5").withColumn("v", F.col("k") * 2)
    want = sorted(map(tuple, rows.join(keys, "k").select("k", "id", "n", "v").collect()))
    for join in (util.keyed_join, util.salted_join):
        assert sorted(map(tuple, join(rows, keys, ["k"], "n", 3000).select("k", "id", "n", "v").collect())) == want


def test_near_copies_of_many_repeats(spark):
    """Weights far above 2**20 and very long texts of few words."""
    a, b, c = np.repeat(np.uint64(7), 3 << 20), np.repeat(np.uint64(7), 2 << 20), np.repeat(np.uint64(9), 10)
    text = np.repeat([0, 1, 2], [len(a), len(b), len(c)])
    names = near_dedup.signatures(text, np.concatenate([a, b, c]), 3)
    assert abs((names[0] == names[1]).mean() - 2 / 3) < 0.15 and (names[0] == names[2]).mean() < 0.05


def documents():
    return [tuple(r) for r in duckdb.connect().execute(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet'").fetchall()]


def test_queries_against_brute_force(spark):
    """The registered queries that have no SQL, over whole tables."""
    docs, known = documents(), queries.queries()
    got = {(r.doc_id, r.class_id) for r in known["op2_near_dedup"](spark, SF).collect()}
    assert got == set(brute_classes([d[:2] for d in docs]))
    encoding = token_counts._counter(token_counts.default_ranks())[0]
    assert isinstance(encoding, tiktoken.Encoding)
    lengths = Counter(len(encoding.encode_ordinary(d[1] or "")) for d in docs)
    assert {(r.length, r.n_docs) for r in known["op5_token_counts"](spark, SF).collect()} == set(lengths.items())
    library, want = Tokenizer.from_file(bpe.default_vocabulary()), set()
    for i, text, *_ in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert set(map(tuple, known["op7_bpe"](spark, SF).collect())) == want
    assert sorted(map(tuple, known["op10_suffix_dedup"](spark, SF).collect()), key=str) == brute_repeats([d[:2] for d in docs], 100)
    vectors = dict(duckdb.connect().execute(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall())
    found, hits, total = known["op4_graph_search"](spark, SF).collect(), 0, 0
    for q in (k for k in vectors if k % 20 == 0):
        exact = sorted((-float(np.dot(np.array(vectors[q], float), np.array(v, float))), k) for k, v in vectors.items() if k != q)[:20]
        mine = [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)]
        hits, total = hits + len({k for _, k in exact} & set(mine)), total + 20
    assert hits / total > 0.95


def test_pipeline_against_brute_force(spark):
    """run() row for row against the same steps written out: SQL, loops and the tokenizers library."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = [r[:5] for r in con.execute(quality_sql(result="doc_id, text, lang, source, n_chars, kept")).fetchall() if r[5]]
    lines = {i: t for i, _, _, t in brute_lines([r[:2] for r in kept])}
    kept = [(i, lines[i], lang, source, len(lines[i])) for i, _, lang, source, _ in kept]
    classes = dict(brute_classes([r[:2] for r in kept]))
    kept = [r for r in kept if classes[r[0]] == r[0]]
    con.execute("CREATE TABLE rest (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO rest VALUES (?, ?, ?, ?, ?)", kept)
    chosen = con.execute(mixing_sql("rest", "doc_id, text, lang, source")).fetchall()
    library, want = Tokenizer.from_file(bpe.default_vocabulary()), []
    for i, text, lang, source in chosen:
        ids = library.encode(text, add_special_tokens=False).ids
        want.append((i, lang, source, ids, library.decode(ids, skip_special_tokens=False), len(ids)))
    got = [(r.doc_id, r.lang, r.source, list(r.ids), r.decoded, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect()]
    assert len(want) > 50 and sorted(got) == sorted(want)


def test_index_grows_its_shards(spark, monkeypatch):
    monkeypatch.setattr(graph_search, "SHARDS", 4)
    r = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, (v / np.linalg.norm(v) * 1.5).tolist()) for k, v in enumerate(r.standard_normal((600, 8)))], "vec_id long, embedding array<float>")
    assert graph_search.build_index(rows, shard=50).count() == 4 and graph_search.build_index(rows, shard=50, largest=60).count() == 10


"""Near duplicates, mixing, graph search, suffix dedup, the pipeline: against brute force, and in odd cases."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import graph, graph_search, mixing, near_dedup, repeats, suffix_dedup
from lamina.llm.sql import mixing_sql

SF = "/root/testdata/sf0.001"


def brute_classes(rows):
    bags = [near_dedup.bag(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common, union = near_dedup.overlap(bags[a], bags[b])
            if (union == 0) or 100 * common >= 80 * union:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return [(i, least[find(k)]) for k, (i, _) in enumerate(rows)]


def test_near_classes(clashing, nothing):
    got = near_dedup.near_classes(clashing)
    rows = [(r.doc_id, r.text) for r in clashing.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.class_id) for r in got.select("doc_id", "class_id").collect()), key=str) == sorted(brute_classes(rows), key=str)
    assert got.columns.count("class_id") == 1 and near_dedup.near_classes(nothing).count() == 0
    kept = near_dedup.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns and kept.where("doc_id IN (20, 21)").count() == 0 and kept.where("doc_id = 3").count() == 1 and kept.where("doc_id = 7").count() == 2


def test_near_copies_without_ids(spark):
    """Of a class without ids one row stays; with an id among them, that one; a document of its own stays."""
    words = [f"w{k}" for k in range(100)]
    near, other, alone = " ".join(words[:-1] + ["x"]), " ".join(f"v{k}" for k in range(60)), " ".join(f"u{k}" for k in range(60))
    rows = [(None, " ".join(words), c) for c in "aabb"] + [(None, near, "c"), (None, near, "d"), (None, other, "e"), (5, other, "f"), (None, other, "g"), (None, alone, "h"), (9, alone + " t" * 200, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = [(r.doc_id, r.lang) for r in near_dedup.drop_near_duplicates(docs).collect()]
    again = [(r.doc_id, r.lang) for r in near_dedup.drop_near_duplicates(docs.repartition(7, "lang")).collect()]
    assert sorted(kept, key=str) == sorted(again, key=str) and len(kept) == 4 and {(5, "f"), (9, "i"), (None, "h")} < set(kept) and {x[1] for x in kept} & set("abcd")
    same = near_dedup.drop_near_duplicates(docs.where("lang IN ('a', 'b')")).collect()
    assert [(r.doc_id, r.lang) for r in same] == [(None, "a")]


def test_near_chain_and_crowd(spark):
    """A chain of edits links its ends; a crowd of near copies is one class; documents half alike stay apart."""
    r = random.Random(2)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(120)]
    rows, at = [], list(base)
    for k in range(8):
        rows.append((k, " ".join(at)))
        at = list(at)
        at[k * 13] = f"e{k}"
    for k in range(150):
        own = [f"c{j}" for j in range(100)]
        own[r.randint(0, 99)] = f"z{k}"
        rows.append((100 + k, " ".join(own)))
    rows += [(900, " ".join(base[:60] + [f"q{j}" for j in range(60)]))]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((x.doc_id, x.class_id) for x in got.collect()) == sorted(brute_classes(rows))


def test_signatures_are_unbiased():
    r = np.random.default_rng(3)
    common = r.integers(0, 2**63, 300).astype(np.uint64)
    errors = []
    for trial in range(40):
        bags = []
        for _ in range(2):
            own = r.integers(0, 2**63, 100).astype(np.uint64)
            bags.append(np.concatenate([np.repeat(common + np.uint64(trial), r.integers(1, 6, 300)), own]))
        counts = [Counter(b.tolist()) for b in bags]
        c, u = near_dedup.overlap(*counts)
        text = np.repeat([0, 1], [len(bags[0]), len(bags[1])])
        a, b = near_dedup.signatures(text, np.concatenate(bags), 2)
        errors.append((a == b).mean() - c / u)
    assert abs(np.mean(errors)) < 0.02 and 0.02 < np.std(errors) < 0.07


def test_components(spark):
    r = random.Random(1)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(40)]
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            todo += near[x := todo.pop()] - seen
            seen |= near[x]
        assert got[start] == min(seen)


def test_mixing_follows_its_sql(spark):
    got = sorted(map(tuple, mixing.op3_mixing(spark, SF).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(con.execute(mixing_sql()).fetchall(), key=str)


def test_mixing_any_source(spark, tmp_path):
    """Sources that don't end in a number, or in one too long, fall to the last domain, as in the SQL."""
    names = ["", "hot", "src1x", "src3", "src4", "src5", f"src{2**31}", "src" + "9" * 40, "src00000000000000000000003", None]
    rows = [(k, f"{'one two three ' * (k % 7)}{k}", ["en", "de"][k % 2], names[k % len(names)], 0) for k in range(120)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, mixing.op3_mixing(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(mixing_sql()).fetchall(), key=str)
    assert {r[1] for r in got if r[3] in ("", "hot", f"src{2**31}")} == {"forum"} and {r[1] for r in got if r[3] == "src00000000000000000000003"} == {"web"}


def test_budgets_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "3", 1000), ("b", "x", "4", 1000), ("c", "x", "5", 0)], "domain string, lang string, source string, supply long")
    got = {r.source: r.budget for r in mixing.budgets(leaves, {}, F.lit(900).cast("bigint"), 1).collect()}
    # c can't use its third: a and b get 450 each; in a, x and y get 225; in x, source 2 takes what 1 lacks.
    assert got == {"1": 10, "2": 215, "3": 225, "4": 450, "5": 0}
    more = {r.source: r.budget for r in mixing.budgets(leaves, {("b",): 3}, F.lit(10**6).cast("bigint"), 2).collect()}
    assert more == {"1": 20, "2": 2000, "3": 2000, "4": 2000, "5": 0}


def test_mixing_in_odd_cases(clashing, nothing):
    got = mixing.mix(clashing, budget_percent=150, most_epochs=3)
    assert got.columns.count("n_tokens") == 1 and got.columns.count("epoch") == 1
    rows = got.select("doc_id", "lang", "source", "n_tokens", "epoch").collect()
    assert {r.epoch for r in rows} >= {0, 1} and sum(r.n_tokens for r in rows) <= 1.5 * sum(len((r.text or "").encode().split()) for r in clashing.collect())
    assert mixing.mix(nothing).count() == 0 and mixing.mix(clashing, budget_percent=0).where("n_tokens > 0").count() == 0
    assert any(r.lang is None for r in rows) and sum(r.doc_id == 7 for r in rows) % 2 == 0


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((1500, 24)) * r.uniform(0.5, 2, (1500, 1))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(2000 + k, rows[40][1]) for k in range(60)] + [(3000, None), (3001, [0.0] * 24), (3002, [float("nan")] * 24), (3003, [None] + [1.0] * 23), (None, [1.0] * 24), (3020, [1.0, 2.0]), (3021, [3.0, 1.0]), (40, rows[40][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))


def test_graph_search(vectors):
    index = graph_search.build_index(vectors, shard=500)
    assert index.count() > 2 and index.select("band").distinct().count() > 1
    got = defaultdict(list)
    for r in graph_search.search_index(index, vectors.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    rows = {}
    for r in vectors.collect():
        if r.vec_id is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding):
            rows[r.vec_id] = np.array(r.embedding)
    hits = total = 0
    for q, v in rows.items():
        if q % 20:
            continue
        best = sorted((-(v * x).sum(), k) for k, x in rows.items() if k != q and len(x) == len(v))[:20]
        assert [r.rank for r in got[q]] == list(range(1, len(best) + 1)) and q not in [r.vec_id for r in got[q]]
        assert all(abs(r.score - (v * rows[r.vec_id]).sum()) < 1e-9 for r in got[q])
        hits += len({k for _, k in best} & {r.vec_id for r in got[q]})
        total += len(best)
    assert hits / total > 0.95 and [r.vec_id for r in got[40]][0] in range(2000, 2060) and [r.vec_id for r in got[3020]] == [3021]
    assert graph_search.search_index(graph_search.build_index(vectors.where("false")), vectors.where("false")).count() == 0


@pytest.mark.parametrize("lengths", ["one", "gauss", "uniform", "lognormal", "junk"])
def test_recall_on_whole_shards(lengths):
    """Recall on graphs of full size, whatever the lengths of vectors: random directions have no clusters to help."""
    r = np.random.default_rng(1)
    n, d = 9000, 64
    x = r.standard_normal((n, d))
    size = {"one": np.ones(n), "gauss": np.linalg.norm(x, axis=1), "uniform": r.uniform(0.1, 2, n), "lognormal": r.lognormal(0, 1, n), "junk": np.exp(r.uniform(-300, 300, n))}[lengths]
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * size[:, None]
    queries = np.concatenate([x[:60], r.standard_normal((60, d))])
    unit = graph_search.directions(queries)
    found, scores = [], []
    for band in np.unique(np.floor(np.log2(size))):
        at = np.flatnonzero(np.floor(np.log2(size)) == band)
        graph_ = graph_search.build(graph_search.directions(x[at]))
        ids, _ = graph_.by_product(graph_search.reduced(x[at])).search(unit, min(graph_search.SEARCH_BEAM, max(42, len(at))))
        ids = np.where(ids >= 0, at[np.maximum(ids, 0)], -1)
        found.append(ids)
        scores.append(np.where(ids >= 0, np.einsum("qkd,qd->qk", x[ids], unit.astype(float)), -np.inf))
    found, scores = np.concatenate(found, axis=1), np.concatenate(scores, axis=1)
    got = np.take_along_axis(found, np.argsort(-scores, axis=1)[:, :20], axis=1)
    best = np.argsort(-(unit.astype(float) @ x.T), axis=1)[:, :20]
    hits = [len({*a} & {*b}) / 20 for a, b in zip(got, best)]
    assert np.mean(hits) > 0.97 and min(hits) >= 0.7


def brute_repeats(rows, length):
    seen, out = {}, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, suffix_dedup.tag(r[1]))):
        raw, again = (text or "").encode(), seen.get(("doc", i, text))
        covered = bytearray(len(raw))
        if again is not None:
            covered = again
        else:
            for s in range(len(raw) - length + 1):
                w = raw[s : s + length]
                if w in seen:
                    covered[s : s + length] = b"\1" * length
                seen[w] = True
            seen["doc", i, text] = covered
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        out.append((i, len(raw), sum(covered), sum(1 for k, c in enumerate(covered) if c and not (k and covered[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [8192, 1])
def test_repeats(spark, clashing, nothing, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    r = random.Random(5)
    passage = "".join(r.choice("abcdefgh ") for _ in range(260))
    rows = [(r_.doc_id, r_.text) for r_ in clashing.select("doc_id", "text").collect()]
    for k in range(60):
        a, b = sorted((r.randint(0, 130), r.randint(120, 260)))
        rows.append((100 + k, "".join(r.choice("xyz é") for _ in range(r.randint(0, 90))) + passage[a:b] + "".join(r.choice("xyz") for _ in range(r.randint(0, 90)))))
    rows += [(200, "a" * 500), (201, "ab" * 300), (202, passage[:99]), (203, passage[:100]), (203, passage[:100]), (203, passage[1:150])]
    got = suffix_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
    found = got.select("doc_id", "n_bytes", n.alias("n"), F.size("spans").alias("s"), "kept_sha256").collect()
    assert sorted(map(tuple, found), key=str) == brute_repeats(rows, 100)
    assert suffix_dedup.cut_repeats(nothing).count() == 0


@pytest.mark.parametrize("crowd", [8192, 1])
def test_maximal_repeats(spark, nothing, monkeypatch, crowd):
    """Every string of 100 bytes that occurs twice lies in a repeat with exactly its occurrences; occurrences of a repeat
    have equal bytes."""
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    r = random.Random(8)
    passage = "".join(r.choice("abcdefgh ") for _ in range(400))
    texts = {k: "".join(r.choice("xyz é") for _ in range(r.randint(0, 60))) + passage[a : a + r.randint(90, 200)] + "".join(r.choice("xyz") for _ in range(r.randint(0, 60))) for k, a in enumerate(r.choices(range(220), k=40))}
    texts |= {100: passage, 101: passage, 102: passage + passage[:150], 103: "a" * 230, 104: "", 105: passage[:99]}
    rows = spark.createDataFrame([*texts.items(), (100, passage), (106, None)], "doc_id long, text string")
    groups = defaultdict(set)
    for x in suffix_dedup.maximal_repeats(rows).collect():
        groups[x.repeat].add((x.doc_id, x.begin, x.end))
    raw = {k: (t or "").encode() for k, t in texts.items()}
    spread = defaultdict(set)
    for members in groups.values():
        bytes_ = {raw[d][a:b] for d, a, b in members}
        assert len(members) > 1 and len(bytes_) == 1 and (n := len(bytes_.pop())) >= 100
        for o in range(n - 99):
            spread[frozenset((d, a + o) for d, a, _ in members)].add(n)
    at = defaultdict(set)
    for k, t in raw.items():
        for p in range(len(t) - 99):
            at[t[p : p + 100]].add((k, p))
    wanted = [frozenset(v) for v in at.values() if len(v) > 1]
    assert wanted and all(v in spread for v in wanted)
    assert suffix_dedup.maximal_repeats(nothing).count() == 0
    spans = [(x.doc_id, x.begin, x.end) for x in suffix_dedup.removed_spans(rows).collect()]
    assert (101, 0, 400) in spans


def test_maximal_groups():
    texts = [b"xxhello world", b"yyhello worms", b"zzhello there", b"xxhello world"]
    at = [t.index(b"llo") for t in texts]
    got = {(a, b, tuple(sorted(m))) for a, b, m in repeats.maximal_groups([t[k:] for t, k in zip(texts, at)], [t[:k] for t, k in zip(texts, at)], 5)}
    assert (4, 9, (0, 3)) in got and (2, 7, (0, 1, 3)) in got and (2, 4, (0, 1, 2, 3)) in got


def test_pipeline_stages(spark, clashing, nothing, tmp_path):
    """Every stage against a brute-force version of its own, on what the stage before kept."""
    docs = clashing
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert stage(spark, nothing, SF).count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        before, rows = docs.collect(), after.collect()
        ids = Counter(r.doc_id for r in rows)
        if name == "quality_rules":
            assert not {30, 31, 32, 33, 34} & set(ids) and set(range(12)) <= set(ids)
        elif name == "line_dedup":
            assert ids == Counter(r.doc_id for r in before) and sum("shared by many" in r.text for r in rows) < sum("shared by many" in r.text for r in before)
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_dedup":
            classes = brute_classes([(r.doc_id, r.text) for r in before])
            assert ids == Counter(i for i, c in classes if i == c)
        elif name == "mixing":
            assert set(ids) <= {r.doc_id for r in before} and rows
        else:
            assert len(rows) == len(before) and all(r.n_tokens == len(r.ids) for r in rows)
        docs = after


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50 and out.columns == ["doc_id", "lang", "source", "ids", "decoded", "n_tokens"] and out.columns

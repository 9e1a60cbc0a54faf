import decimal
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest

from lamina.operators import layout
from lamina.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    if isinstance(x, float):
        return repr(round(x, 9))
    if isinstance(x, decimal.Decimal):
        return str(x)
    return str(bytes(x)) if isinstance(x, bytes | bytearray) else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    got = catalogue.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in catalogue.ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in rows) == want


def test_crc32_of_texts(spark):
    """SQL would run over every byte of every text, so this query is held against zlib."""
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert {(r.doc_id, r.digest) for r in catalogue.payload_crc32_texts(spark, SF).collect()} == {(i, zlib.crc32((t or "").encode())) for i, t in texts}


def balanced(spark, folder, rows):
    """The query's rows and those of its SQL over a table of these sizes and keys."""
    spark.createDataFrame(rows, "p_size int, p_partkey bigint").repartition(3).write.parquet(f"{folder}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    return sorted(map(tuple, catalogue.balanced_partition(spark, str(folder)).collect())), sorted(con.execute(catalogue.ORACLES["balanced_partition"]).fetchall())


def test_balanced_partition_of_long_groups(spark, tmp_path):
    """More rows than the reference cuts exactly (1,990): the query stays exact."""
    rng = random.Random(3)
    got, want = balanced(spark, tmp_path, [(size, key) for size in (2, 6, 16, 21) for key in rng.sample(range(1_000_000), 2400)])
    assert len(want) == 4 and got == want


def test_balanced_partition_of_odd_groups(spark, tmp_path):
    """Tied and far keys, keys and sizes below 0, nulls, weights of 0, groups too short."""
    rng = random.Random(4)
    rows = [(30, rng.randrange(400)) for _ in range(3000)] + [(31, rng.randrange(-(2**63), 2**63 - 1)) for _ in range(2500)]
    rows += [(size, rng.randrange(-50, 50)) for size in range(-60, -30) for _ in range(40)] + [(size, rng.randrange(-50, 50)) for size in range(100, 160) for _ in range(rng.randrange(1, 40))]
    rows += [(0, k) for k in range(9)] + [(None, k) for k in range(9)] + [(40, k) for k in (None, 1, 2, 3, None)] + [(41, 1), (41, 2), (42, 1), (42, 1), (42, 2), (43, None)]
    got, want = balanced(spark, tmp_path, rows)
    assert len(want) > 50 and got == want


def test_best_marks():
    rng = random.Random(5)
    for _ in range(300):
        parts, total = rng.randrange(1, 5), rng.randrange(-5, 60)
        ends = sorted({rng.randrange(-9, 60) for _ in range(rng.randrange(9))})
        ends = [x for x in ends if x < total]
        cuts = [layout.largest_gap(list(m), total) for m in itertools.combinations(ends, parts - 1)]
        marks = layout.best_marks(np.array(ends, "int64"), total, parts)
        assert (marks is None) == (not cuts) and (marks is None or len(marks) == parts - 1 and set(marks) <= set(ends) and layout.largest_gap(marks, total) == min(cuts))


def test_least_parts_marks_the_running_sums(spark):
    rng = random.Random(7)
    weights = [rng.randrange(1, 1000) for _ in range(20_000)]
    df = spark.createDataFrame([("a", k, w) for k, w in enumerate(weights)] + [("b", 5, 4), ("b", 9, 4)], "name string, k bigint, w int")
    upto = list(itertools.accumulate(weights))
    for parts in (2, 5):
        (got,) = layout.least_parts(df, "w", "k", "name", parts).where("name = 'a'").collect()
        cut = layout.best_cuts(weights, parts)
        sums = [sum(w for w, c in zip(weights, cut, strict=True) if c == p) for p in range(parts)]
        assert got.total == upto[-1] and got.largest == max(sums) == layout.largest_gap(got.marks, got.total) and set(got.marks) < set(upto) and len(got.marks) == parts - 1
    assert [tuple(r) for r in layout.least_parts(df, "w", "k", "name", 2).where("name = 'b'").collect()] == [("b", 8, 4, [4])]
    with pytest.raises(ValueError, match="two parts"):
        layout.least_parts(df, "w", "k", "name", 1)


def test_balanced_parts_on_both_sides_of_the_threshold(spark):
    rng = random.Random(9)
    groups = {"short": [rng.randrange(50) for _ in range(300)], "long": [rng.randrange(50) for _ in range(2500)]}
    df = spark.createDataFrame([(n, k, w) for n, ws in groups.items() for k, w in enumerate(ws)], "name string, k bigint, w bigint")
    got = {n: [] for n in groups}
    for r in layout.balanced_parts(df, "w", "k", "name", 3).orderBy("k").collect():
        got[r.name].append(r.part)
    assert got == {n: layout.cuts_by_cost(ws, 3) for n, ws in groups.items()} and not layout.exact_is_cheap(2500, 3)

"""Operator 11: Strassen against plain products, heaps and whole results against direct search."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import negatives

DATA = "/root/testdata/sf0.001"


def direct(rows, positives=5, n=3):
    """rows: (id, label, vector of integers, anchor)."""
    out = []
    for i, label, v, anchor in rows:
        if not anchor:
            continue
        score = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w, _ in rows if j != i and len(w) == len(v)]
        same = sorted((s, j) for s, j, other in score if other == label)[:positives]
        for s, p in same:
            window = sorted((t, j) for t, j, other in score if other != label and 50 * -s <= 100 * -t <= 95 * -s)[:n]
            out += [(i, p, k, j, -s, -t) for k, (t, j) in enumerate(window, 1)]
    return sorted(out)


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 64, 3), (97, 65, 131), (256, 128, 255), (48, 48, 48), (50, 0, 50)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(1)
    m, k, n = shape
    a, b = rng.integers(-(2**27), 2**27, (m, k)), rng.integers(-(2**27), 2**27, (k, n))
    assert (negatives.strassen(a, b) == a @ b).all()


def test_heaps_merge():
    rng = np.random.default_rng(2)
    score, ids = rng.integers(0, 9, (7, 60)), np.sort(rng.permutation(500)[:60])
    score[3] = negatives.NONE
    one, two, whole = (negatives.Heaps(7, 4) for _ in range(3))
    whole.offer(score.copy(), ids)
    one.offer(score[:, :25].copy(), ids[:25])
    two.offer(score[:, 25:].copy(), ids[25:])
    one.merge(two, np.arange(7))
    assert (one.score == whole.score).all() and (one.id == whole.id).all()
    for r in (0, 6):
        want = sorted(zip(-score[r], ids, strict=True))[:4]
        assert [(-s, i) for s, i in want] == list(zip(whole.score[r], whole.id[r], strict=True))
    assert set(whole.entries()[0]) == {0, 1, 2, 4, 5, 6}


def test_windows():
    for p in [0, 1, 19, 20, 21, 1000, 2**62, -5]:
        low, high = negatives.windows(np.array([p]))
        n = [x for x in range(-20, 1100) if 50 * p <= 100 * x <= 95 * p] if abs(p) <= 1000 else None
        if n is not None:
            assert n == list(range(int(low[0]), int(high[0]) + 1))
        else:
            assert int(low[0]) == -(-p // 2) and int(high[0]) == 95 * p // 100


def test_whole_result(spark):
    """Ties, negative scores, labels of few rows, pieces and chunks of a few rows."""
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.choice([0, 0, 0, 1, 2])) if i else 7, rng.integers(-9, 12, 5).tolist(), i % 5 == 0) for i in range(160)]
    d = spark.createDataFrame([(i, label, [x / 256 for x in v], a) for i, label, v, a in rows], "vec_id long, label int, embedding array<double>, a boolean")
    for kw in ({}, {"shard": 17, "chunk": 6, "tile": 8}):
        got = negatives.hard_negatives(d, F.col("a"), **kw)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(map(tuple, got.collect())) == direct(rows)


def test_edges(spark):
    one = [3.0, 4.0]
    rows = [
        (0, 1, one), (1, 1, one), (2, 2, [2.0, 2.0]), (3, 2, [2.0, 2.0]), (3, 2, [2.0, 2.0]), (4, None, one), (5, 1, None), (6, 1, [1.0, None]),
        (7, 2, [float("nan"), 1.0]), (8, 2, [float("inf"), 1.0]), (None, 1, one), (9, 2, [2.0, 2.0, 2.0]), (10, 2, []), (11, 2, [1e30, 1.0]),
    ]
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    for name in ("id", "row", "dim", "v", "piece", "chunk", "place", "rank", "anchor"):
        d = d.withColumn(name, F.lit("x"))
    out = sorted(map(tuple, negatives.hard_negatives(d, F.col("vec_id") == 0).collect()))
    ps, ns = 256 * 256 * 25, 256 * 256 * 14
    assert out == [(0, 1, 1, 2, ps, ns), (0, 1, 2, 3, ps, ns), (0, 1, 3, 3, ps, ns)]
    twice = negatives.hard_negatives(d.union(d.filter("vec_id = 0")), F.col("vec_id") == 0).collect()
    assert sorted(map(tuple, twice)) == sorted(out * 2)
    assert negatives.hard_negatives(d.limit(0), F.col("vec_id") == 0).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables aren't there")
def test_query_and_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    want = con.sql(negatives.OP11_SQL)
    got = negatives.op11_hard_negatives(spark, DATA)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert got.count() > 0

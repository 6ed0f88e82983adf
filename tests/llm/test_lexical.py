"""Operator 13 against scores of all documents taken directly."""

import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import lexical

DATA = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(lexical.TERMS, (text or "").translate(FOLD))


def direct(docs, items, k):
    """(item, rank, doc, score); documents of a null id last."""
    docs = [(i, w) for i, t in docs if (w := words(t))]
    n, total = len(docs), sum(len(w) for _, w in docs)
    df = {}
    for _, w in docs:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, w in docs:
            m, s = 50 + 50 * len(w) * n // total, 0
            for x in set(words(text)) & set(w):
                tf = w.count(x)
                s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * tf // (1000 * tf + 20 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("shard", [64, 16_384])
def test_random_texts(spark, monkeypatch, shard):
    """Common and rare words, ties, many blocks and shards."""
    monkeypatch.setattr(lexical, "BLOCK", 8)
    monkeypatch.setattr(lexical, "SHARD", shard)
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(400)]
    share = 1 / np.arange(1, 401)
    draw = lambda n: " ".join(rng.choice(vocabulary, n, p=share / share.sum()))
    docs = [(int(i), draw(rng.integers(0, 40))) for i in rng.permutation(1500)] + [(7000 + i, "w1 w2 w300") for i in range(30)]
    items = [(i, draw(12)) for i in range(15)] + [(90, "w1 w1 W2 w300"), (91, "unknown"), (92, "w0")]
    d, q = tables(spark, docs, items)
    for k in (5, 50):
        assert found(lexical.rank_documents(d.repartition(3), q, k)) == direct(docs, items, k)


def test_skipping_leaves_blocks_out(spark):
    """A rare word that some documents hold keeps most blocks of the common words' lists unread."""
    docs = [(i, "the of and" + (" rare" if i % 1000 == 5 else "")) for i in range(20_000)]
    d, _ = tables(spark, docs, [])
    row = lexical.build_shards(d.coalesce(1), ["and", "of", "rare", "the"], "doc_id", "text").first().asDict()
    shard = lexical.Shard(row, np.array([10, 10, 9000, 10]), 20_000, 60_020)
    score, doc = shard.search([0, 1, 2, 3], 10)
    assert len(score) == 10 and shard.seen <= 17 and (shard.doc_id[doc] % 1000 == 5).all()
    whole = [int(x) for x in shard.doc_id[doc]]
    assert whole == sorted(whole)


def test_edges(spark):
    docs = [
        (3, "Same text here"), (1, "same TEXT here"), (1, "same text here"), (None, "same text here"), (2, None), (4, ""), (5, " ,;! "), (6, "word " * 50_000),
        (8, "Ünï 日本 😀x"), (9, "ÜNÏ 日本"), (10, "x" * 70_000),
    ]
    items = [(1, "same text"), (1, "same text"), (2, None), (3, ""), (4, "word"), (5, "ünï Ünï 日本 😀x"), (None, "here"), (6, "x" * 70_000), (7, "x")]
    d, q = tables(spark, docs, items)
    for name in ("id", "row", "score", "term", "rank", "item"):
        d, q = d.withColumn(name, F.lit("z")), q.withColumn(name, F.lit("z"))
    got = lexical.rank_documents(d, q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(got) == direct(docs, items, 50)
    assert found(lexical.rank_documents(d, q, query_bytes=30_000)) == direct(docs, items, 50)  # several parts of the queries
    assert lexical.rank_documents(d.limit(0), q).collect() == []
    assert lexical.rank_documents(d, q.limit(0)).collect() == []


def test_terms_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(lexical.Vocabulary, "hashes", staticmethod(lambda data, start, end: np.zeros(len(start), np.uint64)))
    known = lexical.Vocabulary(["abc"])
    low = np.frombuffer(b"abc abd abc", np.uint8)
    word, term = known.find(low, np.array([0, 4, 8]), np.array([3, 7, 11]))
    assert word.tolist() == [0, 2] and term.tolist() == [0, 0]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables aren't there")
def test_query_and_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(lexical.OP13_SQL)
    got = lexical.op13_lexical_search(spark, DATA)
    assert found(got.select(*want.columns)) == sorted(want.fetchall(), key=str)
    d, q = (con.sql(f"select * from {t}").fetchall() for t in ("documents", "benchmark"))
    assert found(got) == direct([r[:2] for r in d], q, 50)

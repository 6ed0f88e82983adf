"""Trigram postings made inside a row: against a plain count, in small pieces and with very many signs, without a shuffle."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import grams, search


def plain(rows):
    out = {}
    for field, i, text in rows:
        for at in range(len(text) - 2):
            out.setdefault((text[at : at + 3], field, i), []).append(at + 1)
    return out


@pytest.mark.parametrize("alphabet", ["ab", "".join(map(chr, range(97, 123))) + "äß日本😀", "".join(map(chr, range(0x4E00, 0x9FFF))) + "".join(map(chr, range(0x20000, 0x2A000)))])
def test_postings_against_plain_count(alphabet):
    rng = random.Random(3)
    rows = [(f, str(i), "".join(rng.choices(alphabet, k=rng.choice([3, 50, 3000])))) for i in range(30) for f in ("title", "abstract")]
    batch = grams.postings([(f, i, np.frombuffer(t.encode("utf-32-le"), "<u4")) for f, i, t in rows])
    keys = list(zip(*(batch.column(c).to_pylist() for c in ("gram", "field", "id")), strict=True))
    assert keys == sorted(keys)
    assert dict(zip(keys, batch.column("positions").to_pylist(), strict=True)) == plain(rows)


def test_pieces(spark, monkeypatch):
    rows = [(str(i), "Some-Title of  a paper", None if i % 2 else "A name", "text " * i) for i in range(40)]
    p = spark.createDataFrame(rows, "id string, title string, authors_text string, abstract string").coalesce(1)
    whole = search.build_gram_index(p).toArrow().to_pylist()
    texts = search.indexed_texts(p).toArrow()
    monkeypatch.setattr(grams, "PIECE", 100)
    pieces = [r for b in grams.of_batches(iter(texts.to_batches())) for r in b.to_pylist()]
    key = lambda r: (r["gram"], r["field"], r["id"], tuple(r["positions"]))
    want = plain([(f, r["id"], r[f]) for r in texts.to_pylist() for f in search.WEIGHTS])
    assert sorted(map(key, whole)) == sorted(map(key, pieces)) == sorted((*k, tuple(v)) for k, v in want.items())


def test_no_exchange(spark):
    p = spark.createDataFrame([("1", "a title", "b", "c")], "id string, title string, authors_text string, abstract string")
    assert "Exchange" not in search.build_gram_index(p)._jdf.queryExecution().executedPlan().toString()


def test_texts_go(spark, tmp_path):
    p = spark.range(50).select(F.col("id").cast("string").alias("id"), F.lit("learning").alias("title"), F.lit("x").alias("authors_text"), F.lit("").alias("abstract"))
    search.write_gram_index(p, str(tmp_path / "i"))
    assert sorted(x.name for x in (tmp_path / "i").iterdir()) == ["lengths", "postings", "totals"]
    assert search.bm25_of_index(search.read_gram_index(spark, str(tmp_path / "i")), "learn").count() == 50

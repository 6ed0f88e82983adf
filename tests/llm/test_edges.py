"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import bpe, chat, exact_dedup, near_dedup, neighbours, packing, pii, quality, repeats, toxicity

TEXTS = [None, "", " \n\t ", "a", "one two", "Mail me at a.b@c.de or call +1 (988) 555-2485", "x" * 60_000, "word " * 40_000, "Ünï 日本 😀 <|endoftext|>", "same text here", "same text here"]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(10, "same text here"), (None, "same text here"), (None, None)]


def documents(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    # columns whose names the operators use themselves
    for name in ("id", "key", "n", "path", "spans", "digest", "salt", "content", "keep", "score", "runs", "group", "bucket", "length"):
        d = d.withColumn(name, F.lit(1))
    return d.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))


def labels(spark, rows):
    return spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i, _ in rows if i is not None] * 2, "doc_id long, quality int, toxic int")


OPERATORS = {
    "toxicity": lambda d, l: toxicity.toxicity(d, l),
    "pii": lambda d, l: pii.find_pii(d),
    "redact": lambda d, l: pii.redact(d),
    "repeats": lambda d, l: repeats.remove_repeats(d),
    "exact": lambda d, l: exact_dedup.exact_dedup(d),
    "quality": lambda d, l: quality.quality(d, l),
    "bpe": lambda d, l: bpe.bpe_digests(d),
    "near": lambda d, l: near_dedup.near_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, name):
    d, l = documents(spark, ROWS), labels(spark, ROWS)
    out = OPERATORS[name](d, l).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](documents(spark, []), labels(spark, [])).collect() == []


def test_packing_edges(spark):
    assert packing.best_fit_pack(documents(spark, [])).collect() == []
    out = packing.best_fit_pack(documents(spark, ROWS)).collect()
    assert sum(r["start"] == 0 for r in out) == len(ROWS)
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in places.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= 1024


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (None, 0, "user", "hello"), (2, None, "assistant", "y" * 50_000)]
    d = spark.createDataFrame(rows, schema).withColumn("seq", F.lit(7)).withColumn("kind", F.lit("delta"))
    out = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold_events(chat.events_of(d)))).collect()}
    assert {k: len(v["turns"]) for k, v in out.items()} == {1: 4, None: 1, 2: 1}
    assert out[2]["loss_text"] == "y" * 50_000
    assert chat.render(chat.fold_events(chat.events_of(d.limit(0)))).collect() == []


def test_neighbour_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0, 1.0]), (9, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(0)).withColumn("score", F.lit(0))
    out = neighbours.nearest(d, d, k=2, factor=1.0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in out if r["query_id"] in (1, 6)] == [(1, 6), (1, 7), (6, 1), (6, 7)]
    assert not [r for r in out if r["query_id"] in (2, 3, 4, 5, 9)]
    assert neighbours.nearest(d.limit(0), d, k=2).collect() == []


def test_stages_on_edges(spark, tmp_path):
    labels(spark, ROWS).write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (ROWS, []):
        d = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, str(tmp_path))
            assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
            out.count()

"""The pipeline's stages take out single rows, also where ids are null or repeated."""

from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import quality, shared

LONG = "one two three four five six seven eight nine ten eleven twelve"


def documents(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return d.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))


def kept(df):
    return sorted([(r["doc_id"], r["text"]) for r in df.collect()], key=str)


def test_quality_takes_single_rows(spark, tmp_path, monkeypatch):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def scores(docs, labels, **_):
        return docs.withColumn("score", F.when(F.col("text") == "bad", 0.1).otherwise(0.9)).drop("text")

    monkeypatch.setattr(quality, "quality", scores)
    rows = [(None, "bad", "en"), (None, "good", "en"), (1, "bad", "en"), (1, "fine", "en")]
    out = corpus_pipeline.keep_quality(spark, documents(spark, rows), str(tmp_path))
    assert kept(out) == [(1, "fine"), (None, "good")]


def test_quality_scores_carry_the_row(spark):
    d = documents(spark, [(None, "a", "en"), (None, LONG, "en"), (2, "b", "en")]).withColumn("row", F.monotonically_increasing_id())
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.quality(d, labels, row_col="row")
    assert out.columns == ["doc_id", "score", "row"]
    assert {r["row"] for r in out.collect()} == {r["row"] for r in d.collect()}


def test_one_copy_stays(spark, tmp_path):
    rows = [(None, "copy", "en"), (None, "other", "en"), (3, "Copy", "en"), (3, "copy", "de"), (3, "third", "en"), (None, "twin", "en"), (None, "twin", "en")]
    out = kept(corpus_pipeline.drop_copies(spark, documents(spark, rows), str(tmp_path)))
    assert [(i, t.lower()) for i, t in out] == [(3, "copy"), (3, "third"), (None, "other"), (None, "twin")]


def test_one_near_copy_stays(spark, tmp_path):
    rows = [(None, LONG, "en"), (None, "a text of its own that is like no other one", "en"), (3, LONG, "en"), (3, LONG.upper(), "en"), (3, "third text that is like nothing else in this table", "en"), (None, "twins of no id " * 3, "en"), (None, "twins of no id " * 3, "en"), (None, None, "en"), (None, "", "en")]
    out = kept(corpus_pipeline.drop_near_copies(spark, documents(spark, rows), str(tmp_path)))
    want = [(3, LONG), (3, rows[4][1]), (None, rows[1][1]), (None, rows[5][1]), (None, None), (None, "")]
    assert sorted([(i, t.lower() if t and t.isupper() else t) for i, t in out], key=str) == sorted(want, key=str)


def test_places_at_the_ends_of_the_range(spark):
    d = spark.createDataFrame([(i, r) for i in (None, -(2**63), -1, 0, 2**63 - 1) for r in (0, 2**63 - 1)], "id long, row long")
    for null_id in (-(2**63) - 1, 2**63):
        for r in d.withColumn("place", shared.place(F.col("id"), F.col("row"), null_id)).collect():
            assert int(r["place"]) == (null_id if r["id"] is None else r["id"]) * 2**63 + r["row"]


def test_numbers_of_rows_in_files(spark, tmp_path):
    """Unique, the same at every read and under other columns, and stages on files do what they do on other tables."""
    rows = [(None, "copy", "en"), (None, "other", "en"), (3, "Copy", "en"), (3, "copy", "de"), (3, "third", "en"), (None, "twin", "en"), (None, "twin", "en")]
    documents(spark, rows).repartition(3).write.parquet(f"{tmp_path}/docs")
    d = spark.read.parquet(f"{tmp_path}/docs")
    numbered = corpus_pipeline.numbered(d)
    first = sorted((r["row"], str(r["text"])) for r in numbered.select("row", "text").collect())
    assert len({n for n, _ in first}) == len(rows)
    assert [n for n, _ in first] == sorted(r["row"] for r in corpus_pipeline.numbered(d).select("row").collect())
    assert {r["row"] for r in numbered.filter("text = 'twin'").select("row").collect()} == {n for n, t in first if t == "twin"}
    out = kept(corpus_pipeline.drop_copies(spark, d, str(tmp_path)))
    assert [(i, t.lower()) for i, t in out] == [(3, "copy"), (3, "third"), (None, "other"), (None, "twin")]


def test_numbers_of_derived_rows(spark, tmp_path):
    """Exploded, joined and united rows, and files read twice, are rows of their own; of copies one stays."""
    documents(spark, [(i, f"text {i // 2}", "en") for i in range(40)]).repartition(3).write.parquet(f"{tmp_path}/docs")
    d = spark.read.parquet(f"{tmp_path}/docs")
    two = spark.createDataFrame([("a",), ("b",)], "x string")
    columns = corpus_pipeline.COLUMNS
    derived = {
        "explode": d.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))),
        "join": d.join(two, F.lit(True)),
        "union": d.unionByName(d),
        "cached": d.unionByName(d).cache(),
        "twice": spark.read.parquet(f"{tmp_path}/docs", f"{tmp_path}/docs"),
        "filter": d.filter("doc_id >= 0").select(*reversed(columns), F.lit(1).alias("more")),
    }
    for name, rows in derived.items():
        n = rows.count()
        numbers = corpus_pipeline.numbered(rows).select("row").collect()
        assert len(numbers) == n and len({r["row"] for r in numbers}) == n, name
        out = kept(corpus_pipeline.drop_copies(spark, rows, str(tmp_path)))
        assert sorted(i for i, _ in out) == [*range(1, 40, 2)], name
    assert corpus_pipeline.plain_scan(d) and corpus_pipeline.plain_scan(derived["filter"])
    assert not any(corpus_pipeline.plain_scan(derived[x]) for x in ("explode", "join", "union", "cached", "twice"))

"""D3 on a stored corpus: equal to the merge of whole tables, touched buckets only, and safe when a merge dies. W10 by ranges."""

import os

import pytest
from pyspark.sql import functions as F

from quillspark.operators import merge, worklist
from quillspark.sources import corpus

RAW = "conf string, paper_name string, paper_authors array<string>, paper_url string, paper_abstract string, paper_code string, seq long"


def rows_of(df):
    return sorted(map(str, df.select(*corpus.COLUMNS).collect()))


def files(path):
    """Name and time of every data file, by bucket."""
    found = {}
    for home, _, names in os.walk(f"{path}/base"):
        for n in names:
            if n.endswith(".parquet"):
                bucket = int(home.rsplit("bucket=", 1)[1])
                found.setdefault(bucket, set()).add((home, n, os.stat(f"{home}/{n}").st_mtime_ns))
    return found


@pytest.fixture
def old(spark):
    rows = [(f"C{c}2020", f"t{i}", ["a"], f"https://x.org/{c}/{i}" if i % 5 else "", "" if i % 2 else "held", "#", 100 * c + i) for c in range(30) for i in range(10)]
    return spark.createDataFrame(rows, RAW)


@pytest.fixture
def new(spark):
    rows = [
        ("C32020", "fresh title", ["a", "b"], "https://x.org/3/1", "a much longer text", "https://github.com/a/b", 9000),
        ("C32020", "only new", [], "https://x.org/3/new", None, None, 9001), ("C32020", "only new", [], "https://x.org/3/new", None, None, 9001),
        ("C992021", None, None, None, None, None, 9002), ("C52020", "Proceedings of the 5th", [], "https://doi.org/10.1145/12345", "", "#", 9003),
    ]
    return spark.createDataFrame(rows, RAW)


def test_equal_to_the_merge_of_whole_tables(spark, tmp_path, old, new):
    path = f"{tmp_path}/c"
    assert corpus.create_corpus(old, path, 16)["batch"] == 0 and rows_of(corpus.read_corpus(spark, path)) == rows_of(old)
    manifest = corpus.merge_into(new, path)
    assert manifest["batch"] == 1
    want = rows_of(merge.merge_incremental(new, old))
    assert rows_of(corpus.read_corpus(spark, path)) == want and sum(manifest["rows"].values()) == len(want)
    again = new.withColumn("paper_abstract", F.lit("x" * 99))
    corpus.merge_into(again, path)
    assert rows_of(corpus.read_corpus(spark, path)) == rows_of(merge.merge_incremental(again, merge.merge_incremental(new, old)))
    with pytest.raises(ValueError, match="already"):
        corpus.create_corpus(old, path)


def test_untouched_files_keep_names_and_times(spark, tmp_path, old, new):
    path = f"{tmp_path}/c"
    first = corpus.create_corpus(old, path, 16)
    before = files(path)
    second = corpus.merge_into(new, path)
    touched = {int(b) for b, v in second["buckets"].items() if v == 1}
    assert len(touched) in (2, 3) and touched == set(corpus.sizes(merge.P.drop_on_collect(new), 16))
    after = files(path)
    assert all(after[b] == before[b] for b in before if b not in touched)
    assert all(before[b] < after[b] for b in touched & set(before))  # the version before is kept for its readers
    assert {b: v for b, v in first["buckets"].items() if int(b) not in touched}.items() <= second["buckets"].items()
    corpus.merge_into(new, path)
    left = files(path)
    assert all(left[b] == before[b] for b in before if b not in touched) and not any("v=0/" in f[0] for b in touched for f in left[b])


def test_a_merge_that_dies(spark, tmp_path, old, new, monkeypatch):
    path = f"{tmp_path}/c"
    corpus.create_corpus(old, path, 16)
    put = corpus.Folder.put
    monkeypatch.setattr(corpus.Folder, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        corpus.merge_into(new, path)
    assert rows_of(corpus.read_corpus(spark, path)) == rows_of(old)
    monkeypatch.setattr(corpus.Folder, "put", put)
    assert corpus.merge_into(new, path)["batch"] == 1
    assert rows_of(corpus.read_corpus(spark, path)) == rows_of(merge.merge_incremental(new, old))


def test_empty_tables_and_nulls(spark, tmp_path, old, new):
    path, none = f"{tmp_path}/c", spark.createDataFrame([], RAW)
    with pytest.raises(ValueError, match="no corpus"):
        corpus.merge_into(new, path)
    assert corpus.create_corpus(none, path, 4)["rows"] == {} and corpus.read_corpus(spark, path) is None
    assert corpus.merge_into(none, path)["batch"] == 0
    corpus.merge_into(new, path)
    assert rows_of(corpus.read_corpus(spark, path)) == rows_of(merge.merge_incremental(new, none))
    extra = old.withColumn("bucket", F.lit("clash")).withColumn("slices", F.lit("clash"))
    corpus.create_corpus(extra, f"{tmp_path}/d", 4)
    assert rows_of(corpus.read_corpus(spark, f"{tmp_path}/d")) == rows_of(old)


def test_a_hot_conference_is_written_by_several_tasks(spark, tmp_path):
    path = f"{tmp_path}/c"
    hot = spark.range(4000).select(F.lit("H2020").alias("conf"), F.concat(F.lit("t"), "id").alias("paper_name"), F.array().cast("array<string>").alias("paper_authors"),
        F.concat(F.lit("https://x.org/"), "id").alias("paper_url"), F.lit("").alias("paper_abstract"), F.lit("#").alias("paper_code"), F.col("id").alias("seq"))
    corpus.create_corpus(hot, path, 4, each=500)
    assert len(*files(path).values()) >= 4
    manifest = corpus.merge_into(hot.filter("seq < 10"), path, each=500)
    assert list(manifest["rows"].values()) == [4000] and corpus.read_corpus(spark, path).select("paper_url").distinct().count() == 4000


def test_strata_by_ranges(spark, tmp_path):
    """The same sample as by hosts; without a window over a host's year in the plan."""
    rows = [(f"{i:05d}", None if i % 50 == 0 else 2000 + i % 3, None if i % 97 == 0 else f"https://hot.org/{i * 7919 % 3001:05d}" if i % 3 else f"https://h{i % 7}.org/{i:05d}") for i in range(3000)]
    d = spark.createDataFrame(rows, "id string, year int, url string").repartition(5).withColumn("place", F.lit("clash"))
    strata = {"hot": (F.col("url").contains("hot"), 18), "rest": (F.lit(True), 6)}
    ranged = worklist.sample_strata(d, strata, 40, 42, f"{tmp_path}/places")
    assert sorted(map(str, ranged.collect())) == sorted(map(str, worklist.sample_strata(d.drop("place"), strata, 40, 42).collect()))
    assert ranged.count() == 40
    plan = ranged._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "windowspecdefinition(_part" in plan
    assert worklist.sample_strata(d.limit(0), strata, 40, 42, f"{tmp_path}/none").count() == 0


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    """One conference with much text in few rows goes to several files, in the first version and after merges."""
    monkeypatch.setattr(corpus, "BYTES_A_FILE", 20_000)
    schema = "conf string, paper_name string, paper_url string, paper_abstract string, paper_authors array<string>, paper_code string, seq long"
    rows = lambda first: spark.createDataFrame([("A2020", f"t{i}", f"https://e.org/{i}", "x" * 1000, ["a"], "#", i) for i in range(first, first + 100)], schema)
    path = str(tmp_path / "c")
    corpus.create_corpus(rows(0), path, buckets=4)
    manifest = corpus.merge_into(rows(100), path)
    (bucket, n), = manifest["rows"].items()
    files = list((tmp_path / "c" / f"base/v={manifest['batch']}" / f"bucket={bucket}").glob("*.parquet"))
    assert n == 200 and len(files) > 3 and corpus.read_corpus(spark, path).count() == 200
    assert 200_000 <= manifest["bytes"][bucket] <= 220_000

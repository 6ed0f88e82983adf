"""D2 and R2 on keys that very many rows share: the counters of the fold, and plans without a window over such a key."""

import random
import re

from pyspark.sql import functions as F

from quillspark.operators import merge, repair

RAW = "conf string, paper_name string, paper_authors array<string>, paper_url string, paper_abstract string, paper_code string, seq long"


def fold(rows):
    """D2's counters, row by row."""
    best, n = {}, {"rows_saved": 0, "abstract_rescued": 0, "abstract_upgraded": 0, "code_upgraded": 0, "authors_extended": 0}
    for key, size, authors, real in rows:
        if key in best:
            a, m, r = best[key]
            n["rows_saved"] += 1
            n["abstract_rescued"] += a == 0 < size
            n["abstract_upgraded"] += 0 < a < size
            n["code_upgraded"] += real and not r
            n["authors_extended"] += authors > m
        a, m, r = best.get(key, (0, 0, False))
        best[key] = (max(a, size), max(m, authors), r or real)
    return n


def test_counters_over_runs(spark, monkeypatch):
    """A hot key and others, in runs of a few rows; seq with gaps and out of the order of the table."""
    rng = random.Random(6)
    said = [(rng.choice(["hot", "hot", "hot", *"abcdef"]), rng.choice([0, 0, 5, 9, i // 9]), rng.randint(0, 2 + i // 60), rng.random() < 0.1) for i in range(400)]
    rows = [("A2020", "t", ["x"] * m, f"https://x.org/{k}", "y" * size, "https://github.com/a/b" if real else "#", 3 * i) for i, (k, size, m, real) in enumerate(said)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, RAW)
    want = fold(said)
    for run in (1, 7, 50, 10**6):
        monkeypatch.setattr(merge.folds_before, "__defaults__", (run,))
        assert merge.dedupe_clean(df)[1].first().asDict() == want


def test_a_key_of_a_million_rows(spark):
    """Ten runs in ten tasks; the counters are known from the sizes."""
    n = 1_000_000
    df = spark.range(0, n, 1, 8).select(
        F.lit("A2020").alias("conf"), F.lit("t").alias("paper_name"), F.array(F.lit("a")).alias("paper_authors"), F.lit("https://x.org/1").alias("paper_url"),
        F.repeat(F.lit("y"), (F.col("id") / 100_000).cast("int")).alias("paper_abstract"), F.when(F.col("id") == 777_777, "https://github.com/a/b").otherwise("#").alias("paper_code"),
        F.col("id").alias("seq"),
    )
    rows, stats = merge.dedupe_clean(df)
    assert stats.first().asDict() == {"rows_saved": n - 1, "abstract_rescued": 1, "abstract_upgraded": 8, "code_upgraded": 1, "authors_extended": 0}
    assert rows.select("seq", F.length("paper_abstract").alias("size"), "paper_code").first().asDict() == {"seq": 0, "size": 9, "paper_code": "https://github.com/a/b"}
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    rowwise = [x for x in plan.splitlines() if "Window [" in x and "AS _o_" in x]
    assert len(rowwise) == 1 and re.search(r"windowspecdefinition\([^)]*_run#", rowwise[0])  # inside a run


def test_repair_of_many_rows_to_one_url(spark):
    n = 2000
    wrapped = lambda i: f"https://web.archive.org/web/2020/http://dead.org/{i}"
    papers = spark.createDataFrame([("A2020", f"t{i}", [], wrapped(i), "" if i % 2 else "held", "#", i) for i in range(n)] + [("A2020", "there", [], "https://doi.org/10.1/b", "", "#", n)], RAW)
    accepted = spark.createDataFrame([(i, "https://doi.org/10.1/a" if i % 4 else "https://doi.org/10.1/b", "found", "s") for i in range(n)], "seq long, new_url string, abstract string, source string")
    out, log = repair.repair_urls(papers, accepted)
    assert {(r["paper_url"], r["paper_name"], r["seq"]) for r in out.collect()} == {("https://doi.org/10.1/a", "t1", 1), ("https://doi.org/10.1/b", "there", n)}
    assert {(r["action"], r["count"]) for r in log.groupBy("action").count().collect()} == {("rewrite", 1), ("merge", n - 1)}
    assert log.filter("action = 'rewrite'").first()["seq"] == 1
    assert "Window" not in log._jdf.queryExecution().optimizedPlan().toString()


def test_untitled_rows_stay_apart(spark):
    rows = [("A2020", None, [], f"https://x.org/{i}", "", "#", i) for i in range(20)]
    out = merge.merge_official(spark.createDataFrame(rows, RAW), spark.createDataFrame([("A2020", "", [], "https://x.org/3", "new text", "#", 0)], RAW))
    assert out.count() == 20 and out.filter("paper_abstract = 'new text'").count() == 1

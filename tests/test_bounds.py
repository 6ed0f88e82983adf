"""M8's bound on title ratios and P9's index of stored conditions: same answers as without them, fewer tests."""

import difflib
import random

from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.functions import predicates as P
from quillspark.operators import linkage


def titles(n=400):
    rng = random.Random(7)
    base = ["deep learning of graphs", "learning deep graphs", "a study of über-large models", "state of the art", "日本語 text", "attention is all you need", "xyz", ""]

    def changed(t):
        t = list(t)
        for _ in range(rng.randint(0, 6)):
            i = rng.randint(0, len(t))
            t[i : i + rng.randint(0, 2)] = rng.choice(["", "a", "é", "7", " zz"])
        return "".join(t)

    return [(changed(rng.choice(base)), changed(rng.choice(base))) for _ in range(n)]


def test_bound_and_verdicts(spark):
    d = spark.createDataFrame(titles(), "a string, b string")
    x, y = C.plain_title_key(F.col("a")), C.plain_title_key(F.col("b"))
    for least in (0.8, 0.9):
        rows = d.select(x.alias("x"), y.alias("y"), linkage.ratio_bound(x, y).alias("bound"), linkage.title_gate(F.col("a"), F.col("b"), least).alias("ok")).collect()
        for r in rows:
            ratio = difflib.SequenceMatcher(None, r["x"], r["y"]).ratio()
            assert r["bound"] >= ratio - 1e-12
            assert r["ok"] == bool(r["x"] and r["y"] and (r["x"] in r["y"] or r["y"] in r["x"] or ratio >= least))
        report = linkage.gate_report(d, "a", "b", least).first()
        assert report["pairs"] == 400 and report["matched"] < report["by_length"] / 2
        assert report["matched"] >= sum(r["ok"] for r in rows) - report["contained"]


def test_shares_of_known_pairs(spark):
    d = spark.createDataFrame([("abc", "abc"), ("abcdef", "uvwxyz"), ("abcdef", "fedcba"), ("abcdefgh", "x"), ("", "a"), (None, "b")], "a string, b string")
    assert linkage.gate_report(d, "a", "b", 0.9).first().asDict() == {"pairs": 6, "contained": 1, "by_length": 2, "matched": 1}
    got = [bool(r[0]) for r in d.select(linkage.title_gate(F.col("a"), F.col("b"), 0.9)).collect()]
    assert got == [True, False, False, False, False, False]


def corpus(spark):
    rng = random.Random(8)
    words = ["graph", "deep", "learning", "kernel", "proof", "quantum", "ÜBER", "c++", "ai", "zeta"]
    draw = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(str(i), draw(3), draw(8) if i % 7 else None, "ACL", draw(2), 2000 + i % 9) for i in range(300)]
    return rows, spark.createDataFrame(rows, "id string, title string, abstract string, conf string, authors_text string, year int")


def met(row, field, negate, value):
    _, title, abstract, conf, authors, year = row
    own = {"title": title, "abstract": abstract, "conf": conf, "author": authors}
    if field == "year":
        hit = str(year) == (value or "").lower() if value is not None else False
    else:
        text = own[field] or "" if field in own else " ".join(x for x in (title, abstract, authors, conf) if x is not None)
        hit = value is not None and value.lower() in text.lower()
    return hit != bool(negate)


def test_saved_queries_by_index(spark):
    rng = random.Random(9)
    rows, papers = corpus(spark)
    fields = ["title", "abstract", "author", "conf", "year", "any", "keywords"]
    values = ["graph", "Deep", "learning kernel", "proo", "ai", "c+", "2003", "über", "no such", "", "a"]
    asked = [(q, leg, rng.choice(fields), rng.random() < 0.25, rng.choice(values)) for q in range(60) for leg in range(rng.randint(1, 3)) for _ in range(rng.randint(1, 3))]
    asked += [(97, 1, "year", False, "2003"), (98, 1, "title", True, "graph"), (99, 1, "any", False, "quantum"), (99, 2, "title", False, "quantum")]
    d = spark.createDataFrame(asked, "query_id int, leg int, field string, negate boolean, value string")
    want = {}
    for q in {a[0] for a in asked}:
        legs = {leg: [a[2:] for a in asked if a[:2] == (q, leg)] for leg in {a[1] for a in asked if a[0] == q}}
        want[q] = sum(any(all(met(r, *c) for c in cs) for cs in legs.values()) for r in rows)
    for few in (0, 1000):
        assert {r["query_id"]: r["hits"] for r in P.match_saved_queries(papers, d, few=few).collect()} == want
    assert {r["query_id"]: r["hits"] for r in P.match_saved_queries(papers.limit(0), d).collect()} == dict.fromkeys(want, 0)


def test_papers_are_tested_on_few_legs(spark):
    """Legs of rare words cost a paper nothing, whatever their number."""
    _, papers = corpus(spark)
    asked = spark.range(2000).select(F.col("id").cast("int").alias("query_id"), F.lit(1).alias("leg"), F.lit("title").alias("field"), F.lit(False).alias("negate"), F.concat(F.lit("graph rare"), F.col("id").cast("string")).alias("value"))
    legs = P.indexed_legs(papers, asked, 300)
    assert legs.filter("gram is null").count() == 0
    assert P.candidate_legs(papers, legs).count() == 0
    one = P.indexed_legs(papers, spark.createDataFrame([(1, 1, "title", False, "graph")], "query_id int, leg int, field string, negate boolean, value string"), 300)
    assert P.candidate_legs(papers, one).count() == sum("graph" in " ".join(x for x in r[1:5] if x) for r in corpus(spark)[0])

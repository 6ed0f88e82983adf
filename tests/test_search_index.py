"""BM25 of substring phrases, from texts and from the positional index, against a SQLite full-text table."""

import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillspark.operators import search

FIELDS = {"title": ["title", "abstract"], "author": ["authors"], "abstract": ["abstract"], "any": ["title", "abstract", "authors"]}


def indexed(text):
    return re.sub(r"\s+", " ", text or "").strip().lower().replace("-", " ")


def full_text(rows, query, field, author=""):
    """id -> score of a full-text table with trigrams, as its own function ranks."""
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(title, abstract, authors, content='', tokenize='trigram')")
    con.executemany("insert into t(rowid, title, abstract, authors) values (?, ?, ?, ?)", [(int(i), indexed(t), indexed(b), indexed(a)) for i, t, a, b in rows])
    long = lambda text: [w for w in search.C.tokens(text) if len(w) >= 3]
    quoted = lambda ws, op: f" {op} ".join('"' + w.replace('"', '""') + '"' for w in ws)
    parts = []
    if long(query):
        parts.append("(" + " OR ".join(f"{c} : ({quoted(long(query), 'AND')})" for c in FIELDS[field]) + ")")
    if long(author) and len(long(author)) == len(search.C.tokens(author)):
        parts.append(f"authors : ({quoted(long(author), 'OR')})")
    found = con.execute("select rowid, bm25(t, 3.0, 1.0, 2.0) from t where t match ?", (" AND ".join(parts),)).fetchall()
    return {str(i): -score for i, score in found}


def corpus(spark):
    rng = random.Random(5)
    words = ["deep", "learning", "learn", "unlearning", "graph", "graphs", "state-of-the-art", "Rank", "c++", "node.js", "aaaa", "aaaaaa", "Über", "日本語文", "-", "to"]
    draw = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    rows = [(str(i), draw(6), draw(3), rng.choice([draw(20), draw(5) + "  " + draw(4), None])) for i in range(1, 160)]
    rows += [("900", "Deep learning of graphs", "Ann Learn", "plain"), ("901", "Learn to rank", "Bo", "text"), ("902", "unlearning", "Cy", "other")]
    return rows, spark.createDataFrame(rows, "id string, title string, authors_text string, abstract string").withColumn("year", F.lit(2020)).withColumn("conf", F.lit("X"))


QUERIES = [("learn", "title", ""), ("deep graph", "title", ""), ("deep learn deep", "any", ""), ("aaaa", "abstract", ""), ("c++ to", "title", ""), ("über", "any", ""), ("日本語", "title", ""), ("learn", "author", ""), ("graph", "title", "learn rank"), ("graph", "any", "learn to")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows, papers = corpus(spark)
    path = str(tmp_path_factory.mktemp("grams"))
    search.write_gram_index(papers, path)
    return rows, papers, search.read_gram_index(spark, path)


@pytest.mark.parametrize(("query", "field", "author"), QUERIES)
def test_scores_of_a_full_text_table(stored, query, field, author):
    rows, papers, index = stored
    want = full_text(rows, query, field, author)
    assert want
    plain = {r["id"]: r["bm25"] for r in search.with_bm25(papers, query, field, author).collect()}
    kept = {r["id"]: r["bm25"] for r in search.bm25_of_index(index, query, field, author).collect()}
    for i, score in want.items():
        assert plain[i] == pytest.approx(score, rel=1e-6, abs=2e-12)
        assert kept[i] == pytest.approx(score, rel=1e-6, abs=2e-12)


def test_ranks_by_phrase_within_the_enabled_columns(stored):
    """Nearness of lengths decides, an author of that name adds nothing to a search of titles and abstracts."""
    rows, papers, index = stored
    some = papers.filter("cast(id as int) >= 900")
    got = [r["id"] for r in search.with_bm25(some, "learn").orderBy(F.desc("bm25"), "id").collect()]
    want = full_text(rows[-3:], "learn", "title")
    assert got == sorted(want, key=lambda i: (-want[i], i))


def test_search_with_and_without_an_index(stored):
    _, papers, index = stored
    for query, field, author in QUERIES:
        pages = [search.search(papers, query, field, size=50, index=x, author=author) for x in (None, index)]
        one, two = ([(r["rank"], r["id"], r["score"]) for r in page.orderBy("rank").collect()] for page, _ in pages)
        assert one == two
        assert pages[0][1].first() == pages[1][1].first()


def test_plans(stored):
    """The total needs no statistics, and a search with an index reads no text but the candidates'."""
    _, papers, index = stored
    total = search.search(papers, "learn")[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in total
    plan = search.bm25_of_index(index, "learn")._jdf.queryExecution().executedPlan().toString()
    assert "abstract#" not in plan and "title#" not in plan and re.search(r"PushedFilters: \[[^\]]*In\(gram, \[arn,ear,lea\]\)", plan)


def test_positions_and_lengths(spark):
    p = spark.createDataFrame([("1", "ab-ab  AB", "", None), ("2", "", "xy", "aaaa")], "id string, title string, authors_text string, abstract string")
    index = search.gram_index(p)
    got = {(r["field"], r["id"], r["gram"]): r["positions"] for r in index.postings.collect()}
    assert got[("title", "1", "ab ")] == [1, 4] and got[("abstract", "2", "aaa")] == [1, 2] and not any(f == "authors_text" for f, _, _ in got)
    assert {r["id"]: r["size"] for r in index.lengths.collect()} == {"1": 6, "2": 2}
    assert search.gram_index(p.limit(0)).postings.collect() == []

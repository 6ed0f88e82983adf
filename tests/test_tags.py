"""Tags of listings by look-ups of beginnings, and trees of pages that are taken apart."""

import gc

from quillspark.sources import html, pages

ENTRY = "conf string, paper_name string, paper_authors array<string>, paper_url string, paper_abstract string, page string, page_no long, pos int"


def entries(spark, rows):
    return spark.createDataFrame([(c, n, [], u, "", "p", 0, i) for i, (c, n, u) in enumerate(rows)], ENTRY)


def kept(spark, rows, tags):
    return {r["paper_name"] for r in pages.listing_records(entries(spark, rows), spark.createDataFrame(tags, "conf string, tag string")).collect()}


def test_tags_by_beginning(spark):
    rows = [("A1", "both tags", "https://e.org/ab.1"), ("A1", "short tag", "https://e.org/AX"), ("A1", "no tag", "https://e.org/b"), ("A1", "no address", ""),
            ("B1", "no tags in the conf", ""), ("C1", "empty tag", "https://e.org/zz"), ("C1", "empty tag and address", ""), ("D1", "null tag only", "https://e.org/q")]
    tags = [("A1", "a"), ("A1", "AB"), ("A1", None), ("C1", ""), ("C1", "x"), ("D1", None)]
    assert kept(spark, rows, tags) == {"both tags", "short tag", "no tags in the conf", "empty tag", "empty tag and address"}


def test_tags_are_not_gathered(spark):
    """No array of a conf's tags is built, whose every element each entry would be held against."""
    df = pages.listing_records(entries(spark, [("A1", "x", "https://e.org/ab")]), spark.createDataFrame([("A1", "a")], "conf string, tag string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" not in plan and "StartsWith" not in plan and df.count() == 1


def test_trees_go_at_once():
    gc.collect()
    gc.disable()
    try:
        for _ in range(20):
            with html.tree("<ul>" + "<li><a href='/x'>entry</a></li>" * 50 + "</ul>") as root:
                assert len(html.select(root, "ul > li > a")) == 50
            del root
        assert sum(isinstance(x, html.Element) for x in gc.get_objects()) == 0
    finally:
        gc.enable()


def test_pages_come_back_in_pieces(spark):
    n = 3 * pages.ROWS_A_TIME + 1
    page = spark.range(n).selectExpr("concat('https://e.org/', id) as url", "concat('<li>Entry ', id, ', by A</li><li>B ', id, ', C</li>') as html", "'ACL2020' as conf").coalesce(1)
    rules = spark.createDataFrame([("e.org", "li", ",", ["li"])], "host string, entry string, separator string, selectors array<string>")
    out = pages.extract_listing(page, rules)
    assert (out.count(), out.select("page", "pos").distinct().count()) == (2 * n, 2 * n)
    assert pages.extract_pages(page, rules).select("url").distinct().count() == n

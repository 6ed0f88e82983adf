"""Titles with signs that have no single capital in full upper case, and references that SQL does not read."""

import pytest

from quillspark.plans import common, registry
from pyspark.sql import functions as F

duckdb = pytest.importorskip("duckdb")


def both(spark, tmp_path, name, rows, table="documents", schema="doc_id long, text string"):
    """Sorted rows of a query and of its SQL."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    out = registry.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.sql(registry.ORACLES[name])
    at = [want.columns.index(c) for c in out.columns]
    return sorted(map(str, (tuple(r) for r in out.collect()))), sorted(map(str, (tuple(r[i] for i in at) for r in want.fetchall())))


def test_capitals_sign_by_sign(spark):
    texts = ["straße", "ﬁn ŉ", "ΐᾳ", "İßi", "plain ä", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(common.capitals(F.col("t")).alias("u")).collect()
    assert [r["u"] for r in rows] == ["STRAẞE", "ﬁN ŉ", "ΐᾼ", "İẞI", "PLAIN Ä", "", None]


@pytest.mark.parametrize("name", ["d4_official_rows", "d4_official_rows_folded"])
def test_official_titles_in_capitals(spark, tmp_path, name):
    """ß merges with its capital; titles that differ by accents are one for a-z alone and two for folded letters."""
    titles = ["weiß maß und strauß", "Straße", "Cionñ", "Ciónn", "Einß Einß", "Einü Einü"]
    got, want = both(spark, tmp_path, name, [(3 * i, f"{t}. Rest.") for i, t in enumerate(titles)])
    assert got == want


def test_id_table_in_capitals(spark, tmp_path):
    got, want = both(spark, tmp_path, "m12_fill_from_id_table", [(6, "Die einöge öer erß chß. Rest."), (12, "Another title that is long enough. x")])
    assert got == want and any("text of the table" in g and ", 6'" in g for g in got)


@pytest.mark.parametrize("name", ["i7_page_titles", "i7_page_titles_whole"])
def test_references_in_titles(spark, tmp_path, name):
    heads = ["A title of some length that names token = &quot;0123456789", "x &lt;b&gt; &amp;quot; &amp " + "y" * 50, "short &quot;", "&ampere " + "z" * 60]
    rows = [(i, f"https://e.org/{i}", f"<html><head><title>{h}</title></head></html>") for i, h in enumerate(heads[: 3 if name.endswith("whole") else 4])]
    got, want = both(spark, tmp_path, name, rows, "pages", "page_id long, url string, html string")
    assert got == want

"""Page rules of more hosts than are broadcast."""

from quillspark.sources import pages

HOSTS = 10_050


def tables(spark, rule):
    one = spark.range(HOSTS).selectExpr("concat('h', id, '.org') as host")
    page = one.selectExpr("concat('https://', host, '/p') as url", "concat('<li>Entry of ', host, ' with text that is long enough to count as one abstract, by A</li>') as html", "'ACL2020' as conf")
    return page, one.selectExpr("host", *rule)


def test_listing_entries_of_all_hosts(spark):
    out = pages.extract_listing(*tables(spark, ["'li' as entry", "', by' as separator"]))
    assert out.select("page").distinct().count() == HOSTS


def test_pages_of_all_hosts(spark):
    out = pages.extract_pages(*tables(spark, ["array('li') as selectors"]))
    assert out.filter("ok").count() == HOSTS

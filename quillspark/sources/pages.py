"""Extraction from stored web pages: rules are chosen by host, pages parsed in Arrow batches on the executors."""

from __future__ import annotations

import re
from collections.abc import Iterator
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import predicates as P
from ..operators.merge import FIELDS, merged
from . import html

MIN_CHARS = 60
MOST_BROADCAST = 10_000  # rules
ROWS_A_TIME = 256  # handed back by a task that parses pages


def dimension(rules: DataFrame) -> DataFrame:
    """All rules; marked for broadcast where they are counted to be few, else joined as Spark chooses."""
    few = rules.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return F.broadcast(rules) if few else rules


def optional(df: DataFrame, name: str, kind: str) -> Column:
    """The column of a table of rules, null where it has none."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def extract_pages(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, host, abstract, ok, reason) per page. rules: host, selectors (array, in order; sources/html.py has their
    forms); host '*' is for pages without a rule of their own. The first text of MIN_CHARS or more counts, or with
    `longest` the longest of all. A label Abstract (with `every_label` all of them) is taken off as an element; a word
    that only begins so stays. Reasons: venue_index, no_rule, empty_abstract (a layout matched, its text was short),
    no_abstract_available."""
    host = C.canonical_host(F.col("url"))
    options = [optional(rules, "longest", "boolean").alias("longest"), optional(rules, "every_label", "boolean").alias("every_label")]
    rules = rules.select("host", F.struct("selectors", *options).alias("rule"))
    own = rules.filter("host <> '*'").select(F.col("host").alias("h"), F.col("rule").alias("own"))
    spare = rules.filter("host = '*'").limit(1).select(F.col("rule").alias("spare"))
    j = pages.select("url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"), C.classify_url(F.col("url")).alias("kind"))
    j = j.join(dimension(own), F.col("host") == F.col("h"), "left").join(F.broadcast(spare), F.lit(True), "left")  # one row at most
    rule = F.coalesce("own", "spare")
    j = j.select("url", "html", "host", "kind", rule["selectors"].alias("selectors"), *(F.coalesce(rule[c], F.lit(False)).alias(c) for c in ("longest", "every_label")))

    def outcome(r) -> tuple[str | None, str]:
        if r.kind == "venue-index":
            return None, "venue_index"
        if r.selectors is None or not len(r.selectors):
            return None, "no_rule"
        with html.tree(r.html) as root:
            texts = [t for s in r.selectors for t in html.passages(root, s, r.every_label)]
        good = [t for t in texts if len(t) >= MIN_CHARS]
        best = max(good, key=len) if good and r.longest else next(iter(good), None)
        return (best, "") if best else (None, "empty_abstract" if texts else "no_abstract_available")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS_A_TIME):
                some = batch.iloc[at : at + ROWS_A_TIME]
                out = [outcome(r) for r in some.itertuples()]
                yield pd.DataFrame({"url": some["url"], "host": some["host"], "abstract": [a for a, _ in out], "reason": [r for _, r in out]})

    got = j.mapInPandas(parse, "url string, host string, abstract string, reason string")
    return got.select("url", "host", "abstract", F.col("abstract").isNotNull().alias("ok"), F.nullif("reason", F.lit("")).alias("reason"))


def outcome_by_host(extracted: DataFrame) -> DataFrame:
    return extracted.groupBy("host", "ok", "reason").agg(F.count("*").alias("n"))


ENTRY = ("entry", "title", "link", "authors", "abstract", "separator")


def entry_parts(root: html.Element, entry: html.Element, rule: dict) -> tuple[str, list[str], str, str]:
    """(title, authors, address, abstract) of an entry; a rule without `title` has them in one text, parted by `separator`."""
    link = next(iter(html.values(entry, rule["link"] or "a[href] @href")), "")
    if not link and not rule["link"]:
        link = entry.attrs.get("href", "")
    if rule["title"]:
        title = next((t for t in html.values(entry, rule["title"]) if t), "")
        authors = html.values(entry, rule["authors"]) if rule["authors"] else []
    else:
        title, _, names = entry.text().partition(rule["separator"] or "\0")
        title = re.sub(r"^(?:\d+\.|\[\d+\])\s+", "", title)  # the number of the entry
        authors = names.split(",")
    title = re.sub(r"\s*\.$", "", title.strip())
    authors = [a for a in (re.sub(r"\s+", " ", re.sub(r"\d", "", a)).strip(" |") for a in authors) if a]
    abstract = ""
    if rule["abstract"]:
        selector = rule["abstract"].replace("{key}", link.strip("/").replace(".", "--"))
        abstract = next(iter(html.passages(root, selector)), "")
    return title, authors, link, abstract


def extract_listing(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """papers_raw rows (conf, paper_name, paper_authors, paper_url, paper_abstract, page, page_no, pos) of stored
    listing pages(url, html, conf, and seq: their order, else that of the table).

    rules: host, entry (a selector; each element holds one paper), and selectors inside an entry: title, link (with
    @href), authors (one element or attribute each), abstract (in the whole page, {key} stands for the link with -- for
    periods). A rule without title and authors takes them from the entry's text, parted by `separator`. Urls are made
    absolute; a closing period goes from titles, digits go from names. Entries without title or with the address of a
    volume are left out.
    """
    kept = rules.select("host", F.struct(*(optional(rules, c, "string").alias(c) for c in ENTRY)).alias("rule"))
    number = F.col("seq").cast("long") if "seq" in pages.columns else F.monotonically_increasing_id()
    j = pages.select("url", "conf", F.coalesce("html", F.lit("")).alias("html"), number.alias("page_no"), C.canonical_host(F.col("url")).alias("host"))
    j = j.join(dimension(kept), "host").select("url", "conf", "html", "page_no", "rule.*")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import urljoin

        columns = ["conf", "paper_name", "paper_authors", "paper_url", "paper_abstract", "page", "page_no", "pos"]
        rows: list[tuple] = []
        for batch in batches:
            for r in batch.itertuples():
                rule = {c: getattr(r, c) or "" for c in ENTRY}
                with html.tree(r.html) as root:
                    for pos, x in enumerate(html.select(root, rule["entry"])):
                        title, authors, link, abstract = entry_parts(root, x, rule)
                        rows.append((r.conf, title, authors, urljoin(r.url, link) if link else "", abstract, r.url, r.page_no, pos))
                        if len(rows) == ROWS_A_TIME:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
        yield pd.DataFrame(rows, columns=columns)

    schema = "conf string, paper_name string, paper_authors array<string>, paper_url string, paper_abstract string, page string, page_no long, pos int"
    return j.mapInPandas(parse, schema).filter((F.col("paper_name") != "") & (C.classify_url(F.col("paper_url")) != "venue-index"))


def has_tag(entries: DataFrame, tags: DataFrame, last: Column) -> DataFrame:
    """entries(conf, page_no, pos) without those of a conf with tags that none of its tags begins in `last` (lower case).

    Beginnings of the lengths that a conf's tags have are looked up among its tags, so the work follows entries and tags and
    not their product. Entries are read twice."""
    tags = tags.select("conf", F.lower("tag").alias("tag")).distinct()
    sizes = tags.groupBy("conf").agg(F.collect_set(F.length("tag")).alias("sizes"))  # no more than the longest tag has signs
    e = entries.withColumn("last", last).join(dimension(sizes), "conf", "left")
    settled = F.col("sizes").isNull() | F.array_contains("sizes", 0)
    begins = F.transform(F.filter("sizes", lambda n: n <= F.length("last")), lambda n: F.left(F.col("last"), n))
    asked = e.filter(~settled).select("conf", "last", "sizes").distinct().select("conf", "last", F.explode(begins).alias("tag"))
    known = asked.join(tags, ["conf", "tag"], "left_semi").select("conf", "last").distinct().withColumn("known", F.lit(True))
    # entries that need no look-up (or have nothing to look up) don't meet under one key
    own = F.when(settled | (F.col("last") == ""), F.concat_ws("|", F.lit("/row"), F.col("page_no").cast("string"), F.col("pos").cast("string"))).otherwise(F.col("last"))
    e = e.withColumn("settled", settled).withColumn("last", own).join(known, ["conf", "last"], "left")
    return e.filter("settled or known").drop("sizes", "settled", "last", "known")


def listing_records(entries: DataFrame, tags: DataFrame | None = None, details: DataFrame | None = None) -> DataFrame:
    """I13, the rest of it: papers_raw rows of extract_listing()'s entries, with seq, the first place in the listings, as a
    struct (page_no, pos).

    tags(conf, tag): of a conf with tags only entries stay whose address ends in an id that one of its tags begins.
    details(url, doi, code, abstract): what an entry's own page says, which overrides its address (by the DOI), code and
    abstract. With tags the entries are read twice, so they should be stored. Entries of one conf and address are merged field by field, volumes and front matter dropped.
    """
    url = C.normalise_url(F.col("paper_url"))
    row = F.concat_ws("|", F.lit("row"), F.col("page_no").cast("string"), F.col("pos").cast("string"))
    e = entries.withColumn("u", url).withColumn("paper_abstract", F.coalesce(optional(entries, "paper_abstract", "string"), F.lit(""))).withColumn("paper_code", F.lit("#"))
    if tags is not None:
        e = has_tag(e, tags, F.lower(F.regexp_extract("u", "([^/]+)$", 1)))
    if details is not None:
        d = details.select(C.normalise_url(F.col("url")).alias("u"), "doi", "code", "abstract").filter("u <> ''")
        d = d.groupBy("u").agg(*(F.max(F.nullif(F.trim(c), F.lit(""))).alias(c) for c in ("doi", "code", "abstract")))
        e = e.withColumn("u", F.coalesce(F.nullif("u", F.lit("")), row))  # entries without address don't meet under one key
        e = e.join(d, "u", "left").withColumn("paper_url", F.coalesce(F.concat(F.lit("https://doi.org/"), "doi"), "paper_url"))
        e = e.withColumn("paper_abstract", F.coalesce("abstract", "paper_abstract")).withColumn("paper_code", F.coalesce("code", "paper_code"))
    key = F.coalesce(F.nullif(C.normalise_url(F.col("paper_url")), F.lit("")), row)
    out = e.withColumn("k", key).groupBy("conf", "k").agg(*merged("page_no", "pos"))
    return P.drop_on_collect(out.select("conf", *FIELDS, "seq"))

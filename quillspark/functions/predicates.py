"""Filters and search predicates as boolean columns over papers(id, conf, year, title, url, authors, abstract, code)."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import columns as C

# Fixed values
FRONT_MATTER = r"(?i)^(proceedings\b|front matter|frontmatter|table of contents|preface\b|findings of the association)"
PROCEEDINGS = (
    r"(?i)(?:^(?:(?:adjunct|joint|workshops)\s+)?proceedings\b|^workshop proceedings\s+of\b|[,:]\s*proceedings\b"
    r"|\bproceedings\s*(?:,\s*part\b|$)|\bconference proceedings\s*,|\bworkshop proceedings\s*\()"
)
ACM_PROCEEDINGS = (
    r"(?i)(?:^(?:(?:adjunct|joint|workshops)\s+)?proceedings\b|^workshop proceedings\s+of\b|[,:]\s*proceedings\b"
    r"|\bconference proceedings\s*,|\bworkshop proceedings\s*\(|^ACM\b[^,]*\bconference proceedings$)"
)
IEEE_TITLE = r"(?i)\bIEEE(?:/CVF)?\b.*\bconference\b.*\b(?:19|20)[0-9]{2}\b"
ACL_NONPAPER = (
    r"(?i)(?:\bauthor index\b|\btutorial abstracts\b|\bcompanion volume\b|^student research workshop$"
    r"|\bdemonstration papers\b|\bcoling [0-9]{4}: (?:posters|demonstrations)\b|\bproceedings of the student research workshop\b)"
)
ACL_CONFERENCE = r"(?i)(?:\bconference\b|\bannual meeting\b|\bmeeting\b|\bcoling\b|\bhuman language technologies\b)"
EDITOR = r"(?i)\(\s*eds?\.?\s*\)|\beditors?\b"
REJECTED_VENUES = ["submitted", "reject", "withdrawn", "desk rejected"]
ACCEPTED_VENUES = ["oral", "spotlight", "poster", "accept", "top", "blogpost"]


def any_true(parts: Iterable[Column]) -> Column:
    return reduce(operator.or_, parts, F.lit(False))


def all_true(parts: Iterable[Column]) -> Column:
    return reduce(operator.and_, parts, F.lit(True))


# Whole volumes and front matter, over papers_raw
def is_proceedings() -> Column:
    """A whole volume: the title has its shape and the address confirms it."""
    title, url = F.trim(C.text("paper_name")), C.text("paper_url")
    host, path = C.canonical_host(url), F.regexp_replace(C.path_of(url), "^/+|/+$", "")
    ieee, acm, doi = title.rlike(IEEE_TITLE), title.rlike(ACM_PROCEEDINGS), host == "doi.org"
    acl = title.rlike(ACL_NONPAPER) | title.rlike(ACL_CONFERENCE)
    volume_id = F.regexp_extract(path, r"-([0-9]+)$", 1).try_cast("long") % 100 == 0
    citation = (path == "citation.cfm") & C.query_of(url).rlike(r"(^|&)id=[0-9]+(&|$)")
    evidence = (
        ((host == "aclanthology.org") & acl & (title.rlike(ACL_NONPAPER) | (F.coalesce(volume_id, F.lit(False)) & title.rlike(ACL_CONFERENCE))))
        | (doi & path.rlike(r"(?i)^10\.1007/978-[^_]+$"))
        | (ieee & doi & path.rlike(r"(?i)^10\.1109/[A-Za-z0-9]+\.(?:19|20)[0-9]{2}$"))
        | (acm & doi & path.rlike(r"^10\.1145/[0-9]+$"))
        | (acm & host.endswith("acm.org") & (path.rlike(r"(?i)^(?:doi/)?10\.1145/[0-9]+$") | citation))
        | (C.classify_url(url) == "venue-index")
    )
    return (title.rlike(PROCEEDINGS) | ieee | acl) & evidence


def has_code(code: Column) -> Column:
    return ~F.trim(C.text(code)).isin("", "#")


def is_frontmatter() -> Column:
    """Cleaning variant: a volume, or a front-matter title on an index page or without abstract and code."""
    bare = (F.trim(C.text("paper_abstract")) == "") & ~has_code(F.col("paper_code"))
    title = F.trim(C.text("paper_name")).rlike(FRONT_MATTER)
    return is_proceedings() | (title & ((C.classify_url(F.col("paper_url")) == "venue-index") | bare))


def dropped_on_collect() -> Column:
    """Collection variant: a volume, or a front-matter title on an index page or with no author but editors."""
    authors = F.coalesce("paper_authors", F.array().cast("array<string>"))
    edited = F.forall(authors, lambda a: C.text(a).rlike(EDITOR))
    title = F.trim(C.text("paper_name")).rlike(FRONT_MATTER)
    return is_proceedings() | (title & ((C.classify_url(F.col("paper_url")) == "venue-index") | edited))


def drop_on_collect(raw: DataFrame) -> DataFrame:
    return raw.filter(~dropped_on_collect())


def drop_frontmatter(raw: DataFrame, confs: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, removed, removed per conf), looking at the given confs only, or at all."""
    out = is_frontmatter() & (F.col("conf").isin(confs) if confs else F.lit(True))
    out = F.coalesce(out, F.lit(False))
    removed = raw.filter(out)
    return raw.filter(~out), removed, removed.groupBy("conf").agg(F.count("*").alias("removed"))


# F4
def accepted_venue(venue: Column) -> Column:
    low = F.lower(C.text(venue))
    return any_true(low.contains(w) for w in ACCEPTED_VENUES) & ~any_true(low.contains(w) for w in REJECTED_VENUES)


# F5
def conf_matches(conf: Column, pattern: str) -> Column:
    """Exact unless the pattern has *; a comma list of globs ignores case."""
    glob = lambda p: "^" + ".*".join(re.escape(x) for x in p.split("*")) + "$"
    if "," in pattern:
        return any_true(conf.rlike("(?i)" + glob(p.strip())) for p in pattern.split(",") if p.strip())
    return conf.rlike(glob(pattern)) if "*" in pattern else conf == pattern


# F6
def in_phase(phase: str, conf: Column, url: Column) -> Column:
    doi, core = C.netloc(url).rlike(r"(^|\.)doi\.org$"), F.regexp_replace(conf, "[0-9]{4}$", "").isin(C.CORE_CONFS)
    return {"1": doi, "2": ~doi & core, "3": ~doi & ~core, "all": F.lit(True)}[phase]


# F7
def missing(what: str, prefix: str = "paper_") -> Column:
    value = F.trim(C.text(f"{prefix}{what}"))
    return ~has_code(value) if what == "code" else value == ""


# P1-P5
def term(field: str, value: str) -> Column:
    """Case-insensitive substring of a field; year by equality; an empty value is true."""
    v = value.strip().lower()
    if not v:
        return F.lit(True)
    low = lambda c: F.lower(C.text(c))
    if field == "year":
        return F.coalesce(F.col("year").cast("string") == v, F.lit(False))
    if field == "author":
        return F.coalesce(F.exists("authors", lambda a: F.lower(a).contains(v)), F.lit(False))
    if field == "keywords":
        return low("title").contains(v) | low("abstract").contains(v)
    if field in ("title", "abstract", "conf"):
        return low(field).contains(v)
    return low(F.concat_ws(" ", "title", "abstract", "authors_text", "conf")).contains(v)


def any_of(field: str, values: list[str]) -> Column:
    return any_true(term(field, v) for v in values)


def year_range(first: object, last: object) -> Column:
    """Inclusive, bounds swapped if reversed; a bound that is no number makes it false."""
    try:
        low, high = sorted((int(str(first)), int(str(last))))
    except ValueError:
        return F.lit(False)
    return F.coalesce(F.col("year").between(low, high), F.lit(False))


def near(field: str, a: str, b: str, n: int = 15) -> Column:
    """Both single words stand with at most n words between them in the field (any: title and abstract joined)."""
    joined = F.concat_ws(" ", "title", "abstract") if field not in ("title", "abstract") else C.text(field)
    words = F.filter(F.split(F.lower(joined), "[^a-z0-9]+"), lambda w: w != "")
    a, b = a.lower(), b.lower()
    if not (re.fullmatch("[a-z0-9]+", a) and re.fullmatch("[a-z0-9]+", b)):
        return term(field, a) & term(field, b)
    # the nearest pair of the two words are neighbours among their places
    at = F.filter(F.transform(words, lambda x, i: F.when(x.isin(a, b), F.struct(i.alias("i"), x.alias("w")))), lambda p: p.isNotNull())
    pairs = lambda p: F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    other = lambda q: F.lit(True) if a == b else q["x"]["w"] != q["y"]["w"]
    close = lambda q: F.coalesce(other(q) & (q["y"]["i"] - q["x"]["i"] - 1 <= n), F.lit(False))
    return F.exists(F.transform(F.array(at), lambda p: F.exists(pairs(p), close)), lambda found: found)


def negate(p: Column) -> Column:
    return ~F.coalesce(p, F.lit(False))


# P6
def rows_predicate(rows: list[dict]) -> Column:
    """Condition rows {op, field, value}: AND before OR, NOT is AND NOT, the first op is ignored. Year bounds
    (fields since, until) and authors hold for every OR leg."""
    legs: list[list[Column]] = [[]]
    every: list[Column] = []
    for k, row in enumerate(rows):
        op, field, value = row.get("op", "AND").upper(), row["field"], str(row["value"])
        if field == "since":
            p = year_range(value, 9999)
        elif field == "until":
            p = year_range(0, value)
        else:
            p = term(field, value)
        p = negate(p) if op == "NOT" else p
        if field in ("since", "until", "author") and op != "NOT":
            every.append(p)
            continue
        if k and op == "OR":
            legs.append([])
        legs[-1].append(p)
    return any_true(all_true(leg) for leg in legs if leg or len(legs) == 1) & all_true(every)


# P7, P8
def refine(
    df: DataFrame, keyword: str = "", with_abstract: bool = False, with_code: bool = False, years: tuple | None = None, fields: list[str] | None = None
) -> DataFrame:
    """Rows that hold the keyword, have an abstract or code, lie within the years and belong to one of the fields."""
    if keyword.strip():
        df = df.filter(F.lower(F.concat_ws(" ", "title", "authors_text", "abstract", "conf")).contains(keyword.strip().lower()))
    if with_abstract:
        df = df.filter(F.trim(C.text("abstract")) != "")
    if with_code:
        df = df.filter(has_code(F.col("code")))
    if fields:
        from ..operators.stats import field_of

        df = field_of(df).filter(F.col("field").isin(fields)).select(*df.columns)
    return df.filter(year_range(*years)) if years else df


def search_filter(confs: list[str] | None = None, since: int | None = None, until: int | None = None, author: str = "") -> Column:
    parts = []
    if confs:
        parts.append(F.col("conf").isin([c.strip().upper() for c in confs]))
    if since is not None:
        parts.append(F.col("year") >= since)
    if until is not None:
        parts.append(F.col("year") <= until)
    if words := C.tokens(author):
        names = C.normalise_text(F.col("authors_text"))
        parts.append(any_true(names.contains(w) for w in words))
    return all_true(parts)


# P9
def match_saved_queries(papers: DataFrame, query_rows: DataFrame, sample: int = 2000, few: int = 64) -> DataFrame:
    """(query_id, hits): stored condition rows (query_id, leg, field, negate, value) counted over all papers at once.

    A paper hits a query if it meets every row of one of its legs. Legs are indexed: each is kept under one trigram of one
    of its words, the one that the fewest of `sample` papers have (which papers these are decides only how many tests are
    made). A paper is tested on the legs that its own trigrams name, and on those without any word of three signs; each
    leg is then checked in full where the paper lies. Up to `few` conditions are all tried, as that is less than to cut a
    paper into trigrams. There are at most MAX_CONDITIONS rows, so the legs may be broadcast.
    """
    legs = indexed_legs(papers, query_rows, sample, few)
    met = lambda conditions: F.forall(conditions, condition_met)
    named = candidate_legs(papers, legs).filter(met("all")).select("query_id", "id")
    rest = F.broadcast(legs.filter("gram is null").agg(F.collect_list(F.struct("query_id", "all")).alias("rest")))  # one row
    others = saved_texts(papers).crossJoin(rest).select(F.explode(F.filter("rest", lambda q: met(q["all"]))["query_id"]).alias("query_id"), "id")
    hits = named.unionByName(others)
    counts = hits.groupBy("query_id", "id").agg(F.lit(1)).groupBy("query_id").agg(F.count("*").alias("hits"))
    return query_rows.select("query_id").distinct().join(counts, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"))


def saved_texts(papers: DataFrame) -> DataFrame:
    """id, year, texts (field -> lower-cased text) and whole (all four fields) of papers."""
    fields = [F.lower(C.text(c)) for c in ("title", "abstract", "conf", "authors_text")]
    texts = F.map_from_arrays(F.array(*map(F.lit, SAVED_FIELDS)), F.array(*fields))
    return papers.select("id", F.col("year").cast("string").alias("year"), texts.alias("texts"), F.lower(F.concat_ws(" ", "title", "abstract", "authors_text", "conf")).alias("whole"))


def condition_met(c: Column) -> Column:
    own = F.when(c["field"] == "year", F.col("year") == c["value"]).otherwise(F.coalesce(F.try_element_at("texts", c["field"]), F.col("whole")).contains(c["value"]))
    return F.coalesce(own, F.lit(False)) != c["negate"]


def text_grams(c: Column) -> Column:
    """Trigrams of a text in their order, repeats included: its signs beside themselves moved by one and by two, which
    takes time in proportion to the text (a substring would count from the text's begin each time)."""
    signs, n = F.split(c, ""), F.greatest(F.length(c) - 2, F.lit(0))
    moved = lambda by: F.slice(signs, by + 1, n)
    joined = lambda x, y: F.concat(x, y)
    return F.zip_with(F.zip_with(moved(0), moved(1), joined), moved(2), joined)


def indexed_legs(papers: DataFrame, query_rows: DataFrame, sample: int, few: int = 0) -> DataFrame:
    """query_id, leg, all (its conditions), gram (null: none of its conditions asks for three signs, or there are no more
    than `few` conditions)."""
    if (n := query_rows.limit(MAX_CONDITIONS + 1).count()) > MAX_CONDITIONS:
        raise ValueError(f"over {n - 1} condition rows; split them into calls of {MAX_CONDITIONS}")
    condition = F.struct("field", F.coalesce("negate", F.lit(False)).alias("negate"), F.lower(F.col("value")).alias("value"))
    legs = query_rows.groupBy("query_id", "leg").agg(F.collect_list(condition).alias("all"))
    if n <= few:
        return legs.withColumn("gram", F.lit(None).cast("string"))
    asked = F.filter("all", lambda c: ~c["negate"] & (F.coalesce(c["field"], F.lit("")) != "year") & (F.length(c["value"]) >= 3))
    grams = F.array_distinct(F.flatten(F.transform(asked, lambda c: text_grams(c["value"]))))
    each = legs.select("query_id", "leg", F.explode(grams).alias("gram"))
    seen = saved_texts(papers.limit(sample)).select(F.explode(F.array_distinct(text_grams(F.col("whole")))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    rare = each.join(seen, "gram", "left").groupBy("query_id", "leg").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return legs.join(rare, ["query_id", "leg"], "left")


def candidate_legs(papers: DataFrame, legs: DataFrame) -> DataFrame:
    """The texts of each paper with each leg that its trigrams name. A field's trigrams are trigrams of the whole text,
    as that joins the fields."""
    rows = saved_texts(papers)
    some = legs.filter("gram is not null").select("gram", "query_id", "all")  # at most MAX_CONDITIONS legs
    known = F.broadcast(some.agg(F.collect_set("gram").alias("known")))  # one row
    own = rows.crossJoin(known).withColumn("gram", F.explode(F.array_intersect(text_grams(F.col("whole")), "known"))).drop("known")
    return own.join(F.broadcast(some), "gram").drop("gram")


SAVED_FIELDS = ["title", "abstract", "conf", "author"]  # others are looked for in all four together
MAX_CONDITIONS = 10_000

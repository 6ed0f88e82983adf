"""Work lists: which papers to try next, as joins against the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import predicates as P
from .search import places_by_range
from .stats import venue_tier

MAX_ATTEMPTS = 3


def empty_abstract() -> Column:
    return F.trim(C.text("abstract")) == ""


def route(url: Column, title: Column) -> Column:
    """C20: which evidence applies to a row, in order."""
    host = C.canonical_host(url)
    return (
        F.when(C.classify_url(url) == "venue-index", "venue_index")
        .when(host.isin("openreview.net", "openaccess.thecvf.com"), "delegated")
        .when(host.isin("aclanthology.org", "ijcai.org", "ojs.aaai.org", "jmlr.org", "proceedings.mlr.press", "usenix.org", "ndss-symposium.org", "link.springer.com"), "registered_host")
        .when(C.doi_of(url).isNotNull(), "doi")
        .when(F.lower(C.path_of(url)).endswith(".pdf"), "pdf")
        .when(F.trim(C.text(title)) != "", "title_only")
        .otherwise("nothing")
    )


def pending(papers: DataFrame, state: DataFrame, mode: str = "default", reasons: list[str] | None = None, legacy: bool = True) -> DataFrame:
    """W1. default: not in the ledger; force: not a success; partial: no success or still without abstract; failed:
    fewer than MAX_ATTEMPTS, optionally of some reasons, rows without a reason (legacy) in or out."""
    j = papers.join(state.select("url", "status", "attempts", "reason"), "url", "left")
    success, failed = F.col("status").eqNullSafe("success"), F.col("status").eqNullSafe("failed")
    if mode == "default":
        keep = F.col("status").isNull()
    elif mode == "force":
        keep = ~success
    elif mode == "partial":
        keep = ~success | empty_abstract()
    else:
        keep = failed & (F.coalesce("attempts", F.lit(0)) < MAX_ATTEMPTS)
        old = F.trim(C.text("reason")) == ""
        keep &= F.when(old, F.lit(legacy)).otherwise(F.col("reason").isin(reasons) if reasons else F.lit(True))
    return j.filter(keep).select(*papers.columns)


def batch_skip(papers: DataFrame, state: DataFrame) -> DataFrame:
    """Papers but for those that succeeded and have an abstract, or failed MAX_ATTEMPTS times."""
    j = papers.join(state.select("url", "status", "attempts"), "url", "left")
    done = F.col("status").eqNullSafe("success") & ~empty_abstract()
    worn = F.col("status").eqNullSafe("failed") & (F.coalesce("attempts", F.lit(0)) >= MAX_ATTEMPTS)
    return j.filter(~(done | worn)).select(*papers.columns)


def failed_rows(papers: DataFrame, state: DataFrame) -> DataFrame:
    return papers.filter(empty_abstract()).join(state.filter("status = 'failed'").select("url"), "url", "left_semi")


def doi_targets(papers: DataFrame, state: DataFrame) -> DataFrame:
    """Failed papers without abstract that have a DOI, the first of each (lower-case) DOI."""
    rows = failed_rows(papers, state).withColumn("doi", F.lower(C.doi_of(F.col("url")))).filter("doi is not null")
    return rows.groupBy("doi").agg(F.min_by(F.struct("id", "url", "title", "seq"), "seq").alias("r")).select("doi", "r.*")


def title_targets(papers: DataFrame, state: DataFrame, excluded_hosts: list[str]) -> DataFrame:
    """Failed papers without abstract or DOI that have a title, off the excluded hosts."""
    rows = failed_rows(papers, state).filter(C.doi_of(F.col("url")).isNull() & (F.trim(C.text("title")) != ""))
    return rows.filter(~C.canonical_host(F.col("url")).isin(excluded_hosts))


def api_key(conf: Column, url: Column, title: Column) -> Column:
    """sha1 of conf, url, and the title where there is no url."""
    own = F.when(C.text(url) == "", C.text(title)).otherwise("")
    return F.sha1(F.concat_ws("\0", C.text(conf), C.text(url), own))


def api_targets(papers: DataFrame, api_state: DataFrame, conf_glob: str | None = None, year: int | None = None, retry: bool = False) -> DataFrame:
    """Papers that lack abstract or code, those without abstract first; terminal or worn-out ones only on retry."""
    raw = papers.withColumnsRenamed({"title": "paper_name", "url": "paper_url", "abstract": "paper_abstract", "code": "paper_code", "authors": "paper_authors"})
    lacks = P.missing("abstract") | P.missing("code")
    rows = raw.filter(lacks & (F.trim(C.text("paper_name")) != "") & (C.classify_url(F.col("paper_url")) != "venue-index") & ~F.coalesce(P.is_frontmatter(), F.lit(False)))
    if conf_glob:
        rows = rows.filter(P.conf_matches(F.col("conf"), conf_glob))
    if year is not None:
        rows = rows.filter(F.col("year") == year)
    rows = rows.withColumn("key", api_key(F.col("conf"), F.col("paper_url"), F.col("paper_name")))
    if not retry:
        closed = api_state.filter(F.coalesce("terminal", F.lit(False)) | (F.coalesce("attempts", F.lit(0)) >= MAX_ATTEMPTS))
        rows = rows.join(closed.select("key"), "key", "left_anti")
    return rows.select("id", "key", P.missing("abstract").alias("no_abstract"), P.missing("code").alias("no_code"), "seq").orderBy(F.desc("no_abstract"), "seq")


def host_targets(papers: DataFrame, tried: DataFrame, host: str, official: DataFrame | None = None) -> DataFrame:
    """A host's queue of papers without abstract: rows on the host, and rows whose title is that of exactly one
    official(title, url) row; what was tried (url) is left out."""
    empty = papers.filter(empty_abstract()).withColumn("t", C.plain_title_key(F.col("title")))
    own = empty.filter(C.canonical_host(F.col("url")) == host).select("id", F.col("url").alias("fetch_url"))
    if official is not None:
        one = official.groupBy(C.plain_title_key(F.col("title")).alias("t")).agg(F.count("*").alias("n"), F.min("url").alias("fetch_url")).filter("n = 1")
        own = own.unionByName(empty.filter(C.canonical_host(F.col("url")) != host).join(one, "t").select("id", "fetch_url"))
    return own.join(tried.select(F.col("url").alias("fetch_url")).distinct(), "fetch_url", "left_anti")


def rank_confs(papers: DataFrame) -> DataFrame:
    """Confs with empty abstracts by tier, share of DOI rows among the empty, and number of empty ones."""
    doi = C.doi_of(F.col("url")).isNotNull()
    by = papers.groupBy("conf").agg(
        F.count("*").alias("total"), F.count_if(~empty_abstract()).alias("has"), F.count_if(empty_abstract()).alias("empty"),
        F.count_if(empty_abstract() & doi).alias("doi_empty"),
    ).filter(F.col("empty") > 0)
    by = by.withColumn("tier", venue_tier(F.col("conf")))
    order = Window.orderBy("tier", F.desc(F.col("doi_empty") / F.col("empty")), F.desc("empty"), "conf")  # one row per conf
    return by.withColumn("rank", F.row_number().over(order))


def budget(targets: DataFrame, ranked: DataFrame, max_rows: int, top: int | None = None) -> DataFrame:
    """targets(conf, seq) in order of the confs' rank until max_rows are spent (the feature is the cut).

    Whole confs are cut on the running sum of their counts; only inside the last one are rows numbered.
    """
    confs = ranked.select("conf", "rank") if top is None else ranked.filter(F.col("rank") <= top).select("conf", "rank")
    n = targets.groupBy("conf").agg(F.count("*").alias("n")).join(confs, "conf")
    before = F.coalesce(F.sum("n").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = n.withColumn("left", F.lit(max_rows) - before).filter("left > 0")
    rows = targets.join(left.select("conf", "left", "n"), "conf")
    number = F.row_number().over(Window.partitionBy("conf").orderBy("seq"))
    whole = rows.filter("n <= left").drop("n", "left")
    return whole.unionByName(rows.filter("n > left").withColumn("number", number).filter("number <= left").drop("n", "left", "number"))


def collect_due(catalog: DataFrame, progress: DataFrame, cached: DataFrame, now: str, refreshable: list[str], ttl_days: int = 30) -> DataFrame:
    """Catalog entries (source, name, url) to collect: unseen ones, empty ones older than the ttl, and, of those whose
    name is already cached, only names of several entries or refreshable sources."""
    entries = catalog.filter((F.trim(C.text("name")) != "") & (F.trim(C.text("url")) != ""))
    many = F.count("*").over(Window.partitionBy("source", "name")) > 1
    j = entries.withColumn("many", many).join(progress.select("source", "url", F.col("ts").alias("seen"), F.coalesce("empty", F.lit(False)).alias("was_empty")), ["source", "url"], "left")
    j = j.join(cached.select("name").distinct().withColumn("cached", F.lit(True)), "name", "left")
    stale = F.col("was_empty") & (F.datediff(F.lit(now).cast("date"), F.col("seen").cast("date")) > ttl_days)
    unseen = F.col("seen").isNull() & (F.col("cached").isNull() | F.col("many") | F.col("source").isin(refreshable))
    return j.filter(unseen | F.coalesce(stale, F.lit(False))).select("source", "name", "url")


def places_by_host(rows: DataFrame) -> DataFrame:
    """rows(stratum, year, at, url, id) with `place`, the number by year, host, url and id inside the stratum, and `all`,
    the rows of the stratum. A window holds one host's year of a stratum."""
    part = ["stratum", "year", "at"]
    counts = rows.groupBy(*part).agg(F.count("*").alias("own"))
    order = Window.partitionBy("stratum").orderBy("year", "at")
    counts = counts.select(*part, (F.sum("own").over(order) - F.col("own")).alias("before"), F.sum("own").over(Window.partitionBy("stratum")).alias("all"))
    safe = lambda d, name: d.withColumn(name, F.coalesce("year", F.lit(-1)))  # noqa: E731  null years match
    place = F.row_number().over(Window.partitionBy(*part).orderBy("url", "id"))
    rows = safe(rows.withColumn("own", place), "y").join(safe(counts, "y").drop("year"), ["stratum", "y", "at"])
    return rows.withColumn("place", F.col("before") + F.col("own"))


def sample_strata(df: DataFrame, strata: dict[str, Column | tuple[Column, int]], n: int, seed: int, path: str | None = None) -> DataFrame:
    """A stratified sample. strata: name -> (condition, base quota), or a condition of quota 1; a row falls to the first stratum it fits, and
    quotas are scaled from their sum to n, each at least 1. A stratum's rows, by year and url, are cut into as many slices
    of equal size, and the row with the least seeded hash is taken from each; a stratum within its quota is taken whole.

    With a path, places are numbered in ranges of all rows (places_by_range), so no task holds one host's year of a
    stratum. Without one they are numbered inside (stratum, year, host) and moved by what comes before it.
    """
    strata = {k: v if isinstance(v, tuple) else (v, 1) for k, v in strata.items()}
    first, quota = F.lit(None).cast("string"), F.lit(1)
    total = sum(q for _, q in strata.values())
    for name, (fits, base) in reversed(strata.items()):
        first = F.when(fits, name).otherwise(first)
        quota = F.when(F.col("stratum") == name, max(1, round(n * base / total))).otherwise(quota)
    rows = df.withColumn("stratum", first).filter("stratum is not null").withColumn("at", F.regexp_extract(C.text("url"), "^(?:[^/]*//)?[^/]*/?", 0))
    if path:
        placed = places_by_range(rows.select("stratum", "year", "at", "url", "id"), [F.asc(c) for c in ("stratum", "year", "at", "url", "id")], path)
        of = placed.groupBy("stratum").agg((F.min("place") - 1).alias("before"), F.count("*").alias("all"))  # a row for each stratum
        rows = placed.join(F.broadcast(of), "stratum").withColumn("place", F.col("place") - F.col("before"))
    else:
        rows = places_by_host(rows)
    rows = rows.withColumn("quota", quota)
    slice_ = F.when(F.col("all") <= F.col("quota"), F.col("place") - 1).otherwise(F.ceil(F.col("place") * F.col("quota") / F.col("all")) - 1)
    rows = rows.withColumn("slice", slice_)
    pick = F.min_by(F.struct("id", "year", "url"), F.md5(F.concat_ws("|", F.lit(str(seed)), "url", "id")))
    return rows.groupBy("stratum", "slice").agg(pick.alias("r")).select("stratum", "slice", "r.*")

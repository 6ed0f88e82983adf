"""Record linkage and backfill: ambiguity-free indexes, ranked matches, candidate acceptance, code links.

Fuzzy title comparison only ever runs after an equi-join on a record id; a match key that leads to several things is
dropped instead of scored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import predicates as P
from . import ratios

MIN_CHARS = 60
# What an extract holds that took in a notice or went on into the paper
NOTICE = r"permission to make digital|copyright held by"
INTRO = r"1\. introduction|i\. introduction|1 introduction"


def unambiguous_index(rows: DataFrame, key: str, fingerprint: Column, order: str = "seq") -> DataFrame:
    """M1: the first row of each non-empty key whose rows all have one fingerprint."""
    cols = [c for c in rows.columns if c != key]
    by = rows.filter(C.text(key) != "").groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("r"), F.count_distinct(fingerprint).alias("n"))
    return by.filter("n <= 1").select(key, "r.*")


def abstract_keys(url: Column, title: Column) -> Column:
    """Keys of a paper in order of trust: array<struct<rank, kind, key>>."""
    kinds = [("arxiv", C.arxiv_id(url)), ("openreview", C.submission_id(url)), ("url", F.nullif(C.normalise_url(url), F.lit(""))), ("title", F.nullif(C.plain_title_key(title), F.lit("")))]
    rows = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), v.alias("key")) for i, (k, v) in enumerate(kinds)))
    return F.filter(rows, lambda x: x["key"].isNotNull())


def year_guard(conf: Column, venue_text: Column, date: Column) -> Column:
    """M4: years in the venue text must include the conf's; else the date must lie within a year of it; else it passes."""
    own = C.conf_year(conf)
    years = F.transform(F.regexp_extract_all(C.text(venue_text), F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    by_date = F.abs(F.year(date) - own) <= 1
    return F.when(own.isNull(), True).when(F.size(years) > 0, F.array_contains(years, own)).otherwise(F.coalesce(by_date, F.lit(True)))


def match_priority(papers: DataFrame, index: DataFrame) -> DataFrame:
    """M2: (id, method, best row of the index) by the first key that hits. papers: id, conf, url, title; index: kind,
    key, venue_text, date, abstract. A hit by title must also pass M4."""
    asked = papers.select("id", "conf", F.explode(abstract_keys(F.col("url"), F.col("title"))).alias("k")).select("id", "conf", "k.*")
    hit = asked.join(index, ["kind", "key"]).filter((F.col("kind") != "title") | year_guard(F.col("conf"), F.col("venue_text"), F.col("date")))
    return hit.groupBy("id").agg(F.min_by(F.struct(F.col("kind").alias("method"), "abstract"), F.col("rank")).alias("r")).select("id", "r.*")


def fill_abstract(papers: DataFrame, match: DataFrame, min_chars: int = MIN_CHARS, samples: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M3: (papers, counts by method and conf, at most `samples` samples): only empty abstracts, by cleaned text that is
    long enough."""
    j = papers.join(match.select("id", "method", C.clean_abstract(F.col("abstract")).alias("found")), "id", "left")
    ok = F.coalesce((F.trim(C.text("abstract")) == "") & (F.length("found") >= min_chars), F.lit(False))
    filled = j.withColumn("filled", ok)
    out = filled.withColumn("abstract", F.when(ok, F.col("found")).otherwise(F.col("abstract"))).select(*papers.columns)
    done = filled.filter("filled")
    return out, done.groupBy("method", "conf").agg(F.count("*").alias("n")), done.select("id", "method", "found").orderBy("id").limit(samples)


def code_index(links: DataFrame) -> DataFrame:
    """M5: (kind, key, repo): keys of one paper identity only, and the best repository: official, then mentioned in the
    paper, then by url. links: paper_title, paper_arxiv_id, paper_url_abs, repo_url, is_official, mentioned_in_paper."""
    repo = F.regexp_replace(F.regexp_replace(F.trim(C.text("repo_url")), r"[.,;:'\")\]}>]+$", ""), "/+$", "")
    github = repo.rlike(r"^https?://github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+(?:/[^\s)\]}>\"'`]*)?$")
    identity = F.coalesce(F.nullif(F.trim(C.text("paper_arxiv_id")), F.lit("")), F.nullif(C.normalise_url(F.col("paper_url_abs")), F.lit("")), C.plain_title_key(F.col("paper_title")))
    kinds = [("arxiv", F.trim(C.text("paper_arxiv_id"))), ("url", C.normalise_url(F.col("paper_url_abs"))), ("title", C.plain_title_key(F.col("paper_title")))]
    keys = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in kinds))
    rank = F.struct(~F.coalesce("is_official", F.lit(False)), ~F.coalesce("mentioned_in_paper", F.lit(False)), repo.alias("repo"))
    rows = links.select(F.explode(keys).alias("k"), identity.alias("identity"), F.when(github, rank).alias("best")).filter("k.key <> ''")
    by = rows.groupBy("k.kind", "k.key").agg(F.count_distinct("identity").alias("n"), F.min("best").alias("best"))
    return by.filter("n = 1 and best is not null").select("kind", "key", F.col("best.repo").alias("repo"))


def fill_code(papers: DataFrame, index: DataFrame) -> DataFrame:
    """M6: empty or '#' codes filled by arXiv id, then url, then title."""
    asked = papers.filter(~P.has_code(F.col("code"))).select("id", F.explode(abstract_keys(F.col("url"), F.col("title"))).alias("k")).select("id", "k.*")
    best = asked.join(index, ["kind", "key"]).groupBy("id").agg(F.min_by("repo", "rank").alias("repo"))
    return papers.join(best, "id", "left").withColumn("code", F.coalesce("repo", "code")).select(*papers.columns)


def fill_code_from_text(papers: DataFrame, year: int | None = None, retry: bool = False) -> DataFrame:
    """M7: missing codes from the first repository link in the abstract; '#' where none is found. Without retry only rows
    never looked at (empty code) are tried."""
    code = F.trim(C.text("code"))
    tried = (code == "") | (code == "#") if retry else code == ""
    due = tried & (F.lit(True) if year is None else F.coalesce(F.col("year") == year, F.lit(False)))
    return papers.withColumn("code", F.when(due, F.coalesce(F.nullif(C.github_link(F.col("abstract")), F.lit("")), F.lit("#"))).otherwise(F.col("code")))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratios.ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


def title_ratio(a: Column, b: Column) -> Column:
    """M8: Ratcliff-Obershelp ratio of the plain title keys."""
    return _ratio(C.plain_title_key(a), C.plain_title_key(b))


SIGNS = "etaoinsrhldc"  # more of them bound better, but the generated code outgrows a method


def ratio_bound(x: Column, y: Column) -> Column:
    """At least the ratio of two texts: what they can share is, sign by sign, no more than the rarer side has of it (signs
    beyond SIGNS are counted together). 1 for two empty texts."""
    shared = F.lit(0)
    for c in SIGNS:
        shared = shared + F.least(*(F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for t in (x, y)))
    rest = F.least(*(F.length(F.translate(t, SIGNS, "")) for t in (x, y)))
    both = F.length(x) + F.length(y)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * (shared + rest) / both)


def gate_parts(a: Column, b: Column, least: float) -> dict[str, Column]:
    """The two keys, and which pairs of titles the gate settles by containment, leaves open by length, and after the bound
    on shared signs."""
    x, y = C.plain_title_key(a), C.plain_title_key(b)
    named = (x != "") & (y != "")
    cheap = named & (x.contains(y) | y.contains(x))
    by_length = named & ~cheap & (2 * F.least(F.length(x), F.length(y)) >= least * (F.length(x) + F.length(y)))
    return {"x": x, "y": y, "contained": cheap, "by_length": by_length, "open": by_length & (ratio_bound(x, y) >= least)}


def title_gate(a: Column, b: Column, least: float) -> Column:
    """Equal, contained, or alike enough. The UDF sees only rows that the cheap tests leave open."""
    g = gate_parts(a, b, least)
    ratio = _ratio(F.when(g["open"], g["x"]), F.when(g["open"], g["y"]))
    return g["contained"] | (g["open"] & (ratio >= least))


def gate_report(pairs: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """One row: pairs, and how many are contained, left open by length, and handed to the sequence matcher."""
    g = gate_parts(F.col(a), F.col(b), least)
    return pairs.agg(F.count("*").alias("pairs"), *(F.count_if(F.coalesce(g[k], F.lit(False))).alias(n) for k, n in (("contained", "contained"), ("by_length", "by_length"), ("open", "matched"))))


def accept_candidates(papers: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M9: (first accepted candidate or reason per paper, outcome per paper and source). papers: id, title, year;
    candidates: id, source, rank, title, year, landing_url. arXiv needs a ratio of 0.98; the others 0.98, or 0.90 with
    a year within one of the paper's."""
    c = candidates.withColumnsRenamed({"title": "c_title", "year": "c_year"})
    j = papers.select("id", "title", "year").join(c, "id", "left").withColumn("ratio", title_ratio(F.col("title"), F.col("c_title")))
    close = F.coalesce(F.abs(F.col("c_year") - F.col("year")) <= 1, F.lit(False))
    ok = F.col("source").isNotNull() & ((F.col("ratio") >= 0.98) | ((F.col("source") != "arxiv") & (F.col("ratio") >= 0.90) & close))
    order = F.struct(F.when(F.col("source") == "openalex", 0).when(F.col("source") == "crossref", 1).otherwise(2), "rank")
    j = j.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("order", order)
    best = j.groupBy("id").agg(
        F.min_by(F.struct("source", "rank", "ratio", "landing_url"), F.when(F.col("ok"), F.col("order"))).alias("hit"),
        F.count("source").alias("n"), F.max("ratio").alias("top"),
    )
    reason = F.when(F.col("hit").isNotNull(), "accepted").when(F.col("n") == 0, "no_candidate").when(F.col("top") >= 0.90, "year_mismatch").otherwise("title_mismatch")
    outcome = j.filter("source is not null").groupBy("id", "source").agg(F.bool_or("ok").alias("accepted"), F.count("*").alias("tried"))
    return best.select("id", "hit.source", "hit.rank", "hit.landing_url", reason.alias("reason")), outcome


def evaluate_by_doi(papers: DataFrame, responses: DataFrame) -> DataFrame:
    """(id, outcome, abstract) of lookups by DOI. papers: id, url, title; responses: doi, title, abstract."""
    r = responses.select(F.lower("doi").alias("doi"), F.col("title").alias("r_title"), C.clean_abstract(F.col("abstract")).alias("r_abstract")).dropDuplicates(["doi"])
    j = papers.select("id", "title", F.lower(C.doi_of(F.col("url"))).alias("doi")).filter("doi is not null").join(r.withColumn("there", F.lit(True)), "doi", "left")
    outcome = (
        F.when(F.col("there").isNull(), "doi_not_found")
        .when(~title_gate(F.col("title"), F.col("r_title"), 0.70), "title_mismatch")
        .when(F.length("r_abstract") < MIN_CHARS, "empty_abstract")
        .otherwise("success")
    )
    return j.withColumn("outcome", outcome).select("id", "outcome", F.when(F.col("outcome") == "success", F.col("r_abstract")).alias("abstract"))


def evaluate_by_title(papers: DataFrame, candidates: DataFrame) -> DataFrame:
    """First candidate (by rank) that passes title (0.85), year (within one, if both have one) and length; else
    empty_abstract if one had the right title, else title_mismatch. candidates: id, rank, title, year, abstract."""
    c = candidates.select("id", "rank", F.col("title").alias("c_title"), F.col("year").alias("c_year"), C.clean_abstract(F.col("abstract")).alias("c_abstract"))
    j = papers.select("id", "title", "year").join(c, "id", "left")
    same = title_gate(F.col("title"), F.col("c_title"), 0.85) & F.coalesce(F.abs(F.col("c_year") - F.col("year")) <= 1, F.lit(True))
    j = j.withColumn("same", F.coalesce(same, F.lit(False)))
    good = F.col("same") & (F.length("c_abstract") >= MIN_CHARS)
    best = j.groupBy("id").agg(F.min_by("c_abstract", F.when(good, F.col("rank"))).alias("abstract"), F.bool_or("same").alias("same"))
    return best.select("id", F.when(F.col("abstract").isNotNull(), "success").when(F.col("same"), "empty_abstract").otherwise("title_mismatch").alias("outcome"), "abstract")


def fill_from_bibliography(papers: DataFrame, biblio: DataFrame, min_chars: int = 40) -> DataFrame:
    """Empty abstracts from biblio(url, abstract) by canonical url, then a code link out of the new text."""
    b = biblio.select(C.normalise_url(F.col("url")).alias("u"), C.clean_abstract(F.col("abstract")).alias("b")).filter((F.length("b") >= min_chars) & (F.col("u") != ""))
    b = b.groupBy("u").agg(F.max_by("b", F.struct(F.length("b"), "b")).alias("b"))
    j = papers.withColumn("u", C.normalise_url(F.col("url"))).join(b, "u", "left")
    fill = (F.trim(C.text("abstract")) == "") & F.col("b").isNotNull()
    link = F.nullif(C.github_link(F.col("b")), F.lit(""))
    code = F.when(fill & ~P.has_code(F.col("code")), F.coalesce(link, "code")).otherwise(F.col("code"))
    return j.withColumn("code", code).withColumn("abstract", F.when(fill, F.col("b")).otherwise(F.col("abstract"))).select(*papers.columns)


def fill_from_id_table(papers: DataFrame, table: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """M12's second source, for what the bibliography left empty: table(acl_id, title, year, abstract) by the id at the
    end of the address, if titles agree (0.85) and years, where both are known, lie within one; then a code link."""
    t = table.select(F.col("acl_id").alias("k"), F.col("title").alias("t_title"), F.col("year").alias("t_year"), C.clean_abstract(F.col("abstract")).alias("b"))
    t = t.filter((C.text("k") != "") & (F.length("b") >= min_chars))
    one = t.groupBy("k").agg(F.max_by(F.struct("t_title", "t_year", "b"), F.struct(F.length("b"), "b", "t_title")).alias("t")).select("k", "t.*")
    own = C.canonical_host(F.col("url")) == "aclanthology.org"
    j = papers.withColumn("k", F.when(own, F.regexp_extract(C.normalise_url(F.col("url")), "([^/]+)$", 1))).join(one, "k", "left")
    near = F.coalesce(F.abs(F.col("t_year") - F.col("year")) <= 1, F.lit(True))
    fill = (F.trim(C.text("abstract")) == "") & F.col("b").isNotNull() & near & F.coalesce(title_gate(F.col("title"), F.col("t_title"), 0.85), F.lit(False))
    j = j.withColumn("fill", fill)
    code = F.when(F.col("fill") & ~P.has_code(F.col("code")), F.coalesce(F.nullif(C.github_link(F.col("b")), F.lit("")), "code")).otherwise(F.col("code"))
    return j.withColumn("code", code).withColumn("abstract", F.when(F.col("fill"), F.col("b")).otherwise(F.col("abstract"))).select(*papers.columns)


def link_by_identity(local: DataFrame, external: DataFrame) -> DataFrame:
    """(xid, id, status, method) of every external row. local: id, conf, url, title; external: xid, conf, url, title.

    Within a conf the identity keys are walked in order: the first that exactly one local row has makes a match, one that
    several have is ambiguous; else the title key, if unique on both sides; else unmatched.
    """
    keys = lambda df, i: df.select("conf", i, F.posexplode(C.identity_keys(F.col("url"))).alias("pos", "k")).select("conf", i, "pos", "k.kind", "k.key")
    own = keys(local, "id").groupBy("conf", "kind", "key").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    hit = keys(external, "xid").join(own, ["conf", "kind", "key"])
    by_key = hit.groupBy("xid").agg(F.min_by(F.struct("n", "id", "kind"), "pos").alias("k"))
    titles = lambda df, i, n: df.groupBy("conf", C.plain_title_key(F.col("title")).alias("t")).agg(F.count("*").alias(n), F.min(i).alias(i)).filter(F.col("t") != "")
    by_title = titles(external, "xid", "xn").join(titles(local, "id", "ln"), ["conf", "t"]).filter("xn = 1 and ln = 1").select("xid", F.col("id").alias("t_id"))
    j = external.select("xid").join(by_key, "xid", "left").join(by_title, "xid", "left")
    one, many = F.col("k.n") == 1, F.col("k.n") > 1
    return j.select(
        "xid",
        F.when(one, F.col("k.id")).when(many, None).otherwise(F.col("t_id")).alias("id"),
        F.when(one, "matched").when(many, "ambiguous").when(F.col("t_id").isNotNull(), "matched").otherwise("unmatched").alias("status"),
        F.when(one, F.col("k.kind")).when(F.col("k").isNull() & F.col("t_id").isNotNull(), "title").alias("method"),
    )


def valid_codes(urls: Column) -> Column:
    """The accepted urls of an array of code urls."""
    return F.filter(F.transform(urls, lambda u: C.classify_code_url(u)["url"]), lambda u: u != "")


def import_codes(papers: DataFrame, listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(papers, counts by outcome): empty codes filled from matched listings(xid, conf, url, title, code_urls) whose
    valid urls agree on one repository. Only the code changes."""
    link = link_by_identity(papers, listings).join(listings.select("xid", "code_urls"), "xid")
    link = link.withColumn("valid", valid_codes(F.col("code_urls")))
    repos = F.array_distinct(F.transform("valid", C.normalise_repo))
    link = link.withColumn("repos", F.size(repos)).withColumn("repo", F.try_element_at(repos, F.lit(1)))
    usable = link.filter("status = 'matched' and repos = 1").groupBy("id").agg(F.min_by(F.struct(F.element_at("valid", 1).alias("code"), "repo"), "xid").alias("r"), F.count_distinct("repo").alias("n")).filter("n = 1").select("id", "r.*")
    j = papers.join(usable.withColumnRenamed("code", "new_code"), "id", "left")
    has = P.has_code(F.col("code"))
    out = j.withColumn("code", F.when(~has & F.col("new_code").isNotNull(), F.col("new_code")).otherwise(F.col("code"))).select(*papers.columns)
    filled = j.filter(F.col("new_code").isNotNull()).select(F.when(~has, "filled").when(C.normalise_repo(F.col("code")) == F.col("repo"), "same").otherwise("conflict").alias("outcome"))
    rest = link.filter("status <> 'matched' or repos <> 1").select(F.when(F.col("status") != "matched", F.col("status")).when(F.col("repos") == 0, "no_valid_url").otherwise("several_repositories").alias("outcome"))
    return out, filled.unionByName(rest).groupBy("outcome").agg(F.count("*").alias("n"))


def changed_beyond_code(before: DataFrame, after: DataFrame) -> DataFrame:
    """M14's check: rows that `after` has, or lacks, in any column but code; none, if only codes changed."""
    columns = [c for c in before.columns if c != "code"]
    a, b = before.select(*columns), after.select(*columns)
    return b.exceptAll(a).unionByName(a.exceptAll(b))


def repair_codes(papers: DataFrame, listings: DataFrame, blocked: DataFrame) -> DataFrame:
    """Rows whose code is a blocked(repo): kept if the abstract or a matched listing names it, replaced by the one
    valid alternative of the listing, else cleared. Adds `action`."""
    link = link_by_identity(papers, listings).filter("status = 'matched'").join(listings.select("xid", "code_urls"), "xid")
    support = link.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(valid_codes(F.col("code_urls"))))).alias("urls"))  # listings of one paper
    repo = C.normalise_repo(F.col("code"))
    j = papers.withColumn("repo", repo).join(blocked.select("repo").distinct().withColumn("bad", F.lit(True)), "repo", "left").join(support, "id", "left")
    names = F.transform(F.coalesce("urls", F.array().cast("array<string>")), C.normalise_repo)
    backed = F.array_contains(names, F.col("repo")) | F.lower(C.text("abstract")).contains(F.regexp_replace("repo", "^https://", ""))
    other = F.filter(F.coalesce("urls", F.array().cast("array<string>")), lambda u: C.normalise_repo(u) != F.col("repo"))
    action = F.when(F.col("bad").isNull(), "untouched").when(backed, "kept").when(F.size(other) == 1, "replaced").otherwise("cleared")
    j = j.withColumn("action", action).withColumn("other", F.try_element_at(other, F.lit(1)))
    return j.withColumn("code", F.when(F.col("action") == "replaced", F.col("other")).when(F.col("action") == "cleared", "#").otherwise(F.col("code"))).select(*papers.columns, "action")


def quarantine_repos(papers: DataFrame, blocked: DataFrame | None = None, least: int = 20, share: float = 0.05) -> DataFrame:
    """(conf, repo, rows, titles): used by at least `least` rows and titles and `share` of the conf, or blocked."""
    rows = papers.filter(P.has_code(F.col("code"))).withColumn("repo", C.normalise_repo(F.col("code"))).filter("repo <> ''")
    used = rows.groupBy("conf", "repo").agg(F.count("*").alias("rows"), F.count_distinct(C.plain_title_key(F.col("title"))).alias("titles"))
    j = used.join(papers.groupBy("conf").agg(F.count("*").alias("total")), "conf")
    bad = (F.col("rows") >= least) & (F.col("titles") >= least) & (F.col("rows") >= share * F.col("total"))
    if blocked is not None:
        j = j.join(blocked.select("repo").distinct().withColumn("listed", F.lit(True)), "repo", "left")
        bad = bad | F.coalesce("listed", F.lit(False))
    return j.filter(bad).select("conf", "repo", "rows", "titles")


def export_missing(papers: DataFrame, listings: DataFrame, exclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, counts by reason): papers with a valid code that the listings lack by any key or title, but for
    ambiguous, excluded(id) and quarantined ones.

    The identity keys of a paper are walked in order: one that the listings have makes it listed, one that several papers
    have makes it ambiguous; then the title, the other way round. Papers without title or url are ambiguous as well.
    """
    keys = lambda df: df.select("conf", *(["id"] if "id" in df.columns else []), F.posexplode(C.identity_keys(F.col("url"))).alias("pos", "k"))
    own = keys(papers.select("conf", "id", "url"))
    shared = own.groupBy("conf", "k").agg(F.count_distinct("id").alias("n")).filter("n > 1").withColumn("many", F.lit(True))
    listed = keys(listings.select("conf", "url")).select("conf", "k").distinct().withColumn("listed", F.lit(True))
    met = own.join(listed, ["conf", "k"], "left").join(shared, ["conf", "k"], "left").filter("listed or many")
    by_key = met.groupBy("id").agg(F.min_by(F.when(F.col("listed"), "listed").otherwise("ambiguous"), "pos").alias("by_key"))
    code, title = C.classify_code_url(F.col("code")), C.plain_title_key(F.col("title"))
    titles = lambda df: df.select("conf", title.alias("t")).filter("t <> ''")
    same = titles(listings).distinct().withColumn("titled", F.lit(True))
    twins = titles(papers).groupBy("conf", "t").agg(F.count("*").alias("n")).filter("n > 1").withColumn("twin", F.lit(True)).drop("n")
    bad = quarantine_repos(papers).select("conf", "repo").withColumn("bad", F.lit(True))
    j = (
        papers.withColumn("c", code).withColumn("t", title).withColumn("repo", C.normalise_repo(F.col("code")))
        .join(by_key, "id", "left").join(same, ["conf", "t"], "left").join(twins, ["conf", "t"], "left").join(bad, ["conf", "repo"], "left")
        .join(exclusions.select("id").distinct().withColumn("excluded", F.lit(True)), "id", "left")
    )
    unnamed = (F.trim(C.text("title")) == "") | (F.trim(C.text("url")) == "")
    reason = (
        F.when(F.col("by_key").isNotNull(), F.col("by_key")).when(F.col("twin"), "ambiguous").when(F.col("titled"), "same_title")
        .when(F.col("c.reason") != "", F.col("c.reason")).when(F.col("excluded"), "excluded").when(F.col("bad"), "quarantined")
        .when(unnamed, "ambiguous").otherwise("export")
    )
    j = j.withColumn("reason", reason)
    return j.filter("reason = 'export'").select("id", "conf", "title", "url", F.col("c.url").alias("code")), j.groupBy("reason").agg(F.count("*").alias("n"))


def resolve_lookup(papers: DataFrame, response: DataFrame) -> DataFrame:
    """(id, repo, abstract, per-field status, terminal) of lookups keyed by the API ledger's key. papers: id, key,
    url, title, no_abstract, no_code; response: key, ok, r_arxiv, r_title, r_abstract, repo_url, is_official, stars, pos."""
    own = C.arxiv_id(F.col("url"))
    j = papers.join(response, "key", "left")
    same = F.when(own.isNotNull() & F.col("r_arxiv").isNotNull(), own == F.col("r_arxiv")).otherwise(C.title_key(F.col("title"), "nfkc") == C.title_key(F.col("r_title"), "nfkc"))
    j = j.withColumn("same", F.coalesce(same & F.col("ok"), F.lit(False)))
    rank = F.struct(~F.coalesce("is_official", F.lit(False)), -F.coalesce("stars", F.lit(0)), "repo_url", "pos")
    text = C.clean_abstract(F.col("r_abstract"))
    best = j.groupBy("id").agg(
        F.min_by("repo_url", F.when(F.col("same") & F.col("repo_url").isNotNull(), rank)).alias("repo"),
        F.max(F.when(F.col("same") & (F.length(text) >= MIN_CHARS), text)).alias("abstract"),
        F.bool_or("ok").alias("answered"), F.first("no_abstract").alias("no_abstract"), F.first("no_code").alias("no_code"),
    )
    state = lambda need, got: F.when(~F.col(need), "not_needed").when(~F.coalesce("answered", F.lit(False)), "failed").when(F.col(got).isNotNull(), "filled").otherwise("unavailable")
    out = best.withColumn("abstract_status", state("no_abstract", "abstract")).withColumn("code_status", state("no_code", "repo"))
    terminal = (F.col("abstract_status") != "failed") & (F.col("code_status") != "failed")
    return out.select("id", "repo", "abstract", "abstract_status", "code_status", terminal.alias("terminal"))


def pick_source(papers: DataFrame, responses: DataFrame) -> DataFrame:
    """Per paper the first answer with text, of crossref, semanticscholar, openalex, whose title passes (a missing
    one does). papers: id, title; responses: id, source, title, abstract."""
    r = responses.select("id", "source", F.col("title").alias("r_title"), C.clean_abstract(F.col("abstract")).alias("r_abstract"))
    j = papers.select("id", "title").join(r, "id")
    ok = ((C.text("r_title") == "") | title_gate(F.col("title"), F.col("r_title"), 0.70)) & (F.col("r_abstract") != "")
    rank = F.when(F.col("source") == "crossref", 0).when(F.col("source") == "semanticscholar", 1).otherwise(2)
    best = j.withColumn("ok", ok).filter("ok").groupBy("id").agg(F.min_by(F.struct("source", F.col("r_abstract").alias("abstract")), rank).alias("r"))
    return best.select("id", "r.*")


def compare_texts(extracted: DataFrame, reference: DataFrame) -> DataFrame:
    """Verdict per id: FAIL (no extract), NOREF (no reference), PASS (ratio 0.80, or the first 200 characters of one
    side stand in the other), REVIEW (0.5), FAIL; and whether the extract holds a copyright notice or leaks past the
    abstract. Texts are compared in lower case, words joined over hyphens, anything between words as one space. The ratio
    is null where the beginning settles the verdict or a reference is missing."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(C.text(c)), r"(?U)-\s+", ""), r"(?U)[^\w]+", " "))
    j = extracted.select("id", F.col("text").alias("e")).join(reference.select("id", F.col("text").alias("r")), "id", "left")
    j = j.withColumn("x", plain("e")).withColumn("y", plain("r"))
    begins = (F.col("x") != "") & (F.col("y") != "") & (F.col("y").contains(F.left("x", F.lit(200))) | F.col("x").contains(F.left("y", F.lit(200))))
    empty, alone = C.text("e") == "", C.text("r") == ""
    measured = ~empty & ~alone & ~begins
    ratio = F.when(empty, 0.0).when(measured, _ratio(F.when(measured, F.col("x")), F.when(measured, F.col("y"))))
    verdict = F.when(empty, "FAIL").when(alone, "NOREF").when(begins | (F.col("ratio") >= 0.80), "PASS").when(F.col("ratio") >= 0.5, "REVIEW").otherwise("FAIL")
    holds = lambda marks: F.lower(C.text("e")).rlike(marks)
    out = j.withColumn("prefix", begins & ~empty & ~alone).withColumn("ratio", ratio)
    out = out.withColumn("intro_leak", holds(INTRO)).withColumn("keywords_leak", holds(r"\b(keywords|index terms)\b"))
    return out.select("id", "ratio", "prefix", verdict.alias("verdict"), holds(NOTICE).alias("copyright"), "intro_leak", "keywords_leak", (F.col("intro_leak") | F.col("keywords_leak")).alias("leak"))


def verdict_rates(verdicts: DataFrame) -> DataFrame:
    n = verdicts.groupBy("verdict").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))

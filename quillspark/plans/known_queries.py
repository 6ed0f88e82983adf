"""Queries whose title ratios are known beforehand, so that SQL can check the operators behind the sequence matcher.

The other title is a beginning of the paper's title key followed by signs that occur in no title: the matcher's only
block is that beginning, and the ratio is twice its length over both lengths.
"""

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import linkage, repair
from .column_queries import key
from .common import papers, query, raw

SIGN = "ꙮ"  # a letter of one manuscript
LONG = "text of a response that is surely longer than sixty characters, as abstracts are"


def known(df, title):
    """df with `base`, the title's key, and `other`, which keeps all but `cut` signs of it and adds `extra` foreign ones."""
    n = F.length("base")
    rows = df.withColumn("base", C.plain_title_key(F.col(title)))
    rows = rows.withColumn("cut", F.floor(n * (F.col("seq") % 6) / 12).cast("int")).withColumn("extra", F.floor(n * (F.col("seq") % 4) / 10).cast("int"))
    return rows.withColumn("other", F.concat(F.left("base", n - F.col("cut")), F.repeat(F.lit(SIGN), F.col("extra"))))


def known_sql(table, title):
    """Rows of the table with ratio, and with `inside`, whether one key holds the other."""
    return f"""k0 as (select *, {key(title)} as base from {table}), k1 as (select *, length(base) as n from k0),
  k2 as (select *, cast(floor(n * (seq % 6) / 12) as int) as cut, cast(floor(n * (seq % 4) / 10) as int) as extra from k1),
  k as (select *, case when n = 0 then 1.0::double else 2.0::double * (n - cut) / (n + n - cut + extra) end as ratio, n > 0 and n - cut + extra > 0 and (cut = 0 or extra = 0) as inside from k2)"""


PAPERS, RAW = known_sql("papers", "title"), known_sql("raw", "paper_name")
GATE = "(inside or (n > 0 and n - cut + extra > 0 and ratio >= {}))"


@query("m8_known_ratios", f", {PAPERS} select id, round(ratio, 6) as ratio, {GATE.format(0.85)} as ok from k")
def m8_known(spark, sf):
    p = known(papers(spark, sf), "title")
    return p.select("id", F.round(linkage.title_ratio(F.col("title"), F.col("other")), 6).alias("ratio"), linkage.title_gate(F.col("title"), F.col("other"), 0.85).alias("ok"))


@query("m9_known_candidates", f""", {PAPERS}, c as (select *, case when seq % 7 <> 0 then case seq % 3 when 0 then 'crossref' when 1 then 'arxiv' else 'openalex' end end as source from k),
  a as (select *, coalesce(source is not null and (ratio >= 0.98 or (source <> 'arxiv' and ratio >= 0.90 and seq % 5 <= 2)), false) as ok from c)
  select id, case when ok then source end as source, case when ok then 'https://e.org/' || seq end as landing_url,
    case when ok then 'accepted' when source is null then 'no_candidate' when ratio >= 0.90 then 'year_mismatch' else 'title_mismatch' end as reason from a""")  # fmt: skip
def m9_known(spark, sf):
    p = known(papers(spark, sf), "title")
    source = F.when(F.col("seq") % 3 == 0, "crossref").when(F.col("seq") % 3 == 1, "arxiv").otherwise("openalex")
    c = p.filter("seq % 7 <> 0").select("id", source.alias("source"), F.lit(0).alias("rank"), F.col("other").alias("title"), (F.col("year") + F.col("seq") % 5 - 1).cast("int").alias("year"), F.concat(F.lit("https://e.org/"), "seq").alias("landing_url"))
    return linkage.accept_candidates(p, c)[0].select("id", "source", "landing_url", "reason")


@query("m10_known_responses", f""", {PAPERS} select id, case when seq % 5 = 0 then 'doi_not_found' when not {GATE.format(0.70)} then 'title_mismatch' when seq % 3 = 0 then 'empty_abstract' else 'success' end as outcome,
  case when seq % 5 <> 0 and {GATE.format(0.70)} and seq % 3 <> 0 then '{LONG}' end as abstract from k where url like 'https://doi.org/%'""")  # fmt: skip
def m10_known(spark, sf):
    p = known(papers(spark, sf), "title")
    r = p.filter("seq % 5 <> 0").select(F.upper(C.doi_of(F.col("url"))).alias("doi"), F.col("other").alias("title"), F.when(F.col("seq") % 3 == 0, "").otherwise(LONG).alias("abstract"))
    return linkage.evaluate_by_doi(p, r.filter("doi is not null"))


@query("m11_known_candidates", f""", {PAPERS}, s as (select *, {GATE.format(0.85)} and seq % 4 <= 1 and seq % 11 <> 0 as same from k)
  select id, case when same and seq % 5 <> 0 then 'success' when same then 'empty_abstract' else 'title_mismatch' end as outcome from s""")  # fmt: skip
def m11_known(spark, sf):
    p = known(papers(spark, sf), "title").filter("seq % 11 <> 0")
    c = p.select("id", F.lit(2).alias("rank"), F.col("other").alias("title"), (F.col("year") + F.col("seq") % 4).cast("int").alias("year"), F.when(F.col("seq") % 5 == 0, "").otherwise(LONG).alias("abstract"))
    unlike = p.select("id", F.lit(1).alias("rank"), F.repeat(F.lit(SIGN), 9).alias("title"), "year", F.lit(LONG).alias("abstract"))
    return linkage.evaluate_by_title(papers(spark, sf), c.unionByName(unlike)).select("id", "outcome")


@query("m18_known_lookups", f""", {PAPERS}, s as (select *, cut = 0 and extra = 0 and seq % 5 <> 0 as same, trim(abstract) = '' as no_abstract, trim(code) in ('', '#') as no_code from k)
  select id, case when same then 'https://github.com/a/b' end as repo, case when not no_abstract then 'not_needed' when seq % 5 = 0 then 'failed' when same then 'filled' else 'unavailable' end as abstract_status,
    case when not no_code then 'not_needed' when seq % 5 = 0 then 'failed' when same then 'filled' else 'unavailable' end as code_status, seq % 5 <> 0 or not (no_abstract or no_code) as terminal from s""")  # fmt: skip
def m18_known(spark, sf):
    """Every fifth lookup has no answer; the others offer a lesser repository beside the official one."""
    p = known(papers(spark, sf), "title").withColumn("key", F.col("id")).withColumn("no_abstract", F.trim("abstract") == "").withColumn("no_code", F.trim("code").isin("", "#"))
    r = p.filter("seq % 5 <> 0").select("key", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("r_arxiv"), F.col("other").alias("r_title"), F.lit(LONG).alias("r_abstract"))
    repos = [("https://github.com/a/more-stars", False, 9, 0), ("https://github.com/a/b", True, 3, 1)]
    repos = F.explode(F.array(*(F.struct(F.lit(u).alias("repo_url"), F.lit(o).alias("is_official"), F.lit(s).alias("stars"), F.lit(i).alias("pos")) for u, o, s, i in repos)))
    r = r.select("*", repos.alias("x")).select("key", "ok", "r_arxiv", "r_title", "r_abstract", "x.*")
    return linkage.resolve_lookup(p, r).select("id", "repo", "abstract_status", "code_status", "terminal")


@query("m19_known_sources", f""", {PAPERS}, s as (select id, case when (n - cut + extra = 0 or {GATE.format(0.70)}) and seq % 7 <> 0 then 'crossref' when seq % 3 = 0 then 'semanticscholar' when seq % 2 = 0 and (title = '' or n > 0) then 'openalex' end as source from k)
  select id, source, '{LONG}' as abstract from s where source is not null""")  # fmt: skip
def m19_known(spark, sf):
    """Crossref has the other title (and no text for every seventh paper), the second source no title, the third the own one."""
    p = known(papers(spark, sf), "title")
    of = lambda rows, source, title, text: rows.select("id", F.lit(source).alias("source"), title.alias("title"), text.alias("abstract"))
    r = of(p, "openalex", F.col("title"), F.lit(LONG)).join(p.filter("seq % 2 = 0").select("id"), "id", "left_semi")
    r = r.unionByName(of(p.filter("seq % 3 = 0"), "semanticscholar", F.lit(""), F.lit(LONG)))
    return linkage.pick_source(p, r.unionByName(of(p, "crossref", F.col("other"), F.when(F.col("seq") % 7 == 0, "").otherwise(LONG))))


_AUDIT = f""", {RAW}, a as (select *, paper_url || '#' || seq as old_url, case when seq % 5 = 0 then 'https://doi.org/10.17816/' || seq when seq % 3 = 0 then 'https://peerj.com/' || seq else 'https://doi.org/10.7/' || seq end as new_url,
    case when seq % 8 = 0 then 'merge' else 'rewrite' end as action from k where seq % 4 = 0),
  v as (select *, case when (seq % 5 <> 0 and seq % 3 = 0) or n - cut + extra = 0 or paper_name = '' then 'UNVERIFIABLE' when ratio >= 0.90 then 'PASS' else 'FAIL' end as verdict from a)"""


def known_audit(spark, sf):
    """Every fourth row has a new address, merged into another row for every eighth, half of those gone from the earlier table."""
    r = known(raw(spark, sf), "paper_name").withColumn("paper_url", F.concat_ws("#", "paper_url", "seq"))
    new = F.when(F.col("seq") % 5 == 0, "https://doi.org/10.17816/").when(F.col("seq") % 3 == 0, "https://peerj.com/").otherwise("https://doi.org/10.7/")
    moved = r.filter("seq % 4 = 0").withColumn("new_url", F.concat(new, "seq")).withColumn("action", F.when(F.col("seq") % 8 == 0, "merge").otherwise("rewrite"))
    log = moved.select("conf", F.col("paper_url").alias("old_url"), "new_url", "action", F.concat(F.lit(" "), "paper_name", F.lit("!")).alias("old_name"), F.lit(False).alias("abstract_filled"), "seq")
    now = moved.filter("action = 'rewrite'").select("conf", F.col("new_url").alias("paper_url"), "paper_name")
    return repair.audit(log.unionByName(log), now, r.filter("seq % 16 <> 0"), moved.select("new_url", F.col("other").alias("remote_title")))


@query("r4_known_audit", f"{_AUDIT} select old_url, new_url, action, round(ratio, 6) as ratio, verdict from v", over="raw")
def r4_known(spark, sf):
    return known_audit(spark, sf).select("old_url", "new_url", "action", F.round("ratio", 6).alias("ratio"), "verdict")


@query("r5_known_reverts", f"""{_AUDIT} select old_url, new_url from v where (verdict = 'FAIL' and (ratio < 0.6 or new_url like '%10.17816/%')) or (verdict = 'UNVERIFIABLE' and (new_url like '%peerj%' or new_url like '%10.17816/%'))""", over="raw")
def r5_known(spark, sf):
    return repair.select_reverts(known_audit(spark, sf)).select("old_url", "new_url")


@query("c11_known_tex", r"""select seq, trim(regexp_replace(replace(replace('On ' || translate(paper_name, '{}$', '') || ' with α and é', '---', '—'), '--', '–'), '\s+', ' ', 'g')) as t from raw""", over="raw")
def c11_known(spark, sf):
    """Titles between TeX commands: taken off, spelt out, accented."""
    return raw(spark, sf).select("seq", C.clean_tex_abstract(F.concat(F.lit(r"\emph{On} "), F.col("paper_name"), F.lit(r" with $\alpha$ and \'{e}"))).alias("t"))


@query("c19_known_surnames", """select seq, array_to_string(list_sort(list_distinct(list_transform(paper_authors, lambda a: case when seq % 3 = 0 then 'muenoz' when seq % 3 = 1 then 'strasse-' || 'e' else 'li' end))), '|') as names from raw""", over="raw")
def c19_known(spark, sf):
    """Every author of a row gets the row's surname, with umlauts, accents or a sharp s."""
    name = F.when(F.col("seq") % 3 == 0, "Müñoz").when(F.col("seq") % 3 == 1, "Straße-É").otherwise("Li")
    authors = F.transform("paper_authors", lambda a: F.concat(a, F.lit(" "), name))
    return raw(spark, sf).select("seq", F.concat_ws("|", C.author_surnames(authors)).alias("names"))

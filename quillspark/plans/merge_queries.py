"""Queries over merging, the ledger and work lists."""

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import predicates as P
from ..operators import adapters, ledger, merge, stats, worklist
from ..sources import corpus
from .column_queries import DOI, HOST, key
from .common import ORACLES, catalog, papers, query, raw, scratch, state

REAL = "trim(coalesce(paper_code, '')) not in ('', '#')"


def dup(spark, sf):
    """Raw rows in which half of the titles have lost their url and authors grow with seq."""
    r = raw(spark, sf)
    return r.withColumn("paper_url", F.when(F.col("seq") % 2 == 0, "").otherwise(F.col("paper_url"))).withColumn("conf", F.when(F.col("seq") % 13 == 0, "").otherwise(F.col("conf")))


DUP = "(select * replace (case when seq % 2 = 0 then '' else paper_url end as paper_url, case when seq % 13 = 0 then '' else conf end as conf) from raw)"
MERGED = f"""arg_min(paper_name, seq) as paper_name, arg_min(paper_url, seq) as paper_url,
  arg_max(coalesce(paper_abstract, ''), length(coalesce(paper_abstract, '')) * 100000000 - seq) as paper_abstract,
  len(arg_max(paper_authors, len(paper_authors) * 100000000 - seq)) as n_authors,
  case when count(*) = 1 then min(paper_code) else coalesce(arg_min(paper_code, seq) filter (where {REAL}), '#') end as paper_code, min(seq) as seq, count(*) as merged_rows"""


@query("d1_merge_fields", f"select conf, t, {MERGED} from (select *, lower(paper_name) as t from raw) group by conf, t", over="raw")
def d1(spark, sf):
    out = merge.merge_fields(raw(spark, sf).withColumn("t", F.lower("paper_name")), ["conf", "t"])
    return out.withColumn("n_authors", F.size("paper_authors")).drop("paper_authors")


KEY = "case when trim(paper_url) <> '' then 'u:' || trim(paper_url) else 't:' || lower(trim(paper_name)) end"


@query("d2_dedupe_clean", f"""select conf, paper_name, paper_url, paper_abstract, paper_code, seq from (select conf, {KEY} as k, {MERGED} from {DUP} where conf <> '' group by 1, 2)
  union all select conf, paper_name, paper_url, paper_abstract, paper_code, seq from {DUP} where conf = ''""", over="raw")  # fmt: skip
def d2(spark, sf):
    return merge.dedupe_clean(dup(spark, sf))[0].select("conf", "paper_name", "paper_url", "paper_abstract", "paper_code", "seq")


@query("d2_dedupe_stats", f"""select count(*) as rows_saved, count(*) filter (where best = 0 and size > 0) as abstract_rescued, count(*) filter (where best > 0 and size > best) as abstract_upgraded,
  count(*) filter (where had = 0 and r = 1) as code_upgraded, count(*) filter (where n > most) as authors_extended from (
  select count(*) over w as earlier, length(paper_abstract) as size, max(length(paper_abstract)) over w as best, len(paper_authors) as n, max(len(paper_authors)) over w as most,
    ({REAL})::int as r, max(({REAL})::int) over w as had from {DUP} where conf <> '' window w as (partition by conf, {KEY} order by seq rows between unbounded preceding and 1 preceding)) where earlier > 0""", over="raw")  # fmt: skip
def d2s(spark, sf):
    return merge.dedupe_clean(dup(spark, sf))[1]


@query("d3_merge_incremental", f"""select conf, paper_url, count(*) as n, max(len) as longest from (
  select conf, paper_url, max(length(paper_abstract)) as len from raw where conf in (select conf from raw where seq % 4 = 0) group by conf, paper_url
  union all select conf, paper_url, length(paper_abstract) from raw where seq % 4 <> 0 and conf not in (select conf from raw where seq % 4 = 0)) group by conf, paper_url""", over="raw")  # fmt: skip
def d3(spark, sf):
    r = raw(spark, sf)
    out = merge.merge_incremental(r.filter("seq % 4 = 0"), r.filter("seq % 4 <> 0"))
    return out.groupBy("conf", "paper_url").agg(F.count("*").alias("n"), F.max(F.length("paper_abstract")).alias("longest"))


@query("d4_merge_official")
def d4(spark, sf):
    r = raw(spark, sf)
    official = r.filter("seq % 3 = 0").withColumn("paper_url", F.concat(F.lit("https://doi.org/10.9/"), F.col("seq").cast("string"))).withColumn("paper_name", F.upper("paper_name"))
    return merge.merge_official(r, official, "ijcai").select("conf", "paper_name", "paper_url", "seq")


@query("d5_sync_report", """, b as (select conf, count(*) as r, count(*) filter (where trim(paper_abstract) <> '') as f from raw where seq % 10 <> 0 group by conf),
  a as (select conf, count(*) as r, count(*) filter (where trim(paper_abstract) <> '') as f from raw where seq % 9 <> 0 group by conf)
  select coalesce(a.conf, b.conf) as conf, coalesce(b.r, 0) as rows_before, coalesce(b.f, 0) as filled_before, coalesce(a.r, 0) as rows_after, coalesce(a.f, 0) as filled_after,
  greatest(coalesce(a.r, 0) - coalesce(b.r, 0), 0) as added, greatest(coalesce(b.r, 0) - coalesce(a.r, 0), 0) as removed,
  coalesce(a.r, 0) <> coalesce(b.r, 0) or coalesce(a.f, 0) <> coalesce(b.f, 0) as changed from a full join b on a.conf = b.conf""", over="raw")  # fmt: skip
def d5(spark, sf):
    r = raw(spark, sf)
    return merge.sync_report(r.filter("seq % 10 <> 0"), r.filter("seq % 9 <> 0"))


@query("d3_merged_rows", f"""select conf, paper_name, paper_url, paper_abstract, n_authors, paper_code, seq from (
  select conf, paper_url as u, arg_min(paper_name, o) as paper_name, arg_min(paper_url, o) as paper_url,
    case when count(*) = 1 then min(paper_abstract) else arg_max(coalesce(paper_abstract, ''), length(coalesce(paper_abstract, '')) * 1000000000 - o) end as paper_abstract,
    len(arg_max(paper_authors, len(paper_authors) * 1000000000 - o)) as n_authors,
    case when count(*) = 1 then min(paper_code) else coalesce(arg_min(paper_code, o) filter (where {REAL}), '#') end as paper_code, min(o) % 100000000 as seq
  from (select *, seq + case when seq % 4 = 0 then 0 else 100000000 end as o from raw where conf in (select conf from raw where seq % 4 = 0)) where trim(paper_url) <> '' group by 1, 2)
  union all select conf, paper_name, paper_url, paper_abstract, len(paper_authors), paper_code, seq from raw
  where (seq % 4 <> 0 and conf not in (select conf from raw where seq % 4 = 0)) or (trim(paper_url) = '' and conf in (select conf from raw where seq % 4 = 0))""", over="raw")  # fmt: skip
def d3_rows(spark, sf):
    r = raw(spark, sf)
    out = merge.merge_incremental(r.filter("seq % 4 = 0"), r.filter("seq % 4 <> 0"))
    return out.select("conf", "paper_name", "paper_url", "paper_abstract", F.size("paper_authors").alias("n_authors"), "paper_code", "seq")


@query("d3_merge_stored", ORACLES["d3_merged_rows"], over="")
def d3_stored(spark, sf):
    """D3 on a corpus in buckets of conferences: only touched buckets are read and written, and all are read back."""
    r, path = raw(spark, sf), scratch(spark, "corpus")
    corpus.create_corpus(r.filter("seq % 4 <> 0"), path, buckets=16)
    corpus.merge_into(r.filter("seq % 4 = 0"), path)
    out = corpus.read_corpus(spark, path)
    return out.select("conf", "paper_name", "paper_url", "paper_abstract", F.size("paper_authors").alias("n_authors"), "paper_code", "seq")


@query("d5_official_titles", f"""select r.conf, count(*) filter (where k.t is not null) as matched, count(*) filter (where k.t is null) as new from (select conf, paper_name, {key('paper_name')} as t from raw where seq % 3 = 0) r
  left join (select distinct conf, {key('paper_name')} as t from raw where seq % 5 <> 0) k on k.conf = r.conf and k.t = r.t where r.t <> '' group by r.conf""", over="raw")  # fmt: skip
def d5_titles(spark, sf):
    r = raw(spark, sf)
    return merge.official_titles(r.filter("seq % 5 <> 0"), r.filter("seq % 3 = 0"))


@query("d6_catalog_merge", "select conf as name, count(*) as n from (select distinct conf from raw) group by conf", over="raw")
def d6(spark, sf):
    c = catalog(spark, sf)
    half = F.pmod("pos", F.lit(2)) == 0
    return merge.catalog_merge(c.filter(half), c).groupBy("name").agg(F.count("*").alias("n"))


@query("d7_catalog_new", """select conf as name from (select distinct conf from raw) where cast(right(conf, 4) as int) between 2000 and 2015 and left(conf, length(conf) - 4) in ('ACL', 'KDD', 'CHI', 'ICML')
  and cast(right(conf, 4) as int) % 2 = 1""", over="raw")  # fmt: skip
def d7(spark, sf):
    c = catalog(spark, sf)
    known = c.filter(F.right("name", F.lit(4)).cast("int") % 2 == 0).withColumn("url", F.concat(F.replace("url", F.lit("https"), F.lit("http")), F.lit("/")))
    return merge.catalog_new(c.select("name", "url"), known, 2000, 2015, ["ACL", "KDD", "CHI", "ICML"]).select("name")


@query("d8_dominant_id_prefix", """select conf as event, y || '.acl' as tag from (select conf, right(conf, 4) as y, bool_or(starts_with(paper_url, 'https://aclanthology.org/')) as m from raw group by conf) where m""", over="raw")
def d8(spark, sf):
    r = raw(spark, sf).filter(C.canonical_host(F.col("paper_url")) == "aclanthology.org")
    ids = r.select(F.col("conf").alias("event"), F.lit("ACL").alias("venue"), F.right("conf", F.lit(4)).cast("int").alias("year"), F.regexp_extract("paper_url", "([^/]+)$", 1).alias("id"))
    return merge.dominant_id_prefix(ids)


# Ledger
@query("l1_ledger_latest", "select url, status, attempts, chars, ts, seq from state", over="ledger")
def l1(spark, sf):
    return state(spark, sf).select("url", "status", "attempts", "chars", "ts", "seq")


@query("l2_ledger_append", """, prev as (select * from ledger where seq % 2 = 0 qualify row_number() over (partition by url order by seq desc) = 1)
  select s.url, s.seq from state s left join prev p on s.url = p.url where p.url is null or (s.status, s.source, s.chars, s.attempts, s.reason, s.ts) is distinct from (p.status, p.source, p.chars, p.attempts, p.reason, p.ts)""", over="ledger")  # fmt: skip
def l2(spark, sf):
    e = adapters.ledger_events(spark, sf)
    return ledger.ledger_append(ledger.ledger_latest(e), ledger.ledger_latest(e.filter("seq % 2 = 0"))).select("url", "seq")


@query("l3_needs_compaction", "select count(*) as physical, count(distinct url) as live, count(*) > 2.0 * count(distinct url) as compact from ledger", over="ledger")
def l3(spark, sf):
    return ledger.needs_compaction(adapters.ledger_events(spark, sf))


@query("l4_ledger_apply", """, o as (select url, status = 'success' as ok, source, chars, reason, ts from ledger where seq % 3 = 0 qualify row_number() over (partition by url order by seq desc) = 1),
  s as (select * from ledger where seq % 3 <> 0 qualify row_number() over (partition by url order by seq desc) = 1),
  r as (select *, case when reason like '%429%' then 'rate_limited' when reason like '%timeout%' then 'timeout' else 'network' end as rr from o)
  select coalesce(s.url, r.url) as url, case when r.url is null then s.status when ok then 'success' else 'failed' end as status,
    case when r.url is null then s.attempts when ok then 0 else coalesce(s.attempts, 0) end as attempts, case when r.url is null then s.reason when not ok then rr end as reason,
    case when r.url is null then s.chars when ok then r.chars end as chars, coalesce(r.ts, s.ts) as ts from s full join r on s.url = r.url""", over="ledger")  # fmt: skip
def l4(spark, sf):
    e = adapters.ledger_events(spark, sf)
    out = ledger.ledger_latest(e.filter("seq % 3 = 0")).select("url", (F.col("status") == "success").alias("ok"), "source", "chars", "reason", "ts")
    return ledger.ledger_apply(ledger.ledger_latest(e.filter("seq % 3 <> 0")), out).select("url", "status", "attempts", "reason", "chars", "ts")


@query("l5_demote_short", """select url, case when status = 'success' and chars < 60 then 'failed' else status end as status, case when status = 'success' and chars < 60 then 'empty_abstract' else reason end as reason,
  case when status = 'success' and chars < 60 then true else rescued end as rescued, case when status = 'success' and chars < 60 then 0 else attempts end as attempts from state""", over="ledger")  # fmt: skip
def l5(spark, sf):
    return ledger.demote_short(state(spark, sf))[0].select("url", "status", "reason", "rescued", "attempts")


@query("l6_purge_venue_index", "select url from state where not regexp_matches(url, '0$')", over="ledger")
def l6(spark, sf):
    s = state(spark, sf)
    return ledger.purge_venue_index(s.withColumn("own", F.col("url")).withColumn("url", F.when(F.col("url").endswith("0"), "https://openreview.net/forum").otherwise(F.col("url"))))[0].select(F.col("own").alias("url"))


@query("l7_ledger_report", """select 'total' as kind, 'all' as key, count(*) as n from state union all select 'status', status, count(*) from state group by status union all select 'month', left(ts, 7), count(*) from state group by 2
  union all select 'host', 'doi.org', count(*) from state where status = 'failed' having count(*) > 0
  union all select 'reason', case when reason is null then '(unspecified)' when reason like '%429%' then 'rate_limited' else 'timeout' end, count(*) from state where status = 'failed' group by 2""", over="ledger")  # fmt: skip
def l7(spark, sf):
    return ledger.ledger_report(state(spark, sf))


@query("l9_final_reason", """select url, case when spec is not null then spec when doi then case when mm then 'title_mismatch' else 'empty_abstract' end when not title then 'no_doi' when mm then 'title_mismatch' else 'no_abstract_available' end as reason, last_source from (
  select url, arg_max(reason, seq) filter (where seq % 17 = 0 and reason is not null) as spec, bool_or(seq % 3 = 0) as title, bool_or(seq % 5 = 0) as doi, coalesce(bool_or(reason = 'title_mismatch'), false) as mm, arg_max(event_type, seq) as last_source
  from (select 'https://doi.org/10.1/' || user_id as url, event_id as seq, event_type, case event_id % 4 when 0 then 'title_mismatch' when 1 then 'timeout' end as reason from events) group by url)""", over="")  # fmt: skip
def l9(spark, sf):
    e = adapters.table(spark, sf, "events")
    n = F.col("event_id")
    reason = F.when(n % 4 == 0, "title_mismatch").when(n % 4 == 1, "timeout")
    a = e.select(
        F.concat(F.lit("https://doi.org/10.1/"), F.col("user_id").cast("string")).alias("url"), n.alias("seq"), F.col("event_type").alias("source"), reason.alias("reason"),
        (n % 17 == 0).alias("host_specific"), (n % 3 == 0).alias("has_title"), (n % 5 == 0).alias("has_doi"),
    )
    return ledger.final_reason(a)


# Work lists: papers whose url leads into the ledger
def urls(spark, sf):
    return papers(spark, sf).withColumn("url", F.concat(F.lit("https://doi.org/10.1/"), (F.col("seq") % 120).cast("string")))


W = "(select * replace ('https://doi.org/10.1/' || (seq % 120) as url) from papers)"
EMPTY = "trim(p.abstract) = ''"
_PENDING = {
    "default": "s.status is null", "force": "s.status is distinct from 'success'", "partial": f"s.status is distinct from 'success' or {EMPTY}",
    "failed": "s.status = 'failed' and s.attempts < 3 and (s.reason is null or s.reason in ('read timeout'))",
}


@query("w1_pending", " union all ".join(f"select '{m}' as mode, p.id from {W} p left join state s on p.url = s.url where {c}" for m, c in _PENDING.items()), over="both")
def w1(spark, sf):
    p, s = urls(spark, sf), state(spark, sf)
    legs = [worklist.pending(p, s, m, ["read timeout"]).select(F.lit(m).alias("mode"), "id") for m in _PENDING]
    return legs[0].unionByName(legs[1]).unionByName(legs[2]).unionByName(legs[3])


@query("w2_batch_skip", f"select p.id from {W} p left join state s on p.url = s.url where not coalesce(s.status = 'success' and not ({EMPTY}), false) and not coalesce(s.status = 'failed' and s.attempts >= 3, false)", over="both")
def w2(spark, sf):
    return worklist.batch_skip(urls(spark, sf), state(spark, sf)).select("id")


@query("w3_doi_targets", f"select '10.1/' || (p.seq % 120) as doi, arg_min(p.id, p.seq) as id from {W} p join state s on p.url = s.url and s.status = 'failed' where {EMPTY} group by 1", over="both")
def w3(spark, sf):
    return worklist.doi_targets(urls(spark, sf), state(spark, sf)).select("doi", "id")


@query("w4_title_targets", "select p.id from papers p where trim(p.abstract) = '' and p.title <> '' and p.seq % 2 = 0 and regexp_extract(lower(p.url), '://(?:www\\.)?([^/]*)', 1) not in ('doi.org', 'ijcai.org')")
def w4(spark, sf):
    p = papers(spark, sf)
    failed = p.filter("seq % 2 = 0").select("url", F.lit("failed").alias("status"))
    odd = p.filter("seq % 2 = 0")
    return worklist.title_targets(odd, failed, ["ijcai.org"]).select("id")


@query("w4_title_targets_whole", """select p.id from papers p where trim(p.abstract) = '' and p.title <> '' and p.url in (select url from papers where seq % 2 = 0)
  and regexp_extract(lower(p.url), '://(?:www\\.)?([^/]*)', 1) not in ('doi.org', 'ijcai.org')""")  # fmt: skip
def w4_whole(spark, sf):
    """All papers whose url failed, also those that share it with the paper that brought it into the ledger."""
    p = papers(spark, sf)
    failed = p.filter("seq % 2 = 0").select("url", F.lit("failed").alias("status"))
    return worklist.title_targets(p, failed.distinct(), ["ijcai.org"]).select("id")


@query("w5_api_targets", "select id, trim(abstract) = '' as no_abstract, trim(code) in ('', '#') as no_code from papers where (trim(abstract) = '' or trim(code) in ('', '#')) and title <> '' and year = 2010")
def w5(spark, sf):
    none = spark.createDataFrame([], "key string, terminal boolean, attempts int")
    return worklist.api_targets(papers(spark, sf), none, year=2010).select("id", "no_abstract", "no_code")


@query("w6_host_targets", f"""select id, url as fetch_url from papers where trim(abstract) = '' and {HOST.format(u='url')} = 'openreview.net'
  union all select p.id, o.u from papers p join (select {key('title')} as t, min('https://openreview.net/forum?id=o' || seq) as u from papers where seq % 3 = 0 group by 1 having count(*) = 1) o on {key('p.title')} = o.t
  where trim(p.abstract) = '' and {HOST.format(u='p.url')} <> 'openreview.net' and o.t <> ''""")  # fmt: skip
def w6(spark, sf):
    p = papers(spark, sf)
    official = p.filter("seq % 3 = 0").select("title", F.concat(F.lit("https://openreview.net/forum?id=o"), F.col("seq").cast("string")).alias("url")).filter(C.plain_title_key(F.col("title")) != "")
    return worklist.host_targets(p, spark.createDataFrame([], "url string"), "openreview.net", official)


_TIERS = " union all ".join(f"select '{v}' as v, {t} as t" for t, vs in C.TIERS.items() for v in vs)


@query("w7_rank_confs", f"""select conf, total, has, empty, doi_empty, tier, row_number() over (order by tier, doi_empty / empty desc, empty desc, conf) as rank from (
  select conf, count(*) as total, count(*) filter (where trim(abstract) <> '') as has, count(*) filter (where trim(abstract) = '') as empty,
    count(*) filter (where trim(abstract) = '' and url like 'https://doi.org/%') as doi_empty from papers group by conf) p
  join (select c.conf as c, coalesce(max_by(t, length(v)), 4) as tier from (select distinct conf from papers) c left join ({_TIERS}) k on starts_with(c.conf, k.v) group by c.conf) t on p.conf = t.c where empty > 0""")  # fmt: skip
def w7(spark, sf):
    return worklist.rank_confs(papers(spark, sf))


@query("w8_budget", """, r as (select conf, row_number() over (order by conf) as rank from (select distinct conf from papers)),
  x as (select p.id, row_number() over (order by r.rank, p.seq) as n from papers p join r using (conf)) select id from x where n <= 150""")  # fmt: skip
def w8(spark, sf):
    from pyspark.sql import Window

    p = papers(spark, sf).select("id", "conf", "seq")
    ranked = p.select("conf").distinct().withColumn("rank", F.row_number().over(Window.orderBy("conf")))
    return worklist.budget(p, ranked, 150).select("id")


@query("w9_collect_due", """select conf as name from (select distinct conf, cast(right(conf, 4) as int) as y from raw) where (y % 3 = 0) or (y % 3 = 1 and y % 2 = 0)""", over="raw")
def w9(spark, sf):
    c = catalog(spark, sf).select(F.lit("acl").alias("source"), "name", "url", F.right("name", F.lit(4)).cast("int").alias("y"))
    seen = c.filter("y % 3 <> 0").select("source", "url", F.when(F.col("y") % 2 == 0, "2024-01-01").otherwise("2024-05-20").alias("ts"), (F.col("y") % 3 == 1).alias("empty"))
    return worklist.collect_due(c, seen, c.limit(0).select("name"), "2024-06-01", []).select("name")


@query("w10_sample_strata", "select (case when year < 2010 then 'old' else 'new' end) as stratum, least(count(*), case when stratum = 'old' then 36 else 12 end) as n from papers group by 1")
def w10(spark, sf):
    out = worklist.sample_strata(papers(spark, sf), {"old": (F.col("year") < 2010, 18), "new": (F.lit(True), 6)}, 48, 42, scratch(spark, "strata"))
    return out.groupBy("stratum").agg(F.count("*").alias("n"))


@query("a15_conf_outcomes", f"""select p.conf, count(*) as total, count(*) filter (where s.status = 'success') as success, count(*) filter (where s.status = 'failed') as failed, count(*) filter (where s.status is null) as pending
  from {W} p left join state s on p.url = s.url group by p.conf""", over="both")  # fmt: skip
def a15(spark, sf):
    return stats.conf_outcomes(urls(spark, sf), state(spark, sf))

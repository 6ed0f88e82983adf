"""Queries over derived columns and filters."""

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import predicates as P
from ..operators import adapters, stats, worklist
from .common import query, raw

HOST = "regexp_replace(regexp_extract(lower(trim({u})), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^www\\.', '')"
PATH = "regexp_extract(trim({u}), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
H, PA = HOST.format(u="paper_url"), PATH.format(u="paper_url")
DOI = f"case when ({H} = 'doi.org' or {H} like '%.doi.org') and trim({PA}, '/') <> '' then trim({PA}, '/') end"
KIND = f"""case
  when {H} = 'aclanthology.org' then case when {PA} in ('', '/') or regexp_matches({PA}, '^/[0-9]{{4}}\\.[A-Za-z0-9-]+\\.0/?$|^/(volumes|events)/') then 'venue-index'
    when regexp_matches({PA}, '^/([0-9]{{4}}\\.[A-Za-z0-9-]+\\.0*[1-9][0-9]*|[A-Za-z][0-9]{{2}}-[0-9]+)/?$') then 'paper' else 'unknown' end
  when {H} = 'openreview.net' then case when {PA} in ('/forum', '/pdf') and regexp_matches(paper_url, '[?&]id=[^&]') then 'paper' else 'venue-index' end
  when {H} = 'ijcai.org' then case when regexp_matches({PA}, '^/proceedings/[0-9]{{4}}/[0-9]+/?$') then 'paper' when {PA} in ('', '/') or regexp_matches({PA}, '^/proceedings(/[0-9]{{4}})?/*$') then 'venue-index' else 'unknown' end
  else 'unknown' end"""
NORM_URL = f"'https://' || {H} || rtrim(case when {H} = 'openreview.net' then lower({PA}) else {PA} end, '/') || case when {H} = 'openreview.net' then '?id=' || regexp_extract(paper_url, 'id=(.*)$', 1) else '' end"
REAL = "trim(coalesce(paper_code, '')) not in ('', '#')"
FRONT = "(?i)^(proceedings\\b|front matter|frontmatter|table of contents|preface\\b|findings of the association)"


def key(title: str) -> str:
    return f"regexp_replace(lower(trim({title})), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', '', 'g')"


@query("c1_conf_parts", """select seq, upper(trim(regexp_extract(conf, '^(.*?)([0-9]{4}|$)', 1))) as series, cast(regexp_extract(conf, '[0-9]{4}') as int) as year,
  regexp_extract(conf, '^([A-Za-z]+)[0-9]{4}', 1) as stats_series, regexp_extract(conf, '^[A-Za-z]+([0-9]{4})', 1) as stats_year,
  regexp_replace(conf, '[0-9]{4}$', '') as stem, cast(regexp_extract(conf, '([0-9]{4})$', 1) as int) as last_year from raw""", over="raw")  # fmt: skip
def c1(spark, sf):
    c = F.col("conf")
    names = ["series", "year", "stats_series", "stats_year", "stem", "last_year"]
    return raw(spark, sf).select("seq", *(x.alias(n) for x, n in zip([*C.search_parts(c), *C.stats_parts(c), *C.trailing_parts(c)], names, strict=True)))


@query("c2_normalise_text", "select seq, trim(regexp_replace(replace(lower(paper_abstract), '-', ' '), '\\s+', ' ', 'g')) as t from raw", over="raw")
def c2(spark, sf):
    return raw(spark, sf).select("seq", C.normalise_text(F.col("paper_abstract")).alias("t"))


@query("c3_c5_c6_url_parts", f"""select seq, {H} as host, {DOI} as doi, nullif(regexp_extract(paper_url, 'openreview\\.net/(?:forum|pdf)\\?.*?\\bid=([\\w-]+)', 1), '') as submission,
  nullif(regexp_extract(paper_url, 'arxiv\\.org/(?:abs|pdf)/([0-9]{{4}}\\.[0-9]{{4,5}})', 1), '') as arxiv from raw""", over="raw")  # fmt: skip
def c3(spark, sf):
    u = F.col("paper_url")
    return raw(spark, sf).select("seq", C.canonical_host(u).alias("host"), C.doi_of(u).alias("doi"), C.submission_id(u).alias("submission"), C.arxiv_id(u).alias("arxiv"))


@query("c4_classify_url", f"select seq, {KIND} as kind from raw", over="raw")
def c4(spark, sf):
    return raw(spark, sf).select("seq", C.classify_url(F.col("paper_url")).alias("kind"))


@query("c7_normalise_url", f"select seq, {NORM_URL} as u from raw", over="raw")
def c7(spark, sf):
    return raw(spark, sf).select("seq", C.normalise_url(F.col("paper_url")).alias("u"))


@query("c8_identity_keys", f"""select seq, kind, key from (
  select seq, 'openreview' as kind, regexp_extract(paper_url, 'id=([A-Za-z0-9_-]+)', 1) as key from raw where {H} = 'openreview.net'
  union all select seq, 'acl', lower(regexp_extract(paper_url, '([^/]*)$', 1)) from raw where {H} = 'aclanthology.org'
  union all select seq, 'doi', lower(trim({PA}, '/')) from raw where {H} = 'doi.org'
  union all select seq, 'ijcai', regexp_extract(paper_url, 'proceedings/([0-9]+)/', 1) || ':' || try_cast(regexp_extract(paper_url, '/([0-9]+)$', 1) as int) from raw where {H} = 'ijcai.org'
  union all select seq, 'url', {NORM_URL} from raw) where key <> ''""", over="raw")  # fmt: skip
def c8(spark, sf):
    return raw(spark, sf).select("seq", F.explode(C.identity_keys(F.col("paper_url"))).alias("k")).select("seq", "k.kind", "k.key")


@query("c9_title_key", f"select seq, {key('paper_name')} as k from raw", over="raw")
def c9(spark, sf):
    return raw(spark, sf).select("seq", C.title_key(F.col("paper_name")).alias("k"))


@query("c9_title_key_unicode")
def c9u(spark, sf):
    t = F.col("paper_name")
    return raw(spark, sf).select("seq", *(C.title_key(t, m).alias(m) for m in ("nfkc", "cvf", "miccai", "ijcai")))


@query("c10_clean_abstract", r"""select seq, trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(paper_abstract, '<[^>]+>', '', 'g')), '-\r?\n\s*', '', 'g'), '\r?\n\s*([a-z0-9])', ' \1', 'g'), '\s+', ' ', 'g')) as t from raw""", over="raw")
def c10(spark, sf):
    return raw(spark, sf).select("seq", C.clean_abstract(F.col("paper_abstract")).alias("t"))


@query("c11_clean_tex_abstract")
def c11(spark, sf):
    return raw(spark, sf).select("seq", C.clean_tex_abstract(F.concat(F.lit(r"\emph{On} "), F.col("paper_name"), F.lit(r" with $\alpha$ and \'{e}"))).alias("t"))


@query("c12_c14_code_links", """select seq, code as link, code as url, case when code = '' then 'empty' else '' end as reason, code as repo
  from (select seq, case when paper_code = '#' then '' else paper_code end as code from raw)""", over="raw")  # fmt: skip
def c12(spark, sf):
    c = F.col("paper_code")
    cls = C.classify_code_url(c)
    text = F.concat(F.lit("see "), c, F.lit("."))
    return raw(spark, sf).select("seq", C.github_link(text).alias("link"), cls["url"].alias("url"), cls["reason"].alias("reason"), C.normalise_repo(c).alias("repo"))


@query("c15_normalise_reason", "select seq, case when reason like '%429%' then 'rate_limited' when reason like '%timeout%' then 'timeout' else 'network' end as reason from ledger", over="ledger")
def c15(spark, sf):
    return adapters.ledger_events(spark, sf).select("seq", C.normalise_reason(F.col("reason")).alias("reason"))


@query("c16_unwrap_archive", "select seq, nullif(regexp_extract(paper_url, 'web\\.archive\\.org/web/[0-9]+/(https?://.+)$', 1), '') as inner_url from raw", over="raw")
def c16(spark, sf):
    return raw(spark, sf).select("seq", C.unwrap_archive_url(F.col("paper_url")).alias("inner_url"))


_TIERS = " union all ".join(f"select '{v}' as v, {t} as t" for t, vs in C.TIERS.items() for v in vs)
_FIELDS = " union all ".join(f"select '{v}' as v, '{f}' as f" for f, vs in stats.FIELD_VENUES.items() for v in vs)


@query("c17_venue_tier", f"""select c.conf, coalesce(max_by(t, length(v)), 4) as tier from (select distinct conf from raw) c
  left join ({_TIERS}) k on starts_with(regexp_replace(c.conf, '[0-9]{{4}}$', ''), k.v) group by c.conf""", over="raw")  # fmt: skip
def c17(spark, sf):
    return raw(spark, sf).select("conf").distinct().withColumn("tier", stats.venue_tier(F.col("conf")))


@query("c18_field_of", f"select seq, coalesce(f, '{stats.OTHER}') as field from raw left join ({_FIELDS}) d on regexp_replace(conf, '[0-9]{{4}}$', '') = d.v", over="raw")
def c18(spark, sf):
    return stats.field_of(raw(spark, sf).select("seq", "conf")).select("seq", "field")


@query("c19_author_surnames")
def c19(spark, sf):
    return raw(spark, sf).select("seq", F.concat_ws("|", C.author_surnames(F.col("paper_authors"))).alias("names"))


@query("c20_route", f"""select seq, case when {KIND} = 'venue-index' then 'venue_index' when {H} in ('openreview.net') then 'delegated'
  when {H} in ('aclanthology.org', 'ijcai.org') then 'registered_host' when {DOI} is not null then 'doi' when lower({PA}) like '%.pdf' then 'pdf' when paper_name <> '' then 'title_only' else 'nothing' end as route from raw""", over="raw")  # fmt: skip
def c20(spark, sf):
    return raw(spark, sf).select("seq", worklist.route(F.col("paper_url"), F.col("paper_name")).alias("route"))


#: Titles of front matter and volumes among the raw rows, so that the filters have something to find.
MARKED = "case seq % 11 when 0 then 'Proceedings of ' || conf when 1 then 'Preface' when 2 then 'ACL Conference: Author Index' else paper_name end"
PROC = f"""((regexp_matches(t, '(?i)^proceedings\\b') and {H} = 'doi.org' and regexp_matches({PA}, '^/10\\.1145/[0-9]+$'))
  or (t = 'ACL Conference: Author Index' and {H} = 'aclanthology.org') or ((regexp_matches(t, '(?i)^proceedings\\b') or t = 'ACL Conference: Author Index') and {KIND} = 'venue-index'))"""
MARKED_SQL = f"(select * exclude (paper_name), {MARKED} as t, case when seq % 22 = 1 then ['A. Editor (eds.)'] else paper_authors end as au from raw)"


def marked(spark, sf):
    t = F.when(F.col("seq") % 11 == 0, F.concat(F.lit("Proceedings of "), "conf")).when(F.col("seq") % 11 == 1, "Preface").when(F.col("seq") % 11 == 2, "ACL Conference: Author Index").otherwise(F.col("paper_name"))
    authors = F.when(F.col("seq") % 22 == 1, F.array(F.lit("A. Editor (eds.)"))).otherwise(F.col("paper_authors"))
    return raw(spark, sf).withColumn("paper_name", t).withColumn("paper_authors", authors)


@query("f1_is_proceedings", f"select seq, {PROC} as volume from {MARKED_SQL}", over="raw")
def f1(spark, sf):
    return marked(spark, sf).select("seq", P.is_proceedings().alias("volume"))


@query("f2_drop_on_collect", f"select seq from {MARKED_SQL} where not ({PROC} or (regexp_matches(t, '{FRONT}') and ({KIND} = 'venue-index' or len(au) = 0 or seq % 22 = 1)))", over="raw")
def f2(spark, sf):
    return P.drop_on_collect(marked(spark, sf)).select("seq")


@query("f3_drop_frontmatter", f"""select conf, count(*) as removed from {MARKED_SQL} where {PROC} or (regexp_matches(t, '{FRONT}') and ({KIND} = 'venue-index' or (paper_abstract = '' and not ({REAL})))) group by conf""", over="raw")
def f3(spark, sf):
    return P.drop_frontmatter(marked(spark, sf))[2]


@query("f4_accepted_venue", """select doc_id, (v like '%poster%' or v like '%oral%') and v not like '%submitted%' as ok
  from (select doc_id, case doc_id % 4 when 0 then 'iclr poster' when 1 then 'submitted to oral' when 2 then 'iclr oral' else 'workshop' end as v from documents)""", over="")  # fmt: skip
def f4(spark, sf):
    d = adapters.table(spark, sf, "documents").select("doc_id")
    v = F.element_at(F.array(*map(F.lit, ["ICLR poster", "Submitted to oral", "ICLR oral", "workshop"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select("doc_id", P.accepted_venue(v).alias("ok"))


@query("f5_filter_conf", "select seq from raw where regexp_matches(conf, '^IC.*20[0-9]5$') or lower(conf) = 'acl2001' or regexp_matches(lower(conf), '^kdd')", over="raw")
def f5(spark, sf):
    c = F.col("conf")
    globs = P.any_true(P.conf_matches(c, f"IC*20{d}5") for d in range(10))
    return raw(spark, sf).filter(globs | P.conf_matches(c, "acl2001, kdd*")).select("seq")


@query("f6_filter_phase", f"""select seq, case when {DOI} is not null then '1' when regexp_replace(conf, '[0-9]{{4}}$', '') in ({', '.join(f"'{c}'" for c in C.CORE_CONFS)}) then '2' else '3' end as phase from raw""", over="raw")
def f6(spark, sf):
    r = raw(spark, sf)
    legs = [r.filter(P.in_phase(p, F.col("conf"), F.col("paper_url"))).select("seq", F.lit(p).alias("phase")) for p in "123"]
    return legs[0].unionByName(legs[1]).unionByName(legs[2])


@query("f7_missing", f"select seq, trim(paper_abstract) = '' as no_abstract, not ({REAL}) as no_code from raw", over="raw")
def f7(spark, sf):
    return raw(spark, sf).select("seq", P.missing("abstract").alias("no_abstract"), P.missing("code").alias("no_code"))

"""Queries over search, facets, statistics and deltas."""

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import predicates as P
from ..operators import search as S
from ..operators import stats as A
from .column_queries import _FIELDS, HOST
from .common import papers, query, raw, scratch

N = lambda c: f"trim(regexp_replace(replace(lower({c}), '-', ' '), '\\s+', ' ', 'g'))"
HAS = lambda c, w: f"contains({N(c)}, '{w}')"
MATCH = f"(({HAS('title', 'the')} and {HAS('title', 'on')}) or ({HAS('abstract', 'the')} and {HAS('abstract', 'on')}))"
SCORE = " + ".join(f"case when {HAS(c, w)} then {k} else 0 end" for c, k in (("title", 3), ("abstract", 1)) for w in ("the", "on"))
REAL = "trim(code) not in ('', '#')"
U = HOST.format(u="url")
FIELD = f"(select p.*, coalesce(f, '{A.OTHER}') as field from papers p left join ({_FIELDS}) d on p.conf = d.v)"


@query("i4_materialise_papers", "select id, conf, year, title, url, authors_text, code, seq, len(authors) as n_authors from papers")
def i4(spark, sf):
    return papers(spark, sf).select("id", "conf", "year", "title", "url", "authors_text", "code", "seq", F.size("authors").alias("n_authors"))


_T = lambda c: f"replace(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), '-', ' ')"


def _bm25(*words: str) -> str:
    """Phrases in title and abstract; the words don't overlap themselves, so replace() counts them."""
    keys = [(c, w) for c in "tb" for w in words]
    part = lambda c, w: f"(case when i_{c}{w} <= 0 then 1e-6 else i_{c}{w} end) * {3 if c == 't' else 1} * h_{c}{w} * 2.2 / ({3 if c == 't' else 1} * h_{c}{w} + 1.2 * (0.25 + 0.75 * size / mean))"
    each = lambda c: f"case when {' and '.join(f'h_{c}{w} > 0' for w in words)} then {' + '.join(part(c, w) for w in words)} else 0 end"
    return f""", w as (select id, {_T('title')} as t, {_T('authors_text')} as a, {_T('abstract')} as b from papers),
  f as (select id, greatest(length(t) - 2, 0) + greatest(length(a) - 2, 0) + greatest(length(b) - 2, 0) as size,
    {', '.join(f"(length({c}) - length(replace({c}, '{w}', ''))) // {len(w)} as h_{c}{w}" for c, w in keys)} from w),
  s as (select count(*) as n, avg(size) as mean, {', '.join(f'count(*) filter (where h_{c}{w} > 0) as d_{c}{w}' for c, w in keys)} from f),
  l as (select n, mean, {', '.join(f'ln((n - d_{c}{w} + 0.5) / (d_{c}{w} + 0.5)) as i_{c}{w}' for c, w in keys)} from s),
  bm as (select id, round({each('t')} + {each('b')}, 12) as bm25 from f, l)"""


@query("s1_search", f"""{_bm25('the')} select row_number() over (order by score desc, year desc, bm25 desc, id) as rank, id, title, conf, year, score
  from (select p.*, bm25, {SCORE} as score from papers p join bm using (id) where {MATCH} and year >= 2000) order by score desc, year desc, bm25 desc, id limit 20 offset 20""")  # fmt: skip
def s1(spark, sf):
    page, _ = S.search(papers(spark, sf), "the on", since=2000, page=2, size=20)
    return page.select("rank", "id", "title", "conf", "year", "score")


@query("s2_s3_match", f"select id, {SCORE} as score from papers where {MATCH}")
def s2(spark, sf):
    return papers(spark, sf).filter(S.token_match("The ON")).select("id", S.relevance("The ON").alias("score"))


@query("s2_any_field", f"select id from papers where {' or '.join(f'({HAS(c, 'en')} and {HAS(c, 'de')})' for c in ('title', 'abstract', 'authors_text'))}")
def s2_any(spark, sf):
    return papers(spark, sf).filter(S.token_match("en de", "any")).select("id")


@query("s1_total", f"select count(*) as total from papers where {MATCH}")
def s1_total(spark, sf):
    return S.search(papers(spark, sf), "the on")[1]


@query("s6_sort_conf", "select id, row_number() over (order by lower(conf), year desc, id) as place from papers")
def s6(spark, sf):
    # places by range: each conf's are numbered apart and moved by the rows before it
    from pyspark.sql import Window

    p = S.sorted_results(papers(spark, sf), "conf").select("id", "year", F.lower("conf").alias("c"))
    n = p.groupBy("c").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("year"), "id"))
    return p.withColumn("own", own).join(n.select("c", before.alias("before")), "c").select("id", (F.col("before") + F.col("own")).alias("place"))


@query("s7_union_legs", f"select id, year from papers where {HAS('title', 'ing')} or year = 2010 order by year desc, id limit 100")
def s7(spark, sf):
    p = papers(spark, sf)
    return S.union_legs([p.filter(S.token_match("ing", "title") & P.term("title", "ing")), p.filter(P.term("year", "2010"))], 100)[0].select("id", "year")


@query("s8_gram_index", f"""select gram, field, count(*) as n from (select distinct id, field, substr(f, i, 3) as gram from (
  select id, unnest(['title', 'abstract', 'authors_text']) as field, unnest([{N('title')}, {N('abstract')}, {N('authors_text')}]) as f from papers) t, range(1, 200000) r(i) where i <= length(f) - 2) group by gram, field""")  # fmt: skip
def s8(spark, sf):
    return S.build_gram_index(papers(spark, sf)).groupBy("gram", "field").agg(F.count("*").alias("n"))


@query("s9_narrowed_search", f"select id from papers where {HAS('title', 'tion')} or {HAS('abstract', 'tion')}")
def s9(spark, sf):
    p = papers(spark, sf)
    return S.narrowed_search(p, S.build_gram_index(p), "tion").select("id")


@query("s9_narrowed_by_author", f"select id from papers where (({HAS('title', 'the')} and {HAS('title', 'on')}) or ({HAS('abstract', 'the')} and {HAS('abstract', 'on')})) and ({HAS('authors_text', 'the')} or {HAS('authors_text', 'and')})")
def s9_author(spark, sf):
    p = papers(spark, sf)
    return S.narrowed_search(p, S.build_gram_index(p), "the on", author="the and").select("id")


@query("s10_bm25", f"{_bm25('the', 'and')} select id, bm25 from bm where bm25 > 0")
def s10(spark, sf):
    return S.bm25(papers(spark, sf), "the and")


@query("s10_bm25_of_index", f"{_bm25('the', 'and')} select id, bm25 from bm where bm25 > 0")
def s10_index(spark, sf):
    path = scratch(spark, "grams")
    S.write_gram_index(papers(spark, sf), path)
    return S.bm25_of_index(S.read_gram_index(spark, path), "the and")


@query("s11_get_by_ids", "select id, title from papers where seq < 40")
def s11(spark, sf):
    """A request for some known ids, an unknown one and repeats."""
    p = papers(spark, sf)
    asked = [r["id"] for r in p.filter("seq < 40").select("id").collect()]  # one request
    return S.get_by_ids(p, [*asked, "unknown", *asked[:3]])[0].select("id", "title")


@query("s12_apply_scores", """, r as (select id, row_number() over (order by id) as pos, seq from (select * from papers order by id limit 200)),
  x as (select *, case when seq % 3 = 0 then case when seq % 2 = 0 then (seq % 100) / 100.0 else (seq % 97)::double end end as s from r),
  y as (select *, case when s < 0 then 0.0 when s <= 1 then s when s <= 10 then s / 10 when s <= 100 then s / 100 end as u from x)
  select id, coalesce(u, 0.5)::double as relevance, row_number() over (order by (u is null), u desc, pos) as place from y""")  # fmt: skip
def s12(spark, sf):
    from pyspark.sql import Window

    top = papers(spark, sf).orderBy("id").limit(200).withColumn("pos", F.row_number().over(Window.orderBy("id")))
    score = F.when(F.col("seq") % 2 == 0, (F.col("seq") % 100) / 100).otherwise((F.col("seq") % 97).cast("double"))
    scores = top.filter("seq % 3 = 0").select(F.col("id").alias("paper_id"), score.alias("score"))
    return S.apply_scores(top.select("id", "pos"), scores).select("id", "relevance", "place")


@query("s12_apply_scores_whole", """, x as (select id, seq as pos, case when seq % 3 = 0 then case when seq % 2 = 0 then (seq % 100) / 100.0 else (seq % 97)::double end end as s from papers),
  y as (select *, case when s < 0 then 0.0 when s <= 1 then s when s <= 10 then s / 10 when s <= 100 then s / 100 end as u from x)
  select id, coalesce(u, 0.5)::double as relevance, row_number() over (order by (u is null), u desc, pos) as place from y""")  # fmt: skip
def s12_whole(spark, sf):
    """All papers in the order of seq, every third scored; places are numbered by range."""
    p = papers(spark, sf).select("id", F.col("seq").alias("pos"), "seq")
    score = F.when(F.col("seq") % 2 == 0, (F.col("seq") % 100) / 100).otherwise((F.col("seq") % 97).cast("double"))
    scores = p.filter("seq % 3 = 0").select(F.col("id").alias("paper_id"), score.alias("score"))
    return S.apply_scores(p.select("id", "pos"), scores, scratch(spark, "scores")).select("id", "relevance", "place")


JOINED = "lower(title || ' ' || abstract || ' ' || authors_text || ' ' || conf)"


@query("p1_p5_terms", f"""select id from papers where ((contains(lower(title), 'ing') or contains(lower(abstract), 'ement')) and year between 1999 and 2015
  and not exists (select 1 from (select unnest(authors) as a) where contains(lower(a), 'the'))) or contains({JOINED}, 'acl2')""")  # fmt: skip
def p1(spark, sf):
    p = (P.term("title", "ing") | P.any_of("abstract", ["ement", "ement"])) & P.year_range(2015, 1999) & P.negate(P.term("author", "The"))
    return papers(spark, sf).filter(p | P.term("topic", "ACL2")).select("id")


@query("p4_near", r"""select distinct id from (select id, w, i from (select id, list_filter(regexp_split_to_array(lower(abstract), '[^a-z0-9]+'), lambda x: x <> '') as ws from papers), lateral (select unnest(ws) as w, generate_subscripts(ws, 1) as i) where w in ('the', 'and')) a
  join (select id as id2, w as w2, i as i2 from (select id, list_filter(regexp_split_to_array(lower(abstract), '[^a-z0-9]+'), lambda x: x <> '') as ws from papers), lateral (select unnest(ws) as w, generate_subscripts(ws, 1) as i)) b
  on a.id = b.id2 and a.w = 'the' and b.w2 = 'and' and abs(i - i2) - 1 <= 2""")  # fmt: skip
def p4(spark, sf):
    return papers(spark, sf).filter(P.near("abstract", "the", "and", 2)).select("id")


@query("p6_rows_predicate", "select id from papers where ((contains(lower(title), 'ing') and contains(lower(abstract), 'and')) or (contains(lower(title), 'eau') and not contains(lower(abstract), 'des'))) and year >= 2003")
def p6(spark, sf):
    said = [("OR", "title", "ing"), ("AND", "abstract", "and"), ("OR", "title", "eau"), ("NOT", "abstract", "des"), ("AND", "since", 2003)]
    return papers(spark, sf).filter(P.rows_predicate([dict(zip(("op", "field", "value"), x, strict=True)) for x in said])).select("id")


@query("p7_p8_refine", f"""select id from papers where contains(lower(title || ' ' || authors_text || ' ' || abstract || ' ' || conf), 'tion') and trim(abstract) <> '' and {REAL}
  and year between 1998 and 2020 and ({HAS('authors_text', 'the')} or {HAS('authors_text', 'de')})""")  # fmt: skip
def p7(spark, sf):
    p = P.refine(papers(spark, sf), "Tion", True, True, (2020, 1998))
    return p.filter(P.search_filter(author="the de")).select("id")


@query("p7_refine_fields", f"select id from {FIELD} where field in ('Speech', 'Artificial Intelligence') and trim(abstract) <> ''")
def p7_fields(spark, sf):
    return P.refine(papers(spark, sf), with_abstract=True, fields=["Speech", "Artificial Intelligence"]).select("id")


@query("p9_saved_queries", """select 1 as query_id, count(*) as hits from papers where contains(lower(title), 'ing') and not contains(lower(abstract), 'des')
  union all select 2, count(*) from papers where contains(lower(title), 'eau') or (year = 2010 and contains(lower(authors_text), 'th')) union all select 3, 0""")  # fmt: skip
def p9(spark, sf):
    rows = [(1, 1, "title", False, "ing"), (1, 1, "abstract", True, "des"), (2, 1, "title", False, "eau"), (2, 2, "year", False, "2010"), (2, 2, "author", False, "th"), (3, 1, "title", False, "no such words")]
    return P.match_saved_queries(papers(spark, sf), spark.createDataFrame(rows, "query_id int, leg int, field string, negate boolean, value string"))


@query("a1_corpus_counts", "select count(*) as papers, count(distinct conf) as confs, min(year) as first_year, max(year) as last_year from papers")
def a1(spark, sf):
    return A.corpus_counts(papers(spark, sf))


@query("a2_conf_year_counts", "select conf, year, count(*) as n from papers group by conf, year union all select conf, null, count(*) from papers group by conf")
def a2(spark, sf):
    return A.conf_year_counts(papers(spark, sf))


@query("a3_result_tree", "select case when grouping(conf) = 1 then 0 when grouping(year) = 1 then 1 else 2 end as level, conf, year, count(*) as n from papers where year > 2005 group by rollup (conf, year)")
def a3(spark, sf):
    return A.result_tree(papers(spark, sf).filter("year > 2005"))


@query("a4_field_facet", f"select field, count(*) as n from {FIELD} group by field")
def a4(spark, sf):
    return A.field_facet(papers(spark, sf))


@query("a5_year_bounds", "select min(year) as first, max(year) as last from papers")
def a5(spark, sf):
    return A.year_bounds(papers(spark, sf))


@query("a6_coverage", f"select year, count(*) as total, count(*) filter (where trim(abstract) <> '') as with_abstract, count(*) filter (where {REAL}) as with_code, count(distinct conf) as series from papers group by year")
def a6(spark, sf):
    return A.coverage(papers(spark, sf), "year")


@query("a7_corpus_stats", f""", x as (select *, case when {REAL} then 1 else 0 end as c from {FIELD})
  select 'year' as kind, year::varchar as key, count(*) as n, sum(c)::bigint as with_code from x group by year union all select 'series', conf, count(*), sum(c)::bigint from x group by conf
  union all select 'field', field, count(*), sum(c)::bigint from x group by field""")  # fmt: skip
def a7(spark, sf):
    return A.corpus_stats(papers(spark, sf))


@query("a8_year_field_matrix", "select y as year, " + ", ".join(f"(select count(*) from {FIELD} where year = y and field = '{f}') as \"{f}\"" for f in [*A.FIELD_VENUES, A.OTHER]) + " from range(2000, (select max(year) + 1 from papers)) r(y)")
def a8(spark, sf):
    return A.year_field_matrix(papers(spark, sf))


@query("a9_series_summary", f"""select *, count(*) over (partition by field) as series_in_field, field <> '{A.OTHER}' as assigned from (select coalesce(f, '{A.OTHER}') as field, s as series, min(y) as first, max(y) as last, count(distinct y) as editions
  from (select regexp_extract(conf, '^([A-Za-z]+)', 1) as s, cast(regexp_extract(conf, '([0-9]{{4}})', 1) as int) as y from raw) left join ({_FIELDS}) d on s = d.v group by 1, 2)""", over="raw")  # fmt: skip
def a9(spark, sf):
    return A.series_summary(raw(spark, sf).select(F.col("conf").alias("name")).distinct())


@query("a9_series_totals", f"""select field, count(*) as series, sum(editions)::bigint as editions from (select coalesce(f, '{A.OTHER}') as field, s as series, count(distinct y) as editions
  from (select regexp_extract(conf, '^([A-Za-z]+)', 1) as s, cast(regexp_extract(conf, '([0-9]{{4}})', 1) as int) as y from raw) left join ({_FIELDS}) d on s = d.v group by 1, 2) group by rollup (field)""", over="raw")  # fmt: skip
def a9_totals(spark, sf):
    return A.series_totals(raw(spark, sf).select(F.col("conf").alias("name")).distinct())


@query("a10_top_series", "select conf, count(*) as n from papers group by conf order by n desc, conf limit 10")
def a10(spark, sf):
    return A.top_series(papers(spark, sf), 10)


@query("a11_missing_profile", f""", m as (select *, {U} as h from papers where trim(abstract) = ''), g as (
  select 'host' as kind, h as key, count(*) as n from m group by h union all select 'doi', case when h = 'doi.org' then 'doi' else 'other' end, count(*) from m group by 2
  union all select 'year', year::varchar, count(*) from m group by year union all select 'conf', conf, count(*) from m group by conf)
  select kind, key, n, n / sum(n) over (partition by kind) as share from g""")  # fmt: skip
def a11(spark, sf):
    return A.missing_profile(papers(spark, sf))


@query("a11_missing_report", f""", m as (select *, {U} as h from papers where trim(abstract) = ''), g as (
  select 'host' as kind, h as key, count(*) as n from m group by h union all select 'doi', case when h = 'doi.org' then 'doi' else 'other' end, count(*) from m group by 2
  union all select 'year', year::varchar, count(*) from m group by year union all select 'conf', conf, count(*) from m group by conf)
  select kind, key, n, n / sum(n) over (partition by kind) as share from g qualify kind in ('host', 'doi') or (kind = 'year' and row_number() over (partition by kind order by key) <= 10)
    or (kind = 'conf' and row_number() over (partition by kind order by n desc, key) <= 10)
  union all select 'all', 'missing', count(*) filter (where trim(abstract) = ''), count(*) filter (where trim(abstract) = '') / count(*) from papers""")  # fmt: skip
def a11_report(spark, sf):
    return A.missing_report(papers(spark, sf))


@query("a12_host_share", f"select host, n, 100 * n / sum(n) over () as percent, rank() over (order by n desc) as rank from (select {HOST.format(u='url')} as host, count(*) as n from pages group by 1)", over="")
def a12(spark, sf):
    from ..operators.adapters import table

    return A.host_share(table(spark, sf, "pages"))


BEFORE = "seq % 10 <> 0"


@query("a13_delta", f"""select a.conf, count(*) as new_papers, not exists (select 1 from raw b where {BEFORE} and b.conf = a.conf) as new_conf from (select distinct conf, paper_url from raw) a
  where not exists (select 1 from raw b where {BEFORE} and b.conf = a.conf and b.paper_url = a.paper_url) group by a.conf""", over="raw")  # fmt: skip
def a13(spark, sf):
    r = raw(spark, sf)
    return A.delta(r.filter(BEFORE), r)


@query("a14_run_summary", f""", x as (select count(*) as total, count(*) filter (where trim(abstract) <> '') as wa, count(*) filter (where {REAL}) as wc from papers where {BEFORE}),
  y as (select count(*) as total, count(*) filter (where trim(abstract) <> '') as wa, count(*) filter (where {REAL}) as wc from papers)
  select x.total as total_before, x.wa as with_abstract_before, x.wc as with_code_before, y.total as total_after, y.wa as with_abstract_after, y.wc as with_code_after,
  y.total - x.total as change, round(100 * x.wa / x.total, 2) as percent_before, round(100 * y.wa / y.total, 2) as percent_after from x, y""")  # fmt: skip
def a14(spark, sf):
    p = papers(spark, sf)
    return A.run_summary(p.filter(BEFORE), p)

"""The given tables as the tables of this library, and the same adapters as SQL text for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Venues of the adapter, each with its place
VENUES = "ACL NIPS CVPR ICML KDD SIGIR ICSE PLDI STOC CHI ICASSP TPAMI TKDE EMNLP AAAI IJCAI MICCAI SOSP CCS OTHERS".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conf, paper_name, paper_authors, paper_url, paper_abstract, paper_code, seq, from `documents`."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    title = F.trim(F.left(F.regexp_extract("text", r"^[^.\n]*", 0), F.lit(120)))
    d = d.select("doc_id", "text", title.alias("paper_name"))
    n, key = F.length("paper_name"), F.left(F.sha1("paper_name"), F.lit(10))
    year = 1998 + (n * 7) % 27
    venue = F.element_at(F.array(*map(F.lit, VENUES)), (n % 20 + 1).cast("int"))
    ym = year.cast("string")
    url = (
        F.when(n % 6 == 0, F.concat(F.lit("https://aclanthology.org/"), ym, F.lit(".acl-long."), (n + 1).cast("string")))
        .when(n % 6 == 1, F.concat(F.lit("https://doi.org/10.1145/"), key))
        .when(n % 6 == 2, F.concat(F.lit("https://openreview.net/forum?id="), key))
        .when(n % 6 == 3, F.concat(F.lit("https://www.ijcai.org/proceedings/"), ym, F.lit("/"), n.cast("string")))
        .when(n % 6 == 4, F.concat(F.lit("https://web.archive.org/web/2019/http://old.example.org/"), key))
        .otherwise(F.concat(F.lit("https://www.example.org/p/"), key, F.lit("/")))
    )
    return d.select(
        F.concat(venue, ym).alias("conf"),
        "paper_name",
        F.slice(F.filter(F.split("text", r"[ \n]+"), lambda w: w != ""), 1, 3).alias("paper_authors"),
        url.alias("paper_url"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")).alias("paper_abstract"),
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("https://github.com/lab/"), key)).otherwise("#").alias("paper_code"),
        F.col("doc_id").alias("seq"),
    )


_V = ", ".join(f"'{v}'" for v in VENUES)
RAW_SQL = rf"""
d0 as (select doc_id, coalesce(text, '') as text from documents),
d1 as (select doc_id, text, trim(left(regexp_extract(text, '^[^.\n]*', 0), 120)) as paper_name from d0),
d2 as (select *, length(paper_name) as n, left(sha1(paper_name), 10) as k, 1998 + (length(paper_name) * 7) % 27 as y from d1),
raw as (select ([{_V}])[(n % 20 + 1)::int] || y as conf, paper_name,
  list_filter(regexp_split_to_array(text, '[ \n]+'), lambda w: w <> '')[1:3] as paper_authors,
  case n % 6 when 0 then 'https://aclanthology.org/' || y || '.acl-long.' || (n + 1)
    when 1 then 'https://doi.org/10.1145/' || k when 2 then 'https://openreview.net/forum?id=' || k
    when 3 then 'https://www.ijcai.org/proceedings/' || y || '/' || n
    when 4 then 'https://web.archive.org/web/2019/http://old.example.org/' || k
    else 'https://www.example.org/p/' || k || '/' end as paper_url,
  case when doc_id % 5 = 0 then '' else text end as paper_abstract,
  case when doc_id % 7 = 0 then 'https://github.com/lab/' || k else '#' end as paper_code, doc_id as seq from d2)
"""

PAPERS_SQL = (
    RAW_SQL
    + r""",
p0 as (select sha1(upper(trim(regexp_extract(conf, '^(.*?)([0-9]{4}|$)', 1))) || '|' || regexp_extract(conf, '[0-9]{4}') || '|' || paper_name)[1:16] as id,
  upper(trim(regexp_extract(conf, '^(.*?)([0-9]{4}|$)', 1))) as conf, cast(regexp_extract(conf, '[0-9]{4}') as int) as year,
  paper_name as title, paper_url as url, paper_authors as authors, array_to_string(paper_authors, ' ') as authors_text,
  paper_abstract as abstract, paper_code as code, seq from raw),
papers as (select * from p0 qualify row_number() over (partition by id order by seq) = 1)
"""
)


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, status, source, chars, attempts, reason, last_source, rescued, ts, seq, from `events`."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    ok = F.col("event_type").isin("purchase", "click")
    return e.select(
        F.concat(F.lit("https://doi.org/10.1/"), F.col("user_id").cast("string")).alias("url"),
        F.when(ok, "success").otherwise("failed").alias("status"),
        F.when(ok, F.col("event_type")).alias("source"),
        F.when(ok, (F.coalesce(k, F.lit(0)) * 3).cast("int")).alias("chars"),
        F.when(ok, F.lit(0)).otherwise(F.coalesce(k, F.lit(0)) % 5).cast("int").alias("attempts"),
        F.when(~ok & (F.col("event_id") % 3 != 0), F.concat(F.lit("HTTP 429 "), F.col("event_type"))).when(~ok & (F.col("event_id") % 6 == 0), "read timeout").alias("reason"),
        F.when(~ok, F.lit("crossref")).alias("last_source"),
        F.lit(False).alias("rescued"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        F.col("event_id").alias("seq"),
    )


LEDGER_SQL = """
ev as (select *, try_cast(json_extract_string(props, '$.k') as int) as k, event_type in ('purchase', 'click') as ok from events),
ledger as (select 'https://doi.org/10.1/' || user_id as url, case when ok then 'success' else 'failed' end as status,
  case when ok then event_type end as source, case when ok then coalesce(k, 0) * 3 end as chars,
  case when ok then 0 else coalesce(k, 0) % 5 end as attempts,
  case when not ok and event_id % 3 <> 0 then 'HTTP 429 ' || event_type when not ok and event_id % 6 = 0 then 'read timeout' end as reason,
  case when not ok then 'crossref' end as last_source, false as rescued, strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts, event_id as seq from ev),
state as (select * from ledger qualify row_number() over (partition by url order by seq desc) = 1)
"""

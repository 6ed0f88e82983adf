"""Registration of queries and the tables they start from."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adapters, merge
from ..sources.records import remove

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, over: str = "papers") -> Callable:
    """Register a query; sql is checked against it, after the adapter's common table expressions."""

    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            start = {"papers": adapters.PAPERS_SQL, "raw": adapters.RAW_SQL, "ledger": adapters.LEDGER_SQL, "both": adapters.PAPERS_SQL + "," + adapters.LEDGER_SQL, "": ""}[over]
            ORACLES[name] = f"with {start.strip()}{'' if sql.startswith(',') else chr(10)}{sql}" if start else sql
        return f

    return register


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share (spark.checkpoint.dir), removed when the driver
    ends. Only a session whose tasks run in the driver's own machine gets a folder where none is named."""
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        home = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
    path = f"{home.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def capitals(c: Column) -> Column:
    """Upper case sign by sign, as the SQL has it: no sign becomes several (ß is ẞ and not SS), so that lower case leads
    back; a sign without a capital of its own takes its title form, if that is one sign, or stays."""
    one = lambda x: F.length(x) == 1
    sign = lambda x: F.when(one(F.upper(x)), F.upper(x)).when(x == "ß", "ẞ").when(one(F.initcap(x)), F.initcap(x)).otherwise(x)
    plain = F.length(F.upper(c)) == F.length(c)
    return F.when(plain, F.upper(c)).otherwise(F.array_join(F.transform(F.split(c, ""), sign), ""))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.papers_raw(spark, sf_dir)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.materialise_papers(raw(spark, sf_dir))[0]


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import ledger

    return ledger.ledger_latest(adapters.ledger_events(spark, sf_dir))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, url, pos: the distinct confs of the papers, each with one address."""
    rows = raw(spark, sf_dir).select(F.col("conf").alias("name")).distinct()
    return rows.select("name", F.concat(F.lit("https://example.org/"), "name").alias("url"), F.xxhash64("name").alias("pos"))


def abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An external table of abstracts: every third document, its title spaced and punctuated; clashing titles occur."""
    r = raw(spark, sf_dir).filter("seq % 3 = 0")
    year = F.regexp_extract("conf", "[0-9]{4}", 0)
    return r.select(
        F.concat(F.replace("paper_name", F.lit(" "), F.lit("  ")), F.lit("!")).alias("title"),
        F.concat(F.lit("<p>"), F.col("paper_name"), F.lit(" external text of some length that is surely longer than sixty characters</p>")).alias("abstract"),
        F.when(F.col("seq") % 2 == 0, F.col("paper_url")).otherwise(F.lit("")).alias("url"),
        F.when(F.col("seq") % 4 == 0, F.concat(F.lit("Proceedings "), year)).otherwise("").alias("venue_text"),
        F.lit(None).cast("date").alias("date"), "seq",
    )


ABSTRACTS_SQL = """
ext as (select replace(paper_name, ' ', '  ') || '!' as title, '<p>' || paper_name || ' external text of some length that is surely longer than sixty characters</p>' as abstract,
  case when seq % 2 = 0 then paper_url else '' end as url, case when seq % 4 = 0 then 'Proceedings ' || regexp_extract(conf, '[0-9]{4}') else '' end as venue_text, seq
  from raw where seq % 3 = 0)
"""

"""Repair of dead links, its audit and its reversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .linkage import title_ratio
from .merge import merged_columns

COLUMNS = ["conf", "paper_name", "paper_url", "paper_abstract", "paper_authors", "paper_code", "seq"]


def choose_url(doi: Column, landing: Column, dead_host: str) -> Column:
    """The DOI's address; else a web landing page that is neither archived nor on the dead host; else null."""
    bare = F.regexp_replace(F.trim(C.text(doi)), r"(?i)^https?://(dx\.)?doi\.org/", "")
    host = C.canonical_host(landing)
    usable = landing.rlike("(?i)^https?://") & C.unwrap_archive_url(landing).isNull() & (host != "web.archive.org") & (host != dead_host)
    return F.when(bare != "", F.concat(F.lit("https://doi.org/"), bare)).when(usable, landing)


def repair_urls(papers: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R2: (papers, log). accepted: seq, new_url, abstract, source, for archive-wrapped rows. If (conf, new_url) already
    exists the row merges into it and goes; of several rows for one new url the first is rewritten and the rest merge
    into it; empty abstracts are filled. The log keeps what merged rows held."""
    p = papers.select(*COLUMNS)
    wrapped = C.unwrap_archive_url(F.col("paper_url")).isNotNull()
    a = accepted.filter("new_url is not null").groupBy("seq").agg(F.min_by(F.struct("new_url", F.col("abstract").alias("found"), "source"), "new_url").alias("a")).select("seq", "a.*")
    j = p.join(a, "seq", "left").withColumn("new_url", F.when(wrapped, F.col("new_url")))
    fill = F.col("new_url").isNotNull() & (F.trim(C.text("paper_abstract")) == "") & (F.trim(C.text("found")) != "")
    held = p.select("conf", F.col("paper_url").alias("new_url")).filter("new_url is not null").distinct().withColumn("exists", F.lit(True))
    moved = j.filter("new_url is not null").join(held, ["conf", "new_url"], "left")
    # the first row of each new url, as an aggregate: no task numbers the rows of a url that many share
    first = moved.groupBy("conf", "new_url").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    moved = moved.join(first, "seq", "left")
    moved = moved.withColumn("action", F.when(F.col("exists").isNotNull() | F.col("first").isNull(), "merge").otherwise("rewrite"))
    log = moved.select(
        "conf", F.col("paper_url").alias("old_url"), "new_url", "action", fill.alias("abstract_filled"), "source",
        *(F.when(F.col("action") == "merge", F.col(c)).alias(f"old_{c[6:]}") for c in ("paper_name", "paper_authors", "paper_abstract", "paper_code")), "seq",
    )
    url = F.coalesce("new_url", "paper_url")
    changed = j.withColumn("moved", F.col("new_url").isNotNull()).withColumn("paper_abstract", F.when(fill, F.col("found")).otherwise(F.col("paper_abstract"))).withColumn("paper_url", url)
    target = moved.select("conf", F.col("new_url").alias("paper_url")).distinct()
    same = changed.join(target, ["conf", "paper_url"], "left_semi")
    same = same.withColumn("late", F.col("moved").cast("int"))  # rows that were there come first
    one = same.groupBy("conf", "paper_url").agg(*(c.alias(k) for k, c in merged_columns("late", "seq").items() if k != "paper_url"))
    out = one.select(*COLUMNS).unionByName(changed.join(target, ["conf", "paper_url"], "left_anti").select(*COLUMNS))
    return out, log


def repair_report(log: DataFrame, top: int = 10, unchanged: DataFrame | None = None) -> DataFrame:
    """(kind, key, n) by action, source, and the `top` hosts before and after; of rows left unchanged(source,
    reason) also by source and action, and by reason."""
    kinds = [("action", F.col("action")), ("source", F.coalesce("source", F.lit("none"))), ("host_before", C.reported_host(F.col("old_url"))), ("host_after", C.reported_host(F.col("new_url")))]
    n = log.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in kinds))).alias("g")).groupBy("g.kind", "g.key").agg(F.count("*").alias("n"))
    if unchanged is not None:
        left = F.array(
            F.struct(F.lit("action").alias("kind"), F.lit("unchanged").alias("key")),
            F.struct(F.lit("unchanged_source").alias("kind"), F.coalesce("source", F.lit("none")).alias("key")),
            F.struct(F.lit("reason").alias("kind"), F.coalesce("reason", F.lit("(unspecified)")).alias("key")),
        )
        n = n.unionByName(unchanged.select(F.explode(left).alias("g")).groupBy("g.kind", "g.key").agg(F.count("*").alias("n")))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "key"))
    return n.withColumn("place", place).filter(~F.col("kind").startswith("host") | (F.col("place") <= top)).drop("place")


def audit(log: DataFrame, now: DataFrame, before: DataFrame, titles: DataFrame, known_hosts: list[str] = ("doi.org",)) -> DataFrame:
    """The log once per (old_url, new_url), with the local title (of the current table for rewrites, of the earlier
    one, else the log, for merges), its ratio to titles(new_url, remote_title) and the verdict."""
    one = log.groupBy("old_url", "new_url").agg(F.min_by(F.struct("conf", "action", "old_name", "abstract_filled"), "seq").alias("r")).select("old_url", "new_url", "r.*")
    n = now.groupBy(F.col("conf"), F.col("paper_url").alias("new_url")).agg(F.min("paper_name").alias("now_title"))
    b = before.groupBy(F.col("conf"), F.col("paper_url").alias("old_url")).agg(F.min("paper_name").alias("before_title"))
    t = titles.groupBy("new_url").agg(F.min("remote_title").alias("remote_title"))
    j = one.join(n, ["conf", "new_url"], "left").join(b, ["conf", "old_url"], "left").join(t, "new_url", "left")
    local = F.when(F.col("action") == "rewrite", F.col("now_title")).otherwise(F.coalesce("before_title", "old_name"))
    j = j.withColumn("local_title", local)
    j = j.withColumn("ratio", title_ratio(F.col("local_title"), F.col("remote_title")))
    sure = C.canonical_host(F.col("new_url")).isin(list(known_hosts)) & (C.text("remote_title") != "") & (C.text("local_title") != "")
    return j.withColumn("verdict", F.when(~sure, "UNVERIFIABLE").when(F.col("ratio") >= 0.90, "PASS").otherwise("FAIL"))


def select_reverts(audited: DataFrame, max_ratio: float = 0.6, hard: str = r"10\.17816/|peerj") -> DataFrame:
    """Failures below the ratio or with a hard url pattern; unverifiable ones with such a pattern only."""
    bad = F.lower("new_url").rlike(hard)
    return audited.filter(((F.col("verdict") == "FAIL") & ((F.col("ratio") < max_ratio) | bad)) | ((F.col("verdict") == "UNVERIFIABLE") & bad))


def revert(papers: DataFrame, before: DataFrame, rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(papers, ledger rows). Rewrites get their url back and lose a filled abstract; merged rows are put back from
    the earlier table and their target's abstract and code restored from it; the ledger fails them as title_mismatch."""
    r = rows.select("conf", "old_url", "new_url", "action", F.coalesce("abstract_filled", F.lit(False)).alias("filled"))
    first = r.groupBy("conf", F.col("new_url").alias("paper_url")).agg(F.min_by(F.struct("action", "old_url", "filled"), F.struct(F.col("action") == "merge", "old_url")).alias("r"))
    was = before.groupBy("conf", "paper_url").agg(F.min_by(F.struct("paper_abstract", "paper_code"), "seq").alias("was"))
    j = papers.select(*COLUMNS).join(first, ["conf", "paper_url"], "left").join(was, ["conf", "paper_url"], "left")
    rewrite, merge = F.col("r.action").eqNullSafe("rewrite"), F.col("r.action").eqNullSafe("merge") & F.col("was").isNotNull()
    j = j.withColumn("paper_abstract", F.when(rewrite & F.col("r.filled"), "").when(merge, F.col("was.paper_abstract")).otherwise(F.col("paper_abstract")))
    j = j.withColumn("paper_code", F.when(merge, F.col("was.paper_code")).otherwise(F.col("paper_code"))).withColumn("paper_url", F.when(rewrite, F.col("r.old_url")).otherwise(F.col("paper_url")))
    gone = r.filter("action = 'merge'").select("conf", F.col("old_url").alias("paper_url")).distinct()
    back = before.join(gone, ["conf", "paper_url"], "left_semi").select(*COLUMNS)
    tries = state.select("url", F.coalesce("attempts", F.lit(0)).alias("tries"))
    ledger = r.select(F.col("old_url").alias("url")).distinct().join(tries, "url", "left")
    ledger = ledger.select("url", F.lit("failed").alias("status"), F.lit("title_mismatch").alias("reason"), (F.coalesce("tries", F.lit(0)) + 1).alias("attempts"))
    return j.select(*COLUMNS).unionByName(back), ledger

"""The append-only ledger of outcomes: latest state, appends, compaction, updates and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

COLUMNS = ["status", "source", "chars", "attempts", "reason", "last_source", "rescued", "ts", "seq"]
REQUEST_LEVEL = ["rate_limited", "timeout", "network"]


def ledger_latest(events: DataFrame) -> DataFrame:
    """L1: the last event of each url, by seq; associative, so a hot url is folded map-side."""
    some = [c for c in COLUMNS if c in events.columns]
    return events.groupBy("url").agg(F.max_by(F.struct(*some), "seq").alias("r")).select("url", "r.*")


def ledger_append(state: DataFrame, prev: DataFrame) -> DataFrame:
    """L2: rows of state that are new or differ from prev in any column but seq."""
    cols = [c for c in COLUMNS if c in state.columns and c != "seq"]
    old = prev.select("url", F.struct(*cols).alias("old"))
    joined = state.withColumn("new", F.struct(*cols)).join(old, "url", "left")
    return joined.filter(~F.col("new").eqNullSafe(F.col("old"))).drop("new", "old")


def needs_compaction(events: DataFrame, ratio: float = 2.0) -> DataFrame:
    """L3's test: one row (physical, live, compact)."""
    return events.agg(F.count("*").alias("physical"), F.count_distinct("url").alias("live")).withColumn("compact", F.col("physical") > ratio * F.col("live"))


def ledger_compact(events: DataFrame, path: str, ratio: float = 2.0) -> bool:
    """L3: write the latest state to path if there are over `ratio` physical rows per live url. It is staged and counted
    before it takes the place of what is there, so path may be the table that events are read from."""
    from ..sources.records import replace_verified

    due = bool(needs_compaction(events, ratio).first()["compact"])
    if due:
        replace_verified(ledger_latest(events), path)
    return due


def ledger_apply(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """L4: outcomes(url, ok, source, chars, reason, ts) on the state. A failure adds an attempt unless it is one of the
    request; its reason is mapped to the vocabulary."""
    o = outcomes.select("url", *(F.col(c).alias(f"o_{c}") for c in ("ok", "source", "chars", "reason", "ts")))
    j = state.join(o, "url", "full")
    reason = C.normalise_reason(F.col("o_reason"))
    ok, hit = F.col("o_ok"), F.col("o_ok").isNotNull()
    tries = F.coalesce("attempts", F.lit(0)) + F.when(reason.isin(REQUEST_LEVEL), 0).otherwise(1)
    pick = lambda good, bad, old: F.when(~hit, old).when(ok, good).otherwise(bad)
    none = F.lit(None).cast("string")
    return j.select(
        "url",
        pick(F.lit("success"), F.lit("failed"), F.col("status")).alias("status"),
        pick(F.col("o_source"), none, F.col("source")).alias("source"),
        pick(F.col("o_chars"), F.lit(None).cast("int"), F.col("chars")).alias("chars"),
        pick(F.lit(0), tries, F.col("attempts")).alias("attempts"),
        pick(none, reason, F.col("reason")).alias("reason"),
        pick(none, F.coalesce("o_source", "last_source"), F.col("last_source")).alias("last_source"),
        F.coalesce("o_ts", "ts").alias("ts"),
    )


def demote_short(state: DataFrame, threshold: int = 60) -> tuple[DataFrame, DataFrame]:
    """(state, one row of counts): successes of fewer characters than the threshold fail as empty_abstract, rescued,
    with no attempts; those without a count stay and are counted."""
    success = F.col("status") == "success"
    short = F.coalesce(success & (F.col("chars") < threshold), F.lit(False))
    put = lambda c, v: F.when(short, F.lit(v)).otherwise(F.col(c)).alias(c)
    new = {"status": "failed", "reason": "empty_abstract", "rescued": True, "attempts": 0}
    out = state.select(*(put(c, new[c]) if c in new else F.col(c) for c in state.columns))
    return out, state.agg(F.count_if(short).alias("demoted"), F.count_if(success & F.col("chars").isNull()).alias("no_chars"))


def purge_venue_index(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state without index pages, removed rows by host)."""
    index = C.classify_url(F.col("url")) == "venue-index"
    return state.filter(~index), state.filter(index).groupBy(C.reported_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def ledger_report(state: DataFrame, top: int = 10) -> DataFrame:
    """(kind, key, n): status counts and total, the `top` failing hosts, reasons, months; one pass over the state."""
    failed = F.col("status") == "failed"
    raw = F.trim(C.text("reason"))
    reason = F.when(raw == "", "(unspecified)").otherwise(C.normalise_reason(F.col("reason")))
    month = F.when(C.text("ts").rlike("^[0-9]{4}-[0-9]{2}"), F.left("ts", F.lit(7))).otherwise("(no-ts)")
    group = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    kinds = [
        group("total", F.lit("all")), group("status", F.col("status")), group("month", month),
        F.when(failed, group("host", C.reported_host(F.col("url")))), F.when(failed, group("reason", reason)),
    ]
    each = state.select(F.explode(F.array(*kinds)).alias("g")).filter("g is not null")
    n = each.groupBy(F.col("g.kind").alias("kind"), F.col("g.key").alias("key")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "key"))
    return n.withColumn("place", place).filter((F.col("kind") != "host") | (F.col("place") <= top)).drop("place")


def final_reason(attempts: DataFrame) -> DataFrame:
    """One reason per url from attempts(url, seq, source, reason, host_specific, has_title, has_doi)."""
    a = attempts.groupBy("url").agg(
        F.max_by("reason", F.when(F.col("host_specific") & F.col("reason").isNotNull(), F.col("seq"))).alias("specific"),
        F.bool_or("has_title").alias("has_title"), F.bool_or("has_doi").alias("has_doi"),
        F.bool_or(F.col("reason") == "title_mismatch").alias("mismatch"), F.max_by("source", "seq").alias("last_source"),
    )
    mismatch = F.coalesce("mismatch", F.lit(False))
    without = F.when(~F.col("has_title"), "no_doi").when(mismatch, "title_mismatch").otherwise("no_abstract_available")
    return a.select("url", F.when(F.col("specific").isNotNull(), F.col("specific")).when(F.col("has_doi"), F.when(mismatch, "title_mismatch").otherwise("empty_abstract")).otherwise(without).alias("reason"), "last_source")

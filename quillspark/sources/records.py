"""Readers, checks and writers of record tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import predicates as P
from ..operators.merge import merged

RAW = T.StructType([
    T.StructField("conf", T.StringType()), T.StructField("paper_name", T.StringType()), T.StructField("paper_authors", T.ArrayType(T.StringType())),
    T.StructField("paper_url", T.StringType()), T.StructField("paper_abstract", T.StringType()), T.StructField("paper_code", T.StringType()),
])
CSV = ["title", "url", "authors", "abstract", "code", "conf", "year"]


def parse_papers(lines: DataFrame) -> DataFrame:
    """Rows of lines(value, seq): the RAW columns, seq and _corrupt_record (the line, if it is no record with a string
    conf). Blank lines are skipped; authors given as one string become a list of one."""
    shape = "conf string, paper_name string, paper_authors string, paper_url string, paper_abstract string, paper_code string, _corrupt_record string"
    j = lines.filter(F.trim("value") != "").select("seq", "value", F.from_json("value", shape, {"mode": "PERMISSIVE"}).alias("r"), F.get_json_object("value", "$.conf").alias("c"))
    kind = F.expr("typeof(try_parse_json(value))")
    text_conf = F.expr("schema_of_variant(try_variant_get(try_parse_json(value), '$.conf', 'variant')) = 'STRING'")
    bad = kind.isNull() | F.col("r._corrupt_record").isNotNull() | ~F.coalesce(text_conf, F.lit(False))
    given = F.col("r.paper_authors")
    authors = F.when(given.startswith("["), F.from_json(given, "array<string>")).when(given.isNotNull(), F.array(given))
    cols = [authors.alias("paper_authors") if c == "paper_authors" else F.col(f"r.{c}").alias(c) for c in RAW.names]
    return j.select(*cols, "seq", F.when(bad, F.col("value")).alias("_corrupt_record"))


def read_papers(spark: SparkSession, path: str, frozen: str | None = None) -> DataFrame:
    """JSON lines (plain or gzip). Input order counts, so seq rises along each file's lines; with a path `frozen` the
    lines are written there once, and seq is the same whenever they are read."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("seq"))
    if frozen:
        lines.write.parquet(frozen)
        lines = spark.read.schema(lines.schema).parquet(frozen)
    return parse_papers(lines)


def validate(raw: DataFrame, max_error_ratio: float = 0.0) -> tuple[DataFrame, DataFrame, dict]:
    """(good rows, rejects, counts); refuses a table with too large a share of rejects."""
    n = raw.agg(F.count("*").alias("rows"), F.count("_corrupt_record").alias("errors")).first().asDict()
    if n["errors"] > max_error_ratio * n["rows"]:
        raise ValueError(f"{n['errors']} of {n['rows']} lines are no records")
    return raw.filter("_corrupt_record is null").drop("_corrupt_record"), raw.filter("_corrupt_record is not null").select("seq", "_corrupt_record"), n


def preflight(raw: DataFrame, most_errors: int = 3) -> tuple[dict, list]:
    """Counts and a head sample of three rows (a report); refuses an empty table or over `most_errors` rejects."""
    n = raw.agg(F.count("*").alias("rows"), F.count("_corrupt_record").alias("errors")).first().asDict()
    if not n["rows"] or n["errors"] > most_errors:
        raise ValueError(f"not fit to publish: {n}")
    return n, raw.limit(3).collect()


def read_nested_notes(notes: DataFrame) -> DataFrame:
    """notes(value, seq): JSON whose content fields are flat or {"value": x}; accepted venues with an id, merged by id."""
    field = lambda f: F.coalesce(F.get_json_object("value", f"$.content.{f}.value"), F.get_json_object("value", f"$.content.{f}"))
    rows = notes.select(
        F.get_json_object("value", "$.id").alias("id"), field("venue").alias("venue"), field("title").alias("paper_name"),
        F.from_json(field("authors"), "array<string>").alias("paper_authors"), field("abstract").alias("paper_abstract"), "seq",
    )
    good = rows.filter(P.accepted_venue(F.col("venue")) & (C.text("id") != ""))
    good = good.withColumn("paper_url", F.concat(F.lit("https://openreview.net/forum?id="), "id")).withColumn("paper_code", F.lit("#"))
    return good.groupBy("id").agg(*merged()).drop("merged_rows")


def flatten_inverted_index(index: Column) -> Column:
    """The text of a map word -> positions; gaps stay empty, a blank text is null."""
    entries = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    by_place = F.map_from_entries(F.array_distinct(F.transform(entries, lambda x: F.struct(x["p"], F.lit(1)))))
    last = F.array_max(F.map_keys(by_place))
    words = F.map_from_entries(F.transform(F.array_sort(entries), lambda x: F.struct(x["p"], x["w"])))
    text = F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.try_element_at(words, i), F.lit(""))), " ")
    return F.when(F.size(entries) > 0, F.nullif(F.trim(text), F.lit("")))


def slice_abstract_section(text: Column, most: int = 2000) -> Column:
    """I8: the abstract of a full text: from a line 'Abstract' or an inline one to the next section's heading. Null for
    boilerplate or text without spaces."""
    t = C.text(text)
    line = F.regexp_extract(t, r"(?is)(?:^|\n)[ \t]*abstract[ \t]*[:.]?[ \t]*\n(.*)$", 1)
    inline = F.regexp_extract(t, r"(?is)\babstract\s*[-—:.]\s*(.*)$", 1)
    body = F.when(line != "", line).otherwise(inline)
    stop = r"(?is)\n[ \t]*(?:[0-9]+\.?[ \t]*|I\.?[ \t]+)?(?:introduction|keywords|key words|index terms|ccs concepts|acm reference format)\b.*$"
    body = F.left(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, stop, ""), r"-\n\s*", ""), r"\s+", " ")), F.lit(most))
    spaces = F.length(body) - F.length(F.translate(body, " ", ""))
    bad = F.lower(body).rlike("^(copyright|permission to make|all rights reserved|©)") | ((F.length(body) >= 100) & (spaces < 0.03 * F.length(body)))
    return F.when((body != "") & ~bad, body)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path, if the session still runs."""
    if spark.sparkContext._jsc is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def replace_verified(df: DataFrame, path: str, write=lambda w, p: w.parquet(p), read=lambda s, p: s.read.parquet(p)) -> int:
    """Write beside path, read back and compare counts, then swap; on a difference the old data stay."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    staged, old = (f"{path}.{kind}-{uuid.uuid4().hex}" for kind in ("staged", "old"))
    rows = df.count()
    write(df.write, staged)
    again = read(spark, staged).count()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    if again != rows:
        fs.delete(at(staged), True)
        raise ValueError(f"wrote {again} of {rows} rows; {path} is as before")
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    if not fs.rename(at(staged), at(path)):
        raise OSError(f"could not move {staged} to {path}; the old data are in {old}")
    fs.delete(at(old), True)
    return rows


def write_papers(df: DataFrame, path: str, kind: str = "parquet") -> int:
    """I9 as Parquet or gzip JSON lines; returns the rows written."""
    if kind == "json":
        return replace_verified(df, path, lambda w, p: w.json(p, compression="gzip"), lambda s, p: s.read.schema(df.schema).json(p))
    return replace_verified(df, path)


def csv_line() -> Column:
    """One row of the export: every cell quoted, quotes doubled, authors joined by commas."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(C.text(c), F.lit('"'), F.lit('""')), F.lit('"'))
    cells = {"authors": F.concat_ws(",", "authors"), "year": F.col("year").cast("string")}
    return F.concat_ws(",", *(quoted(cells.get(c, F.col(c))) for c in CSV))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV, each file with its header; the UTF-8 byte order mark opens the header."""
    rows = df.select("title", "url", F.concat_ws(",", "authors").alias("authors"), "abstract", "code", "conf", F.col("year").cast("string").alias("year"))
    rows.withColumnRenamed("title", "﻿title").fillna("").write.csv(path, header=True, quoteAll=True, escape='"', emptyValue='""')


def export_txt(df: DataFrame, path: str) -> None:
    """`[conf and year]`, a tab and the title."""
    df.select(txt_line().alias("value")).write.text(path)


def txt_line() -> Column:
    return F.concat(F.lit("["), C.text("conf"), C.text(F.col("year").cast("string")), F.lit("]\t"), C.text("title"))


LEDGER = "url string, status string, source string, chars int, attempts int, reason string, last_source string, rescued boolean, ts string"


def read_ledger(lines: DataFrame) -> DataFrame:
    """Events of lines(value, seq): one event a line (v3, v4), a list of urls (v1), or a map of them (v2).
    Malformed lines, _meta lines and lines without a url are skipped. seq is (seq of the line, pos within it)."""
    body = lines.filter(F.col("value").isNotNull())
    has = lambda p: F.get_json_object("value", p)
    kind = F.expr("schema_of_variant(try_parse_json(value))")
    parsed = body.withColumn("kind", kind).filter("kind is not null")
    event = parsed.filter(F.col("kind").startswith("OBJECT") & has("$.url").isNotNull() & has("$._meta").isNull()).select("seq", F.lit(0).alias("pos"), F.from_json("value", LEDGER).alias("e"))
    old = parsed.filter(F.col("kind").startswith("ARRAY")).select("seq", F.posexplode(F.from_json("value", "array<string>")).alias("pos", "u"))
    old = old.select("seq", "pos", F.struct("u").alias("u")).select("seq", "pos", F.from_json(F.to_json(F.struct(F.col("u.u").alias("url"), F.lit("success").alias("status"))), LEDGER).alias("e"))
    urls = parsed.filter(F.col("kind").startswith("OBJECT") & has("$.url").isNull() & has("$._meta").isNull())
    urls = urls.select("seq", F.posexplode(F.map_entries(F.from_json("value", f"map<string, struct<{LEDGER.replace(' ', ':').replace(',:', ',').removeprefix('url:string,')}>>"))).alias("pos", "m"))
    urls = urls.filter("m.value is not null").select("seq", "pos", F.struct(F.col("m.key").alias("url"), "m.value.*").alias("e"))
    return event.unionByName(old).unionByName(urls).filter("e.url is not null and e.url <> ''").select("e.*", F.struct("seq", "pos").alias("seq"))

"""The corpus of records as versioned buckets of conferences, of which a merge (D3) writes only those it touches.

A corpus is a folder: `base/v=N/bucket=B` holds the rows of the conferences that hash to bucket B as merge N left them,
and `manifests/N` says which version of each bucket counts and how many rows it has. A merge reads and writes the buckets
of the conferences it brings, checks what it wrote, and only then puts its manifest, so a reader sees all of a merge or
nothing and files of other buckets are never touched. A merge that died leaves a version that no manifest names; the next
one writes over it. One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as P
from ..operators.merge import FIELDS, merge_cleaned
from ..streaming.ledger_stream import Folder, clean

BUCKETS = 256
ROWS_A_FILE = 1_000_000
BYTES_A_FILE = 32 << 20  # of texts, before compression
COLUMNS = ["conf", *FIELDS, "seq"]


def bucket_of(conf: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(conf), F.lit(buckets)).cast("int")


def read_corpus(spark: SparkSession, path: str, some: set[int] | None = None) -> DataFrame | None:
    """The rows of a corpus (of some buckets), as the newest manifest names them; None where there are none."""
    folder = Folder(spark, path)
    manifest = folder.manifest()
    files = folder.base(manifest, some)
    return spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(*files) if files else None


def sizes(df: DataFrame, buckets: int) -> dict[int, tuple[int, int]]:
    """Rows and bytes of text of each bucket that has any: at most `buckets` pairs."""
    texts = [F.octet_length(F.coalesce(c, F.lit(""))) for c in ("paper_name", "paper_url", "paper_abstract", "paper_code")]
    size = sum(texts, F.octet_length(F.concat_ws(" ", "paper_authors"))).cast("long")
    by = df.groupBy(bucket_of(F.col("conf"), buckets).alias("b")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    return {r["b"]: (r["n"], r["bytes"]) for r in by.collect()}


def put_version(folder: Folder, df: DataFrame, old: dict, expected: dict[int, tuple[int, int]], each: int) -> dict:
    """Write df as the next version of its buckets, compare what can be read back, and name it in a manifest. A bucket of
    more than `each` expected rows, or BYTES_A_FILE of text, goes to several files, so a conference of any size is written
    by several tasks, and what a task gets does not grow with the corpus."""
    spark, number, buckets = folder.spark, old["batch"] + 1, old["count"]
    slices = {b: max(-(-n // each), -(-size // BYTES_A_FILE), 1) for b, (n, size) in expected.items()}
    parts = spark.createDataFrame([(b, s) for b, s in slices.items()], "bucket int, slices int")  # at most `buckets` rows
    rows = df.select(*COLUMNS, bucket_of(F.col("conf"), buckets).alias("bucket")).join(F.broadcast(parts), "bucket")
    slice_ = F.pmod(F.xxhash64("paper_url", "paper_name", "seq"), F.col("slices"))
    rows = rows.repartition(sum(slices.values()), "bucket", slice_).drop("slices")
    written, at = Observation(), f"base/v={number}"
    rows.observe(written, F.count("*").alias("n")).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder.path}/{at}")
    again = {r["bucket"]: r["n"] for r in spark.read.parquet(f"{folder.path}/{at}").groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    if sum(again.values()) != written.get["n"]:
        folder.remove(at)
        raise ValueError(f"wrote {written.get['n']} rows and read {sum(again.values())}; {folder.path} is as before")
    kept = lambda of: {b: x for b, x in of.items() if int(b) not in expected}
    manifest = {
        "batch": number, "count": buckets, "schema": df.select(*COLUMNS).schema.jsonValue(),
        "bytes": kept(old.get("bytes", {})) | {str(b): expected[b][1] * n // max(expected[b][0], 1) for b, n in again.items()},
        "buckets": kept(old["buckets"]) | {str(b): number for b in again}, "rows": kept(old["rows"]) | {str(b): n for b, n in again.items()},
    }
    folder.put(f"manifests/{number}", json.dumps(manifest))
    clean(folder)
    return manifest


def create_corpus(df: DataFrame, path: str, buckets: int = BUCKETS, each: int = ROWS_A_FILE) -> dict:
    """A new corpus of the rows of df as they are. An empty table makes an empty corpus."""
    folder = Folder(df.sparkSession, path)
    if folder.names("manifests"):
        raise ValueError(f"{path} holds a corpus already")
    empty = {"batch": -1, "count": buckets, "buckets": {}, "rows": {}}
    expected = sizes(df, buckets)
    if expected:
        return put_version(folder, df, empty, expected, each)
    manifest = {**empty, "batch": 0}
    folder.put("manifests/0", json.dumps(manifest))
    return manifest


def merge_into(new: DataFrame, path: str, each: int = ROWS_A_FILE) -> dict:
    """D3 on a stored corpus: merge_incremental(new, corpus), reading and writing only the buckets of the conferences
    that `new` has after its front matter is dropped. Returns the manifest; nothing is written if there are none.

    The new rows are stored beside the corpus once their front matter is dropped, as the merge reads them three times.
    """
    spark = new.sparkSession
    folder = Folder(spark, path)
    old = folder.manifest()
    if "count" not in old:
        raise ValueError(f"{path} holds no corpus")
    folder.remove("incoming")
    P.drop_on_collect(new).select(*COLUMNS).write.parquet(f"{folder.path}/incoming")
    fresh = spark.read.schema(new.select(*COLUMNS).schema).parquet(f"{folder.path}/incoming")
    coming = sizes(fresh, old["count"])
    if coming:
        held = read_corpus(spark, path, set(coming))
        held = fresh.limit(0) if held is None else held
        # a bucket whose manifest has no bytes yet counts as its new rows do
        had = lambda b, n, size: (rows := old["rows"].get(str(b), 0), old.get("bytes", {}).get(str(b), rows * size // n))
        expected = {b: tuple(map(sum, zip((n, size), had(b, n, size), strict=True))) for b, (n, size) in coming.items()}
        old = put_version(folder, merge_cleaned(fresh, held), old, expected, each)
    folder.remove("incoming")
    return old

"""The ledger's latest state kept current from a folder of event files, with Structured Streaming.

The state is a folder. `deltas/batch=N` holds the latest event of every url of micro-batch N, and nothing of older
state is read or written for it. Every few batches a compaction folds the deltas into the base, which is parted into
buckets of urls: only buckets that a delta touches are written anew, as `base/v=N/bucket=B`, and `manifests/N` then says
which version of each bucket counts and up to which batch. A reader takes the newest manifest, its buckets, and the
deltas after it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import ledger_latest

BUCKETS = 64
KEPT = 2  # manifests; what only older ones name is removed


class Folder:
    """Names and small files of a state folder, on whatever file system it lies."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.jvm = spark, path.rstrip("/"), spark.sparkContext._jvm
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(name))] if self.fs.exists(self.at(name)) else []

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Written aside and renamed, so that a reader sees all of it or nothing."""
        stream = self.fs.create(self.at(f"{name}.new"), True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        self.remove(name)
        self.fs.rename(self.at(f"{name}.new"), self.at(name))

    def manifest(self, before: int | None = None) -> dict:
        """The newest manifest (of a batch before the given one): batch, and the version of each bucket."""
        done = [int(n) for n in self.names("manifests") if n.isdigit() and (before is None or int(n) < before)]
        return json.loads(self.read(f"manifests/{max(done)}")) if done else {"batch": -1, "buckets": {}}

    def deltas(self, after: int, upto: int | None = None) -> list[str]:
        """Complete deltas of the batches after `after`, up to `upto`."""
        numbers = sorted(int(n[6:]) for n in self.names("deltas") if n.startswith("batch="))
        numbers = [n for n in numbers if n > after and (upto is None or n <= upto)]
        return [f"{self.path}/deltas/batch={n}" for n in numbers if self.fs.exists(self.at(f"deltas/batch={n}/_SUCCESS"))]

    def base(self, manifest: dict, some: set[int] | None = None) -> list[str]:
        return [f"{self.path}/base/v={v}/bucket={b}" for b, v in manifest["buckets"].items() if some is None or int(b) in some]


def current_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest event of every url: base and deltas that are complete; None if there are none."""
    folder = Folder(spark, path)
    manifest = folder.manifest()
    files = [*folder.base(manifest), *folder.deltas(manifest["batch"])]
    if not files:
        return None
    schema = spark.read.parquet(files[-1]).drop("bucket").schema
    return ledger_latest(spark.read.schema(schema).parquet(*files))


def compact(spark: SparkSession, path: str, number: int, buckets: int = BUCKETS) -> None:
    """Fold the deltas up to batch `number` into the buckets that they touch. Run again, it writes the same again."""
    folder = Folder(spark, path)
    old = folder.manifest(before=number)
    deltas = folder.deltas(old["batch"], number)
    if not deltas:
        return
    bucket = F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")
    new = spark.read.parquet(*deltas)
    touched = {r["bucket"] for r in new.select(bucket.alias("bucket")).distinct().collect()}  # at most `buckets` rows
    base = folder.base(old, touched)
    rows = new.unionByName(spark.read.schema(new.schema).parquet(*base)) if base else new
    out = ledger_latest(rows).withColumn("bucket", bucket).repartition(len(touched), "bucket")
    out.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder.path}/base/v={number}")
    folder.put(f"manifests/{number}", json.dumps({"batch": number, "buckets": old["buckets"] | {str(b): number for b in sorted(touched)}}))
    clean(folder)


def clean(folder: Folder) -> None:
    """Remove what none of the last KEPT manifests needs."""
    numbers = sorted(int(n) for n in folder.names("manifests") if n.isdigit())
    kept = [json.loads(folder.read(f"manifests/{n}")) for n in numbers[-KEPT:]]
    for n in numbers[:-KEPT]:
        folder.remove(f"manifests/{n}")
    named = {(v, b) for m in kept for b, v in m["buckets"].items()}
    for version in folder.names("base"):
        if int(version[2:]) < kept[0]["batch"]:
            own = [n for n in folder.names(f"base/{version}") if n.startswith("bucket=")]
            gone = [n for n in own if (int(version[2:]), n[7:]) not in named]
            for n in gone if len(gone) < len(own) else [""]:
                folder.remove(f"base/{version}/{n}".rstrip("/"))
    for n in folder.names("deltas"):
        if int(n[6:]) <= kept[0]["batch"]:
            folder.remove(f"deltas/{n}")


def ledger_stream(spark: SparkSession, events: str, state: str, checkpoint: str, schema, every: int = 8, buckets: int = BUCKETS, files: int | None = None) -> StreamingQuery:
    """Keeps the state (later seq wins) from a folder of event files, of which a batch takes at most `files`.

    What a batch writes grows with the batch alone; every `every` batches their deltas are compacted into the buckets
    that they touch. A batch that is run again after a crash writes the same delta and the same buckets again. The
    number of buckets is fixed for the life of a state folder.
    """

    def fold(batch: DataFrame, number: int) -> None:
        ledger_latest(batch).write.mode("overwrite").parquet(f"{state}/deltas/batch={number}")
        if number % every == every - 1:
            compact(batch.sparkSession, state, number, buckets)

    stream = spark.readStream.schema(schema)
    stream = (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(events)
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_outcomes(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Outcomes per time window of a stream (or table) of events with a timestamp column `at`; late events count until the watermark."""
    rows = events.withWatermark("at", late) if events.isStreaming else events
    return rows.groupBy(F.window("at", width).alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")

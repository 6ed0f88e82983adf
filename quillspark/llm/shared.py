"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, named in spark.checkpoint.dir. Only a session whose tasks
    run in the driver's own machine gets one of its own where none is named; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives a lost executor.

    The files go when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def stored_with(df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict]:
    """stored(df), and sums over its rows that are taken as they are written, without another pass."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    out = stored(df.observe(seen, *(c.alias(k) for k, c in sums.items())), name)
    return out, seen.get


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table, if the session still runs."""
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 5, is 0 (a null id is held out too)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def place(id_: Column, row: Column, null_id: int) -> Column:
    """(id, row) as one number, in order of the id and then of the row; a null id counts as null_id. A decimal and not
    a struct, so that its minimum and maximum are hash aggregates."""
    wide = F.coalesce(id_.cast("decimal(20,0)"), F.lit(Decimal(null_id)).cast("decimal(20,0)"))
    return (wide * F.lit(Decimal(2**63)).cast("decimal(19,0)") + row.cast("decimal(19,0)")).cast("decimal(38,0)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for a keyed exchange of so many rows, `each` of them a task; never below the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies; QUILLSPARK_TOKENIZERS names another folder."""
    home = os.environ.get("QUILLSPARK_TOKENIZERS")
    if home:
        return os.path.join(home, name)
    import public_tokenizers

    return public_tokenizers.path(name)

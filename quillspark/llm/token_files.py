"""Token ids in Parquet files: lists with dictionary or delta encoding, small row groups and pages, page indexes.

A folder of token files holds `tokens` (id, part, at, n_tokens, ids), one file for each range of ids, and `parts`
(part, before), the number of ids in earlier files. Pages and row groups are small and carry their least and largest id,
so a reader of some documents skips the others' token pages, and one of lengths alone reads no token page at all.
"""

from __future__ import annotations

import atexit
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .bpe import WordBpe

END_ID = 1
ENCODINGS = ("dictionary", "delta")
MOST_BROADCAST = 100_000  # rows of `parts`, one for each file


def write_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", file: str = "word_bpe_49k.json", encoding: str = "dictionary",
    each: int = 16_384, row_group: int = 8 << 20, page: int = 64 << 10, page_rows: int = 1000,
) -> None:
    """Write the ids of all documents, each with END_ID after them, to the folder path in ascending order of the id.

    Rows are dealt by range of (id, place in the table), `each` a file, so rows that share one id share no task. A null
    text counts as empty (the end id alone), a null id comes first, repeated rows stay as many. An empty table gives
    empty files. encoding says how token lists are kept; the other columns, which ascend, have delta encoding.
    row_group and page are bytes. Columns beside the id and the text are ignored, whatever their names.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}")
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    keys = [F.col("id").asc_nulls_first(), F.col("row")]
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(shared.parts(spark, rows.count(), each), *keys)
    ranged = ranged.sortWithinPartitions(*keys).select("id", F.spark_partition_id().alias("part"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, at = WordBpe(shared.tokenizer_path(file)), np.uint32(END_ID).tobytes(), 0
        for batch in batches:
            done, held, size = 0, [], 0
            texts = batch.column("text")
            for i, ids in enumerate(bpe.encode(texts[j].as_py() for j in range(len(texts))), 1):
                held.append(ids + end)
                size += len(held[-1])
                if size < 16 << 20 and i < len(texts):
                    continue
                n = np.fromiter(map(len, held), np.int64, len(held)) // 4
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.frombuffer(b"".join(held), np.int32)))
                starts = at + np.cumsum(n) - n
                columns = [batch.column("id")[done:i], batch.column("part")[done:i], pa.array(starts), pa.array(n), lists]
                yield pa.RecordBatch.from_arrays(columns, ["id", "part", "at", "n_tokens", "ids"])
                done, held, size, at = i, [], 0, at + int(n.sum())

    out = ranged.mapInArrow(encode, "id long, part int, at long, n_tokens long, ids array<int>")
    kept = {"parquet.enable.dictionary": str(encoding == "dictionary").lower()} | {f"parquet.enable.dictionary#{c}": "false" for c in ("id", "part", "at", "n_tokens")}
    sizes = {"parquet.block.size": row_group, "parquet.page.size": page, "parquet.page.row.count.limit": page_rows}
    # the second version of the writer has delta encoding where there is no dictionary
    out.write.options(compression="zstd", **{"parquet.writer.version": "v2"}, **kept, **sizes).parquet(f"{path}/tokens")
    tokens = spark.read.schema(out.schema).parquet(f"{path}/tokens")
    n = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # no token page is read
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # a row for each file
    n.select("part", before.alias("before")).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """id, start, n_tokens, ids of the documents of a folder of token files whose id is from first to last (None: no
    bound; rows of a null id only without bounds). start counts the ids of all documents before. Only row groups and
    pages that can hold such ids are read, and token pages only if `ids` is used."""
    tokens = spark.read.schema("id long, part int, at long, n_tokens long, ids array<int>").parquet(f"{path}/tokens")
    parts = spark.read.schema("part int, before long").parquet(f"{path}/parts")
    if first is not None:
        tokens = tokens.filter(F.col("id") >= first)
    if last is not None:
        tokens = tokens.filter(F.col("id") <= last)
    parts = F.broadcast(parts) if parts.count() <= MOST_BROADCAST else parts
    return tokens.join(parts, "part").select("id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")


def token_digests(tokens: DataFrame) -> DataFrame:
    """id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of read_tokens()'s rows."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            data = memoryview(np.ascontiguousarray(ids)).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            columns = [batch.column("id"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("id", "start", "ids").mapInArrow(digest, "id long, start long, n_tokens long, ids_crc32 long")


def op12_token_files(spark, sf_dir):
    path = f"{shared.shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    atexit.register(shared.remove, spark, path)
    write_tokens(shared.table(spark, sf_dir, "documents"), path)
    return token_digests(read_tokens(spark, path)).withColumnRenamed("id", "doc_id")

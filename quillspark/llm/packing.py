"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed capacity.

Pieces are placed in order of decreasing length, each into the tightest open sequence, which a segment tree over
remaining capacities finds in logarithmic time. Pieces of one length are interchangeable and so are sequences with
one remaining capacity, so the driver packs the *histogram* of lengths (at most `capacity` rows, whatever the
corpus) and moves whole runs at once. What comes back is a table of runs: the pieces of length L with ranks
lo..hi go to the sequences from seq_lo on, at one offset. Ranks are dealt on the executors, so the result is the
packing that one sequential pass over all documents gives, with no document on the driver.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

END_ID = 2
EOT, EOT_ID = "<|endoftext|>", 50256  # the vocabulary's only special string


class ByteEncoder:
    """Byte-level BPE ids of a text as little-endian unsigned 32-bit bytes.

    The word pattern's look-ahead matters only within runs of white space; texts without any take the pattern
    without it, which is faster.
    """

    runs = re.compile(r"\s\s")

    def __init__(self) -> None:
        import public_tokenizers
        import tiktoken

        with open(shared.tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        full = public_tokenizers.PATTERN
        self.full, self.simple = (
            tiktoken.Encoding("byte_bpe_50k", pat_str=p, mergeable_ranks=ranks, special_tokens={})
            for p in (full, full.replace(r"|\s+(?!\S)", ""))
        )

    def ids(self, text: str) -> bytes:
        bpe = self.full if self.runs.search(text) else self.simple
        return array("I", bpe.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if EOT in text:
            return EOT_ID.to_bytes(4, "little").join(self.ids(x) for x in text.split(EOT))
        return self.ids(text)


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """The pieces of every document: its ids and the end id, cut from the end so that only the first may be short."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end, width = ByteEncoder(), END_ID.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            ids, number, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch["id"], batch["text"], strict=True):
                data = encoder.encode(text) + end
                cuts = [0, *range(len(data) % width or width, len(data) + 1, width)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    ids.append(doc_id)
                    number.append(k)
                    start.append(a // 4)
                    length.append((b - a) // 4)
                    crc.append(zlib.crc32(data[a:b]))
            yield pd.DataFrame({
                "id": pd.Series(ids, dtype="Int64"), "piece": pd.Series(number, dtype="int32"),
                "start": pd.Series(start, dtype="int64"), "length": pd.Series(length, dtype="int64"),
                "ids_crc32": pd.Series(crc, dtype="int64"),
            })

    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )
    return rows.mapInPandas(cut, "id long, piece int, start long, length long, ids_crc32 long")


class Tightest:
    """Segment tree over remaining capacities; a node tells whether any sequence below it is open."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.width)

    def put(self, remaining: int, is_open: bool) -> None:
        i = remaining + self.width
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def at_least(self, size: int) -> int | None:
        """The least remaining capacity >= size of an open sequence."""
        i = size + self.width
        while not self.open[i]:
            while i & 1:  # a right child: go up
                i //= 2
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:  # past the right edge
                return None
        while i < self.width:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.width


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, lo, hi, seq_lo, offset): ranks lo..hi-1 of a length go to sequences seq_lo.. at that offset."""
    tree, runs, made = Tightest(capacity), [], 0
    free: dict[int, list[list[int]]] = {}  # remaining capacity -> runs [seq_lo, n] of open sequences

    def keep(remaining: int, seq: int, n: int) -> None:
        if n and remaining:
            free.setdefault(remaining, []).append([seq, n])
            tree.put(remaining, True)

    def fill(size: int, rank: int, n: int, remaining: int, seq: int, bins: int) -> int:
        """Put n pieces into `bins` equal sequences, as many into each as fit; returns the next rank."""
        each = remaining // size
        full, over = divmod(n, each)
        for used, width, k in ((each, full, 0), (over, 1 if over else 0, full)):
            if width:
                for j in range(used):
                    runs.append((size, rank, rank + width, seq + k, capacity - remaining + j * size))
                    rank += width
                keep(remaining - used * size, seq + k, width)
        keep(remaining, seq + full + (over > 0), bins - full - (over > 0))
        return rank

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        rank, n = 0, counts[size]
        while rank < n:
            remaining = tree.at_least(size)
            if remaining is None:
                bins = -(-(n - rank) // (capacity // size))
                rank, made = fill(size, rank, n - rank, capacity, made, bins), made + bins
                continue
            seq, bins = free[remaining].pop()
            if not free[remaining]:
                tree.put(remaining, False)
            rank = fill(size, rank, min(n - rank, bins * (remaining // size)), remaining, seq, bins)
    return runs


def best_fit_pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, each: int = 100_000
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of the end id alone. Equal rows give equal pieces, each placed on its own. An
    empty table gives no rows. Columns beside the id and the text are ignored, whatever their names.
    """
    spark = docs.sparkSession
    cut = shared.stored(pieces(docs, id_col, text_col, capacity), "pieces")
    n = cut.count()
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(-(-n // each) or 1)))
    by_bucket = shared.stored(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")), "piece-counts")
    # at most `capacity` rows come to the driver
    counts = {r["length"]: r["n"] for r in by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(
        pack_histogram(counts, capacity), "length long, lo long, hi long, seq_lo long, offset long"
    )
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = by_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32"))
    ranked = cut.withColumn("own", own).join(before, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own") - 1)
    # the runs depend on the capacity, not on the corpus: a few for each of at most `capacity` lengths
    placed = ranked.join(F.broadcast(runs), "length").filter("rank >= lo and rank < hi")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("seq_lo") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset",
    )


def op9_best_fit_pack(spark, sf_dir):
    return best_fit_pack(shared.table(spark, sf_dir, "documents"))

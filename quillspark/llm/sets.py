"""Helpers for the similarity join: shingle sets of texts, Bloom filters of keys, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, shared

STEPS = np.random.default_rng(5).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its k-word shingles) of every text with at least one word.

    Words are separated by ASCII white space, A-Z lower-cased. A text of fewer than k words is one shingle.
    """
    for base, _, data, offsets in hashing.blocks(column):
        low = hashing.FOLD[data]
        start, end = hashing.spans(~hashing.SPACE[low], offsets)
        if not len(start):
            continue
        word = hashing.mix(hashing.windows(hashing.prefix(low), start, end) + (end - start).astype(np.uint64))
        row = np.searchsorted(offsets, start, "right") - 1
        n = len(word)
        first = np.searchsorted(row, np.arange(len(offsets)))
        whole = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            whole += word[j : j + len(whole)] * STEPS[j]
        full = row[: len(whole)] == row[k - 1 :] if len(whole) else np.zeros(0, bool)
        rows, hashes = row[: len(whole)][full], hashing.mix(whole[full])
        counts = np.diff(first)
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            own = [(word[first[r] : first[r + 1]] * STEPS[: counts[r]]).sum(dtype=np.uint64) + np.uint64(counts[r]) for r in short]
            rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, hashing.mix(np.array(own, np.uint64))])
        order = np.lexsort((hashes, rows))
        rows, hashes = rows[order], hashes[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        rows, hashes = rows[new], hashes[new]
        at = np.searchsorted(rows, np.arange(len(offsets)))
        for r in np.flatnonzero(np.diff(at)):
            yield base + int(r), hashes[at[r] : at[r + 1]]


class Bloom:
    """Blocked Bloom filter of 64-bit keys: one word of a fixed-size array and four of its bits for each key.

    Its size is bounded, so it may be broadcast whatever the corpus; with more keys it only lets more others pass.
    """

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @staticmethod
    def of(keys: DataFrame, column: str, expected: int, most_words: int = 1 << 21) -> Bloom:
        """Built by the executors: rows of the result are at most as many as the filter has words."""
        size = 1 << min(most_words.bit_length() - 1, max(10, (expected // 2).bit_length()))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, mask = Bloom.parts(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), size)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mask.view(np.int64))], ["at", "mask"])

        rows = keys.select(F.col(column).cast("long")).mapInArrow(place, "at long, mask long")
        got = rows.groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
        words = np.zeros(size, np.uint64)
        words[got.column("at").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
        return Bloom(words)

    @staticmethod
    def parts(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        h = hashing.mix(keys + np.uint64(0x5851F42D4C957F2D))
        mask = np.zeros(len(h), np.uint64)
        for shift in (0, 6, 12, 18):
            mask |= np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63))
        return ((h >> np.uint64(24)) % np.uint64(size)).astype(np.int64), mask

    def __contains__(self, keys: np.ndarray) -> bool:
        raise TypeError("use has()")

    def has(self, keys: np.ndarray) -> np.ndarray:
        at, mask = Bloom.parts(keys, len(self.words))
        return (self.words[at] & mask) == mask


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of every node of edges(a, b): root is the least node that can be reached.

    Alternating large-star and small-star steps; each halves the distance to the root or better, and each is an
    aggregation and a join, so hubs are summed map-side and joined by ranges of their rows.
    """
    sums = {"n": F.count(F.lit(1)), "h": F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0))}
    first = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = shared.stored_with(first, "edges", **sums)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        now, after = shared.stored_with(small.select("e.*").filter("a <> b").distinct(), "edges", **sums)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )

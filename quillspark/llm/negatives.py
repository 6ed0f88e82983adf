"""Hard negatives by exact inner products of integer vectors, multiplied tile by tile with Strassen's recursion.

Anchors and candidates meet in tiles of int64. A product of two tiles is halved in all three directions, with a row or
column of zeros where a side is odd, into seven products of sums in place of eight, down to small tiles; all sums are
of integers, so nothing is rounded. What a tile yields goes into heaps: one of positives for each anchor, one for each
(anchor, positive) whose entries lie within that positive's window of scores. Heaps of different tiles merge, so tiles
can be dealt over tasks in any way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

LEAF = 24  # no side of a tile under this is halved
TILE = 512  # rows of a tile of anchors, and of a tile of candidates
NONE = np.iinfo(np.int64).min  # score of an empty place in a heap
MOST_BROADCAST = 100_000  # rows of (key, pieces)
MOST = 2.0**62  # sum of squares of a vector: products of two stay within 64 bits


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of int64 matrices, exact modulo 2**64."""
    if min(*a.shape, b.shape[1]) < 2 * LEAF:
        return a @ np.ascontiguousarray(b.T).T
    m, n = a.shape[0], b.shape[1]
    if any(x % 2 for x in (*a.shape, n)):
        a = np.pad(a, [(0, x % 2) for x in a.shape])
        b = np.pad(b, [(0, x % 2) for x in b.shape])
    i, k, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    out = np.empty((2 * i, 2 * j), np.int64)
    c11, c12, c21, c22 = out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:]
    c11[:] = strassen(a11 + a22, b11 + b22)
    c22[:] = c11
    p = strassen(a21 + a22, b11)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12)
    c11 += strassen(a12 - a22, b21 + b22)
    return out[:m, :n]


class Heaps:
    """`n` heaps of the `k` best entries by (score descending, id ascending), as rows of sorted arrays."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        """Put a tile into the heaps: score has a row for each heap, NONE where an entry is not for it; ids ascend."""
        best = score.max(1)
        rows = np.flatnonzero((best != NONE) & (best >= self.score[:, -1]))
        tile, each = score[rows], np.arange(len(rows))
        new = Heaps(len(rows), self.k)
        for j in range(min(self.k, score.shape[1])):
            at = tile.argmax(1)  # the first of equals, so the one of least id
            new.score[:, j] = tile[each, at]
            new.id[:, j] = np.where(new.score[:, j] == NONE, new.id[:, j], ids[at])
            tile[each, at] = NONE
        self.merge(new, rows)

    def merge(self, other: Heaps, rows: np.ndarray) -> None:
        """Merge the heaps of other into those of the given rows."""
        score = np.concatenate([self.score[rows], other.score], 1)
        ids = np.concatenate([self.id[rows], other.id], 1)
        order = np.lexsort((ids, ~score), 1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(heap, score, id) of all that they hold."""
        heap, place = np.nonzero(self.score != NONE)
        return heap, self.score[heap, place], self.id[heap, place]


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64, copy=False)


def products(anchors: np.ndarray, candidates: np.ndarray, tile: int) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows of candidates, inner products of all anchors with them), tile by tile."""
    for j in range(0, len(candidates), tile):
        yield slice(j, j + tile), strassen(anchors, candidates[j : j + tile].T)


def windows(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score n with 50 * p <= 100 * n <= 95 * p, without a product that leaves 64 bits."""
    return -((-positive) // 2), 19 * (positive // 20) + 19 * (positive % 20) // 20


def integers(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str, vector_col: str) -> DataFrame:
    """id, label, anchor, v (floor(256 * x) of every component) of the rows that take part."""
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("x"),
    )
    short = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**40))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & short)
    rows = rows.select("id", "label", "anchor", F.transform("x", lambda x: F.floor(256 * x)).alias("v"))
    return rows.filter(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) < MOST)


def dealt(rows: DataFrame, by: list[str], each: int, name: str) -> tuple[DataFrame, DataFrame]:
    """rows with a number `name` that parts the rows of a key into pieces of about `each`, and (key, pieces)."""
    pieces = rows.groupBy(*by).agg(F.ceil(F.count("*") / each).alias("pieces"))
    pieces = shared.stored(pieces, "negative-pieces")
    few = F.broadcast(pieces) if pieces.count() <= MOST_BROADCAST else pieces
    return rows.join(few, by).withColumn(name, F.pmod(F.xxhash64("row"), "pieces")).drop("pieces"), few


def met(asked: DataFrame, rows: DataFrame, by: list[str], shard: int, chunk: int, look, schema: str) -> DataFrame:
    """look(anchors, candidates) for every chunk of anchors and piece of candidates of a key."""
    rows = rows.toDF(*rows.columns)  # columns of their own, as both sides may be one table
    rows, pieces = dealt(rows, by, shard, "piece")
    asked, chunks = dealt(asked, by, chunk, "chunk")
    every = lambda df, sizes, name: df.join(sizes, by).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).drop("pieces")
    keys = [*by, "piece", "chunk"]
    return every(asked, pieces, "piece").groupBy(*keys).cogroup(every(rows, chunks, "chunk").groupBy(*keys)).applyInPandas(look, schema)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3,
    id_col: str = "vec_id", vector_col: str = "embedding", shard: int = 32_768, chunk: int = 2048, tile: int = TILE,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A score is the inner product of floor(256 * x). An anchor's positives are its best `positives` other rows of its
    label, its negatives for each of these the best `negatives` rows of other labels that score from 50 % to 95 % of the
    positive, ties by the smaller id. is_anchor and label (default: the column `label`) are columns over vectors.

    Rows with a null id, label, vector or component, with a component that is not finite, or so long that products leave
    64 bits (a norm of 2^31 after scaling) take no part. Rows of the anchor's own id are no positives. Repeated rows
    count as many: an anchor that comes twice has its rows twice, a candidate that comes twice can be two positives or
    negatives. Only vectors of one length meet. Fewer rows than asked for give fewer, an empty table none; a positive
    whose window is empty has no row. Other columns are ignored, whatever their names.

    A task multiplies at most `chunk` anchors and about `shard` candidates. Positives are sought among pieces of one
    label, negatives in pieces of all rows, so a label that a third of all rows share is dealt over as many tasks.
    """
    rows = integers(vectors, is_anchor, F.col("label") if label is None else label, id_col, vector_col)
    rows = rows.withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id())
    rows = shared.stored(rows, "negative-rows")  # both passes read it
    asked, rows = rows.filter("anchor").drop("anchor"), rows.drop("anchor")

    def look_same(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        """The best rows of the anchors' label."""
        found = []
        if len(q) and len(c):
            c = c.sort_values("id")
            ids, points = c["id"].to_numpy(np.int64), matrix(c["v"])
            for i in range(0, len(q), tile):
                own = q.iloc[i : i + tile]
                heaps = Heaps(len(own), positives)
                for at, score in products(matrix(own["v"]), points, tile):
                    score[own["id"].to_numpy(np.int64)[:, None] == ids[at]] = NONE
                    heaps.offer(score, ids[at])
                heap, score, other = heaps.entries()
                found.append(pd.DataFrame({"row": own["row"].to_numpy()[heap], "positive_id": other, "positive_score": score}))
        return pd.concat(found) if found else pd.DataFrame({"row": [], "positive_id": [], "positive_score": []}, dtype="int64")

    def look_others(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        """The best rows of other labels within the window of each positive."""
        names = ["row", "place", "negative_id", "negative_score"]
        found = [pd.DataFrame({n: [] for n in names}, dtype="int64")]
        if len(q) and len(c):
            c = c.sort_values("id")
            ids, labels, points = c["id"].to_numpy(np.int64), c["label"].to_numpy(np.int64), matrix(c["v"])
            for i in range(0, len(q), tile):
                own = q.iloc[i : i + tile]
                n, label_ = len(own), own["label"].to_numpy(np.int64)
                low, high = np.full((positives, n), 1), np.full((positives, n), 0)  # an empty window where a positive is missing
                for j, scores in enumerate(own["scores"]):
                    low[: len(scores), j], high[: len(scores), j] = windows(np.asarray(scores, np.int64))
                heaps = [Heaps(n, negatives) for _ in range(positives)]
                for at, score in products(matrix(own["v"]), points, tile):
                    score[label_[:, None] == labels[at]] = NONE
                    for p, heap in enumerate(heaps):
                        within = (score >= np.maximum(low[p], heap.score[:, -1])[:, None]) & (score <= high[p][:, None])
                        heap.offer(np.where(within, score, NONE), ids[at])
                for p, heap in enumerate(heaps):
                    at, score, other = heap.entries()
                    found.append(pd.DataFrame(dict(zip(names, (own["row"].to_numpy()[at], p, other, score), strict=True))))
        return pd.concat(found)

    best = met(asked, rows, ["label", "dim"], shard, chunk, look_same, "row long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id"))
    best = shared.stored(best.withColumn("place", place - 1).filter(F.col("place") < positives), "negative-positives")
    scores = best.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    found = met(asked.join(scores, "row"), rows.drop("row").withColumn("row", F.monotonically_increasing_id()), ["dim"], shard, chunk, look_others, "row long, place int, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    named = best.join(asked.select("row", F.col("id").alias("anchor_id")), "row")
    return named.join(found, ["row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir):
    vectors = shared.table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0, label)


OP11_SQL = """with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
    list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
  from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, id)::int as rank,
  id as negative_id, positive_score, score as negative_score
from p join s on p.anchor_id = s.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, id) <= 3"""

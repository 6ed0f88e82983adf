"""Approximate nearest neighbours by vantage-point trees, one per shard of the vectors.

A tree keeps at each node a vantage point and, for the nearer and the farther half of what is below, the range of
distances to it. By the triangle inequality no vector of a half can be nearer to a query than the gap between the
query's distance and that range. A half is left out if gap * factor exceeds the distance of the k-th best so far:
factor 1 is exact search, a larger one prunes more.

The tree of a shard is built once and stored; queries come to it in blocks of rows, so that neither side of the search
is ever whole in one task.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

LEAF = 64
FACTOR = 5.0  # of the pruning; recall and the share of vectors seen at it are in the README


class VpTree:
    """Tree over the rows of an array; nodes are tuples, leaves arrays of row numbers."""

    def __init__(self, points: np.ndarray, seed: int = 11) -> None:
        self.points = points
        rng = np.random.default_rng(seed)
        self.root = self.build(np.arange(len(points)), rng)

    def build(self, rows: np.ndarray, rng: np.random.Generator):
        if len(rows) <= LEAF:
            return rows
        trial = self.points[rng.choice(rows, min(64, len(rows)), replace=False)]
        options = rng.choice(rows, 8, replace=False)
        spread = [np.sqrt(((trial - self.points[o]) ** 2).sum(1)).std() for o in options]
        vantage = int(options[int(np.argmax(spread))])
        rest = rows[rows != vantage]
        away = np.sqrt(((self.points[rest] - self.points[vantage]) ** 2).sum(1))
        order = np.argsort(away, kind="stable")  # halves by rank, so equal vectors part too
        half = len(order) // 2
        near, far = order[:half], order[half:]
        ranges = [(away[part].min(), away[part].max()) for part in (near, far)]
        return vantage, ranges, self.build(rest[near], rng), self.build(rest[far], rng)

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, factor: float):
        """(distances, rows) of the k best found for each query, -1 where fewer; own: ids to leave out."""
        n = len(queries)
        self.seen = 0  # (query, point) pairs that were looked at
        best = np.full((n, k), np.inf)
        found = np.full((n, k), -1, np.int64)
        q_norm, p_norm = (queries**2).sum(1), (self.points**2).sum(1)

        def offer(q: np.ndarray, rows: np.ndarray) -> None:
            """Merge the rows into the k best of the queries; only what a matrix product can't exclude is measured."""
            self.seen += len(q) * len(rows)
            square = q_norm[q, None] + p_norm[rows][None, :] - 2 * queries[q] @ self.points[rows].T
            slack = 1e-9 * (q_norm[q, None] + p_norm[rows][None, :] + 1)
            maybe = (square <= (best[q, -1] ** 2)[:, None] + slack) & (ids[rows][None, :] != own[q, None])
            i, j = np.nonzero(maybe)
            if not len(i):
                return
            away = np.sqrt(((queries[q[i]] - self.points[rows[j]]) ** 2).sum(1))
            some = np.unique(i)
            place = np.searchsorted(some, i)
            old = np.repeat(np.arange(len(some)), k)
            who = np.concatenate([old, place])
            d = np.concatenate([best[q[some]].ravel(), away])
            r = np.concatenate([found[q[some]].ravel(), rows[j]])
            tie = np.where(r >= 0, ids[r], np.iinfo(np.int64).max)
            order = np.lexsort((tie, d, who))
            first = np.searchsorted(who[order], np.arange(len(some)))
            top = order[first[:, None] + np.arange(k)]
            best[q[some]], found[q[some]] = d[top], r[top]

        def visit(node, q: np.ndarray) -> None:
            if not len(q):
                return
            if isinstance(node, np.ndarray):
                if len(node):
                    offer(q, node)
                return
            vantage, ranges, *halves = node
            offer(q, np.array([vantage]))
            d = np.sqrt(((queries[q] - self.points[vantage]) ** 2).sum(1))
            gaps = [np.maximum(0, np.maximum(lo - d, d - hi)) for lo, hi in ranges]
            nearer = gaps[0] <= gaps[1]
            nearer = np.where(gaps[0] == gaps[1], d <= (ranges[0][1] + ranges[1][0]) / 2, nearer)
            for i, first in ((0, nearer), (1, ~nearer)):
                visit(halves[i], q[first])
            for i, later in ((0, ~nearer), (1, nearer)):
                visit(halves[i], q[later][gaps[i][later] * factor <= best[q[later], -1]])

        if len(self.points):
            visit(self.root, np.arange(n))
        return best, found


def sound(vector: Column) -> Column:
    """Vectors that take part: not null, not empty, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR, shard: int = 8192, block: int = 2048,
    chunk: int = 16, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), id_col, score: the k nearest found of each query by Euclidean distance, in double.

    Vectors are dealt to shards of about `shard` rows by a hash, whose trees are stored; queries to blocks of about
    `block` rows. A task holds one tree against at most `chunk` blocks, so neither grows with the corpus. Vectors with
    the query's own id are left out. Rows with a null id and unsound vectors (see sound()) take no part on either side.
    Ties go to the smaller id. Repeated rows count as many: a query row that comes twice has its k rows twice, ranks
    1 to k each time, and a vector that comes twice can be two of its neighbours. Fewer than k candidates give fewer
    rows, an empty table none. Vectors of a length other than the query's take no part in its search. Other columns
    are ignored, whatever their names.
    """
    pick = lambda df: df.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")
    ).filter(F.col("id").isNotNull() & sound(F.col("v"))).withColumn("dim", F.size("v"))
    base = pick(vectors)
    asked = shared.stored(pick(queries).withColumn("row", F.monotonically_increasing_id()), "near-queries")
    shards, blocks = -(-base.count() // shard) or 1, -(-asked.count() // block) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # rows of one id are dealt like all others
    base = base.withColumn("shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)))

    def plant(c: pd.DataFrame) -> pd.DataFrame:
        tree = VpTree(np.stack(c["v"].to_numpy()))
        return pd.DataFrame({"shard": c["shard"].iloc[:1], "dim": c["dim"].iloc[:1], "tree": [pickle.dumps((c["id"].to_numpy(np.int64), tree))]})

    trees = shared.stored(base.groupBy("shard", "dim").applyInPandas(plant, "shard long, dim int, tree binary"), "near-trees")
    trees = trees.withColumn("chunk", every(-(-blocks // chunk)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn("shard", every(shards))
    asked = asked.withColumn("chunk", F.floor(F.col("block") / chunk))

    def look(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"row": [], "query_id": [], "id": [], "score": []}).astype({"row": "int64", "query_id": "int64", "id": "int64"})]
        for tree_bytes in t["tree"]:
            ids, tree = pickle.loads(tree_bytes)
            for _, some in q.groupby("block"):
                own, row = some["id"].to_numpy(np.int64), some["row"].to_numpy(np.int64)
                away, rows = tree.search(np.stack(some["v"].to_numpy()), own, ids, k, factor)
                at, _ = np.nonzero(rows >= 0)
                found.append(pd.DataFrame({"row": row[at], "query_id": own[at], "id": ids[rows[rows >= 0]], "score": away[rows >= 0]}))
        return pd.concat(found, ignore_index=True)

    keys = ["shard", "chunk", "dim"]
    found = asked.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInPandas(look, "row long, query_id long, id long, score double")
    order = Window.partitionBy("row").orderBy("score", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def op1_vp_nearest(spark, sf_dir):
    vectors = shared.table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"))

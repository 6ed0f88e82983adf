"""Toxicity by maximum-scoring segments.

Token log-odds between toxic and other labelled documents, with an informative Dirichlet prior, become token scores;
a linear-time scan finds every maximal-scoring segment of a document; extreme-value statistics of the segments of
clean documents turn segment scores into E-values, whose evidence is summed and calibrated to a probability.

Tokens are runs of letters, and of each the whole word and its first 4 and 6 bytes are counted, so that inflected
forms share evidence. Features are hashed into 2**BITS buckets, so the model has one size for any vocabulary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, shared

BITS = 17
DRIFT = 0.7  # subtracted from each token's log-odds, so that ordinary text scores below zero
MAX_LABELLED = 200_000  # documents that the classifier learns from, at most (about)
LETTER = np.zeros(256, bool)
LETTER[[*range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token its row, and the buckets (tokens x 3) of its word and two beginnings."""
    low = hashing.FOLD[data]
    start, end = hashing.spans(LETTER[low], offsets)
    p = hashing.prefix(low)
    keys = [hashing.windows(p, start, e) for e in (end, np.minimum(end, start + 4), np.minimum(end, start + 6))]
    salted = [(hashing.mix(k + np.uint64(i)) >> np.uint64(64 - BITS)).astype(np.int32) for i, k in enumerate(keys)]
    return np.searchsorted(offsets, start, "right") - 1, np.stack(salted, 1)


def sampled_labels(labels: DataFrame, label: str, limit: int = MAX_LABELLED) -> DataFrame:
    """(id, y) of labelled rows that may be learnt from, one per id; of more than `limit`, a share by hash."""
    rows = labels.filter(~shared.held_out(F.col("doc_id")) & F.col(label).isNotNull())
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    n = rows.count()
    if n > limit:
        share = int(limit / n * (1 << 20))
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share)
    return rows


def bucket_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Token counts by bucket in toxic (y = 1) and other rows of (y, text); 2**BITS rows come to the driver at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False) > 0
            for first, _, data, offsets in hashing.blocks(batch.column("text")):
                row, buckets = features(data, offsets)
                for k in (0, 1):
                    seen[k] += np.bincount(buckets[y[row + first] == k].ravel(), minlength=1 << BITS)
        some = np.flatnonzero(seen.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[1, some]), pa.array(seen[0, some])], ["b", "t", "c"])

    by_task = docs.mapInArrow(count, "b long, t long, c long")
    got = by_task.groupBy("b").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).toPandas()
    toxic, clean = np.zeros(1 << BITS), np.zeros(1 << BITS)
    toxic[got["b"]], clean[got["b"]] = got["t"], got["c"]
    return toxic, clean


def log_odds(toxic: np.ndarray, clean: np.ndarray, prior: float = 10_000.0) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratio of every bucket under a Dirichlet prior of the pooled counts, shrunk by its z-score; and |z|."""
    both = toxic + clean
    a = prior * (both + 0.5) / (both + 0.5).sum()
    t, c = toxic + a, clean + a
    delta = np.log(t / (t.sum() - t)) - np.log(c / (c.sum() - c))
    z = delta / np.sqrt(1 / t + 1 / c)
    return (delta * np.maximum(0, 1 - (3.0 / np.maximum(np.abs(z), 1e-9)) ** 2)).astype(np.float32), np.abs(z).astype(np.float32)


def maximal_segments(at: list[int], total: list[float], score: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments, in linear time, given the positive items: their places, the sum of all scores
    up to and including each, and their scores. Segments begin and end at positive items, so no others matter."""
    found: list[list[float]] = []  # start, end, sum before, sum at end
    for i, end, s in zip(at, total, score, strict=True):
        new = [i, i, end - s, end]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4] if len(found[j]) > 4 else j - 1
            if j < 0 or found[j][3] >= new[3]:
                found.append([*new, j])
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(f[0]), int(f[1]), f[3] - f[2]) for f in found]


def segments(docs: DataFrame, weight: np.ndarray, z: np.ndarray) -> DataFrame:
    """id, tokens, segments (first and last token, score) of rows (id, text)."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
    model = docs.sparkSession.sparkContext.broadcast((weight, z))  # 1 MB, whatever the corpus

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, z = model.value
        for batch in batches:
            tokens = np.zeros(batch.num_rows, np.int64)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for start, _, data, offsets in hashing.blocks(batch.column("text")):
                row, buckets = features(data, offsets)
                n = np.bincount(row, minlength=len(offsets) - 1)
                tokens[start : start + len(n)] = n
                best = np.take_along_axis(buckets, z[buckets].argmax(1)[:, None], 1)[:, 0] if len(row) else row
                score = weight[best].astype(np.float64) - DRIFT
                total, first = np.cumsum(score), np.concatenate([[0], np.cumsum(n)])
                up = np.flatnonzero(score > 0)
                cut = np.searchsorted(up, first)
                for k in np.flatnonzero(np.diff(cut)):
                    at = up[cut[k] : cut[k + 1]]
                    got = maximal_segments((at - first[k]).tolist(), total[at].tolist(), score[at].tolist())
                    found[start + k] = [{"first": a, "last": b, "score": s} for a, b, s in got]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(tokens), pa.array(found, kind)], ["id", "tokens", "segments"])

    return docs.select("id", "text").mapInArrow(scan, "id long, tokens long, segments array<struct<first:int,last:int,score:double>>")


def logistic_1d(bins: list[tuple[float, float, float]], steps: int = 60) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a + b x))) by Newton's method over (x, rows, rows of label 1), with a weak prior."""
    theta = np.zeros(2)
    x = np.array([[1.0, b[0]] for b in bins] or np.zeros((0, 2)))
    n, y = np.array([b[1] for b in bins]), np.array([b[2] for b in bins])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (n * p - y) + 0.02 * theta
        theta = theta - np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + 0.02 * np.eye(2), slope).clip(-5, 5)
    return float(theta[0]), float(theta[1])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1), passages (first and last token, score, e_value).

    Learns from at most about MAX_LABELLED rows of labels(doc_id, toxic) that are not held out. Null texts count as
    empty and score as a text without a toxic passage. Without labels no token has evidence and all score 0.5.
    Several labels of one id count as toxic if one is. Equal rows give equal rows, an empty table none; columns
    beside the id and the text are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    known = shared.stored(sampled_labels(labels, "toxic"), "toxic-labels")  # bounded, so it may be broadcast
    weight, z = log_odds(*bucket_counts(rows.join(F.broadcast(known), "id").select("y", "text")))
    found = shared.stored(segments(rows, weight, z), "toxic-segments")

    learn = found.join(F.broadcast(known), "id")
    clean = learn.filter("y = 0").agg(
        F.sum("tokens").alias("tokens"), F.sum(F.size("segments")).alias("n"),
        F.sum(F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["score"])).alias("score"),
    ).first()
    # tail of clean segments: so many a token (K), exponential in the score (lambda)
    k = ((clean["n"] or 0) + 1) / ((clean["tokens"] or 0) + 1000)
    lam = ((clean["n"] or 0) + 1) / ((clean["score"] or 0.0) + 1)
    e_value = lambda s: k * F.greatest(F.col("tokens"), F.lit(1)) * F.exp(-lam * s["score"])
    evidence = F.aggregate("segments", F.lit(0.0), lambda a, s: a + F.greatest(F.lit(0.0), -F.log(e_value(s))))
    x = F.least(F.round(evidence * 4) / 4, F.lit(60.0))
    bins = learn.groupBy(x.alias("x")).agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()  # 241 at most
    a, b = logistic_1d([(r["x"], r["n"], r["y"]) for r in bins])
    passages = F.transform(F.filter("segments", lambda s: e_value(s) < 1), lambda s: F.struct(
        s["first"].alias("first"), s["last"].alias("last"), s["score"].alias("score"), e_value(s).alias("e_value")))
    return found.select(F.col("id").alias(id_col), (1 / (1 + F.exp(-(F.lit(a) + F.lit(max(b, 0.0)) * x)))).alias("score"), passages.alias("passages"))


def op2_toxicity(spark, sf_dir):
    out = toxicity(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", shared.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )

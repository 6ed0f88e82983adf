"""Quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

Statistics come from byte histograms and word counts of each whole text. Standardised with the mean and deviation of
the whole corpus, they are mapped by random Fourier features of a Gaussian kernel. Each partition of the labelled rows
sums its part of the normal equations; the sums are added and solved. The scores of the labelled rows are then
calibrated by pool-adjacent-violators over a histogram of a fixed number of bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, shared
from .toxicity import MAX_LABELLED, sampled_labels

STATS = [
    "log_bytes", "lower", "upper", "digits", "white", "stops", "symbols", "high", "breaks", "shouts", "bars",
    "word_bytes", "long_words", "distinct_words", "common_word", "distinct_lines", "entropy", "symbol_ends",
]
FEATURES = 256
BINS = 1000
PER_TASK = 25_000  # labels whose rows one task sums


def classes() -> np.ndarray:
    """One row for each byte class, over the 256 byte values."""
    rows = np.zeros((10, 256))
    for row, members in enumerate(
        [range(97, 123), range(65, 91), range(48, 58), [32, *range(9, 14)], b".,;:?'\"()-", b"%&$*#@^~_=+<>{}[]\\/`", range(128, 256), b"\n", b"!", b"|"]
    ):
        rows[row, list(members)] = 1
    return rows


def one_text(data: np.ndarray, by_class: np.ndarray) -> list[float]:
    """The statistics of a text, given as bytes; zeros for an empty one."""
    n = len(data)
    if not n:
        return [0.0] * len(STATS)
    counts = np.bincount(data, minlength=256)
    share = counts / n
    raw = data.tobytes()
    words, lines = raw.split(), raw.split(b"\n")
    if words:
        p = hashing.prefix(data)
        start, end = hashing.spans(~hashing.SPACE[data], np.array([0, n]))
        _, times = np.unique(hashing.windows(p, start, end), return_counts=True)
        sizes = end - start
        odd = by_class[5, data[end - 1]].mean()
        by_word = [sizes.mean(), (sizes > 15).mean(), len(times) / len(sizes), times.max() / len(sizes)]
    else:
        by_word, odd = [0.0] * 4, 0.0
    some = share[share > 0]
    own = (by_class @ share).tolist()
    return [np.log1p(n), *own, *by_word, len(set(lines)) / len(lines), float(-(some * np.log(some)).sum()), odd]


def statistics(docs: DataFrame) -> DataFrame:
    """id and the statistics of every row of (id, text)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_class = classes()
        for batch in batches:
            data, at = hashing.column_bytes(batch.column("text"))
            rows = np.array([one_text(data[a:b], by_class) for a, b in zip(at, at[1:], strict=False)]).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), *map(pa.array, rows.T)], ["id", "row", *STATS])

    return docs.select("id", "row", "text").mapInArrow(measure, "id long, row long, " + ", ".join(f"{s} double" for s in STATS))


class Kernel:
    """Standardisation and random Fourier features; the same for any corpus but for means and deviations."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, gamma: float = 0.05, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(0, np.sqrt(2 * gamma), (len(STATS), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.std, -6, 6)
        z = np.sqrt(2 / FEATURES) * np.cos(x @ self.w + self.b)
        return np.hstack([z, np.ones((len(x), 1))])


def ridge(learn: DataFrame, kernel: Kernel, strength: float = 1e-3) -> np.ndarray:
    """Weights from partition sums of the normal equations over rows of the statistics and y.

    The labelled rows are few and their partitions hold many each, so the driver adds up few sums.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xx, xy = np.zeros((FEATURES + 1,) * 2), np.zeros(FEATURES + 1)
        for batch in batches:
            z, y = kernel(batch[STATS].to_numpy()), batch["y"].to_numpy(float)
            xx, xy = xx + z.T @ z, xy + z.T @ y
        yield pd.DataFrame({"sums": [np.vstack([xx, xy]).tobytes()]})

    sums = [np.frombuffer(bytes(r["sums"])).reshape(FEATURES + 2, -1) for r in learn.mapInPandas(add, "sums binary").collect()]
    total = np.sum(sums, 0) if sums else np.zeros((FEATURES + 2, FEATURES + 1))
    penalty = strength * max(1.0, total[FEATURES, FEATURES]) / FEATURES * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-6
    return np.linalg.solve(total[:-1] + penalty, total[-1])


def isotonic(bins: list[tuple[int, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over (bin, rows, rows of label 1): bins and their non-decreasing values, in (0, 1)."""
    pools: list[list[float]] = []
    for at, n, y in sorted(bins):
        pools.append([at, at, n, y])
        while len(pools) > 1 and pools[-2][3] / pools[-2][2] >= pools[-1][3] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    if not pools:
        return np.array([0.0, BINS]), np.array([0.5, 0.5])
    value = [(y + 0.5) / (n + 1) for _, _, n, y in pools]
    x = [p for a, b, _, _ in pools for p in ((a,) if a == b else (a, b))]
    v = [q for (a, b, _, _), q in zip(pools, value, strict=True) for q in ((q,) if a == b else (q, q))]
    return np.array(x, float), np.maximum.accumulate(v)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: id, score (0 to 1, the calibrated probability of label 1).

    Learns from at most about MAX_LABELLED rows of labels(doc_id, quality) that are not held out; of several labels
    of one id the larger counts. Null texts count as empty, whose statistics are zeros. Without labels all score
    0.5. Equal rows give equal rows, an empty table none; columns beside the id and the text are ignored.
    row_col names a column of numbers of rows, which then comes back too.
    """
    row = F.col(f"`{row_col}`").cast("long") if row_col else F.lit(0).cast("long")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), row.alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    stats = shared.stored(statistics(rows), "quality-statistics")
    both = stats.agg(*(f(s).alias(f"{f.__name__}_{s}") for s in STATS for f in (F.avg, F.stddev_pop))).first()
    mean, std = (np.array([both[f"{f}_{s}"] or 0.0 for s in STATS]) for f in ("avg", "stddev_pop"))
    kernel = Kernel(mean, std)
    known = shared.stored(sampled_labels(labels, "quality", MAX_LABELLED), "quality-labels")  # bounded, so it may be broadcast
    found = stats.join(F.broadcast(known), "id").select(*STATS, "y")
    learn = shared.stored(found.repartition(-(-known.count() // PER_TASK) or 1), "quality-learn")
    weights = ridge(learn, kernel)

    def raw(batch: pd.DataFrame) -> np.ndarray:
        return np.clip(kernel(batch[STATS].to_numpy(float)) @ weights, -0.2, 1.2)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.round((raw(batch) + 0.2) / 1.4 * BINS).astype(int)
            yield pd.DataFrame({"at": at, "y": batch["y"]}).groupby("at").y.agg(["size", "sum"]).reset_index()

    bins = learn.mapInPandas(binned, "at long, size long, sum long").groupBy("at").agg(F.sum("size").alias("n"), F.sum("sum").alias("y"))
    x, value = isotonic([(r["at"], r["n"], r["y"]) for r in bins.collect()])  # BINS + 1 rows at most

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            calibrated = np.interp((raw(batch) + 0.2) / 1.4 * BINS, x, value)
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "score": calibrated, "row": batch["row"]})

    out = stats.mapInPandas(scored, "id long, score double, row long")
    return out.select(F.col("id").alias(id_col), "score", *([F.col("row").alias(row_col)] if row_col else []))


def op7_quality(spark, sf_dir):
    out = quality(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", shared.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )

"""Ranked lexical search: accumulators of the short lists, taken as one bounded iterator in a document-at-a-time pass.

Documents are dealt to shards of some thousand. For the terms of the queries a shard keeps posting lists (local document
number, frequency) in the order of document ids. A query first goes term-at-a-time over its short lists and sums them
into accumulators; these form one more list, with a bound, beside the long ones. Then it goes document-at-a-time over
blocks of documents: a block whose bounds add up to less than the score to beat is skipped on every list at once,
inside a block the lists are added in the order of their bounds until the rest can't matter, and the best documents
stay. All scores are integers, so skipping changes no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing, shared

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
IN_TERM = np.zeros(256, bool)  # of bytes in UTF-8; the same set as TERMS
IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SHARD = 16_384  # documents
SHARD_BYTES = 64 << 20  # of their texts
BLOCK = 256  # documents that are skipped or scored together
SHORT = 16  # a list of at most 1 / SHORT of a shard's documents is short
QUERY_BYTES = 32 << 20  # of query texts, searched in one pass over the documents
SHARD_SCHEMA = (
    "n_docs long, n_terms long, doc_id binary, is_null binary, length binary, term array<int>, df array<int>, doc binary, tf binary"
)


class Vocabulary:
    """The terms of the queries, found in texts by a hash and confirmed byte by byte."""

    def __init__(self, terms: list[str]) -> None:
        raw = [t.encode("utf-8") for t in terms]
        self.size = np.array([len(x) for x in raw], np.int64)
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.at = np.cumsum(self.size) - self.size
        h = self.hashes(self.data, self.at, self.at + self.size) if raw else np.zeros(0, np.uint64)
        self.order = np.argsort(h, kind="stable")
        self.sorted = h[self.order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[h >> np.uint64(44)] = True

    @staticmethod
    def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return hashing.mix(hashing.windows(hashing.prefix(data), start, end) + (end - start).astype(np.uint64))

    def find(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of a word, its term) of the words low[start:end] that are terms."""
        h = self.hashes(low, start, end)
        word = np.flatnonzero(self.maybe[h >> np.uint64(44)])
        if not len(word) or not len(self.sorted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.sorted, h[word])
        hit = self.sorted[np.minimum(at, len(self.sorted) - 1)] == h[word]
        word, term = word[hit], self.order[np.minimum(at, len(self.sorted) - 1)[hit]]
        same = self.size[term] == (end - start)[word]
        word, term = word[same], term[same]
        size = self.size[term]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        equal = low[np.repeat(start[word], size) + inside] == self.data[np.repeat(self.at[term], size) + inside]
        if not equal.all():
            good = np.minimum.reduceat(equal, np.cumsum(size) - size)
            word, term = word[good], term[good]
        return word, term


def smallest(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8 if not len(x) or x.max() < 1 << 8 else np.uint32)


def build_shards(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """One row for each shard: its documents with at least one term, in the order of their ids, and postings of `terms`."""

    def shard(ids: list, nulls: list, lengths: list, postings: list) -> pa.RecordBatch:
        doc_id, null, length = np.concatenate(ids), np.concatenate(nulls), np.concatenate(lengths)
        order = np.lexsort((doc_id, null))
        order = order[length[order] > 0]
        place = np.zeros(len(doc_id), np.int64)
        place[order] = np.arange(len(order))
        doc, term, tf = (np.concatenate(x) for x in zip(*postings, strict=True)) if postings else (np.zeros(0, np.int64),) * 3
        by = np.argsort(term * (len(order) + 1) + place[doc], kind="stable")
        found, df = np.unique(term, return_counts=True)
        row = [
            [len(order)], [int(length.sum())], [doc_id[order].astype("<i8").tobytes()], [null[order].tobytes()], [length[order].astype("<i8").tobytes()],
            [found.astype(np.int32)], [df.astype(np.int32)], [place[doc][by].astype("<u2").tobytes()], [tf[by].astype("<u4").tobytes()],
        ]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names)

    names = [x.split()[0] for x in SHARD_SCHEMA.split(", ")]
    types = [pa.int64()] * 2 + [pa.binary()] * 3 + [pa.list_(pa.int32())] * 2 + [pa.binary()] * 2

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(terms)
        ids, nulls, lengths, postings, n, size = [], [], [], [], 0, 0
        for batch in batches:
            column, doc_id = batch.column("text"), batch.column("id")
            for first, last, data, offsets in hashing.blocks(column):
                for a in range(first, last, SHARD):  # a block of tiny texts may hold more than a shard
                    b = min(last, a + SHARD)
                    at = offsets[a - first : b - first + 1]
                    low = hashing.FOLD[data[at[0] : at[-1]]]
                    at = at - at[0]
                    if n and (n + b - a > SHARD or size + len(low) > SHARD_BYTES):
                        yield shard(ids, nulls, lengths, postings)
                        ids, nulls, lengths, postings, n, size = [], [], [], [], 0, 0
                    start, end = hashing.spans(IN_TERM[low], at) if len(low) else (np.zeros(0, np.int64),) * 2
                    row = np.searchsorted(at, start, "right") - 1
                    word, term = known.find(low, start, end)
                    pair, tf = np.unique(row[word] * max(1, len(terms)) + term, return_counts=True)
                    own = doc_id[a:b]
                    ids.append(own.fill_null(0).to_numpy(zero_copy_only=False))
                    nulls.append(own.is_null().to_numpy(zero_copy_only=False))
                    lengths.append(np.bincount(row, minlength=b - a))
                    postings.append((n + pair // max(1, len(terms)), pair % max(1, len(terms)), tf))
                    n, size = n + b - a, size + len(low)
        if n:
            yield shard(ids, nulls, lengths, postings)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(index, SHARD_SCHEMA)


class Shard:
    """Posting lists of a shard with the score that each posting adds; documents are numbered in the order of their ids."""

    def __init__(self, row: dict, weight: np.ndarray, n: int, total: int) -> None:
        self.doc_id, self.is_null = np.frombuffer(row["doc_id"], "<i8"), np.frombuffer(row["is_null"], bool)
        self.n = len(self.doc_id)
        length = np.frombuffer(row["length"], "<i8")
        if len(length) and int(length.max()) * n >= 2**63 // 50:
            norm = np.array([50 + 50 * x * n // total for x in length.tolist()], np.int64)
        else:
            norm = 50 + 50 * length * n // max(1, total)
        term, df = np.array(row["term"], np.int64), np.array(row["df"], np.int64)
        self.doc, tf = np.frombuffer(row["doc"], "<u2").astype(np.int64), np.frombuffer(row["tf"], "<u4").astype(np.int64)
        self.adds = np.repeat(weight[term], df) * (1_000_000_000 * tf // (1000 * tf + 20 * norm[self.doc]))
        ends = np.cumsum(df)
        self.lists = {int(t): (int(e - d), int(e)) for t, d, e in zip(term, df, ends, strict=True)}
        self.blocks = -(-self.n // BLOCK)
        self.edges = np.arange(self.blocks + 1) * BLOCK
        self.known: dict[int, tuple] = {}

    def bounded(self, doc: np.ndarray, adds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A list with the place where each block begins and the most that it adds in each block."""
        at = np.searchsorted(doc, self.edges)
        most = np.zeros(self.blocks, np.int64)
        some = np.flatnonzero(at[1:] > at[:-1])
        if len(some):
            most[some] = np.maximum.reduceat(adds, at[some])
        return doc, adds, at, most

    def long_list(self, term: int) -> tuple:
        if term not in self.known:
            a, b = self.lists[term]
            self.known[term] = self.bounded(self.doc[a:b], self.adds[a:b])
        return self.known[term]

    def search(self, terms: list[int], k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(score, document) of the k best by (score descending, document), of those that score floor or more."""
        own = [t for t in terms if t in self.lists]
        size = {t: self.lists[t][1] - self.lists[t][0] for t in own}
        short = [self.lists[t] for t in own if size[t] * SHORT <= self.n]
        lists = [self.long_list(t) for t in own if size[t] * SHORT > self.n]
        if short:  # term at a time: summed accumulators, then one more list
            doc = np.concatenate([self.doc[a:b] for a, b in short])
            order = np.argsort(doc, kind="stable")
            doc, adds = doc[order], np.concatenate([self.adds[a:b] for a, b in short])[order]
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            doc, adds = doc[first], np.add.reduceat(adds, first)
            lists.append(self.bounded(doc, adds))
            if len(adds) >= k:  # so many documents score at least this
                floor = max(floor, int(np.partition(adds, len(adds) - k)[len(adds) - k]))
        score, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not lists:
            return score, best
        bounds = np.stack([x[3] for x in lists])
        total = bounds.sum(0)
        self.seen = 0
        for block in np.flatnonzero(total >= floor).tolist():
            # later documents lose ties against those that are kept already
            need = max(floor, int(score[-1]) + 1) if len(score) == k else floor
            rest = int(total[block])
            if rest < need:
                continue
            self.seen += 1
            sums, base = np.zeros(BLOCK, np.int64), block * BLOCK
            for i in np.argsort(-bounds[:, block], kind="stable").tolist():
                if not (most := int(bounds[i, block])) or int(sums.max()) + rest < need:
                    break
                doc, adds, at, _ = lists[i]
                a, b = at[block], at[block + 1]
                sums[doc[a:b] - base] += adds[a:b]
                rest -= most
            else:
                most = 0
            if rest:
                continue  # none of its documents can reach what is needed
            new = np.flatnonzero(sums >= need)
            if len(new):
                score, best = np.concatenate([score, sums[new]]), np.concatenate([best, new + base])
                top = np.lexsort((best, -score))[:k]
                score, best = score[top], best[top]
        return score, best


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text",
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """item_col, rank (from 1), id_col, score: the k best documents of each item that score above 0, ties by the id.

    Terms are runs of letters and digits of ASCII and of all other signs beyond it, A-Z lower-cased. A document's score
    is the sum over the item's distinct terms of w * (10^9 * tf div (1000 * tf + 20 * m)), w = floor(1000 * ln((2N + 2)
    / (2 df + 1))) and m = 50 + 50 * n * N div L over all documents with at least one term. A null text has no terms; a
    null document id ranks after others of its score. Repeated documents each hold a rank; repeated items each have
    their rows. Items without terms, and those that no document matches, have none; empty tables give none. Other
    columns are ignored, whatever their names.

    Documents are read once for each `query_bytes` of query texts, whose terms (so bounded) go to all tasks. A shard
    has at most SHARD documents; a task keeps k documents an item and the best of all tasks meet by item.
    """
    asked = items.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.coalesce(F.col(f"`{query_col}`"), F.lit("")).alias("text"))
    asked = shared.stored(asked.withColumn("row", F.monotonically_increasing_id()), "search-items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = -(-size // query_bytes) or 1
    words = F.array_distinct(F.regexp_extract_all(shared.ascii_lower(F.col("text")), F.lit(TERMS), F.lit(0)))
    asked = asked.select("item", "row", words.alias("words")).withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    found = None
    for chunk in range(chunks):  # one pass for each bounded part of the queries
        some = asked.filter(F.col("chunk") == chunk)
        out = search_part(docs, [(r["item"], r["row"], r["words"]) for r in some.collect()], k, id_col, text_col)
        found = out if found is None else found.unionByName(out)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def search_part(docs: DataFrame, asked: list[tuple[int, int, list[str]]], k: int, id_col: str, text_col: str) -> DataFrame:
    """item, row, id, score: of each query (item, row, words) the k best documents of every task."""
    terms = sorted({w for _, _, words in asked for w in words})
    number = {t: i for i, t in enumerate(terms)}
    queries = [(item, row, [number[w] for w in words]) for item, row, words in asked if words]
    shards = shared.stored(build_shards(docs, terms, id_col, text_col), "search-shards")
    sums = shards.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total")).first()
    n, total = sums["n"] or 0, sums["total"] or 0
    each = shards.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df"))
    weight = np.zeros(len(terms), np.int64)
    for r in each.collect():  # a row for each term of the bounded queries
        weight[r["term"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard({c: batch.column(c)[i].as_py() for c in batch.schema.names}, weight, n, total)
                for q, (_, _, own) in enumerate(queries):
                    kept = best.get(q)
                    floor = max(1, int(kept[0][-1])) if kept is not None and len(kept[0]) == k else 1
                    score, doc = shard.search(own, k, floor)
                    if len(score):
                        new = (score, shard.doc_id[doc], shard.is_null[doc])
                        if kept is not None:
                            new = tuple(np.concatenate(x) for x in zip(kept, new, strict=True))
                            top = np.lexsort((new[1], new[2], -new[0]))[:k]
                            new = tuple(x[top] for x in new)
                        best[q] = new
        for q, (score, doc, null) in best.items():
            item, row, _ = queries[q]
            columns = [pa.array([item] * len(doc), pa.int64()), pa.array([row] * len(doc), pa.int64()), pa.array(doc, pa.int64(), mask=null), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["item", "row", "id", "score"])

    return shards.mapInArrow(search, "item long, row long, id long, score long")


def op13_lexical_search(spark, sf_dir):
    return rank_documents(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))


_WORDS = f"regexp_extract_all(translate(text, '{shared.UPPER}', '{shared.LOWER}'), '{TERMS}')"
OP13_SQL = rf"""with d as (select doc_id, row_number() over () as r, {_WORDS} as t from documents where text is not null),
s as (select count(*)::bigint as n, sum(len(t))::bigint as total from d where len(t) > 0),
p as (select r, term, count(*) as tf from (select r, unnest(t) as term from d) group by all),
w as (select term, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::bigint as w from p, s group by term, n),
q as (select item_id, i, unnest(list_distinct(t)) as term from (select item_id, row_number() over () as i, {_WORDS} as t from benchmark where text is not null)),
m as (select r, doc_id, 50 + (50 * len(t) * n) // total as m from d, s where len(t) > 0),
x as (select i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
  from q join p using (term) join w using (term) join m using (r) group by all)
select item_id, row_number() over (partition by i order by score desc, doc_id)::int as rank, doc_id, score from x where score > 0
qualify row_number() over (partition by i order by score desc, doc_id) <= 50"""

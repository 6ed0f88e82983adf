"""Removal of long repeated passages by prefix-free parsing.

Every text is cut into phrases at rolling-hash triggers. A trigger is the place of the least hash among the `reach`
first starts of a window, so equal windows of `span` symbols have their first trigger at the same offset, and no phrase
is longer than `reach` (a fixed modulus would leave some text without triggers). A window is then a phrase suffix, up to
its trigger, and a parse suffix, from the trigger on. All windows at a trigger share the `span - reach` symbols after it,
a block of whole phrases; only triggers whose block comes again are looked at further, and blocks part the work.

Within a block's rows the distinct phrases are the dictionary, whose suffix array is made by prefix doubling; the parse
suffixes are put in order with their longest common prefixes. Windows in the order of phrase suffix, then parse suffix,
stand in corpus order: those that agree with a neighbour there on phrase suffix and enough of the parse are repeated.
Blocks are told apart by two independent 64-bit hashes; everything around them is compared symbol by symbol. Triggers in
equal surroundings on the same stretch of a task's text (copies, periodic text) are joined before the exchange.

Symbols are bytes for what is removed, and words for what is only counted: passages of over `words` words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, shared
from .near_dedup import by_group
from .sets import Bloom

GRAM = 16  # bytes that a trigger's hash covers
PLACE = np.uint64(2**32 - 1)  # low bits of a hash give way to its place, so the leftmost of equal ones is least
SEGMENT = 1 << 22
LOOKUPS = 16  # tasks that look up one hot window
HOT = 20_000  # triggers of one block that a task puts in order; see repeated_runs()
KIND = "hash long, more long, unit int, id long, row_key long, start long, end long"


@dataclass
class Tape:
    """Some rows as one run of symbols of `unit` bytes each, in which windows of `span` are looked for: offsets of the
    rows, hashes that choose triggers (2**64 - 1 where none may stand), hash prefixes; row0 and place tell where the first
    symbol stands."""

    span: int
    reach: int
    row0: int
    place: int
    symbols: np.ndarray
    unit: int
    offsets: np.ndarray
    value: np.ndarray
    prefixes: Callable[[int], np.ndarray]

    def block(self, at: np.ndarray, which: int) -> np.ndarray:
        """One of two hashes of the block from each trigger on."""
        return hashing.mix(hashing.windows(self.prefixes(which), at, at + self.span - self.reach))

    def around(self, at: np.ndarray, low: np.ndarray, high: np.ndarray, which: int) -> np.ndarray:
        """One of two hashes of all that the windows of each trigger cover, and of the trigger's place in it."""
        whole = hashing.mix(hashing.windows(self.prefixes(which), at - high, at - low + self.span))
        return hashing.mix(hashing.mix(whole + low.astype(np.uint64)) ^ high.astype(np.uint64))


def byte_tapes(column: pa.Array, span: int, reach: int) -> Iterator[Tape]:
    """Blocks of rows as bytes; a long row in segments that overlap by all but one byte of a window."""
    for first, _, data, offsets in hashing.blocks(column):
        long = len(data) > 2 * SEGMENT
        for at in range(0, len(data), SEGMENT) if long else (0,):
            some = data[at : at + SEGMENT + span - 1] if long else data
            p = hashing.prefix(some)
            places = np.arange(max(0, len(some) - GRAM + 1))
            value = np.full(len(some), 2**64 - 1, np.uint64)
            value[: len(places)] = (hashing.mix(hashing.windows(p, places, places + GRAM)) & ~PLACE) | places.astype(np.uint64)
            both = lambda which, p=p, some=some: hashing.prefix(some, hashing.TABLE2) if which else p
            yield Tape(span, reach, first, at, some, 1, np.array([0, len(some)]) if long else offsets, value, both)


def word_tapes(column: pa.Array, span: int, reach: int) -> Iterator[Tape]:
    """Blocks of rows as words, of which each is 32 bits of its hash."""
    for first, _, data, offsets in hashing.blocks(column):
        start, end = hashing.spans(~hashing.SPACE[data], offsets)
        word = hashing.mix(hashing.windows(hashing.prefix(data), start, end) + (end - start).astype(np.uint64))
        value = (word & ~PLACE) | np.arange(len(word), dtype=np.uint64)
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(w * hashing.powers(len(w)), dtype=np.uint64)]) for w in (word, hashing.mix(word))]
        symbols = (word >> np.uint64(32)).astype(">u4").view(np.uint8)
        yield Tape(span, reach, first, 0, symbols, 4, np.searchsorted(start, offsets), value, lambda which, sums=sums: sums[which])


def triggers(value: np.ndarray, offsets: np.ndarray, span: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, least offset, greatest offset) of the windows of `span` symbols that lie within one row; a trigger
    stands for the run of windows that start 'offset' symbols before it."""
    n = len(value)
    sizes = np.diff(offsets)
    valid = np.zeros(n, bool)
    for a, b in zip(offsets[:-1][sizes >= span], offsets[1:][sizes >= span], strict=True):
        valid[a : b - span + 1] = True
    start = np.flatnonzero(valid)
    if not len(start):
        return start, start, start
    padded = np.full(-(-n // reach) * reach + reach, 2**64 - 1, np.uint64)
    padded[:n] = value
    tiles = padded.reshape(-1, reach)  # least of [p, p + reach): the end of one tile and the beginning of the next
    ahead = np.minimum.accumulate(tiles, 1).ravel()
    behind = np.minimum.accumulate(tiles[:, ::-1], 1)[:, ::-1].ravel()
    trigger = (np.minimum(behind[start], ahead[start + reach - 1]) & PLACE).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    at = trigger[first]
    return at, at - start[last], at - start[first]


def alike(tape: Tape, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, again): the first of each kind of triggers that stand in equal surroundings on this tape, and a mask of
    the triggers whose kind comes several times there. All windows of the latter are repeated, so one trigger of each
    kind is enough for the comparison with the rest of the corpus. Kinds are told apart by two 64-bit hashes."""
    one = tape.around(at, low, high, 0)
    if len(np.unique(one)) == len(one):
        return np.arange(len(at)), np.zeros(len(at), bool)
    two = tape.around(at, low, high, 1)
    by = np.lexsort((two, one))
    new = np.ones(len(by), bool)
    new[1:] = (one[by[1:]] != one[by[:-1]]) | (two[by[1:]] != two[by[:-1]])
    kind = np.cumsum(new) - 1
    again = np.empty(len(by), bool)
    again[by] = np.bincount(kind)[kind] > 1
    return np.sort(by[new]), again


def shared_keys(rows: DataFrame, tapes: Callable) -> DataFrame:
    """(key, n) of the blocks of phrases that stand at several triggers, of which those in equal surroundings on one
    tape count once; counted in each task before the exchange."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.zeros(0, np.uint64)]
            for tape in tapes(batch.column("text")):
                at, low, high = triggers(tape.value, tape.offsets, tape.span, tape.reach)
                if len(at):
                    keys.append(tape.block(at[alike(tape, at, low, high)[0]], 0))
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    return rows.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")


def contexts(rows: DataFrame, tapes: Callable, filters: Broadcast, salts: int) -> DataFrame:
    """Rows of two kinds. One for each kind of triggers of a tape with a wanted block: key, check (the block's second hash), salt (0; for the blocks of too many
    triggers one of 1 to salts), unit, id, row_key, at (its window
    that starts first), offset (of the trigger in that window), around (the phrase before the trigger, then what follows
    the block). And one for each stretch that windows repeated on its own tape cover: unit, id, row_key, at (its start),
    offset (its end), any key and null around."""

    def rows_of(batch: pa.RecordBatch, tape: Tape, row: np.ndarray, key, check, salt, at, offset, around: pa.Array) -> pa.RecordBatch:
        owner = pa.array(row + tape.row0)
        ids = [batch.column("id").take(owner), batch.column("row_key").take(owner)]
        unit = np.full(len(row), tape.unit, np.int32)
        arrays = [pa.array(x) for x in (key.view(np.int64), check.view(np.int64), salt, unit)]
        return pa.RecordBatch.from_arrays([*arrays, *ids, pa.array(at), pa.array(offset), around], ["key", "check", "salt", "unit", "id", "row_key", "at", "offset", "around"])

    def stretches(batch: pa.RecordBatch, tape: Tape, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
        row = np.searchsorted(tape.offsets, at, "right") - 1
        start, end = at - high, at - low + tape.span
        new = np.ones(len(at), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] > end[:-1])
        begins = np.flatnonzero(new)
        row, moved = row[begins], tape.place - tape.offsets[row[begins]]
        start, end = start[begins] + moved, end[np.append(begins[1:], len(at)) - 1] + moved
        dealt = hashing.mix((row + tape.row0).astype(np.uint64) * np.uint64(2**32) + start.astype(np.uint64))
        return rows_of(batch, tape, row, dealt, dealt, np.zeros(len(row), np.int64), start, end, pa.nulls(len(row), pa.binary()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, hot = filters.value
        for batch in batches:
            for tape in tapes(batch.column("text")):
                at, low, high = triggers(tape.value, tape.offsets, tape.span, tape.reach)
                if not len(at):
                    continue
                first, again = alike(tape, at, low, high)
                if again.any():
                    yield stretches(batch, tape, at[again], low[again], high[again])
                at, low, high = at[first], low[first], high[first]
                key = tape.block(at, 0)
                ok = wanted.has(key)
                at, low, high, key = at[ok], low[ok], high[ok], key[ok]
                if not len(at):
                    continue
                check = tape.block(at, 1)
                salt = np.zeros(len(at), np.int64) if hot is None else hot.has(key) * (1 + at % salts)
                size = (high + tape.reach - low) * tape.unit
                begin = np.concatenate([[0], np.cumsum(size)])
                inner = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
                before = np.repeat(high * tape.unit, size)
                source = np.repeat((at - high) * tape.unit, size) + inner + np.where(inner >= before, (tape.span - tape.reach) * tape.unit, 0)
                around = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(begin), pa.py_buffer(tape.symbols[source])])
                row = np.searchsorted(tape.offsets, at, "right") - 1
                yield rows_of(batch, tape, row, key, check, salt, at - high - tape.offsets[row] + tape.place, high, around.cast(pa.binary()))

    return rows.mapInArrow(cut, "key long, check long, salt long, unit int, id long, row_key long, at long, offset long, around binary")


def suffix_ranks(phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, ends): the place of every suffix of the phrases in their common suffix array, by prefix doubling, equal
    for equal suffixes; a phrase's suffix of n bytes stands at its end - n, and the empty one has rank 0."""
    sizes = np.array([len(x) for x in phrases], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    rank = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.int64)
    inside = np.ones(len(rank), bool)
    inside[ends] = False
    rank[inside] = np.frombuffer(b"".join(phrases), np.uint8).astype(np.int64) + 1
    end = np.repeat(ends, sizes + 1)
    place, width, top = np.arange(len(rank)), 1, 257
    while width <= sizes.max(initial=0):
        step = 3 if top < 1 << 20 else 2
        key = rank
        for m in range(1, step):
            key = key * top + rank[np.minimum(place + m * width, end)]
        _, rank = np.unique(key, return_inverse=True)
        width, top = width * step, int(rank.max()) + 1
    return rank, ends


def common_prefixes(tails: list[bytes], group: np.ndarray, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of the parse: rows in order of group and tail, and a table for range minima of the common
    prefixes of neighbours (0 between groups)."""
    wide = -(-width // 8) * 8
    sizes = np.array([len(x) for x in tails])
    padded = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in tails), np.uint8).reshape(-1, wide)
    order = np.lexsort((sizes, *padded.view(">u8").T[::-1], group))
    same = padded[order[1:]] == padded[order[:-1]]
    lcp = np.where(same.all(1), wide, same.argmin(1))
    lcp = np.minimum(lcp, np.minimum(sizes[order[1:]], sizes[order[:-1]])) * (group[order[1:]] == group[order[:-1]])
    table = [np.concatenate([[0], lcp]).astype(np.int16)]
    while 2 ** len(table) <= len(order):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return order, table


def repeated_windows(rows: pd.DataFrame, reach: int, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, number within the row's run of windows) of the windows that have an equal one, sorted."""
    high = rows["offset"].to_numpy()
    low = high + reach - rows["around"].map(len).to_numpy() // unit
    group = rows.groupby(["key", "check"]).ngroup().to_numpy()
    heads = [x[: h * unit] for x, h in zip(rows["around"], high, strict=True)]
    order, table = common_prefixes([x[h * unit :] for x, h in zip(rows["around"], high, strict=True)], group, reach * unit)
    code, dictionary = pd.factorize(np.array([*heads, None], object)[:-1])
    rank, ends = suffix_ranks(list(dictionary))
    # all windows, by parse suffix; then in corpus order
    n = (high - low + 1)[order]
    place = np.repeat(np.arange(len(order)), n)
    row = order[place]
    offset = high[row] - (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    key = rank[ends[code[row]] - offset * unit] * (int(group.max(initial=0)) + 1) + group[row]
    by = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[by[1:]] == key[by[:-1]])
    left, right = place[by[same]] + 1, place[by[same + 1]]  # least of the table over left..right
    level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    least = np.zeros(len(same), np.int16)
    for k in np.unique(level):
        at = level == k
        least[at] = np.minimum(table[k][left[at]], table[k][right[at] - (1 << k) + 1])
    same = same[least >= (reach - offset[by[same]]) * unit]
    again = np.zeros(len(row), bool)
    again[by[same]] = again[by[same + 1]] = True
    row, j = row[again], (high[row] - offset)[again]
    out = np.lexsort((j, row))
    return row[out], j[out]


def window_hashes(rows: pd.DataFrame, reach: int, unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number within the row's run of windows, two hashes of block, trigger offset and symbols) of all windows."""
    data = np.frombuffer(b"".join(rows["around"]), np.uint8)
    size = rows["around"].map(len).to_numpy()
    begin = np.cumsum(size) - size
    n = size // unit - reach + 1
    row = np.repeat(np.arange(len(rows)), n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = begin[row] + j * unit
    offset = (rows["offset"].to_numpy()[row] - j).astype(np.uint64)
    found = []
    for name, table in (("key", hashing.TABLE), ("check", hashing.TABLE2)):
        h = hashing.windows(hashing.prefix(data, table), start, start + reach * unit)
        found.append(hashing.mix(hashing.mix(h + offset) ^ rows[name].to_numpy().view(np.uint64)[row]))
    return row, j, found[0], found[1]


def covered(rows: pd.DataFrame, row: np.ndarray, j: np.ndarray, span: int) -> pd.DataFrame:
    """Symbols that the given windows cover, as runs: unit, id, row_key, start, end."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (j[1:] != j[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(row)]])[: len(first)] - 1
    own = rows.iloc[row[first]]
    at = own["at"].to_numpy()
    return pd.DataFrame({**{c: own[c].to_numpy() for c in ("unit", "id", "row_key")}, "start": at + j[first], "end": at + j[last] + span})


def repeated_runs(rows: DataFrame, sizes: dict[int, tuple[int, int]], hot_rows: int) -> DataFrame:
    """unit, id, row_key, start, end (places of symbols) of runs of repeated windows; sizes: unit -> (span, reach), with
    bytes as the symbols of unit 1 and words as those of unit 4.

    Blocks of at most `hot_rows` triggers are put in order by one task each. Those of a block that more share are not:
    they are dealt over all tasks by a salt, and their windows counted by two 64-bit hashes, with the same result.
    """
    spark = rows.sparkSession

    def tapes(column: pa.Array) -> Iterator[Tape]:
        for unit, (span, reach) in sizes.items():
            yield from (byte_tapes if unit == 1 else word_tapes)(column, span, reach)

    keys = shared.stored(shared_keys(rows, tapes), "repeat-keys")
    n = keys.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") > hot_rows).alias("hot")).first()
    hot = Bloom.of(keys.filter(F.col("n") > hot_rows), "key", n["hot"]) if n["hot"] else None
    filters = spark.sparkContext.broadcast((Bloom.of(keys, "key", n["keys"]), hot))  # of a bounded size

    parts = shared.parts(spark, n["rows"], 25_000)

    def order(group: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({c: pd.Series([], dtype="Int64") for c in ("hash", "more", "unit", "id", "row_key", "start", "end")})]
        known = group[group["around"].isna()]
        if len(known):
            none = pd.array([None] * len(known), "Int64")
            found.append(known[["unit", "id", "row_key"]].assign(start=known["at"], end=known["offset"], hash=none, more=none))
            group = group[group["around"].notna()]
        for unit, (span, reach) in sizes.items():
            own = group[(group["unit"] == unit) & (group["salt"] == 0)].reset_index(drop=True)
            if len(own):
                runs = covered(own, *repeated_windows(own, reach, unit), span)
                none = pd.array([None] * len(runs), "Int64")
                found.append(runs.assign(hash=none, more=none))
            own = group[(group["unit"] == unit) & (group["salt"] > 0)].reset_index(drop=True)
            if len(own):
                row, j, one, two = window_hashes(own, reach, unit)
                start = own["at"].to_numpy()[row] + j
                ids = {c: own[c].to_numpy()[row] for c in ("unit", "id", "row_key")}
                hashes = {"hash": pd.array(one.view(np.int64), "Int64"), "more": pd.array(two.view(np.int64), "Int64")}
                found.append(pd.DataFrame({**hashes, **ids, "start": start, "end": start + span}))
        return pd.concat(found, ignore_index=True)

    dealt = contexts(rows, tapes, filters, parts).repartition(parts, "key", "salt").sortWithinPartitions("key")
    out = dealt.mapInPandas(by_group("key", order, 8_000), KIND)
    columns = ["unit", "id", "row_key", "start", "end"]
    if hot is None:
        return out.select(*columns)
    out = shared.stored(out, "repeat-runs")
    windows = out.filter("hash is not null")
    again = windows.groupBy("hash", "more").agg(F.count("*").alias("n")).filter("n > 1").select("hash", "more")
    # a window that very many rows have is looked up by several tasks
    again = again.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LOOKUPS - 1).cast("long"))))
    windows = windows.withColumn("salt", F.pmod(F.xxhash64("row_key", "start"), F.lit(LOOKUPS).cast("long")))
    return out.filter("hash is null").select(*columns).unionByName(windows.join(again, ["hash", "more", "salt"]).select(*columns))


def merged(runs: list[tuple[int, int]]) -> list[list[int]]:
    """Runs (start, end) that overlap or touch, as one each."""
    out: list[list[int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 400, reach: int = 128, words: int | None = 50, hot_rows: int = HOT
) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept (the remaining bytes), n_passages.

    Removed is every byte under a `span`-byte string that also starts elsewhere in the corpus or the same text; matches
    never cross texts, and all are judged on the input. n_passages counts the stretches of a text that are covered by
    strings of `words` + 1 words (between ASCII white space) which also start elsewhere; they may be shorter than `span`
    and are counted, not removed; with words None there is no such column. A null text counts as empty; rows that are equal in full are copies of each other. An
    empty table gives no rows; other columns are ignored.
    """
    if span - reach < GRAM:
        raise ValueError(f"span must exceed reach by {GRAM} or more")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("id", "text"))
    known = rows.withColumn("id", F.coalesce("id", F.lit(0)))
    sizes = {1: (span, reach)} | ({4: (words + 1, (words + 1) // 3)} if words else {})
    found = repeated_runs(known, sizes, hot_rows)
    spans = found.groupBy("row_key", "id").agg(F.collect_set(F.struct("unit", "start", "end")).alias("runs"))
    joined = rows.join(spans.withColumnRenamed("id", "own"), ["row_key"], "left")
    joined = joined.filter(F.col("own").isNull() | (F.col("own") == F.coalesce("id", F.lit(0))))

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = hashing.column_bytes(batch.column("text"))
            n_removed, n_spans, kept, passages = [], [], [], []
            for a, b, marks in zip(at, at[1:], batch.column("runs").to_pylist(), strict=False):
                text = data[a:b].tobytes()
                gone = merged([(x["start"], x["end"]) for x in marks or () if x["unit"] == 1])
                n_removed.append(sum(e - s for s, e in gone))
                n_spans.append(len(gone))
                kept.append(b"".join(text[s:e] for s, e in zip([0, *(m[1] for m in gone)], [*(m[0] for m in gone), len(text)], strict=True)))
                passages.append(len(merged([(x["start"], x["end"]) for x in marks or () if x["unit"] > 1])))
            numbers = [pa.array(x, pa.int64()) for x in (np.diff(at), n_removed, n_spans)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *numbers, pa.array(kept, pa.binary()), pa.array(passages, pa.int64())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept", "n_passages"],
            )

    out = joined.select("id", "text", "runs").mapInArrow(strike, "id long, n_bytes long, n_removed long, n_spans long, kept binary, n_passages long")
    return (out if words else out.drop("n_passages")).withColumnRenamed("id", id_col)


def op4_remove_repeats(spark, sf_dir):
    """n_passages shows repeated passages of over 50 words, which may have fewer bytes than what is removed."""
    out = remove_repeats(shared.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages")

"""Positions of trigrams, in numpy on pieces of a task's texts: a text's trigrams all stand in its own row, so they are
grouped there and no row of (trigram, position) goes through an exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 21  # signs that are sorted at once; a longer text is a piece of its own
SCHEMA = "gram string, field string, id string, positions array<int>"


def postings(units: list[tuple[str, str, np.ndarray]]) -> pa.RecordBatch:
    """Rows (gram, field, id, positions from 1 on), in that order, of (field, id, signs) of which each has three signs or
    more."""
    units = sorted(units, key=lambda u: u[:2])
    sizes = np.array([len(u[2]) for u in units])
    signs = np.concatenate([u[2] for u in units])
    present = np.zeros(int(signs.max()) + 1, bool)
    present[signs] = True
    code = np.cumsum(present, dtype=np.int64) - 1  # the place of a sign among those that occur
    known, n = np.flatnonzero(present), int(present.sum())
    counts = sizes - 2
    unit = np.repeat(np.arange(len(units)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = at + np.repeat(np.cumsum(sizes) - sizes, counts)
    coded = code[signs]
    gram = (coded[start] * n + coded[start + 1]) * n + coded[start + 2]
    bits = len(at).bit_length()
    if n**3 << bits < 1 << 63:  # trigram and place in one number: all differ, so any sort keeps the order of places
        both = np.sort((gram << bits) | np.arange(len(at)))
        order, gram = both & ((1 << bits) - 1), both >> bits
    else:
        order = np.argsort(gram, kind="stable")
        gram = gram[order]
    unit, at = unit[order], at[order]
    first = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (unit[1:] != unit[:-1]))))
    named, which = np.unique(gram[first], return_inverse=True)
    letters = known[np.stack([named // (n * n), named // n % n, named % n], 1)].astype("<u4")
    texts = pa.array([letters[i].tobytes().decode("utf-32-le") for i in range(len(named))], pa.string())
    own = pa.array(unit[first])
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array((at + 1).astype(np.int32)))
    fields, ids = (pa.array([u[i] for u in units], pa.string()).take(own) for i in (0, 1))
    return pa.RecordBatch.from_arrays([texts.take(pa.array(which)), fields, ids, lists], ["gram", "field", "id", "positions"])


def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """postings() of batches with an id and texts under the names of their fields."""
    units, held = [], 0
    for batch in batches:
        ids = batch.column("id").to_pylist()
        for name in batch.schema.names:
            if name == "id":
                continue
            for i, text in zip(ids, batch.column(name), strict=True):
                signs = np.frombuffer((text.as_py() or "").encode("utf-32-le"), "<u4")
                if len(signs) < 3:
                    continue
                if held and held + len(signs) > PIECE:
                    yield postings(units)
                    units, held = [], 0
                units.append((name, i, signs))
                held += len(signs)
    if units:
        yield postings(units)

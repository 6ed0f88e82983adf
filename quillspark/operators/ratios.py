"""The ratio of difflib.SequenceMatcher for long texts, level by level instead of one longest block after the other.

The matcher takes the longest run of signs that the second text does not have too often, leftmost first, extends it by any
equal signs and goes on left and right of it. Here all blocks of one length are taken in one pass over all places still
open, from the longest length down: no place holds a longer run by then, so the first run of that length in each is the
one the matcher takes. Work follows the length of the texts times the number of different lengths, memory the length.
"""

from __future__ import annotations

import difflib
from bisect import bisect_left

import numpy as np

SHORT = 700  # signs of both texts, below which the matcher itself is as fast


class Runs:
    """The runs of seldom signs of two texts, by length, told apart by exact numbers."""

    def __init__(self, a: str, b: str):
        x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in (a, b))
        signs, counts = np.unique(y, return_counts=True)
        signs = signs[counts <= len(y) // 100 + 1] if len(y) >= 200 else signs  # as difflib's autojunk has it
        both = np.concatenate([x, [-1], y])
        rank = np.searchsorted(signs, both)
        seldom = np.append(signs, -2)[rank] == both
        place = np.arange(len(both))
        stop = np.where(seldom, len(both), place)
        self.ahead = np.minimum.accumulate(stop[::-1])[::-1] - place  # seldom signs from here on
        self.first, self.width, self.ranks = len(x), len(both), {1: rank}

    def numbers(self, length: int, free: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, number of the run of this length there), of free places only if given."""
        if length not in self.ranks and length & (length - 1) == 0:
            at, key = self.numbers_of_halves(length, length // 2)
            self.ranks[length] = np.zeros(self.width, np.int64)
            self.ranks[length][at] = np.unique(key, return_inverse=True)[1]
        if length in self.ranks:
            at = self.places(length, free)
            return at, self.ranks[length][at]
        at, key = self.numbers_of_halves(length, 1 << (length.bit_length() - 1), free)
        return at, np.unique(key, return_inverse=True)[1]

    def places(self, length: int, free: np.ndarray | None) -> np.ndarray:
        return np.flatnonzero(self.ahead >= length) if free is None else free[self.ahead[free] >= length]

    def numbers_of_halves(self, length: int, half: int, free: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        if half not in self.ranks:
            self.numbers(half)
        at = self.places(length, free)
        return at, self.ranks[half][at] * self.width + self.ranks[half][at + length - half]

    def within(self, length: int, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place in the first text, number, open stretch) of the runs that both sides of a stretch hold; and number and
        place of those of the second text, in order. open_: rows of (from, to) in the first and (from, to) in the second."""
        edge = np.zeros(self.width + 1, np.int64)
        for lo, hi, start in ((0, 1, 0), (2, 3, self.first + 1)):
            edge[open_[:, lo] + start] += 1
            edge[open_[:, hi] + start] -= 1
        at, number = self.numbers(length, np.flatnonzero(np.cumsum(edge[:-1])))
        cut = np.searchsorted(at, self.first)
        places = np.append(np.sort(number[cut:] * self.width + at[cut:] - self.first - 1), np.iinfo(np.int64).max)
        at, number = at[:cut], number[:cut]
        own = np.maximum(np.searchsorted(open_[:, 0], at, "right") - 1, 0)
        least, most = number * self.width + open_[own, 2], number * self.width + open_[own, 3] - length
        held = (at >= open_[own, 0]) & (at + length <= open_[own, 1]) & (places[np.searchsorted(places, least)] <= most)
        return at[held], number[held], own[held], places


def matched(a: str, b: str) -> int:
    """Signs in the blocks of SequenceMatcher(None, a, b)."""
    if not a or not b:
        return 0
    runs, total = Runs(a, b), 0
    open_ = np.array([[0, len(a), 0, len(b)]])
    most = 1  # no run of this length is left
    while most <= min(len(a), len(b)) and len(runs.within(most, open_)[0]):
        most *= 2
    most = min(most, min(len(a), len(b)) + 1)
    while most > 1 and len(open_):
        least, step = most - 1, 1  # the greatest length that is left: mostly near the last one
        while least and not len(runs.within(least, open_)[0]):
            most, step = least, 2 * step
            least = max(0, least - step)
        while most - least > 1:
            half = (least + most) // 2
            least, most = (half, most) if len(runs.within(half, open_)[0]) else (least, half)
        if not least:
            break
        found, open_ = blocks(a, b, least, open_, *runs.within(least, open_))
        total, most = total + found, least
    for i, to, j, end in open_.tolist():  # without any seldom sign in common, the matcher takes equal beginnings
        while i < to and j < end and a[i] == b[j]:
            i, j, total = i + 1, j + 1, total + 1
    return total


def blocks(a: str, b: str, length: int, open_: np.ndarray, at: np.ndarray, number: np.ndarray, own: np.ndarray, places: np.ndarray) -> tuple[int, np.ndarray]:
    """(signs in the blocks around runs of this length, what stays open)."""
    width, total, left, last = len(a) + len(b) + 1, 0, [], -1
    i = j = to = end = 0
    ordered = places.tolist()
    for p, n, w in zip(at.tolist(), number.tolist(), own.tolist(), strict=True):
        if w != last:
            left.append((i, to, j, end))
            (i, to, j, end), last = open_[w].tolist(), w
        if p < i:
            continue
        q = ordered[bisect_left(ordered, n * width + j)] - n * width
        if q + length > end:
            continue
        s, t, e, f = p, q, p + length, q + length
        while s > i and t > j and a[s - 1] == b[t - 1]:
            s, t = s - 1, t - 1
        while e < to and f < end and a[e] == b[f]:
            e, f = e + 1, f + 1
        total += e - s
        left.append((i, s, j, t))
        i, j = e, f
    left.append((i, to, j, end))
    rest = np.concatenate([np.delete(open_, np.unique(own), 0), np.array(left)])
    rest = rest[(rest[:, 0] < rest[:, 1]) & (rest[:, 2] < rest[:, 3])]
    return total, rest[np.argsort(rest[:, 0])]


def ratio(a: str, b: str) -> float:
    """SequenceMatcher(None, a, b).ratio()."""
    if len(a) + len(b) < SHORT:
        return difflib.SequenceMatcher(None, a, b).ratio()
    return 2.0 * matched(a, b) / (len(a) + len(b))

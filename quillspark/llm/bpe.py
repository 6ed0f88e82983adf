"""BPE encoding and decoding with a contiguous rank array per short word.

A word is its row of part ids; beside it stands the row of ranks of adjacent parts. Again and again the least rank
is found by a scan, the boundary there is deleted (the row is closed up), and the ranks to its left and right are
refreshed. Words are short, so a scan beats a heap; the rows of many words form one array, and each step is taken
for all of them at once. Words over `WIDTH` bytes, which scans would take quadratic time for, have a heap of ranks and
linked parts instead.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, shared

WIDTH = 32  # bytes of a word that the batched form takes
NONE = np.int32(2**31 - 1)  # rank of a pair that never merges
WHITE, LETTER, NUMBER, OTHER = range(4)


def byte_alphabet() -> list[str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


@functools.cache
def kinds() -> np.ndarray:
    """The kind of every code point: white space, letter, number, or any other sign."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    valid = [*range(0xD800), *range(0xE000, 0x110000)]
    text, code = "".join(map(chr, valid)), np.array(valid)
    for kind, pattern in ((WHITE, r"\p{White_Space}+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            out[code[m.start() : m.end()]] = kind
    return out


class WordBpe:
    """Encoder and decoder of a `tokenizers` file whose BPE marks word ends."""

    def __init__(self, path: str, cache: int = 128_000_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int32)
        self.last = np.array([vocab[c + suffix] for c in alphabet], np.int32)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64)
        key = pairs[:, 0] << 20 | pairs[:, 1]
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int32), pairs[:, 2].astype(np.int32)
        self.pairs = dict(zip(key.tolist(), range(len(key)), strict=True))
        self.kinds, self.tables = kinds(), [np.random.default_rng(i).integers(1, 2**63, 0x110000, np.uint64) * np.uint64(2) + np.uint64(1) for i in (7, 8)]
        self.cache, self.held, self.known_words = cache, 0, {}  # bytes that may be kept of words and their ids, and that are

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of parts; NONE where they don't merge or a part is -1."""
        at = np.searchsorted(self.keys, key := (left.astype(np.int64) << 20 | right))
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def long_word(self, data: bytes) -> list[int]:
        """Ids of a word of any length: the pair of least rank, the leftmost of equals, is merged again and again."""
        parts = [*self.inner[np.frombuffer(data[:-1], np.uint8)].tolist(), int(self.last[data[-1]])]
        n = len(parts)
        ranks = self.rank(np.array(parts[:-1], np.int32), np.array(parts[1:], np.int32))
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(ranks.tolist()) if r != NONE]
        heapq.heapify(heap)
        left, right = [*range(-1, n - 1)], [*range(1, n + 1)]
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two was merged meanwhile
            parts[i], parts[j] = int(self.made[rank]), -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := self.pairs.get(parts[x] << 20 | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def batch(self, words: list[bytes]) -> list[bytes]:
        """Ids of non-empty words of at most WIDTH bytes, as little-endian unsigned 32-bit bytes."""
        n, width = len(words), max(map(len, words))
        sizes = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        parts = np.full((n, width + 1), -1, np.int32)
        parts[:, :width] = np.where(np.arange(width) < sizes[:, None], self.inner[raw], -1)
        parts[np.arange(n), sizes - 1] = self.last[raw[np.arange(n), sizes - 1]]
        ranks = np.full((n, width + 1), NONE, np.int32)  # ranks[i] is that of parts i and i + 1
        ranks[:, :width] = self.rank(parts[:, :width].ravel(), parts[:, 1:].ravel()).reshape(n, width)
        out = parts.copy()
        rows = np.arange(n)
        column = np.arange(width + 1)
        while len(rows):
            m = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), m]
            if not (live := least != NONE).all():
                out[rows[~live]] = parts[~live]
                rows, parts, ranks, m, least = rows[live], parts[live], ranks[live], m[live], least[live]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            parts[each, m] = self.made[least]
            close = np.minimum(column + (column > m[:, None]), width)
            parts = np.take_along_axis(parts, close, 1)
            parts[:, width] = -1
            ranks = np.take_along_axis(ranks, np.minimum(column + (column >= m[:, None]), width), 1)
            ranks[each, m] = self.rank(parts[each, m], parts[each, np.minimum(m + 1, width)])
            before = np.maximum(m - 1, 0)
            ranks[each, before] = np.where(m > 0, self.rank(parts[each, before], parts[each, m]), ranks[each, before])
        counts = (out >= 0).sum(1) * 4
        flat = out[out >= 0].astype("<u4").tobytes()
        ends = np.cumsum(counts).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def normal(self, text: str) -> str:
        """NFC, then each character lower-cased by itself (no special end-of-word sigma)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def learn_words(self, words: set[str]) -> None:
        """Encode the words that are new."""
        short: dict[int, list[str]] = {}
        for w in words:
            size = len(w) if w.isascii() else len(w.encode("utf-8"))
            if size > WIDTH:
                self.known_words[w] = np.array(self.long_word(w.encode("utf-8")), "<u4").tobytes()
            else:
                short.setdefault((size + 3) // 4, []).append(w)
        for ws in short.values():
            self.known_words.update(zip(ws, self.batch([w.encode("utf-8") for w in ws]), strict=True))
        self.held += sum(200 + len(w) + len(self.known_words[w]) for w in words)

    def cut(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every word of a row of code points that ends in white space: runs of letters, runs of other
        signs, single digits, and contractions, which begin where an apostrophe begins a run."""
        kind = self.kinds[cp]
        begin = kind != WHITE
        begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        at = np.flatnonzero(begin & (cp == ord("'")))
        one, two = cp[at + 1], cp[np.minimum(at + 2, len(cp) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((two == ord("e")) & np.isin(one, [ord("r"), ord("v")])) | ((one == ord("l")) & (two == ord("l")))
        at, width = at[short | long], np.where(short, 2, 3)[short | long]
        begin[at + 1] = False
        begin[at + width] = kind[at + width] != WHITE
        last = kind != WHITE
        last[:-1] &= (kind[1:] == WHITE) | begin[1:]
        return np.flatnonzero(begin), np.flatnonzero(last) + 1

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special strings. The distinct words of all texts are encoded once: words are told apart
        by a 64-bit hash that a second one confirms, and meet earlier blocks' words as strings."""
        normal = [self.normal(x) for x in texts]
        joined = "\n".join([*normal, ""])
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if not len(cp):
            return [b""] * len(texts)
        start, end = self.cut(cp)
        one, two = (hashing.windows(hashing.prefix(cp, t), start, end) for t in self.tables)
        code, seen = pd.factorize(hashing.mix(one + (end - start).astype(np.uint64)))
        first = np.zeros(len(seen), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        if (two != two[first][code]).any():  # two words of one hash
            return [self.plain([x])[0] for x in texts] if len(texts) > 1 else [self.one_by_one(joined, start, end)]
        words = [joined[i:j] for i, j in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        if new := set(words).difference(self.known_words):
            self.learn_words(new)
        ids = [self.known_words[w] for w in words]
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        n = size[code]
        to = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat((np.cumsum(size) - size)[code] - to[:-1], n) + np.arange(to[-1])].tobytes()
        stop = np.cumsum(np.fromiter(map(len, normal), np.int64, len(normal)) + 1)
        stops = (4 * to[np.searchsorted(start, stop)]).tolist()
        return [out[i:j] for i, j in zip([0, *stops], stops, strict=False)]

    def one_by_one(self, joined: str, start: np.ndarray, end: np.ndarray) -> bytes:
        words = [joined[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)]
        if new := set(words).difference(self.known_words):
            self.learn_words(new)
        return b"".join(map(self.known_words.__getitem__, words))

    def block(self, texts: list[str]) -> list[bytes]:
        """Ids of a block of texts, a few MB at most; special strings become their ids."""
        if self.held > self.cache:
            self.known_words.clear()
            self.held = 0
        parts = [self.at_special.split(x) if "<|" in x else [x] for x in texts]
        ids = iter(self.plain([x for xs in parts for x in xs]))
        out = []
        for text, xs in zip(texts, parts, strict=True):
            marks = self.at_special.findall(text) if len(xs) > 1 else []
            own = [next(ids) for _ in xs]
            out.append(own[0] + b"".join(self.special[m].to_bytes(4, "little") + x for m, x in zip(marks, own[1:], strict=True)))
        return out

    def encode(self, texts: Iterable[str], chars: int = 4_000_000) -> Iterator[bytes]:
        block, size = [], 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size > chars:
                yield from self.block(block)
                block, size = [], 0
        yield from self.block(block)

    def decode(self, ids: bytes) -> str:
        """Tokens parted by spaces: what a `tokenizers` file without a decoder gives."""
        return " ".join(map(self.tokens.__getitem__, array("I", ids)))


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str = "word_bpe_49k.json") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no tokens and the digests of nothing. Special strings of the file inside a text
    become their ids. Equal rows give equal rows; an empty table none. Other columns are ignored.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = WordBpe(shared.tokenizer_path(file))
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in bpe.encode(batch["text"]):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha})

    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )
    out = rows.mapInPandas(digest, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op8_bpe(spark, sf_dir):
    return bpe_digests(shared.table(spark, sf_dir, "documents"))

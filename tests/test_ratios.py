"""The ratio of long texts against the sequence matcher itself."""

import difflib
import random
import time

from quillspark.operators import linkage, ratios


def texts(seed: int):
    """Pairs of random texts: few and many signs, runs, periods, words; read backwards, edited, turned round, unlike."""
    r = random.Random(seed)
    for _ in range(400):
        signs = [chr(97 + c) for c in range(r.choice([1, 2, 5, 20, 105, 150, 400]))]
        n = r.choice([0, 1, 50, 199, 200, 201, 300, 600])
        words = ["".join(r.choices(signs, k=r.randrange(1, 8))) for _ in range(12)]
        b = r.choice([
            "".join(r.choices(signs, k=n)), ("".join(signs) * (n // len(signs) + 1))[:n],
            "".join(r.choice(signs) * r.randrange(1, 9) for _ in range(n // 4)), " ".join(r.choices(words, k=n // 4)),
        ])
        at, to = sorted(r.randrange(len(b) + 1) for _ in range(2))
        yield r.choice([b[::-1], b[:at] + b[to:] + b[at:to], b[to:] + "é" + b[:at], "".join(r.choices(signs, k=r.choice([0, 1, 30, 210, 500])))]), b


def test_blocks_are_those_of_the_matcher():
    for a, b in texts(1):
        assert ratios.matched(a, b) == sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks()), (a, b)


def test_short_and_empty_texts():
    for a, b in (("", ""), ("", "a"), ("a", ""), ("ab" * 400, ""), ("", "ab" * 400), ("\ud800x" * 400, "x\ud800" * 400), ("𝔞b" * 400, "b𝔞" * 400)):
        assert ratios.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_long_texts_are_compared_in_time(spark):
    """A long text of many signs read backwards: the matcher's steps grow about with the square of its length."""
    text = "".join(random.Random(2).choices([chr(0x4E00 + i) for i in range(150)], k=150_000))
    e, f = ([(1, t)] for t in (text[::-1], text))
    began = time.monotonic()
    got = linkage.compare_texts(spark.createDataFrame(e, "id long, text string"), spark.createDataFrame(f, "id long, text string")).collect()
    assert time.monotonic() - began < 40 and 0 < got[0]["ratio"] < 0.5 and got[0]["verdict"] == "FAIL"

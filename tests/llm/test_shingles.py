"""Blocks with fewer words than a shingle has."""

import numpy as np
import pyarrow as pa

from quillspark.llm.sets import shingle_sets


def test_a_block_of_fewer_words_than_a_shingle():
    """Three words in all and five-word shingles: the texts are one shingle each."""
    for texts, rows in ((["one two three"], [0]), (["one", "two", "", "three"], [0, 1, 3]), (["a b c d"], [0]), (["x"], [0])):
        got = [(r, len(s)) for r, s in shingle_sets(pa.array(texts), 5)]
        assert got == [(r, 1) for r in rows]
    whole = dict(shingle_sets(pa.array(["one two three", "p q r s t u v"]), 5))
    alone = dict(shingle_sets(pa.array(["one two three"]), 5))
    assert np.array_equal(whole[0], alone[0])

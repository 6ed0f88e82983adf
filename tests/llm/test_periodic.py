"""op4 on periodic texts: every window of a period comes again, so all but what differs goes."""

import time

from test_exact import brute_repeats

from quillspark.llm import repeats


def removed(spark, rows, **sizes):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = repeats.remove_repeats(d, words=None, **sizes)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()), key=str)


def test_periods_copies_and_surroundings(spark):
    aside = "".join(chr(33 + (i * i * 7 + i // 90) % 90) for i in range(700))
    period = "".join(chr(33 + (i * i * 11 + 5) % 90) for i in range(83))
    rows = [(i, t) for i, t in enumerate([
        "a" * 900, "a" * 40, "ab" * 300 + aside, aside[:100] + period * 12, period * 9 + aside[200:], aside * 2, aside[300:] + "x" + aside[:300], "", "b" + "a" * 77,
    ])]
    for span, reach, hot in ((80, 16, 20_000), (80, 16, 3), (40, 16, 20_000)):
        assert removed(spark, rows, span=span, reach=reach, hot_rows=hot) == sorted(brute_repeats(rows, span), key=str)


def test_ten_megabytes_of_a_period(spark):
    rows = [(1, "ab" * 5_000_000), (2, "".join(map(str, range(2_000)))), (3, "xyz" * 200_000), (4, "q" * 1_000_000)]
    began = time.perf_counter()
    got = removed(spark, rows)
    assert [x[:4] for x in got] == [(1, 10**7, 10**7, 1), (2, 6890, 0, 0), (3, 600_000, 600_000, 1), (4, 10**6, 10**6, 1)]
    assert time.perf_counter() - began < 60

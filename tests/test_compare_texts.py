"""W11 on texts labelled by hand."""

from quillspark.operators import linkage


def test_verdicts(spark):
    long = " ".join(f"word{i}" for i in range(60))
    cases = {
        1: ("", "a reference", "FAIL", False), 2: (None, None, "FAIL", False), 3: ("an extract", None, "NOREF", False), 4: ("an extract", "", "NOREF", False),
        5: (long[:250] + " and other things", long, "PASS", True), 6: (long, "Title. " + long[:40], "FAIL", False), 7: (long[:90], "before " + long, "PASS", True),
        8: ("an informa- tion sys-\ntem", "An information system", "PASS", True), 9: ("re use", "reuse", "PASS", False), 10: ("zzzz qqqq", "aaaa", "FAIL", False),
        11: ("?!", "...", "PASS", False), 12: ("abcdxxxx", "abcdyyyy", "REVIEW", False),
    }
    e = spark.createDataFrame([(i, c[0]) for i, c in cases.items()], "id long, text string")
    r = spark.createDataFrame([(i, c[1]) for i, c in cases.items() if i != 4], "id long, text string")  # no row is no reference
    got = {x["id"]: x for x in linkage.compare_texts(e, r).collect()}
    assert {i: (x["verdict"], x["prefix"]) for i, x in got.items()} == {i: c[2:] for i, c in cases.items()}
    assert got[1]["ratio"] == 0.0 and got[3]["ratio"] is None and got[12]["ratio"] == 0.5 and got[9]["ratio"] == 10 / 11

"""Operators on hand-made rows that carry the edge cases of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.functions import predicates as P
from quillspark.operators import ledger, linkage, merge, repair, search, stats, worklist
from quillspark.sources import pages, records
from quillspark.streaming import ledger_stream

RAW = "conf string, paper_name string, paper_authors array<string>, paper_url string, paper_abstract string, paper_code string, seq long"


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        ("ACL 2023", "State-of-the-art Parsing", ["Ann Lee", "Bo Xu"], "https://aclanthology.org/2023.acl-long.5/", "We parse. See https://github.com/a/b).", "#", 1),
        ("acl 2023", "State-of-the-art Parsing", ["Ann Lee"], "https://aclanthology.org/2023.acl-long.5/", "short", None, 2),
        ("NIPS2018", "Learning c++ and r&d with node.js", [], "https://doi.org/10.1145/1", None, "https://github.com/x/y", 3),
        ("KDD2020", "AI of mining", ["Ann Lee"], "", "Mining text", "", 4),
        ("KDD2020", "ai of mining ", ["Ann Lee", "Cy Oz"], "", "Mining text", "https://github.com/m/n", 5),
        ("Workshop", "No year", None, None, None, None, 6),
        ("NIPS2018", "Learning c++ and r&d with node.js", [], "https://doi.org/10.1145/1", None, "https://github.com/x/y", 7),
    ]
    return spark.createDataFrame(rows, RAW)


@pytest.fixture(scope="module")
def papers(raw):
    return merge.materialise_papers(raw)[0]


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_materialise(raw, papers):
    out = {r["seq"]: r for r in papers.collect()}
    assert set(out) == {1, 3, 4, 5} and out[1]["conf"] == "ACL" and out[3]["abstract"] == ""
    counts = merge.materialise_papers(raw)[1].first()
    assert (counts["rows"], counts["no_year"], counts["duplicates"]) == (7, 1, 2)


def test_conf_parts(spark):
    names = ["ACL 2023", "NIPS2018", "x", None, "IEEE2020b"]
    assert column(spark, names, lambda c: C.search_parts(c)[0]) == ["ACL", "NIPS", "X", "", "IEEE"]
    assert column(spark, names, lambda c: C.stats_parts(c)[1]) == ["Unknown", "2018", "Unknown", "Unknown", "2020"]
    assert column(spark, names, lambda c: C.trailing_parts(c)[1]) == [2023, 2018, None, None, None]


URLS = {
    "https://aclanthology.org/2023.acl-long.0/": "venue-index", "https://aclanthology.org/2023.acl-long.42": "paper", "https://aclanthology.org/volumes/x/": "venue-index",
    "https://aclanthology.org/P05-1001": "paper", "https://openaccess.thecvf.com/CVPR2020?day=all": "venue-index", "https://openaccess.thecvf.com/content_CVPR_2020/html/A_paper.html": "paper",
    "https://openreview.net/forum?id=": "venue-index", "https://openreview.net/forum?id=abc": "paper", "https://openreview.net/group?id=ICLR": "venue-index",
    "https://www.ijcai.org/proceedings/2020/": "venue-index", "https://www.ijcai.org/proceedings/2020/0001": "paper", "https://e.org/x": "unknown", "": "unknown", "garbage": "unknown",
    "https://ieeexplore.ieee.org/xpl/conhome/123/proceeding": "venue-index",
}


def test_url_classes(spark):
    assert column(spark, list(URLS), C.classify_url) == list(URLS.values())
    assert column(spark, [None], C.classify_url) == ["unknown"]


def test_url_keys(spark):
    u = ["http://www.arXiv.org/PDF/2001.01234v2.pdf/", "https://e.org/P/?b=2&ID=7&x=1", "ftp://e.org/a", None, "https://e.org"]
    assert column(spark, u, C.normalise_url) == ["https://arxiv.org/pdf/2001.01234v2.pdf", "https://e.org/P?id=7", "", "", ""]
    assert column(spark, u[:1], C.arxiv_id) == ["2001.01234"]
    keys = column(spark, ["https://arxiv.org/pdf/2001.01234v2.pdf", "https://www.ijcai.org/proceedings/2020/0012.pdf"], C.identity_keys)
    assert [(k["kind"], k["key"]) for k in keys[0]][0] == ("arxiv", "2001.01234")
    assert [(k["kind"], k["key"]) for k in keys[1]][0] == ("ijcai", "2020:12")


def test_titles_and_texts(spark):
    assert column(spark, ["A-b  C", None], C.normalise_text) == ["a b c", ""]
    assert column(spark, ["Über \\emph{β}-Nets!"], lambda c: C.title_key(c, "nfkc")) == ["überβnets"]
    assert column(spark, ["Über β"], lambda c: C.title_key(c, "cvf")) == ["uberbeta"]
    assert column(spark, ["<p>in-\nside the\nhouse\nNext</p>"], C.clean_abstract) == ["inside the house Next"]
    assert column(spark, [r"\emph{On} $\alpha$ -- \'{e}"], C.clean_tex_abstract) == ["On α – é"]
    assert column(spark, [["Ann Müller", "Bo D'Óz"], [], None], C.author_surnames, "array<string>") == [["d'oz", "mueller"], [], []]


def test_code_urls(spark):
    urls = ["https://github.com/A/B.git", "[x](https://gitlab.com/a/b)", "https://huggingface.co/a/b", "https://x.github.io/p", "https://youtu.be/1", "https://paperswithcode.com/p", "https://anonymous.4open.science/r/x", "", None, "https://github.com/a"]
    assert column(spark, urls, lambda c: C.classify_code_url(c)["reason"]) == ["", "", "model_or_dataset", "project_page", "video", "aggregator", "", "empty", "empty", "non_repository"]
    assert column(spark, urls[:2], C.normalise_repo) == ["https://github.com/a/b", "https://gitlab.com/a/b"]
    assert column(spark, ["see https://github.com/a/b)."], C.github_link) == ["https://github.com/a/b"]
    reasons = ["HTTP 429 x", "read timeout", "missing doi: not found", "404", "returned no abstract available for", "title mismatch", "", None, "odd"]
    assert column(spark, reasons, C.normalise_reason) == ["rate_limited", "timeout", "no_doi", "doi_not_found", "no_abstract_available", "title_mismatch", "network", "network", "network"]


def test_search(papers):
    page, total = search.search(papers, "of-the art", size=5)
    assert [r["seq"] for r in page.collect()] == [1] and total.first()["total"] == 1
    assert {r["seq"] for r in papers.filter(search.token_match("c++ node.js")).collect()} == {3}
    assert {r["seq"] for r in papers.filter(search.token_match("ai")).collect()} == {4, 5}
    assert {r["seq"] for r in papers.filter(search.token_match("lee ann", "author")).collect()} == {1, 4, 5}
    assert search.search(papers, "#")[1].first()["total"] == 4
    grams = search.build_gram_index(papers)
    assert {r["seq"] for r in search.narrowed_search(papers, grams, "parsing").collect()} == {1}
    known, unknown = search.get_by_ids(papers, ["nope", papers.filter("seq = 4").first()["id"]])
    assert [r["seq"] for r in known.collect()] == [4] and [r["id"] for r in unknown.collect()] == ["nope"]


def test_scores(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5)], "id string, pos int")
    s = spark.createDataFrame([("a", -1.0), ("b", 8.0), ("c", 90.0), ("d", 150.0), ("x", 0.5), ("e", float("nan"))], "paper_id string, score double")
    out = search.apply_scores(rows, s).orderBy("place").collect()
    assert [(r["id"], r["relevance"]) for r in out] == [("c", 0.9), ("b", 0.8), ("a", 0.0), ("d", 0.5), ("e", 0.5)]


def test_predicates(papers):
    ids = lambda p: {r["seq"] for r in papers.filter(p).collect()}
    assert ids(P.near("title", "state", "parsing", 3)) == {1} and ids(P.near("title", "state", "parsing", 2)) == set()
    assert ids(P.year_range(2023, 2019)) == {1, 4, 5} and ids(P.year_range("x", 2020)) == set()
    assert ids(P.negate(P.term("abstract", "mining"))) == {1, 3} and ids(P.term("title", " ")) == {1, 3, 4, 5}
    rows = [dict(field="title", value="parsing"), dict(op="OR", field="title", value="mining"), dict(op="AND", field="until", value=2021)]
    assert ids(P.rows_predicate(rows)) == {4, 5}


def test_front_matter(spark):
    rows = [
        ("ACL2023", "Proceedings of ACL", ["A"], "https://doi.org/10.1145/33", "text", "#", 1), ("ACL2023", "Preface", ["E. D (eds.)"], "https://e.org", "text", "#", 2),
        ("ACL2023", "Preface", ["A"], "https://e.org", "", "#", 3), ("ACL2023", "A paper", None, "https://e.org", "", None, 4), ("ACL2023", "Conference of ACL", ["A"], "https://aclanthology.org/P05-1000", "", "#", 5),
    ]
    d = spark.createDataFrame(rows, RAW)
    assert {r["seq"] for r in P.drop_on_collect(d).collect()} == {3, 4}
    kept, removed, by = P.drop_frontmatter(d)
    assert {r["seq"] for r in kept.collect()} == {2, 4} and by.first()["removed"] == 3


def test_merge(raw):
    out = {r["seq"]: r for r in merge.dedupe_clean(raw)[0].collect()}
    assert out[4]["paper_code"] == "https://github.com/m/n" and len(out[4]["paper_authors"]) == 2
    assert out[6]["paper_code"] is None and out[3]["paper_code"] == "https://github.com/x/y"
    again = merge.dedupe_clean(merge.dedupe_clean(raw)[0])[0]
    assert again.count() == len(out)
    stats_row = merge.dedupe_clean(raw)[1].first()
    assert (stats_row["rows_saved"], stats_row["code_upgraded"], stats_row["authors_extended"]) == (2, 1, 1)


def test_official_titles_need_surnames(spark):
    a = spark.createDataFrame([("IJCAI2020", "On β", ["Ann Müller"], "https://www.ijcai.org/proceedings/2020/1", "", "#", 1), ("IJCAI2020", "Twin", ["X Y"], "https://www.ijcai.org/proceedings/2020/2", "", "#", 2)], RAW)
    b = spark.createDataFrame([("IJCAI2020", "ON Β", ["A. Mueller"], "https://doi.org/10.1/1", "long", "#", 1), ("IJCAI2020", "Twin", ["P Q"], "https://www.ijcai.org/proceedings/2020/3", "", "#", 2)], RAW)
    out = merge.merge_official(a, b, "ijcai").collect()
    url = "https://www.ijcai.org/proceedings/2020/"
    assert sorted(r["paper_url"].replace("https://ijcai.org", "https://www.ijcai.org") for r in out) == ["https://doi.org/10.1/1", url + "2", url + "3"]


def test_official_titles_need_pages_of_papers(spark):
    """Titles of one name stay apart where an address is no page of an IJCAI paper."""
    a = spark.createDataFrame([("IJCAI2020", "On x", ["A B"], "https://e.org/1", "", "#", 1)], RAW)
    b = spark.createDataFrame([("IJCAI2020", "On x", ["A B"], "https://doi.org/10.1/1", "long", "#", 1)], RAW)
    assert merge.merge_official(a, b, "ijcai").count() == 2 and merge.merge_official(a, b, "cvf").count() == 1


def test_seq_of_any_size_keeps_the_order(spark):
    """seq may be as large as a long: sides don't mix and the number comes back."""
    big = 2**62
    a = spark.createDataFrame([("KDD2020", "New", ["A"], "https://e.org/1", "", "#", big + 5)], RAW)
    b = spark.createDataFrame([("KDD2020", "Old", ["A", "B"], "https://e.org/1", "text", "#", 3)], RAW)
    out = merge.merge_incremental(a, b).collect()
    assert [(r["paper_name"], r["seq"], r["paper_abstract"]) for r in out] == [("New", big + 5, "text")]
    lines = spark.createDataFrame([('{"url": "u", "status": "failed"}', 3 * 2**33), ('["u", "v"]', 2**62)], "value string, seq long")
    got = {r["url"]: (r["status"], r["seq"]["seq"], r["seq"]["pos"]) for r in ledger.ledger_latest(records.read_ledger(lines)).collect()}
    assert got == {"u": ("success", 2**62, 0), "v": ("success", 2**62, 1)}


def test_near_takes_the_nearest_pair(spark):
    d = spark.createDataFrame([(1, "a x x b"), (2, "a x x x b"), (3, "b a"), (4, "a a x a"), (5, "a"), (6, "b x x x x a x b")], "id int, abstract string")
    ids = lambda p: {r["id"] for r in d.filter(p).collect()}
    assert ids(P.near("abstract", "a", "b", 2)) == {1, 3, 6} and ids(P.near("abstract", "a", "a", 0)) == {4} and ids(P.near("abstract", "a", "b", 3)) == {1, 2, 3, 6}


def test_strata_have_scaled_quotas(spark):
    d = spark.createDataFrame([(str(i), 2000 + i % 3, f"https://h{i % 2}.org/{i:03d}") for i in range(100)], "id string, year int, url string")
    out = worklist.sample_strata(d, {"even": (F.col("url").contains("h0"), 18), "rest": (F.lit(True), 6)}, 12, 42).collect()
    assert [sum(r["stratum"] == s for r in out) for s in ("even", "rest")] == [9, 3]
    rows = sorted(((r.year, r.url) for r in d.filter(F.col("url").contains("h0")).collect()))
    for r in out:
        if r["stratum"] == "even":
            place = rows.index((r["year"], r["url"]))
            assert int(r["slice"] * 50 / 9) <= place < int((r["slice"] + 1) * 50 / 9)


def test_ledger(spark):
    rows = [("u1", "failed", None, None, 1, "HTTP 429", "2024-01-02", 1), ("u1", "success", "x", 30, 0, None, "2024-02-02", 2), ("u2", "failed", None, None, 3, None, "", 3), ("u3", "success", "x", 60, 0, None, None, 4), ("u4", "success", "x", None, 0, None, None, 5)]
    e = spark.createDataFrame(rows, "url string, status string, source string, chars int, attempts int, reason string, ts string, seq long").withColumn("rescued", F.lit(False)).withColumn("last_source", F.lit(None).cast("string"))
    state = ledger.ledger_latest(e)
    assert {r["url"]: r["status"] for r in state.collect()} == {"u1": "success", "u2": "failed", "u3": "success", "u4": "success"}
    demoted, counts = ledger.demote_short(state, 60)
    assert counts.first().asDict() == {"demoted": 1, "no_chars": 1}
    assert {r["url"]: r["reason"] for r in demoted.filter("status = 'failed'").collect()} == {"u1": "empty_abstract", "u2": None}
    report = {(r["kind"], r["key"]): r["n"] for r in ledger.ledger_report(state).collect()}
    assert report[("reason", "(unspecified)")] == 1 and report[("month", "(no-ts)")] == 3 and report[("total", "all")] == 4
    out = spark.createDataFrame([("u2", False, None, None, "title mismatch", "t"), ("u9", False, None, None, "429", "t")], "url string, ok boolean, source string, chars int, reason string, ts string")
    new = {r["url"]: r for r in ledger.ledger_apply(state, out).collect()}
    assert (new["u2"]["attempts"], new["u2"]["reason"], new["u9"]["attempts"]) == (4, "title_mismatch", 0)


def test_stream_keeps_the_latest(spark, tmp_path):
    schema = "url string, status string, seq long"
    for part in ([("a", "failed", 1), ("b", "failed", 2)], [("a", "success", 3)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        kind = spark.createDataFrame([], schema).schema
        ledger_stream.ledger_stream(spark, f"{tmp_path}/events", f"{tmp_path}/state", f"{tmp_path}/checkpoint", kind).awaitTermination()
    out = ledger_stream.current_state(spark, f"{tmp_path}/state").collect()
    assert {r["url"]: r["status"] for r in out} == {"a": "success", "b": "failed"}


def test_linkage(spark, papers):
    rows = spark.createDataFrame([("k", "x", 1), ("k", "y", 2), ("j", "z", 3), ("j", "z", 4), ("", "q", 5)], "key string, text string, seq long")
    assert [r["key"] for r in linkage.unambiguous_index(rows, "key", F.col("text")).collect()] == ["j"]
    c = spark.createDataFrame([("Deep nets for x", "Deep nets for y", 0.9), ("A", "A whole other thing", 1.0), ("", "x", 0.0)], "a string, b string, r double")
    assert [r["ok"] for r in c.select(linkage.title_gate(F.col("a"), F.col("b"), 0.85).alias("ok")).collect()] == [True, True, False]
    guard = spark.createDataFrame([("KDD2020", "Proc 2020", None), ("KDD2020", "Proc 2019", None), ("KDD2020", "", "2019-05-01"), ("KDD2020", "", "2017-05-01"), ("KDD", "2019", None), ("KDD2020", None, None)], "conf string, v string, d string")
    assert [r[0] for r in guard.select(linkage.year_guard(F.col("conf"), F.col("v"), F.col("d").cast("date"))).collect()] == [True, False, True, False, True, True]


def test_candidates(spark):
    p = spark.createDataFrame([("1", "A study of graphs in the wild", 2010), ("2", "Other", 2010), ("3", "None here", 2010)], "id string, title string, year int")
    c = [("1", "crossref", 0, "A study of graphs in the wilds", 2011, "l1"), ("1", "arxiv", 0, "A study of graphs in the wilds", 2010, "l2"), ("2", "crossref", 0, "Different", 2010, "l3")]
    best, _ = linkage.accept_candidates(p, spark.createDataFrame(c, "id string, source string, rank int, title string, year int, landing_url string"))
    assert {r["id"]: (r["source"], r["reason"]) for r in best.collect()} == {"1": ("crossref", "accepted"), "2": (None, "title_mismatch"), "3": (None, "no_candidate")}


def test_repair_collisions(spark):
    wrap = "https://web.archive.org/web/2019/http://old.org/"
    rows = [("A2020", "One", ["x"], wrap + "1", "", "#", 1), ("A2020", "One", ["x", "y"], wrap + "2", "long text", "#", 2), ("A2020", "Two", [], "https://doi.org/10.1/2", "t", "#", 3), ("A2020", "Two", [], wrap + "3", "", "#", 4)]
    accepted = spark.createDataFrame([(1, "https://doi.org/10.1/1", "found", "s"), (2, "https://doi.org/10.1/1", "found", "s"), (4, "https://doi.org/10.1/2", "found it", "s")], "seq long, new_url string, abstract string, source string")
    out, log = repair.repair_urls(spark.createDataFrame(rows, RAW), accepted)
    assert {r["seq"]: r["action"] for r in log.collect()} == {1: "rewrite", 2: "merge", 4: "merge"}
    got = {r["paper_url"]: r for r in out.collect()}
    assert set(got) == {"https://doi.org/10.1/1", "https://doi.org/10.1/2"} and got["https://doi.org/10.1/1"]["paper_abstract"] == "long text"


def test_budget_and_strata(spark, papers):
    t = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(5)], "conf string, seq int")
    ranked = spark.createDataFrame([("a", 2), ("b", 1)], "conf string, rank int")
    out = worklist.budget(t, ranked, 7).collect()
    assert sum(r["conf"] == "b" for r in out) == 5 and {r["seq"] for r in out if r["conf"] == "a"} == {0, 1}
    same = [worklist.sample_strata(papers, {"all": F.lit(True)}, 2, 1).collect() for _ in range(2)]
    assert same[0] == same[1] and len(same[0]) == 2


def test_delta_is_never_negative(raw):
    assert stats.delta(raw, raw.limit(1)).count() == 0
    assert {r["conf"]: (r["new_papers"], r["new_conf"]) for r in stats.delta(raw.filter("seq < 3"), raw).collect()}["KDD2020"] == (2, True)


def test_records_round_trip(spark, tmp_path, papers):
    lines = ['{"conf": "A2020", "paper_name": "x", "paper_authors": "one"}', "", '{"conf": 3}', "{broken", '{"conf": "B2021", "paper_authors": ["a", "b"]}']
    rows = records.parse_papers(spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "value string, seq long"))
    good, bad, n = records.validate(rows, 0.5)
    assert n == {"rows": 4, "errors": 2} and [r["paper_authors"] for r in good.orderBy("seq").collect()] == [["one"], ["a", "b"]]
    with pytest.raises(ValueError):
        records.validate(rows)
    assert records.write_papers(papers, f"{tmp_path}/p") == 4 and records.write_papers(papers.limit(2), f"{tmp_path}/p") == 2
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    records.export_csv(papers, f"{tmp_path}/csv")
    back = spark.read.csv(f"{tmp_path}/csv", header=True, escape='"', multiLine=True)
    assert back.count() == 4


def test_ledger_versions(spark):
    lines = ['{"_meta": {"v": 4}}', '{"url": "a", "status": "failed", "attempts": 2}', "oops", '["b", "c"]', '{"d": {"status": "success", "chars": 5}}', '{"status": "success"}']
    out = records.read_ledger(spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "value string, seq long"))
    assert {(r["url"], r["status"]) for r in out.collect()} == {("a", "failed"), ("b", "success"), ("c", "success"), ("d", "success")}


def test_pages(spark):
    long = "This abstract is quite long enough to pass the gate of sixty characters."
    rows = [("https://a.org/1", f"<div class='abs'><b>Abstract</b> {long}<script>x</script></div>"), ("https://a.org/2", "<div class='abs'>short</div>"), ("https://a.org/3", "<p>no</p>"), ("https://openreview.net/forum?id=", ""), ("https://z.org", "<p>x</p>"), ("https://a.org/4", f"<meta name='description' content='{long}'><broken")]
    rules = spark.createDataFrame([("a.org", [".abs", "meta:description"]), ("openreview.net", ["p"])], "host string, selectors array<string>")
    out = {r["url"]: (r["ok"], r["reason"]) for r in pages.extract_pages(spark.createDataFrame(rows, "url string, html string"), rules).collect()}
    assert list(out.values()) == [(True, None), (False, "empty_abstract"), (False, "no_abstract_available"), (False, "venue_index"), (False, "no_rule"), (True, None)]
    sliced = column(spark, ["T\nAbstract\nWe do\nthings.\n1. Introduction\nmore", "no section", "Abstract - Copyright x"], records.slice_abstract_section)
    assert sliced[0] == "We do things." and sliced[1] is None


def test_inverted_index(spark):
    rows = spark.createDataFrame([({"we": [0], "go": [1, 3]},), ({},), (None,)], "m map<string, array<int>>")
    assert [r[0] for r in rows.select(records.flatten_inverted_index(F.col("m"))).collect()] == ["we go  go", None, None]


def test_files_in_and_out(spark, tmp_path, papers):
    import gzip

    with gzip.open(tmp_path / "in.jsonl.gz", "wt") as f:
        f.write('{"conf": "A2020", "paper_name": "x"}\n\n{"conf": "B2021", "paper_name": "y"}\n')
    rows = records.read_papers(spark, str(tmp_path / "in.jsonl.gz"))
    assert [r["paper_name"] for r in rows.orderBy("seq").collect()] == ["x", "y"]
    assert records.preflight(rows)[0] == {"rows": 2, "errors": 0}
    with pytest.raises(ValueError):
        records.preflight(rows.limit(0))
    records.export_txt(papers, f"{tmp_path}/txt")
    assert "[KDD2020]\tAI of mining" in {r["value"] for r in spark.read.text(f"{tmp_path}/txt").collect()}
    assert records.write_papers(papers, f"{tmp_path}/json", "json") == 4


def test_windows_of_a_table(spark):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", "ok"), ("2024-01-01 23:00:00", "ok"), ("2024-01-02 01:00:00", "ok")], "at string, status string")
    out = ledger_stream.windowed_outcomes(rows.withColumn("at", F.to_timestamp("at")))
    assert sorted(r["n"] for r in out.collect()) == [1, 2]


def test_a_failed_write_keeps_the_old_data(spark, tmp_path, papers):
    records.write_papers(papers, f"{tmp_path}/p")
    with pytest.raises(ValueError):
        records.replace_verified(papers, f"{tmp_path}/p", read=lambda s, p: s.read.parquet(p).limit(1))
    assert spark.read.parquet(f"{tmp_path}/p").count() == 4


def test_listings_and_notes(spark):
    page = spark.createDataFrame([("https://a.org/list", "KDD2020", "<ul><li>1. <a href='/p/1'>On trees</a>. by Ann Lee, Bo Xu</li><li><a href='https://openreview.net/forum?id='>index</a></li></ul>")], "url string, conf string, html string")
    rules = spark.createDataFrame([("a.org", "li", "by")], "host string, entry string, separator string")
    out = pages.extract_listing(page, rules).collect()
    assert [(r["paper_name"], r["paper_authors"], r["paper_url"]) for r in out] == [("On trees", ["Ann Lee", "Bo Xu"], "https://a.org/p/1")]


def test_lookups(spark):
    p = spark.createDataFrame([("1", "k1", "https://arxiv.org/abs/2001.01234", "T", True, True), ("2", "k2", "", "Same Title", True, False), ("3", "k3", "", "Gone", True, True)], "id string, key string, url string, title string, no_abstract boolean, no_code boolean")
    text = "long enough " * 8
    r = spark.createDataFrame([("k1", True, "2001.01234", "Other", text, "https://github.com/a/b", False, 5, 0), ("k1", True, "2001.01234", "Other", text, "https://github.com/o/o", True, 1, 1), ("k2", True, None, "ＳAME title", text, None, None, None, 0)],
                              "key string, ok boolean, r_arxiv string, r_title string, r_abstract string, repo_url string, is_official boolean, stars int, pos int")
    out = {x["id"]: x for x in linkage.resolve_lookup(p, r).collect()}
    assert (out["1"]["repo"], out["1"]["abstract_status"], out["1"]["terminal"]) == ("https://github.com/o/o", "filled", True)
    assert (out["2"]["abstract_status"], out["2"]["code_status"]) == ("filled", "not_needed")
    assert (out["3"]["abstract_status"], out["3"]["terminal"]) == ("failed", False)


def test_audit_and_revert(spark):
    now = spark.createDataFrame([("A2020", "One", [], "https://doi.org/10.1/1", "filled", "#", 1)], RAW)
    before = spark.createDataFrame([("A2020", "One", [], "https://web.archive.org/web/1/http://x.org/1", "", "#", 1)], RAW)
    log = spark.createDataFrame([("A2020", "https://web.archive.org/web/1/http://x.org/1", "https://doi.org/10.1/1", "rewrite", True, None, 1)] * 2, "conf string, old_url string, new_url string, action string, abstract_filled boolean, old_name string, seq long")
    titles = spark.createDataFrame([("https://doi.org/10.1/1", "Something else entirely")], "new_url string, remote_title string")
    out = repair.audit(log, now, before, titles)
    assert [r["verdict"] for r in out.collect()] == ["FAIL"]
    state = spark.createDataFrame([("https://web.archive.org/web/1/http://x.org/1", 1)], "url string, attempts int")
    rows, events = repair.revert(now, before, repair.select_reverts(out), state)
    assert [(r["paper_url"], r["paper_abstract"]) for r in rows.collect()] == [("https://web.archive.org/web/1/http://x.org/1", "")]
    assert [(r["reason"], r["attempts"]) for r in events.collect()] == [("title_mismatch", 2)]


def test_listing_records(spark):
    rows = [("ACL2020", "On trees", ["Ann Lee"], "https://aclanthology.org/2020.acl-main.1/", "p1", 0), ("ACL2020", "On trees", ["Ann Lee", "Bo Xu"], "https://www.aclanthology.org/2020.acl-main.1", "p1", 1),
            ("ACL2020", "Preface", [], "https://aclanthology.org/2020.acl-main.9", "p1", 2), ("ACL2020", "Of a workshop", [], "https://aclanthology.org/2020.ws-1.4", "p1", 3), ("KDD2020", "No tag", [], "https://k.org/1", "p2", 0)]
    entries = spark.createDataFrame(rows, "conf string, paper_name string, paper_authors array<string>, paper_url string, page string, pos int").withColumn("page_no", F.lit(0).cast("long"))
    tags = spark.createDataFrame([("ACL2020", "2020.acl-main")], "conf string, tag string")
    details = spark.createDataFrame([("https://k.org/1", "10.1/k", "https://github.com/a/b", " Text. "), ("https://k.org/2", "", None, None)], "url string, doi string, code string, abstract string")
    out = {r["paper_name"]: r for r in pages.listing_records(entries, tags, details).collect()}
    assert set(out) == {"On trees", "No tag"} and len(out["On trees"]["paper_authors"]) == 2
    assert (out["No tag"]["paper_url"], out["No tag"]["paper_code"], out["No tag"]["paper_abstract"]) == ("https://doi.org/10.1/k", "https://github.com/a/b", "Text.")
    assert {r["paper_name"] for r in pages.listing_records(entries).collect()} == {"On trees", "Of a workshop", "No tag"}


def test_one_search_field_holds_all_grams(spark):
    rows = [("1", "alpha beta", "", "gamma delta"), ("2", "alpha", "beta", "gamma"), ("3", "", "alpha beta", "zeta"), ("4", "alpha beta", "", "")]
    p = spark.createDataFrame(rows, "id string, title string, abstract string, authors_text string").withColumn("authors", F.array()).withColumn("conf", F.lit("X")).withColumn("year", F.lit(2000))
    index = search.build_gram_index(p)
    ids = lambda *a, **k: {r["id"] for r in search.gram_candidates(index, *a, **k).collect()}
    assert ids("alpha beta") == {"1", "3", "4"} and ids("alpha beta", author="gamma zeta") == {"1", "3"} and ids("alpha", author="ga zeta") == {"1", "2", "3", "4"}
    assert search.gram_candidates(index, "", author="ab") is None


def test_rules_past_ten_thousand_are_used(spark):
    rules = spark.range(10_050).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".org")).alias("host"), F.array(F.lit("p")).alias("selectors"))
    rows = [(f"https://h{i}.org/x", "<p>" + "long enough text " * 6 + "</p>") for i in (0, 9_999, 10_000, 10_049)]
    out = pages.extract_pages(spark.createDataFrame(rows, "url string, html string"), rules).collect()
    assert len(out) == 4 and all(r["ok"] for r in out)

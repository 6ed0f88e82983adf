"""Queries that once ran on cut inputs, on small tables of their own."""

from quillspark.plans import registry


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_whole_abstracts_are_compared(spark, tmp_path):
    """Read backwards the whole text is the same, its first 300 characters are not."""
    half = "".join(chr(97 + i * i % 26) + chr(97 + i // 26) for i in range(400))
    out = registry.QUERIES["w11_compare_texts"](spark, documents(spark, tmp_path, [(1, half + half[::-1])])).collect()
    assert [(r["verdict"], r["n"]) for r in out] == [("PASS", 1)]


def test_titles_with_repeated_words(spark, tmp_path):
    titles = ["the more the merrier", "two  spaces", "plain title"]
    out = registry.QUERIES["i6_inverted_index_whole"](spark, documents(spark, tmp_path, [(i, f"{t}. Rest.") for i, t in enumerate(titles)])).collect()
    assert {r["seq"]: r["t"] for r in out} == dict(enumerate(titles))


def test_papers_that_share_a_failed_url(spark, tmp_path):
    """Titles of one length give one url; the odd paper shares that of the even one."""
    rows = [(10, "abcdef. x"), (15, "uvwxyz. y"), (25, "a title of another length. z")]
    sf = documents(spark, tmp_path, rows)
    assert registry.QUERIES["w4_title_targets_whole"](spark, sf).count() == 2


def test_event_files_are_bounded(spark, tmp_path, monkeypatch):
    """The stream takes bounded files, a bounded number at a time, and still folds all events."""
    from quillspark.plans import link_queries
    from quillspark.streaming import ledger_stream

    monkeypatch.setattr(link_queries, "EVENTS_A_FILE", 100)
    monkeypatch.setattr(link_queries, "FILES_A_BATCH", 3)
    batches, own = [], ledger_stream.ledger_latest
    monkeypatch.setattr(ledger_stream, "ledger_latest", lambda df: batches.append(df.count()) or own(df))
    rows = spark.range(1000).selectExpr("id as event_id", "timestamp'2024-01-01 00:00:00' as ts", "id % 70 as user_id", "if(id % 3 = 0, 'click', 'view') as event_type", "1.0D as value", "to_json(named_struct('k', id)) as props")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["url"].rsplit("/", 1)[1]: r["seq"] for r in registry.QUERIES["l8_ledger_stream"](spark, str(tmp_path)).collect()}
    assert got == {str(u): max(i for i in range(1000) if i % 70 == u) for u in range(70)}
    assert max(batches[:-1]) <= 300 and sum(batches[:4]) == 1000

"""What batches write, restarts after a crash, and the state against the fold of all events."""

import os

import pytest
from pyspark.sql import functions as F

from quillspark.operators.ledger import ledger_latest
from quillspark.streaming import ledger_stream as L


def events(spark, n, first=0, urls=50):
    r = spark.range(first, first + n)
    url = F.concat(F.lit("https://x.org/"), F.pmod(F.xxhash64("id"), F.lit(urls)).cast("string"))
    status = F.when(F.col("id") % 3 == 0, "success").otherwise("failed")
    return r.select(
        url.alias("url"), status.alias("status"), F.lit("s").alias("source"), F.col("id").cast("int").alias("chars"), F.lit(1).alias("attempts"),
        F.lit("").alias("reason"), F.lit(None).cast("string").alias("last_source"), F.lit(False).alias("rescued"), F.lit("2024").alias("ts"), F.col("id").alias("seq"),
    )


def add(df, path, number):
    """One event file, so one micro-batch."""
    df.coalesce(1).write.parquet(f"{path}/tmp-{number}")
    os.makedirs(f"{path}/events", exist_ok=True)
    part = next(f for f in os.listdir(f"{path}/tmp-{number}") if f.endswith(".parquet"))
    os.rename(f"{path}/tmp-{number}/{part}", f"{path}/events/{number:03}.parquet")


def run(spark, path, schema, **kw):
    query = L.ledger_stream(spark, f"{path}/events", f"{path}/state", f"{path}/checkpoint", schema, files=1, **kw)
    query.awaitTermination()


def state(df):
    return sorted(map(str, df.select("url", "status", "chars", "seq").collect()))


def size(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_state_over_batches_and_restarts(spark, tmp_path):
    parts = [events(spark, 40, 40 * i) for i in range(7)]
    for i, part in enumerate(parts[:4]):
        add(part, tmp_path, i)
    run(spark, tmp_path, parts[0].schema, every=3, buckets=8)
    every = parts[0]
    for part in parts[1:4]:
        every = every.unionByName(part)
    assert state(L.current_state(spark, f"{tmp_path}/state")) == state(ledger_latest(every))
    for i, part in enumerate(parts[4:], 4):
        add(part, tmp_path, i)
        every = every.unionByName(part)
    run(spark, tmp_path, parts[0].schema, every=3, buckets=8)
    assert state(L.current_state(spark, f"{tmp_path}/state")) == state(ledger_latest(every))
    assert sorted(os.listdir(f"{tmp_path}/state/manifests"))[-1] == "5"
    assert L.current_state(spark, f"{tmp_path}/none") is None


@pytest.mark.parametrize("where", ["delta", "base", "manifest"])
def test_a_killed_stream_is_taken_up(spark, tmp_path, monkeypatch, where):
    """The driver dies after a delta, in a compaction before its manifest, or after the manifest; then it starts again."""
    parts = [events(spark, 30, 30 * i) for i in range(3)]
    for i, part in enumerate(parts):
        add(part, tmp_path, i)
    calls = {"n": 0}
    real_compact, real_put, real_clean = L.compact, L.Folder.put, L.clean

    def once(f):
        def g(*a, **k):
            calls["n"] += 1
            if calls["n"] == 1:
                raise RuntimeError("killed")
            return f(*a, **k)

        return g

    if where == "delta":
        monkeypatch.setattr(L, "compact", once(real_compact))
    elif where == "base":
        monkeypatch.setattr(L.Folder, "put", once(real_put))
    else:
        monkeypatch.setattr(L, "clean", once(real_clean))
    with pytest.raises(Exception, match="killed"):
        run(spark, tmp_path, parts[0].schema, every=2, buckets=4)
    seen = parts[0].unionByName(parts[1])
    assert state(L.current_state(spark, f"{tmp_path}/state")) == state(ledger_latest(seen))
    run(spark, tmp_path, parts[0].schema, every=2, buckets=4)
    assert calls["n"] >= 2
    assert state(L.current_state(spark, f"{tmp_path}/state")) == state(ledger_latest(seen.unionByName(parts[2])))


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    """A small batch after a large one adds a small delta; its compaction leaves other buckets' files as they are."""
    large = events(spark, 5000, urls=3000)
    add(large, tmp_path, 0)
    run(spark, tmp_path, large.schema, every=1, buckets=16)
    before = size(f"{tmp_path}/state/base")
    small = large.filter("seq = 7").withColumn("seq", F.lit(9000).cast("long"))
    add(small, tmp_path, 1)
    run(spark, tmp_path, large.schema, every=1, buckets=16)
    after = size(f"{tmp_path}/state/base")
    assert all(after.get(f) == t for f, t in before.items())
    assert len({os.path.dirname(f) for f in after} - {os.path.dirname(f) for f in before}) == 1
    assert spark.read.parquet(f"{tmp_path}/state/deltas/batch=1").count() == 1
    assert state(L.current_state(spark, f"{tmp_path}/state")) == state(ledger_latest(large.unionByName(small)))


def test_old_versions_go(spark, tmp_path):
    part = events(spark, 20, urls=5)
    for i in range(6):
        add(part.withColumn("seq", F.col("seq") + 100 * i), tmp_path, i)
    run(spark, tmp_path, part.schema, every=1, buckets=2)
    assert sorted(os.listdir(f"{tmp_path}/state/manifests")) == [x for x in sorted(os.listdir(f"{tmp_path}/state/manifests")) if x.endswith(".crc") or x in "45"]
    assert {n for n in os.listdir(f"{tmp_path}/state/base")} <= {"v=4", "v=5"}
    assert {n for n in os.listdir(f"{tmp_path}/state/deltas")} == {"batch=5"}
    assert L.current_state(spark, f"{tmp_path}/state").agg(F.min("seq")).first()[0] >= 500

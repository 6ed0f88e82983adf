"""Repeated query rows, pruning, long words, direct solves, event histories and salted ways back."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, chat, exact_dedup, neighbours, packing, quality, shared, toxicity


# 1
def test_repeated_query_rows_keep_their_own_ranks(spark):
    rows = [(1, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (None, [1.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = neighbours.nearest(d, d.filter("vec_id = 7"), k=3, factor=1.0).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in out) == [(1, 1), (1, 1), (2, 6), (2, 6), (3, 8), (3, 8)]
    one = neighbours.nearest(d, d.filter("vec_id = 1"), k=3, factor=1.0).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in one) == [(1, 6), (2, 7), (3, 7)]


def recall_and_seen(points, n):
    ids = np.arange(len(points))
    tree = neighbours.VpTree(points)
    exact = neighbours.VpTree(points).search(points[:n], ids[:n], ids, 10, 1.0)[1]
    some = tree.search(points[:n], ids[:n], ids, 10, neighbours.FACTOR)[1]
    return np.mean([len({*a} & {*b}) / 10 for a, b in zip(exact, some, strict=True)]), tree.seen / (n * len(points))


def test_recall_at_the_production_factor():
    rng = np.random.default_rng(2)
    flat = rng.normal(size=(8000, 64))
    recall, seen = recall_and_seen(flat / np.linalg.norm(flat, axis=1, keepdims=True), 50)
    assert recall >= 0.95 and seen < 0.99  # nearly orthogonal vectors: hardly anything can be pruned
    centres = rng.normal(size=(60, 64))
    near = centres[rng.integers(0, 60, 8000)] + 0.3 * rng.normal(size=(8000, 64))
    recall, seen = recall_and_seen(near, 50)
    assert recall >= 0.95 and seen < 0.4


# 2
def test_toxicity_against_a_direct_computation(spark):
    """Scores of the query's operator against log-odds, segments, E-values and the logistic fit computed row by row."""
    rng = random.Random(21)
    bad = ["idiot", "moron", "scum"]
    texts = [" ".join(rng.choice([*"abcdefgh", *bad] if i % 3 == 0 else list("abcdefgh")) * 3 for _ in range(40)) for i in range(300)] + ["", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(d, marks).collect()}

    import pyarrow as pa

    from quillspark.llm import hashing

    def buckets(t):
        data, offsets = hashing.column_bytes(pa.array([t or ""]))
        return toxicity.features(data, offsets)[1]

    learn = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
    counts = np.zeros((2, 1 << toxicity.BITS))
    for i in learn:
        np.add.at(counts[int(i % 3 == 0)], buckets(texts[i]).ravel(), 1)
    both = counts.sum(0) + 0.5
    a = 10_000 * both / both.sum()
    t, c = counts[1] + a, counts[0] + a
    delta = np.log(t / (t.sum() - t)) - np.log(c / (c.sum() - c))
    z = delta / np.sqrt(1 / t + 1 / c)
    weight = delta * np.maximum(0, 1 - (3 / np.maximum(abs(z), 1e-9)) ** 2)

    def segments(text):
        x = [weight[row[np.argmax(abs(z[row]))]] - toxicity.DRIFT for row in buckets(text)]
        best, found = [(0, len(x))], []
        while best:  # the best segment, then what is left of it and right of it
            lo, hi = best.pop()
            top, at = 0.0, None
            for i in range(lo, hi):
                run = 0.0
                for j in range(i, hi):
                    run += x[j]
                    if run > top + 1e-9:
                        top, at = run, (i, j)
            if at:
                found.append(top)
                best += [(lo, at[0]), (at[1] + 1, hi)]
        return len(x), found

    own = [segments(t) for t in texts]
    clean = [own[i] for i in learn if i % 3]
    n, tokens, total = sum(len(f) for _, f in clean), sum(m for m, _ in clean), sum(sum(f) for _, f in clean)
    k, lam = (n + 1) / (tokens + 1000), (n + 1) / (total + 1)
    evidence = [sum(max(0.0, -math.log(k * max(m, 1) * math.exp(-lam * s))) for s in f) for m, f in own]
    x = [min(60.0, math.floor(e * 4 + 0.5) / 4) for e in evidence]
    bins = Counter(x[i] for i in learn)
    a0, b0 = toxicity.logistic_1d([(v, w, sum(1 for i in learn if x[i] == v and i % 3 == 0)) for v, w in bins.items()])
    for i in range(len(texts)):
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(a0 + max(b0, 0) * x[i]))), abs=2e-3)


# 7
def test_quality_against_a_direct_solve(spark):
    rng = random.Random(22)
    texts = [" ".join(rng.choice(["the", "house", "BUY!!", "###", "far."]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    y = {i: int(t.count("the") * 4 > len(t.split())) for i, t in enumerate(texts)}
    marks = spark.createDataFrame([(i, v, 0) for i, v in y.items()], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality.quality(d, marks).collect()}
    stats = np.array([quality.one_text(np.frombuffer(t.encode(), np.uint8), quality.classes()) for t in texts])
    kernel = quality.Kernel(stats.mean(0), stats.std(0))
    learn = [i for i in y if zlib.crc32(str(i).encode()) % 5]
    z, target = kernel(stats[learn]), np.array([y[i] for i in learn], float)
    penalty = 1e-3 * max(1.0, len(learn)) / quality.FEATURES * np.eye(quality.FEATURES + 1)
    penalty[-1, -1] = 1e-6
    weights = np.linalg.lstsq(np.vstack([z, np.linalg.cholesky(penalty).T]), np.concatenate([target, np.zeros(quality.FEATURES + 1)]), rcond=None)[0]
    at = (np.clip(kernel(stats) @ weights, -0.2, 1.2) + 0.2) / 1.4 * quality.BINS
    bins = {}
    for i in learn:
        n, s = bins.get(b := int(np.round(at[i])), (0, 0))
        bins[b] = (n + 1, s + y[i])
    x, v = quality.isotonic([(b, n, s) for b, (n, s) in bins.items()])
    assert np.abs(np.array([got[i] for i in range(400)]) - np.interp(at, x, v)).max() < 0.02


def test_random_features_approach_the_gaussian_kernel():
    rng = np.random.default_rng(23)
    rows = rng.normal(size=(40, len(quality.STATS)))
    z = quality.Kernel(np.zeros(len(quality.STATS)), np.ones(len(quality.STATS)))(rows)[:, :-1]
    exact = np.exp(-0.05 * ((rows[:, None] - rows[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - exact).mean() < 0.06


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


# 8
def test_long_words_equal_the_library_and_take_linear_time():
    import time

    from tokenizers import Tokenizer

    path = shared.tokenizer_path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    rng = random.Random(24)
    texts = ["".join(rng.choice(["ab", "the", "é", "x", "ing", "日"]) for _ in range(n)) for n in (20, 50, 300, 3000)] + ["a" * 5000]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    began = time.perf_counter()
    assert len(b"".join(own.encode(["".join(rng.choice("abcdefgh") for _ in range(400_000))]))) > 0
    assert time.perf_counter() - began < 30


# 5
def test_histories_fold_back(spark):
    rng = random.Random(25)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice([None, "", "é😀x", "hello world", "a\nb"])) for c in range(30) for t in range(5)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.events_of(d)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    got = sorted((r["conv_id"], r["turn_no"], r["role"], r["text"]) for r in chat.fold_events(log).collect())
    assert got == sorted((c, t + 1, role, text or "") for c, t, role, text in rows)


# 6
def test_salted_way_back(spark):
    rows = [(i, "copy" if i % 3 else f"own {i}") for i in range(400)] + [(7, "Copy"), (None, "copy"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for salts, bits in ((8, 256), (1, 256), (63, 256), (8, 4)):
        out = exact_dedup.exact_dedup(d, salts=salts, digest_bits=bits).collect()
        assert len(out) == len(rows)
        assert Counter((r["keep_id"], r["group_size"]) for r in out)[(398, 268)] == 268


# 9
def test_pieces_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(shared.tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(26)
    texts = [" ".join(rng.choice(["the", "Ünï", "42", "  ", "hello"]) for _ in range(n)) for n in (0, 1, 30, 900, 4000)] + [None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = packing.best_fit_pack(d).orderBy("doc_id", "piece").collect()
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want = [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out if r["doc_id"] == i] == want


def test_runs_are_bounded_by_the_capacity():
    """However many documents: the table of runs that is broadcast has a few rows for each length."""
    rng = random.Random(27)
    sizes = [len(packing.pack_histogram({n: rng.randint(1, most) for n in range(1, 1025)}, 1024)) for most in (10, 1000, 10**6)]
    assert max(sizes) < 20 * 1024


# shared
def test_a_cluster_without_a_shared_folder_is_an_error():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session)


# 10
def test_a_large_group_of_unequal_near_copies(spark):
    """5,000 variants of one text, no two equal, are one component; pairs of other texts keep to themselves."""
    from quillspark.llm import near_dedup

    rng = random.Random(28)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(5000):
        w = list(base)
        w[rng.randrange(150)] = f"own{i}"
        rows.append((1_000_000 + i, " ".join(w)))
    for i in range(100):
        w = [f"p{i}x{j}" for j in range(100)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:50], "other", *w[51:]]))]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(d, words=3, percent=85).collect()}
    assert all(out[1_000_000 + i] == 1_000_000 for i in range(5000))
    assert all(out[2 * i] == out[2 * i + 1] == 2 * i for i in range(100))


# 10
def test_places_are_drawn_without_replacement():
    from quillspark.llm import near_dedup

    assert len({p for _, p in near_dedup.roots(64)}) == 64 and near_dedup.roots(10) == near_dedup.roots(64)[:10]
    rng = np.random.default_rng(30)
    tokens = rng.integers(0, 2**32, (200, near_dedup.TOKENS), np.uint32)
    path, used = rng.integers(1, 2**62, 200, np.uint64), np.ones(200, np.uint64)
    for level in range(2, near_dedup.TOKENS + 1):
        before = used
        path, used = near_dedup.children(path, used, tokens)
        assert (before & used == before).all() and all(int(u).bit_count() == level for u in used)


def test_a_third_of_all_rows_of_one_set(spark, monkeypatch):
    from quillspark.llm import near_dedup

    monkeypatch.setattr(near_dedup, "HOT_ROWS", 20)
    monkeypatch.setattr(near_dedup, "MOST_HOT", 1000)
    words = [f"w{i}" for i in range(40)]
    near = [" ".join(words[:30]), " ".join([*words[:29], "other"])]
    rows = [(i, near[0]) for i in range(100, 160)] + [(5, near[1])] + [(i, f"text number {i} has words of its own {i * 7}") for i in range(200, 300)] + [(1, ""), (2, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_dedup.near_dedup(d, words=3).collect()}
    assert len(out) == len(rows) and all(out[i] == (5, i == 5) for i in [5, *range(100, 160)])
    assert all(out[i] == (i, True) for i in [*range(200, 300), 1, 2])

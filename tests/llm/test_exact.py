"""Results of the operators against brute force, other libraries and exact round trips, on small fixtures."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, chat, exact_dedup, near_dedup, neighbours, packing, pii, quality, repeats, sets, shared, toxicity


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def words(rng, n):
    return [f"w{rng.randrange(n)}" for _ in range(n)]


# 1
@pytest.mark.parametrize("ties", [False, True])
def test_vp_tree_is_exact_at_factor_one(ties):
    rng = np.random.default_rng(0)
    points = rng.normal(size=(700, 5))
    points = np.round(points) if ties else points
    ids = rng.permutation(5000)[:700].astype(np.int64)
    tree = neighbours.VpTree(points)
    away, rows = tree.search(points[:60], ids[:60], ids, 10, 1.0)
    for q in range(60):
        d = np.sqrt(((points - points[q]) ** 2).sum(1))
        best = sorted((x, int(i)) for x, i in zip(d, ids, strict=True) if i != ids[q])[:10]
        assert [(x, int(ids[r])) for x, r in zip(away[q], rows[q], strict=True)] == best


def test_nearest_over_shards(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(400, 6)).astype(np.float32)
    d = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    out = neighbours.nearest(d, d.filter("vec_id % 20 = 0"), k=5, factor=1.0, shard=90, block=7).collect()
    wide = points.astype(float)
    for q in range(0, 400, 20):
        away = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        best = [i for _, i in sorted((x, i) for i, x in enumerate(away) if i != q)[:5]]
        assert [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])] == best


def test_recall_of_the_production_factor():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(4000, 64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    ids = np.arange(4000)
    exact = neighbours.VpTree(points).search(points[:50], ids[:50], ids, 10, 1.0)[1]
    some = neighbours.VpTree(points).search(points[:50], ids[:50], ids, 10, 3.0)[1]
    assert np.mean([len({*a} & {*b}) / 10 for a, b in zip(exact, some, strict=True)]) >= 0.95


# 2
def brute_segments(x):
    def within(lo, hi):
        best = None
        for i in range(lo, hi):
            for j in range(i, hi):
                s = sum(x[i : j + 1])
                if s > 0 and (best is None or s > best[2] + 1e-12):
                    best = (i, j, s)
        return [] if best is None else within(lo, best[0]) + [best[:2]] + within(best[1] + 1, hi)

    return within(0, len(x))


def test_maximal_segments():
    rng = random.Random(3)
    for _ in range(300):
        x = [rng.choice([-3, -2, -1, -1, 1, 2, 3.5]) + rng.random() / 100 for _ in range(rng.randint(0, 13))]
        total = np.cumsum(x) if x else []
        up = [i for i, v in enumerate(x) if v > 0]
        got = toxicity.maximal_segments(up, [float(total[i]) for i in up], [x[i] for i in up])
        assert [(a, b) for a, b, _ in got] == brute_segments(x)


def labelled(spark, good, bad):
    rng = random.Random(4)
    rows = [(i, (bad if i % 4 == 0 else good)(rng)) for i in range(1200)]
    marks = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    return docs(spark, rows), marks


def accuracy(out, least, toxic):
    held = [r for r in out if int.from_bytes(__import__("zlib").crc32(str(r["doc_id"]).encode()).to_bytes(4, "big")) % 5 == 0]
    assert len(held) > 150
    return np.mean([(r["score"] >= least) == ((r["doc_id"] % 4 == 0) == toxic) for r in held])


def test_toxicity_on_held_out_rows(spark):
    plain = lambda rng: " ".join(f"w{rng.randrange(300)}x".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(80))
    toxic = lambda rng: plain(rng)[:200] + " idiot moron" + rng.choice(["", "ic"]) + " " + plain(rng)
    d, marks = labelled(spark, plain, toxic)
    assert accuracy(toxicity.toxicity(d, marks).collect(), 0.5, True) >= 0.98


# 3
KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(n := re.sub("[^0-9]", "", m)) <= 19 and luhn(n)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def luhn(number):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(v - 9 * (v > 9) for v in twice) % 10 == 0


def test_base_spans_and_redaction(spark):
    rng = random.Random(5)
    bits = ["a", "B", ".", "@", "-", "+", "1", "42", "255", "4111111111111111", "4111 1111 1111 1111", " ", "é", "😀", "_", "%", "(555) ", "555-1234", "\n", "password=abc12345x", "+1 (988) 555-2485", "a.b@c.de", "1.2.3.4", "256.1.1.1"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + ["1 " * 20_000, "a" * 100_000]
    d = docs(spark, list(enumerate(texts)))
    out = {r["doc_id"]: r for r in pii.find_pii(d).select("doc_id", "spans", pii.listed(F.filter("spans", lambda s: s["kind"] < 4)).alias("base")).collect()}
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, f"{n}:{m.start()}:{m.end()}") for k, (n, p, ok) in enumerate(KINDS) for m in re.finditer(p, t) if ok(m[0]))
        assert out[i]["base"] == ",".join(x[2] for x in want)
    clean = {r["doc_id"]: r["text"] for r in pii.redact(d).collect()}
    for i, t in enumerate(texts):
        done, at = "", 0
        for s in sorted(out[i]["spans"], key=lambda s: (s["start"], s["end"], s["kind"])):
            if s["start"] >= at:
                done += t[at : s["start"]] + f"[{pii.KINDS[s['kind']].upper()}]"
            at = max(at, s["end"])
        assert clean[i] == done + t[at:]


def test_label_model_finds_the_reliable_labelers():
    rng = random.Random(6)
    counts = Counter()
    for _ in range(4000):
        y = rng.random() < 0.4
        vote = tuple((1 if (rng.random() < p) == y else -1) for p in (0.95, 0.9, 0.85, 0.6, 0.8))
        counts[(4, vote, 1)] += 1
    soft, seen = pii.label_model(counts)
    good = [table[1][0] for table in seen[4]]
    assert good[0] > 0.9 and good[0] > good[3]


# 4
def brute_passages(rows, size):
    words = [[x for x in re.split("[\x20\x09-\x0d]+", t or "") if x] for _, t in rows]
    n = Counter(tuple(w[p : p + size]) for w in words for p in range(len(w) - size + 1))
    for w in words:
        gone = bytearray(len(w))
        for p in range(len(w) - size + 1):
            if n[tuple(w[p : p + size])] > 1:
                gone[p : p + size] = b"\1" * size
        yield len(re.findall(b"\1+", bytes(gone)))


def brute_repeats(rows, span):
    data = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(b[p : p + span] for _, b in data for p in range(len(b) - span + 1))
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if n[b[p : p + span]] > 1:
                gone[p : p + span] = b"\1" * span
        yield i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, y in zip(b, gone, strict=True) if not y)


@pytest.mark.parametrize("span, reach, hot", [(400, 128, 200_000), (400, 128, 3), (40, 16, 200_000)])
def test_repeats(spark, span, reach, hot):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 8))) for _ in range(500)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [some(rng.choice([20, 60, 90, 150])) for _ in range(8)]
    part = lambda: rng.choice([rng.choice(passages), rng.choice(passages)[rng.randint(0, 50) : rng.randint(60, 700)], some(40)])
    rows = [(i, " ".join(part() for _ in range(rng.randint(1, 5)))) for i in range(100)]
    rows += [(900, None), (901, ""), (902, "a" * 1500), (903, "ab" * 500), (904, "a" * 400), (905, "b" * 399), (906, "c" * 400), (907, "d" * 401), (908, "e f " * 60), (909, "abcdefg hijk " * 90), (910, "x" * 300 + "abcdefg hijk " * 90), (0, rows[0][1]), (None, rows[3][1])]
    out = repeats.remove_repeats(docs(spark, rows), span=span, reach=reach, hot_rows=hot).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["n_passages"]) for r in out), key=str)
    assert got == sorted((x + (n,) for x, n in zip(brute_repeats(rows, span), brute_passages(rows, 51), strict=True)), key=str)


def test_triggers_of_equal_windows_agree():
    rng = np.random.default_rng(8)
    piece = rng.integers(97, 110, 600).astype(np.uint8)
    found = []
    for before in (0, 37, 1000):
        data = np.concatenate([rng.integers(97, 110, before).astype(np.uint8), piece])
        import pyarrow as pa

        (tape,) = repeats.byte_tapes(pa.array([data.tobytes().decode()]), 400, 128)
        at, low, high = repeats.triggers(tape.value, tape.offsets, 400, 128)
        found.append({(a - before, o) for a, x, y in zip(at, low, high, strict=True) for o in range(x, y + 1) if a - o >= before})
    assert found[0] == found[1] == found[2] and len(found[0]) == 201


# 5
def test_fold_edits_and_regenerations(spark):
    log = [(1, 1, "message", 0, "user", "hi <|im_end|> \\ <\\| x"), (1, 2, "delta", 1, "assistant", "a"), (1, 3, "delta", 1, "assistant", "b"), (1, 4, "regenerate", 1, "assistant", None),
           (1, 5, "delta", 1, "assistant", "c"), (1, 6, "delta", 1, "assistant", "d"), (1, 7, "message", 2, "user", "gone"), (1, 8, "regenerate", 1, None, None), (1, 9, "delta", 1, None, "e"), (1, 10, "edit", 0, "user", "hi <|im_start|>")]
    e = spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string")
    out = chat.read_back(chat.render(chat.fold_events(e))).first()
    assert [(t["role"], t["text"]) for t in out["turns"]] == [("user", "hi <|im_start|>"), ("assistant", "e")]
    assert out["loss_text"] == "e"


def test_escapes_round_trip(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["<", "|", "\\", "n", "\n", "<|im_end|>", "a", "é"]) for _ in range(rng.randint(0, 9))) for _ in range(600)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    out = d.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r["t"] == r["u"] and "<|" not in r["e"] for r in out)


# 6
def test_exact_dedup_when_digests_collide(spark):
    rng = random.Random(10)
    rows = [(i, rng.choice(["Aa", "aA", "b", "É", "é", None, "", "c d"])) for i in range(300)]
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    for bits in (256, 4):
        for r in exact_dedup.exact_dedup(docs(spark, rows), digest_bits=bits).collect():
            own = groups[low(rows[r["doc_id"]][1])]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))


# 7
def test_quality_on_held_out_rows(spark):
    good = lambda rng: " ".join(rng.choice(["the", "house", "stands", "on", "green", "hills,", "far."]) for _ in range(60))
    bad = lambda rng: " ".join(rng.choice(["BUY!!", "###", "$$$", "NOW!!", "x%%%"]) for _ in range(60))
    d, marks = labelled(spark, good, bad)
    assert accuracy(quality.quality(d, marks).collect(), 0.3, False) >= 0.98


def test_isotonic_is_monotone():
    x, v = quality.isotonic([(0, 10, 1), (1, 10, 5), (2, 10, 3), (3, 10, 9)])
    assert list(v) == sorted(v) and x[0] == 0 and len(v) == 4


# 8, 9
BITS = [" ", "  ", "\n", "\t", "a", "B", "é", "É", "1", "22", "'s", "'LL", "!", "%%", " ", "　", "<|endoftext|>", "<|startoftext|>", "日本", "\x1c", "́", "٣", "²", "​", "😀", "Σ", "İ", "ß", "ﬁ", "ab" * 30, "hello", "the"]


def samples(n):
    rng = random.Random(11)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_word_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = shared.tokenizer_path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    texts = samples(4000)
    for t, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_byte_bpe_equals_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(shared.tokenizer_path("byte_bpe_50k.json")), packing.ByteEncoder()
    for t in samples(4000):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def brute_bins(lengths, capacity):
    bins = []
    for size in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(bins) if r >= size]
        if fits:
            bins[min(fits)[1]] -= size
        else:
            bins.append(capacity - size)
    return len(bins)


def test_histogram_packing_is_best_fit_decreasing():
    rng = random.Random(12)
    for _ in range(150):
        capacity, n = rng.choice([7, 16, 50, 100, 1024]), rng.choice([1, 5, 50, 300])
        lengths = [rng.randint(1, rng.choice([capacity, max(1, capacity // 3)])) for _ in range(n)]
        placed, seen = {}, Counter()
        for size, lo, hi, seq, offset in packing.pack_histogram(Counter(lengths), capacity):
            seen[size] += hi - lo
            for k in range(hi - lo):
                placed.setdefault(seq + k, []).append((offset, size))
        assert seen == Counter(lengths) and len(placed) == brute_bins(lengths, capacity)
        for x in placed.values():
            end = 0
            for offset, size in sorted(x):
                assert offset == end
                end += size
            assert end <= capacity


# 10
def shingles(text, k):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, k, percent):
    own = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in own:
        for j in own:
            both = len(own[i] & own[j])
            if i < j and own[i] and 100 * both >= percent * len(own[i] | own[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(own[i]), find(i)) for i in own}


@pytest.mark.parametrize("options", [{}, {"limit": 4, "depth": 3, "cluster": 40}])
def test_near_dedup(spark, options):
    rng = random.Random(13)
    vocabulary = [f"W{i}" for i in range(900)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([2, 10, 40, 150]))] for _ in range(50)]
    rows = []
    for i in range(420):
        w = list(base[0] if i > 300 else rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(500, None), (501, ""), (502, "a"), (503, "A"), (504, "a b"), (505, " \t ")]
    out = near_dedup.near_dedup(docs(spark, rows), words=3, percent=85, **options).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(rows, 3, 85)


def test_components_of_long_chains_and_hubs(spark):
    rng = random.Random(14)
    chain = [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(1001, 1200)] + [(7, 7)]
    rng.shuffle(chain)
    out = {r["node"]: r["root"] for r in sets.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(out[i] == 100 for i in range(100, 161)) and all(out[i] == 1000 for i in range(1000, 1200)) and 7 not in out


def test_bloom_has_all_its_keys(spark):
    keys = np.random.default_rng(15).integers(-(2**62), 2**62, 3000)
    bloom = sets.Bloom.of(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k", 3000)
    assert bloom.has(keys.view(np.uint64)).all()
    assert bloom.has(np.arange(20_000, dtype=np.uint64)).mean() < 0.05



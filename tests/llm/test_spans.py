"""What the span classifier takes and rejects, and very long texts full of matches."""

import random
import time

from pyspark.sql import functions as F

from quillspark.llm import pii


def test_classifier_rejects_look_alikes(spark):
    """Labelled by hand: secrets and local phone numbers among assignments and digit runs that are neither."""
    rng = random.Random(31)
    letters = "abcdefghjkmnpqrstuvwxyz"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    mixed = lambda n: "".join(rng.choice(letters.upper() + letters + "23456789") for _ in range(n - 2)) + "7q"
    rows = []
    for i in range(400):
        yes = i % 2 == 0
        if i % 4 < 2:
            name = rng.choice(["password", "api_key", "secret", "access-token", "token"]) if yes else rng.choice(["section", "chapter", "theme", "colour", "see"])
            span = f"{name}={mixed(20)}" if yes else f"{name}: {word(9)}"
            rows.append((i, f"{word(5)} {word(7)} login {span} {word(4)}" if yes else f"{word(5)} {span} {word(4)}", yes, span))
        else:
            n = f"{rng.randint(2, 9)}{rng.randint(13, 99)}", f"{rng.randint(23, 98)}5", f"{rng.randint(1000, 9999)}"
            span = f"({n[0]}) {n[1]}-{n[2]}" if yes else f"0{n[0][1:]}1{n[1][1:]}{n[2][0] * 4}"
            rows.append((i, f"{word(6)} call {span} {word(3)}" if yes else f"{word(6)} item {span} {word(3)}", yes, span))
    d = spark.createDataFrame(rows, "doc_id long, text string, yes boolean, span string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(d).collect()}
    right = sum(bool(got[i]) == yes for i, _, yes, _ in rows)
    assert right >= 0.97 * len(rows)
    proposed = d.select(F.size(pii.candidates(F.col("text"))).alias("n")).filter("n > 0").count()
    assert proposed == len(rows)  # the look-alikes were proposed, and votes put them out


def test_very_long_texts_full_of_matches(spark):
    texts = ["1.2.3.4 " * 130_000, "a@b.cd " * 150_000, "token=abcdefgh12 1.2.3.4 " * 40_000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    began = time.perf_counter()
    n = {r["doc_id"]: r["n"] for r in pii.find_pii(d).select("doc_id", F.size("spans").alias("n")).collect()}
    assert n[0] == 130_000 and n[1] == 150_000 and n[2] >= 40_000
    clean = {r["doc_id"]: r["text"] for r in pii.redact(d).collect()}
    assert clean[0] == "[IP] " * 130_000 and clean[1] == "[EMAIL] " * 150_000
    assert time.perf_counter() - began < 120

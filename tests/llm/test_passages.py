"""op4's query shows repeated passages that are too short in bytes to be removed."""

from quillspark.llm import registry


def test_passages_of_short_words(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(60))  # 60 words, fewer than 400 bytes
    rows = [(1, f"one own beginning {passage} and end"), (2, f"another {passage}"), (3, " ".join(f"q{i}" for i in range(70))), (4, " ".join(f"p{i}" for i in range(50)) + " no more"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_removed"], r["n_passages"]) for r in registry.QUERIES["op4_remove_repeats"](spark, str(tmp_path)).collect()}
    assert len(passage) < 400 and got == {1: (0, 1), 2: (0, 1), 3: (0, 0), 4: (0, 0), 5: (0, 0)}

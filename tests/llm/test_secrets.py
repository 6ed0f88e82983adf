"""Secrets of any length are masked whole."""

from pyspark.sql import functions as F

from quillspark.llm import pii


def test_a_long_secret_is_one_span(spark):
    secret = "aB3" * 100_000
    d = spark.createDataFrame([(f"x api_key={secret} y",)], "text string")
    out = d.select(F.explode(pii.matches(F.col("text"), "secret")).alias("s")).select("s.start", "s.end").collect()
    assert [tuple(r) for r in out] == [(2, 2 + len("api_key=") + len(secret))]

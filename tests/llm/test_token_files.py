"""Operator 12: token files against the tokenizers library; encodings, row groups and page indexes of what is written."""

import glob
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillspark.llm import shared, token_files

DATA = "/root/testdata/sf0.001"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(shared.tokenizer_path("word_bpe_49k.json"))


def wanted(rows):
    """(id, start, n, crc) of rows in their order."""
    encoder, start, out = library(), 0, []
    for i, t in rows:
        ids = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def rows_of(df):
    return [tuple(r) for r in df.orderBy("start").collect()]


def test_query_on_given_documents(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = token_files.op12_token_files(spark, DATA)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert rows_of(got) == wanted(sorted((r["doc_id"], r["text"]) for r in d))


@pytest.mark.parametrize("encoding", token_files.ENCODINGS)
def test_edges(spark, tmp_path, encoding):
    rows = [(5, "Five <|endoftext|> five"), (None, "no id"), (3, None), (3, ""), (9, "word " * 60_000), (-4, "Ünï 日本 😀 it's"), (7, "twin"), (7, "twin")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("part", F.lit(1)).withColumn("ids", F.lit(2))
    token_files.write_tokens(d.repartition(3, "doc_id"), str(tmp_path / "t"), encoding=encoding, each=2)
    out = rows_of(token_files.token_digests(token_files.read_tokens(spark, str(tmp_path / "t"))))
    assert [r[0] for r in out] == [None, -4, 3, 3, 5, 7, 7, 9]
    assert out == wanted([(None, "no id"), (-4, rows[5][1]), (3, None), (3, ""), rows[0], rows[6], rows[7], rows[4]])
    token_files.write_tokens(d.limit(0), str(tmp_path / "e"), encoding=encoding)
    assert token_files.read_tokens(spark, str(tmp_path / "e")).collect() == []


def test_one_id_for_all_rows(spark, tmp_path):
    d = spark.range(600).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    token_files.write_tokens(d, str(tmp_path), each=50)
    got = token_files.read_tokens(spark, str(tmp_path))
    assert got.count() == 600
    assert spark.read.parquet(f"{tmp_path}/tokens").groupBy("part").count().agg(F.max("count")).first()[0] < 200
    ends = got.select("start", (F.col("start") + F.col("n_tokens")).alias("end")).orderBy("start").collect()
    assert [r["start"] for r in ends[1:]] == [r["end"] for r in ends[:-1]]


@pytest.mark.parametrize("encoding", token_files.ENCODINGS)
def test_files(spark, tmp_path, encoding):
    """Encodings, row groups and page indexes are as asked for, and a reader of some ids meets few rows."""
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    d = d.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("copy")).withColumn("doc_id", F.col("doc_id") * 100 + F.col("copy"))
    token_files.write_tokens(d, str(tmp_path), encoding=encoding, each=2000, row_group=1 << 18, page=16 << 10, page_rows=50)
    groups = 0
    for f in glob.glob(f"{tmp_path}/tokens/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            groups += 1
            assert all(c.has_offset_index for c in columns.values())
            assert all(columns[c].has_column_index for c in ("id", "n_tokens"))
            assert "DELTA_BINARY_PACKED" in columns["id"].encodings
            assert columns["ids.list.element"].total_uncompressed_size < 4 << 20
            assert ("RLE_DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED") in columns["ids.list.element"].encodings
    assert groups > 4
    few = token_files.read_tokens(spark, str(tmp_path), 500, 519)
    whole = token_files.read_tokens(spark, str(tmp_path))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, whole.filter("id between 500 and 519").collect()))
    plan = whole.select("id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema: ")[1].split(">")[0]
    assert "GreaterThanOrEqual(id,500)" in few._jdf.queryExecution().executedPlan().toString()


def test_unknown_encoding(spark, tmp_path):
    with pytest.raises(ValueError, match="encoding"):
        token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path), encoding="plain")

"""Exact de-duplication by skew-safe combining, in DataFrame operations only.

Copies are dropped inside each map task first (the partial aggregation), then digest groups are merged within a
salt, so that a text which a third of all rows share is spread over many tasks, and last the winners of the salts
are combined. All three stages group by the digest *and* the whole text: equal digests never merge unequal texts.
The way back is salted too: the winner of a digest is copied once for each salt that its rows have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8, digest_bits: int = 256,
    row_col: str | None = None,
) -> DataFrame:
    """One row per input row: id, keep_id (largest id of the equal texts), group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. A null text counts as empty. A null id never wins unless
    all ids of its group are null. Where several rows share the winning id, all of them are marked kept. An empty
    table gives an empty result; other columns are ignored, whatever their names.
    digest_bits may be lowered (tests do) to force digests that collide. salts: at most 63.
    row_col names a column of unique numbers from 0 on: it comes back too, and of the rows that share the winning id
    only the one with the largest number is kept.
    """
    text = shared.ascii_lower(F.col(f"`{text_col}`"))
    row = F.col(f"`{row_col}`").alias("row") if row_col else F.lit(0).alias("row")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), row, text.alias("content"))
    place = shared.place(F.col("id"), F.col("row"), -(2**63) - 1) if row_col else F.col("id")
    sha = F.sha2("content", 256)
    rows = rows.withColumn("sha", sha).withColumn("digest", F.expr(f"left(sha, {digest_bits // 4})"))

    best = lambda c: [F.max(c).alias("best")] if row_col else []
    rows = rows.withColumn("salt", F.pmod(F.hash("id"), F.lit(salts)))
    by_salt = rows.groupBy("digest", "salt", "content").agg(F.max("id").alias("keep"), F.count("*").alias("n"), *best(place))
    own = F.bit_or(F.expr("shiftleft(1L, salt)")).alias("own")  # the salts of a text, as bits
    winners = by_salt.groupBy("digest", "content").agg(F.max("keep").alias("keep"), F.sum("n").alias("n"), own, *best("best"))
    by_digest = shared.stored(
        winners.groupBy("digest").agg(
            F.count("*").alias("texts"), F.max("keep").alias("keep"), F.sum("n").alias("n"), F.bit_or("own").alias("own"), *best("best")
        ),
        "exact-dedup",
    )
    each = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda i: F.getbit("own", i) == 1)
    per_salt = lambda df: df.withColumn("salt", F.explode(each)).drop("own")

    plain = rows.join(per_salt(by_digest.filter("texts = 1")), ["digest", "salt"])
    columns = ["id", "keep", "n", "sha", *(["row", "best"] if row_col else [])]
    out = plain.select(*columns)
    if not by_digest.filter("texts > 1").isEmpty():  # a digest of several texts: match by the texts themselves
        again = winners.join(by_digest.filter("texts > 1").select("digest"), "digest", "left_semi")
        out = out.unionByName(rows.join(per_salt(again), ["digest", "salt", "content"]).select(*columns))
    return out.select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        (place == F.col("best") if row_col else F.col("id").eqNullSafe(F.col("keep"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup(shared.table(spark, sf_dir, "documents"))


OP6_SQL = """
with n as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as content
  from documents)
select doc_id, max(doc_id) over (partition by content) as keep_id, count(*) over (partition by content) as group_size,
       doc_id = max(doc_id) over (partition by content) as kept, sha256(content) as text_sha256
from n
"""

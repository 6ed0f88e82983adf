"""A training-data pipeline over `documents`: five stages, each applying one operator to all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, near_dedup, packing, pii, quality, shared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
QUALITY_LEAST = 0.3


def plain_scan(docs: DataFrame) -> bool:
    """Whether each row of docs is another row of a file: files without more than filters and columns on top. A join,
    union or explode can show one row of a file several times, and so can a folder that is named twice."""
    plan = docs._jdf.queryExecution().analyzed()
    while not plan.children().isEmpty():
        if plan.nodeName() not in ("Project", "Filter", "SubqueryAlias"):
            return False
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation" or not hasattr(plan.relation(), "location"):
        return False
    roots = plan.relation().location().rootPaths()
    roots = [roots.apply(i).toString() for i in range(roots.size())]
    return not any(x == y or x.startswith(y.rstrip("/") + "/") for i, x in enumerate(roots) for j, y in enumerate(roots) if i != j)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a unique number of each row, from 0 on, the same whenever a row is read.

    Where docs are files, as between stages, it is made of the file's number and the row's place in the file; other
    tables (joins, unions, exploded rows) are stored with their numbers.
    """
    if not plain_scan(docs):
        return shared.stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "pipeline-rows")
    placed = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    names = placed.select("file").distinct()
    files = shared.stored(names.withColumn("no", F.row_number().over(Window.orderBy("file")).cast("long")), "pipeline-files")  # a row for each file
    files = F.broadcast(files) if files.count() <= 100_000 else files
    return placed.join(files, "file").select(*COLUMNS, (F.col("no") * F.lit(2**36) + F.col("at")).alias("row"))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents of numbered rows but for those whose number is among gone."""
    return rows.join(gone.select("row"), "row", "left_anti").select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below QUALITY_LEAST go. It learns from the labels of those given."""
    rows = numbered(docs)
    scores = quality.quality(rows, shared.table(spark, sf_dir, "labels"), row_col="row")
    return without(rows, scores.filter(F.col("score") < QUALITY_LEAST))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the document with the largest doc_id stays, one of those that share it."""
    rows = numbered(docs)
    return without(rows, exact_dedup.exact_dedup(rows, row_col="row").filter(~F.col("kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the one with the least doc_id stays, one of
    those that share it."""
    rows = numbered(docs)
    return without(rows, near_dedup.near_dedup(rows, row_col="row").filter(~F.col("kept")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind in brackets; n_chars follows. All documents stay."""
    masked = pii.redact(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, with the sequence and place that each goes to."""
    return packing.best_fit_pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack),
]

ORACLE_SQL = None  # a kernel classifier, similarity joins and tokenizers are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

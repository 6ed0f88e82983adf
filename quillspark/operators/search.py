"""Weighted token search over papers: match, relevance, order, page, trigram narrowing, BM25, external scores."""

from __future__ import annotations

import re
from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import predicates as P
from . import grams

RUN_BYTES = 8 << 20  # of a row group of postings
WEIGHTS = {"title": 3, "authors_text": 2, "abstract": 1}
FIELDS: dict[str, list[str]] = {"title": ["title", "abstract"], "author": ["authors_text"], "abstract": ["abstract"], "any": list(WEIGHTS)}


def token_match(query: str, field: str = "title") -> Column:
    """Every token is a substring of one and the same enabled field."""
    words = C.tokens(query)
    if not words or query.strip() == "#":
        return F.lit(True)
    return P.any_true(P.all_true(C.normalise_text(F.col(c)).contains(w) for w in words) for c in FIELDS[field])


def relevance(query: str, field: str = "title") -> Column:
    """S3: sum over fields of matched tokens times the field's weight; 0 without a query."""
    words = C.tokens(query)
    if not words or query.strip() == "#":
        return F.lit(0)
    parts = [F.when(C.normalise_text(F.col(c)).contains(w), WEIGHTS[c]).otherwise(0) for c in FIELDS[field] for w in dict.fromkeys(words)]
    return reduce(add, parts)


def order_keys(query: str = "", sort: str = "year", descending: bool = True) -> list[Column]:
    """Relevance, the chosen key (ASCII case ignored), BM25 (where a word is long enough for the index), id."""
    key = F.col("year") if sort == "year" else F.lower(F.col(sort))
    first = [F.desc("score")] if C.tokens(query) else []
    then = [F.desc("bm25")] if eligible(query) else []
    return [*first, key.desc() if descending else key.asc(), *then, F.asc("id")]


def search(
    papers: DataFrame, query: str = "", field: str = "title", sort: str = "year", descending: bool = True, page: int = 1, size: int = 20,
    index: GramIndex | None = None, **filters,
) -> tuple[DataFrame, DataFrame]:
    """(the page with rank and score, one row with the total of matches). With an index (S8) candidates and BM25
    come from its postings; without one the table itself is counted for BM25, and only where a page is asked for."""
    matches = token_match(query, field) & P.search_filter(**filters)
    author = filters.get("author") or ""
    rows = papers
    if index is not None and (ids := gram_candidates(index.postings, query, field, author)) is not None:
        rows = papers.join(ids, "id", "left_semi")
    found = rows.filter(matches)
    if not eligible(query):
        ranked = found.withColumn("bm25", F.lit(0.0))
    elif index is None:
        ranked = with_bm25(found, query, field, author, corpus=papers)
    else:
        ranked = found.join(bm25_of_index(index, query, field, author), "id", "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    ranked = ranked.withColumn("score", relevance(query, field))
    keys = order_keys(query, sort, descending)
    top = ranked.orderBy(*keys).offset((page - 1) * size).limit(size)
    # numbered after the limit, so the single task holds one page
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys)) + (page - 1) * size
    return top.withColumn("rank", rank), found.agg(F.count("*").alias("total"))


def sorted_results(df: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Year, conf (then newest first) or title."""
    key = F.lower(F.col(by)) if by != "year" else F.col("year")
    then = [F.desc("year")] if by == "conf" else []
    return df.orderBy(key.desc() if descending else key.asc(), *then, "id")


def union_legs(legs: list[DataFrame], cap: int = 5000) -> tuple[DataFrame, DataFrame]:
    """Legs merged by id, newest first, the first `cap` rows (a display limit); and one row (n, truncated)."""
    both = reduce(DataFrame.unionByName, legs).dropDuplicates(["id"])
    return both.orderBy(F.desc("year"), "id").limit(cap), both.agg(F.count("*").alias("n"), (F.count("*") > cap).alias("truncated"))


def eligible(query: str) -> list[str]:
    """Words of a query that trigrams can find, repeats included."""
    return [w for w in C.tokens(query) if len(w) >= 3 and query.strip() != "#"]


def grams_of(word: str) -> list[str]:
    return sorted({word[i : i + 3] for i in range(len(word) - 2)})


class GramIndex(NamedTuple):
    """postings(gram, field, id, positions), and one row (n, total) with the numbers of papers and of trigrams;
    lengths(id, size) has the trigrams of each paper."""

    postings: DataFrame
    lengths: DataFrame
    totals: DataFrame


def index_text(c: Column) -> Column:
    """What is indexed of a field: white space collapsed, lower case, hyphens as spaces (which then are not collapsed)."""
    return F.translate(F.lower(F.trim(F.regexp_replace(C.text(c), r"\s+", " "))), "-", " ")


def gram_count(c: Column) -> Column:
    return F.greatest(F.length(c) - 2, F.lit(0))


def indexed_texts(papers: DataFrame) -> DataFrame:
    """id and what is indexed of each field, under its name."""
    return papers.select("id", *(index_text(F.col(c)).alias(c) for c in WEIGHTS))


def build_gram_index(papers: DataFrame) -> DataFrame:
    """(gram, field, id, positions) of the trigrams of the indexed title, abstract and authors of papers, whose ids
    differ. Each task groups its own papers' trigrams; nothing is shuffled."""
    return index_of_texts(indexed_texts(papers)).postings


def index_of_texts(texts: DataFrame) -> GramIndex:
    sizes = texts.select("id", reduce(add, (gram_count(F.col(c)) for c in WEIGHTS)).cast("long").alias("size"))
    return GramIndex(texts.mapInArrow(grams.of_batches, grams.SCHEMA), sizes, sizes.agg(F.count("*").alias("n"), F.sum("size").alias("total")))


def gram_index(papers: DataFrame) -> GramIndex:
    return index_of_texts(indexed_texts(papers))


def write_gram_index(papers: DataFrame, path: str) -> None:
    """Write the index. Each task writes the postings of its own papers in runs ordered by (gram, field, id), with row
    groups of about a run, so that a query reads the pages of its grams and no file holds all of a gram that every paper
    has. The indexed texts are stored meanwhile, as papers are read twice."""
    from ..sources.records import remove

    spark, texts = papers.sparkSession, indexed_texts(papers)
    texts.write.parquet(f"{path}/texts")
    index = index_of_texts(spark.read.schema(texts.schema).parquet(f"{path}/texts"))
    index.lengths.write.parquet(f"{path}/lengths")
    index.postings.write.option("parquet.block.size", RUN_BYTES).parquet(f"{path}/postings")
    lengths = spark.read.schema(index.lengths.schema).parquet(f"{path}/lengths")
    lengths.agg(F.count("*").alias("n"), F.sum("size").alias("total")).write.parquet(f"{path}/totals")
    remove(spark, f"{path}/texts")


def read_gram_index(spark: SparkSession, path: str) -> GramIndex:
    kinds = {"postings": "gram string, field string, id string, positions array<int>", "lengths": "id string, size long", "totals": "n long, total long"}
    return GramIndex(*(spark.read.schema(kinds[k]).parquet(f"{path}/{k}") for k in GramIndex._fields))


def gram_candidates(postings: DataFrame, query: str = "", field: str = "title", author: str = "") -> DataFrame | None:
    """Ids in which one and the same enabled field holds all grams of every word of 3 characters or more. The author
    filter holds if any of its words does, so it narrows only if all of them are long enough. None if nothing narrows."""
    ids = None
    if words := dict.fromkeys(eligible(query)):
        grams = sorted({g for w in words for g in grams_of(w)})
        some = postings.filter(F.col("gram").isin(grams) & F.col("field").isin(FIELDS[field]))  # reaches the range-clustered files
        found = some.groupBy("id", "field").agg(F.count("gram").alias("n")).filter(F.col("n") == len(grams))  # a row for each gram
        ids = found.select("id").distinct()
    names = list(dict.fromkeys(C.tokens(author)))
    if names and all(len(w) >= 3 for w in names):
        some = postings.filter(F.col("gram").isin(sorted({g for w in names for g in grams_of(w)})) & (F.col("field") == "authors_text"))
        whole = P.any_true(F.count_distinct(F.when(F.col("gram").isin(grams_of(w)), F.col("gram"))) == len(grams_of(w)) for w in names)
        found = some.groupBy("id").agg(whole.alias("any")).filter("any").select("id")
        ids = found if ids is None else ids.join(found, "id", "left_semi")
    return ids


def narrowed_search(papers: DataFrame, postings: DataFrame, query: str, field: str = "title", author: str = "") -> DataFrame:
    """S9 then S2: candidates by grams, verified by the exact match."""
    ids = gram_candidates(postings, query, field, author)
    rows = papers if ids is None else papers.join(ids, "id", "left_semi")
    return rows.filter(token_match(query, field) & P.search_filter(author=author))


def phrases(query: str, field: str, author: str = "") -> list[tuple[str, str, bool]]:
    """(column, word, whether it is of the author filter) of each phrase that BM25 counts. The filter takes part if all
    of its words are long enough."""
    names = C.tokens(author)
    own = [(c, w, False) for c in FIELDS[field] for w in eligible(query)]
    return own + [("authors_text", w, True) for w in names if all(len(x) >= 3 for x in names)]


def occurrences(text: Column, word: str) -> Column:
    """How often the word stands in a text, inside words and overlapping itself too."""
    quoted = re.sub(r"(\W)", r"\\\1", word)
    return F.regexp_count(text, F.lit(f"(?={quoted})"))


def phrase_score(hits: Column, weight: int, rows_with: Column, size: Column, n: Column, total: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """BM25 of one phrase; hits are weighted by their column, a phrase that most rows have still counts a little."""
    idf = F.log((n - rows_with + 0.5) / (rows_with + 0.5))
    often = hits * float(weight)
    return F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * often * (k1 + 1) / (often + k1 * (1 - b + b * size * n / total))


def summed(parts: list[tuple[str, bool, Column, Column]]) -> Column:
    """Sum of (column, of the author filter, hits, score): the query's phrases of a column count where all are there."""
    whole = {c: P.all_true(h > 0 for d, a, h, _ in parts if d == c and not a) for c in {c for c, a, _, _ in parts if not a}}
    each = [F.when((h > 0) if a else whole[c], score).otherwise(0.0) for c, a, h, score in parts]
    return F.round(reduce(add, each, F.lit(0.0)), 12)


def with_bm25(papers: DataFrame, query: str, field: str = "title", author: str = "", corpus: DataFrame | None = None) -> DataFrame:
    """papers and their bm25 (S10), counted in the texts themselves: over substring phrases of the enabled columns,
    weighted 3, 2 and 1, with document frequencies and lengths of the whole corpus (default: papers)."""
    wanted = phrases(query, field, author)
    if not wanted:
        return papers.withColumn("bm25", F.lit(0.0))
    corpus = papers if corpus is None else corpus
    texts = {c: index_text(F.col(c)) for c in WEIGHTS}
    keys = list(dict.fromkeys((c, w) for c, w, _ in wanted))
    plain = corpus.select(*(t.alias(c) for c, t in texts.items()))
    stats = plain.agg(
        F.count("*").alias("_n"), F.sum(reduce(add, (gram_count(F.col(c)) for c in texts))).alias("_total"),
        *(F.count_if(F.col(c).contains(w)).alias(f"_d{i}") for i, (c, w) in enumerate(keys)),
    )
    size = reduce(add, (gram_count(t) for t in texts.values()))
    rows = papers.withColumns({"_size": size, **{f"_h{i}": occurrences(texts[c], w) for i, (c, w) in enumerate(keys)}})
    both = rows.crossJoin(F.broadcast(stats))  # one row of totals
    parts = []
    for c, w, a in wanted:
        i = keys.index((c, w))
        score = phrase_score(F.col(f"_h{i}"), WEIGHTS[c], F.col(f"_d{i}"), F.col("_size"), F.col("_n"), F.col("_total"))
        parts.append((c, a, F.col(f"_h{i}"), score))
    return both.select(*papers.columns, summed(parts).alias("bm25"))


def phrase_hits(postings: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """(id, field, h0, h1, ...): how often the word of each (field, word) stands in the field, from the positions of its
    trigrams; only rows of a field that holds a trigram of its words."""
    grams = sorted({g for _, w in keys for g in grams_of(w)})
    fields = sorted({c for c, _ in keys})
    some = postings.filter(F.col("gram").isin(grams) & F.col("field").isin(fields))
    held = some.groupBy("id", "field").agg(*(F.first(F.when(F.col("gram") == g, F.col("positions")), ignorenulls=True).alias(f"g{i}") for i, g in enumerate(grams)))

    def hits(c: str, w: str) -> Column:
        shifted = lambda g, by: F.transform(f"g{grams.index(g)}", lambda p: p - by)
        starts = [shifted(w[j : j + 3], j) for j in range(len(w) - 2)]
        return F.when(F.col("field") == c, F.coalesce(F.size(reduce(F.array_intersect, starts)), F.lit(0))).otherwise(0)

    # a missing trigram makes the intersection null, whose size is null or -1
    return held.select("id", "field", *(F.greatest(hits(c, w), F.lit(0)).alias(f"h{i}") for i, (c, w) in enumerate(keys)))


def bm25_of_index(index: GramIndex, query: str, field: str = "title", author: str = "") -> DataFrame:
    """S10 from an index: (id, bm25) of the papers in which a phrase counts. It reads the postings of the query's own
    trigrams, and the lengths of the papers that hold them."""
    wanted = phrases(query, field, author)
    keys = list(dict.fromkeys((c, w) for c, w, _ in wanted))
    if not keys:
        return index.lengths.select("id", F.lit(0.0).alias("bm25")).limit(0)
    hits = phrase_hits(index.postings, keys)
    by_id = hits.groupBy("id").agg(*(F.sum(f"h{i}").alias(f"h{i}") for i in range(len(keys))))
    stats = hits.agg(*(F.count_if(F.col(f"h{i}") > 0).alias(f"d{i}") for i in range(len(keys))))
    both = by_id.join(index.lengths, "id").crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(index.totals))  # a row each
    parts = []
    for c, w, a in wanted:
        i = keys.index((c, w))
        parts.append((c, a, F.col(f"h{i}"), phrase_score(F.col(f"h{i}"), WEIGHTS[c], F.col(f"d{i}"), F.col("size"), F.col("n"), F.col("total"))))
    return both.select("id", summed(parts).alias("bm25")).filter("bm25 > 0")


def bm25(papers: DataFrame, query: str, field: str = "title", author: str = "") -> DataFrame:
    """S10 without an index: (id, bm25) of the papers in which a phrase counts."""
    return with_bm25(papers.select("id", *WEIGHTS), query, field, author).select("id", "bm25").filter("bm25 > 0")


def get_by_ids(papers: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows in request order, each id once; and the ids that are unknown."""
    asked = papers.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(ids))), "pos int, id string")
    joined = F.broadcast(asked).join(papers.withColumn("known", F.lit(True)), "id", "left") if len(ids) <= 10_000 else asked.join(papers.withColumn("known", F.lit(True)), "id", "left")
    return joined.filter("known").drop("known").orderBy("pos"), joined.filter("known is null").select("pos", "id")


def places_by_range(df: DataFrame, keys: list[Column], path: str) -> DataFrame:
    """df with `place`, its number from 1 on in the order of the keys, without a task that holds all: rows are written to
    path in ranges of the keys, numbered inside each range and moved by the ranges before it."""
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_own", F.monotonically_increasing_id() % (1 << 33))
    ranged.write.parquet(path)
    rows = df.sparkSession.read.schema(ranged.schema).parquet(path)
    n = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    moved = rows.join(F.broadcast(n.select("_part", before.alias("_before"))), "_part")
    return moved.withColumn("place", F.col("_before") + F.col("_own") + 1).drop("_part", "_own", "_before")


def apply_scores(df: DataFrame, scores: DataFrame, path: str | None = None) -> DataFrame:
    """df(id, pos) with a relevance 0..1 from scores(paper_id, score) on scales 0-1, 0-10 or 0-100.

    Negative scores count as 0; scores over 100 and NaN are dropped. Scored rows come first, the rest keep their order at
    0.5. df may be one result page, or with a path for places_by_range() a table of any size.
    """
    s = F.col("score")
    unit = F.when(s < 0, 0.0).when(s <= 1, s).when(s <= 10, s / 10).when(s <= 100, s / 100)
    usable = scores.filter(s.isNotNull() & ~F.isnan(s) & (s <= 100)).groupBy(F.col("paper_id").alias("id")).agg(F.max(unit).alias("unit"))
    out = df.join(usable, "id", "left")
    keys = [F.col("unit").isNull().asc(), F.desc("unit"), F.asc("pos")]
    placed = places_by_range(out, keys, path) if path else out.withColumn("place", F.row_number().over(Window.orderBy(*keys)))
    return placed.withColumn("relevance", F.coalesce("unit", F.lit(0.5))).drop("unit")

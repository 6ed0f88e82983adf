"""De-duplication and merging of paper records, all as associative aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import predicates as P

FIELDS = ["paper_name", "paper_url", "paper_abstract", "paper_authors", "paper_code"]


def materialise_papers(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I4: (search form, one row with the counts): rows whose conf has no year are skipped, the first of each id kept."""
    series, year = C.search_parts(F.col("conf"))
    key = F.concat_ws("|", series, year.cast("string"), C.text("paper_name"))
    rows = raw.withColumn("year", year).withColumn("series", series).withColumn("id", F.left(F.sha1(key), F.lit(16)))
    dated = rows.filter(F.col("year").isNotNull())
    first = dated.groupBy("id").agg(F.min_by(F.struct("series", "year", *FIELDS, "seq"), "seq").alias("r")).select("id", "r.*")
    papers = first.select(
        "id", F.col("series").alias("conf"), "year", C.text("paper_name").alias("title"), C.text("paper_url").alias("url"),
        F.coalesce("paper_authors", F.array().cast("array<string>")).alias("authors"), F.concat_ws(" ", "paper_authors").alias("authors_text"),
        C.text("paper_abstract").alias("abstract"), C.text("paper_code").alias("code"), "seq",
    )
    counts = rows.agg(
        F.count("*").alias("rows"), F.count_if(F.col("year").isNull()).alias("no_year"),
        (F.count_if(F.col("year").isNotNull()) - F.count_distinct(F.when(F.col("year").isNotNull(), F.col("id")))).alias("duplicates"),
    )
    return papers, counts


def merged_columns(*order: str) -> dict[str, Column]:
    """D1 as aggregates by name: title and url of the first row, longest abstract and author list (the earlier wins ties),
    first real code link, else the first non-empty code, else '#'. A group of one row is left as it is. Rows come in the
    order of the given columns (seq, if none is; without it the first place of all of them is the group's seq)."""
    order = order or ("seq",)
    o = F.struct(*order)
    alone = F.count("*") == 1
    longest = lambda c, size: F.max_by(c, F.struct(size, *(-F.col(x) for x in order)))
    code, abstract = F.trim(C.text("paper_code")), C.text("paper_abstract")
    authors = F.coalesce("paper_authors", F.array().cast("array<string>"))
    best = F.coalesce(F.min_by(code, F.when(P.has_code(F.col("paper_code")), o)), F.min_by(code, F.when(code != "", o)), F.lit("#"))
    one = lambda c: F.min_by(c, o)
    return {
        "paper_name": one("paper_name"),
        "paper_url": one("paper_url"),
        "paper_abstract": F.when(alone, one("paper_abstract")).otherwise(longest(abstract, F.length(abstract))),
        "paper_authors": F.when(alone, one("paper_authors")).otherwise(longest(authors, F.size(authors))),
        "paper_code": F.when(alone, one("paper_code")).otherwise(best),
        "seq": F.min(o)["seq"] if "seq" in order else F.min(o),
        "merged_rows": F.count("*"),
    }


def merged(*order: str) -> list[Column]:
    """merged_columns() under their names."""
    return [c.alias(name) for name, c in merged_columns(*order).items()]


RUN = 100_000  # values of seq in a run


def folds_before(rows: DataFrame, keys: list[str], sums: dict[str, Column], most: dict[str, Column], run: int = RUN) -> DataFrame:
    """rows and, under the names of `sums` and `most`, the sum or maximum of a column over the rows of the same key with a
    smaller seq (0 or null where there are none).

    A key's rows are parted into runs of seq, so that no task holds more than a run of them: each run is summed up
    (both folds are associative), the sums are carried over the runs of the key, and inside a run rows are folded in
    order. A run has at most `run` rows, as seq numbers the rows of a table.
    """
    folds = {n: (c, F.sum) for n, c in sums.items()} | {n: (c, F.max) for n, c in most.items()}
    rows = rows.withColumn("_run", F.floor(F.col("seq") / run)).withColumns({f"_{n}": c for n, (c, _) in folds.items()})
    whole = rows.groupBy(*keys, "_run").agg(*(f(f"_{n}").alias(f"_w_{n}") for n, (_, f) in folds.items()))
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each run
    carried = whole.select(*keys, "_run", *(f(f"_w_{n}").over(before).alias(f"_c_{n}") for n, (_, f) in folds.items()))
    inside = Window.partitionBy(*keys, "_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({f"_o_{n}": f(f"_{n}").over(inside) for n, (_, f) in folds.items()}).join(carried, [*keys, "_run"])
    both = {n: F.coalesce(f"_o_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0)) if n in sums else F.greatest(f"_o_{n}", f"_c_{n}") for n in folds}
    return own.withColumns(both).drop("_run", *(f"{x}{n}" for n in folds for x in ("_", "_o_", "_c_")))


def merge_fields(df: DataFrame, keys: list[str]) -> DataFrame:
    """D1 over groups of equal keys (null equals null)."""
    return df.groupBy(*keys).agg(*merged())


def clean_key() -> Column:
    """(url) else (lower, trimmed title), for rows with a conf."""
    url = F.trim(C.text("paper_url"))
    return F.when(url != "", F.concat(F.lit("u:"), url)).otherwise(F.concat(F.lit("t:"), F.lower(F.trim(C.text("paper_name")))))


def dedupe_clean(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, one row of counters). Rows without a conf pass untouched.

    Counters follow the fold over seq: rows saved, merges that gave an empty abstract its first text (rescued), a
    longer one (upgraded), a first real code link, a longer author list.
    """
    rows = df.withColumn("k", clean_key())
    keyed = rows.filter(F.trim(C.text("conf")) != "")
    kept = keyed.groupBy("conf", "k").agg(*merged()).select("conf", *FIELDS, "seq")
    size, n = F.length(C.text("paper_abstract")), F.size(F.coalesce("paper_authors", F.array().cast("array<string>")))
    each = keyed.select("conf", "k", "seq", size.alias("size"), n.alias("n"), P.has_code(F.col("paper_code")).cast("int").alias("real"))
    seen = folds_before(each, ["conf", "k"], {"earlier": F.lit(1)}, {"best": F.col("size"), "most": F.col("n"), "had": F.col("real")})
    seen = seen.filter("earlier > 0")
    stats = seen.agg(
        F.count("*").alias("rows_saved"),
        F.count_if((F.col("best") == 0) & (F.col("size") > 0)).alias("abstract_rescued"),
        F.count_if((F.col("best") > 0) & (F.col("size") > F.col("best"))).alias("abstract_upgraded"),
        F.count_if((F.col("had") == 0) & (F.col("real") == 1)).alias("code_upgraded"),
        F.count_if(F.col("n") > F.col("most")).alias("authors_extended"),
    )
    loose = rows.filter(F.trim(C.text("conf")) == "").select("conf", *FIELDS, "seq")
    return kept.unionByName(loose), stats


def merge_incremental(new: DataFrame, old: DataFrame) -> DataFrame:
    """D3: confs absent from `new` are copied; else old rows merge into new ones by url, and those without url are added.

    Front matter is dropped on the new side only; new rows come before old ones.
    """
    return merge_cleaned(P.drop_on_collect(new), old)


def merge_cleaned(new: DataFrame, old: DataFrame) -> DataFrame:
    """D3 for new rows without front matter. They are read three times."""
    fresh = new.select("conf", *FIELDS, "seq").withColumn("side", F.lit(0))
    touched = fresh.select("conf").distinct()
    cached = old.select("conf", *FIELDS, "seq").withColumn("side", F.lit(1))
    both = fresh.unionByName(cached.join(touched, "conf", "left_semi"))
    linked = F.trim(C.text("paper_url")) != ""
    byurl = both.filter(linked).withColumn("u", F.col("paper_url")).groupBy("conf", "u").agg(*merged("side", "seq"))
    out = byurl.select("conf", *FIELDS, "seq")
    return out.unionByName(both.filter(~linked).select("conf", *FIELDS, "seq")).unionByName(
        cached.join(touched, "conf", "left_anti").select("conf", *FIELDS, "seq")
    )


def merge_official(records: DataFrame, official: DataFrame, mode: str = "cvf") -> DataFrame:
    """Official rows merged into the records of a conf, by canonical url first, then by a title key that is unique
    among the official rows (prefer a DOI url, then the official one). Mode ijcai also asks that surnames overlap or one
    side has none, and that both urls are pages of its papers; modes miccai and ascii keep their own title keys. Rows of `official`
    that match nothing are added."""
    a = records.select("conf", *FIELDS, "seq").withColumn("side", F.lit(0))
    b = official.select("conf", *FIELDS, "seq").withColumn("side", F.lit(1))
    row = F.concat_ws(":", F.lit("row"), F.col("side").cast("string"), F.col("seq").cast("string"))
    both = a.unionByName(b).withColumn("u", F.coalesce(F.nullif(C.normalise_url(F.col("paper_url")), F.lit("")), row))
    first = both.groupBy("conf", "u").agg(
        *merged("side", "seq"), F.min("side").alias("side"), F.max("side").alias("official"), F.max_by("paper_url", "side").alias("official_url")
    )
    keyed = first.withColumn("t", C.title_key(F.col("paper_name"), mode))
    names = C.author_surnames(F.col("paper_authors"))
    allowed = C.is_ijcai_url(F.col("paper_url")) if mode == "ijcai" else F.lit(True)
    # untitled rows merge by url alone, and so need not meet
    same_title = Window.partitionBy("conf", F.when(F.col("t") != "", F.col("t")).otherwise(F.col("u")))
    unique = F.sum("official").over(same_title) == 1
    keyed = keyed.withColumn("names", names if mode == "ijcai" else F.array().cast("array<string>")).withColumn("ok", unique & allowed & (F.col("t") != ""))
    theirs = F.max_by("names", "official").over(same_title)
    fits = (F.size("names") == 0) | (F.size(theirs) == 0) | F.arrays_overlap("names", theirs)
    group = F.when(F.col("ok") & fits, F.concat(F.lit("t:"), F.col("t"))).otherwise(F.concat(F.lit("u:"), F.col("u")))
    keyed = keyed.withColumn("g", group)
    doi = F.max(F.when(C.netloc(F.col("paper_url")).rlike(r"(^|\.)doi\.org$"), F.col("paper_url")))
    pick = F.coalesce(doi, F.max(F.when(F.col("official") == 1, F.col("official_url"))), F.min_by("paper_url", F.struct("side", "seq")))
    out = keyed.groupBy("conf", "g").agg(*merged("side", "seq"), pick.alias("best_url"), F.count("*").alias("sides"))
    return out.withColumn("paper_url", F.when(F.col("sides") > 1, F.col("best_url")).otherwise(F.col("paper_url"))).select("conf", *FIELDS, "seq")


def sync_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per conf rows before and after, added and removed, changed, and abstract coverage."""
    filled = F.count_if(F.trim(C.text("paper_abstract")) != "")
    sums = lambda df, s: df.groupBy("conf").agg(F.count("*").alias(f"rows_{s}"), filled.alias(f"filled_{s}"))
    both = sums(before, "before").join(sums(after, "after"), "conf", "full").fillna(0)
    diff = F.col("rows_after") - F.col("rows_before")
    return both.withColumn("added", F.greatest(diff, F.lit(0))).withColumn("removed", F.greatest(-diff, F.lit(0))).withColumn(
        "changed", (diff != 0) | (F.col("filled_after") != F.col("filled_before"))
    )


def official_titles(before: DataFrame, official: DataFrame) -> DataFrame:
    """Per conf of the official rows, how many titles are known already (matched) and how many are new."""
    key = C.title_key(F.col("paper_name"), "miccai")
    known = before.select("conf", key.alias("t")).distinct().withColumn("known", F.lit(True))
    rows = official.select("conf", key.alias("t")).filter("t <> ''").join(known, ["conf", "t"], "left")
    return rows.groupBy("conf").agg(F.count("known").alias("matched"), F.count_if(F.col("known").isNull()).alias("new"))


def catalog_merge(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Catalog rows (name, url, pos) with unseen urls added; `place` orders an added row after its name, else by year
    inside its series, else at the end."""
    added = new.dropDuplicates(["url"]).join(existing.select("url"), "url", "left_anti")
    series = F.regexp_replace("name", "[0-9]{4}$", "")
    year = F.regexp_extract("name", "([0-9]{4})$", 1).try_cast("int")
    both = existing.withColumn("is_new", F.lit(0)).unionByName(added.select("name", "url", "pos").withColumn("is_new", F.lit(1)))
    both = both.withColumn("series", series).withColumn("year", year)
    old_pos = F.when(F.col("is_new") == 0, F.col("pos"))
    anchor = F.coalesce(
        F.max(old_pos).over(Window.partitionBy("name")),
        F.max(old_pos).over(Window.partitionBy("series").orderBy("year").rangeBetween(Window.unboundedPreceding, 0)),
        F.min(old_pos).over(Window.partitionBy("series")) - 1,
        F.lit(1 << 40),
    )
    return both.withColumn("place", F.struct(F.when(F.col("is_new") == 0, F.col("pos")).otherwise(anchor).alias("a"), "is_new", F.col("year").alias("y"), "url"))


def catalog_key(url: Column) -> Column:
    """Mirrors are compared by path; scheme and trailing slash don't count."""
    return F.lower(F.regexp_replace(C.path_of(url), "/+$", ""))


def catalog_new(discovered: DataFrame, existing: DataFrame, first: int, last: int, series: list[str] | None = None) -> DataFrame:
    """Discovered rows (name, url) in the year window and of the series, once per key, that are not yet known."""
    year = F.regexp_extract("name", "([0-9]{4})$", 1).try_cast("int")
    own = discovered.filter(year.between(first, last))
    if series:
        own = own.filter(F.regexp_replace("name", "[0-9]{4}$", "").isin(series))
    own = own.withColumn("k", catalog_key(F.col("url"))).groupBy("k").agg(F.min_by(F.struct("name", "url"), F.struct("name", "url")).alias("r"))
    return own.join(existing.select(catalog_key(F.col("url")).alias("k")).distinct(), "k", "left_anti").select("r.*")


def dominant_id_prefix(ids: DataFrame) -> DataFrame:
    """(event, tag) from ids(event, venue, year, id): `year.venue` where modern ids of the venue and year occur, else
    the most frequent old prefix (workshop ones, with W, only if there is no other), else a tag by rule."""
    modern = F.regexp_extract("id", r"^([0-9]{4})\.([a-z0-9]+)", 0)
    own = F.col("id").rlike(r"^[0-9]{4}\.") & (F.regexp_extract("id", r"^([0-9]{4})\.", 1) == F.col("year").cast("string")) & F.regexp_extract("id", r"^[0-9]{4}\.([a-z0-9]+)", 1).startswith(F.lower("venue"))
    old = F.nullif(F.regexp_extract("id", r"^([A-Z][0-9]{2})-", 1), F.lit(""))
    n = ids.select("event", "venue", "year", F.when(own, modern).alias("modern"), old.alias("old"))
    by = n.groupBy("event", "venue", "year", "old").agg(F.count("*").alias("c"), F.max("modern").alias("modern"))
    rank = F.when(F.col("old").isNotNull(), F.struct(~F.col("old").startswith("W"), "c", F.col("old").alias("o")))
    out = by.groupBy("event", "venue", "year").agg(F.max("modern").alias("modern"), F.max_by("old", rank).alias("old"))
    ruled = F.concat_ws(".", F.col("year").cast("string"), F.lower("venue"))
    return out.select("event", F.when(F.col("modern").isNotNull(), ruled).otherwise(F.coalesce("old", ruled)).alias("tag"))

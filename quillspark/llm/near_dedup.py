"""MinHash near-de-duplication by a chosen-path set similarity join.

Texts become sets of word shingles; equal sets form one class. Independent trees branch the classes: at a node with
path p one of the minwise tokens is chosen by a hash of p, and a class goes to the child that its own token names. A
pair survives a level with a chance that grows with its similarity, so unlike sets part soon. Nodes of at most `limit` classes are compared exhaustively on sketches. In larger ones a few classes are heads:
what is near to a head is joined to it and leaves the tree, the rest branches on; after `depth` levels what still
shares a node is taken together as it is. What the trees join are only candidate clusters: inside each, links are
confirmed on the full sets, and pairs already known to be connected are skipped. So `limit`, `heads`, `depth` and
`cluster` decide how a candidate is found or where it is compared, never whether a link is kept.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, shared
from .sets import Bloom, components, shingle_sets

TOKENS = 64  # minwise tokens of a set
FACTORS = np.random.default_rng(17).integers(1, 2**62, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MARGIN = 0.25  # sketches may fall short of the threshold by this much (5 deviations or more at 64 tokens and 0.8)
SHARE = 500  # classes of a large node that one task holds against its heads, about
HOT_ROWS, MOST_HOT = 100_000, 50_000  # rows of one set that are very many, and how many sets can have so many
CLUSTER = 2048  # classes of a candidate cluster that one task compares; larger ones go by pairs of blocks


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128-bit key of a set, as two signed integers: sums of two independent hashes of its members."""
    sums = [hashing.mix(s).sum(dtype=np.uint64), hashing.mix(s * FACTORS[0] + FACTORS[1]).sum(dtype=np.uint64)]
    one, two = hashing.mix(np.array(sums, np.uint64) + np.uint64(len(s))).view(np.int64)
    return int(one), int(two)


def minwise(s: np.ndarray) -> np.ndarray:
    """The set's minwise tokens, 32 bits each."""
    out = np.full(TOKENS, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 1 << 14):
        out = np.minimum(out, (FACTORS[:, None] * s[i : i + (1 << 14)]).min(1))
    return (out >> np.uint64(32)).astype(np.uint32)


def signatures(rows: DataFrame, words: int) -> DataFrame:
    """id, row, key, check, n, tokens, sketch (the lowest byte of each token) of every row of (id, row, text); a text
    without words has n 0 and nulls otherwise."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key: list[int | None] = [None] * batch.num_rows
            check: list[int | None] = [None] * batch.num_rows
            n, tokens, sketch = [0] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
            for r, s in shingle_sets(batch.column("text"), words):
                (key[r], check[r]), n[r], own = set_key(s), len(s), minwise(s)
                tokens[r], sketch[r] = own.tobytes(), own.astype(np.uint8).tobytes()
            numbers = [pa.array(x, pa.int64()) for x in (key, check, n)]
            columns = [batch.column("id"), batch.column("row"), *numbers, pa.array(tokens, pa.binary()), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "row", "key", "check", "n", "tokens", "sketch"])

    return rows.mapInArrow(sign, "id long, row long, key long, check long, n long, tokens binary, sketch binary")


def unused(path: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The place that a node's path chooses among the TOKENS ones that no node above it has used (bits of `used`)."""
    free = ((used[:, None] >> np.arange(TOKENS, dtype=np.uint64)) & np.uint64(1)) == 0
    nth = (hashing.mix(path) % free.sum(1).astype(np.uint64)).astype(np.int64)
    return (free.cumsum(1) > nth[:, None]).argmax(1)


def children(path: np.ndarray, used: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(path of the child that every row goes to from its node, places used down to it): the row's own token, at a new
    place that the node's path chooses."""
    at = unused(path, used)
    token = tokens[np.arange(len(path)), at].astype(np.uint64)
    child = hashing.mix(path * FACTORS[1] + (at.astype(np.uint64) << np.uint64(32)) + token)
    return child, used | (np.uint64(1) << at.astype(np.uint64))


def roots(trees: int) -> list[tuple[int, int]]:
    """(tree, place) of the roots: every tree begins at a place of its own, up to TOKENS trees."""
    return [(t + 1, int(p)) for t, p in enumerate(np.resize(np.random.default_rng(29).permutation(TOKENS), trees))]


def branched(rows: DataFrame, trees: int) -> DataFrame:
    """path, used, key of the first level of every tree, of rows (key, tokens)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
            for tree, at in roots(trees):
                root = np.uint64(tree) * FACTORS[1] + (np.uint64(at) << np.uint64(32))
                child = hashing.mix(root + tokens[:, at].astype(np.uint64))
                used = np.full(batch.num_rows, np.uint64(1) << np.uint64(at))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(used.view(np.int64)), batch.column("key")], ["path", "used", "key"])

    return rows.mapInArrow(go, "path long, used long, key long")


def by_group(column: str, work: Callable[[pd.DataFrame], pd.DataFrame], rows: int = 20_000) -> Callable:
    """For mapInPandas over rows sorted by `column`: calls `work` on runs of whole groups, `rows` rows or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < rows:
                continue
            both = pd.concat(held, ignore_index=True) if len(held) > 1 else batch
            value = both[column].to_numpy()
            cut = int(np.searchsorted(value, value[-1]))  # the last group may go on
            if cut:
                yield work(both.iloc[:cut].reset_index(drop=True))
            held, size = [both.iloc[cut:]], len(both) - cut if cut else 0
        if held and len(both := pd.concat(held, ignore_index=True)):
            yield work(both)

    return run


def rooted(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable row of each of n rows, by pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def compare_nodes(least: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Exhaustive comparison of small nodes on sketches; edges that span what is alike in each node."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        path, key = rows["path"].to_numpy(), rows["key"].to_numpy()
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, TOKENS)
        left, right, step = [], [], 1
        here = np.arange(len(path))
        while len(here := here[here + step < len(path)]) and len(here := here[path[here] == path[here + step]]):
            for some in np.array_split(here, -(-len(here) // 50_000)):
                alike = (sketch[some] == sketch[some + step]).mean(1) >= least
                left.append(some[alike])
                right.append(some[alike] + step)
            step += 1
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        root = rooted(len(path), a, b)
        more = np.flatnonzero(root != np.arange(len(path)))
        return pd.DataFrame({"a": key[more], "b": key[root[more]]})

    return work


def linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    if min(len(s), len(t)) * 100 < percent * max(len(s), len(t)):
        return False
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def confirm(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Edges that span the true components of each cluster: searches outward from each class in turn, comparing the
    full sets with those not reached yet. Sketches rule out pairs that are far below the threshold."""
    least = percent / 100 - MARGIN

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows["key"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows["members"]]
        sizes = np.array([len(s) for s in sets])
        group = rows["group"].to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        a, b = [], []
        for lo, hi in zip(edge, [*edge[1:], len(rows)], strict=True):
            if hi - lo < 2:
                continue
            order = lo + np.argsort(keys[lo:hi], kind="stable")
            sketch = np.stack([minwise(sets[i]) for i in order]) if hi - lo > 8 else None
            size, left = sizes[order], np.arange(hi - lo)
            while len(left) > 1:
                root, left = left[0], left[1:]
                queue = [root]
                while queue and len(left):
                    i = queue.pop()
                    maybe = np.minimum(size[left], size[i]) * 100 >= percent * np.maximum(size[left], size[i])
                    if sketch is not None:
                        maybe[maybe] = (sketch[left[maybe]] == sketch[i]).mean(1) >= least
                    hit = np.array([bool(m) and linked(sets[order[i]], sets[order[j]], percent) for j, m in zip(left, maybe, strict=True)], bool)
                    queue += left[hit].tolist()
                    a += keys[order[left[hit]]].tolist()
                    b += [int(keys[order[root]])] * int(hit.sum())
                    left = left[~hit]
        return pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    return work


def in_groups(rows: DataFrame, column: str, parts: int, work: Callable, size: int) -> DataFrame:
    return rows.repartition(parts, column).sortWithinPartitions(column).mapInPandas(by_group(column, work, size), "a long, b long")


def apart(heads: np.ndarray, near: float) -> list[int]:
    """Heads (rows of tokens) without those within `near` of an earlier one. Fewer heads only mean that fewer classes
    stay behind."""
    kept: list[int] = []
    for i in range(len(heads)):
        if not kept or (heads[kept] == heads[i]).mean(1).max() < near:
            kept.append(i)
    return kept


def meet_heads(near: float, far: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For runs of rows (group, path, used, key, tokens, heads) of large nodes: one row for each, key, head (the nearest
    one, if within `far`) and child (the path that the class goes on to, with the places used down to it); and once a
    group the pairs of heads that one class is near to, as key and head.

    A class within `near` of a head stays behind and has no child: by the triangle inequality whatever it is linked
    with lies within `far` of that head and is joined to it as well. So a crowd of near copies doesn't branch on and on.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        group, keys = rows["group"].to_numpy(), rows["key"].to_numpy()
        tokens = np.frombuffer(b"".join(rows["tokens"]), np.uint32).reshape(-1, TOKENS)
        child, used = (x.view(np.int64) for x in children(rows["path"].to_numpy().view(np.uint64), rows["used"].to_numpy().view(np.uint64), tokens))
        head, behind, pairs = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool), []
        joined = np.zeros(len(rows), bool)
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        for lo, hi in zip(edge, [*edge[1:], len(rows)], strict=True):
            own = sorted(rows["heads"].iloc[lo], key=lambda h: h["key"])
            theirs = np.stack([np.frombuffer(h["tokens"], np.uint32) for h in own])
            kept = apart(theirs, near)
            names, theirs = np.array([own[i]["key"] for i in kept], np.int64), theirs[kept]
            alike = (tokens[lo:hi, None] == theirs[None]).mean(2)
            first = alike.argmax(1)
            best = alike[np.arange(hi - lo), first]
            head[lo:hi], joined[lo:hi], behind[lo:hi] = names[first], best >= far, best >= near
            row, other = np.nonzero((alike >= far) & (np.arange(len(kept)) != first[:, None]))
            pairs.append(np.unique(np.stack([names[first[row]], names[other]]), axis=1))
        both = np.concatenate(pairs, 1)
        return pd.DataFrame({
            "key": np.concatenate([keys, both[0]]),
            "head": pd.Series(np.concatenate([head, both[1]])).astype("Int64").where(np.concatenate([joined, np.ones(both.shape[1], bool)])),
            "child": pd.Series(np.concatenate([child, np.zeros(both.shape[1], np.int64)])).astype("Int64").where(np.concatenate([~behind, np.zeros(both.shape[1], bool)])),
            "used": np.concatenate([used, np.zeros(both.shape[1], np.int64)]),
        })

    return work


def candidate_edges(classes: DataFrame, percent: int, trees: int, limit: int, depth: int, heads: int = 10) -> DataFrame:
    """Edges (a, b) of keys that span the candidate clusters of classes(key, tokens, sketch)."""
    spark = classes.sparkSession
    # what is linked with a class at `near` of a head is nearer than near - (1 - threshold); sketches may err
    near = percent / 100 - 0.1
    far = near - (1 - percent / 100) - 0.2
    small, edges = [], []
    level = branched(classes.select("key", "tokens"), trees)
    for d in range(depth):
        counts = level.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
        nodes, n = shared.stored_with(level.join(counts, "path"), "near-nodes", small=F.count_if(F.col("size") <= limit), large=F.count_if(F.col("size") > limit))
        small.append((nodes.filter(F.col("size") <= limit).select("path", "key"), n["small"]))
        if not n["large"]:
            break
        large = nodes.filter(F.col("size") > limit)
        if d == depth - 1:
            first = large.groupBy("path").agg(F.min("key").alias("b"))
            edges.append(large.join(first, "path").select(F.col("key").alias("a"), "b"))
            break
        # a node of many classes is dealt over several tasks, its heads copied to each
        copies = F.ceil(F.col("size") / SHARE)
        whole = large.join(classes.select("key", "tokens"), "key").withColumn("salt", F.pmod(F.xxhash64("key", "path"), copies))
        # one head of each of a few slices of a node, so that partial aggregation finds them
        slice_ = F.pmod(F.xxhash64("key", F.lit(d)), F.lit(heads))
        picks = [F.min_by(F.struct("key", "tokens"), F.when(slice_ == i, F.xxhash64("key"))).alias(f"h{i}") for i in range(heads)]
        some = whole.groupBy("path").agg(F.first("size").alias("size"), *picks)
        some = some.select("path", F.array_compact(F.array(*(f"h{i}" for i in range(heads)))).alias("heads"), F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("salt"))
        met = whole.select("path", "used", "salt", "key", "tokens").join(some, ["path", "salt"])
        met = met.select(F.xxhash64("path", "salt").alias("group"), "path", "used", "key", "tokens", "heads").sortWithinPartitions("group")
        met = shared.stored(met.mapInPandas(by_group("group", meet_heads(near, far), 2_000), "key long, head long, child long, used long"), "near-met")
        edges.append(met.filter("head <> key").select(F.col("key").alias("a"), F.col("head").alias("b")))
        level = met.filter("child is not null").select(F.col("child").alias("path"), "used", "key")
    rows = sum(n for _, n in small)
    alike = functools.reduce(DataFrame.unionByName, (x for x, _ in small)).join(classes.select("key", "sketch"), "key").select("path", "key", "sketch")
    found = in_groups(alike, "path", shared.parts(spark, rows, 100_000), compare_nodes(percent / 100 - MARGIN), 20_000)
    return functools.reduce(DataFrame.unionByName, edges, found)


def full_sets(rows: DataFrame, members: DataFrame, n: int, words: int) -> DataFrame:
    """key, check, members (the set) of the classes in members(key, check), read again from the texts; once per class."""
    bloom = rows.sparkSession.sparkContext.broadcast(Bloom.of(members, "key", n))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets = [], []
            seen: set[tuple[int, int]] = set()
            for _, s in shingle_sets(batch.column("text"), words):
                k = set_key(s)
                if k not in seen and bloom.value.has(np.array(k[:1], np.int64).view(np.uint64))[0]:
                    seen.add(k)
                    keys.append(k)
                    sets.append(s.tobytes())
            key, check = (pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([key, check, pa.array(sets, pa.binary())], ["key", "check", "members"])

    built = rows.mapInArrow(build, "key long, check long, members binary")
    return built.groupBy("key", "check").agg(F.first("members").alias("members"))


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
    trees: int = 10, limit: int = 64, depth: int = 4, cluster: int = CLUSTER,
    row_col: str | None = None,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (least id reachable over links), kept (id = component_id).

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of `words`-word shingles. Texts
    that are null or without words have empty sets and are linked with nothing. Equal texts are linked. A null id
    counts as the largest of its component. Equal rows share a component; where several share its least id, all are
    kept. An empty table gives no rows; other columns are ignored.
    row_col names a column of unique numbers from 0 on: it comes back too, and of the rows that share the least id of a
    component only the one with the least number is kept.
    Recall: a pair of similarity s meets in a tree of small nodes with chance s, and no two trees begin at one place, nor
    does a path use one twice; so at 0.8 all 10 trees miss it with 1e-7; where it has to go on once or twice more inside
    large nodes, with 4e-5 and 8e-4 (at 0.85: 6e-9, 3e-6 and 7e-5).
    Sets of more than `cluster` candidates are compared by pairs of blocks: exact, but each set goes to every block.
    """
    spark = docs.sparkSession
    row = F.col(f"`{row_col}`").cast("long") if row_col else F.lit(0).cast("long")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), row.alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    signed = shared.stored(signatures(rows, words), "near-signatures")
    place = shared.place(F.col("id"), F.col("row"), 2**63)
    classes = signed.filter("key is not null").groupBy("key", "check").agg(
        F.min("id").alias("id"), F.min(place).alias("place"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"),
        F.count("*").alias("rows"),
    )
    # stored with a number of each class, which stands for it in the trees
    classes = shared.stored(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    numbered = classes.select(F.col("node").alias("key"), "tokens", "sketch")
    clusters = components(candidate_edges(numbered, percent, trees, limit, depth))
    members = shared.stored(clusters.join(classes.select("node", "key", "check", "n"), "node"), "near-members")
    sizes = members.groupBy("root").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles"))
    sizes = sizes.withColumn("blocks", F.ceil(F.greatest(F.col("classes") / cluster, F.col("shingles") / (cluster * 2048))))
    members = members.join(sizes.select("root", "blocks"), "root")
    n = members.count()
    # a class of a large cluster meets every block of it: group = (cluster, its own block, another block), unordered
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    sets = members.join(full_sets(rows, members.select("key"), n, words), ["key", "check"])
    placed = sets.select("node", "root", "members", own.alias("own"), other.alias("other"))
    placed = placed.select(F.col("node").alias("key"), "members", F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("group"))
    links = shared.stored(in_groups(placed, "group", shared.parts(spark, n, 5_000), confirm(percent), 2_000), "near-links")
    label = classes.join(components(links), "node", "left").select("key", "check", "rows", "id", "place", F.coalesce("root", "node").alias("root"))
    least = label.groupBy("root").agg(F.min("id").alias("component"), F.min("place").alias("first"))
    label = shared.stored(label.join(least, "root").select("key", "check", "rows", "component", "first"), "near-labels")
    # rows of one set find its label without a shuffle where they are very many: at most MOST_HOT sets are so large
    hot = F.broadcast(label.filter(F.col("rows") > max(HOT_ROWS, -(-signed.count() // MOST_HOT))).drop("rows"))
    rows = signed.select("id", "row", "key", "check", "n")
    others = rows.join(hot.select("key", "check"), ["key", "check"], "left_anti").join(label.drop("rows"), ["key", "check"], "left")
    out = rows.join(hot, ["key", "check"]).unionByName(others)
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        (F.coalesce(place == F.col("first"), F.lit(True)) if row_col else F.col("id").eqNullSafe(component)).alias("kept"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )


def op10_near_dedup(spark, sf_dir):
    return near_dedup(shared.table(spark, sf_dir, "documents"), words=3, percent=85)

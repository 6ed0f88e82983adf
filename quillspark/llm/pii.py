"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose spans: four base kinds whose matches are always kept, and two looser kinds that take in much that is
no personal data: any assignment of a value to a name, and any number shaped like a local phone number. Five labelers
(shape, check, gazetteer, context, make-up) vote +1, 0 or -1 on every span. The votes on the looser kinds are counted by
pattern, a table of bounded size whatever the corpus (kinds x 3^5 votes x length classes); expectation-maximisation over
it estimates each labeler's reliability for each kind, and a logistic span classifier for each kind is trained on the
resulting soft labels. It is then an ordinary column expression: it decides which looser spans join the base ones.

Everything about one text takes time in proportion to its length: running sums go by blocks, never by growing arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

KINDS = ["email", "ip", "card", "phone", "secret", "local_phone"]
BASE = 4  # so many kinds are kept whatever the labelers say

# The base patterns, in a form that Java's engine runs in linear time: a run is entered at its start only (or where
# the match before it ended), and what can't be given back is possessive. The language is that of the plain form.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z][A-Za-z0-9_-]*+[ ]?[:=][ ]?[\"']?[A-Za-z0-9/+_-]{8,}+|(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])",
    "local_phone": r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
}
# Cheap tests that every text with a match passes.
NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?+[0-9]){11}"),
    "phone": lambda t: t.contains("+"),
    "secret": lambda t: t.rlike(r"[:=][ ]?[\"']?[A-Za-z0-9/+_-]{8}|AKIA"),
    "local_phone": lambda t: t.rlike(r"[0-9]{3}[ .-]?[0-9]{4}"),
}
# Gazetteers and context words of the labelers.
DOMAINS = (
    "com|org|net|edu|gov|mil|int|io|info|biz|name|pro|app|dev|ai|me|tv|cc|co|ac|ad|ae|am|ar|at|au|be|bg|br|by|ca|ch|cl|cn|cz|de|dk|ee|eg|es|eu|"
    "fi|fr|gr|hk|hr|hu|id|ie|il|in|ir|is|it|jp|ke|kr|lt|lu|lv|ma|mx|my|ng|nl|no|nz|pe|ph|pk|pl|pt|ro|rs|ru|sa|se|sg|si|sk|th|tr|tw|ua|uk|us|vn|za"
)
COUNTRY_CODES = (  # of phone numbers
    "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-368]|2[2346][0-9]|25[0-8]|29[0179]|3[578][0-9]|42[0-13]|50[0-9]|59[0-9]|"
    "67[02-9]|68[0-35-9]|69[0-2]|800|808|85[02356]|87[08]|88[0-368]|96[0-8]|97[0-9]|99[2-68]"
)
CARD_PREFIXES = "4|5[0-8]|2[2-7]|3[0-9]|6"
SECRET_NAMES = (
    "password|passwd|passphrase|passcode|pwd|pin|secret|token|credential|credentials|auth|authorization|bearer|apikey|api[_-]?key|access[_-]?key|"
    "private[_-]?key|client[_-]?secret|session[_-]?key|ssh[_-]?key|license[_-]?key"
)
CONTEXT = {
    "email": "mail|contact|write|reach",
    "ip": "ip|host|server|address|addr",
    "card": "card|visa|master|credit|pay|iban",
    "phone": "phone|call|tel|fax|mobile|contact",
    "secret": "login|user|key|config|credential|auth|export",
    "local_phone": "phone|call|tel|fax|mobile|contact",
}
BLOCK = 256  # of a running sum
WIDTH = 1024  # characters of a block of text
MOST = 2**31 - 1


added, larger, smaller = (lambda a, b: a + b), (lambda a, b: F.greatest(a, b)), (lambda a, b: F.least(a, b))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, merge: Callable[[Column, Column], Column], zero: int) -> Column:
    """What each element of an integer array finds before it: zero merged with all earlier ones. Elements are taken by
    blocks, so the arrays that grow stay short."""
    none = F.array().cast("array<int>")

    def over(some: Column, first: Column) -> Column:
        start = F.struct(first.alias("now"), none.alias("out"))
        return F.aggregate(some, start, lambda acc, x: F.struct(
            merge(acc["now"], x).alias("now"), F.array_append(acc["out"], acc["now"]).alias("out")))["out"]

    def by_block(blocks: Column) -> Column:
        firsts = over(F.transform(blocks, lambda b: F.aggregate(b, F.lit(zero), merge)), F.lit(zero))
        return F.flatten(F.zip_with(blocks, firsts, over))

    def cut(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_, k * BLOCK + 1, F.lit(BLOCK)))

    return let(values, lambda v: F.when(F.size(v) > 0, let(cut(v), by_block)).otherwise(none))


def matches(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, match, before), in code points; before is what stands
    between the match and the one before it, 30 characters at most."""
    pattern = PATTERNS[kind]
    none = F.array().cast("array<struct<start:int,end:int,m:string,before:string>>")

    def placed(found: Column, gaps: Column) -> Column:
        rows = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(
            m.alias("m"), F.length(g).alias("gap"), F.length(m).alias("n"), F.right(g, F.lit(30)).alias("before")))
        return let(rows, lambda rows: F.zip_with(
            rows, running(F.transform(rows, lambda r: r["gap"] + r["n"]), added, 0),
            lambda r, at: F.struct((at + r["gap"]).alias("start"), (at + r["gap"] + r["n"]).alias("end"), r["m"].alias("m"), r["before"].alias("before")),
        ))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(NEEDS[kind](text), let(found, lambda f: F.when(F.size(f) > 0, placed(f, F.split(text, pattern, -1))).otherwise(none))).otherwise(none)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of 12 to 19 digits passes the check sum."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        v = F.substring(number, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(v > 9, v - 9).otherwise(v)

    return F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def valid(kind: str, m: Column) -> Column:
    """The tests that a base match must pass; the looser kinds have none."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"))
    if kind == "card":
        return luhn(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def votes(kind: str, s: Column) -> list[Column]:
    """What the five labelers say about a span."""
    m, number = s["m"], digits(s["m"])
    value = F.regexp_replace(m, r"^[A-Za-z0-9_-]+[ ]?[:=][ ]?[\"']?", "")
    shape = {
        "email": m.rlike(r"^[A-Za-z0-9][\w.%+-]*@[A-Za-z0-9][A-Za-z0-9-]*(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"),
        "ip": ~m.rlike(r"(^|\.)0[0-9]"),
        "card": m.rlike(r"^([0-9]{4}[ -]?){3}[0-9]{1,7}$"),
        "phone": m.rlike(r"^\+[1-9]"),
        "secret": m.rlike(r"=|[\"']|^AKIA") | (F.length(value) >= 16),
        "local_phone": m.rlike(r"^\(|^[0-9]{3}([ .-])[0-9]{3}\1"),
    }[kind]
    checked = {
        "ip": valid("ip", m), "card": luhn(number), "phone": F.length(number).between(9, 15),
        "secret": F.size(F.array_distinct(F.split(F.left(value, F.lit(64)), ""))) >= 7,
    }.get(kind)
    known = {
        "email": m.rlike(rf"(?i)\.(?:{DOMAINS})$"), "ip": ~m.rlike(r"^(?:0|127|255)\."), "card": number.rlike(f"^(?:{CARD_PREFIXES})"),
        "phone": number.rlike(f"^(?:{COUNTRY_CODES})"), "secret": m.rlike(rf"(?i)^(?:[A-Za-z0-9]+[_-])?(?:{SECRET_NAMES})[ ]?[:=]|^AKIA"),
        "local_phone": ~number.rlike("^(?:[0-9]{3}[01]|[0-9]11|[0-9]{3}[0-9]11|[01])"),
    }[kind]
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") if kind in ("email", "secret") else ~number.rlike(r"([0-9])\1{3}")
    sure = lambda c: F.when(c, 1).otherwise(-1)
    near = F.when(F.lower(s["before"]).rlike(CONTEXT[kind]), 1).otherwise(0)
    check = F.lit(0) if checked is None else sure(checked)
    if kind == "local_phone":  # bare digits have no form to check
        check = F.when(m.rlike("^[0-9]+$"), 0).otherwise(sure(number.rlike("^[2-9][0-9]{2}[2-9]")))
    return [sure(shape), check, sure(known), near, sure(mixed)]


def free_spans(spans: Column) -> Column:
    """Of spans in order: the base ones, and the looser ones that touch none of them."""
    base = lambda s: s["kind"] < BASE
    reached = running(F.transform(spans, lambda s: F.when(base(s), s["end"]).otherwise(0)), larger, 0)
    coming = F.reverse(running(F.reverse(F.transform(spans, lambda s: F.when(base(s), s["start"]).otherwise(MOST))), smaller, MOST))
    around = F.zip_with(reached, coming, lambda r, c: F.struct(r.alias("reached"), c.alias("coming")))
    told = F.zip_with(spans, around, lambda s, a: F.struct(s.alias("s"), (base(s) | ((a["reached"] <= s["start"]) & (a["coming"] >= s["end"]))).alias("ok")))
    return F.transform(F.filter(told, lambda x: x["ok"]), lambda x: x["s"])


def candidates(text: Column) -> Column:
    """All proposed spans of a text: array of (start, end, kind, votes, size), by start, then end and kind.

    Spans of the looser kinds that touch a base span are not proposed.
    """
    def proposed(k: int, kind: str) -> Column:
        found = matches(text, kind)
        kept = F.filter(found, lambda s: valid(kind, s["m"])) if k < BASE else found
        return F.transform(kept, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind"), F.array(*votes(kind, s)).alias("votes"),
            F.least(F.floor(F.length(s["m"]) / 8), F.lit(5)).cast("int").alias("size"),
        ))

    found = F.array_sort(F.concat(*(proposed(k, kind) for k, kind in enumerate(KINDS))))
    return let(found, lambda all_: F.when(F.exists(all_, lambda s: s["kind"] >= BASE), free_spans(all_)).otherwise(all_))


def label_model(counts: dict[tuple, int], rounds: int = 50, weight: float = 4.0) -> tuple[dict[tuple, float], dict[int, list[dict]]]:
    """EM over vote patterns {(kind, votes, size): n}: soft label of each, and for each kind and labeler P(vote | class).
    The first guess of both counts as `weight` spans, so a kind with few spans stays near it."""
    guess = {1: (0.8, 0.25), 0: (0.15, 0.15), -1: (0.05, 0.6)}
    prior = dict.fromkeys({k for k, _, _ in counts}, 0.5)
    seen = {k: [dict(guess) for _ in next(iter(counts))[1]] for k in prior}
    soft: dict[tuple, float] = {}
    for _ in range(rounds):
        for p in counts:
            yes, no = math.log(prior[p[0]]), math.log(1 - prior[p[0]])
            for v, table in zip(p[1], seen[p[0]], strict=True):
                yes, no = yes + math.log(table[v][0]), no + math.log(table[v][1])
            soft[p] = 1 / (1 + math.exp(max(-700, min(700, no - yes))))
        for k, tables in seen.items():
            own = {p: w for p, w in counts.items() if p[0] == k}
            yes_n = sum(w * soft[p] for p, w in own.items())
            prior[k] = min(0.99, max(0.01, (yes_n + weight / 2) / (sum(own.values()) + weight)))
            for j, table in enumerate(tables):
                sums = {v: [weight * g for g in guess[v]] for v in guess}
                for p, w in own.items():
                    sums[p[1][j]][0] += w * soft[p]
                    sums[p[1][j]][1] += w * (1 - soft[p])
                total = [sum(x[c] for x in sums.values()) for c in (0, 1)]
                for v in table:
                    table[v] = (sums[v][0] / total[0], sums[v][1] / total[1])
    return soft, seen


def features(vote: tuple, size: int) -> list[float]:
    return [1.0, *map(float, vote), size / 5]


def span_classifier(counts: dict[tuple, int], soft: dict[tuple, float], steps: int = 400) -> dict[int, list[float]]:
    """Logistic weights of each kind, fitted to the soft labels by gradient steps; the patterns are few."""
    fitted = {}
    for kind in {k for k, _, _ in counts}:
        own = sorted(p for p in counts if p[0] == kind)
        total = sum(counts[p] for p in own)
        rows = [(features(*p[1:]), counts[p] / total, soft[p]) for p in own]
        weights = [0.0] * len(rows[0][0])
        for _ in range(steps):
            slope = [1e-4 * w for w in weights]
            for x, n, y in rows:
                z = sum(a * b for a, b in zip(weights, x, strict=True))
                d = n * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y)
                slope = [s + d * v for s, v in zip(slope, x, strict=True)]
            weights = [w - s for w, s in zip(weights, slope, strict=True)]
        fitted[kind] = weights
    return fitted


def score(span: Column, weights: dict[int, list[float]]) -> Column:
    """The classifier as a column: probability that a span of a looser kind is personal data."""
    z = F.lit(-30.0)
    for kind, (bias, *by_vote, by_size) in weights.items():
        own = F.lit(bias) + F.lit(by_size) * span["size"] / 5
        for j, w in enumerate(by_vote):
            own = own + F.lit(w) * span["votes"][j]
        z = F.when(span["kind"] == kind, own).otherwise(z)
    return 1 / (1 + F.exp(-z))


def fit(spans: DataFrame) -> dict[int, list[float]]:
    """Weights of the span classifier, from a column `spans` of candidates; only the bounded pattern counts are collected."""
    one = spans.select(F.explode(F.filter("spans", lambda s: s["kind"] >= BASE)).alias("s"))
    rows = one.groupBy("s.kind", "s.votes", "s.size").count().collect()
    counts = {(r["kind"], tuple(r["votes"]), r["size"]): r["count"] for r in rows}
    return span_classifier(counts, label_model(counts)[0])


def accepted(spans: Column, weights: dict[int, list[float]]) -> Column:
    return F.filter(spans, lambda s: (s["kind"] < BASE) | (score(s, weights) >= 0.5))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, spans: array of (start, end, kind, votes, size), kind an index of KINDS.

    Null texts count as empty and have no spans. Equal rows give equal rows; an empty table none. Columns beside
    the id and the text are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    found = shared.stored(rows.select("id", candidates(F.col("text")).alias("spans")), "pii-candidates")
    return found.select(F.col("id").alias(id_col), accepted(F.col("spans"), fit(found)).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every accepted span replaced by its kind in brackets; null texts stay null.

    Spans that overlap are replaced together, under the kind that starts first.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    weights = fit(shared.stored(docs.select(candidates(text).alias("spans")), "pii-candidates"))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        """Characters a to b of a text that is given in blocks of WIDTH."""
        block = lambda i: F.coalesce(F.try_element_at(blocks, i + 1), F.lit(""))
        i, j = (F.floor(x / WIDTH).cast("int") for x in (a, b))
        ends = F.concat(
            F.substring(block(i), a % WIDTH + 1, F.lit(WIDTH)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""),
            F.substring(block(j), F.lit(1), b % WIDTH),
        )
        return F.when(b <= a, "").when(i == j, F.substring(block(i), a % WIDTH + 1, b - a)).otherwise(ends)

    def masked(spans: Column, blocks: Column) -> Column:
        reached = running(F.transform(spans, lambda s: s["end"]), larger, 0)
        pieces = F.zip_with(spans, reached, lambda s, at: F.when(
            s["start"] >= at, F.concat(cut(blocks, at, s["start"]), F.element_at(names, s["kind"] + 1))).otherwise(""))
        rest = cut(blocks, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text))
        return F.array_join(F.concat(pieces, F.array(rest)), "")

    in_blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{WIDTH}}}"), F.lit(0))
    clean = let(accepted(candidates(text), weights), lambda spans: F.when(
        F.size(spans) > 0, let(in_blocks, lambda blocks: masked(spans, blocks))).otherwise(text))
    return docs.withColumn(text_col, F.when(F.col(f"`{text_col}`").isNotNull(), clean))


def listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], one(s).alias("said"))))
    return F.array_join(F.transform(order, lambda x: x["said"]), ",")


def op3_pii(spark, sf_dir):
    found = find_pii(shared.table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    n = [F.size(of_kind(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(BASE)]
    base = listed(F.filter("spans", lambda s: s["kind"] < BASE))
    return found.select("doc_id", *n, F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

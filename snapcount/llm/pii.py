"""Personal data by candidate spans and boosted trees, in DataFrame functions only.

Base spans follow fixed patterns (below) and always stay. Beside them, high-recall generators
propose overlapping spans: anything around an at sign, also a spelt one, and every run of digits and
separators, which is proposed as a phone number, a card and an address at once. A span is
described by yes/no features of its format and its context, so a whole corpus comes down
to counts by feature pattern (at most 2 to the number of features rows). Boosted trees of
depth two are fitted to these counts, once for each kind, with the base spans as positive
examples; copies of them without the sign that a person may leave out (the plus of a phone
number, the at sign) are positive too. A kind's threshold is the least score at which
``PRECISION`` of the weight is positive. The trees are then a sum of conditions again.

Positions: ``split`` and ``regexp_extract_all`` with one pattern give the pieces between the
matches and the matches; running lengths, in code points, place them. The patterns say the
same as the plain ones but never go back over a run, so long runs take linear time.

Defined results: a null or empty text has no span and the digest of the empty string; rows with
equal texts have equal spans; an empty table gives an empty table; with no candidate the
model adds nothing. Other columns are carried.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcount.llm.common import text_of

# Kinds in their order, and what each must match.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
QUAD = rf"^{PART}\.{PART}\.{PART}\.{PART}$"
NEEDS = {"email": "@", "phone": "+"}
# Generators of candidates, and the kinds that each proposes.
AT = r"(?:@|\x20?[\[(]at[\])]\x20?)"
DOT = r"(?:\.|\x20?[\[(]dot[\])]\x20?)"
GENERATORS = {
    "address": rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)*+",
    "number": r"[+(]?[0-9](?:[\x20()./-]{0,2}[0-9])++",
}
PROPOSES = {"address": ("email",), "number": ("ip", "card", "phone")}
CONTEXT = r"(?i)(?:tel|phone|call|fax|card|visa|mail|contact|address|host|server)[^\n]{0,12}$"
SPAN = "array<struct<start:bigint,stop:bigint,m:string,before:string,after:string>>"
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

TREES = 40
RATE = 0.3
PRECISION = 0.95
FEATURES = (
    "digits", "luhn", "plus", "brackets", "dots", "three_dots", "separated", "glued_before", "glued_after",
    "at", "domain", "quad", "context",
)
# What a person may leave out, by kind.
OPTIONAL = {"phone": ("plus",), "email": ("at",)}


def located(text: str, pattern: str, name: str, when: Column) -> list[tuple[str, Column]]:
    """Steps (column name, expression) of which the last holds the matches and where they stand."""
    tag = f"__{name}_"
    none = F.array().cast("array<string>")
    found = F.when(when, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none)
    pieces = F.when(F.size(f"{tag}f") > 0, F.split(F.col(text), pattern, -1)).otherwise(none)
    f, p = F.col(f"{tag}f"), F.col(f"{tag}p")

    def add(held: Column, i: Column) -> Column:
        start = held["at"] + F.char_length(p[i])
        stop = start + F.char_length(f[i])
        span = F.struct(
            start.cast("bigint").alias("start"),
            stop.cast("bigint").alias("stop"),
            f[i].alias("m"),
            F.right(p[i], F.lit(24)).alias("before"),
            F.left(p[i + 1], F.lit(1)).alias("after"),
        )
        return F.struct(stop.cast("bigint").alias("at"), F.concat(held["out"], F.array(span)).cast(SPAN).alias("out"))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))
    walked = F.aggregate(F.sequence(F.lit(0), F.size(f) - 1), begin, add, lambda held: held["out"])
    return [
        (f"{tag}f", found),
        (f"{tag}p", pieces),
        (f"{tag}s", F.when(F.size(f) > 0, walked).otherwise(F.array().cast(SPAN))),
    ]


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit fits."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return (F.length(digits) > 0) & (F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0)


def holds(kind: str, m: Column) -> Column:
    """Whether a match of the kind's base pattern is a base span."""
    digits = digits_of(m)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(QUAD)
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    return F.length(digits).between(8, 15)


def holding(kind: str) -> Callable[[Column], Column]:
    return lambda s: holds(kind, s["m"])


def with_steps(df: DataFrame, steps: list[tuple[str, Column]]) -> tuple[DataFrame, str]:
    for name, column in steps:
        df = df.withColumn(name, column)
    return df, steps[-1][0]


def base_spans(df: DataFrame, text: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with a column of base spans for each kind."""
    names = {}
    for kind in KINDS:
        needed = F.contains(F.col(text), F.lit(NEEDS[kind])) if kind in NEEDS else F.col(text).rlike("[0-9]")
        df, found = with_steps(df, located(text, PATTERNS[kind], kind, needed))
        names[kind] = f"__base_{kind}"
        df = df.withColumn(names[kind], F.filter(found, holding(kind)))
    return df, names


def features(kind: str, s: Column) -> Column:
    """Feature pattern of a candidate as an integer, a bit for each of ``FEATURES``."""
    m = s["m"]
    digits = digits_of(m)
    n = F.length(digits)
    low, high = {"email": (0, 40), "ip": (4, 12), "card": (16, 19), "phone": (8, 15)}[kind]
    flags = {
        "digits": n.between(low, high),
        "luhn": n.between(12, 19) & luhn(digits),
        "plus": m.startswith("+"),
        "brackets": F.contains(m, F.lit("(")),
        "dots": F.contains(m, F.lit(".")),
        "three_dots": F.length(F.regexp_replace(m, "[^.]", "")) == 3,
        "separated": m.rlike("[0-9][ -]+[(0-9]"),
        "glued_before": s["before"].rlike(r"[\p{L}\p{N}_]$"),
        "glued_after": s["after"].rlike(r"[\p{L}\p{N}_]"),
        "at": F.contains(m, F.lit("@")),
        "domain": m.rlike(rf"{AT}[A-Za-z0-9-]+{DOT}[A-Za-z0-9-]"),
        "quad": m.rlike(QUAD),
        "context": s["before"].rlike(CONTEXT),
    }
    bits = [F.when(flags[name], 1 << i).otherwise(0) for i, name in enumerate(FEATURES)]
    return reduce(lambda a, b: a + b, bits)


def proposed(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), features(kind, s).alias("x"))


def candidates(df: DataFrame, text: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with a column of candidates for each kind: (start, stop, x: feature pattern)."""
    names = {}
    for generator, pattern in GENERATORS.items():
        some = "[0-9]" if generator == "number" else r"@|[\[(]at[\])]"
        df, found = with_steps(df, located(text, pattern, generator, F.col(text).rlike(some)))
        wide = F.filter(found, lambda s: F.length(digits_of(s["m"])) >= 4) if generator == "number" else F.col(found)
        for kind in PROPOSES[generator]:
            names[kind] = f"__may_{kind}"
            df = df.withColumn(
                names[kind],
                F.transform(wide, proposed(kind)),
            )
    return df, names


def overlaps(a: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (a["start"] < b["stop"]) & (b["start"] < a["stop"]))


@dataclass
class Trees:
    """Depth-two trees of one kind: (feature, feature, the four leaves), a start and a threshold."""

    start: float
    trees: list[tuple[int, int, tuple[float, float, float, float]]]
    least: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for a, b, leaves in self.trees:
            total += np.array(leaves)[(x >> a & 1) * 2 + (x >> b & 1)]
        return total

    def column(self, x: Column) -> Column:
        total = F.lit(float(self.start))
        for a, b, leaves in self.trees:
            one, two = x.bitwiseAND(1 << a) != 0, x.bitwiseAND(1 << b) != 0
            total = total + F.when(one & two, leaves[3]).when(one, leaves[2]).when(two, leaves[1]).otherwise(leaves[0])
        return total


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES) -> Trees | None:
    """Boosted trees on weighted feature patterns; None with one class only."""
    good, bad = float((weight * y).sum()), float((weight * (1 - y)).sum())
    if not good or not bad:
        return None
    start = float(np.log(good / bad))
    total = np.full(len(x), start)
    bits = len(FEATURES)
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (y - p), weight * p * (1 - p)
        best = None
        for a in range(bits):
            for b in range(a + 1, bits):
                cell = (x >> a & 1) * 2 + (x >> b & 1)
                gs, hs = np.bincount(cell, g, 4), np.bincount(cell, h, 4) + 1.0
                gain = float((gs * gs / hs).sum())
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, a, b, gs / hs * RATE)
        _, a, b, leaves = best
        grown.append((a, b, tuple(float(v) for v in leaves)))
        total += leaves[(x >> a & 1) * 2 + (x >> b & 1)]
    model = Trees(start, grown, float("inf"))
    order = np.argsort(-total, kind="stable")
    share = np.cumsum((weight * y)[order]) / np.cumsum(weight[order])
    last_of_score = np.append(np.diff(total[order]) != 0, True)
    enough = np.flatnonzero((share >= PRECISION) & last_of_score)
    if len(enough):
        model.least = max(0.0, float(total[order][enough[-1]]))
    return model


def fit(docs: DataFrame, text: str = "text") -> dict[str, Trees | None]:
    """Trees for each kind, from the counts of all candidates of all documents."""
    df = docs.select(text_of(text).alias("__text"))
    df, base = base_spans(df, "__text")
    df, may = candidates(df, "__text")

    def counted(kind: str) -> Column:
        seen = lambda s: overlaps(s, F.col(base[kind])).cast("int")
        return F.transform(
            F.col(may[kind]), lambda s: F.struct(F.lit(kind).alias("kind"), s["x"].alias("x"), seen(s).alias("y"))
        )

    every = F.concat(*[counted(kind) for kind in KINDS])
    counts = df.select(F.explode(every).alias("c")).groupBy("c.kind", "c.x", "c.y").count().collect()
    models = {}
    for kind in KINDS:
        rows = [(r["x"], r["y"], float(r["count"])) for r in counts if r["kind"] == kind]
        for name in OPTIONAL.get(kind, ()):
            bit = 1 << FEATURES.index(name)
            rows += [(x & ~bit, 1, n / 2) for x, y, n in rows if y and x & bit]
        x, y, n = (np.array(v) for v in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, int),) * 3
        models[kind] = boost(x, y, n) if len(x) else None
    return models


def added(model: Trees, base: Column) -> Callable[[Column], Column]:
    return lambda s: ~overlaps(s, base) & (model.column(s["x"]) >= model.least)


def find(docs: DataFrame, models: dict[str, Trees | None], text: str = "text") -> DataFrame:
    """``docs`` with ``pii_base`` and ``pii_spans``: arrays of (kind, start, stop), by kind and start.

    No shuffle. Added spans overlap no base span of their kind.
    """
    kept = [c for c in docs.columns if c not in ("pii_base", "pii_spans")]
    df = docs.select(*kept).withColumn("__text", text_of(text))
    df, base = base_spans(df, "__text")
    df, may = candidates(df, "__text")

    def named(kind: str, spans: Column) -> Column:
        return F.transform(
            spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))
        )

    both = {}
    for kind in KINDS:
        own = named(kind, F.col(base[kind]))
        model = models.get(kind)
        if model is None or model.least == float("inf"):
            both[kind] = own
            continue
        chosen = F.filter(F.col(may[kind]), added(model, F.col(base[kind])))
        both[kind] = F.array_sort(F.concat(own, named(kind, chosen)))
    return df.select(
        *kept,
        F.concat(*[named(k, F.col(base[k])) for k in KINDS]).alias("pii_base"),
        F.concat(*[both[k] for k in KINDS]).alias("pii_spans"),
    )


def written(spans: str) -> Column:
    """kind:start:stop of every span, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, counts of base spans, digest of base spans, all spans) of the rows of ``find``."""
    count = lambda kind: F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(written("pii_base"), 256).alias("base_sha256"),
        written("pii_spans").alias("spans"),
    )


def redact(docs: DataFrame, models: dict[str, Trees | None]) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind's mark; ``n_chars`` follows if present."""
    found = find(docs, models)
    text = F.col("text").cast("string")

    def walk(held: Column, s: Column) -> Column:
        mark = reduce(lambda c, k: c.when(s["kind"] == k, MARKS[k]), KINDS[1:], F.when(s["kind"] == KINDS[0], MARKS[KINDS[0]]))
        between = F.substring(text, (held["at"] + 1).cast("int"), (s["start"] - held["at"]).cast("int"))
        fresh = s["start"] >= held["at"]
        return F.struct(
            F.greatest(held["at"], s["stop"]).cast("bigint").alias("at"),
            F.when(fresh, F.concat(held["out"], between, mark)).otherwise(held["out"]).alias("out"),
        )

    by_start = F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"], s["stop"], s["kind"])))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    rest = lambda held: F.concat(held["out"], F.substring(text, (held["at"] + 1).cast("int"), F.char_length(text)))
    clean = F.when(F.size("pii_spans") > 0, F.aggregate(by_start, begin, walk, rest)).otherwise(F.col("text"))
    found = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        same = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(same))
    return found.select(*docs.columns)

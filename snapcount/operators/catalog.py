"""The play catalog: building it, and checking observed calls against it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapcount import constants as C
from snapcount.functions import text as P
from snapcount.functions.similarity import seq_ratio
from snapcount.session import BROADCAST_ROWS, at_most, cut

# A runner-up below this can never spoil the margin of an accepted match.
RELEVANT = C.FUZZY_ACCEPT_WITH_MARGIN - C.FUZZY_MARGIN

# Rarest pairs of a key that are coupled; the rows found are the same with any number.
MOST_IN_COUPLES = 40

SIDES = ("offense", "defense")


class Catalog:
    """Catalog plays plus what is derived from them once.

    ``label`` is the catalog's own name; it goes into provenance texts.
    """

    def __init__(
        self, plays: DataFrame, names: DataFrame | None = None, label: str = ""
    ) -> None:
        self.plays = plays
        self.label = label
        names = names if names is not None else plays.select("side", "play_name")
        self.names = names.filter(F.col("play_name").isNotNull()).distinct()
        self._small: bool | None = None
        self._local: dict | None = None

    @property
    def small(self) -> bool:
        """Whether the whole catalog may be broadcast; counted once."""
        if self._small is None:
            self._small = at_most(self.plays, BROADCAST_ROWS) and at_most(
                self.names, BROADCAST_ROWS
            )
            if not self._small:
                # Read by every check of a call.
                self.names = cut(self.names)
        return self._small

    def hint(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df

    def available(self, side: str) -> bool:
        if self.small:
            return bool(self.local()["names"][side])
        return bool(self.names.filter(F.col("side") == side).head(1))

    def local(self) -> dict:
        """Names per side and per offense formation; only for a small catalog."""
        if self._local is None:
            names: dict[str, list[str]] = {side: [] for side in SIDES}
            for row in self.names.filter(F.col("side").isin(*SIDES)).collect():
                names[row.side].append(row.play_name)
            formations: dict[str, list[str]] = {}
            for row in formation_names(self.plays).collect():
                formations[row.formation_key] = row.names
            self._local = {"names": names, "formations": formations}
        return self._local


# Building -------------------------------------------------------------------


def parse_pages(pages: DataFrame, html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(plays, rejects) from crawled pages with script payloads.

    ``pages`` has ``side``, ``page`` and the html. A page without a page count
    or without plays is rejected.
    """
    pushed = F.regexp_extract_all(
        html, F.lit(r"(?s)self\.__next_f\.push\((\[.*?\])\)</script>"), F.lit(1)
    )
    # A payload is [number, "text"]; anything else is skipped.
    second = F.transform(
        pushed, lambda raw: F.get(F.from_json(raw, "array<string>"), F.lit(1))
    )
    quoted = F.transform(
        pushed, lambda raw: raw.rlike(r'(?s)^\[\s*[^,"\[{]*,\s*"')
    )
    decoded = F.filter(
        F.transform(
            F.arrays_zip(second.alias("text"), quoted.alias("ok")),
            lambda p: F.when(p["ok"], p["text"]),
        ),
        lambda text: text.isNotNull(),
    )
    play = r'(\{"side":"(?:offense|defense)".*?"teamCount":\d+\})'
    raw_plays = F.flatten(
        F.transform("_decoded", lambda text: F.regexp_extract_all(text, F.lit(play), F.lit(1)))
    )
    totals = F.transform(
        "_decoded",
        lambda text: F.nullif(
            F.regexp_extract(text, r'"totalPages":(\d+)', 1), F.lit("")
        ).try_cast("int"),
    )
    parsed = (
        pages.withColumn("_decoded", decoded)
        .withColumns(
            {
                "_plays": raw_plays,
                "total_pages": F.get(F.filter(totals, lambda n: n.isNotNull()), F.lit(0)),
            }
        )
        .drop("_decoded")
    )
    good = F.col("total_pages").isNotNull() & (F.size("_plays") > 0)
    schema = (
        "side string, formationFamily string, formation string, formationSlug string, "
        "playName string, playSlug string, playType string, teamCount int"
    )
    plays = (
        parsed.filter(good)
        .select("side", "page", "total_pages", F.posexplode("_plays").alias("pos", "_raw"))
        .withColumn("_play", F.from_json("_raw", schema))
        .select(F.col("page"), "pos", "total_pages", "_play.*")
    )
    rejects = parsed.filter(~good).drop("_plays", html)
    return plays, rejects


def changed_page_counts(plays: DataFrame) -> DataFrame:
    """Pages whose page count differs from their side's first page."""
    first = Window.partitionBy("side").orderBy("page")
    return (
        plays.select("side", "page", "total_pages")
        .distinct()
        .withColumn("first_total", F.first("total_pages").over(first))
        .filter(F.col("total_pages") != F.col("first_total"))
    )


def keep_last(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key: the last one in ``order``."""
    newest = F.struct(*order)
    others = [name for name in df.columns if name not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*others), newest).alias("_kept"))
    return kept.select(*keys, "_kept.*").select(*df.columns)


def is_special_teams(*fields: str) -> Column:
    text = F.upper(F.concat_ws(" ", *(F.coalesce(F.col(f), F.lit("")) for f in fields)))
    found = F.lit(False)
    for phrase in C.SPECIAL_TEAMS_PHRASES:
        found = found | text.contains(phrase)
    return found


def catalog_records(raw: DataFrame, base_url: str = "") -> DataFrame:
    """Crawled play objects in the catalog's columns."""
    special = is_special_teams("formationFamily", "formation", "playName", "playType")
    return raw.select(
        "side",
        F.when(special, "special_teams").otherwise(F.col("side")).alias("unit"),
        F.col("formationFamily").alias("formation_family"),
        "formation",
        F.col("formationSlug").alias("formation_slug"),
        F.col("playName").alias("play_name"),
        F.col("playSlug").alias("play_slug"),
        F.col("playType").alias("play_type"),
        F.col("teamCount").alias("team_count"),
        F.concat_ws("/", F.lit(base_url), "side", "formationSlug", "playSlug").alias(
            "source_url"
        ),
    )


def build_catalog(offense: DataFrame, defense: DataFrame, base_url: str = "") -> DataFrame:
    """Both sides' crawled plays, last of each key, in catalog order (``pos``)."""
    raw = offense.unionByName(defense)
    unique = keep_last(raw, ["side", "formationSlug", "playSlug"], "page", "pos")
    return in_catalog_order(catalog_records(unique, base_url))


def in_catalog_order(records: DataFrame) -> DataFrame:
    """Add ``pos``, the rank in (side, family, formation, name) order; nulls come first.

    Rows are cut into ranges of this order by sampled bounds, whatever family they are of, and ranked within their
    range behind the rows of the ranges before. Rows equal in all order columns, slugs included, may take any order.
    """
    order = ["side", "formation_family", "formation", "play_name", "formation_slug", "play_slug"]
    count = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written with their range, as another run may sample other bounds.
    ranged = cut(records.repartitionByRange(count, *order).withColumn("_range", F.spark_partition_id()))
    # One row a range, so at most ``count`` rows.
    sizes = ranged.groupBy("_range").count().orderBy("_range").collect()
    starts = accumulate((row["count"] for row in sizes), initial=0)
    before = records.sparkSession.createDataFrame(
        [(row["_range"], start) for row, start in zip(sizes, starts)], "_range int, _start long"
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        ranged.withColumn("_rank", F.row_number().over(inside))
        .join(F.broadcast(before), "_range")
        .select(*records.columns, (F.col("_start") + F.col("_rank") - 1).alias("pos"))
    )


def catalog_names(plays: DataFrame) -> DataFrame:
    """Distinct names per side, in case-insensitive order."""
    return (
        plays.select("side", "play_name").distinct().orderBy("side", F.lower("play_name"), "play_name")
    )


def unit_counts(plays: DataFrame) -> DataFrame:
    """Plays per unit, with a total row."""
    counts = plays.rollup("unit").agg(F.count("*").alias("plays"))
    return counts.select(F.coalesce("unit", F.lit("total")).alias("unit"), "plays")


# Lookups --------------------------------------------------------------------


def formation_key(family: Column | str, formation: Column | str) -> Column:
    parts = [F.col(c) if isinstance(c, str) else c for c in (family, formation)]
    return P.compact_key(F.concat(*(F.coalesce(c, F.lit("")) for c in parts)))


def formation_names(plays: DataFrame) -> DataFrame:
    """(formation_key, names) of the offense; names in case-insensitive order."""
    return (
        plays.filter(F.col("side") == "offense")
        .groupBy(formation_key("formation_family", "formation").alias("formation_key"))
        .agg(F.collect_set("play_name").alias("names"))
        .withColumn(
            "names",
            F.transform(
                F.array_sort(F.transform("names", lambda n: F.struct(F.lower(n), n.alias("n")))),
                lambda pair: pair["n"],
            ),
        )
    )


def exact_names(names: DataFrame) -> DataFrame:
    """(side, compact, name) where exactly one distinct name has the key."""
    return (
        names.groupBy("side", P.compact_key("play_name").alias("compact"))
        .agg(F.collect_set("play_name").alias("_names"))
        .filter(F.size("_names") == 1)
        .select("side", "compact", F.get("_names", F.lit(0)).alias("exact_name"))
    )


class _Matcher:
    """Best and next-best name for a text, comparing only names that can count."""

    LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def __init__(self, names: list[str], formations: dict[str, list[str]]) -> None:
        every = sorted(set(names).union(*formations.values()))
        self.names = every
        keys = ["".join(c for c in n.upper() if c in self.LETTERS) for n in every]
        self.compared = [SequenceMatcher(None, "", key) for key in keys]
        self.lengths = np.array([len(key) for key in keys])
        self.counts = np.array([self._letters(key) for key in keys]).reshape(-1, 36)
        place = {name: i for i, name in enumerate(every)}
        self.every = np.array([place[name] for name in names], dtype=int)
        self.formations = {
            key: np.array([place[n] for n in group]) for key, group in formations.items()
        }
        self.best = lru_cache(maxsize=1 << 16)(self._best)

    def _letters(self, text: str) -> list[int]:
        return [text.count(letter) for letter in self.LETTERS]

    def _best(self, text: str, formation: str | None) -> str | None:
        chosen = self.formations.get(formation, self.every) if formation else self.every
        shared = np.minimum(self.counts[chosen], self._letters(text)).sum(axis=1)
        bound = 2 * shared / (self.lengths[chosen] + len(text))
        ranked = []
        for i in chosen[bound >= RELEVANT - 1e-9]:
            self.compared[i].set_seq1(text)
            ranked.append((self.compared[i].ratio(), self.names[i]))
        ranked.sort(reverse=True)
        if not ranked:
            return None
        top, name = ranked[0]
        following = ranked[1][0] if len(ranked) > 1 else 0.0
        return name.upper() if accepted(top, following) else None


def accepted(top: float, following: float) -> bool:
    return top >= C.FUZZY_ACCEPT or (
        top >= C.FUZZY_ACCEPT_WITH_MARGIN and top - following >= C.FUZZY_MARGIN
    )


def _matching_udf(df: DataFrame, catalog: Catalog, side: str):
    local = catalog.local()
    formations = local["formations"] if side == "offense" else {}
    shared = df.sparkSession.sparkContext.broadcast((local["names"][side], formations))

    @F.pandas_udf("string")
    def matching(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        matcher = _Matcher(*shared.value)
        for texts, keys in parts:
            yield pd.Series(
                [None if t is None else matcher.best(t, k) for t, k in zip(texts, keys)],
                dtype=object,
            )

    return matching


def _numbered_pairs(keys: DataFrame, key: str) -> DataFrame:
    """Pairs of neighbouring letters of each distinct key; equal pairs of a key are numbered."""
    starts = F.sequence(F.lit(1), F.length(key) - 1)
    pairs = F.transform(starts, lambda i: F.substring(key, i, F.lit(2)))
    listed = keys.filter(F.length(key) >= 2).select(key, F.posexplode(pairs).alias("_at", "_pair"))
    nth = F.row_number().over(Window.partitionBy(key, "_pair").orderBy("_at"))
    return listed.select(key, "_pair", nth.alias("_nth"))


def _meeting_keys(pairs: DataFrame, frequency: DataFrame, key: str, ratio: float, text: bool) -> DataFrame:
    """(``key``, ``_meets``): what a text or name shares with all names or texts as near as ``ratio``.

    With M matched letters of L in both, the matches form at most L-2M+1 blocks, so 3M-L-1 pairs stay whole, and M is at
    least L times half the ratio. Two keys that share so many pairs share two of the rarest of each that are left when
    two fewer are taken off; keys are such couples. The least L follows from the bands of length of both. Single pairs
    are the keys where bands are so short that one shared pair is all that is sure, or so long that couples are many.
    """
    width = 1.001 * (2 - ratio) / ratio
    rarity = F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_pair", "_nth")
    listed = (
        pairs.join(frequency, ["_pair", "_nth"], "left")
        .groupBy(key)
        .agg(F.transform(F.sort_array(F.collect_list(rarity)), lambda p: F.concat(p["_pair"], p["_nth"])).alias("_rare"))
        .withColumn("_band", F.floor(F.log(F.length(key)) / math.log(width)))
        .withColumn("_step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    )
    own, other = F.col("_band"), F.col("_band") + F.col("_step")
    least = F.pow(F.lit(width), own) + F.pow(F.lit(width), other)
    shared = F.greatest(F.lit(1), F.ceil((1.5 * ratio - 1) * least - 1 - 1e-6))
    longest = F.pow(F.lit(width), F.greatest(own, other) + 1)
    sized = listed.withColumn("_shared", shared).withColumn(
        "_couples", (F.col("_shared") >= 2) & (longest - F.col("_shared") <= MOST_IN_COUPLES)
    )
    kept = F.length(key) - F.col("_shared") + F.when(F.col("_couples"), 1).otherwise(0)
    rare = F.slice("_rare", F.lit(1), F.greatest(F.lit(0), kept.cast("int")))
    couples = F.flatten(
        F.transform(
            "_rare", lambda x, i: F.transform(F.slice("_rare", i + 2, F.size("_rare")), lambda y: F.concat(x, F.lit("|"), y))
        )
    )
    bands = (own, other) if text else (other, own)
    return (
        sized.withColumn("_rare", rare)
        .withColumn("_key", F.explode(F.when(F.col("_couples"), couples).otherwise(F.col("_rare"))))
        .select(key, F.concat_ws(":", *bands, "_key").alias("_meets"))
    )


def _near_keys(texts: DataFrame, keys: DataFrame, ratio: float) -> DataFrame:
    """(compact, name_key, _ratio) of distinct texts and names that are as near as ``ratio``.

    They meet at their rarest pairs. Where lengths add up to 5, 8 or 11 no pair need be shared; those short texts meet
    on single letters.
    """
    low = ratio - 1e-9
    mine, theirs = _numbered_pairs(texts, "compact"), _numbered_pairs(keys, "name_key")
    # At most one row for each two letters of the alphabet and number.
    frequency = theirs.groupBy("_pair", "_nth").agg(F.count("*").alias("_n"))
    met = _meeting_keys(mine, frequency, "compact", low, True).join(
        _meeting_keys(theirs, frequency, "name_key", low, False), "_meets"
    )

    def letters(rows: DataFrame, key: str, longest: int) -> DataFrame:
        short = rows.filter(F.length(key) <= longest)
        return short.select(key, F.explode(F.array_distinct(F.split(key, ""))).alias("_letter"))

    single = letters(texts, "compact", 10).join(letters(keys, "name_key", 8), "_letter")
    single = single.filter((F.length("compact") + F.length("name_key")).isin(5, 8, 11))
    columns = ["compact", "name_key"]
    return _scored(met.select(columns).unionByName(single.select(columns)).distinct(), low)


def _scored(pairs: DataFrame, low: float) -> DataFrame:
    """Pairs with ``_ratio``, without those that edits rule out before it is computed.

    Matched letters are a common subsequence, so the edit distance is at most the unmatched letters of both.
    """
    total = F.length("compact") + F.length("name_key")
    shorter = F.least(F.length("compact"), F.length("name_key"))
    most = F.floor((1 - low) * total).cast("int")
    possible = (2 * shorter >= low * total) & (F.levenshtein("compact", "name_key") <= most)
    return pairs.filter(possible).withColumn("_ratio", seq_ratio("compact", "name_key")).filter(F.col("_ratio") >= low)


def _match_by_blocks(lookups: DataFrame, catalog: Catalog, side: str) -> DataFrame:
    """(compact, fkey, fuzzy) for a catalog too large to broadcast, by equal-key joins that find every pair that counts.

    No name is accepted below a ratio of ``FUZZY_ACCEPT_WITH_MARGIN``, so texts are first searched at that ratio; only
    those whose best name needs a margin are searched for a runner-up, which may be less near.
    """
    names = catalog.names.filter(F.col("side") == side).select(
        "play_name", P.compact_key("play_name").alias("name_key")
    )
    # Only a known formation of the offense narrows the names; a blank one never does.
    fnames = (
        formation_names(catalog.plays)
        .withColumnRenamed("formation_key", "fkey")
        .filter((F.col("fkey") != "") & F.lit(side == "offense"))
    )
    inside = lookups.join(fnames.select("fkey"), "fkey", "left_semi")
    outside = lookups.join(fnames.select("fkey"), "fkey", "left_anti")
    pairs_in = inside.join(
        fnames.select("fkey", F.explode("names").alias("play_name")), "fkey"
    ).withColumn("name_key", P.compact_key("play_name"))

    texts, keys = outside.select("compact").distinct(), names.select("name_key").distinct()
    first = cut(_near_keys(texts, keys, C.FUZZY_ACCEPT_WITH_MARGIN))
    tops = first.groupBy("compact").agg(F.max("_ratio").alias("_top"))
    doubtful = tops.filter(F.col("_top") < C.FUZZY_ACCEPT).select("compact")
    near = first.join(doubtful, "compact", "left_anti").unionByName(_near_keys(doubtful, keys, RELEVANT))
    columns = ["compact", "fkey", "play_name", "_ratio"]
    scored = (
        near.join(names.distinct(), "name_key")
        .join(outside, "compact")
        .select(columns)
        .unionByName(_scored(pairs_in, RELEVANT - 1e-9).select(columns))
    )
    ranked = Window.partitionBy("compact", "fkey").orderBy(F.desc("_ratio"), F.desc("play_name"))
    top = (
        scored.withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") <= 2)
        .groupBy("compact", "fkey")
        .agg(
            F.max(F.when(F.col("_rank") == 1, F.col("play_name"))).alias("play_name"),
            F.max(F.when(F.col("_rank") == 1, F.col("_ratio"))).alias("_top"),
            F.coalesce(
                F.max(F.when(F.col("_rank") == 2, F.col("_ratio"))), F.lit(0.0)
            ).alias("_following"),
        )
    )
    good = (F.col("_top") >= C.FUZZY_ACCEPT) | (
        (F.col("_top") >= C.FUZZY_ACCEPT_WITH_MARGIN)
        & (F.col("_top") - F.col("_following") >= C.FUZZY_MARGIN)
    )
    return top.filter(good).select("compact", "fkey", F.upper("play_name").alias("fuzzy"))


def validate_calls(
    df: DataFrame,
    catalog: Catalog,
    text: str,
    side: str,
    out: str,
    formation: str | None = None,
) -> DataFrame:
    """Add ``out`` (catalog name in capitals, or null) and ``out_status``.

    Exact names are found by a join. Texts without one go, where they stand and
    so without a shuffle, through an Arrow function that holds the catalog; a
    catalog above the broadcast limit is joined on letter pairs instead.
    """
    status = f"{out}_status"
    readable = F.col(text).isNotNull() & (F.col(text) != "")
    if not catalog.available(side):
        return df.withColumns(
            {
                out: F.lit(None).cast("string"),
                status: F.when(readable, "catalog_unavailable").otherwise("unreadable"),
            }
        )
    exact = catalog.hint(
        exact_names(catalog.names.filter(F.col("side") == side)).select(
            F.col("compact").alias("_compact"), F.col("exact_name").alias("_exact")
        )
    )
    df = df.withColumn("_compact", F.when(readable, P.compact_key(text)))
    df = df.join(exact, "_compact", "left")
    fkey = F.lit(None).cast("string")
    if formation is not None and side == "offense":
        fkey = F.when(F.col(formation) != "", P.compact_key(formation))
    df = df.withColumn("_fkey", fkey)
    open_text = F.when(
        F.col("_exact").isNull() & (F.length("_compact") >= 3), F.col("_compact")
    )
    if catalog.small:
        df = df.withColumn("_fuzzy", _matching_udf(df, catalog, side)(open_text, F.col("_fkey")))
    else:
        df = df.withColumn("_open", open_text)
        lookups = df.select(
            F.col("_open").alias("compact"), F.coalesce("_fkey", F.lit("")).alias("fkey")
        )
        # Both are read several times, also by later checks; without cuts each would compute ``df`` again.
        lookups = cut(lookups.filter(F.col("compact").isNotNull()).distinct())
        found = cut(_match_by_blocks(lookups, catalog, side)).select(
            F.col("compact").alias("_open"), F.col("fkey").alias("_fk"), F.col("fuzzy").alias("_fuzzy")
        )
        df = (
            df.withColumn("_fk", F.coalesce("_fkey", F.lit("")))
            .join(found, ["_open", "_fk"], "left")
            .drop("_open", "_fk")
        )
    return df.withColumns(
        {
            out: F.coalesce(F.upper("_exact"), F.col("_fuzzy")),
            status: F.when(~readable, "unreadable")
            .when(F.col("_exact").isNotNull(), "verified")
            .when(F.col("_fuzzy").isNotNull(), "verified_fuzzy")
            .otherwise("unverified"),
        }
    ).drop("_compact", "_exact", "_fkey", "_fuzzy")


def resolve_calls(
    df: DataFrame,
    catalog: Catalog,
    offense: str,
    defense: str,
    banner: str,
    out: str,
    formation: str | None = None,
) -> DataFrame:
    """Add ``{out}_off``/``{out}_def`` and their statuses for one banner."""
    shown = F.coalesce(F.col(banner), F.lit(False))
    df = df.withColumns(
        {
            "_shown_off": F.when(shown, F.col(offense)),
            "_shown_def": F.when(shown, F.col(defense)),
        }
    )
    df = validate_calls(df, catalog, "_shown_off", "offense", f"{out}_off", formation)
    df = validate_calls(df, catalog, "_shown_def", "defense", f"{out}_def")
    fixed = {}
    for name in (f"{out}_off", f"{out}_def"):
        fixed[name] = F.when(shown, F.col(name)).otherwise(C.BANNER_NOT_SHOWN)
        fixed[f"{name}_status"] = F.when(shown, F.col(f"{name}_status")).otherwise(
            "banner_not_shown"
        )
    return df.withColumns(fixed).drop("_shown_off", "_shown_def")


def only_value(value: str) -> Column:
    """struct(value) when a group holds exactly one distinct value; null counts."""
    values = F.collect_set(F.struct(F.col(value).alias("value")))
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def offense_facts(plays: DataFrame) -> DataFrame:
    """Per normalised offense name: url, play type, unique formation.

    ``by_formation`` maps a formation key to the name's type there, where it has
    just one.
    """
    df = plays.filter(F.col("side") == "offense").select(
        P.normalize_text("play_name").alias("norm"),
        formation_key("formation_family", "formation").alias("fkey"),
        F.struct(
            F.col("formation_family").cast("string").alias("family"),
            F.col("formation").cast("string").alias("formation"),
        ).alias("place"),
        "play_type",
        "source_url",
        "pos",
    )
    typed = (
        df.groupBy("norm", "fkey")
        .agg(only_value("play_type").alias("only"))
        .filter(F.col("only").isNotNull())
        .groupBy("norm")
        .agg(F.map_from_entries(F.collect_list(F.struct("fkey", "only"))).alias("by_formation"))
    )
    facts = df.groupBy("norm").agg(
        F.min_by("source_url", "pos").alias("url"),
        only_value("play_type").alias("only_type"),
        only_value("place").alias("only_place"),
    )
    return facts.join(typed, "norm", "left").select(
        "norm",
        "url",
        "only_type",
        F.concat_ws(" - ", "only_place.value.family", "only_place.value.formation").alias("_place"),
        "by_formation",
        F.col("only_place").isNotNull().alias("_placed"),
    ).select(
        "norm", "url", "only_type", "by_formation",
        F.when(F.col("_placed"), F.col("_place")).alias("unique_formation"),
    )


def defense_urls(plays: DataFrame) -> DataFrame:
    return (
        plays.filter(F.col("side") == "defense")
        .groupBy(P.normalize_text("play_name").alias("norm"))
        .agg(F.min_by("source_url", "pos").alias("url"))
    )


def catalog_play_type(formation: Column) -> Column:
    """Type by formation where that is unique, else by name; needs the facts."""
    here = F.when(
        F.length(formation) > 0,
        F.try_element_at("by_formation", P.compact_key(formation)),
    )
    return F.when(here.isNotNull(), here["value"]).otherwise(F.col("only_type.value"))

"""From clean frames to one summary row per ball spot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapcount import constants as C
from snapcount.functions import text as P
from snapcount.functions.similarity import (
    LETTER_BONUS,
    TOKEN_BONUS,
    UNIT,
    seq_ratio,
    text_consensus,
)
from snapcount.operators import sequence as S
from snapcount.operators.sequence import Sequence
from snapcount.operators.stabilise import FRAMES
from snapcount.session import cut, spread

VOTED = {
    "quarter": "int",
    "down": "int",
    "distance": "int",
    "special_state": "string",
    "yard_line": "int",
    "field_side": "string",
    "stream_side": "string",
    "personnel": "string",
    "formation": "string",
    "away_team": "string",
    "home_team": "string",
    "possession_team": "string",
    "away_score": "int",
    "home_score": "int",
}


def has_anchor() -> Column:
    return F.col("yard_line").isNotNull() | F.col("down").isNotNull() | F.col("special_state").isNotNull()


def with_openings(frames: DataFrame, seq: Sequence = FRAMES) -> DataFrame:
    """Add ``_opens``, whether a frame certainly opens a spot, and what decides it: ``_prior``, the special state and
    score of the anchored frame before, and ``_yard``, the last yard line."""
    special = F.col("special_state")
    score = F.struct("away_score", "home_score")
    df = S.scan(
        frames,
        seq,
        _prior=S.latest(F.when(has_anchor(), F.struct(special.alias("special"), score.alias("score")))),
        _yard=S.latest(F.col("yard_line")),
    )
    prior = F.col("_prior")
    moved = F.coalesce(F.col("yard_line") != F.col("_yard"), F.lit(False))
    opens = (
        F.when(~has_anchor(), False)
        .when(prior.isNull(), True)
        .when(prior.special.isNotNull(), ~prior.special.eqNullSafe(special))
        .otherwise(moved | ~prior.score.eqNullSafe(score))
    )
    return df.withColumn("_opens", opens)


def assign_spots(frames: DataFrame, seq: Sequence = FRAMES) -> DataFrame:
    """Add ``spot``: the order value of the frame that opens the frame's spot.

    Scores must be filled in (see ``stabilize_scores``). Whether a frame opens a
    spot depends on the anchored frame before it, on the last yard line, and on
    the down of the open spot. That down is the latest one read together with a
    yard line since the last certain opening or, without one, the first down
    read since then; so a few ordered lookups decide every frame.
    Unreadable frames go with the next anchored frame; those before the first
    and after the last anchored frame get null.
    """
    order = F.col(seq.order)
    yard, down = F.col("yard_line"), F.col("down")
    df = with_openings(frames, seq)
    df = S.scan(df, seq, _since=S.fill(F.when(F.col("_opens"), order)))

    since = F.col("_since")
    firm = yard.isNotNull() & F.col("_yard").isNotNull() & down.isNotNull()
    loose = has_anchor() & down.isNotNull() & ~firm
    read = F.struct(down.alias("down"), since.alias("since"))
    df = S.scan(
        df,
        seq,
        _firm=S.latest(F.when(firm, read)),
        _loose=S.latest(F.when(loose, read)),
    )
    opening_read = loose & ~F.coalesce(F.col("_loose.since") == since, F.lit(False))
    df = S.scan(df, seq, _first=S.latest(F.when(opening_read, read)))

    spot_down = F.when(F.col("_firm.since") == since, F.col("_firm.down")).when(
        F.col("_first.since") == since, F.col("_first.down")
    )
    new_down = (
        ~F.col("_opens")
        & F.col("_prior.special").isNull()
        & (yard == F.col("_yard"))
        & (down != spot_down)
    )
    opened = F.col("_opens") | F.coalesce(new_down, F.lit(False))
    df = df.withColumn("_opened", has_anchor() & opened)
    df = S.scan(df, seq, _spot=S.fill(F.when(F.col("_opened"), order)))
    df = S.scan(df, seq, _ahead=S.coming(F.when(has_anchor(), F.col("_spot"))))
    spot = F.when(has_anchor(), F.col("_spot")).when(F.col("_spot").isNotNull(), F.col("_ahead"))
    return df.withColumn("spot", spot).drop(
        "_prior", "_yard", "_opens", "_since", "_firm", "_loose", "_first",
        "_opened", "_spot", "_ahead",
    )


def count_alike(
    rows: DataFrame, keys: list[str], position: str, fields: dict[str, str], *more: Column
) -> DataFrame:
    """Rows of a key that are equal in all voted fields, counted, first one noted."""
    return rows.groupBy(*keys, *fields).agg(
        F.count("*").alias("_n"), F.min(position).alias("_first"), *more
    )


def vote_counted(counted: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    votes = F.array(
        *(
            F.struct(F.lit(name).alias("field"), F.col(name).cast("string").alias("value"))
            for name in fields
        )
    )
    totals = (
        counted.select(*keys, "_n", "_first", F.explode(votes).alias("_vote"))
        .filter("_vote.value is not null and _vote.value <> ''")
        .groupBy(*keys, "_vote.field", "_vote.value")
        .agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
    )
    rank = F.struct(F.col("_n"), (-F.col("_first")).alias("_f"))
    return totals.groupBy(*keys).agg(
        *(
            F.max_by("value", F.when(F.col("field") == name, rank)).cast(kind).alias(name)
            for name, kind in fields.items()
        )
    )


def vote_fields(
    rows: DataFrame, keys: list[str], position: str, fields: dict[str, str]
) -> DataFrame:
    """Most frequent non-empty value of each field; ties go to the first seen.

    Equal rows are counted first, so the wide-to-long step sees few rows.
    """
    return vote_counted(count_alike(rows, keys, position, fields), keys, fields)


def consensus_by_key(
    reads: DataFrame, keys: list[str], position: str, text: str
) -> DataFrame:
    """(keys, text): the best-supported text among each key's ordered reads.

    For keys of any length: reads are reduced to their distinct texts with
    counts, and only texts that a length bound cannot rule out are compared
    with the others. Sums are whole numbers, as in ``best_supported``.
    """
    reads = reads.filter(F.col(text).isNotNull() & (F.col(text) != ""))
    counts = (
        reads.withColumn("_clean", P.normalize_text(text))
        .filter(F.col("_clean") != "")
        .groupBy(*keys, "_clean")
        .agg(F.count("*").alias("_n"), F.min(position).alias("_at"))
    )
    # A key of one text, as most are, needs no comparison.
    counts = counts.withColumn("_texts", F.count("*").over(Window.partitionBy(*keys)))
    alone = counts.filter("_texts = 1").select(*keys, F.col("_clean").alias(text))
    many = _consensus_of_counts(counts.filter("_texts > 1").drop("_texts"), keys)
    return alone.unionByName(many.withColumnRenamed("_clean", text))


def _consensus_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Best-supported text from (keys, _clean, _n, _at), without all pairs.

    The ratio of two texts is at most 2*min/(a+b) of their lengths. A text whose
    agreement cannot reach that of the most frequent text even at this bound is
    left out before any two texts are compared.
    """
    words = F.filter(
        F.split("_clean", " "), lambda word: word.isin(*C.CONSENSUS_TOKENS)
    )
    counts = counts.withColumns(
        {
            "_squeezed": F.replace("_clean", F.lit(" "), F.lit("")),
            "_bonus": F.size(words) * F.lit(TOKEN_BONUS).cast("long")
            + F.least(F.length("_clean"), F.lit(24)) * F.lit(LETTER_BONUS).cast("long"),
        }
    ).withColumn("_len", F.length("_squeezed"))
    lengths = counts.groupBy(*keys, "_len").agg(F.sum("_n").alias("_n"))
    ours, theirs = F.col("a._len"), F.col("b._len")
    bound = (
        lengths.alias("a")
        .join(lengths.alias("b"), keys)
        .groupBy(*keys, ours.alias("_len"))
        .agg(
            F.sum(
                F.ceil(2 * F.least(ours, theirs) / (ours + theirs) * UNIT) * F.col("b._n")
            ).alias("_most")
        )
    )

    def agreement(candidates: DataFrame) -> DataFrame:
        others = counts.select(
            *keys, F.col("_squeezed").alias("_other"), F.col("_n").alias("_weight")
        )
        return (
            candidates.join(others, keys)
            .withColumn(
                "_near", F.floor(seq_ratio("_squeezed", "_other") * UNIT + 0.5) * F.col("_weight")
            )
            .groupBy(*keys, "_clean", "_at", "_bonus")
            .agg(F.sum("_near").alias("_sum"))
            .withColumn("_score", F.col("_sum") + F.col("_bonus"))
        )

    leader = counts.groupBy(*keys).agg(
        F.max_by(F.struct("_clean", "_squeezed", "_at", "_bonus"), F.struct("_n", "_bonus")).alias("_top")
    )
    floor = agreement(leader.select(*keys, "_top.*")).select(
        *keys, F.col("_score").alias("_floor")
    )
    candidates = (
        counts.join(bound, [*keys, "_len"])
        .join(floor, keys)
        .filter(F.col("_most") + F.col("_bonus") >= F.col("_floor"))
        .select(*keys, "_clean", "_squeezed", "_at", "_bonus")
    )
    rank = F.struct("_score", F.length("_clean").alias("_l"), (-F.col("_at")).alias("_f"))
    return agreement(candidates).groupBy(*keys).agg(F.max_by("_clean", rank).alias("_clean"))


def summarize_spots(spotted: DataFrame, seq: Sequence = FRAMES) -> DataFrame:
    """One summary per spot: votes, smallest clock, any banner, call consensus.

    Frames of a spot are mostly alike, so they are reduced to their distinct
    votes first; both the votes and the rest are taken from that small table.
    """
    keys = [*seq.keys, "spot"]
    order = seq.order
    bounded = seq.width is None
    calls = {"_prev_off": "prev_off_call", "_prev_def": "prev_def_call"}
    df = spotted.filter(F.col("spot").isNotNull())
    at = F.struct(F.col(order).alias("o"), F.col("timestamp_seconds").alias("t"))
    seconds = P.clock_seconds("game_clock")
    clock = F.struct(seconds.alias("s"), F.col(order).alias("o"), F.col("game_clock").alias("c"))
    more = [
        F.min(at).alias("_from"),
        F.max(at).alias("_to"),
        F.min(F.when(seconds.isNotNull(), clock)).alias("_clock"),
        F.bool_or("previous_play_banner_shown").alias("_banner"),
    ]
    if bounded:
        more += [
            F.collect_list(
                F.when(F.col(c) != "", F.struct(F.col(order).alias("o"), F.col(c).alias("text")))
            ).alias(name)
            for name, c in calls.items()
        ]
    # Read by the votes and by the rest, with different columns; written, so that frames are computed once.
    counted = cut(spread(count_alike(df, keys, order, VOTED, *more), *keys))
    rest = counted.groupBy(*keys).agg(
        F.round(F.min("_from")["t"], 3).alias("start_timestamp_seconds"),
        F.round(F.max("_to")["t"], 3).alias("end_timestamp_seconds"),
        F.min("_clock")["c"].alias("game_clock"),
        F.coalesce(F.bool_or("_banner"), F.lit(False)).alias("_banner_shown"),
        *(
            F.sort_array(F.flatten(F.collect_list(name)))["text"].alias(name)
            for name in calls
            if bounded
        ),
    )
    # A spot without any vote has no row on the right.
    summaries = rest.join(vote_counted(counted, keys, VOTED), keys, "left")
    for name, read in calls.items():
        if bounded:
            summaries = summaries.withColumn(name, text_consensus(name))
        else:
            reads = df.select(*keys, order, F.col(read).alias(name))
            summaries = summaries.join(
                consensus_by_key(reads, keys, order, name), keys, "left"
            )
    return summaries.withColumns(
        {
            "down_distance": P.format_down_distance("down", "distance"),
            "_field_side_observed": F.col("field_side"),
            "_possession_team_observed": F.col("possession_team"),
        }
    ).withColumnsRenamed(
        {"stream_side": "_stream_side", "personnel": "_personnel", "formation": "_formation"}
    )

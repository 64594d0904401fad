"""The whole way from frame states to plays, for many games at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapcount.operators import pairing, repairs, spots, stabilise
from snapcount.operators.catalog import Catalog
from snapcount.operators.evidence import refine_calls
from snapcount.operators.repairs import SUMMARIES
from snapcount.operators.sequence import Sequence
from snapcount.operators.stabilise import FRAMES
from snapcount.session import cut

# A game of more frames than this (11 days at one per second) is cut in chunks.
LONG_GAME = 1_000_000
FRAME_WIDTH = 1 << 17
SUMMARY_WIDTH = 1 << 23


def _sequences(long: bool, frame_width: int, summary_width: int) -> tuple[Sequence, Sequence]:
    if not long:
        return FRAMES, SUMMARIES
    return (
        Sequence(FRAMES.keys, FRAMES.order, frame_width),
        Sequence(SUMMARIES.keys, SUMMARIES.order, summary_width),
    )


def _settle(df: DataFrame, seq: Sequence) -> DataFrame:
    """Between rounds of chunked work, do not compute earlier rounds again.

    Rows of long games are written partitioned by chunk as they already are.
    """
    return cut(df) if seq.width is not None else df


def clean_frames(frames: DataFrame, seq: Sequence = FRAMES) -> DataFrame:
    return stabilise.stabilize_situation(stabilise.stabilize_scores(frames, seq), seq)


def repaired_summaries(
    summaries: DataFrame, catalog: Catalog, seq: Sequence = SUMMARIES
) -> DataFrame:
    """All summary passes, in the order that decides their results."""
    df = repairs.collapse_same_clock(summaries, seq)
    df = repairs.drop_before_special(df, seq)
    df = cut(repairs.backfill_static_and_scores(df, seq))
    df = repairs.repair_downs(df, seq)
    df = repairs.resolve_stream_sides(df, seq)
    df = repairs.resolve_possession(df, seq)
    # Later passes read their rows several times; cut, those are not computed each time.
    df = cut(repairs.propagate(df, "field_side", "game_clock", seq=seq))
    df = _settle(repairs.repair_quarter_and_clock(df, seq), seq)
    df = cut(repairs.collapse_same_clock(df, seq))
    backed = cut(pairing.backed_by_banner(df, catalog))
    columns = seq.unmark(df).columns
    df = cut(repairs.drop_unsupported(backed, F.col("_backed"), seq).select(*columns))
    return seq.unmark(repairs.repair_special_scores(df, seq))


def _summaries(
    frames: DataFrame, catalog: Catalog, frame_seq: Sequence, summary_seq: Sequence
) -> DataFrame:
    clean = _settle(clean_frames(frames, frame_seq), frame_seq)
    spotted = frame_seq.unmark(spots.assign_spots(clean, frame_seq))
    summaries = spots.summarize_spots(_settle(spotted, frame_seq), frame_seq)
    # Later passes use their input more than once; summaries are few, so keep them.
    summaries = cut(summaries.filter(spots.has_anchor()))
    return repaired_summaries(summaries, catalog, summary_seq)


def by_game_length(
    frames: DataFrame, work: Callable[[DataFrame, bool], DataFrame], long_game: int = LONG_GAME
) -> DataFrame:
    """Run ``work(frames, long)`` on short games whole and on long ones in chunks.

    Frames are counted per game first, a pass over one column. Nothing is split
    unless a long game is found.
    """
    long_games = (
        frames.groupBy("game_id").count().filter(F.col("count") > long_game).select("game_id")
    )
    if not long_games.head(1):
        return work(frames, False)
    short = work(frames.join(long_games, "game_id", "left_anti"), False)
    # Few games are this long, so this side is small and its frames stay put.
    long = work(frames.join(long_games, "game_id", "left_semi"), True)
    return short.unionByName(long)


def summaries_from_frames(
    frames: DataFrame,
    catalog: Catalog,
    long_game: int = LONG_GAME,
    frame_width: int = FRAME_WIDTH,
    summary_width: int = SUMMARY_WIDTH,
) -> DataFrame:
    def work(part: DataFrame, long: bool) -> DataFrame:
        return _summaries(part, catalog, *_sequences(long, frame_width, summary_width))

    return by_game_length(frames, work, long_game)


def plays_from_frames(
    frames: DataFrame,
    catalog: Catalog,
    observations: DataFrame | None = None,
    long_game: int = LONG_GAME,
    frame_width: int = FRAME_WIDTH,
    summary_width: int = SUMMARY_WIDTH,
) -> DataFrame:
    """Plays of every game; ``observations`` lets unknown calls be looked up."""

    def work(part: DataFrame, long: bool) -> DataFrame:
        frame_seq, summary_seq = _sequences(long, frame_width, summary_width)
        # The closer look and the checks of calls read the summaries several times.
        df = cut(_summaries(part, catalog, frame_seq, summary_seq))
        if observations is not None:
            df = cut(refine_calls(df, observations, catalog, summary_seq))
        return pairing.pair_plays(df, catalog, summary_seq)

    return by_game_length(frames, work, long_game)

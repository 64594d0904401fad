"""Raw readings to frame states, and choosing which frames to use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcount import constants as C
from snapcount.functions import metrics as M
from snapcount.functions import text as P
from snapcount.operators import sequence as S
from snapcount.operators.sequence import Greedy, Sequence
from snapcount.operators.stabilise import FRAMES


def parse_readings(readings: DataFrame) -> DataFrame:
    """Frame states from raw texts and pixel metrics: one narrow projection."""
    header = P.normalize_text("defense_header_text")
    defending = header.contains("DEFEN") | (header.contains("PICK") & header.contains("PLA"))
    df = readings.withColumns(
        {
            "_dd": P.parse_down_distance("down_distance_text"),
            "_defending": defending,
            "_away": P.parse_team("away_team_text"),
            "_home": P.parse_team("home_team_text"),
            "_visible": M.panel_visible(F.col("panel_dark_ratio"), F.col("panel_edge_density")),
            "_offense_formation": P.canonical_formation("offense_formation_text"),
        }
    )
    defense = F.col("_defending")
    visible = F.col("_visible")
    return df.select(
        "game_id",
        "frame_index",
        "timestamp_seconds",
        P.parse_quarter("quarter_text").alias("quarter"),
        P.parse_clock("clock_text").alias("game_clock"),
        F.col("_dd.down").alias("down"),
        F.col("_dd.distance").alias("distance"),
        P.parse_special_state("down_distance_text").alias("special_state"),
        P.parse_yard("yard_text").alias("yard_line"),
        M.field_side(F.col("field_side_row_counts")).alias("field_side"),
        F.when(defense, "defense")
        .when(F.col("_offense_formation").isNotNull(), "offense")
        .alias("stream_side"),
        F.when(defense, P.parse_personnel("defense_personnel_text")).alias("personnel"),
        F.when(defense, P.canonical_formation("defense_formation_text"))
        .otherwise(F.col("_offense_formation"))
        .alias("formation"),
        F.col("_away").alias("away_team"),
        F.col("_home").alias("home_team"),
        M.possession_team(
            F.col("possession_away_ratio"), F.col("possession_home_ratio"),
            F.col("_away"), F.col("_home"),
        ).alias("possession_team"),
        P.parse_int("away_score_text").alias("away_score"),
        P.parse_int("home_score_text").alias("home_score"),
        visible.alias("previous_play_banner_shown"),
        F.when(visible, P.clean_call("prev_def_text")).alias("prev_def_call"),
        F.when(visible, P.clean_call("prev_off_text")).alias("prev_off_call"),
    )


def banner_observations(readings: DataFrame) -> DataFrame:
    """The banner's own rows, for a closer look at unknown calls."""
    return readings.select(
        "game_id",
        "timestamp_seconds",
        P.clean_call("prev_off_text").alias("off_text"),
        P.clean_call("prev_def_text").alias("def_text"),
        P.previous_play_heading("heading_text").alias("heading"),
        M.panel_visible(F.col("panel_dark_ratio"), F.col("panel_edge_density")).alias(
            "panel_visible"
        ),
    )


def visibility() -> Column:
    text = F.concat_ws(" ", "clock_text", "down_distance_text")
    return M.scoreboard_visibility(
        F.col("edge_density"), F.col("dark_ratio"), F.col("bright_ratio"), text
    )


def filter_visible(
    readings: DataFrame, least: float, score: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(kept rows, (game_id, kept, skipped) counts)."""
    seen = (visibility() if score is None else score) >= least
    counts = readings.groupBy("game_id").agg(
        F.count_if(seen).alias("kept"), F.count_if(~seen).alias("skipped")
    )
    return readings.filter(seen), counts


def sample_frames(
    frames: DataFrame,
    every: int,
    fps: float = 30.0,
    start_seconds: float = 0.0,
    max_seconds: float | None = None,
    max_frames: int | None = None,
) -> DataFrame:
    """Every n-th relative frame, with absolute index and timestamp.

    The frame limit takes the first kept rows of each game, also where numbers
    are missing. Rows must be numbered from 0.
    """
    fps = fps if fps > 0 else 30.0
    relative = F.col("relative_index")
    kept = frames.filter(relative % every == 0)
    if max_seconds is not None:
        kept = kept.filter((F.lit(start_seconds) + relative / fps) - start_seconds <= max_seconds)
    if max_frames is not None:
        kept = first_rows(kept, max_frames, Sequence(FRAMES.keys, "relative_index"))
    return kept.withColumns(
        {
            "frame_index": relative + round(start_seconds * fps),
            "timestamp_seconds": F.lit(start_seconds) + relative / F.lit(fps),
        }
    )


def first_rows(df: DataFrame, count: int, seq: Sequence = FRAMES) -> DataFrame:
    """The first ``count`` rows per key."""
    df = S.scan(df, seq, _row=S.running_sum(F.lit(1)))
    return seq.unmark(df.filter(F.col("_row") <= count).drop("_row"))


def evenly_spaced(df: DataFrame, most: int = 6, seq: Sequence = FRAMES) -> DataFrame:
    """At most ``most`` rows per key, spread evenly from first to last."""
    df = S.scan(df, seq, _row=S.running_sum(F.lit(1)))
    sizes = df.groupBy(*seq.keys).agg(F.count("*").alias("_n"))
    k = F.least(F.col("_n"), F.lit(most))
    picks = sizes.withColumn(
        "_row",
        F.explode(
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(0).cast("bigint"), k - 1),
                    lambda i: F.floor(i * (F.col("_n") - 1) / F.greatest(k - 1, F.lit(1))) + 1,
                )
            )
        ),
    ).drop("_n")
    return seq.unmark(df.join(picks, [*seq.keys, "_row"], "left_semi").drop("_row"))


def median_regions(
    detections: DataFrame, keys: list[str], default: tuple[float, float, float, float]
) -> DataFrame:
    """Median of each coordinate per key; the default where none was detected."""
    return detections.groupBy(*keys).agg(
        *(
            F.coalesce(F.median(c), F.lit(value)).alias(c)
            for c, value in zip(("x", "y", "w", "h"), default)
        )
    )


def discover_layout(
    frames: DataFrame, detections: DataFrame, most: int = 6, defaults: dict[str, tuple] = C.DEFAULT_REGIONS
) -> DataFrame:
    """(game_id, region, x, y, w, h): where each region lies in each game of ``frames``.

    Detections (game_id, frame_index, region, x, y, w, h) count on at most ``most`` frames of a game, spread evenly
    from first to last; the median of each coordinate is exact, over no more rows than that. A region without any
    gets its default, null coordinates are left out, and a region that has no default does not appear.
    """
    sampled = evenly_spaced(frames.select("game_id", "frame_index"), most)
    keys = ["game_id", "region"]
    places = [
        F.struct(F.lit(name).alias("region"), *(F.lit(float(v)).alias(f"_{c}") for c, v in zip("xywh", values, strict=True)))
        for name, values in defaults.items()
    ]
    wanted = frames.select("game_id").distinct().select("game_id", F.explode(F.array(*places)).alias("_d")).select("game_id", "_d.*")
    seen = detections.join(sampled, ["game_id", "frame_index"], "left_semi")
    found = seen.groupBy(*keys).agg(*(F.median(c).alias(c) for c in "xywh"))
    return wanted.join(found, keys, "left").select(*keys, *(F.coalesce(c, f"_{c}").alias(c) for c in "xywh"))


def play_boundaries(
    frames: DataFrame,
    threshold: float = C.BOUNDARY_THRESHOLD,
    gap: int = C.BOUNDARY_GAP,
    seq: Sequence = FRAMES,
) -> DataFrame:
    """Frames that differ enough, at least ``gap`` samples after the last kept one.

    Only candidate rows go through the ordered fold.
    """
    df = S.scan(frames, seq, _at=S.running_sum(F.lit(1).cast("bigint")))
    hits = df.filter((F.col("_at") > 1) & (F.col("diff_score") >= threshold)).select(
        *seq.parts, seq.order, (F.col("_at") - 1).alias("_at"), "timestamp_seconds", "diff_score"
    )
    keep = [seq.order, "timestamp_seconds", "diff_score"]
    return S.fold(
        hits,
        seq,
        Greedy(gap, "_at", keep),
        f"{seq.order} bigint, timestamp_seconds double, diff_score double",
    )


__all__ = [
    "banner_observations", "discover_layout", "evenly_spaced", "filter_visible", "first_rows",
    "median_regions", "parse_readings", "play_boundaries", "sample_frames", "visibility",
]

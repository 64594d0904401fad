"""Summaries to plays: pair neighbours, resolve calls, classify, number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcount import constants as C
from snapcount.functions import plays as R
from snapcount.functions import text as P
from snapcount.operators import catalog as K
from snapcount.operators import sequence as S
from snapcount.operators.catalog import Catalog
from snapcount.operators.repairs import SUMMARIES
from snapcount.operators.sequence import Sequence

EVIDENCE = ("_prev_off_evidence", "_prev_def_evidence", "_banner_heading_evidence")


def backed_by_banner(summaries: DataFrame, catalog: Catalog) -> DataFrame:
    """Add ``_backed``: the shown banner holds a call the catalog knows."""
    df = K.resolve_calls(
        summaries, catalog, "_prev_off", "_prev_def", "_banner_shown", "_own"
    )
    known = F.coalesce("_own_off", "_own_def").isNotNull()
    shown = F.coalesce("_banner_shown", F.lit(False))
    return df.withColumn("_backed", shown & known)


def number_rows(df: DataFrame, seq: Sequence, name: str, keep: Column | None = None) -> DataFrame:
    """0, 1, 2, ... per key in order, over all rows or those with ``keep``."""
    one = F.lit(1) if keep is None else F.when(keep, 1).otherwise(0)
    df = S.scan(df, seq, **{name: S.running_sum(one)})
    number = (F.col(name) - 1).cast("int")
    return df.withColumn(name, number if keep is None else F.when(keep, number))


def pair_plays(
    summaries: DataFrame, catalog: Catalog, seq: Sequence = SUMMARIES
) -> DataFrame:
    """One row per play: the change from a summary to the next one.

    The call of a play is on the banner shown with the next summary. It is
    checked once more here, offense names limited by the play's formation.
    """
    empty = F.array().cast("array<string>")
    df = summaries.withColumns(
        {n: F.coalesce(F.col(n), empty) if n in summaries.columns else empty for n in EVIDENCE}
    )
    df = backed_by_banner(df, catalog)
    prev_fields = [
        "start_timestamp_seconds", "quarter", "game_clock", "away_team", "away_score",
        "home_team", "home_score", "down", "distance", "down_distance", "yard_line",
        "special_state", "_stream_side", "possession_team", "_possession_team_observed",
        "field_side", "_field_side_observed", "_personnel", "_formation", "_own_off",
        "_own_def",
    ]
    df = S.scan(df, seq, prev=S.before(F.struct(*prev_fields)))
    eligible = F.col("prev.down").isNotNull() | F.col("prev.special_state").isNotNull()
    df = df.filter(eligible).withColumn("_formation_before", F.col("prev._formation"))
    df = K.validate_calls(
        df.withColumn("_shown_off", F.when(F.col("_banner_shown"), F.col("_prev_off"))),
        catalog,
        "_shown_off",
        "offense",
        "_with_formation",
        "_formation_before",
    ).drop("_shown_off")
    df = df.withColumn(
        "cur",
        F.struct(
            "down", "distance", "yard_line", "away_score", "home_score", "special_state",
            "field_side",
        ),
    )
    prev, cur = F.col("prev"), F.col("cur")
    shown = F.coalesce("_banner_shown", F.lit(False))

    turnover = F.coalesce((prev["down"] == 4) & (cur["down"] == 1), F.lit(False))
    possession_boundary = (
        F.coalesce(prev["possession_team"] != F.col("possession_team"), F.lit(False)) | turnover
    )
    scoring_boundary = (R.score_delta(prev, cur, "away") >= 3) | (
        R.score_delta(prev, cur, "home") >= 3
    )
    off_status = F.when(shown, F.col("_with_formation_status")).otherwise("banner_not_shown")
    hidden = (
        (possession_boundary | scoring_boundary)
        & off_status.isin(*C.UNSUPPORTED_STATUSES)
        & F.col("_own_def_status").isin(*C.UNSUPPORTED_STATUSES)
    )
    absent = hidden | ~shown
    df = df.withColumns(
        {
            "_boundary": possession_boundary,
            "_banner": shown & ~hidden,
            "_off": F.when(absent, C.BANNER_NOT_SHOWN).otherwise(F.col("_with_formation")),
            "_def": F.when(absent, C.BANNER_NOT_SHOWN).otherwise(F.col("_own_def")),
            "_off_status": F.when(hidden, "banner_not_shown").otherwise(off_status),
            "_def_status": F.when(hidden, "banner_not_shown").otherwise(F.col("_own_def_status")),
        }
    )
    df = (
        df.withColumn("norm", P.normalize_text("_off"))
        .join(catalog.hint(K.offense_facts(catalog.plays)), "norm", "left")
        .withColumnRenamed("url", "_off_url")
        .withColumn("norm", P.normalize_text("_def"))
        .join(catalog.hint(K.defense_urls(catalog.plays)), "norm", "left")
        .withColumnRenamed("url", "_def_url")
        .drop("norm")
    )
    return _play_columns(df, catalog.label, seq)


def _play_columns(df: DataFrame, label: str, seq: Sequence) -> DataFrame:
    prev, cur = F.col("prev"), F.col("cur")
    pat = F.coalesce(prev["special_state"] == "extra_point", F.lit(False))
    kickoff = F.coalesce(prev["special_state"] == "kickoff", F.lit(False))
    special = pat | kickoff
    none = F.lit(None).cast("string")
    label = f"{label}_" if label else ""
    observed_formation = F.col("_formation_before")
    has_formation = F.coalesce(observed_formation != "", F.lit(False))
    play_type = (
        F.when(pat, "extra_point")
        .when(kickoff, "kickoff")
        .otherwise(
            F.coalesce(
                F.nullif(K.catalog_play_type(observed_formation), F.lit("")),
                P.infer_play_type("_off"),
            )
        )
    )
    df = df.withColumns(
        {
            "play_type": play_type,
            "possession_change": F.col("_boundary") | kickoff,
            "offensive_play_call": F.when(pat, "PAT Kick")
            .when(kickoff, "Kickoff")
            .otherwise(F.col("_off")),
            "defensive_play_call": F.when(special, none).otherwise(F.col("_def")),
            "offensive_play_call_validation": F.when(special, "special_state").otherwise(
                F.col("_off_status")
            ),
            "defensive_play_call_validation": F.when(special, "not_applicable").otherwise(
                F.col("_def_status")
            ),
            "offensive_play_call_catalog_match": F.when(~special, F.col("_off")),
            "defensive_play_call_catalog_match": F.when(~special, F.col("_def")),
            "offensive_play_call_catalog_url": F.when(~special, F.col("_off_url")),
            "defensive_play_call_catalog_url": F.when(~special, F.col("_def_url")),
        }
    )
    df = df.withColumns(
        {
            "_result": R.play_result(prev, cur, F.col("play_type"), F.col("possession_change")),
            "_quality": R.quality(
                prev,
                cur,
                F.col("play_type"),
                F.col("offensive_play_call_validation"),
                F.col("defensive_play_call_validation"),
                F.col("_banner"),
            ),
        }
    )
    formation = F.when(has_formation, observed_formation).otherwise(F.col("unique_formation"))
    own_possession = prev["_possession_team_observed"].eqNullSafe(prev["possession_team"])
    out = {
        "start_timestamp_seconds": prev["start_timestamp_seconds"],
        "end_timestamp_seconds": F.col("start_timestamp_seconds"),
        **{
            name: prev[name]
            for name in (
                "quarter", "game_clock", "away_team", "away_score", "home_team", "home_score",
                "down", "distance", "down_distance", "yard_line", "possession_team",
                "field_side",
            )
        },
        "yard_line_observed": prev["yard_line"],
        "yard_line_provenance": F.lit("scoreboard_ocr_consensus"),
        "stream_side": prev["_stream_side"],
        "possession_team_observed": prev["_possession_team_observed"],
        "possession_team_provenance": F.when(own_possession, "possession_marker").otherwise(
            "football_state_transition"
        ),
        "field_side_observed": prev["_field_side_observed"],
        "field_side_provenance": F.when(
            prev["_field_side_observed"].isNotNull(), "scoreboard_direction_indicator"
        ).otherwise("forward_propagation"),
        "personnel": prev["_personnel"],
        "formation_observed": observed_formation,
        "formation": formation,
        "formation_provenance": F.when(has_formation, "play_selection_ocr")
        .when(formation != "", f"{label}unique_play_formation")
        .otherwise("unavailable"),
        "previous_offensive_play_call": prev["_own_off"],
        "previous_defensive_play_call": prev["_own_def"],
        "previous_play_banner_shown": F.col("_banner"),
        "offensive_play_call_ocr": F.col("_prev_off"),
        "defensive_play_call_ocr": F.col("_prev_def"),
        "offensive_play_call_evidence_count": F.size("_prev_off_evidence"),
        "defensive_play_call_evidence_count": F.size("_prev_def_evidence"),
        "offensive_play_call_evidence": F.col("_prev_off_evidence"),
        "defensive_play_call_evidence": F.col("_prev_def_evidence"),
        "previous_play_heading_evidence": F.col("_banner_heading_evidence"),
        "result": F.col("_result.result"),
        "yards_gained": F.col("_result.yards_gained"),
        "end_down_distance": F.col("down_distance"),
        "end_yard_line": cur["yard_line"],
        **{
            name: F.col(f"_quality.{name}")
            for name in (
                "situation_confidence", "call_confidence", "result_confidence",
                "overall_confidence", "result_provenance",
            )
        },
        "situation_provenance": F.lit("scoreboard_ocr+stabilized_state_transition"),
        "call_provenance": F.when(
            F.col("_banner"), f"previous_play_banner+{label}catalog"
        ).otherwise("previous_play_banner_not_shown"),
        "transition_evidence": R.evidence_reasons(prev, cur, F.col("_backed")),
        "end_away_score": cur["away_score"],
        "end_home_score": cur["home_score"],
        "end_special_state": cur["special_state"],
        "end_possession_team": F.col("possession_team"),
    }
    kept = [
        "play_type", "possession_change", "offensive_play_call", "defensive_play_call",
        *(f"{side}_play_call_{what}" for side in ("offensive", "defensive")
          for what in ("validation", "catalog_match", "catalog_url")),
    ]
    df = df.select(
        *seq.keys,
        *([S.CHUNK] if S.CHUNK in df.columns else []),
        seq.order,
        *(column.alias(name) for name, column in out.items()),
        *kept,
    )
    df = number_rows(df, seq, "play_number")
    df = df.withColumn(
        "description",
        R.describe(
            F.col("quarter"), F.col("game_clock"), F.col("down_distance"), F.col("yard_line"),
            F.col("offensive_play_call"), F.col("defensive_play_call"), F.col("result"),
            F.col("end_down_distance"), F.col("end_yard_line"),
        ),
    )
    return seq.unmark(df)


PLAYS = Sequence(("game_id",), "play_number")


def has_game_state_anchor() -> Column:
    def named(call: str) -> Column:
        return F.coalesce(F.col(call) != "", F.lit(False))

    return (
        (F.col("down").isNotNull() & F.col("distance").isNotNull())
        | named("offensive_play_call")
        | named("defensive_play_call")
    )


def renumber_anchored(plays: DataFrame, seq: Sequence = PLAYS) -> DataFrame:
    """Plays with a situation or a call, counted anew as ``csv_play_number``."""
    kept = plays.filter(has_game_state_anchor())
    return seq.unmark(number_rows(kept, seq, "csv_play_number"))


def until_possession_change(
    plays: DataFrame, team: str = "possession_team", seq: Sequence = PLAYS
) -> DataFrame:
    """Plays up to the first one of another team than the first known one."""
    known = F.when(F.col(team) != "", F.struct(F.col(seq.order).alias("o"), F.col(team).alias("t")))
    df = S.scan(plays, seq, _first=S.whole_min(known))
    other = F.coalesce((F.col(team) != "") & (F.col(team) != F.col("_first.t")), F.lit(False))
    df = S.scan(df.withColumn("_other", other), seq, _gone=S.running_sum(F.col("_other").cast("int")))
    kept = df.filter(F.col("_gone") == 0).drop("_first", "_other", "_gone")
    return seq.unmark(kept)


def final_scores(plays: DataFrame) -> DataFrame:
    """Score of each game's last play: where it ended, else where it began."""
    last = F.max_by(
        F.struct(
            "home_team",
            F.coalesce("end_home_score", "home_score").alias("home_score"),
            F.coalesce("end_away_score", "away_score").alias("away_score"),
            "away_team",
        ),
        "play_number",
    )
    return plays.groupBy("game_id").agg(last.alias("_last")).select("game_id", "_last.*")


__all__ = [
    "PLAYS",
    "backed_by_banner",
    "final_scores",
    "has_game_state_anchor",
    "pair_plays",
    "renumber_anchored",
    "until_possession_change",
]

"""Quality and catalog-validation reports over plays, one set per game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcount import constants as C
from snapcount.functions import text as P
from snapcount.operators.catalog import Catalog

CLAIMED = {
    "previous_offensive_play_call": "offense",
    "previous_defensive_play_call": "defense",
    "offensive_play_call": "offense",
    "defensive_play_call": "defense",
}
STATUSES = ("offensive_play_call_validation", "defensive_play_call_validation")
CONFIDENCES = (
    "situation_confidence", "call_confidence", "result_confidence", "overall_confidence",
)


class NonCatalogCallsError(RuntimeError):
    """Plays claim calls that the catalog does not hold."""


def _long(plays: DataFrame, names: tuple[str, ...], *keep: str) -> DataFrame:
    cells = F.array(
        *(F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in names)
    )
    return plays.select(*keep, F.explode(cells).alias("_cell")).select(*keep, "_cell.*")


def duplicate_intervals(plays: DataFrame) -> DataFrame:
    return (
        plays.groupBy("game_id", "start_timestamp_seconds", "end_timestamp_seconds")
        .agg(F.count("*").alias("plays"))
        .filter(F.col("plays") > 1)
    )


def possession_anomalies(plays: DataFrame) -> DataFrame:
    """Plays whose team is neither of the two on the scoreboard."""
    team = F.col("possession_team")
    known = team.eqNullSafe(F.col("away_team")) | team.eqNullSafe(F.col("home_team"))
    return plays.filter(team.isNotNull() & ~known).select(
        "game_id", "play_number", "possession_team"
    )


def low_confidence(plays: DataFrame, below: float = C.LOW_CONFIDENCE) -> DataFrame:
    return plays.filter(F.coalesce("overall_confidence", F.lit(0.0)) < below).select(
        "game_id", "play_number", "overall_confidence", "description"
    )


def missing_fields(plays: DataFrame) -> DataFrame:
    """(game_id, field, plays) for required fields that some plays lack."""
    cells = _long(plays, C.REQUIRED_PLAY_FIELDS, "game_id")
    return (
        cells.filter("value is null or value = ''")
        .groupBy("game_id", "field")
        .agg(F.count("*").alias("plays"))
    )


def value_counts(plays: DataFrame, column: str) -> DataFrame:
    value = F.coalesce(F.nullif(column, F.lit("")), F.lit("unknown")).alias("value")
    return plays.groupBy("game_id", value).agg(F.count("*").alias("plays"))


def evidence_counts(plays: DataFrame) -> DataFrame:
    reasons = plays.select("game_id", F.explode("transition_evidence").alias("value"))
    return reasons.groupBy("game_id", "value").agg(F.count("*").alias("plays"))


def confidence_averages(plays: DataFrame) -> DataFrame:
    return plays.groupBy("game_id").agg(
        *(F.round(F.avg(F.coalesce(n, F.lit(0.0))), 3).alias(n) for n in CONFIDENCES)
    )


def _cell(section: str, item: Column, **values: Column) -> Column:
    """One play's part in one item of a report: rows to count, and what to average or keep."""
    return F.struct(
        F.lit(section).alias("section"),
        item.cast("string").alias("item"),
        *(values.get(name, F.lit(None)).cast("double").alias(name) for name in ("kept", "averaged")),
    )


def quality_report(plays: DataFrame) -> DataFrame:
    """All parts as (game_id, section, item, value) rows.

    Long, not one nested row per game, so that a report grows in rows. One pass: each play becomes its cells, which are
    summed before they meet. An item is a count of its cells, an average of them, or a value of one play.
    """
    interval = F.concat_ws(" - ", "start_timestamp_seconds", "end_timestamp_seconds")
    team, number = F.col("possession_team"), F.col("play_number")
    known = team.eqNullSafe(F.col("away_team")) | team.eqNullSafe(F.col("home_team"))
    doubtful = F.coalesce("overall_confidence", F.lit(0.0)) < C.LOW_CONFIDENCE

    def counted(name: str) -> Column:
        return F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))

    def lacks(name: str) -> Column:
        return F.col(name).isNull() | (F.col(name).cast("string") == "")

    cells = F.array(
        _cell("plays", F.lit("plays")),
        _cell("duplicate_intervals", interval),
        F.when(team.isNotNull() & ~known, _cell("possession_anomaly_plays", number, kept=F.lit(1))),
        F.when(doubtful, _cell("low_confidence_plays", number, kept=F.col("overall_confidence"))),
        *(F.when(lacks(n), _cell("missing_required_fields", F.lit(n))) for n in C.REQUIRED_PLAY_FIELDS),
        _cell("play_type_counts", counted("play_type")),
        _cell("result_counts", counted("result")),
        *(_cell("confidence_averages", F.lit(n), averaged=F.coalesce(n, F.lit(0.0))) for n in CONFIDENCES),
    )
    reasons = F.transform(
        F.coalesce("transition_evidence", F.array().cast("array<string>")),
        lambda reason: _cell("transition_evidence_counts", reason),
    )
    # Plays listed one by one stay one by one, also where numbers repeat.
    alone = F.when(F.col("section").isin("possession_anomaly_plays", "low_confidence_plays"), F.col("kept"))
    return (
        plays.select("game_id", F.explode(F.concat(F.array_compact(cells), reasons)).alias("_c"))
        .select("game_id", "_c.*")
        .groupBy("game_id", "section", "item", alone.alias("kept"))
        .agg(F.count("*").alias("_n"), F.round(F.avg("averaged"), 3).alias("_average"))
        .filter((F.col("section") != "duplicate_intervals") | (F.col("_n") > 1))
        .withColumn("_listed", F.col("section").isin("possession_anomaly_plays", "low_confidence_plays"))
        .select(
            "game_id",
            "section",
            "item",
            F.when(F.col("_listed"), F.col("kept")).otherwise(F.coalesce("_average", "_n")).alias("value"),
            F.explode(F.when(F.col("_listed"), F.sequence(F.lit(1), F.col("_n"))).otherwise(F.array(F.lit(1)))).alias("_"),
        )
        .drop("_")
    )


def _claims(plays: DataFrame) -> DataFrame:
    cells = _long(plays, tuple(CLAIMED), "game_id", "play_number", "play_type")
    empty = F.col("value").isNull() | F.col("value").isin("", C.BANNER_NOT_SHOWN)
    return cells.filter(~empty)


def non_catalog_calls(plays: DataFrame, catalog: Catalog) -> DataFrame:
    """Claimed calls that are not in the catalog; special plays may name themselves."""
    side = F.lit(None).cast("string")
    for field, name in CLAIMED.items():
        side = F.when(F.col("field") == field, name).otherwise(side)
    special = (
        (F.col("field") == "offensive_play_call")
        & F.col("value").isin("PAT Kick", "Kickoff")
        & F.coalesce(F.col("play_type").isin("extra_point", "kickoff"), F.lit(False))
    )
    known = catalog.names.select("side", P.normalize_text("play_name").alias("norm")).distinct()
    return (
        _claims(plays)
        .filter(~special)
        .withColumns({"side": side, "norm": P.normalize_text("value")})
        .join(catalog.hint(known), ["side", "norm"], "left_anti")
        .select("game_id", "play_number", "field", "value")
    )


def first_violations(plays: DataFrame, catalog: Catalog, limit: int = 10) -> DataFrame:
    return (
        non_catalog_calls(plays, catalog).orderBy("game_id", "play_number", "field").limit(limit)
    )


def assert_catalog_calls(plays: DataFrame, catalog: Catalog) -> None:
    """Raise with the first ten violations, if there are any."""
    found = first_violations(plays, catalog).collect()
    if found:
        detail = "; ".join(f"{r.game_id} play {r.play_number} {r.field}={r.value!r}" for r in found)
        raise NonCatalogCallsError(f"Non-catalog play calls cannot be written: {detail}")


def status_counts(plays: DataFrame) -> DataFrame:
    cells = _long(plays, STATUSES, "game_id")
    value = F.coalesce(F.nullif("value", F.lit("")), F.lit("missing")).alias("status")
    return cells.groupBy("game_id", value).agg(F.count("*").alias("cells"))


def validation_report(plays: DataFrame, catalog: Catalog) -> DataFrame:
    """Per game: plays, claimed cells, unverified cells, claims not in the catalog."""
    claims = _claims(plays).groupBy("game_id").agg(F.count("*").alias("claimed_call_cells"))
    wrong = (
        non_catalog_calls(plays, catalog)
        .groupBy("game_id")
        .agg(F.count("*").alias("non_catalog_claimed_calls"))
    )
    unverified = F.lit(0)
    for name in STATUSES:
        bad = F.coalesce(F.col(name).isin(*C.UNSUPPORTED_STATUSES), F.lit(False))
        unverified = unverified + bad.cast("int")
    games = plays.groupBy("game_id").agg(
        F.count("*").alias("plays"), F.sum(unverified).alias("unverified_ocr_cells")
    )
    zero = F.lit(0).cast("bigint")
    return (
        games.join(claims, "game_id", "left")
        .join(wrong, "game_id", "left")
        .select(
            "game_id",
            "plays",
            F.coalesce("claimed_call_cells", zero).alias("claimed_call_cells"),
            "unverified_ocr_cells",
            F.coalesce("non_catalog_claimed_calls", zero).alias("non_catalog_claimed_calls"),
            F.col("non_catalog_claimed_calls").isNull().alias("all_claimed_calls_in_catalog"),
        )
    )

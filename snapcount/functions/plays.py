"""Rules over a pair of neighbouring summaries, as column expressions.

``prev`` and ``cur`` are struct columns of two summaries in a row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapcount import constants as C

SPECIAL_TYPES = ("extra_point", "kickoff")


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def score_delta(prev: Column, cur: Column, side: str) -> Column:
    def points(row: Column) -> Column:
        return F.coalesce(row[f"{side}_score"], F.lit(0))

    return points(cur) - points(prev)


def evidence_reasons(prev: Column, cur: Column, backed: Column) -> Column:
    """Ordered reasons to believe that a play lies between two summaries.

    With both downs read, a banner is no evidence.
    """
    special = prev["special_state"].isNotNull() | cur["special_state"].isNotNull()
    scored = _yes(prev["away_score"] != cur["away_score"]) | _yes(
        prev["home_score"] != cur["home_score"]
    )
    both = prev["down"].isNotNull() & cur["down"].isNotNull()
    progression = F.when(cur["down"] == prev["down"] + 1, "legal_down_progression").when(
        cur["down"] == 1, "first_down_or_possession_transition"
    )
    return F.array_compact(
        F.array(
            F.when(special, "special_state"),
            F.when(scored, "score_change"),
            F.when(both, progression).when(
                _yes(backed), "validated_previous_play_banner"
            ),
        )
    )


def play_result(
    prev: Column, cur: Column, play_type: Column, possession_change: Column
) -> Column:
    """struct(yards_gained, result): the first rule that fits decides."""
    away, home = score_delta(prev, cur, "away"), score_delta(prev, cur, "home")
    down, next_down = prev["down"], cur["down"]
    start, end = prev["yard_line"], cur["yard_line"]
    side = prev["field_side"]
    advanced = _yes(next_down == down + 1)

    gained = F.when(
        advanced & prev["distance"].isNotNull() & cur["distance"].isNotNull(),
        prev["distance"] - cur["distance"],
    ).otherwise(F.abs(end - start))
    moved = _yes(gained != 0)
    text = gained.cast("string")
    nothing = F.lit(None).cast("int")

    def outcome(result: Column | str, yards: Column = gained) -> Column:
        result = F.lit(result) if isinstance(result, str) else result
        return F.struct(yards.cast("int").alias("yards_gained"), result.alias("result"))

    returned = F.when(
        (F.length(cur["field_side"]) > 0) & end.isNotNull(),
        F.concat(
            F.lit("kickoff returned to "), cur["field_side"], F.lit(" "), end.cast("string")
        ),
    ).otherwise("kickoff")
    touchdown_yards = (
        F.when(_yes(side == "opponent") & start.isNotNull(), start)
        .when(_yes(side == "own") & start.isNotNull(), 100 - start)
        .otherwise(gained)
    )
    next_series = (
        F.when(gained.isNull(), "short gain")
        .when(
            gained > 0,
            F.when(play_type == "pass", F.concat(text, F.lit("-yard completion")))
            .when(play_type == "run", F.concat(text, F.lit("-yard gain")))
            .otherwise(F.concat(F.lit("gain of "), text)),
        )
        .when(
            gained == 0,
            F.when(play_type == "pass", "incomplete pass").otherwise("no gain"),
        )
        .otherwise(F.concat(F.abs(gained).cast("string"), F.lit("-yard loss")))
    )
    first_down = F.when(
        moved, F.concat(text, F.lit("-yard gain / first down"))
    ).otherwise("first down")
    point = (away == 1) | (home == 1)
    return (
        F.when(
            _yes(play_type == "extra_point"),
            outcome(
                F.when(point, "extra point good").otherwise("extra point attempt"), nothing
            ),
        )
        .when(_yes(play_type == "kickoff"), outcome(returned, nothing))
        .when(
            _yes(possession_change & (down == 4) & (next_down == 1)),
            outcome("turnover on downs", F.when(start.eqNullSafe(end), 0).otherwise(gained)),
        )
        .when((away >= 6) | (home >= 6), outcome("touchdown", touchdown_yards))
        .when(away.isin(2, 3) | home.isin(2, 3), outcome("field goal good", nothing))
        .when(
            _yes(next_down == 1)
            & (cur["distance"].isNull() | (cur["distance"] == 10)),
            outcome(first_down),
        )
        .when(advanced, outcome(next_series))
        .when(_yes(next_down == down), outcome("no gain / incomplete / penalty"))
        .when(moved, outcome(F.concat(F.lit("gain of "), text)))
        .otherwise(outcome("play run"))
    )


def _count_known(*values: Column) -> Column:
    total = F.lit(0)
    for value in values:
        total = total + value.isNotNull().cast("int")
    return total


def quality(
    prev: Column,
    cur: Column,
    play_type: Column,
    off_status: Column,
    def_status: Column,
    banner: Column,
) -> Column:
    """struct of three confidences, their mean, and the result's provenance."""
    special = _yes(play_type.isin(*SPECIAL_TYPES))
    always = _count_known(
        *(
            prev[name]
            for name in (
                "quarter", "game_clock", "away_team", "home_team", "away_score",
                "home_score", "possession_team",
            )
        )
    )
    ordinary = _count_known(prev["down"], prev["distance"], prev["yard_line"])
    situation = F.when(special, always / F.lit(7)).otherwise((always + ordinary) / F.lit(10))

    def worth(status: Column) -> Column:
        score = F.lit(0.0)
        for name, value in C.STATUS_SCORES.items():
            score = F.when(status == name, value).otherwise(score)
        return score

    call = (worth(off_status) + worth(def_status)) / 2
    scored = (score_delta(prev, cur, "away") != 0) | (score_delta(prev, cur, "home") != 0)
    by_down = prev["down"].isNotNull() & cur["down"].isNotNull()
    result = (
        F.when(special | scored, 1.0)
        .when(by_down, 0.85)
        .when(_yes(banner), 0.65)
        .otherwise(0.4)
    )
    provenance = (
        F.when(special | scored, "scoreboard_score+special_state")
        .when(by_down, "scoreboard_down_distance_transition")
        .when(_yes(banner), "yard_line+validated_previous_play_banner")
        .otherwise("yard_line_transition_only")
    )
    return F.struct(
        F.round(situation, 3).alias("situation_confidence"),
        F.round(call, 3).alias("call_confidence"),
        F.round(result, 3).alias("result_confidence"),
        F.round((situation + call + result) / 3, 3).alias("overall_confidence"),
        provenance.alias("result_provenance"),
    )


def _filled(value: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(value, F.lit(""))


def describe(
    quarter: Column,
    clock: Column,
    down_distance: Column,
    yard_line: Column,
    offense: Column,
    defense: Column,
    result: Column,
    end_down_distance: Column,
    end_yard_line: Column,
) -> Column:
    """One sentence per play."""

    def at(yard: Column) -> Column:
        return F.concat(F.lit("at the "), yard.cast("string"))

    header = F.concat_ws(
        " ",
        F.when(quarter != 0, F.concat(F.lit("Q"), quarter.cast("string"))),
        _filled(clock),
    )
    where = F.concat_ws(" ", _filled(down_distance), at(yard_line))
    call = F.concat(
        F.coalesce(_filled(offense), F.lit("?")),
        F.lit(" vs "),
        F.coalesce(_filled(defense), F.lit("?")),
    )
    ends = F.concat_ws(", ", _filled(end_down_distance), at(end_yard_line))
    tail = F.concat(
        result, F.when(ends != "", F.concat(F.lit(" (→ "), ends, F.lit(")"))).otherwise("")
    )
    prefix = F.when(header != "", F.concat(header, F.lit(" — "))).otherwise("")
    return F.trim(F.concat(prefix, where, F.lit(" — "), call, F.lit(" — "), tail))

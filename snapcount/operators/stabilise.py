"""Frame-level clean-up: which situation and score reads to believe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapcount import constants as C
from snapcount.operators import sequence as S
from snapcount.operators.sequence import Machine, Sequence

FRAMES = Sequence(("game_id",), "frame_index")


def _agree(left: Column, right: Column) -> Column:
    downs = left.down.isNull() | right.down.isNull() | (left.down == right.down)
    return F.coalesce((left.yard_line == right.yard_line) & downs, F.lit(False))


def stabilize_situation(frames: DataFrame, seq: Sequence = FRAMES) -> DataFrame:
    """Blank down, distance and yard line on frames no neighbour supports."""
    here = F.struct("yard_line", "down")
    anchor = F.when(
        F.col("yard_line").isNotNull() | F.col("down").isNotNull(), F.col(seq.order)
    )
    looked = S.scan(
        frames,
        seq,
        _before=S.before(here),
        _after=S.after(here),
        _first=S.whole_min(anchor),
        _last=S.whole_max(anchor),
    )
    supported = (
        F.col("special_state").isNotNull()
        | _agree(F.col("_before"), here)
        | _agree(here, F.col("_after"))
        | F.coalesce(F.col(seq.order).isin(F.col("_first"), F.col("_last")), F.lit(False))
    )
    return looked.withColumns(
        {
            name: F.when(supported, F.col(name))
            for name in ("down", "distance", "yard_line")
        }
    ).drop("_before", "_after", "_first", "_last")


class ScoreSteps(Machine):
    """A score only grows, by a legal step; one point needs ``single``."""

    def __init__(self, order: str) -> None:
        self.order = order

    def run(self, state, rows):
        out = []
        for place, value, single in zip(rows[self.order], rows["value"], rows["single"]):
            step = value - state
            if step > 0 and step in C.SCORE_STEPS and (step > 1 or single):
                state = int(value)
                out.append((place, state))
        return state, {self.order: [place for place, _ in out], "value": [value for _, value in out]}

    def reach(self, rows):
        # Start values that have met share one list of origins.
        origins: dict[int, list[int]] = {}
        seen: set[int] = set()

        def standing_at(score: int) -> list[int]:
            found = origins.pop(score, [])
            if score >= 0 and score not in seen:
                seen.add(score)
                found.append(score)
            return found

        for value, single in zip(rows["value"], rows["single"]):
            steps = [s for s in C.SCORE_STEPS if s > 1 or s == 0 or single]
            arriving = [o for s in steps for o in standing_at(int(value) - s)]
            if arriving:
                origins[int(value)] = arriving
        return {o: at for at, group in origins.items() for o in group}, None


def accepted_scores(events: DataFrame, seq: Sequence) -> DataFrame:
    """(keys, side, order, value) where a side's score legally grows.

    ``events`` holds (keys, order, side, value, single). Growth is strict, so a
    side has at most as many rows as its final score has points.
    """
    by_side = seq.within("side")
    events = S.scan(
        by_side.mark(events),
        by_side,
        _prior=S.before(F.struct("value", "single")),
    ).filter(~(F.col("_prior").eqNullSafe(F.struct("value", "single"))))
    return S.fold(
        events.drop("_prior"),
        by_side,
        ScoreSteps(seq.order),
        f"{seq.order} bigint, value int",
    )


def apply_scores(df: DataFrame, seq: Sequence, accepted: DataFrame) -> DataFrame:
    """Replace both score columns by the last accepted value, 0 before any."""
    steps = accepted.select(
        *seq.keys,
        seq.order,
        *(F.when(F.col("side") == side, F.col("value")).alias(f"_{side}") for side in ("away", "home")),
    )
    df = S.latest_as_of(df, seq, steps, "_away", "_home")
    return df.withColumns(
        {f"{side}_score": F.coalesce(f"_{side}", F.lit(0)) for side in ("away", "home")}
    ).drop("_away", "_home")


def score_events(frames: DataFrame, seq: Sequence = FRAMES) -> DataFrame:
    """Score reads that a later read confirms, as (keys, order, side, value, single).

    Confirmed: one of the side's next three reads repeats the value or is a
    legal step above it. ``single`` tells whether one point may be scored here.
    """
    df = S.near_rows(
        frames, seq, F.col("special_state") == "extra_point", C.PAT_REACH, "single"
    )
    by_side = seq.within("side")
    reads = F.array(
        *(
            F.struct(F.lit(side).alias("side"), F.col(f"{side}_score").alias("value"))
            for side in ("away", "home")
        )
    )
    df = df.select(*seq.parts, seq.order, "single", F.explode(reads).alias("_read"))
    df = df.select(
        *seq.parts, seq.order, "_read.side", "_read.value", "single"
    ).filter(F.col("value").isNotNull())
    df = S.next_rows(df, by_side, F.col("value"), C.SCORE_LOOKAHEAD, "_next")
    growth = [step for step in C.SCORE_STEPS if step > 0]
    confirmed = F.exists(
        "_next",
        lambda later: (later == F.col("value")) | (later - F.col("value")).isin(*growth),
    )
    return df.filter(confirmed).drop("_next")


def stabilize_scores(frames: DataFrame, seq: Sequence = FRAMES) -> DataFrame:
    return apply_scores(frames, seq, accepted_scores(score_events(frames, seq), seq))

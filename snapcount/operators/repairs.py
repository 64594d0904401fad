"""Passes over each game's ordered spot summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcount import constants as C
from snapcount.functions import text as P
from snapcount.functions.similarity import best_supported, merged_text
from snapcount.operators import sequence as S
from snapcount.operators.sequence import Machine, Sequence, Walk
from snapcount.operators.spots import vote_fields
from snapcount.operators.stabilise import accepted_scores, apply_scores

SUMMARIES = Sequence(("game_id",), "spot")

CALLS = ("_prev_off", "_prev_def")
FILLED_FROM_LOSERS = (
    "_stream_side", "_personnel", "_formation", "away_team", "home_team",
    "possession_team", "field_side",
)
REVERSED = {"offense": "defense", "defense": "offense"}


# Merging --------------------------------------------------------------------


class _TextFold(Walk):
    def __init__(self) -> None:
        self.best: str | None = None

    def add(self, row):
        self.best = best_supported([self.best, row.text])
        return []

    def end(self):
        return [(self.best,)]


def _regroup(df: DataFrame, seq: Sequence, group: str, **values: Column) -> DataFrame:
    """One row per (keys, group): ``values``, banner OR, and re-voted calls."""
    keys = [*seq.keys, group]
    values["_banner_shown"] = F.coalesce(F.bool_or("_banner_shown"), F.lit(False))
    values["_rows"] = F.count("*")
    aggs = [value.alias(name) for name, value in values.items()]
    if seq.width is None:
        lists = [
            F.sort_array(
                F.collect_list(
                    F.when(F.col(c).isNotNull(), F.struct(F.col(seq.order).alias("o"), F.col(c)))
                )
            )[c].alias(c)
            for c in CALLS
        ]
        out = df.groupBy(*keys).agg(*aggs, *lists)
        return out.withColumns({c: merged_text(c, "_rows") for c in CALLS}).drop("_rows")
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq.order))).alias(c) for c in CALLS]
    out = df.groupBy(*keys).agg(*aggs, *kept)
    texts = df.select(
        *keys,
        seq.order,
        F.explode(
            F.array(*(F.struct(F.lit(c).alias("call"), F.col(c).alias("text")) for c in CALLS))
        ).alias("_c"),
    ).select(*keys, seq.order, "_c.call", "_c.text")
    texts = texts.filter("text is not null and text <> ''")
    voted = S.walk(texts, [*keys, "call"], seq.order, _TextFold, "text string")
    voted = voted.groupBy(*keys).agg(
        *(F.max(F.when(F.col("call") == c, F.col("text"))).alias(f"{c}_voted") for c in CALLS)
    )
    return (
        out.join(voted, keys, "left")
        .withColumns(
            {c: F.when(F.col("_rows") == 1, F.col(c)).otherwise(F.col(f"{c}_voted")) for c in CALLS}
        )
        .drop("_rows", *(f"{c}_voted" for c in CALLS))
    )


def collapse_same_clock(summaries: DataFrame, seq: Sequence = SUMMARIES) -> DataFrame:
    """Merge neighbours of equal quarter and clock; the longest one wins.

    A row beats the rows merged before it when it lasts longer than they do
    together; the last such row keeps its fields. Its gaps are filled from the
    earlier winners, newest first, and then from the other rows in order.
    """
    columns = seq.unmark(summaries).columns
    order = F.col(seq.order)
    start, end = F.col("start_timestamp_seconds"), F.col("end_timestamp_seconds")
    df = S.scan(
        summaries, seq, _prior=S.before(F.struct("special_state", "quarter", "game_clock"))
    )
    prior = F.col("_prior")
    same = (
        prior.isNotNull()
        & prior.special_state.isNull()
        & F.col("special_state").isNull()
        & prior.quarter.eqNullSafe(F.col("quarter"))
        & (prior.game_clock == F.col("game_clock"))
    )
    df = S.same_value_runs(df, seq, same, "_group")
    df = S.scan(
        df, seq.within("_group"), _from=S.min_before(start), _to=S.max_before(end)
    )
    wins = F.coalesce(end - start > F.col("_to") - F.col("_from"), F.col("_to").isNull())
    df = df.withColumns(
        {
            "_wins": wins,
            "_pref": F.struct(
                F.when(wins, 0).otherwise(1).alias("a"), F.when(wins, -order).otherwise(order).alias("b")
            ),
        }
    )
    merged = ("start_timestamp_seconds", "end_timestamp_seconds", "_banner_shown", *CALLS, seq.order, *seq.keys)
    own = [c for c in columns if c not in merged and c not in FILLED_FROM_LOSERS]
    values = {
        "start_timestamp_seconds": F.min(start),
        "end_timestamp_seconds": F.max(end),
        "_own": F.max_by(F.struct(*own), F.when(F.col("_wins"), order)),
    }
    for name in FILLED_FROM_LOSERS:
        values[name] = F.min_by(name, F.when(F.col(name).isNotNull(), F.col("_pref")))
    out = _regroup(df, seq, "_group", **values).withColumnRenamed("_group", seq.order)
    return out.select(*(F.col(f"_own.{c}").alias(c) if c in own else F.col(c) for c in columns))


class DownEvidence(Machine):
    """Which rows start a new situation; the state is the kept row's down."""

    def __init__(self, order: str) -> None:
        self.order = order

    @staticmethod
    def _stays(state: int, down: int, forced: bool, backed: bool) -> bool:
        if forced:
            return False
        if state and down:
            return down != 1 and down != state + 1
        return not backed

    def run(self, state, rows):
        merged = []
        for place, down, forced, backed in zip(
            rows[self.order], rows["_down"], rows["_forced"], rows["_backed"]
        ):
            if self._stays(state, down, forced, backed):
                merged.append(place)
            else:
                state = int(down)
        return state, {self.order: merged}

    def reach(self, rows):
        starts = {0} | {int(down) - 1 for down in rows["_down"] if down > 1}
        moves = {start: self.run(start, rows)[0] for start in starts}
        never = -1_000_000
        other = self.run(never, rows)[0]
        return moves, None if other == never else other


def drop_unsupported(
    summaries: DataFrame, backed: Column, seq: Sequence = SUMMARIES
) -> DataFrame:
    """Merge rows without evidence of a play into the last kept row.

    Scores must be filled in (see ``backfill_static_and_scores``): merged rows
    then have the kept row's scores, so a change shows against the row before.
    ``backed``: the row's banner holds a call the catalog knows.
    """
    columns = seq.unmark(summaries).columns
    df = S.scan(
        summaries,
        seq,
        _prior=S.before(F.struct("special_state", "away_score", "home_score")),
    )
    prior = F.col("_prior")

    def changed(name: str) -> Column:
        return F.coalesce(prior[name] != F.col(name), F.lit(False))

    forced = (
        prior.isNull()
        | prior.special_state.isNotNull()
        | F.col("special_state").isNotNull()
        | changed("away_score")
        | changed("home_score")
    )
    rows = df.select(
        *seq.parts,
        seq.order,
        F.coalesce("down", F.lit(0)).alias("_down"),
        forced.alias("_forced"),
        F.coalesce(backed, F.lit(False)).alias("_backed"),
    )
    merged = S.fold(rows, seq, DownEvidence(seq.order), f"{seq.order} bigint")
    df = summaries.join(
        merged.withColumn("_merged", F.lit(True)), [*seq.keys, seq.order], "left"
    )
    df = S.scan(
        df, seq, _group=S.fill(F.when(F.col("_merged").isNull(), F.col(seq.order)))
    )
    taken = ("end_timestamp_seconds", "_banner_shown", *CALLS, seq.order, *seq.keys)
    own = [c for c in columns if c not in taken]
    out = _regroup(
        df,
        seq,
        "_group",
        end_timestamp_seconds=F.max("end_timestamp_seconds"),
        _own=F.min_by(F.struct(*own), F.col(seq.order)),
    ).withColumnRenamed("_group", seq.order)
    return out.select(*(F.col(f"_own.{c}").alias(c) if c in own else F.col(c) for c in columns))


def drop_before_special(summaries: DataFrame, seq: Sequence = SUMMARIES) -> DataFrame:
    """Drop an unread row between a down and a kickoff or extra point."""
    df = S.scan(
        summaries,
        seq,
        _before=S.before(F.col("down")),
        _after=S.after(F.col("special_state")),
    )
    drop = (
        F.col("_before").isNotNull()
        & F.col("down").isNull()
        & F.col("special_state").isNull()
        & F.coalesce(F.col("_after").isin("extra_point", "kickoff"), F.lit(False))
    )
    return df.filter(~drop).drop("_before", "_after")


# Filling and repairing --------------------------------------------------------


def backfill_static_and_scores(summaries: DataFrame, seq: Sequence = SUMMARIES) -> DataFrame:
    """Game-wide teams, filled quarters, and scores that only grow legally."""
    teams = vote_fields(
        summaries, list(seq.keys), seq.order, {"away_team": "string", "home_team": "string"}
    )
    reads = F.array(
        *(
            F.struct(F.lit(side).alias("side"), F.col(f"{side}_score").alias("value"))
            for side in ("away", "home")
        )
    )
    marked = seq.mark(summaries)
    events = (
        marked.select(*seq.parts, seq.order, F.explode(reads).alias("_read"))
        .select(*seq.parts, seq.order, "_read.*", F.lit(True).alias("single"))
        .filter(F.col("value").isNotNull())
    )
    df = S.attach(marked.drop("away_team", "home_team"), seq, teams)
    df = apply_scores(df, seq, accepted_scores(events, seq))
    df = S.scan(df, seq, _quarter=S.fill(F.col("quarter")))
    return df.withColumn("quarter", F.coalesce("_quarter", F.lit(1))).drop("_quarter")


def repair_downs(summaries: DataFrame, seq: Sequence = SUMMARIES) -> DataFrame:
    """A down that cannot follow, just before a first down, becomes the next one."""
    here = F.struct("down", "special_state")
    df = S.scan(summaries, seq, _b=S.before(here), _a=S.after(F.col("down")))
    expected = F.col("_b.down") + 1
    broken = F.coalesce(
        F.col("_b.down").between(1, 3)
        & (F.col("down") != 1)
        & (F.col("down") != expected)
        & (F.col("_a") == 1),
        F.lit(False),
    ) & F.col("_b.special_state").isNull() & F.col("special_state").isNull()
    return df.withColumns(
        {
            "down": F.when(broken, expected).otherwise(F.col("down")),
            "down_distance": F.when(
                broken, P.format_down_distance(expected, "distance")
            ).otherwise(F.col("down_distance")),
        }
    ).drop("_b", "_a")


def _possession_flips(df: DataFrame, seq: Sequence) -> DataFrame:
    """Add ``_flip``: the ball changed hands on the way into this row."""
    df = S.scan(df, seq, _b=S.before(F.struct("down", "special_state")))
    flip = F.coalesce((F.col("_b.down") == 4) & (F.col("down") == 1), F.lit(False)) | F.coalesce(
        F.col("_b.special_state") == "kickoff", F.lit(False)
    )
    return df.withColumn("_flip", flip).drop("_b")


def _with_parity(df: DataFrame, seq: Sequence, seen: Column, value: Column) -> DataFrame:
    """Add ``_seen`` (last value where ``seen``) and ``_turns`` (flips since)."""
    df = S.scan(_possession_flips(df, seq), seq, _flips=S.running_sum(F.col("_flip").cast("int")))
    note = F.when(seen, F.struct(value.alias("value"), F.col("_flips").alias("flips")))
    df = S.scan(df, seq, _seen=S.fill(note))
    return df.withColumn("_turns", F.col("_flips") - F.coalesce("_seen.flips", F.lit(0)))


def resolve_stream_sides(summaries: DataFrame, seq: Sequence = SUMMARIES) -> DataFrame:
    """Last observed side, turned over at each later change of possession."""
    side = F.col("_stream_side")
    df = _with_parity(summaries, seq, side.isNotNull(), side)
    seen = F.col("_seen.value")
    turned = F.when(seen == "offense", "defense").when(seen == "defense", "offense")
    known = seen.isin(*REVERSED)
    return df.withColumn(
        "_stream_side",
        F.when(F.col("_turns") == 0, seen)
        .when(F.col("_turns") % 2 == 0, F.when(known, seen))
        .otherwise(turned),
    ).drop("_flip", "_flips", "_seen", "_turns")


def apply_stream_transitions(summaries: DataFrame, seq: Sequence = SUMMARIES) -> DataFrame:
    """Row-to-row turnover of the side, overriding observations."""
    side = F.col("_stream_side")
    df = _possession_flips(summaries, seq)
    df = S.same_value_runs(df, seq, F.col("_flip"), "_run")
    df = S.scan(df, seq, _flips=S.running_sum(F.col("_flip").cast("int")))
    # Only the two known sides can be turned over; any other value stays put.
    first = F.when(
        side.isin(*REVERSED), F.struct(side.alias("side"), F.col("_flips").alias("flips"))
    )
    runs = seq.within("_run")
    df = S.scan(df, runs, _earlier=S.latest(first))
    opening = F.when(F.col("_earlier").isNull(), first)
    df = S.scan(df, runs, _from=S.fill(opening))
    odd = (F.col("_flips") - F.col("_from.flips")) % 2 == 1
    start = F.col("_from.side")
    turned = F.when(start == "offense", "defense").when(start == "defense", "offense")
    return df.withColumn(
        "_stream_side",
        F.when(start.isNotNull(), F.when(odd, turned).otherwise(start)).otherwise(side),
    ).drop("_flip", "_run", "_flips", "_earlier", "_from")


def other_team(team: Column, away: Column, home: Column) -> Column:
    """The opponent; an unread team equals an unread scoreboard name."""
    return F.when(team.eqNullSafe(away), home).when(team.eqNullSafe(home), away)


def resolve_possession(summaries: DataFrame, seq: Sequence = SUMMARIES) -> DataFrame:
    """Last valid possession read, turned over at each change of possession.

    Only reads equal to one of the two team names count. Where a team name is
    unread, a missing read is equal to it and counts too, and the game starts
    out with it. Needs the same two teams on all rows of a game.
    """
    away, home = F.col("away_team"), F.col("home_team")
    read = F.col("possession_team")
    valid = read.eqNullSafe(away) | read.eqNullSafe(home)
    df = _with_parity(summaries, seq, valid, read)
    seen = F.col("_seen.value")
    unset = F.col("_seen").isNull() & away.isNotNull() & home.isNotNull()
    odd = F.col("_turns") % 2 == 1
    return df.withColumn(
        "possession_team",
        F.when(unset, F.lit(None).cast("string"))
        .when(odd, other_team(seen, away, home))
        .otherwise(seen),
    ).drop("_flip", "_flips", "_seen", "_turns")


def propagate(summaries: DataFrame, *names: str, seq: Sequence = SUMMARIES) -> DataFrame:
    """Carry the last known value of each column forward."""
    df = S.scan(summaries, seq, **{f"_filled_{n}": S.fill(F.col(n)) for n in names})
    df = df.withColumns({n: F.col(f"_filled_{n}") for n in names})
    return df.drop(*(f"_filled_{n}" for n in names))


class _Overtimes(Walk):
    """Quarters after the fourth, from restarts whose label is the next quarter."""

    def __init__(self) -> None:
        self.quarter = self.since = None

    def add(self, row):
        if self.quarter is None:
            self.quarter, self.since = row.begins, row.entered
        if row.quarter != self.quarter + 1 or row.low_at < self.since:
            return []
        self.quarter, self.since = row.quarter, row.spot
        return [(row.spot, 1)]


def repair_quarter_and_clock(summaries: DataFrame, seq: Sequence = SUMMARIES) -> DataFrame:
    """Quarters advance on clock restarts only, and clocks never rise inside one.

    A restart is a clock of five minutes or more after one of 45 seconds or
    less; up to the fourth quarter each restart is the next quarter, later
    only one that is labelled so.
    """
    seconds = P.clock_seconds("game_clock")
    low_high = F.when(seconds <= 45, "low").when(seconds >= 300, "high")
    order = F.col(seq.order)
    df = S.scan(
        summaries,
        seq,
        _last=S.latest(low_high),
        _low_at=S.latest(F.when(seconds <= 45, order)),
        _first=S.whole_min(F.struct(order.alias("o"), F.col("quarter").alias("q"))),
    )
    restart = (low_high == "high") & (F.col("_last") == "low")
    df = S.scan(df, seq, _restarts=S.running_sum(F.when(restart, 1).otherwise(0)))
    first = F.coalesce(F.nullif("_first.q", F.lit(0)), F.lit(1))
    regular = F.greatest(F.lit(4) - first, F.lit(0))
    df = df.withColumn("_ahead", F.least(F.col("_restarts"), regular).cast("int"))
    df = S.scan(df, seq, _entered=S.whole_min(F.when(F.col("_ahead") == regular, order)))
    labelled = df.filter((low_high == "high") & (F.col("quarter") > 4) & (F.col("_low_at") >= F.col("_entered")))
    later = S.walk(
        labelled.select(
            *seq.keys, order.alias("spot"), "quarter", F.col("_low_at").alias("low_at"),
            F.col("_entered").alias("entered"), F.greatest(F.lit(4), first).alias("begins"),
        ),
        list(seq.keys),
        "spot",
        _Overtimes,
        "spot bigint, _later int",
    ).withColumnRenamed("spot", seq.order)
    df = df.join(later, [*seq.keys, seq.order], "left")
    df = S.scan(df, seq, _overtimes=S.running_sum(F.coalesce("_later", F.lit(0))))
    df = df.withColumn("_ahead", F.col("_ahead") + F.col("_overtimes").cast("int"))
    df = S.scan(df, seq.within("_ahead"), _lowest=S.min_before(seconds))
    return df.withColumns(
        {
            "quarter": (first + F.col("_ahead")).cast("int"),
            "game_clock": F.when(
                seconds > F.col("_lowest"), P.seconds_clock("_lowest")
            ).otherwise(F.col("game_clock")),
        }
    ).select(*summaries.columns)


class _TouchdownScores(Walk):
    """Scores of extra point and kickoff pairs that follow each other."""

    def __init__(self) -> None:
        self.kickoff: dict[str, int] = {}

    def add(self, row):
        before = {"away": row.before_away, "home": row.before_home} | self.kickoff
        self.kickoff = {}
        previous = before.get(row.side)
        if previous is None:
            return []
        touchdown = int(previous) + 6
        final = next((v for v in row.ahead if v in (touchdown, touchdown + 1)), touchdown)
        self.kickoff = {row.side: int(final)}
        return [
            (row.spot, row.side, touchdown),
            (row.kickoff_spot, row.side, int(final)),
        ]


def repair_special_scores(summaries: DataFrame, seq: Sequence = SUMMARIES) -> DataFrame:
    """An extra point before a kickoff implies a touchdown by its team.

    The score before it plus six is the extra point row's score; the kickoff
    row gets the first of the next 12 rows' scores six or seven above, if any.
    """
    scores = F.struct(
        F.coalesce("away_score", F.lit(-1)).alias("away"),
        F.coalesce("home_score", F.lit(-1)).alias("home"),
    )
    special = F.col("special_state")
    df = S.scan(
        summaries,
        seq,
        _prior=S.before(F.struct("special_state", "away_score", "home_score")),
        _next=S.after(F.struct("special_state", F.col(seq.order).alias("spot"))),
    )
    df = S.next_rows(df, seq, scores, C.PAT_REACH, "_ahead")
    is_pair = F.coalesce(
        (special == "extra_point") & (F.col("_next.special_state") == "kickoff"), F.lit(False)
    )
    # Pairs follow each other directly when a pair's kickoff precedes the next.
    df = S.scan(df.withColumn("_pair", is_pair), seq, _prior_pair=S.before(F.col("_pair")))
    df = S.scan(df, seq, _two_back=S.before(F.col("_prior_pair")))
    team = F.col("possession_team")
    side = F.when(team.eqNullSafe(F.col("away_team")), "away").when(
        team.eqNullSafe(F.col("home_team")), "home"
    )
    chained = F.coalesce(F.col("_two_back"), F.lit(False))
    pairs = df.filter("_pair").withColumn("_side", side)
    pairs = S.scan(
        pairs,
        seq,
        _chain=S.fill(F.when(~chained, F.col(seq.order))),
    ).select(
        *seq.keys,
        "_chain",
        F.col(seq.order).alias("spot"),
        F.col("_next.spot").alias("kickoff_spot"),
        F.col("_side").alias("side"),
        F.col("_prior.away_score").alias("before_away"),
        F.col("_prior.home_score").alias("before_home"),
        F.when(F.col("_side") == "away", F.col("_ahead.away"))
        .otherwise(F.col("_ahead.home"))
        .alias("ahead"),
    )
    fixes = S.walk(
        pairs,
        [*seq.keys, "_chain"],
        "spot",
        _TouchdownScores,
        "spot bigint, side string, value int",
    )
    fixes = fixes.groupBy(*seq.keys, F.col("spot").alias(seq.order)).agg(
        *(
            F.max(F.when(F.col("side") == s, F.col("value"))).alias(f"_{s}_fix")
            for s in ("away", "home")
        )
    )
    return (
        summaries.join(fixes, [*seq.keys, seq.order], "left")
        .withColumns(
            {f"{s}_score": F.coalesce(f"_{s}_fix", f"{s}_score") for s in ("away", "home")}
        )
        .drop("_away_fix", "_home_fix")
    )

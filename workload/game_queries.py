"""Queries over frames and summaries, with their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcount.operators import pairing, readings, repairs, spots, stabilise
from snapcount.operators.catalog import Catalog
from snapcount.plans import games
from workload import bindings as B
from workload import oracles as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bound(spark, sf_dir, B.FRAMES)


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bound(spark, sf_dir, B.SUMMARIES)


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(B.bound(spark, sf_dir, B.CATALOG))


def _frame_query(name, work, columns, step):
    names = ["game_id", "frame_index", *columns]
    register(
        name,
        lambda spark, sf: work(frames(spark, sf)).select(*names),
        O.up_to(step[0], f"select {', '.join(names)} from {step[0]}")
        if isinstance(step, tuple)
        else O.chain(("frames", B.FRAMES), last=f"select {', '.join(names)} from ({step})"),
    )


_frame_query(
    "stabilize_situation", stabilise.stabilize_situation,
    ["down", "distance", "yard_line"], O.situation("frames"),
)
_frame_query(
    "stabilize_scores", stabilise.stabilize_scores, ["away_score", "home_score"], ("scored",)
)
_frame_query(
    "assign_spots", lambda df: spots.assign_spots(games.clean_frames(df)), ["spot"], ("spotted",)
)

SPOT_COLUMNS = [
    "game_id", "spot", "start_timestamp_seconds", "end_timestamp_seconds", "quarter",
    "game_clock", "down", "distance", "down_distance", "special_state", "yard_line",
    "field_side", "_stream_side", "_personnel", "_formation", "away_team", "home_team",
    "possession_team", "away_score", "home_score", "_banner_shown",
]
register(
    "summarize_spots",
    lambda spark, sf: spots.summarize_spots(
        spots.assign_spots(games.clean_frames(frames(spark, sf)))
    ).filter(spots.has_anchor()).select(*SPOT_COLUMNS),
    O.up_to("summaries", f"select {', '.join(SPOT_COLUMNS)} from summaries"),
)


def _summary_query(name, work, query):
    register(
        name,
        lambda spark, sf: work(summaries(spark, sf)).select(*SPOT_COLUMNS),
        O.on_summaries(query, ", ".join(SPOT_COLUMNS)),
    )


_summary_query("collapse_same_clock", repairs.collapse_same_clock, O.same_clock("summaries"))
_summary_query("drop_before_special", repairs.drop_before_special, O.before_special("summaries"))
_summary_query("backfill_static_and_scores", repairs.backfill_static_and_scores, O.backfill("summaries"))
_summary_query("repair_downs", repairs.repair_downs, O.downs("summaries"))
_summary_query("resolve_stream_sides", repairs.resolve_stream_sides, O.stream_sides("summaries"))
_summary_query("apply_stream_transitions", repairs.apply_stream_transitions, O.stream_transitions("summaries"))
_summary_query(
    "resolve_possession",
    lambda df: repairs.resolve_possession(repairs.backfill_static_and_scores(df)),
    O.possession(f"({O.backfill('summaries')})"),
)
_summary_query(
    "propagate_side_and_clock",
    lambda df: repairs.propagate(df, "field_side", "game_clock"),
    O.propagated("summaries"),
)
_summary_query("repair_quarter_and_clock", repairs.repair_quarter_and_clock, O.clocks("summaries"))
# Labels that go on past the fourth quarter, where many are missing and some wrong.
_LATE = "cast(case when event_id % 5 < 3 then 3 + floor(spot / 17) when event_id % 5 = 3 then 4 + event_id % 4 end as int)"
_summary_query(
    "repair_overtimes",
    lambda df: repairs.repair_quarter_and_clock(df.withColumn("quarter", F.expr(_LATE))),
    O.clocks(f"(select * replace ({_LATE} as quarter) from summaries)"),
)
_summary_query(
    "drop_unsupported",
    lambda df: repairs.drop_unsupported(repairs.backfill_static_and_scores(df), F.lit(False)),
    O.unsupported(f"({O.backfill('summaries')})"),
)
_summary_query("repair_special_scores", repairs.repair_special_scores, O.touchdowns("summaries"))

PLAY_COLUMNS = [
    "game_id", "play_number", "start_timestamp_seconds", "end_timestamp_seconds", "quarter",
    "game_clock", "down_distance", "possession_team", "stream_side", "play_type", "result",
    "yards_gained", "possession_change", "previous_play_banner_shown", "situation_confidence",
    "call_confidence", "result_confidence", "overall_confidence", "description",
]


def game_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All plays of all games, through every pass."""
    df = games.plays_from_frames(frames(spark, sf_dir), catalog(spark, sf_dir))
    return df.select(
        *PLAY_COLUMNS, F.array_join("transition_evidence", ",").alias("transition_evidence")
    )


register(
    "game_plays",
    game_plays,
    O.up_to("plays", f"select {', '.join(PLAY_COLUMNS)}, transition_evidence from plays"),
)


def game_summaries_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games above 80 frames are cut into chunks, the others are not."""
    df = games.summaries_from_frames(
        frames(spark, sf_dir), catalog(spark, sf_dir),
        long_game=80, frame_width=32, summary_width=32,
    )
    return df.select(*SPOT_COLUMNS)


register(
    "game_summaries_in_chunks",
    game_summaries_in_chunks,
    O.up_to("s11", f"select {', '.join(SPOT_COLUMNS)} from s11"),
)

BOUNDARIES = O.fold(
    "(select game_id, frame_index, diff_score, row_number() over "
    "(partition by game_id order by frame_index) - 1 as at from frames)",
    "game_id", "frame_index",
    "cast(-10000 as bigint) as last, false as hit",
    """case when r.diff_score >= 18 and r.at - f.last >= 2 then r.at else f.last end,
       coalesce(r.diff_score >= 18 and r.at - f.last >= 2, false)""",
)
register(
    "play_boundaries",
    lambda spark, sf: readings.play_boundaries(frames(spark, sf)).select(
        "game_id", "frame_index", "diff_score"
    ),
    O.chain(("frames", B.FRAMES), last=f"select game_id, frame_index, diff_score from ({BOUNDARIES}) where hit"),
)
register(
    "evenly_spaced_frames",
    lambda spark, sf: readings.evenly_spaced(frames(spark, sf)).select("game_id", "frame_index"),
    O.chain(
        ("frames", B.FRAMES),
        ("n", """select game_id, frame_index, row_number() over w - 1 as i,
                 count(*) over (partition by game_id) as n from frames
                 window w as (partition by game_id order by frame_index)"""),
        last="""select game_id, frame_index from n where i in (select 0) or exists (
                  select 1 from range(0, 6) t(j) where j < least(n.n, 6)
                  and n.i = floor(j * (n.n - 1) / greatest(least(n.n, 6) - 1, 1)))""",
    ),
)
register(
    "first_frames",
    lambda spark, sf: readings.first_rows(frames(spark, sf), 12).select("game_id", "frame_index"),
    O.chain(("frames", B.FRAMES), last="""select game_id, frame_index from frames
      qualify row_number() over (partition by game_id order by frame_index) <= 12"""),
)
register(
    "sampled_frames",
    lambda spark, sf: readings.sample_frames(
        frames(spark, sf).select("game_id", F.col("frame_index").alias("relative_index")),
        5, 30.0, 120.0, 1.5, 8,
    ).select("game_id", "frame_index", F.round("timestamp_seconds", 6).alias("timestamp_seconds")),
    O.chain(("frames", B.FRAMES), last="""
      select game_id, 3600 + frame_index as frame_index,
             round(120.0::double + frame_index / 30.0::double, 6) as timestamp_seconds
      from frames where frame_index % 5 = 0
        and (120.0::double + frame_index / 30.0::double) - 120.0::double <= 1.5
      qualify row_number() over (partition by game_id order by frame_index) <= 8"""),
)
register(
    "median_regions",
    lambda spark, sf: readings.median_regions(
        B.bound(spark, sf, """select label, cast(embedding[0] as double) as x, cast(embedding[1] as double) as y,
                                     cast(embedding[2] as double) as w, cast(embedding[3] as double) as h
                              from embeddings"""),
        ["label"], (0.1, 0.0, 0.8, 0.17),
    ),
    """select label, median(cast(embedding[1] as double)) as x, median(cast(embedding[2] as double)) as y,
              median(cast(embedding[3] as double)) as w, median(cast(embedding[4] as double)) as h
       from embeddings group by label""",
)
register(
    "until_possession_change",
    lambda spark, sf: pairing.until_possession_change(B.bound(spark, sf, B.PLAYS)).select(
        "game_id", "play_number"
    ),
    O.chain(("plays", B.PLAYS), last="""
      select game_id, play_number from (
        select *, first_value(possession_team ignore nulls) over (
                    partition by game_id order by play_number
                    rows between unbounded preceding and unbounded following) as t from plays)
      qualify not coalesce(bool_or(possession_team <> t) over (
        partition by game_id order by play_number), false)"""),
)
register(
    "final_scores",
    lambda spark, sf: pairing.final_scores(
        B.bound(spark, sf, f"""select p.*, case when event_id % 3 = 0 then away_score + 3 end as end_away_score,
                                      case when event_id % 4 = 0 then home_score + 6 end as end_home_score
                               from ({B.PLAYS}) p""")
    ),
    O.chain(("plays", B.PLAYS), last="""
      select game_id, home_team,
             coalesce(case when event_id % 4 = 0 then home_score + 6 end, home_score) as home_score,
             coalesce(case when event_id % 3 = 0 then away_score + 3 end, away_score) as away_score,
             away_team
      from plays qualify row_number() over (partition by game_id order by play_number desc) = 1"""),
)
ANCHORED = """((down is not null and distance is not null)
  or coalesce(offensive_play_call <> '', false) or coalesce(defensive_play_call <> '', false))"""
register(
    "renumber_anchored",
    lambda spark, sf: pairing.renumber_anchored(B.bound(spark, sf, B.PLAYS)).select(
        "game_id", "play_number", "csv_play_number"
    ),
    O.chain(("plays", B.PLAYS), last=f"""
      select game_id, play_number, cast(row_number() over (partition by game_id order by play_number) - 1 as int)
             as csv_play_number from plays where {ANCHORED}"""),
)

_DETECTED = """
select 'v' || cast(vec_id % 40 as string) as game_id, vec_id as frame_index,
       case when vec_id % 3 = 0 then 'scoreboard' else 'play_call_banner' end as region,
       cast(embedding[{0}] as double) as x, cast(embedding[{1}] as double) as y,
       cast(embedding[{2}] as double) as w, cast(embedding[{3}] as double) as h
from embeddings where vec_id % 40 <> 7
"""
_RECORDED = "select 'v' || cast(vec_id % 40 as string) as game_id, vec_id as frame_index from embeddings"


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of every game; one game has none detected."""
    return readings.discover_layout(
        B.bound(spark, sf_dir, _RECORDED), B.bound(spark, sf_dir, _DETECTED.format(0, 1, 2, 3))
    )


register(
    "discovered_layout",
    _layout,
    O.chain(
        ("r", f"select *, row_number() over (partition by game_id order by frame_index) - 1 as i, count(*) over (partition by game_id) as n from ({_RECORDED})"),
        ("picked", """select distinct game_id, frame_index from r, (select unnest(range(6)) as s) where s < least(n, 6)
                      and i = cast(floor(s * (n - 1) / greatest(least(n, 6) - 1, 1)) as bigint)"""),
        ("d", _DETECTED.format(1, 2, 3, 4)),
        ("found", """select game_id, region, median(x) as x, median(y) as y, median(w) as w, median(h) as h
                     from d join picked using (game_id, frame_index) group by all"""),
        ("wanted", """select game_id, region, dx, dy, dw, dh from (select distinct game_id from r),
                      (values ('scoreboard', 0.1, 0.0, 0.8, 0.17), ('play_call_banner', 0.2, 0.72, 0.6, 0.2)) v(region, dx, dy, dw, dh)"""),
        last="""select game_id, region, cast(coalesce(x, dx) as double) as x, cast(coalesce(y, dy) as double) as y,
          cast(coalesce(w, dw) as double) as w, cast(coalesce(h, dh) as double) as h from wanted left join found using (game_id, region)""",
    ),
)

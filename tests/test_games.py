"""Passes over frames and summaries: worked examples, and laws on random games.

What the passes give on whole tables is checked against SQL by the registered queries. Here each
rule has a small example worked out by hand, and random games show that chunks, input order and
a second run change nothing.
"""

import pytest
from pyspark.sql import functions as F

import games
from snapcount.operators import sequence as S
from snapcount import schemas
from snapcount.operators import repairs, spots
from snapcount.operators.catalog import Catalog
from snapcount.operators.sequence import Sequence
from snapcount.plans.games import by_game_length, clean_frames, plays_from_frames, summaries_from_frames

GAMES = [games.game(seed, plain_teams=seed % 3 != 0) for seed in range(24)]
CHUNKED_FRAMES = Sequence(("game_id",), "frame_index", 7 * 30)
CHUNKED = Sequence(("game_id",), "spot", 600)
PASSES = {
    "stream_transitions": repairs.apply_stream_transitions,
    "stream_sides": repairs.resolve_stream_sides,
    "downs": repairs.repair_downs,
    "clocks": repairs.repair_quarter_and_clock,
    "touchdowns": repairs.repair_special_scores,
    "backfill": repairs.backfill_static_and_scores,
    "before_special": repairs.drop_before_special,
    "same_clock": repairs.collapse_same_clock,
}


@pytest.fixture(scope="module")
def frames(spark):
    return games.frames(spark, GAMES).cache()


@pytest.fixture(scope="module")
def summaries(spark, frames):
    base = spots.summarize_spots(spots.assign_spots(clean_frames(frames)))
    return base.filter(spots.has_anchor()).cache()


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [("offense", "HB Stretch", "run"), ("offense", "Mesh Spot", "pass"), ("defense", "Cover 3 Sky", "zone")]
    plays = spark.createDataFrame(rows, "side string, play_name string, play_type string")
    plays = plays.selectExpr(
        "side", "side as unit", "'Gun' as formation_family", "'Trips TE' as formation",
        "'f' as formation_slug", "play_name", "lower(play_name) as play_slug", "play_type",
        "1 as team_count", "concat('u/', play_name) as source_url",
        "cast(length(play_name) as bigint) as pos",
    )
    return Catalog(plays)


def table(df):
    """All rows, in an order of their own."""
    names = sorted(df.columns)
    return sorted(map(str, df.select(*names).collect()))


def in_order(df, order, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("game_id", order).collect()]


# Worked examples ------------------------------------------------------------


def shots(spark, *rows):
    """Frames of one game, a second apart; what a row does not say is null."""
    full = [{"game_id": "g", "frame_index": i, "timestamp_seconds": float(i)} | row for i, row in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in games.NAMES) for r in full], schemas.FRAMES)


def summed(spark, summaries, *rows):
    """Summaries of one game; what a row does not say is null."""
    full = [{"game_id": "g", "spot": i, "_banner_shown": False} | row for i, row in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in summaries.columns) for r in full], summaries.schema)


def test_scores_keep_the_last_believable_value(spark):
    df = shots(spark, *({"away_score": v} for v in (0, 7, 7, None, 50, 7, 8, 8)))
    # 50 is no step from 7; 8 is one point, which needs an extra point nearby.
    assert in_order(clean_frames(df), "frame_index", "away_score") == [(v,) for v in (0, 7, 7, 7, 7, 7, 7, 7)]
    near = [{"away_score": v} for v in (0, 6, 6, 7, 7)]
    near[2]["special_state"] = "extra_point"
    assert in_order(clean_frames(shots(spark, *near)), "frame_index", "away_score") == [(0,), (6,), (6,), (7,), (7,)]


def test_a_single_odd_situation_is_blanked(spark):
    df = shots(spark, *({"yard_line": y, "down": 1, "distance": 10} for y in (20, 20, 33, 20, 20)))
    expected = [(20, 1), (20, 1), (None, None), (20, 1), (20, 1)]
    assert in_order(clean_frames(df), "frame_index", "yard_line", "down") == expected


def test_a_new_yard_line_starts_a_spot_and_blank_frames_join_it(spark):
    df = shots(spark, {"yard_line": 20, "down": 1}, {"yard_line": 20}, {}, {"yard_line": 35, "down": 2}, {})
    found = [s for s, in in_order(spots.assign_spots(df), "frame_index", "spot")]
    assert found[:4] == [0, 0, 3, 3]


def test_votes_take_the_most_frequent_then_the_first(spark):
    rows = [{"yard_line": 20, "down": 1, "away_team": t} for t in ("B", "A", "A", "B", "C")]
    rows[1]["game_clock"], rows[3]["game_clock"] = "5:10", "5:02"
    df = spots.summarize_spots(spots.assign_spots(shots(spark, *rows)))
    assert in_order(df, "spot", "away_team", "game_clock", "start_timestamp_seconds", "end_timestamp_seconds") == [
        ("B", "5:02", 0.0, 4.0)
    ]


def test_equal_clocks_merge_and_the_longer_summary_wins(spark, summaries):
    rows = [
        {"quarter": 1, "game_clock": "5:00", "start_timestamp_seconds": 0.0, "end_timestamp_seconds": 10.0, "_formation": "A"},
        {"quarter": 1, "game_clock": "5:00", "start_timestamp_seconds": 11.0, "end_timestamp_seconds": 13.0, "_formation": "B", "away_team": "X"},
        {"quarter": 2, "game_clock": "5:00", "start_timestamp_seconds": 14.0, "end_timestamp_seconds": 15.0},
    ]
    found = repairs.collapse_same_clock(summed(spark, summaries, *rows))
    names = ("start_timestamp_seconds", "end_timestamp_seconds", "_formation", "away_team", "quarter")
    assert in_order(found, "start_timestamp_seconds", *names) == [(0.0, 13.0, "A", "X", 1), (14.0, 15.0, None, None, 2)]


def test_a_blank_summary_before_a_special_state_goes(spark, summaries):
    df = summed(spark, summaries, {"down": 2}, {"yard_line": 9}, {"special_state": "kickoff"}, {"yard_line": 4})
    assert in_order(repairs.drop_before_special(df), "spot", "spot") == [(0,), (2,), (3,)]


def test_an_impossible_down_follows_the_one_before(spark, summaries):
    df = summed(spark, summaries, {"down": 1}, {"down": 3, "distance": 4}, {"down": 1}, {"down": 2})
    found = in_order(repairs.repair_downs(df), "spot", "down", "down_distance")
    assert [d for d, _ in found] == [1, 2, 1, 2] and found[1][1] == "2 & 4"


def test_sides_turn_after_a_fourth_down_and_a_kickoff(spark, summaries):
    rows = [{"down": 1, "_stream_side": "offense"}, {"down": 4}, {"down": 1}, {"special_state": "kickoff"}, {"down": 1}]
    found = in_order(repairs.resolve_stream_sides(summed(spark, summaries, *rows)), "spot", "_stream_side")
    assert [s for s, in found] == ["offense", "offense", "defense", "defense", "offense"]
    rows = [{"down": 4, "_stream_side": "offense"}, {"down": 1, "_stream_side": "offense"}]
    found = in_order(repairs.apply_stream_transitions(summed(spark, summaries, *rows)), "spot", "_stream_side")
    assert found == [("offense",), ("defense",)]


def test_teams_quarters_and_scores_are_filled(spark, summaries):
    rows = [
        {"away_team": "A", "home_score": None}, {"quarter": 2, "home_score": 7},
        {"away_team": "B", "home_score": 30}, {"away_team": "A", "home_score": 10},
    ]
    found = in_order(repairs.backfill_static_and_scores(summed(spark, summaries, *rows)), "spot", "away_team", "quarter", "home_score")
    assert found == [("A", 1, 0), ("A", 2, 7), ("A", 2, 7), ("A", 2, 10)]


def test_quarters_advance_at_restarts_and_clocks_never_rise(spark, summaries):
    df = summed(spark, summaries, *({"quarter": 1, "game_clock": c} for c in ("1:00", "0:30", "7:00", "8:00", None, "6:40")))
    found = in_order(repairs.repair_quarter_and_clock(df), "spot", "quarter", "game_clock")
    assert found == [(1, "1:00"), (1, "0:30"), (2, "7:00"), (2, "7:00"), (2, None), (2, "6:40")]


@pytest.mark.parametrize("seq", [Sequence(("game_id",), "spot"), CHUNKED], ids=["whole", "chunked"])
def test_overtimes_need_a_restart_with_their_label(spark, summaries, seq):
    reads = [
        (4, "0:20"), (None, "10:00"), (6, "9:50"), (5, "9:40"), (6, "9:30"), (5, "0:10"), (6, "8:00"), (7, "7:00"), (None, "0:05"), (8, "6:00"),
        (7, "5:30"),
    ]
    df = summed(spark, summaries, *({"quarter": q, "game_clock": c} for q, c in reads))
    found = in_order(repairs.repair_quarter_and_clock(df, seq), "spot", "quarter", "game_clock")
    assert found == [
        (4, "0:20"), (4, "0:20"), (4, "0:20"), (5, "9:40"), (5, "9:30"), (5, "0:10"), (6, "8:00"), (6, "7:00"), (6, "0:05"), (6, "0:05"),
        (7, "5:30"),
    ]


def test_a_touchdown_gives_six_before_the_try(spark, summaries):
    teams = {"away_team": "A", "home_team": "H", "home_score": 0}
    rows = [
        teams | {"away_score": 0}, teams | {"away_score": 7, "special_state": "extra_point", "possession_team": "A"},
        teams | {"away_score": 0, "special_state": "kickoff"}, teams | {"away_score": 7},
    ]
    found = in_order(repairs.repair_special_scores(summed(spark, summaries, *rows)), "spot", "away_score")
    assert found == [(0,), (6,), (7,), (7,)]


# Laws on random games -------------------------------------------------------


def test_cleaning_and_spots_do_not_depend_on_chunks(frames):
    whole, cut = clean_frames(frames), clean_frames(frames, CHUNKED_FRAMES)
    assert table(whole) == table(CHUNKED_FRAMES.unmark(cut).select(*whole.columns))
    spotted = spots.assign_spots(whole)
    again = CHUNKED_FRAMES.unmark(spots.assign_spots(whole, CHUNKED_FRAMES))
    assert table(spotted) == table(again.select(*spotted.columns))


@pytest.mark.parametrize("name", PASSES)
def test_each_pass_does_not_depend_on_chunks(summaries, name):
    base = repairs.backfill_static_and_scores(summaries) if name == "touchdowns" else summaries
    whole = PASSES[name](base)
    cut = PASSES[name](base, CHUNKED)
    assert table(whole) == table(CHUNKED.unmark(cut).select(*whole.columns))


@pytest.mark.parametrize("name", ["backfill", "downs", "clocks", "stream_sides", "before_special"])
def test_a_second_run_of_a_pass_changes_nothing(summaries, name):
    once = PASSES[name](summaries)
    assert table(PASSES[name](once).select(*once.columns)) == table(once)


def test_scores_never_fall(summaries):
    done = repairs.backfill_static_and_scores(summaries)
    rows = [r for r in done.orderBy("game_id", "spot").collect()]
    for a, b in zip(rows, rows[1:]):
        if a.game_id == b.game_id:
            assert a.away_score <= b.away_score and a.home_score <= b.home_score


def test_summaries_do_not_depend_on_chunks(frames, catalog):
    """Chunks of seven frames, with call texts voted along the way."""
    whole = summaries_from_frames(frames, catalog)
    cut = summaries_from_frames(frames, catalog, long_game=10, frame_width=7 * 30, summary_width=7 * 30)
    names = [n for n in whole.columns if n in cut.columns]
    assert whole.filter("_prev_off is not null").count() > 0
    assert table(whole.select(*names)) == table(cut.select(*names))


def test_only_long_games_are_cut(frames):
    sizes = []

    def work(part, long):
        sizes.append((long, part.select("game_id").distinct().count()))
        return part

    extra = frames.filter("game_id = 'g1'").withColumn("frame_index", F.col("frame_index") + 9000)
    by_game_length(frames.unionByName(extra), work, 100)
    assert sizes == [(False, len(GAMES) - 1), (True, 1)]


def test_plays_do_not_depend_on_chunks_or_input_order(frames, catalog):
    one = plays_from_frames(frames, catalog)
    two = plays_from_frames(
        frames.orderBy(F.desc("frame_index")).repartition(5), catalog,
        long_game=10, frame_width=200, summary_width=700,
    )
    names = [n for n in one.columns if n != "spot"]
    assert one.count() and table(one.select(*names)) == table(two.select(*names))


@pytest.mark.parametrize("width", [None, 4])
def test_notes_carry_forward_from_their_place(spark, width):
    rows = spark.createDataFrame([("g", n) for n in (1, 3, 3, 9, 20)] + [("h", 2)], "game_id string, frame_index bigint")
    notes = spark.createDataFrame(
        [("g", 3, 5, None), ("g", 7, None, 2), ("g", 8, 6, None), ("g", 30, 7, 7), ("i", 1, 1, 1)],
        "game_id string, frame_index bigint, a int, b int",
    )
    found = S.latest_as_of(rows, S.Sequence(width=width), notes, "a", "b")
    got = sorted(((r.game_id, r.frame_index, r.a, r.b) for r in found.collect()), key=lambda r: r[:2])
    assert got == [
        ("g", 1, None, None), ("g", 3, 5, None), ("g", 3, 5, None), ("g", 9, 6, 2), ("g", 20, 6, 2), ("h", 2, None, None),
    ]

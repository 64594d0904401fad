"""Live plays by open tails equal those of the whole games, however frames arrive."""

import random
import time

import games
from pyspark.sql import functions as F
from test_tables import no_catalog

from snapcount.plans.games import plays_from_frames
from snapcount.streaming import finish, incremental, live
from snapcount.streaming.versions import Versions


def rows_of(df, columns):
    return sorted(map(str, df.select(columns).collect()))


def test_plays_by_open_tails_equal_those_of_whole_games(spark, tmp_path):
    """Three batches, the last one with late frames; the second batch runs twice; then all is finished and archived."""
    whole = games.frames(spark, [games.game(seed, frames=90) for seed in (5, 6)]).cache()
    places = sorted({r.frame_index for r in whole.select("frame_index").collect()})
    part = sum((F.col("frame_index") >= places[len(places) * k // 3]).cast("int") for k in (1, 2))
    part = F.when((F.col("game_id") == "g5") & (F.col("frame_index") == places[3]), 2).otherwise(part)
    numbered = whole.withColumn("part", part).cache()
    folder = str(tmp_path / "live")
    tables = incremental.live_tables(spark, folder)
    for number in (0, 1, 1, 2):
        batch = numbered.filter(F.col("part") == number).drop("part")
        incremental.update(batch, number, no_catalog(spark), tables, compact_every=2)
        if number == 1:
            assert tables.latest("tail").count() < 0.7 * numbered.filter("part < 2").count()
    assert tables.base() == 1
    want = plays_from_frames(whole, no_catalog(spark)).cache()
    assert rows_of(live.current_plays(spark, folder), want.columns) == rows_of(want, want.columns)

    ledger = Versions(spark, f"{folder}/ledger", logs=("finished",))
    ended = spark.createDataFrame([("g5",), ("g5",)], "game_id string")
    args = tables, ledger, no_catalog(spark), str(tmp_path / "out"), "2026-08-05"
    assert finish.finalise(ended, 0, *args) == 1
    assert finish.finalise(ended, 1, *args) == 0
    rows = spark.read.option("header", True).csv(f"{tmp_path}/out/football_play_data")
    assert {r.game_id for r in rows.select("game_id").distinct().collect()} == {"g5"}


def test_finished_games_by_event_time(spark, tmp_path):
    """End rows and idle games are reported once; a late frame of a reported game does not report it again."""
    rows = [
        [("a", 0, None, 0), ("a", 1, True, 60), ("b", 0, False, 30), ("c", 0, False, 7000)],
        [("a", 2, True, 6000), ("b", 1, False, 7100), ("c", 1, False, 7200), (None, 1, True, 1), ("d", 5, True, 7300)],
        [("e", 0, False, 30_000)],
    ]
    folder, source = str(tmp_path), str(tmp_path / "in")
    for batch in rows:
        df = spark.createDataFrame(batch, "game_id string, frame_index long, game_over boolean, s long")
        df = df.withColumn("event_time", F.timestamp_seconds(F.col("s") + 10**6)).drop("s")
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        found = finish.finished_games(stream, idle_ms=600_000, grace_ms=10**8, lateness="10 seconds")
        table = live.run_to_table(found, "finished", f"{folder}/cp")
    got = sorted(tuple(r) for r in table.collect())
    assert got == [("a", 2, 0, 1, 1, "end_row"), ("b", 1, 0, 0, 1, "idle"), ("c", 2, 0, 1, 2, "idle"), ("d", 1, 5, 5, 1, "end_row")]


def test_finished_games_by_the_clock(spark, tmp_path):
    rows = [("a", 0, False), ("a", 1, True), ("b", 0, False)]
    df = spark.createDataFrame(rows, "game_id string, frame_index long, game_over boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    found = finish.finished_games(stream, idle_ms=2_000, lateness=None)
    query = (
        found.writeStream.format("parquet").option("path", f"{tmp_path}/rows")
        .option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    )
    got = []
    for _ in range(80):  # such a stream goes on for ever; it is stopped from outside
        time.sleep(0.5)
        if query.lastProgress:
            got = sorted(tuple(r) for r in spark.read.schema(finish.FINISHED).parquet(f"{tmp_path}/rows").collect())
        if len(got) == 2:
            break
    query.stop()
    assert got == [("a", 2, 0, 1, 1, "end_row"), ("b", 1, 0, 0, 1, "idle")]


def test_compaction_keeps_the_last_rows_of_each_game(spark, tmp_path):
    rng, expected, logged = random.Random(1), {}, []
    tables = Versions(spark, str(tmp_path), states=("s",), logs=("l",))
    assert tables.latest("s") is None
    for number in range(9):
        chosen = rng.sample("abcdef", rng.choice([1, 2, 3]))
        rows = [(g, number * 10 + k) for g in chosen for k in range(rng.choice([0, 1, 2]))]
        df = spark.createDataFrame(rows, "game_id string, v int")
        tables.write("s", df, number)
        tables.write("l", df, number)
        tables.finish(spark.createDataFrame([(g,) for g in chosen], "game_id string"), number)
        for g in chosen:
            expected[g] = sorted(v for name, v in rows if name == g)
        logged += [tuple(r) for r in rows]
        if number % 3 == 2:
            tables.compact(number)
        found = {}
        for r in tables.latest("s").collect():
            found.setdefault(r.game_id, []).append(r.v)
        assert {g: sorted(v) for g, v in found.items()} == {g: v for g, v in expected.items() if v}
        assert sorted(tuple(r) for r in tables.rows("l").select("game_id", "v").collect()) == sorted(logged)
    assert len(tables._numbers("s")) <= 6 and len(tables._numbers("s.base")) <= 2


def test_a_game_whose_plays_go_leaves_none_behind(spark, tmp_path):
    tables = incremental.live_tables(spark, str(tmp_path))
    for batch, (rows, names) in enumerate([([("a", 1), ("b", 1)], "ab"), ([], "a")]):
        tables.write("plays", spark.createDataFrame(rows, "game_id string, play_number int"), batch)
        tables.finish(spark.createDataFrame([(n,) for n in names], "game_id string"), batch)
    assert [r.game_id for r in live.current_plays(spark, str(tmp_path)).collect()] == ["b"]


def test_a_bucket_of_a_small_batch_is_one_file(spark, tmp_path):
    """However many tasks hold the rows; else each of them has a file for every bucket."""
    tables = Versions(spark, str(tmp_path / "t"), states=("plays",))
    rows = spark.range(0, 4000, 1, 8).select(F.concat(F.lit("g"), F.col("id") % 300).alias("game_id"), "id")
    tables.write("plays", rows, 0)
    tables.finish(rows.select("game_id").distinct(), 0)
    for part in ("plays/batch=0", "games/batch=0"):
        buckets = [p for p in (tmp_path / "t" / part).iterdir() if p.is_dir()]
        assert len(buckets) > 100 and all(len(list(p.glob("*.parquet"))) == 1 for p in buckets)
    assert rows_of(tables.latest("plays"), ["game_id", "id"]) == rows_of(rows, ["game_id", "id"])

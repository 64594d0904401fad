import json

import pytest
from pyspark.sql import functions as F

import games
from snapcount import constants as C, schemas
from snapcount.operators import calibration, discovery, readings, sequence as S
from snapcount.operators.catalog import Catalog
from snapcount.operators.sequence import Sequence
from snapcount.operators.spots import consensus_by_key
from snapcount.functions.similarity import best_supported
from snapcount.plans.games import plays_from_frames
from snapcount.sources import files
from snapcount.sources.stores import Conflict, Snapshots, write_named


def no_catalog(spark):
    return Catalog(spark.createDataFrame([], schemas.CATALOG))


@pytest.mark.parametrize("gap", [1, 2, 5])
@pytest.mark.parametrize("width", [None, 3, 40])
def test_boundaries_keep_their_distance(spark, gap, width):
    import random

    rng = random.Random(gap)
    rows = [(g, i, float(i), rng.choice([0.0, 20.0, 30.0])) for g in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "game_id string, frame_index long, timestamp_seconds double, diff_score double")
    got = readings.play_boundaries(df, gap=gap, seq=Sequence(("game_id",), "frame_index", width))
    want = []
    for g in "ab":
        last = -10_000
        for _, i, _, d in [r for r in rows if r[0] == g][1:]:
            if d >= 18 and i - last >= gap:
                want.append((g, i))
                last = i
    assert sorted((r.game_id, r.frame_index) for r in got.collect()) == want


def test_consensus_of_long_keys(spark):
    texts = ["HB STRETCH", "HE STRETCH", "HBSTRETCH", "MESH SPOT", "COVER 3 SKY"]
    rows = [("big", i, texts[i % 5 if i % 3 else 1]) for i in range(5000)]
    rows += [("small", i, texts[i % 5]) for i in range(7)]
    df = spark.createDataFrame(rows, "k string, pos long, text string")
    got = {r.k: r.text for r in consensus_by_key(df, ["k"], "pos", "text").collect()}
    assert got == {k: best_supported([r[2] for r in rows if r[0] == k]) for k in ("big", "small")}


def test_even_spread(spark):
    df = spark.range(20).select(F.lit("g").alias("game_id"), F.col("id").alias("frame_index"))
    got = sorted(r.frame_index for r in readings.evenly_spaced(df).collect())
    assert got == sorted({int(i * 19 / 5) for i in range(6)})


def test_sampling_keeps_absolute_times(spark):
    df = spark.range(10).select(F.lit("g").alias("game_id"), F.col("id").alias("relative_index"))
    rows = readings.sample_frames(df, 1, 30.0, 120.0, 10.0, 2).orderBy("frame_index").collect()
    assert [r.frame_index for r in rows] == [3600, 3601]
    assert rows[1].timestamp_seconds == pytest.approx(120 + 1 / 30)


def test_frame_limit_counts_kept_rows_of_each_game(spark):
    numbers = {"g": [0, 4, 10, 12, 20, 30], "h": [50, 51, 52, 60]}
    df = spark.createDataFrame([(g, i) for g, ns in numbers.items() for i in ns], "game_id string, relative_index long")
    rows = readings.sample_frames(df, 2, 30.0, 0.0, None, 3).collect()
    assert sorted((r.game_id, r.frame_index) for r in rows) == [("g", 0), ("g", 4), ("g", 10), ("h", 50), ("h", 52), ("h", 60)]


def test_channels(spark):
    df = spark.createDataFrame([(0, " Example "), (1, "example"), (2, "Second"), (3, " ")], "position int, channel string")
    got = discovery.normalize_channels(df).orderBy("position").collect()
    assert [r.channel for r in got] == ["example", "second"]
    texts = F.array(F.lit("https://www.twitch.tv/Example_Player https://twitch.tv/videos/1"), F.lit("x HTTPS://TWITCH.TV/SecondOne https://twitch.tv/example_player"))
    assert spark.range(1).select(discovery.linked_channels(texts).alias("v")).head().v == ["example_player", "secondone"]


def test_state_cache_and_outputs(spark, tmp_path):
    rows = games.game(3)
    states = [
        {**{k: v for k, v in r.items() if k not in ("game_id", "frame_index", "timestamp_seconds")}, "timestamp": r["timestamp_seconds"]}
        for r in rows
    ]
    records = [[r["frame_index"], r["timestamp_seconds"]] for r in rows]
    (tmp_path / "g3.json").write_text(json.dumps({"version": 5, "records": records, "states": states}))
    (tmp_path / "old.json").write_text(json.dumps({"version": 4, "records": [], "states": states}))
    cached = files.read_state_caches(spark, str(tmp_path))
    frames = games.frames(spark, [rows])
    assert sorted(cached.collect(), key=str) == sorted(frames.select(cached.columns).collect(), key=str)
    with pytest.raises(files.StateCacheError):
        files.read_state_caches(spark, str(tmp_path), strict=True)
    reuse, again = files.reusable_games(frames, cached)
    assert [r.game_id for r in reuse.collect()] == ["g3"] and again.count() == 0

    plays = plays_from_frames(frames, no_catalog(spark)).cache()
    files.write_games(plays, no_catalog(spark), str(tmp_path / "out"), "2026-08-19")
    written = spark.read.option("header", True).csv(str(tmp_path / "out" / "football_play_data"))
    assert [c for c in written.columns if c != "game_id"] == list(files.C.PLAY_COLUMNS)
    assert written.count() == files.play_rows(plays).count() > 0
    assert {p.name for p in (tmp_path / "out" / "Team_Data").iterdir()} == {"NYJ", "TEN"}


def test_records_of_state_caches_are_not_broadcast(spark, tmp_path, capsys):
    """Their file is small, so that its size says little of the rows in it: one for each frame of all games."""
    written = games.frames(spark, [games.game(seed) for seed in (3, 4)])
    files.write_state_caches(written, str(tmp_path / "caches"))
    files.read_state_caches(spark, str(tmp_path / "caches")).explain()
    joins = [line for line in capsys.readouterr().out.splitlines() if "Join " in line]
    assert "SortMergeJoin" in joins[0] and "LeftOuter" in joins[0]


def test_missing_files_are_empty(spark, tmp_path):
    assert files.read_catalog(spark, str(tmp_path / "none.json")).plays.count() == 0
    assert files.read_labels(spark, str(tmp_path / "none.json"), "g").count() == 0
    (tmp_path / "teams.json").write_text(json.dumps(["ARI", ""]))
    with pytest.raises(ValueError):
        files.read_teams(spark, str(tmp_path / "teams.json"))


def test_writers_of_job_state_lose_nothing(spark, tmp_path):
    folder = str(tmp_path / "jobs")
    assert files.saved_jobs(spark, folder).count() == 0

    def jobs(*ids, status="recording"):
        return spark.createDataFrame([(i, status) for i in ids], "stream_id string, status string")

    assert files.save_jobs(jobs("a", "b"), folder) == 0
    state = Snapshots(spark, folder, keep=2)
    with pytest.raises(Conflict):  # both have read the same version
        state.write(jobs("c"), -1)
    raced = []

    def slow(rows):
        if not raced:  # another writer commits between reading and writing
            raced.append(files.save_jobs(jobs("d"), folder))
        return rows.unionByName(jobs("c"))

    assert state.change(slow) == 2
    files.save_jobs(jobs("a", status="completed"), folder)
    found = {r.stream_id: r.status for r in files.saved_jobs(spark, folder).collect()}
    assert found == {"a": "completed", "b": "recording", "c": "recording", "d": "recording"}
    state.change(lambda rows: rows)
    assert len(state.versions()) == 2 and state.read().count() == 4
    assert len(list((tmp_path / "jobs").glob("rows-*"))) == 2


def test_named_files_replace_their_own_only(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    rows = [("x.csv", 2, 'a "quoted", b', None), ("x.csv", 1, "", True), ("t/y.csv", 1, "ñ", False), (None, 1, "lost", None)]
    table = spark.createDataFrame(rows, "name string, n int, text string, flag boolean").repartition(3)
    assert write_named(table, "name", ["n"], out) == 2
    assert (tmp_path / "out" / "t" / "y.csv").read_text() == "n,text,flag\n1,ñ,false\n"
    read = spark.read.option("header", True).option("escape", "\\").csv(f"{out}/x.csv")
    assert [r.n for r in read.collect()] == ["1", "2"] and read.collect()[1].text == 'a "quoted", b'
    write_named(table.filter("n = 2"), "name", ["n"], out)
    assert spark.read.option("header", True).csv(f"{out}/x.csv").count() == 1
    assert (tmp_path / "out" / "t" / "y.csv").exists()
    assert write_named(table.limit(0), "name", ["n"], out) == 0
    broken = table.withColumn("n", F.when(F.col("name") == "x.csv", F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="broken"):
        write_named(broken, "name", ["n"], out)
    assert spark.read.option("header", True).csv(f"{out}/x.csv").count() == 1


def test_archives_of_earlier_runs_stay(spark, tmp_path):
    out = str(tmp_path / "out")
    for seed in (3, 4):
        plays = plays_from_frames(games.frames(spark, [games.game(seed)]), no_catalog(spark))
        files.write_games(plays, no_catalog(spark), out, f"2026-08-{seed:02d}")
    rows = spark.read.option("header", True).csv(f"{out}/football_play_data")
    assert {r.game_id for r in rows.select("game_id").distinct().collect()} == {"g3", "g4"}
    names = [p.name for p in sorted((tmp_path / "out" / "Game_Data").iterdir())]
    assert len(names) == 2 and all(n.endswith(".csv") and " 2026-08-0" in n for n in names)
    team_files = sorted((tmp_path / "out" / "Team_Data").glob("*/*.csv"))
    assert {p.name for p in team_files} == set(names) and not list((tmp_path / "out").glob("*/_staging*"))
    played = spark.read.option("header", True).csv(f"{out}/Game_Data")
    assert played.columns == list(C.PLAY_COLUMNS) and played.count() == rows.count()

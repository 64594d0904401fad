"""Reading and writing the engine's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from snapcount import constants as C
from snapcount import schemas
from snapcount.operators import pairing, reports
from snapcount.operators.catalog import Catalog
from snapcount.session import cut
from snapcount.sources.pieces import read_elements
from snapcount.sources.stores import Snapshots, write_lines, write_named


class StateCacheError(RuntimeError):
    """A state cache of another version."""


def _state_fields() -> str:
    fields = T.StructType.fromDDL(schemas.FRAMES).fields
    own = [f for f in fields if f.name not in ("game_id", "frame_index", "timestamp_seconds")]
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in own) + ", timestamp: double"


def read_state_caches(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Frame states of cached games, one JSON file per game; a large file is read by many tasks.

    Files of another version are skipped, or an error with ``strict``. The file
    name without its ending is the game.
    """
    headers, states = read_elements(
        spark,
        path,
        "states",
        "version int, records array<array<double>>, sample_every_n_frames int, start_seconds double",
        f"struct<{_state_fields()}>",
    )
    headers = cut(headers)
    if strict:
        wrong = headers.filter(~F.col("_header.version").eqNullSafe(F.lit(C.STATE_CACHE_VERSION))).head(1)
        if wrong:
            version = wrong[0]["_header"] and wrong[0]["_header"].version
            raise StateCacheError(
                f"Unsupported state cache version {version}; expected {C.STATE_CACHE_VERSION}"
            )
    current = headers.filter(F.col("_header.version") == C.STATE_CACHE_VERSION)
    recorded = current.select(
        "_file", F.posexplode("_header.records").alias("_pos", "_record")
    ).select("_file", F.col("_pos").cast("bigint").alias("_pos"), F.get("_record", F.lit(0)).cast("bigint").alias("_frame"))
    names = [f.name for f in T.StructType.fromDDL(schemas.FRAMES).fields[3:]]
    # The headers' file is small for what it holds, a record a frame; by its size, Spark would broadcast them all.
    return (
        states.join(current.select("_file").hint("merge"), "_file", "left_semi")
        .join(recorded.hint("merge"), ["_file", "_pos"], "left")
        .select(
            F.url_decode(F.replace(F.regexp_extract("_file", r"([^/]*?)(\.json)?$", 1), F.lit("+"), F.lit("%2B"))).alias("game_id"),
            F.coalesce("_frame", "_pos").alias("frame_index"),
            F.col("_element.timestamp").alias("timestamp_seconds"),
            *(F.col(f"_element.{n}") for n in names),
        )
    )


def write_state_caches(frames: DataFrame, folder: str, sample_every: int = 1, start: float = 0.0) -> int:
    """One JSON file ``<game_id>.json`` a game, by frame; files of the same games are replaced. Returns their number.

    Of frames with equal numbers any may come first. Fields that are null are left out.
    """
    file = F.concat("game_id", F.lit(".json")).alias("__name")
    begun = f'{{"version": {C.STATE_CACHE_VERSION}, "sample_every_n_frames": {sample_every}, "start_seconds": {start}, "records": ['
    sections = F.array(*(F.struct(F.lit(n).alias("part"), F.lit(t).alias("line")) for n, t in ((0, begun), (2, '], "states": ['), (4, "]}"))))
    games = frames.select("game_id").distinct().withColumn("_s", F.explode(sections)).select(
        file, F.col("_s.part").alias("_part"), F.lit(0).alias("_nth"), F.col("_s.line").alias("__line")
    )
    nth = F.row_number().over(Window.partitionBy("game_id").orderBy("frame_index", "timestamp_seconds"))
    at = F.coalesce(F.round("timestamp_seconds", 3).cast("string"), F.lit("null"))
    names = [f.name for f in T.StructType.fromDDL(schemas.FRAMES).fields[3:]]
    state = F.to_json(F.struct(F.col("timestamp_seconds").alias("timestamp"), *names))
    entries = F.array(
        F.struct(F.lit(1).alias("part"), F.format_string("[%d, %s]", "frame_index", at).alias("line")),
        F.struct(F.lit(3).alias("part"), state.alias("line")),
    )
    comma = F.when(F.col("_nth") > 1, ",").otherwise("")
    listed = frames.withColumn("_nth", nth).withColumn("_s", F.explode(entries)).select(
        file, F.col("_s.part").alias("_part"), "_nth", F.concat(comma, F.col("_s.line")).alias("__line")
    )
    return write_lines(games.unionByName(listed), ["_part", "_nth"], folder, [])


def game_signatures(records: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(game_id, signature) of each game's [frame_index, timestamp] list.

    Frames are hashed by range first, so a long game is many small groups.
    """
    entry = F.struct("frame_index", F.round("timestamp_seconds", 3).alias("t"))
    ranges = records.groupBy("game_id", F.floor(F.col("frame_index") / width).alias("_range")).agg(
        F.sha2(F.to_json(F.sort_array(F.collect_list(entry))), 256).alias("_hash")
    )
    listed = F.sort_array(F.collect_list(F.struct("_range", "_hash")))
    return ranges.groupBy("game_id").agg(F.sha2(F.to_json(listed), 256).alias("signature"))


def reusable_games(records: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(games whose cache fits, games to compute again)."""
    wanted, have = game_signatures(records), game_signatures(cached)
    keys = ["game_id", "signature"]
    return (
        wanted.join(have, keys, "left_semi").select("game_id"),
        wanted.join(have, keys, "left_anti").select("game_id"),
    )


def read_catalog(spark: SparkSession, path: str, label: str = "") -> Catalog:
    """Play catalog from JSON; a missing or broken file is an empty catalog."""
    play = ", ".join(
        f"{f.name}: {f.dataType.simpleString()}"
        for f in T.StructType.fromDDL(schemas.CATALOG).fields
        if f.name != "pos"
    )
    schema = f"offense array<string>, defense array<string>, plays array<struct<{play}>>"
    try:
        files = spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException:
        return Catalog(spark.createDataFrame([], schemas.CATALOG), label=label)
    plays = files.select(F.posexplode("plays").alias("pos", "_p")).select(
        "_p.*", F.col("pos").cast("bigint").alias("pos")
    )
    sides = F.explode(
        F.concat(
            *(
                F.transform(
                    F.coalesce(F.col(s), F.array().cast("array<string>")),
                    lambda n, s=s: F.struct(F.lit(s).alias("side"), n.alias("play_name")),
                )
                for s in ("offense", "defense")
            )
        )
    )
    return Catalog(plays, files.select(sides.alias("_n")).select("_n.*"), label)


def write_catalog(plays: DataFrame, path: str) -> None:
    plays.write.mode("overwrite").partitionBy("side").parquet(path)


def read_teams(spark: SparkSession, path: str) -> DataFrame:
    """Team names, one per row; an empty or non-text entry is an error."""
    raw = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.from_json("value", "array<string>")).alias("position", "team")
    )
    if raw.filter(F.col("team").isNull() | (F.col("team") == "")).head(1) or not raw.head(1):
        raise ValueError(f"Invalid team reference: {path}")
    return raw


def read_labels(spark: SparkSession, path: str, game_id: str) -> DataFrame:
    """Labelled plays of one game; no file means no labels."""
    fields = T.StructType.fromDDL(schemas.LABELS).fields[1:]
    play = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in fields)
    try:
        files = spark.read.schema(f"plays array<struct<{play}>>").option("multiLine", True).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schemas.LABELS)
    plays = files.select(F.explode("plays").alias("_p")).select("_p.*")
    return plays.select(F.lit(game_id).alias("game_id"), "*")


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """(position, channel) of a watcher configuration, as written there."""
    files = spark.read.schema("channels array<string>, poll_seconds int").option(
        "multiLine", True
    ).json(path)
    row = files.select(F.coalesce("poll_seconds", F.lit(60)).alias("seconds")).head()
    if row and row.seconds < 15:
        raise ValueError("poll_seconds must be at least 15")
    return files.select(F.posexplode("channels").alias("position", "channel"))


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Recording jobs from a state file: a map from stream id to job."""
    fields = T.StructType.fromDDL(schemas.JOBS).fields[1:]
    job = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in fields)
    try:
        files = spark.read.schema(f"streams map<string, struct<{job}>>").option(
            "multiLine", True
        ).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schemas.JOBS)
    return files.select(F.explode("streams").alias("stream_id", "_j")).select("stream_id", "_j.*")


def write_frame_metadata(frames: DataFrame, path: str) -> None:
    frames.select(
        "frame_index",
        F.format_string("%.3f", "timestamp_seconds").alias("timestamp_seconds"),
        "output_path",
    ).write.mode("overwrite").csv(path, header=True)


def write_boundaries(boundaries: DataFrame, path: str) -> None:
    boundaries.withColumns(
        {n: F.round(n, 3) for n in ("timestamp_seconds", "diff_score")}
    ).write.mode("overwrite").json(path)


def write_play_records(plays: DataFrame, path: str) -> None:
    plays.drop("spot").write.mode("overwrite").json(path)


def play_rows(plays: DataFrame) -> DataFrame:
    """The 59 published columns, lists as JSON, anchored plays numbered anew.

    The plays are written first: a filter on calls would be pushed into the
    expressions that make them, which then grow beyond what can be planned.
    """
    kept = pairing.renumber_anchored(cut(plays))
    types = dict(kept.dtypes)

    def published(name: str) -> Column:
        if name == "play_number":
            return F.col("csv_play_number").alias(name)
        value = F.to_json(name) if types[name].startswith("array") else F.col(name)
        return value.alias(name)

    return kept.select("game_id", *(published(n) for n in C.PLAY_COLUMNS))


def safe_name(value: Column) -> Column:
    return F.regexp_replace(value, r'[<>:"/\\|?*]', "-")


def game_files(plays: DataFrame, completed: str) -> DataFrame:
    """(game_id, game_file): home and away score of games whose end is known."""
    last = pairing.final_scores(plays)
    whole = F.lit(True)
    for name in ("home_team", "home_score", "away_score", "away_team"):
        whole = whole & F.col(name).isNotNull()
    name = F.format_string(
        f"%s %d - %d %s {completed}.csv", "home_team", "home_score", "away_score", "away_team"
    )
    return last.filter(whole).select("game_id", "home_team", "away_team", safe_name(name).alias("game_file"))


def team_files(files: DataFrame) -> DataFrame:
    """One row per game and distinct team."""
    teams = F.array_sort(F.array_distinct(F.array_compact(F.array("away_team", "home_team"))))
    named = files.select("game_id", "game_file", F.explode(teams).alias("_team"))
    team = F.trim(safe_name(F.col("_team")))
    return named.select("game_id", "game_file", team.alias("team")).filter("team <> ''")


def team_index(teams: DataFrame, files: DataFrame) -> DataFrame:
    """Every reference team with its number of games, also without any."""
    played = team_files(files).groupBy("team").agg(F.count("*").alias("games"))
    return teams.join(played, "team", "left").select(
        "team", F.coalesce("games", F.lit(0).cast("bigint")).alias("games")
    )


def write_games(
    plays: DataFrame, catalog: Catalog, output: str, completed: str | None = None
) -> None:
    """Reports and play rows; with ``completed`` (a date) also the archives.

    Calls are checked first, so nothing is written for plays that claim calls
    the catalog does not hold. Archives and play rows add up over runs: a run replaces
    only the files of its own games. Reports are of this run.
    """
    plays = cut(plays)
    reports.assert_catalog_calls(plays, catalog)
    reports.validation_report(plays, catalog).write.mode("overwrite").json(
        f"{output}/play_call_validation_report"
    )
    reports.quality_report(plays).write.mode("overwrite").partitionBy("section").json(
        f"{output}/full_game_quality_report"
    )
    rows = cut(play_rows(plays))
    _replace(rows, f"{output}/football_play_data", "game_id")
    if completed is None:
        return
    write_archives(rows, game_files(plays, completed), output)


def write_archives(rows: DataFrame, files: DataFrame, output: str) -> None:
    """One CSV file a game under its published name, and a copy in the folder of each of its teams.

    ``rows`` have ``game_id`` and the published columns, ``files`` are the ``game_files``.
    """
    columns = [c for c in rows.columns if c != "game_id"]
    order = [c for c in ("play_number",) if c in columns]
    archived = rows.join(files.select("game_id", "game_file"), "game_id")
    write_named(archived.select("game_file", *columns), "game_file", order, f"{output}/Game_Data")
    path = F.concat_ws("/", "team", "game_file").alias("team_file")
    by_team = rows.join(team_files(files).select("game_id", path), "game_id")
    write_named(by_team.select("team_file", *columns), "team_file", order, f"{output}/Team_Data")


def save_jobs(jobs: DataFrame, folder: str) -> int:
    """Merge jobs into the saved state by ``stream_id``, the new ones winning; safe beside other writers.

    Returns the version. Jobs are given once each; of equal ids in ``jobs`` any one stays.
    """
    jobs = cut(jobs.dropDuplicates(["stream_id"]))

    def merged(saved: DataFrame | None) -> DataFrame:
        if saved is None:
            return jobs
        return saved.join(jobs.select("stream_id"), "stream_id", "left_anti").select(*jobs.columns).unionByName(jobs)

    return Snapshots(jobs.sparkSession, folder).change(merged)


def saved_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The saved job state, empty if none was saved."""
    found = Snapshots(spark, folder).read()
    return spark.createDataFrame([], schemas.JOBS) if found is None else found


def _replace(rows: DataFrame, path: str, *parts: str) -> None:
    """Write the partitions that ``rows`` has and leave the others."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*parts).csv(path, header=True)


def write_calibration(comparisons: DataFrame, summary: DataFrame, output: str) -> None:
    comparisons.write.mode("overwrite").csv(f"{output}/calibration_report_csv", header=True)
    summary.write.mode("overwrite").json(f"{output}/calibration_report")

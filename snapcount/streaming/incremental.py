"""Live plays from the open tail of a game: settled spots are kept, only what later frames can still change is computed again.

A game is cut at a frame Q that certainly opens a spot, has a yard line, follows a frame that belongs to the
spot before, and is settled: so many rows and score reads come after it that no later frame changes
anything up to it. Then the frames from Q on give the same spots as the whole game does, if

* scores are counted from the score before Q: legal steps are differences, so the reads are shifted by it;
* the ``PAT_REACH`` rows before Q come along, without score reads, as an extra point shortly before Q counts;
* nothing else before Q matters: a certain opening with a yard line sets every other value that is looked up.

So a game is carried as Q, two scores, the raw frames from Q (and those few before it), and the finished summaries of
the spots before Q. A frame that arrives late, before Q, has its game computed from all its frames once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapcount import constants as C
from snapcount.operators import pairing, spots, stabilise
from snapcount.operators.catalog import Catalog
from snapcount.operators.stabilise import FRAMES
from snapcount.plans.games import _sequences, by_game_length, repaired_summaries, FRAME_WIDTH, LONG_GAME, SUMMARY_WIDTH
from snapcount.session import cut
from snapcount.streaming.versions import Versions

SIDES = ("away", "home")
CARRY = "game_id string, from_frame long, away_base int, home_base int, epoch long"
STATES, LOGS = ("tail", "carry", "plays"), ("frames", "closed")


def live_tables(spark: SparkSession, folder: str) -> Versions:
    return Versions(spark, folder, STATES, LOGS)


def open_spots(tail: DataFrame, carry: DataFrame, long_game: int = LONG_GAME) -> DataFrame:
    """Frames from Q on with their spot, clean, and what settles them (``_raw_…``).

    ``tail`` has the raw frames of each game from ``PAT_REACH`` rows before Q, ``carry`` a row for each game.
    """
    joined = tail.join(carry, "game_id")
    context = F.coalesce(F.col("frame_index") < F.col("from_frame"), F.lit(False))
    raw = {
        "_context": context,
        "_raw_anchor": F.col("yard_line").isNotNull() | F.col("down").isNotNull(),
        **{f"_raw_{s}": ~context & F.col(f"{s}_score").isNotNull() for s in SIDES},
        **{f"{s}_score": F.when(~context, F.col(f"{s}_score") - F.col(f"{s}_base")) for s in SIDES},
    }
    joined = joined.withColumns(raw)

    def work(part: DataFrame, long: bool) -> DataFrame:
        seq = _sequences(long, FRAME_WIDTH, SUMMARY_WIDTH)[0]
        scored = stabilise.stabilize_scores(part, seq)
        scored = (cut(scored) if long else scored).filter(~F.col("_context"))
        clean = scored.withColumns({f"{s}_score": F.col(f"{s}_score") + F.col(f"{s}_base") for s in SIDES})
        spotted = spots.assign_spots(stabilise.stabilize_situation(clean, seq), seq)
        return seq.unmark(spotted)

    return by_game_length(joined, work, long_game).drop("_context")


def settled_frames(spotted: DataFrame) -> DataFrame:
    """The last frame of each game at which it can be cut: game_id, from_frame, and the scores before it."""
    up, down = FRAMES.up(), FRAMES.down().rowsBetween(Window.unboundedPreceding, -1)
    upto = FRAMES.up().rowsBetween(Window.unboundedPreceding, 0)

    def reads(side: str) -> Column:
        read = F.col(f"_raw_{side}").cast("long")
        return (F.sum(read).over(down) >= C.SCORE_LOOKAHEAD) | (F.sum(read).over(upto) == 0)

    marked = spots.with_openings(spotted).withColumns(
        {
            "_follows": F.lag(spots.has_anchor()).over(up),
            "_rows": F.count(F.lit(1)).over(down) >= C.PAT_REACH,
            "_reads": reads("away") & reads("home"),
            "_anchors": F.max("_raw_anchor").over(down),
            **{f"_{s}": F.lag(f"{s}_score").over(up) for s in SIDES},
        }
    )
    fits = F.col("_opens") & F.col("yard_line").isNotNull() & F.col("_follows") & F.col("_rows") & F.col("_reads") & F.col("_anchors")
    return (
        marked.filter(F.coalesce(fits, F.lit(False)))
        .groupBy("game_id")
        .agg(F.max(F.struct("frame_index", "_away", "_home")).alias("_q"))
        .select("game_id", F.col("_q.frame_index").alias("from_frame"), F.col("_q._away").alias("away_base"), F.col("_q._home").alias("home_base"))
    )


def _newest(frames: DataFrame) -> DataFrame:
    """Each frame once, as the last batch has it."""
    others = [c for c in frames.columns if c not in ("game_id", "frame_index", "batch")]
    last = frames.groupBy("game_id", "frame_index").agg(F.max_by(F.struct(*others), "batch").alias("_s"))
    return last.select("game_id", "frame_index", "_s.*")


def update(
    batch: DataFrame, number: int, catalog: Catalog, tables: Versions, compact_every: int = 20, long_game: int = LONG_GAME
) -> None:
    """Take in one batch of frames: bring the plays of its games up to date.

    What is read and computed grows with the batch, the open tails of its games and their summaries, not with the frames
    they have had. Every part has the batch's number, and the games are listed last, so a batch may run again.
    """
    spark = tables.spark
    tables.write("frames", batch, number)
    mine = spark.read.parquet(f"{tables.folder}/frames/batch={number}").select(*batch.columns)
    touched = cut(mine.groupBy("game_id").agg(F.min("frame_index").alias("first")))
    if not touched.head(1):
        return
    # At most one value per bucket, so a short list of partitions to read.
    buckets = [r.bucket for r in spark.read.parquet(f"{tables.folder}/frames/batch={number}").select("bucket").distinct().collect()]

    def known(name: str, ddl: str) -> DataFrame:
        found = tables.latest(name, number, buckets)
        return spark.createDataFrame([], ddl) if found is None else found

    state = touched.join(known("carry", CARRY), "game_id", "left")
    late = F.col("from_frame").isNull() | (F.col("first") < F.col("from_frame"))
    fresh = F.when(late, F.lit(None).cast("long"))
    state = cut(
        state.select(
            "game_id",
            (F.col("epoch").isNotNull() & F.col("from_frame").isNotNull() & late).alias("late"),
            F.when(~late, F.col("from_frame")).otherwise(fresh).alias("from_frame"),
            *(F.when(~late, F.col(f"{s}_base")).otherwise(F.lit(0)).alias(f"{s}_base") for s in SIDES),
            F.coalesce(F.when(~late | F.col("from_frame").isNull(), F.col("epoch")), F.lit(number).cast("long")).alias("epoch"),
        )
    )
    columns = mine.columns
    parts = mine.withColumn("batch", F.lit(1))
    held = tables.latest("tail", number, buckets)
    if held is not None:
        going = state.filter(~F.col("late")).select("game_id")
        parts = parts.unionByName(held.select(*columns).join(going, "game_id", "left_semi").withColumn("batch", F.lit(0)))
    if state.filter("late").head(1):
        again = tables.rows("frames", number, buckets).drop("bucket")
        again = again.join(state.filter("late"), "game_id", "left_semi").select(*columns, (F.col("batch") - number).alias("batch"))
        parts = parts.unionByName(again)
    tail = cut(_newest(parts))

    carry = state.drop("late")
    spotted = cut(open_spots(tail, carry, long_game))
    moved = cut(settled_frames(spotted))
    summaries = spots.summarize_spots(spotted).filter(spots.has_anchor())
    summaries = cut(
        summaries.join(carry.select("game_id", "epoch"), "game_id").join(
            moved.select("game_id", F.col("from_frame").alias("_q")), "game_id", "left"
        ).withColumn("_closed", F.coalesce(F.col("spot") < F.col("_q"), F.lit(False))).drop("_q")
    )
    kept = ["game_id", *[c for c in summaries.columns if c not in ("game_id", "_closed")]]
    closed = tables.rows("closed", number, buckets)
    tables.write("closed", summaries.filter("_closed").select(*kept), number)

    new = carry.join(moved.withColumnsRenamed({c: f"_{c}" for c in moved.columns if c != "game_id"}), "game_id", "left")
    new = cut(new.select("game_id", *(F.coalesce(f"_{c}", c).alias(c) for c in ("from_frame", "away_base", "home_base")), "epoch"))
    tables.write("carry", new, number)
    back = F.row_number().over(Window.partitionBy("game_id", "_before").orderBy(F.desc("frame_index")))
    waiting = tail.join(new.select("game_id", "from_frame"), "game_id").withColumn(
        "_before", F.coalesce(F.col("frame_index") < F.col("from_frame"), F.lit(False))
    )
    waiting = waiting.withColumn("_back", back).filter(~F.col("_before") | (F.col("_back") <= C.PAT_REACH))
    tables.write("tail", waiting.select(*columns), number)

    whole = summaries.select(*kept)
    if closed is not None:
        earlier = closed.join(carry.select("game_id", "epoch"), ["game_id", "epoch"], "left_semi")
        whole = whole.unionByName(earlier.select(*kept))
    whole = cut(whole.drop("epoch"))
    plays = pairing.pair_plays(repaired_summaries(whole, catalog), catalog)
    tables.write("plays", plays, number)
    tables.finish(touched, number)
    if compact_every and number % compact_every == compact_every - 1:
        tables.compact(number)

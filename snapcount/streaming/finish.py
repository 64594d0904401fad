"""The end of a live game: noticed once, then computed whole and archived once.

``finished_games`` watches frames with a stateful processor, a game at a time. A game is due at its end row or, without one,
when it has been idle; a timer waits for that moment. What is known of a game is a list of arrivals, one
short entry a batch, so a batch appends and never rewrites. ``archive_finished`` is the commit step for the games reported: the final
plays, with the closer look at banners, replace the provisional ones in the archive. A ledger names the games that are
done, so that a batch that runs again, or a game that is reported again, is not archived twice.

In event time (the default) the watermark decides, so a replay of the same frames reports the same games: an end row is
due when the watermark has passed it, that is when no earlier frame can still come. In processing time the clock decides, and the memory of a
reported game is state with a time to live; in event time a second timer forgets it. Frames that come after the report
don't report the game again as long as it is remembered. Null ``game_over`` is no end row; rows without a game are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from snapcount.operators.catalog import Catalog
from snapcount.plans.games import plays_from_frames
from snapcount.session import cut
from snapcount.sources.files import write_games
from snapcount.streaming.versions import Versions

FINISHED = "game_id string, frames bigint, first_frame bigint, last_frame bigint, batches bigint, reason string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class GameEnd(StatefulProcessor):
    """Arrivals of a game, the moment at which it is due, and whether it has been reported."""

    def __init__(self, idle_ms: int, grace_ms: int, event_time: bool) -> None:
        self.idle_ms, self.grace_ms, self.event_time = idle_ms, grace_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        live_for = None if self.event_time else self.grace_ms
        self.arrivals = handle.getListState(
            "arrivals", "frames bigint, first bigint, last bigint, at bigint, over bigint"
        )
        self.due = handle.getValueState("due", "at bigint, over bigint")
        self.reported = handle.getValueState("reported", "at bigint", live_for)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = None if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        frames, first, last, at, over = 0, None, None, now, None
        for batch in rows:
            if batch.empty:
                continue
            frames += len(batch)
            low, high = int(batch["frame_index"].min()), int(batch["frame_index"].max())
            first, last = (low if first is None else min(first, low)), (high if last is None else max(last, high))
            ended = (batch["game_over"] == True).to_numpy()  # noqa: E712
            if self.event_time:
                times = batch["event_time"].astype("datetime64[us]").astype("int64") // 1000
                at = int(times.max()) if at is None else max(at, int(times.max()))
                if ended.any():
                    end = int(times[ended].min())
                    over = end if over is None else min(over, end)
            elif ended.any():
                over = now
        if not frames or self.reported.exists():
            return
        self.arrivals.appendValue((frames, first, last, at, over))
        known = self.due.get() if self.due.exists() else None
        if known is not None:
            self.handle.deleteTimer(known[0])
            ends = [x for x in (over, known[1]) if x is not None]
            over = min(ends) if ends else None
            if over is None:
                at = max(at, known[0] - self.idle_ms)
        due = over if over is not None else at + self.idle_ms
        self.due.update((due, over))
        self.handle.registerTimer(due)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.reported.exists():  # in event time: remembered long enough
            self.reported.clear()
            return
        if not self.due.exists():
            return
        due, over = self.due.get()
        arrivals = list(self.arrivals.get())
        self.arrivals.clear()
        self.due.clear()
        self.reported.update((due,))
        if self.event_time:
            self.handle.registerTimer(due + self.grace_ms)
        yield pd.DataFrame(
            {
                "game_id": [key[0]],
                "frames": [sum(a[0] for a in arrivals)],
                "first_frame": [min(a[1] for a in arrivals)],
                "last_frame": [max(a[2] for a in arrivals)],
                "batches": [len(arrivals)],
                "reason": ["idle" if over is None else "end_row"],
            }
        )

    def close(self) -> None:
        pass


def use_rocks(spark: SparkSession) -> None:
    """Timers and list state need the RocksDB state store; set it before a stream starts."""
    spark.conf.set(PROVIDER, ROCKS)


def finished_games(
    frames: DataFrame, idle_ms: int = 600_000, grace_ms: int = 3_600_000, lateness: str | None = "10 minutes"
) -> DataFrame:
    """Each game once: at its end row, or after a time without frames.

    ``frames`` has ``game_id, frame_index, game_over`` and, with ``lateness``, ``event_time``. Without ``lateness`` the
    clock of the machine decides. A reported game is remembered for ``grace_ms``.
    """
    event_time = lateness is not None
    use_rocks(frames.sparkSession)
    names = ["game_id", "frame_index", "game_over"] + (["event_time"] if event_time else [])
    rows = frames.filter(F.col("game_id").isNotNull() & F.col("frame_index").isNotNull()).select(*names)
    if event_time:
        rows = rows.filter(F.col("event_time").isNotNull()).withWatermark("event_time", lateness)
    return rows.groupBy("game_id").transformWithStateInPandas(
        GameEnd(idle_ms, grace_ms, event_time), FINISHED, "append", "eventTime" if event_time else "processingTime"
    )


def finalise(
    games: DataFrame, batch: int, tables: Versions, ledger: Versions, catalog: Catalog, output: str, completed: str,
    observations: DataFrame | None = None,
) -> int:
    """Archive the games of one batch that the ledger doesn't list yet; returns how many.

    ``tables`` are those of the live plays; every frame of a game counts once, as the last batch has it.
    """
    done = ledger.rows("finished", before=batch)
    wanted = games.select("game_id").distinct()
    if done is not None:
        wanted = wanted.join(done.select("game_id"), "game_id", "left_anti")
    wanted = cut(wanted)
    count = wanted.count()
    if not count:
        return 0
    frames = tables.rows("frames").drop("bucket").join(wanted, "game_id", "left_semi")
    others = [c for c in frames.columns if c not in ("game_id", "frame_index", "batch")]
    last = frames.groupBy("game_id", "frame_index").agg(F.max_by(F.struct(*others), "batch").alias("_s"))
    plays = cut(plays_from_frames(cut(last.select("game_id", "frame_index", "_s.*")), catalog, observations))
    write_games(plays, catalog, output, completed)
    counts = plays.groupBy("game_id").agg(F.count(F.lit(1)).alias("plays"))
    listed = wanted.join(counts, "game_id", "left").select("game_id", F.coalesce("plays", F.lit(0)).alias("plays"))
    ledger.write("finished", listed, batch)
    ledger.finish(wanted, batch)
    return count


def archive_finished(
    frames: DataFrame, live_folder: str, catalog: Catalog, output: str, completed: str, checkpoint: str,
    observations: DataFrame | None = None, **ends,
) -> StreamingQuery:
    """Report finished games of a stream and archive each once, from the frames that ``live_plays`` keeps."""

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        tables = Versions(spark, live_folder)
        ledger = Versions(spark, f"{live_folder}/ledger", logs=("finished",))
        finalise(batch, number, tables, ledger, catalog, output, completed, observations)

    return (
        finished_games(frames, **ends).writeStream.foreachBatch(commit)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

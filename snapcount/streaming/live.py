"""Streams: live frames to plays, and the channel, job and message streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from snapcount.operators import discovery
from snapcount.operators.catalog import Catalog
from snapcount.streaming import incremental

def live_plays(
    frames: DataFrame,
    catalog: Catalog,
    folder: str,
    checkpoint: str,
    lateness: str = "1 hour",
    compact_every: int = 20,
) -> StreamingQuery:
    """Keep the plays under ``folder`` up to date with a stream of frame states.

    Later frames change earlier plays, but only back to the last settled spot: a batch computes the open tails
    of its games again (see ``incremental``). Plays are versions by batch, and ``current_plays`` takes each
    game from the last batch that lists it. A game whose new plays are fewer, or none, so leaves nothing old
    behind. A batch that runs twice writes the same rows again: its id is in every path. Every ``compact_every``
    batches the tables are merged.
    """
    once = frames
    if "event_time" in frames.columns:
        once = frames.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(
            ["game_id", "frame_index"]
        )

    def update(batch: DataFrame, batch_id: int) -> None:
        tables = incremental.live_tables(batch.sparkSession, folder)
        incremental.update(batch.drop("event_time"), batch_id, catalog, tables, compact_every)

    return (
        once.writeStream.foreachBatch(update)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_plays(spark: SparkSession, folder: str) -> DataFrame:
    """The plays of every game as of the last batch that had frames of it."""
    return incremental.live_tables(spark, folder).latest("plays")


def new_streams(polls: DataFrame, jobs: DataFrame, lateness: str | None = None) -> DataFrame:
    """Stream ids seen for the first time and without a job.

    With ``lateness`` (needs ``polled_at``), ids older than that are forgotten.
    """
    unseen = polls.withColumnRenamed("id", "stream_id").join(
        jobs.select("stream_id"), "stream_id", "left_anti"
    )
    if lateness is not None:
        return unseen.withWatermark("polled_at", lateness).dropDuplicatesWithinWatermark(["stream_id"])
    return unseen.dropDuplicates(["stream_id"])


def job_status(job_events: DataFrame) -> DataFrame:
    """Latest status per job, for update or complete mode."""
    return discovery.latest_status(job_events)


def new_channels(
    messages: DataFrame, channels: DataFrame, channel_id: int | None = None, author: str | None = None,
    lateness: str | None = None,
) -> DataFrame:
    """Channels linked in a stream of messages that are not listed yet, once each.

    With ``channel_id``, only watched messages count: those of that channel, and of authors whose name has ``author`` in
    it. With ``lateness`` (needs ``ts``), channels seen longer ago than that are forgotten, so that state is bounded.
    """
    watched = messages if channel_id is None else discovery.watched_messages(messages, channel_id, author)
    if lateness is not None:
        watched = watched.withWatermark("ts", lateness)
    time = [] if lateness is None else ["ts"]
    links = watched.select(*time, F.explode(discovery.linked_channels(discovery.message_texts())).alias("channel"))
    once = links.dropDuplicates(["channel"]) if lateness is None else links.dropDuplicatesWithinWatermark(["channel"])
    known = channels.select(F.lower("channel").alias("_name")).distinct()
    return once.join(known, once["channel"] == F.col("_name"), "left_anti").select("channel")


def run_to_table(
    df: DataFrame, name: str, checkpoint: str, mode: str = "append",
    start: Callable[[StreamingQuery], None] = lambda query: query.awaitTermination(),
) -> DataFrame:
    """Run a stream over what is there now into a Parquet table beside ``checkpoint``.

    Rows go from the executors to the table. In complete mode each batch replaces it.
    """
    if mode not in ("append", "complete"):
        raise ValueError(f"mode {mode} has no table as its result")
    spark, out = df.sparkSession, f"{checkpoint}-rows"
    spark.createDataFrame([], df.schema).write.mode("ignore").parquet(out)
    writer = df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    start(writer.trigger(availableNow=True).start())
    return spark.read.schema(df.schema).parquet(out)

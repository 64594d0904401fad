"""Channels, links, live polls and recording jobs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcount import constants as C


def _lower(name: str) -> Column:
    return F.lower(F.trim(name))


def ordered_distinct(df: DataFrame, value: str, position: str) -> DataFrame:
    """First occurrence of each value."""
    return df.groupBy(value).agg(F.min(position).alias(position))


def normalize_channels(channels: DataFrame) -> DataFrame:
    """Trimmed, lower-cased, non-empty channels; the first of each is kept."""
    names = channels.select("position", _lower("channel").alias("channel"))
    return ordered_distinct(names.filter("channel <> ''"), "channel", "position")


def split_channel_status(channels: DataFrame, live: DataFrame) -> DataFrame:
    """Every channel in order, ``streaming`` or ``offline``."""
    live = live.select("channel").distinct().withColumn("_live", F.lit(True))
    status = F.when(F.col("_live"), "streaming").otherwise("offline")
    return channels.join(live, "channel", "left").select(
        "position", "channel", status.alias("status")
    )


def message_texts() -> Column:
    """All texts of a message: content, embed fields, field values."""
    embeds = F.transform(
        "embeds",
        lambda e: F.concat(
            F.array(e["url"], e["title"], e["description"], e["author_url"]),
            F.coalesce(
                F.transform(e["fields"], lambda f: f["value"]), F.array().cast("array<string>")
            ),
        ),
    )
    texts = F.concat(
        F.array("content"),
        F.coalesce(F.flatten(embeds), F.array().cast("array<string>")),
    )
    return F.filter(texts, lambda t: t.isNotNull() & (t != ""))


def linked_channels(texts: Column) -> Column:
    """Stream channels linked in an array of texts, in order, once each."""
    pattern = r"(?i)https?://(?:www\.)?twitch\.tv/([A-Za-z0-9_]+)"
    found = F.flatten(
        F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(1)))
    )
    names = F.transform(found, lambda name: F.lower(name))
    kept = F.filter(names, lambda name: ~name.isin(*C.RESERVED_CHANNEL_PATHS))
    return F.array_distinct(kept)


def watched_messages(messages: DataFrame, channel_id: int, author: str | None = None) -> DataFrame:
    df = messages.filter(F.col("channel_id") == channel_id)
    if author:
        df = df.filter(F.lower("author").contains(author.lower()))
    return df


def since_cutoff(messages: DataFrame, now: Column, hours: int) -> DataFrame:
    """Messages newer than ``hours`` before ``now``; order by ts when reading them."""
    return messages.filter(F.col("ts") > now - F.expr(f"interval {int(hours)} hours"))


def discovered_channels(messages: DataFrame) -> DataFrame:
    """(channel, ts, message_id, pos): first link to each channel."""
    links = messages.select(
        "ts", "message_id", F.posexplode(linked_channels(message_texts())).alias("pos", "channel")
    )
    first = F.min(F.struct("ts", "message_id", "pos")).alias("_first")
    return links.groupBy("channel").agg(first).select("channel", "_first.*")


def add_channels(channels: DataFrame, found: DataFrame) -> DataFrame:
    """Found channels that are not listed yet, ignoring case."""
    known = channels.select(F.lower("channel").alias("_name")).distinct()
    return found.join(known, F.lower(found["channel"]) == F.col("_name"), "left_anti")


def public_streams(rows: DataFrame) -> DataFrame:
    """Stream rows of a public poll, with a key made of what is known."""
    started = F.coalesce(
        F.nullif("release_timestamp", F.lit(0)), F.nullif("timestamp", F.lit(0))
    )
    source = F.coalesce(F.nullif("source_id", F.lit("")), F.col("channel"))
    key = F.concat_ws(
        "-", F.lit("public"), "channel", source, F.coalesce(started.cast("string"), F.lit("live"))
    )
    return rows.filter(F.coalesce("is_live", F.lit(False))).select(
        key.alias("id"), "channel", "title", started.alias("started_at")
    )


def poll_index(rows: DataFrame) -> DataFrame:
    """Last row of each login that has a login and an id."""
    df = rows.withColumn("channel", F.lower("user_login")).filter(
        F.coalesce((F.col("channel") != "") & (F.col("id") != ""), F.lit(False))
    )
    return (
        df.groupBy("channel")
        .agg(F.max_by(F.struct("id", "title", "started_at"), "pos").alias("_s"))
        .select("channel", "_s.*")
    )


def new_streams(polls: DataFrame, jobs: DataFrame, detected_at: Column) -> DataFrame:
    """Polled streams without a job, as jobs that start recording."""
    return (
        polls.withColumnRenamed("id", "stream_id")
        .join(jobs.select("stream_id"), "stream_id", "left_anti")
        .select(
            "stream_id", "channel", "title", "started_at",
            detected_at.cast("string").alias("detected_at"), F.lit("recording").alias("status"),
        )
    )


def should_record(polls: DataFrame, jobs: DataFrame, running: DataFrame) -> DataFrame:
    """Polled streams that are not running and are new or still to be recorded."""
    others = jobs.filter(~F.col("status").eqNullSafe(F.lit("recording"))).select("stream_id")
    df = polls.withColumnRenamed("id", "stream_id")
    df = df.join(running.select("stream_id"), "stream_id", "left_anti")
    return df.join(others, "stream_id", "left_anti")


def job_counts(jobs: DataFrame) -> DataFrame:
    """How many jobs record, wait, and analyse, in one row."""
    names = {"recording": "recording", "awaiting_analysis": "queued", "analyzing": "analyzing"}
    return jobs.agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in names.items()))


def active_channel(jobs: DataFrame) -> DataFrame:
    """Channel of the first job in analysis, in one row."""
    channel = F.coalesce(F.nullif("channel", F.lit("")), F.lit("Unknown channel"))
    first = F.min_by(channel, F.when(F.col("status") == "analyzing", F.col("position")))
    return jobs.agg(first.alias("channel"))


def latest_status(job_events: DataFrame) -> DataFrame:
    """Current status of each job from its events."""
    last = F.max_by(F.struct("channel", "status"), "seq").alias("_last")
    return job_events.groupBy("stream_id").agg(last).select("stream_id", "_last.*")

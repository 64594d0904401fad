"""A closer look at the banner for calls the catalog does not know."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapcount import constants as C
from snapcount.functions import text as P
from snapcount.functions.similarity import text_consensus
from snapcount.operators import sequence as S
from snapcount.operators.catalog import Catalog, validate_calls
from snapcount.operators.repairs import SUMMARIES
from snapcount.operators.sequence import Sequence
from snapcount.session import cut

SIDES = {"off": "offense", "def": "defense"}


def rescan_banners(
    summaries: DataFrame, observations: DataFrame, bucket: int = 16
) -> DataFrame:
    """The first visible banner of each second of each summary's window.

    A window runs from the start to a second past the end, at most 12 seconds.
    Both sides meet on (game, time bucket), so a long game is many join keys.
    """
    start = F.col("start_timestamp_seconds")
    stop = F.least(F.col("end_timestamp_seconds") + 1.0, start + C.RESCAN_SECONDS)
    windows = summaries.select(
        "game_id",
        "spot",
        start.alias("_start"),
        stop.alias("_stop"),
        F.explode(
            F.sequence(
                F.floor(start / bucket),
                F.floor(stop / bucket),
            )
        ).alias("_bucket"),
    )
    seen = observations.filter(F.coalesce("panel_visible", F.lit(False))).withColumn(
        "_bucket", F.floor(F.col("timestamp_seconds") / bucket)
    )
    inside = windows.join(seen, ["game_id", "_bucket"]).filter(
        F.col("timestamp_seconds").between(F.col("_start"), F.col("_stop"))
    )
    second = F.floor(F.col("timestamp_seconds") - F.col("_start")).cast("int")
    read = F.struct("timestamp_seconds", "off_text", "def_text", "heading")
    return (
        inside.groupBy("game_id", "spot", second.alias("second"))
        .agg(F.min_by(read, "timestamp_seconds").alias("_read"))
        .select("game_id", "spot", "second", "_read.*")
    )


def candidate_consensus(candidates: DataFrame, catalog: Catalog, side: str) -> DataFrame:
    """(game_id, spot, voted): the catalog name a summary's candidates support.

    ``candidates`` holds (game_id, spot, pos, text, formation). The name with
    most candidates is picked first, then tested: two or more, and one exact
    or two different spellings.
    """
    df = validate_calls(candidates, catalog, "text", side, "_m", "formation")
    per_name = (
        df.filter(F.col("_m").isNotNull())
        .groupBy("game_id", "spot", "_m")
        .agg(
            F.count("*").alias("n"),
            F.bool_or(F.col("_m_status") == "verified").alias("exact"),
            F.count_distinct(P.compact_key("text")).alias("spellings"),
            (-F.min("pos")).alias("first"),
        )
    )
    best = per_name.groupBy("game_id", "spot").agg(
        F.max_by(F.struct("_m", "n", "exact", "spellings"), F.struct("n", "first")).alias("b")
    )
    good = (F.col("b.n") >= 2) & (F.col("b.exact") | (F.col("b.spellings") >= 2))
    return best.select("game_id", "spot", F.when(good, F.col("b._m")).alias("voted"))


def refine_calls(
    summaries: DataFrame,
    observations: DataFrame,
    catalog: Catalog,
    seq: Sequence = SUMMARIES,
) -> DataFrame:
    """Replace unknown calls by what the banner shows in its window.

    Adds the evidence columns. A side whose call is already known is left alone
    and gets no evidence. A window has at most 13 looks, so the candidates of
    one summary are always few.
    """
    keys = [*seq.keys, seq.order]
    df = S.scan(summaries, seq, _before_formation=S.before(F.col("_formation")))
    for short, side in SIDES.items():
        formation = "_before_formation" if short == "off" else None
        df = validate_calls(df, catalog, f"_prev_{short}", side, f"_known_{short}", formation)
        known = F.col(f"_known_{short}_status").isin("verified", "verified_fuzzy")
        df = df.withColumn(f"_needs_{short}", ~known).drop(
            f"_known_{short}", f"_known_{short}_status"
        )
    # Rows, looks and candidates are read several times each.
    df = cut(df)
    open_rows = df.filter(F.col("_needs_off") | F.col("_needs_def"))
    looks = cut(rescan_banners(open_rows, observations))
    headings = looks.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.nullif("heading", F.lit("")))).alias("_headings")
    )
    df = df.join(headings, keys, "left")
    for short, side in SIDES.items():
        call = f"_prev_{short}"
        needing = open_rows.filter(f"_needs_{short}").select(
            *keys, F.col(call).alias("text"), F.col("_before_formation").alias("formation")
        )
        seen = looks.select(*keys, "second", F.col(f"{short}_text").alias("text"))
        candidates = cut(
            needing.withColumn("pos", F.lit(-1))
            .unionByName(
                seen.join(needing.drop("text"), keys).withColumnRenamed("second", "pos")
            )
            .filter("text is not null and text <> ''")
        )
        listed = candidates.groupBy(*keys).agg(
            F.sort_array(F.collect_list(F.struct("pos", "text")))["text"].alias("_texts")
        )
        listed = listed.select(
            *keys,
            F.size("_texts").alias("_count"),
            text_consensus("_texts").alias("_refined"),
            F.array_sort(F.array_distinct("_texts")).alias("_evidence"),
        )
        voted = candidate_consensus(candidates, catalog, side).withColumnRenamed(
            "voted", "_voted"
        )
        better = (F.col("_count") >= 3) & (
            P.call_quality("_refined") >= P.call_quality(call)
        )
        df = (
            df.join(listed, keys, "left")
            .join(voted, keys, "left")
            .withColumns(
                {
                    call: F.when(F.col("_voted").isNotNull(), F.col("_voted"))
                    .when(better, F.col("_refined"))
                    .otherwise(F.col(call)),
                    f"_prev_{short}_evidence": F.coalesce(
                        "_evidence", F.array().cast("array<string>")
                    ),
                }
            )
            .drop("_count", "_refined", "_evidence", "_voted")
        )
    return df.withColumn(
        "_banner_heading_evidence", F.coalesce("_headings", F.array().cast("array<string>"))
    ).drop("_headings", "_before_formation", "_needs_off", "_needs_def")

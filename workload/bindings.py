"""Game tables derived from the given tables.

Every text here is SQL that Spark and DuckDB both run, so that a query and its
check start from the same rows. One user of ``events`` is one game, one event is
one frame; values follow from counters, with gaps and misreads mixed in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snapcount.session import ship_package

FRAMES = """
with numbered as (
  select user_id as u, event_id as e, event_type as kind, value,
         cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as k
  from events
), steps as (
  select *, cast(floor(k / 4) as int) as s,
         5 * cast(floor(k / 4) as int) + cast(u % 13 as int) as t
  from numbered
), cycles as (
  select *, cast(floor(t / 13) as int) as c, t % 13 as r,
         case when t % 13 = 0 then 'extra_point' when t % 13 = 5 then 'kickoff' end as sp,
         case when kind = 'error' then true else false end as gap,
         case when u % 10 = 9 then null else 'A' || cast(u % 32 as string) end as aw,
         case when u % 15 = 7 then null else 'H' || cast(u % 32 as string) end as ho,
         greatest(420 - (k % 17) * 26 + case when e % 23 = 0 then 30 else 0 end, 0) as sec
  from steps
)
select 'g' || cast(u as string) as game_id,
       cast(k as bigint) as frame_index,
       cast(k as double) as timestamp_seconds,
       case when e % 5 <> 0 then cast(least(4, 1 + floor(k / 17)) as int)
            when e % 2 = 0 then cast(1 + e % 4 as int) end as quarter,
       case when e % 4 <> 1 then cast(cast(floor(sec / 60) as int) as string) || ':'
            || lpad(cast(sec % 60 as string), 2, '0') end as game_clock,
       case when sp is not null or gap then null
            when e % 17 = 0 then cast(1 + e % 4 as int)
            else cast((s * (1 + u % 3) + u) % 4 + 1 as int) end as down,
       case when sp is not null or gap then null
            when (s + u) % 6 = 0 then 0
            when (s + u) % 6 = 1 then null
            else cast(10 - (s * 3 + u) % 8 as int) end as distance,
       case when e % 31 = 0 then null else sp end as special_state,
       case when gap then null
            when e % 11 = 0 then cast(e % 50 + 1 as int)
            else cast((s * 11 + u * 3) % 50 + 1 as int) end as yard_line,
       case e % 5 when 0 then 'own' when 1 then 'opponent' end as field_side,
       case e % 9 when 0 then 'offense' when 1 then 'defense' end as stream_side,
       case when e % 7 < 3 then cast(1 + s % 2 as string) || ' RB, 1 TE, 3 WR' end as personnel,
       case e % 7 when 0 then 'Gun - Trips TE' when 1 then 'Singleback - Ace' end as formation,
       case when e % 29 = 0 then 'XXX' else aw end as away_team,
       case when e % 37 = 0 then 'YYY' else ho end as home_team,
       case e % 6 when 0 then aw when 1 then ho when 2 then 'NVJ' end as possession_team,
       case when gap then null
            else cast(7 * floor((c + 1) / 2) as int)
                 - case when r < 5 and c % 2 = 1 then 1 else 0 end
                 + case when e % 19 = 0 then 20 else 0 end end as away_score,
       case when gap then null
            else cast(7 * floor(c / 2) as int)
                 - case when r < 5 and c % 2 = 0 and c > 0 then 1 else 0 end
                 + case when e % 41 = 0 then 30 else 0 end end as home_score,
       kind = 'click' as previous_play_banner_shown,
       cast(null as string) as prev_def_call,
       cast(null as string) as prev_off_call,
       e as event_id,
       value as diff_score
from cycles
"""

SUMMARIES = f"""
select game_id, frame_index as spot,
       timestamp_seconds as start_timestamp_seconds,
       timestamp_seconds + 0.125 * (event_id % 7) as end_timestamp_seconds,
       quarter, game_clock, down, distance,
       cast(down as string) || ' & ' || case when distance = 0 then 'inches'
            else cast(distance as string) end as down_distance,
       special_state, yard_line, field_side,
       field_side as _field_side_observed,
       stream_side as _stream_side, personnel as _personnel, formation as _formation,
       away_team, home_team, possession_team,
       possession_team as _possession_team_observed,
       away_score, home_score,
       previous_play_banner_shown as _banner_shown,
       prev_off_call as _prev_off, prev_def_call as _prev_def,
       event_id
from ({FRAMES}) f
"""

PLAYS = f"""
select s.*, cast(spot as int) as play_number,
       case event_id % 6 when 0 then 'run' when 1 then 'pass' when 2 then 'extra_point'
            when 3 then '' end as play_type,
       case event_id % 7 when 0 then 'touchdown' when 1 then 'first down' when 2 then ''
            when 3 then 'play run' end as result,
       cast(event_id % 20 as double) / 16 as situation_confidence,
       cast(event_id % 9 as double) / 8 as call_confidence,
       case when event_id % 11 = 0 then null else cast(event_id % 5 as double) / 4 end
            as result_confidence,
       case when event_id % 13 = 0 then null else cast(event_id % 17 as double) / 16 end
            as overall_confidence,
       'play ' || cast(event_id as string) as description,
       case event_id % 8 when 0 then 'small ring' when 1 then 'PREVIOUS PLAY BANNER NOT SHOWN'
            when 2 then 'no such call' end as previous_offensive_play_call,
       case event_id % 9 when 0 then 'RED widget' when 1 then '' end
            as previous_defensive_play_call,
       case event_id % 10 when 0 then 'PAT Kick' when 1 then 'blue bolt' when 2 then 'Kickoff'
            end as offensive_play_call,
       case event_id % 12 when 0 then 'hot   gear' when 1 then 'zzz' end as defensive_play_call,
       case event_id % 5 when 0 then 'verified' when 1 then 'unverified' when 2 then 'unreadable'
            when 3 then '' end as offensive_play_call_validation,
       case event_id % 4 when 0 then 'banner_not_shown' when 1 then 'catalog_unavailable'
            when 2 then 'verified_fuzzy' end as defensive_play_call_validation
from ({SUMMARIES}) s
"""

CATALOG = """
select case when p_partkey % 3 = 0 then 'defense' else 'offense' end as side,
       case when p_partkey % 3 = 0 then 'defense' else 'offense' end as unit,
       'Gun' as formation_family, p_brand as formation,
       lower(p_brand) as formation_slug, p_name as play_name,
       p_name || '-' || cast(p_size as string) as play_slug,
       case when p_partkey % 4 = 0 then null else p_type end as play_type,
       p_size as team_count,
       'catalog/' || cast(p_partkey as string) as source_url,
       p_partkey as pos
from part
"""

CALLS = """
select p_partkey as call_id,
       case p_partkey % 4 when 0 then upper(p_name) when 1 then replace(p_name, ' ', '')
            when 2 then '  ' || replace(p_name, ' ', '-') || '. '
            else replace(p_name, 'e', '3') end as text,
       'Gun - ' || p_brand as formation
from part
"""

MESSAGES = """
select conv_id * 1000 + turn as message_id, conv_id % 3 as channel_id,
       case when role = 'user' then 'Scout Bot' else role end as author,
       timestamp '2024-01-01 00:00:00' as ts, text,
       case when turn % 4 = 0 then 'https://www.twitch.tv/Player_' || cast(conv_id % 40 as string)
            when turn % 4 = 1 then 'HTTP://twitch.tv/videos/12 http://twitch.tv/Side'
                 || cast(conv_id % 7 as string) end as link
from conversations
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Make the given tables visible to the SQL texts above."""
    ship_package(spark)
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def bound(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    known = ("events", "part", "conversations", "pages", "orders", "lineitem", "embeddings")
    tables(spark, sf_dir, *(name for name in known if name in sql))
    return spark.sql(sql)

"""Queries over readings, the catalog, reports, calibration and channels."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapcount import constants as C
from snapcount import schemas
from snapcount.functions import text as P
from snapcount.operators import calibration, catalog as K, discovery, evidence, readings, reports
from snapcount.plans import games
from snapcount.session import checkpoint_dir, cut
from snapcount.sources import files
from snapcount.streaming import finish, live
from workload import bindings as B
from workload import oracles as O
from workload.game_queries import PLAY_COLUMNS, catalog, frames, register, summaries

# Readings -------------------------------------------------------------------

READINGS = """
select 'g' || cast(user_id as string) as game_id, event_id as frame_index,
       cast(event_id as double) as timestamp_seconds,
       case event_id % 6 when 0 then '1ST' when 1 then ' 2nd' when 2 then '3 RD' when 3 then '4TH.'
            when 4 then 'Q 3' else '~~' end as quarter_text,
       case event_id % 7 when 0 then '7:05' when 1 then '17:51' when 2 then '12:61 3:20' when 3 then 'x'
            when 4 then '015:30' when 5 then '9:7 8:99' else '05:09' end as clock_text,
       case event_id % 9 when 0 then '3rd & 7' when 1 then '2ND & 45' when 2 then '4 AND 2'
            when 3 then '1 & INCHES' when 4 then 'KICKOFF' when 5 then 'the PAT try' when 6 then ''
            when 7 then '2 and in' else 'PATS 5' end as down_distance_text,
       case event_id % 4 when 0 then 'OWN 36' when 1 then '123' when 2 then '77' else '' end as yard_text,
       case event_id % 5 when 0 then '07' when 1 then 'x1234' when 2 then '' else cast(event_id % 60 as string)
            end as away_score_text,
       case event_id % 3 when 0 then '14' else '?' end as home_score_text,
       case event_id % 3 when 0 then 'n.y.j' when 1 then 'T' else 'TENN' end as away_team_text,
       case event_id % 4 when 0 then '' else 'Buf' end as home_team_text,
       case event_id % 5 when 0 then 'DEFENSE' when 1 then 'pick a  play' when 2 then 'OFFENSE' else '' end
            as defense_header_text,
       case event_id % 3 when 0 then '~] GUN - HORMAL Y OFF CLOSE' when 1 then 'I FORM  PRO 3X1' else 'nothing'
            end as defense_formation_text,
       case event_id % 2 when 0 then '} 1RBJ1TE|3 WR' else 'none' end as defense_personnel_text,
       case event_id % 4 when 0 then 'YOFFCLOSE' when 1 then 'x SINGLEBACK STOT TE' when 2 then 'gun' else '' end
            as offense_formation_text,
       case event_id % 3 when 0 then '..hb   stretch!!' when 1 then '--' else 'MESH' end as prev_off_text,
       case event_id % 3 when 0 then '' else ' cover 3-sky ' end as prev_def_text,
       case event_id % 3 when 0 then '* PREVIOUS PLAY *' when 1 then 'PREVIOUS' else '' end as heading_text,
       case event_id % 2 when 0 then 0.75 else 0.5 end as panel_dark_ratio,
       case event_id % 3 when 0 then 0.02 else 0.25 end as panel_edge_density,
       case event_id % 4 when 0 then 0.5 when 1 then 0.25 when 2 then 0.0 end as possession_away_ratio,
       case event_id % 3 when 0 then 0.5 when 1 then 0.0625 else 0.125 end as possession_home_ratio,
       cast(event_id % 8 as double) / 64 as edge_density,
       cast(event_id % 5 as double) / 8 as dark_ratio,
       cast(event_id % 7 as double) / 16 as bright_ratio,
       value as diff_score,
       event_id % 10 as m
from events
"""


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.bound(spark, sf_dir, READINGS)
    m = F.col("m").cast("int")
    return df.withColumn(
        "field_side_row_counts",
        F.when(m < 4, F.array(F.lit(0), F.lit(12), F.lit(10), F.lit(8), m, F.lit(2), F.lit(0)))
        .when(m < 8, F.array(F.lit(2), m, F.lit(6), F.lit(8), F.lit(20)))
        .otherwise(F.array(F.lit(0), F.lit(3), m)),
    )


def _norm(x: str) -> str:
    return f"trim(regexp_replace(upper(coalesce({x}, '')), '[^A-Z0-9]+', ' ', 'g'))"


def _compact(x: str) -> str:
    return f"regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g')"


def _got(x: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', {group}), '')"


def _clean(x: str) -> str:
    return (
        "nullif(trim(regexp_replace(regexp_replace(regexp_replace("
        f"upper({x}), '^[^A-Z0-9]+', ''), '[^A-Z0-9]+$', ''), '\\s+', ' ', 'g')), '')"
    )


def _clock(x: str) -> str:
    def first(pattern: str, most: int) -> str:
        return f"""list_filter(regexp_extract_all({x}, '{pattern}'), lambda v:
            cast(split_part(v, ':', 1) as int) <= {most} and cast(split_part(v, ':', 2) as int) < 60)[1]"""

    best = f"coalesce({first('[0-9]{1,2}:[0-9]{2}', 15)}, {first('[0-9]:[0-9]{2}', 9)})"
    return f"cast(cast(split_part({best}, ':', 1) as int) as string) || ':' || split_part({best}, ':', 2)"


def _formation(x: str) -> str:
    fixed = f"""replace(replace(replace(replace({_norm(x)}, 'HORMAL', 'NORMAL'), 'CIOSE', 'CLOSE'),
               'STOT', 'SLOT'), 'YOFFCLOSE', 'Y OFF CLOSE')"""
    kept = f"""coalesce(nullif(regexp_extract({fixed}, '\\b(?:{'|'.join(C.FORMATION_FAMILIES)})\\b.*'), ''),
               case when contains({fixed}, 'Y OFF CLOSE') then {fixed} end)"""
    words = f"""list_transform(string_split({kept}, ' '), lambda w: case when w = 'TE' then w else
        array_to_string(list_transform(regexp_extract_all(w, '[A-Z]+|[0-9]+'),
          lambda p: substr(p, 1, 1) || lower(substr(p, 2))), '') end)"""
    heads = ", ".join(f"'{name}'" for name in C.DASHED_FAMILIES)
    return f"""case when {kept} is null then null
        when ({words})[1] in ({heads}) and len({words}) > 1
        then ({words})[1] || ' - ' || array_to_string(({words})[2:], ' ')
        else array_to_string({words}, ' ') end"""


_QT = _compact("quarter_text")
_UP = "upper(down_distance_text)"
_AMP, _AND = "([1-4]).*?&\\s*(\\d{1,2})", "([1-4]).*?AND\\s*(\\d{1,2})"
_INCH = "([1-4]).*?(?:&|AND).*?IN(?:CH(?:ES)?)?"
_DEF = f"""(contains({_norm('defense_header_text')}, 'DEFEN') or (contains({_norm('defense_header_text')}, 'PICK')
  and contains({_norm('defense_header_text')}, 'PLA')))"""
_TEAM = "case when length({0}) >= 2 then substr({0}, 1, 3) end"
_AWAY = _TEAM.format("regexp_replace(upper(away_team_text), '[^A-Z]', '', 'g')")
_HOME = _TEAM.format("regexp_replace(upper(home_team_text), '[^A-Z]', '', 'g')")
_NUM = f"coalesce({_got(_UP, _AMP, 1)}, {_got(_UP, _AND, 1)})"
_YDS = f"cast(case when {_got(_UP, _AMP, 1)} is not null then {_got(_UP, _AMP, 2)} else {_got(_UP, _AND, 2)} end as int)"
_VIS = "(panel_dark_ratio >= 0.55 and panel_edge_density >= 0.04)"
_YARD = "try_cast(regexp_extract_all(yard_text, '[0-9]{1,2}')[-1] as int)"
_RA, _RH = "coalesce(possession_away_ratio, 0)", "coalesce(possession_home_ratio, 0)"
_PERS = "(\\d)\\s*RB.*?(\\d)\\s*TE.*?(\\d)\\s*WR"
_PN = _norm("defense_personnel_text")

PARSED = f"""
select game_id, frame_index, timestamp_seconds,
  cast(case when contains({_QT}, 'ND') then 2 when contains({_QT}, 'RD') then 3 when contains({_QT}, 'TH') then 4
       when contains({_QT}, 'ST') then 1 else try_cast({_got(_QT, '[1-4]')} as int) end as int) as quarter,
  {_clock('clock_text')} as game_clock,
  cast(coalesce({_NUM}, {_got(_UP, _INCH, 1)}) as int) as down,
  cast(case when {_NUM} is not null then case when {_YDS} between 0 and 40 then {_YDS} end
       when {_got(_UP, _INCH, 1)} is not null then 0 end as int) as distance,
  case when contains({_norm('down_distance_text')}, 'KICKOFF') then 'kickoff'
       when regexp_matches({_norm('down_distance_text')}, '\\bPAT\\b') then 'extra_point' end as special_state,
  case when {_YARD} between 1 and 50 then {_YARD} end as yard_line,
  case when m < 4 then case when m = 0 or 12 + 10 > (8 + m + 2) * 1.15 then 'own' end
       when m < 8 then 'opponent' end as field_side,
  case when {_DEF} then 'defense' when {_formation('offense_formation_text')} is not null then 'offense' end as stream_side,
  case when {_DEF} and regexp_matches({_PN}, '{_PERS}') then regexp_extract({_PN}, '{_PERS}', 1) || ' RB, ' ||
       regexp_extract({_PN}, '{_PERS}', 2) || ' TE, ' || regexp_extract({_PN}, '{_PERS}', 3) || ' WR' end as personnel,
  case when {_DEF} then {_formation('defense_formation_text')} else {_formation('offense_formation_text')} end as formation,
  {_AWAY} as away_team, {_HOME} as home_team,
  case when {_AWAY} is not null and {_RA} >= 0.08 and {_RA} > {_RH} * 1.5 then {_AWAY}
       when {_HOME} is not null and {_RH} >= 0.08 and {_RH} > {_RA} * 1.5 then {_HOME} end as possession_team,
  try_cast({_got('away_score_text', '[0-9]{1,3}')} as int) as away_score,
  try_cast({_got('home_score_text', '[0-9]{1,3}')} as int) as home_score,
  {_VIS} as previous_play_banner_shown,
  case when {_VIS} then {_clean('prev_def_text')} end as prev_def_call,
  case when {_VIS} then {_clean('prev_off_text')} end as prev_off_call
from readings"""

register(
    "parse_readings",
    lambda spark, sf: readings.parse_readings(_readings(spark, sf)),
    O.chain(("readings", READINGS), last=PARSED),
)
register(
    "banner_observations",
    lambda spark, sf: readings.banner_observations(_readings(spark, sf)),
    O.chain(("readings", READINGS), last=f"""
      select game_id, timestamp_seconds, {_clean('prev_off_text')} as off_text, {_clean('prev_def_text')} as def_text,
             case when contains({_clean('heading_text')}, 'PREVIOUS') and contains({_clean('heading_text')}, 'PLAY')
                  then {_clean('heading_text')} end as heading,
             {_VIS} as panel_visible from readings"""),
)
_SEEN = """(least(1.0, edge_density / 0.12::double) * 0.4::double + least(1.0, dark_ratio / 0.45::double) * 0.2::double
  + least(1.0, bright_ratio / 0.35::double) * 0.2::double
  + case when regexp_matches(clock_text || ' ' || down_distance_text, '\\b[0-5]?[0-9]:[0-5][0-9]\\b') then 0.2::double else 0 end
  + case when regexp_matches(clock_text || ' ' || down_distance_text, '\\b[1-4][A-Z]{0,2}\\s*&\\s*[0-9]{1,2}\\b')
         then 0.2::double else 0 end)"""
register(
    "visible_scoreboards",
    lambda spark, sf: readings.filter_visible(_readings(spark, sf), 0.6)[1],
    O.chain(("readings", READINGS), last=f"""
      select game_id, count(*) filter ({_SEEN} >= 0.6) as kept, count(*) filter ({_SEEN} < 0.6) as skipped
      from readings group by game_id"""),
)
register(
    "call_types",
    lambda spark, sf: B.bound(spark, sf, B.CALLS).select(
        "call_id", P.infer_play_type(F.concat("text", F.when(F.col("call_id") % 3 == 0, " hb dive")
        .when(F.col("call_id") % 3 == 1, " pa post").otherwise(" pat"))).alias("play_type"),
        P.call_quality(F.concat("text", F.lit(" HB dive dog curl HB"))).alias("quality"),
        P.normalize_text("text").alias("norm"), P.compact_key("text").alias("compact"),
    ),
    O.chain(("calls", B.CALLS), last=f"""
      select call_id, case call_id % 3 when 0 then 'run' when 1 then 'pass' else 'extra_point' end as play_type,
             cast(5 as int) as quality, {_norm('text')} as norm, {_compact('text')} as compact from calls"""),
)

# Catalog --------------------------------------------------------------------

register(
    "catalog_names",
    lambda spark, sf: K.catalog_names(catalog(spark, sf).plays),
    O.chain(("c", B.CATALOG), last="select distinct side, play_name from c"),
)
register(
    "catalog_unit_counts",
    lambda spark, sf: K.unit_counts(catalog(spark, sf).plays),
    O.chain(("c", B.CATALOG), last="select coalesce(unit, 'total') as unit, count(*) as plays from c group by rollup(unit)"),
)
_RAW = """
select case when p_partkey % 3 = 0 then 'defense' else 'offense' end as side,
       case when p_partkey % 7 = 0 then 'Special Teams' else p_type end as formationFamily, p_brand as formation,
       lower(p_brand) as formationSlug, p_name as playName, replace(p_name, ' ', '-') as playSlug,
       case when p_partkey % 11 = 0 then 'punt' else p_type end as playType, p_size as teamCount,
       cast(p_partkey as int) as page, cast(p_partkey % 5 as int) as pos from part
"""


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = B.bound(spark, sf_dir, _RAW)
    return K.build_catalog(raw.filter("side = 'offense'"), raw.filter("side = 'defense'"), "site")


register(
    "build_catalog",
    _built,
    O.chain(
        ("raw", _RAW),
        ("kept", """select * from raw qualify row_number() over (
            partition by side, formationSlug, playSlug order by page desc, pos desc) = 1"""),
        last="""select side, case when regexp_matches(upper(concat_ws(' ', formationFamily, formation, playName, playType)),
                  'SPECIAL TEAM|KICKOFF|FIELD GOAL|PUNT|FAKE FG|FAKE PUNT') then 'special_teams' else side end as unit,
                formationFamily as formation_family, formation, formationSlug as formation_slug, playName as play_name,
                playSlug as play_slug, playType as play_type, teamCount as team_count,
                'site/' || side || '/' || formationSlug || '/' || playSlug as source_url,
                row_number() over (order by side, formationFamily, formation, playName, formationSlug, playSlug) - 1 as pos
         from kept"""),
)
_EXACT = f"""select c.call_id, n.name from calls c left join (
    select compact, min(play_name) as name from (select distinct side, play_name, {_compact('play_name')} as compact
      from c0 where side = 'offense') group by compact having count(*) = 1) n on n.compact = {_compact('c.text')}"""
register(
    "exact_catalog_match",
    lambda spark, sf: B.bound(spark, sf, B.CALLS)
    .withColumn("compact", P.compact_key("text"))
    .join(K.exact_names(catalog(spark, sf).names).filter("side = 'offense'"), "compact", "left")
    .select("call_id", F.col("exact_name").alias("name")),
    O.chain(("calls", B.CALLS), ("c0", B.CATALOG), last=_EXACT),
)
register(
    "catalog_facts",
    lambda spark, sf: K.offense_facts(catalog(spark, sf).plays).select(
        "norm", "url", F.col("only_type").isNotNull().alias("one_type"), "unique_formation"
    ),
    O.chain(("c", B.CATALOG), last=f"""
      select {_norm('play_name')} as norm, arg_min(source_url, pos) as url,
             count(distinct coalesce(play_type, '-')) = 1 as one_type,
             case when count(distinct formation_family || '|' || formation) = 1
                  then min(formation_family || ' - ' || formation) end as unique_formation
      from c where side = 'offense' group by all"""),
)
register(
    "catalog_play_types",
    lambda spark, sf: B.bound(spark, sf, B.CALLS)
    .withColumn("norm", P.normalize_text("text"))
    .join(K.offense_facts(catalog(spark, sf).plays), "norm", "left")
    .select("call_id", K.catalog_play_type(F.col("formation")).alias("play_type")),
    O.chain(
        ("calls", B.CALLS), ("c", B.CATALOG),
        ("o", f"select *, {_norm('play_name')} as norm, {_compact('formation_family || formation')} as fkey from c where side = 'offense'"),
        ("by_name", "select norm, count(distinct coalesce(play_type, '-')) as n, min(play_type) as t from o group by norm"),
        ("by_place", "select norm, fkey, count(distinct coalesce(play_type, '-')) as n, min(play_type) as t from o group by norm, fkey"),
        last=f"""select call_id, case when p.n = 1 then p.t when n.n = 1 then n.t end as play_type
          from calls left join by_name n on n.norm = {_norm('text')}
          left join by_place p on p.norm = {_norm('text')} and p.fkey = {_compact('calls.formation')}"""),
)
register(
    "formation_names",
    lambda spark, sf: K.formation_names(catalog(spark, sf).plays).select(
        "formation_key", F.array_join("names", ",").alias("names")
    ),
    O.chain(("c", B.CATALOG), last=f"""
      select formation_key, string_agg(play_name, ',' order by lower(play_name), play_name) as names from (
        select distinct {_compact('formation_family || formation')} as formation_key, play_name from c where side = 'offense')
      group by formation_key"""),
)
register(
    "validate_calls",
    lambda spark, sf: K.validate_calls(
        B.bound(spark, sf, B.CALLS), catalog(spark, sf), "text", "offense", "name", "formation"
    ).select("call_id", "text", "name", "name_status"),
    O.CHECKED_CALLS,
)


def _by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same check by joins, as for a catalog too large to broadcast."""
    large = catalog(spark, sf_dir)
    large._small = False
    return K.validate_calls(
        B.bound(spark, sf_dir, B.CALLS), large, "text", "offense", "name", "formation"
    ).select("call_id", "text", "name", "name_status")


register("validate_calls_by_blocks", _by_blocks, O.CHECKED_CALLS)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = B.bound(spark, sf_dir, B.CALLS)
    return calls.select(
        (F.col("call_id") % 50).cast("string").alias("game_id"), (F.col("call_id") % 7).alias("spot"),
        F.col("call_id").alias("pos"), "text", F.lit(None).cast("string").alias("formation"),
    )


register(
    "candidate_consensus",
    lambda spark, sf: evidence.candidate_consensus(_candidates(spark, sf), catalog(spark, sf), "offense"),
    O.CANDIDATES,
)
register(
    "text_consensus",
    lambda spark, sf: _consensus(spark, sf),
    O.CONSENSUS,
)


def _consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snapcount.operators.spots import consensus_by_key

    return consensus_by_key(_candidates(spark, sf_dir), ["game_id", "spot"], "pos", "text")


_OBS = f"""select game_id, timestamp_seconds + 0.5 as timestamp_seconds, 'c' || cast(event_id % 9 as string) as off_text,
  case when event_id % 4 = 0 then 'd' end as def_text, cast(null as string) as heading, event_id % 3 <> 0 as panel_visible
  from ({B.FRAMES}) f"""
register(
    "rescan_banners",
    lambda spark, sf: evidence.rescan_banners(summaries(spark, sf), B.bound(spark, sf, _OBS)).select(
        "game_id", "spot", "second", "timestamp_seconds", "off_text", "def_text"
    ),
    O.chain(("s", B.SUMMARIES), ("o", _OBS), last="""
      select s.game_id, s.spot, cast(floor(o.timestamp_seconds - s.start_timestamp_seconds) as int) as second,
             o.timestamp_seconds, o.off_text, o.def_text
      from s join o on o.game_id = s.game_id and o.panel_visible and o.timestamp_seconds between
        s.start_timestamp_seconds and least(s.end_timestamp_seconds + 1, s.start_timestamp_seconds + 12)
      qualify row_number() over (partition by s.game_id, s.spot, second order by o.timestamp_seconds) = 1"""),
)
_HTML = """select case when page_id % 2 = 0 then 'offense' else 'defense' end as side, cast(page_id as int) as page,
  html || case when page_id % 3 = 0 then '' else
    '<script>self.__next_f.push([1,"{\\\\"totalPages\\\\":' || cast(1 + page_id % 4 as string) ||
    ',\\\\"plays\\\\":[{\\\\"side\\\\":\\\\"offense\\\\",\\\\"formationSlug\\\\":\\\\"f\\\\",\\\\"playSlug\\\\":\\\\"p' ||
    cast(page_id as string) || '\\\\",\\\\"teamCount\\\\":' || cast(page_id % 9 as string) || '}]}"])</script>' end as html
  from pages"""


def _parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays, _ = K.parse_pages(B.bound(spark, sf_dir, _HTML))
    return plays.select("page", "total_pages", "side", "playSlug", "teamCount")


register(
    "parse_catalog_pages",
    _parsed_pages,
    """select cast(page_id as int) as page, cast(1 + page_id % 4 as int) as total_pages, 'offense' as side,
              'p' || page_id as playSlug, cast(page_id % 9 as int) as teamCount from pages where page_id % 3 <> 0""",
)

_CALL_TEXT = """case e % 4 when 0 then 'RED WIDGET' when 1 then 'RED W1DGET' when 2 then 'blue-bolt' else 'zz' end"""
_CALLED = B.FRAMES.replace(
    "cast(null as string) as prev_off_call", f"case when kind = 'click' then {_CALL_TEXT} end as prev_off_call"
)
_CALLED_SUMMARIES = B.SUMMARIES.replace(B.FRAMES, _CALLED)
_LOOKS = f"""select game_id, timestamp_seconds + 0.5 as timestamp_seconds,
  case event_id % 3 when 0 then 'RED WIDGET' when 1 then 'RED WIDGETS' else 'HOT GEAR' end as off_text,
  'zz' as def_text, 'PREVIOUS PLAY' as heading, event_id % 3 <> 0 as panel_visible
  from ({B.FRAMES}) f"""
register(
    "refine_calls",
    lambda spark, sf: evidence.refine_calls(
        B.bound(spark, sf, _CALLED_SUMMARIES), B.bound(spark, sf, _LOOKS), catalog(spark, sf)
    ).select(
        "game_id", "spot", "_prev_off", "_prev_def",
        F.array_join("_prev_off_evidence", ",").alias("off_evidence"),
        F.array_join("_banner_heading_evidence", ",").alias("headings"),
    ),
    O.refined(_CALLED_SUMMARIES, _LOOKS, f"""len(list_filter(string_split(trim(regexp_replace(upper(coalesce({{0}}, '')),
      '[^A-Z0-9]+', ' ', 'g')), ' '), lambda w: list_contains({list(C.QUALITY_TOKENS)}, w)))"""),
)


def _plays_with_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All plays, their calls read from banners and checked against the catalog."""
    df = games.plays_from_frames(
        B.bound(spark, sf_dir, _CALLED), catalog(spark, sf_dir), B.bound(spark, sf_dir, _LOOKS)
    )
    return files.play_rows(df)


register("published_plays_with_calls", _plays_with_calls)

# Reports --------------------------------------------------------------------


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.bound(spark, sf_dir, B.PLAYS)
    e = F.col("event_id")
    return df.withColumn(
        "transition_evidence",
        F.array_compact(
            F.array(F.when(e % 2 == 0, "special_state"), F.when(e % 3 == 0, "score_change"))
        ),
    )


def _report(name, work, last):
    register(name, lambda spark, sf: work(plays(spark, sf)), O.chain(("p", B.PLAYS), last=last))


_report("duplicate_intervals", lambda p: reports.duplicate_intervals(
    p.withColumn("start_timestamp_seconds", F.floor(F.col("start_timestamp_seconds") / 3).cast("double"))
     .withColumn("end_timestamp_seconds", F.floor(F.col("end_timestamp_seconds") / 5).cast("double"))),
    """select game_id, floor(start_timestamp_seconds / 3) as start_timestamp_seconds,
              floor(end_timestamp_seconds / 5) as end_timestamp_seconds, count(*) as plays
       from p group by all having count(*) > 1""")
_report("possession_anomalies", reports.possession_anomalies,
    """select game_id, play_number, possession_team from p where possession_team is not null
       and not (possession_team is not distinct from away_team or possession_team is not distinct from home_team)""")
_report("low_confidence_plays", reports.low_confidence,
    "select game_id, play_number, overall_confidence, description from p where coalesce(overall_confidence, 0) < 0.7")
_report("missing_fields", reports.missing_fields, " union all ".join(
    f"select game_id, '{n}' as field, count(*) as plays from p where {n} is null or cast({n} as string) = '' group by game_id"
    for n in C.REQUIRED_PLAY_FIELDS))
_report("play_type_counts", lambda p: reports.value_counts(p, "play_type"),
    "select game_id, coalesce(nullif(play_type, ''), 'unknown') as value, count(*) as plays from p group by all")
_report("result_counts", lambda p: reports.value_counts(p, "result"),
    "select game_id, coalesce(nullif(result, ''), 'unknown') as value, count(*) as plays from p group by all")
_report("evidence_counts", reports.evidence_counts, """
    select game_id, 'special_state' as value, count(*) as plays from p where event_id % 2 = 0 group by game_id
    union all select game_id, 'score_change', count(*) from p where event_id % 3 = 0 group by game_id""")
_report("confidence_averages", reports.confidence_averages, "select game_id, " + ", ".join(
    f"round(avg(coalesce({n}, 0)), 3) as {n}" for n in reports.CONFIDENCES) + " from p group by game_id")
_report("call_status_counts", reports.status_counts, """
    select game_id, coalesce(nullif(s, ''), 'missing') as status, count(*) as cells from (
      select game_id, offensive_play_call_validation as s from p union all
      select game_id, defensive_play_call_validation from p) group by all""")
def _coarse(plays: DataFrame) -> DataFrame:
    """Plays whose intervals repeat."""
    return plays.withColumns(
        {
            "start_timestamp_seconds": F.floor(F.col("start_timestamp_seconds") / 3).cast("double"),
            "end_timestamp_seconds": F.floor(F.col("end_timestamp_seconds") / 5).cast("double"),
        }
    )


register(
    "quality_report",
    lambda spark, sf: reports.quality_report(_coarse(plays(spark, sf))),
    O.chain(
        ("p", f"""select * replace (cast(floor(start_timestamp_seconds / 3) as double) as start_timestamp_seconds,
                                   cast(floor(end_timestamp_seconds / 5) as double) as end_timestamp_seconds)
                  from ({B.PLAYS})"""),
        last=f"""
      select game_id, 'plays' as section, 'plays' as item, cast(count(*) as double) as value from p group by game_id
      union all select game_id, 'duplicate_intervals',
        concat_ws(' - ', cast(start_timestamp_seconds as varchar), cast(end_timestamp_seconds as varchar)), count(*)
        from p group by game_id, start_timestamp_seconds, end_timestamp_seconds having count(*) > 1
      union all select game_id, 'possession_anomaly_plays', cast(play_number as varchar), 1 from p
        where possession_team is not null
        and not (possession_team is not distinct from away_team or possession_team is not distinct from home_team)
      union all select game_id, 'low_confidence_plays', cast(play_number as varchar), overall_confidence from p
        where coalesce(overall_confidence, 0) < 0.7
      union all select game_id, 'missing_required_fields', f, count(*) from p, lateral (values
        {', '.join(f"('{n}', cast({n} as varchar))" for n in C.REQUIRED_PLAY_FIELDS)}) v(f, x)
        where x is null or x = '' group by game_id, f
      union all select game_id, 'play_type_counts', coalesce(nullif(play_type, ''), 'unknown') as v, count(*) from p group by game_id, v
      union all select game_id, 'result_counts', coalesce(nullif(result, ''), 'unknown') as v, count(*) from p group by game_id, v
      union all select game_id, 'transition_evidence_counts', 'special_state', count(*) from p where event_id % 2 = 0 group by game_id
      union all select game_id, 'transition_evidence_counts', 'score_change', count(*) from p where event_id % 3 = 0 group by game_id
      union all select game_id, 'confidence_averages', f, round(avg(x), 3) from p, lateral (values
        {', '.join(f"('{n}', coalesce({n}, 0))" for n in reports.CONFIDENCES)}) v(f, x) group by game_id, f""",
    ),
)
_CLAIMS = f"""select game_id, play_number, play_type, field, side, value from p, lateral (values
  ('previous_offensive_play_call', 'offense', previous_offensive_play_call),
  ('previous_defensive_play_call', 'defense', previous_defensive_play_call),
  ('offensive_play_call', 'offense', offensive_play_call),
  ('defensive_play_call', 'defense', defensive_play_call)) v(field, side, value)
  where value is not null and value not in ('', '{C.BANNER_NOT_SHOWN}')"""
_WRONG = f"""select game_id, play_number, field, value from claims
  where not (field = 'offensive_play_call' and value in ('PAT Kick', 'Kickoff')
             and coalesce(play_type in ('extra_point', 'kickoff'), false))
    and (side, {_norm('value')}) not in (select side, {_norm('play_name')} from c)"""
_CHECKS = [("p", B.PLAYS), ("c", B.CATALOG), ("claims", _CLAIMS), ("wrong", _WRONG)]
register(
    "non_catalog_calls",
    lambda spark, sf: reports.non_catalog_calls(plays(spark, sf), catalog(spark, sf)),
    O.chain(*_CHECKS, last="select * from wrong"),
)
register(
    "first_violations",
    lambda spark, sf: reports.first_violations(plays(spark, sf), catalog(spark, sf)),
    O.chain(*_CHECKS, last="select * from wrong order by game_id, play_number, field limit 10"),
)
register(
    "validation_report",
    lambda spark, sf: reports.validation_report(plays(spark, sf), catalog(spark, sf)),
    O.chain(*_CHECKS, last="""
      select game_id, count(*) as plays, (select count(*) from claims k where k.game_id = p.game_id) as claimed_call_cells,
        cast(sum(coalesce(offensive_play_call_validation in ('unverified', 'unreadable', 'catalog_unavailable'), false)::int
          + coalesce(defensive_play_call_validation in ('unverified', 'unreadable', 'catalog_unavailable'), false)::int)
          as bigint) as unverified_ocr_cells,
        (select count(*) from wrong w where w.game_id = p.game_id) as non_catalog_claimed_calls,
        (select count(*) from wrong w where w.game_id = p.game_id) = 0 as all_claimed_calls_in_catalog
      from p group by game_id"""),
)
register(
    "game_files",
    lambda spark, sf: files.team_files(files.game_files(
        plays(spark, sf).withColumns({"end_home_score": F.lit(None).cast("int"), "end_away_score": F.lit(None).cast("int")}),
        "2026-08-19",
    )),
    O.chain(("p", B.PLAYS), ("l", """select * from p qualify row_number() over (partition by game_id order by play_number desc) = 1"""),
      last="""select game_id, home_team || ' ' || home_score || ' - ' || away_score || ' ' || away_team || ' 2026-08-19.csv' as game_file, team
        from l, lateral (select distinct t from (values (away_team), (home_team)) v(t)) d(team)
        where home_team is not null and away_team is not null and home_score is not null and away_score is not null"""),
)

def _archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all games, written under their names in two runs and read back, with their paths."""
    folder = f"{checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"
    played = plays(spark, sf_dir).withColumns({c: F.lit(None).cast("int") for c in ("end_home_score", "end_away_score")})
    named = files.game_files(played, "2026-08-19")
    rows = played.select("game_id", "play_number", "quarter", "game_clock", "result", "description")
    for run in (0, 1):
        files.write_archives(rows, named.filter(F.crc32("game_file") % 2 == run), folder)
    read = spark.read.option("header", True).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)
    path = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "/(Game_Data|Team_Data/[^/]+)/[^/]+$", 1))
    name = F.regexp_replace(F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))), "/", "")
    found = read.schema("play_number int, quarter int, game_clock string, result string, description string").csv(folder)
    return found.select(path.alias("folder"), name.alias("game_file"), "*")


_NAMED = """select game_id, home_team || ' ' || home_score || ' - ' || away_score || ' ' || away_team || ' 2026-08-19.csv' as game_file, home_team, away_team
  from (select * from p qualify row_number() over (partition by game_id order by play_number desc) = 1)
  where home_team is not null and away_team is not null and home_score is not null and away_score is not null"""
register(
    "archived_games",
    _archived,
    O.chain(("p", B.PLAYS), ("kept", _NAMED),
      last="""select folder, game_file, play_number, quarter, game_clock, case when result = '' then null else result end as result, description
        from p join kept using (game_id), lateral (
          select distinct f from (values ('Game_Data'), ('Team_Data/' || kept.home_team), ('Team_Data/' || kept.away_team)) v(f)) d(folder)"""),
)


_FRAME_COLUMNS = [field.split()[0] for field in schemas.FRAMES.split(",")]


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of all games, written as state caches, a file a game, and read back from there."""
    folder = f"{checkpoint_dir(spark)}/caches-{uuid.uuid4().hex}"
    files.write_state_caches(B.bound(spark, sf_dir, B.FRAMES).select(_FRAME_COLUMNS), folder)
    return files.read_state_caches(spark, folder, strict=True)


def _reusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the cache of each game fits its frames, of which every seventh event came 1/4 s later in some games."""
    moved = F.when((F.col("event_id") % 7 == 0) & F.col("game_id").endswith("3"), 0.25).otherwise(0.0)
    wanted = B.bound(spark, sf_dir, B.FRAMES).withColumn("timestamp_seconds", F.col("timestamp_seconds") + moved)
    reuse, again = files.reusable_games(wanted, _cached(spark, sf_dir))
    return reuse.withColumn("reused", F.lit(True)).unionByName(again.withColumn("reused", F.lit(False)))


register("cached_frames", _cached, f"select {', '.join(_FRAME_COLUMNS)} from ({B.FRAMES}) f")
register(
    "reusable_games",
    _reusable,
    f"""select game_id, not max(event_id % 7 = 0 and right(game_id, 1) = '3') as reused
      from ({B.FRAMES}) f group by game_id""",
)


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs saved in three versions, the last one with a newer status of some."""
    folder = f"{checkpoint_dir(spark)}/jobs-{uuid.uuid4().hex}"
    jobs = B.bound(spark, sf_dir, _JOBS)
    for part in range(3):
        mine = F.col("position") % 4 == part if part else F.col("position") % 4 != 1
        status = F.when((F.col("position") % 4 == part) & F.lit(part > 0), F.lit("completed")).otherwise(F.col("status"))
        files.save_jobs(jobs.filter(mine).withColumn("status", status), folder)
    return files.saved_jobs(spark, folder).select("stream_id", "channel", "title", "position", "status")


# Calibration ----------------------------------------------------------------


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.bound(spark, sf_dir, "select * from lineitem")
    game = F.col("l_orderkey").cast("string")
    return df.groupBy(
        game.alias("game_id"), F.col("l_linenumber").alias("play_number")
    ).agg(
        F.max(F.col("l_partkey") % 4 + 1).cast("int").alias("quarter"),
        F.max(F.col("l_suppkey") % 30).cast("int").alias("away_score"),
        F.max(F.col("l_partkey") % 50).cast("int").alias("yard_line"),
        F.max(F.col("l_quantity")).cast("int").alias("distance"),
        F.max("l_returnflag").alias("result"),
        F.max("l_linestatus").alias("offensive_play_call"),
    )


def _labels(base: DataFrame) -> DataFrame:
    """Every order line as a labelled play, some fields left unlabelled."""
    from pyspark.sql import types as T

    from snapcount import schemas

    n = F.col("play_number")
    values = {
        "quarter": F.when(n % 3 != 0, F.col("quarter")),
        "clock_bucket": F.concat(F.col("quarter").cast("string"), F.lit("+")),
        "distance": F.col("distance"),
        "distance_label": F.when(F.col("distance") % 9 == 0, "inches"),
        "offensive_play_call": F.concat(F.lit(" h-b "), "offensive_play_call"),
        "end_down": F.when(n % 2 == 0, F.lit(2)),
        "end_distance": F.col("distance"),
        "end_distance_label": F.when(F.col("distance") % 8 == 0, "inches"),
    }
    fields = T.StructType.fromDDL(schemas.LABELS).fields
    return base.select(
        *(
            (
                values.get(f.name, F.col(f.name) if f.name in base.columns else F.lit(None))
                .cast(f.dataType)
                .alias(f.name)
            )
            for f in fields
        )
    )


def _observed(base: DataFrame) -> DataFrame:
    """The same lines read back: every fifth is lost, values partly differ."""
    base = base.filter((F.col("quarter") + F.col("play_number")) % 5 != 0)
    missing = [n for n in C.CALIBRATED_FIELDS if n not in base.columns and n != "game_clock_bucket"]
    return (
        base.withColumns({n: F.lit(None).cast("string") for n in missing})
        .withColumns(
            {
                "game_clock": F.concat(F.col("quarter").cast("string"), F.lit(":05")),
                "home_score": F.lit(None).cast("int"),
                "down": F.lit(None).cast("int"),
                "defensive_play_call": F.lit(None).cast("string"),
                "yard_line": F.when(F.col("yard_line") % 4 != 0, F.col("yard_line")).otherwise(
                    F.col("yard_line") + 1
                ),
                "offensive_play_call": F.concat(F.lit("HB"), "offensive_play_call"),
                "end_down_distance": F.when(F.col("distance") % 3 != 0, F.concat(F.lit("2 & "), F.col("distance").cast("string"))),
            }
        )
    )


def _aligned_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, plays, and which of them belong together. Orders are small, so small tiles show that borders fit."""
    base = cut(_numbered(spark, sf_dir))
    labels, observed = _labels(base), _observed(base)
    return labels, observed, calibration.align_plays(labels, observed, tile=4)


_CAL = [
    ("b", """select cast(l_orderkey as string) as game_id, l_linenumber as play_number,
        cast(max(l_partkey % 4 + 1) as int) as quarter, cast(max(l_suppkey % 30) as int) as away_score,
        cast(max(l_partkey % 50) as int) as yard_line, cast(max(l_quantity) as int) as distance,
        max(l_returnflag) as result, max(l_linestatus) as call from lineitem group by 1, 2"""),
    ("e", """select game_id, play_number, field, expected from b, lateral (values
        ('quarter', case when play_number % 3 <> 0 then cast(quarter as string) end),
        ('game_clock_bucket', quarter || '+'), ('away_score', cast(away_score as string)),
        ('distance', case when distance % 9 = 0 then '0' else cast(distance as string) end),
        ('yard_line', cast(yard_line as string)), ('offensive_play_call', ' h-b ' || call), ('result', result),
        ('end_down_distance', case when play_number % 2 = 0 then '2 & ' ||
            case when distance % 8 = 0 then 'inches' else cast(distance as string) end end)) v(field, expected)
        where expected is not null"""),
    ("o", """select game_id, play_number, field, observed from b, lateral (values
        ('quarter', cast(quarter as string)), ('game_clock_bucket', quarter || '+'), ('away_score', cast(away_score as string)),
        ('distance', cast(distance as string)),
        ('yard_line', cast(case when yard_line % 4 <> 0 then yard_line else yard_line + 1 end as string)),
        ('offensive_play_call', 'HB' || call), ('result', result),
        ('end_down_distance', case when distance % 3 <> 0 then '2 & ' || distance end)) v(field, observed)
        where (quarter + play_number) % 5 <> 0"""),
    ("lab", """select *, 'h b ' || lower(call) as spoken, row_number() over (partition by game_id order by play_number) as i from b"""),
    ("obs", """select *, row_number() over (partition by game_id order by play_number) as j from b where (quarter + play_number) % 5 <> 0"""),
    ("pairs", """select l.game_id, i, list(p order by j) as p, count(*) as n from (
        select l.game_id, l.i, o.j, case when l.play_number % 3 <> 0 then case when l.quarter = o.quarter then 1 else -0.75 end else 0 end
          + case when l.away_score = o.away_score then 2 else -1.5 end + case when l.distance = o.distance then 3 else -2.25 end
          + case when l.yard_line = case when o.yard_line % 4 <> 0 then o.yard_line else o.yard_line + 1 end then 4 else -3 end
          + case when replace(l.spoken, ' ', '') = 'hb' || lower(o.call) then 3 else -2.25 end as p
        from lab l join obs o using (game_id)) l group by all"""),
    ("scored", """select game_id, cast(0 as bigint) as i, list_transform(range(n + 1), lambda j: -3.0::double * j) as s, cast([] as bigint[]) as moves
        from (select distinct game_id, n from pairs)
        union all
        select game_id, i, s, list_transform(range(len(best)), lambda j: case when s[j + 2] > best[j + 1] then 2 when mt[j + 1] >= up[j + 1] then 0 else 1 end) as moves
        from (select *, list_transform(range(len(cand)), lambda j: list_max(list_transform(range(j + 1), lambda k: cand[k + 1] + 3 * k)) - 3 * j) as s
          from (select *, list_concat([head], best) as cand
            from (select *, list_transform(range(len(mt)), lambda j: greatest(mt[j + 1], up[j + 1])) as best
              from (select q.game_id, q.i, f.s[1] - 3 as head, list_transform(range(q.n), lambda j: f.s[j + 1] + q.p[j + 1]) as mt,
                      list_transform(range(q.n), lambda j: f.s[j + 2] - 3) as up
                from scored f join pairs q on q.game_id = f.game_id and q.i = f.i + 1))))"""),
    ("way", """select game_id, max(i) as r, len(any_value(s)) - 1 as c, cast(null as bigint) as i, cast(null as bigint) as j from scored group by game_id
        union all
        select w.game_id, r - case when m = 2 then 0 else 1 end, c - case when m = 1 then 0 else 1 end,
               case when m = 0 and p > 0 then r end, case when m = 0 and p > 0 then c end
        from (select w.game_id, w.r, w.c, t.moves[w.c] as m, q.p[w.c] as p from way w join scored t on t.game_id = w.game_id and t.i = w.r
              join pairs q on q.game_id = w.game_id and q.i = w.r where w.r > 0 and w.c > 0) w"""),
    ("aligned", """select w.game_id, l.play_number as expected_number, o.play_number from way w
        join lab l on l.game_id = w.game_id and l.i = w.i join obs o on o.game_id = w.game_id and o.j = w.j"""),
    ("cmp", f"""select e.game_id, e.play_number, a.play_number as observed_play_number,
        e.field, expected, observed, case when observed is null then 'missing'
          when e.field in ('offensive_play_call', 'result') then case when contains({_norm('observed')}, {_norm('expected')})
            or contains({_norm('expected')}, {_norm('observed')})
            or replace({_norm('expected')}, ' ', '') = replace({_norm('observed')}, ' ', '') then 'match' else 'mismatch' end
          when expected = observed then 'match' else 'mismatch' end as status
        from e left join aligned a on a.game_id = e.game_id and a.expected_number = e.play_number
        left join o on o.game_id = a.game_id and o.play_number = a.play_number and o.field = e.field"""),
]
register(
    "align_plays",
    lambda spark, sf: (lambda base: calibration.align_plays(_labels(base), _observed(base)))(cut(_numbered(spark, sf))),
    O.chain(*_CAL, last="select * from aligned"),
)
register(
    "align_plays_in_tiles",
    lambda spark, sf: _aligned_rows(spark, sf)[2],
    O.chain(*_CAL, last="select * from aligned"),
)
register(
    "compare_fields",
    lambda spark, sf: calibration.compare_fields(*_aligned_rows(spark, sf)).select(
        "game_id", "play_number", "observed_play_number", "field", "expected", "observed", "status"
    ),
    O.chain(*_CAL, last="select * from cmp"),
)


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, observed, aligned = _aligned_rows(spark, sf_dir)
    compared = calibration.compare_fields(labels, observed, aligned)
    return calibration.calibration_summary(compared, labels)


register(
    "calibration_summary",
    _summary,
    O.chain(*_CAL, last="""
      select game_id, (select count(*) from b where b.game_id = cmp.game_id) as expected_plays,
        count(*) filter (status = 'match') as matched_fields, count(*) filter (status = 'mismatch') as mismatched_fields,
        count(*) filter (status = 'missing') as missing_fields,
        25 * (select count(*) from b where b.game_id = cmp.game_id) - count(*) as ignored_unlabeled_fields,
        round(count(*) filter (status = 'match') / count(*)::double, 4) as field_accuracy
      from cmp group by game_id"""),
)

# Channels, links and jobs -----------------------------------------------------

_CHANNELS = """select cast(page_id as int) as position, case page_id % 5 when 0 then ' Player_' else 'player_' end ||
  cast(page_id % 30 as string) || case page_id % 7 when 0 then ' ' else '' end as channel from pages"""
_POLLS = """select event_id as pos, case when event_id % 9 = 0 then '' else 'Player_' || cast(user_id as string) end as user_login,
  case when event_id % 11 = 0 then null else 's' || cast(event_id as string) end as id, event_type as title,
  cast(value as string) as started_at from events"""
_JOBS = """select 's' || cast(event_id as string) as stream_id, 'player_' || cast(user_id as string) as channel,
  event_type as title, cast(null as string) as started_at, cast(null as string) as detected_at, event_id as position,
  case event_type when 'view' then 'recording' when 'click' then 'awaiting_analysis' when 'signup' then 'analyzing'
       when 'purchase' then 'completed' else 'analysis_failed' end as status from events where event_id % 2 = 0"""
register(
    "saved_jobs",
    _saved,
    O.chain(("j", _JOBS), last="""select stream_id, channel, title, position, case when position % 4 = 2 then 'completed' else status end as status
      from j"""),
)
_URLS = """select page_id, case page_id % 6 when 0 then url when 1 then replace(url, 'http', 'ftp')
  when 2 then 'https://u@clips.twitch.tv:443/x' when 3 then 'https://discord.com/channels/' || cast(page_id as string) || '/77/'
  when 4 then 'HTTP://www.Twitch.TV/some' else 'no link ' || url end as link from pages"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.bound(spark, sf_dir, B.MESSAGES)
    embed = F.struct(
        F.col("link").alias("url"), F.lit(None).cast("string").alias("title"),
        F.lit("").alias("description"), F.lit(None).cast("string").alias("author_url"),
        F.array(F.struct(F.col("text").alias("value"))).alias("fields"),
    )
    return df.withColumn("embeds", F.array(embed)).withColumnRenamed("text", "content")


register(
    "link_kinds",
    lambda spark, sf: B.bound(spark, sf, _URLS).select(
        "page_id", P.is_url("link").alias("is_url"), P.is_stream_url("link").alias("is_stream"),
        P.chat_channel_ids("link")["guild_id"].alias("guild_id"),
        P.chat_channel_ids("link")["channel_id"].alias("channel_id"),
    ),
    """select page_id, case page_id % 6 when 0 then true when 1 then false when 5 then false else true end as is_url,
         page_id % 6 in (2, 4) as is_stream,
         case when page_id % 6 = 3 then page_id end as guild_id, cast(case when page_id % 6 = 3 then 77 end as bigint) as channel_id
       from pages""",
)
register(
    "normalize_channels",
    lambda spark, sf: discovery.normalize_channels(B.bound(spark, sf, _CHANNELS)),
    O.chain(("c", _CHANNELS), last="select lower(trim(channel)) as channel, min(position) as position from c group by 1"),
)
_LIVE = "select distinct 'player_' || cast(user_id as string) as channel from events where event_type = 'view' and user_id % 3 = 0"
register(
    "channel_status",
    lambda spark, sf: discovery.split_channel_status(
        discovery.normalize_channels(B.bound(spark, sf, _CHANNELS)), B.bound(spark, sf, _LIVE)
    ),
    O.chain(("c", _CHANNELS), ("live", _LIVE), last="""
      select min(position) as position, lower(trim(channel)) as channel,
             case when lower(trim(c.channel)) in (select channel from live) then 'streaming' else 'offline' end as status
      from c group by 2, 3"""),
)
register(
    "linked_channels",
    lambda spark, sf: _messages(spark, sf).select(
        "message_id", F.array_join(discovery.linked_channels(discovery.message_texts()), ",").alias("channels")
    ),
    O.chain(("m", B.MESSAGES), last=r"""
      select message_id, coalesce(array_to_string(list_filter(list_transform(
        regexp_extract_all(coalesce(link, ''), '(?i)https?://(?:www\.)?twitch\.tv/([A-Za-z0-9_]+)', 1), lambda x: lower(x)),
        lambda x: x <> 'videos'), ','), '') as channels from m"""),
)
register(
    "watched_messages",
    lambda spark, sf: discovery.watched_messages(_messages(spark, sf), 1, "scout").select("message_id"),
    O.chain(("m", B.MESSAGES), last="select message_id from m where channel_id = 1 and contains(lower(author), 'scout')"),
)
_TIMED = "select event_id as message_id, ts, user_id as channel_id from events"
register(
    "recent_messages",
    lambda spark, sf: discovery.since_cutoff(
        B.bound(spark, sf, _TIMED), F.lit("2024-01-10 00:00:00").cast("timestamp"), 48
    ).select("message_id"),
    "select event_id as message_id from events where ts > timestamp '2024-01-10 00:00:00' - interval 48 hours",
)
register(
    "new_channels",
    lambda spark, sf: discovery.add_channels(
        discovery.normalize_channels(B.bound(spark, sf, _CHANNELS)),
        discovery.discovered_channels(_messages(spark, sf)),
    ).select("channel", "message_id"),
    O.chain(("c", _CHANNELS), ("m", B.MESSAGES), last=r"""
      select channel, min(message_id) as message_id from (
        select message_id, unnest(list_transform(regexp_extract_all(coalesce(link, ''),
          '(?i)https?://(?:www\.)?twitch\.tv/([A-Za-z0-9_]+)', 1), lambda x: lower(x))) as channel from m)
      where channel <> 'videos' and channel not in (select lower(trim(channel)) from c) group by channel"""),
)
register(
    "poll_index",
    lambda spark, sf: discovery.poll_index(B.bound(spark, sf, _POLLS)),
    O.chain(("p", _POLLS), last="""
      select lower(user_login) as channel, id, title, started_at from p where user_login <> '' and id <> ''
      qualify row_number() over (partition by lower(user_login) order by pos desc) = 1"""),
)
_PUBLIC = """select 'c' || cast(user_id as string) as channel, event_type as title, event_id % 4 <> 0 as is_live,
  case when event_id % 3 = 0 then '' when event_id % 3 = 1 then 'src' || cast(event_id as string) end as source_id,
  case when event_id % 5 = 0 then 0 when event_id % 5 = 1 then event_id end as release_timestamp,
  case when event_id % 7 = 0 then event_id + 1 end as timestamp from events"""
register(
    "public_streams",
    lambda spark, sf: discovery.public_streams(B.bound(spark, sf, _PUBLIC)),
    O.chain(("p", _PUBLIC), last="""
      select 'public-' || channel || '-' || coalesce(nullif(source_id, ''), channel) || '-' ||
             coalesce(cast(coalesce(nullif(release_timestamp, 0), nullif(timestamp, 0)) as string), 'live') as id,
             channel, title, coalesce(nullif(release_timestamp, 0), nullif(timestamp, 0)) as started_at
      from p where is_live"""),
)
_INDEX = """(select lower(user_login) as channel, id, title, started_at from p where user_login <> '' and id <> ''
  qualify row_number() over (partition by lower(user_login) order by pos desc) = 1)"""
register(
    "new_streams",
    lambda spark, sf: discovery.new_streams(
        discovery.poll_index(B.bound(spark, sf, _POLLS)), B.bound(spark, sf, _JOBS), F.lit("2024-02-01")
    ),
    O.chain(("p", _POLLS), ("j", _JOBS), last=f"""
      select id as stream_id, channel, title, started_at, '2024-02-01' as detected_at, 'recording' as status
      from {_INDEX} where id not in (select stream_id from j)"""),
)
register(
    "should_record",
    lambda spark, sf: discovery.should_record(
        discovery.poll_index(B.bound(spark, sf, _POLLS)), B.bound(spark, sf, _JOBS),
        B.bound(spark, sf, _JOBS).filter("position % 6 = 0"),
    ).select("stream_id", "channel"),
    O.chain(("p", _POLLS), ("j", _JOBS), last=f"""
      select id as stream_id, channel from {_INDEX}
      where id not in (select stream_id from j where position % 6 = 0)
        and id not in (select stream_id from j where status <> 'recording')"""),
)
register(
    "job_counts",
    lambda spark, sf: discovery.job_counts(B.bound(spark, sf, _JOBS)),
    O.chain(("j", _JOBS), last="""select count(*) filter (status = 'recording') as recording,
      count(*) filter (status = 'awaiting_analysis') as queued, count(*) filter (status = 'analyzing') as analyzing from j"""),
)
register(
    "active_channel",
    lambda spark, sf: discovery.active_channel(B.bound(spark, sf, _JOBS)),
    O.chain(("j", _JOBS), last="select channel from j where status = 'analyzing' order by position limit 1"),
)

# Streams --------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the test data as a stream of files."""
    B.tables(spark, sf_dir, table)
    schema = spark.table(table).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}*.parquet")


def _as_table(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    folder = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    return live.run_to_table(df, name, folder, mode)


register(
    "stream_job_status",
    lambda spark, sf: _as_table(
        live.job_status(
            _stream(spark, sf, "events").select(
                F.col("user_id").cast("string").alias("stream_id"), F.lit("c").alias("channel"),
                F.col("event_type").alias("status"), F.col("event_id").alias("seq"),
            )
        ),
        "stream_job_status", "complete",
    ),
    """select cast(user_id as string) as stream_id, 'c' as channel, arg_max(event_type, event_id) as status
       from events group by user_id""",
)
register(
    "stream_new_streams",
    lambda spark, sf: _as_table(
        live.new_streams(
            _stream(spark, sf, "events").select(F.col("user_id").cast("string").alias("id")),
            B.bound(spark, sf, "select distinct cast(user_id as string) as stream_id from events where user_id % 4 = 0"),
        ),
        "stream_new_streams",
    ),
    "select distinct cast(user_id as string) as stream_id from events where user_id % 4 <> 0",
)
register(
    "stream_new_channels",
    lambda spark, sf: _as_table(
        live.new_channels(
            _stream(spark, sf, "conversations").select(
                F.when(
                    F.col("turn") % 4 == 0,
                    F.concat(F.lit("https://twitch.tv/Player_"), (F.col("conv_id") % 40).cast("string")),
                ).otherwise(F.col("text")).alias("content"),
                F.array().cast("array<struct<url:string,title:string,description:string,author_url:string,fields:array<struct<value:string>>>>").alias("embeds"),
            ),
            B.bound(spark, sf, _CHANNELS).withColumn("channel", F.trim("channel")),
        ),
        "stream_new_channels",
    ),
    O.chain(("c", _CHANNELS), last="""select distinct 'player_' || (conv_id % 40) as channel from conversations
      where turn % 4 = 0 and 'player_' || (conv_id % 40) not in (select lower(trim(channel)) from c)"""),
)


def _live_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames as a stream of two batches: the second half of each game continues from its open tail."""
    folder = f"{checkpoint_dir(spark)}/live-{uuid.uuid4().hex}"
    whole = frames(spark, sf_dir)
    names = list(T.StructType.fromDDL(schemas.FRAMES).names)
    middle = whole.groupBy("game_id").agg((F.max("frame_index") / 2).alias("middle"))
    halves = cut(whole.join(middle, "game_id").withColumn("half", (F.col("frame_index") > F.col("middle")).cast("int")))
    for half in range(2):
        part = halves.filter(F.col("half") == half).select(*names)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(halves.select(*names).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    live.live_plays(stream, catalog(spark, sf_dir), f"{folder}/live", f"{folder}/checkpoint").awaitTermination()
    return live.current_plays(spark, f"{folder}/live").select(
        *PLAY_COLUMNS, F.array_join("transition_evidence", ",").alias("transition_evidence")
    )


register(
    "stream_live_plays",
    _live_plays,
    O.up_to("plays", f"select {', '.join(PLAY_COLUMNS)}, transition_evidence from plays"),
)
register(
    "stream_finished_games",
    lambda spark, sf: _as_table(
        finish.finished_games(
            _stream(spark, sf, "events").select(
                F.concat(F.lit("g"), F.col("user_id").cast("string")).alias("game_id"),
                F.col("event_id").alias("frame_index"),
                (F.col("event_id") % 97 == 5).alias("game_over"),
                F.col("ts").cast("timestamp").alias("event_time"),
            ),
            idle_ms=6 * 3_600_000, lateness="1 hour",
        ),
        "stream_finished_games",
    ),
    """with g as (
      select 'g' || user_id as game_id, count(*) as frames, min(event_id) as first_frame, max(event_id) as last_frame,
             min(ts) filter (event_id % 97 = 5) as over, max(ts) + interval 6 hour as idle
      from events group by user_id
    )
    select game_id, frames, first_frame, last_frame, cast(1 as bigint) as batches,
           case when over is null then 'idle' else 'end_row' end as reason
    from g where coalesce(over, idle) <= (select max(ts) - interval 1 hour from events)""",
)
register(
    "stream_watched_channels",
    lambda spark, sf: _as_table(
        live.new_channels(
            _stream(spark, sf, "conversations").select(
                (F.col("conv_id") % 3).alias("channel_id"),
                F.when(F.col("role") == "user", "Scout Bot").otherwise(F.col("role")).alias("author"),
                F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("ts"),
                F.concat(F.lit("https://twitch.tv/Player_"), (F.col("conv_id") % 40).cast("string")).alias("content"),
                F.array().cast("array<struct<url:string,title:string,description:string,author_url:string,fields:array<struct<value:string>>>>").alias("embeds"),
            ),
            B.bound(spark, sf, _CHANNELS).withColumn("channel", F.trim("channel")),
            channel_id=1, author="bot", lateness="1 day",
        ),
        "stream_watched_channels",
    ),
    O.chain(("c", _CHANNELS), last="""select distinct 'player_' || (conv_id % 40) as channel from conversations
      where conv_id % 3 = 1 and role = 'user' and 'player_' || (conv_id % 40) not in (select lower(trim(channel)) from c)"""),
)

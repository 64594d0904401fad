"""DuckDB SQL for the same results, folds as plain row-by-row recursion."""

from __future__ import annotations

from snapcount import constants as C
from workload import bindings as B


def chain(*steps: tuple[str, str], last: str) -> str:
    return "with recursive " + ",\n".join(f"{n} as materialized ({q})" for n, q in steps) + "\n" + last


def fold(rows: str, keys: str, order: str, start: str, step: str) -> str:
    """Row-by-row pass: ``f`` is the state row before, ``r`` the current row."""
    on = " and ".join(f"r.{k.strip()} is not distinct from f.{k.strip()}" for k in keys.split(","))
    return f"""
      with recursive r_rows as materialized (
        select *, row_number() over (partition by {keys} order by {order}) as rn from {rows}),
      f as (
        select r.*, {start} from r_rows r where rn = 1
        union all
        select r.*, {step} from f join r_rows r on {on} and r.rn = f.rn + 1)
      select * from f"""


SECONDS = """case when regexp_matches({0}, '^[0-5]?[0-9]:[0-5][0-9]$')
  then cast(split_part({0}, ':', 1) as int) * 60 + cast(split_part({0}, ':', 2) as int) end"""
STEP = "({0}) in (0, 1, 2, 3, 6, 7, 8)"


def _agree(a: str, b: str) -> str:
    return (
        f"coalesce({a}_y = {b}_y and ({a}_d is null or {b}_d is null or {a}_d = {b}_d), false)"
    )


def situation(rows: str) -> str:
    return f"""
      select * exclude (p_y, p_d, n_y, n_d, h_y, h_d, a0, a1)
             replace (case when keep then down end as down,
                      case when keep then distance end as distance,
                      case when keep then yard_line end as yard_line)
      from (select *, special_state is not null or {_agree('p', 'h')} or {_agree('h', 'n')}
                      or coalesce(frame_index in (a0, a1), false) as keep
            from (select *, yard_line as h_y, down as h_d,
                         lag(yard_line) over w as p_y, lag(down) over w as p_d,
                         lead(yard_line) over w as n_y, lead(down) over w as n_d,
                         min(case when yard_line is not null or down is not null
                                  then frame_index end) over g as a0,
                         max(case when yard_line is not null or down is not null
                                  then frame_index end) over g as a1
                  from {rows}
                  window w as (partition by game_id order by frame_index),
                         g as (partition by game_id)))"""


def scores(rows: str) -> list[tuple[str, str]]:
    """Steps ending in ``scored``: frames with stable scores."""
    reads = f"""
      select game_id, frame_index, side, value, pat,
             lead(value, 1) over w as n1, lead(value, 2) over w as n2, lead(value, 3) over w as n3
      from (select *, coalesce(bool_or(special_state = 'extra_point') over (
                     partition by game_id order by frame_index
                     rows between 12 preceding and 12 following), false) as pat
            from {rows}) f,
           lateral (values ('away', f.away_score), ('home', f.home_score)) v(side, value)
      where value is not null
      window w as (partition by game_id, side order by frame_index)"""
    ok = " or ".join(f"coalesce(r.n{i} = r.value or (r.n{i} - r.value) in (1,2,3,6,7,8), false)" for i in (1, 2, 3))

    def accept(state: str) -> str:
        return f"""case when r.value - {state} in (0,2,3,6,7,8) and ({ok}) then r.value
                        when r.value - {state} = 1 and r.pat and ({ok}) then r.value
                        else {state} end as stable"""

    stable = fold("reads", "game_id, side", "frame_index", accept("0"), accept("f.stable"))
    wide = """
      select game_id, frame_index, max(case when side = 'away' then stable end) as a,
             max(case when side = 'home' then stable end) as h
      from stable group by game_id, frame_index"""
    scored = f"""
      select f.* replace (
               coalesce(last_value(w.a ignore nulls) over p, 0) as away_score,
               coalesce(last_value(w.h ignore nulls) over p, 0) as home_score)
      from {rows} f left join wide_scores w using (game_id, frame_index)
      window p as (partition by f.game_id order by f.frame_index
                   rows between unbounded preceding and current row)"""
    return [("reads", reads), ("stable", stable), ("wide_scores", wide), ("scored", scored)]


def spotted(rows: str) -> list[tuple[str, str]]:
    """Steps ending in ``spotted``: frames with their spot, by the fold itself."""
    anchored = f"""select * from {rows}
      where yard_line is not null or down is not null or special_state is not null"""
    new = """(case
      when r.special_state = f.sp then false
      when r.yard_line <> f.cur then true
      when r.yard_line = f.cur and r.down <> f.sd then true
      when f.sp is not null and r.special_state is distinct from f.sp then true
      when r.away_score <> f.sa or r.home_score <> f.sh then true
      else false end)"""
    folded = fold(
        "anchored", "game_id", "frame_index",
        """r.frame_index as spot, r.yard_line as cur, r.down as sd, r.special_state as sp,
           r.away_score as sa, r.home_score as sh""",
        f"""case when {new} then r.frame_index else f.spot end,
            coalesce(r.yard_line, f.cur),
            case when {new} then r.down else coalesce(f.sd, r.down) end,
            case when {new} then r.special_state else coalesce(f.sp, r.special_state) end,
            case when {new} then r.away_score else f.sa end,
            case when {new} then r.home_score else f.sh end""",
    )
    out = f"""
      select f.*, case when a.spot is not null then a.spot
                       when last_value(a.spot ignore nulls) over p is not null
                       then first_value(a.spot ignore nulls) over n end as spot
      from {rows} f left join openings a using (game_id, frame_index)
      window p as (partition by f.game_id order by f.frame_index
                   rows between unbounded preceding and current row),
             n as (partition by f.game_id order by f.frame_index
                   rows between current row and unbounded following)"""
    return [
        ("anchored", anchored),
        ("openings", f"select game_id, frame_index, spot from ({folded})"),
        ("spotted", out),
    ]


def mode_of(column: str, rows: str, keys: str, order: str) -> str:
    return f"""
      select {keys}, arg_max({column}, {{'n': n, 'f': -first}}) as {column}
      from (select {keys}, {column}, count(*) as n, min({order}) as first from {rows}
            where {column} is not null and cast({column} as string) <> ''
            group by {keys}, {column}) group by {keys}"""


VOTED = (
    "quarter", "down", "distance", "special_state", "yard_line", "field_side", "stream_side",
    "personnel", "formation", "away_team", "home_team", "possession_team", "away_score",
    "home_score",
)


def summaries(rows: str) -> list[tuple[str, str]]:
    seconds = SECONDS.format("game_clock")
    base = f"""
      select game_id, spot, round(arg_min(timestamp_seconds, frame_index), 3) as start_timestamp_seconds,
             round(arg_max(timestamp_seconds, frame_index), 3) as end_timestamp_seconds,
             arg_min(game_clock, {{'s': {seconds}, 'o': frame_index}})
               filter ({seconds} is not null) as game_clock,
             bool_or(coalesce(previous_play_banner_shown, false)) as _banner_shown
      from {rows} where spot is not null group by game_id, spot"""
    steps = [("base", base)]
    joins = ""
    for name in VOTED:
        steps.append((f"m_{name}", mode_of(name, f"(select * from {rows} where spot is not null)", "game_id, spot", "frame_index")))
        joins += f" left join m_{name} using (game_id, spot)"
    dd = """cast(down as string) || ' & ' || case when distance = 0 then 'inches'
            else cast(distance as string) end"""
    steps.append(("summaries", f"""
      select game_id, spot, start_timestamp_seconds, end_timestamp_seconds, quarter, game_clock,
             down, distance, {dd} as down_distance, special_state, yard_line, field_side,
             field_side as _field_side_observed, stream_side as _stream_side,
             personnel as _personnel, formation as _formation, away_team, home_team,
             possession_team, possession_team as _possession_team_observed, away_score,
             home_score, _banner_shown
      from base {joins}
      where yard_line is not null or down is not null or special_state is not null"""))
    return steps


FILLED = (
    "_stream_side", "_personnel", "_formation", "away_team", "home_team", "possession_team",
    "field_side",
)


def same_clock(rows: str) -> str:
    """Pairwise merging row by row; the state is the merged row so far."""
    cols = (
        "quarter", "game_clock", "down", "distance", "down_distance", "special_state",
        "yard_line", "_field_side_observed", "_possession_team_observed", "away_score",
        "home_score",
    )
    same = """(coalesce(f.m_special_state is null and r.special_state is null
      and f.m_quarter is not distinct from r.quarter and f.m_game_clock = r.game_clock, false))"""
    wins = "(r.end_timestamp_seconds - r.start_timestamp_seconds > f.m_to - f.m_from)"
    start = ["r.spot as grp", "r.start_timestamp_seconds as m_from", "r.end_timestamp_seconds as m_to",
             "r._banner_shown as m_banner"]
    step = [
        f"case when {same} then f.grp else r.spot end",
        f"case when {same} then least(f.m_from, r.start_timestamp_seconds) else r.start_timestamp_seconds end",
        f"case when {same} then greatest(f.m_to, r.end_timestamp_seconds) else r.end_timestamp_seconds end",
        f"case when {same} then f.m_banner or r._banner_shown else r._banner_shown end",
    ]
    for name in cols:
        start.append(f"r.{name} as m_{name}")
        step.append(f"case when {same} and not {wins} then f.m_{name} else r.{name} end")
    for name in FILLED:
        start.append(f"r.{name} as m_{name}")
        step.append(f"""case when {same} and {wins} then coalesce(r.{name}, f.m_{name})
                             when {same} then coalesce(f.m_{name}, r.{name}) else r.{name} end""")
    folded = fold(rows, "game_id", "spot", ", ".join(start), ", ".join(step))
    taken = ", ".join(f"m_{n} as {n}" for n in (*cols, *FILLED))
    return f"""
      select game_id, grp as spot, m_from as start_timestamp_seconds, m_to as end_timestamp_seconds,
             {taken}, m_banner as _banner_shown
      from (select *, row_number() over (partition by game_id, grp order by rn desc) as z
            from ({folded})) where z = 1"""


def before_special(rows: str) -> str:
    return f"""select * from {rows} window w as (partition by game_id order by spot)
      qualify not coalesce(
        lag(down) over w is not null and down is null and special_state is null
        and lead(special_state) over w in ('extra_point', 'kickoff'), false)"""


def backfill(rows: str) -> str:
    start, step = [], []
    for side in ("away", "home"):
        name = f"{side}_score"
        start.append(f"case when {STEP.format(f'r.{name}')} then r.{name} else 0 end as m_{side}")
        step.append(
            f"case when {STEP.format(f'r.{name} - f.m_{side}')} then r.{name} else f.m_{side} end"
        )
    start.append("coalesce(r.quarter, 1) as m_quarter")
    step.append("coalesce(r.quarter, f.m_quarter)")
    folded = fold(rows, "game_id", "spot", ", ".join(start), ", ".join(step))
    away = mode_of("away_team", rows, "game_id", "spot")
    home = mode_of("home_team", rows, "game_id", "spot")
    return f"""
      select b.* exclude (rn, m_away, m_home, m_quarter)
             replace (b.m_away as away_score, b.m_home as home_score, b.m_quarter as quarter,
                      ta.away_team as away_team, th.home_team as home_team)
      from ({folded}) b left join ({away}) ta using (game_id) left join ({home}) th using (game_id)"""


def downs(rows: str) -> str:
    return f"""
      select * exclude (pd, ps, nd, fix)
             replace (case when fix then pd + 1 else down end as down,
                      case when fix then cast(pd + 1 as string) || ' & ' || case when distance = 0
                           then 'inches' else cast(distance as string) end
                           else down_distance end as down_distance)
      from (select *, coalesce(pd between 1 and 3 and down not in (1, pd + 1) and nd = 1
                               and ps is null and special_state is null, false) as fix
            from (select *, lag(down) over w as pd, lag(special_state) over w as ps,
                         lead(down) over w as nd
                  from {rows} window w as (partition by game_id order by spot)))"""


FLIP = "coalesce((f.down = 4 and r.down = 1) or f.special_state = 'kickoff', false)"


def _turn(side: str) -> str:
    return f"case {side} when 'offense' then 'defense' when 'defense' then 'offense' end"


def stream_sides(rows: str) -> str:
    folded = fold(
        rows, "game_id", "spot", "r._stream_side as m",
        f"coalesce(r._stream_side, case when {FLIP} then {_turn('f.m')} else f.m end)",
    )
    return f"select * exclude (rn, m) replace (m as _stream_side) from ({folded})"


def stream_transitions(rows: str) -> str:
    folded = fold(
        rows, "game_id", "spot", "r._stream_side as m",
        f"coalesce(case when {FLIP} then {_turn('f.m')} end, r._stream_side)",
    )
    return f"select * exclude (rn, m) replace (m as _stream_side) from ({folded})"


def possession(rows: str) -> str:
    turned = """case when f.m is not distinct from r.away_team then r.home_team
                     when f.m is not distinct from r.home_team then r.away_team end"""
    valid = """(r.possession_team is not distinct from r.away_team
                or r.possession_team is not distinct from r.home_team)"""
    folded = fold(
        rows, "game_id", "spot",
        f"case when {valid} then r.possession_team end as m",
        f"""case when {valid} then r.possession_team when {FLIP} then {turned} else f.m end""",
    )
    return f"select * exclude (rn, m) replace (m as possession_team) from ({folded})"


def propagated(rows: str) -> str:
    return f"""select * replace (
        last_value(field_side ignore nulls) over w as field_side,
        last_value(game_clock ignore nulls) over w as game_clock)
      from {rows} window w as (partition by game_id order by spot
                               rows between unbounded preceding and current row)"""


def clocks(rows: str) -> str:
    seconds = SECONDS.format("r.game_clock")
    restart = f"coalesce(({seconds}) >= 300 and f.low <= 45, false)"
    ahead = f"({restart} and (f.q < 4 or coalesce(r.quarter = f.q + 1, false)))"
    folded = fold(
        rows, "game_id", "spot",
        f"coalesce(nullif(r.quarter, 0), 1) as q, {seconds} as low, r.game_clock as shown",
        f"""case when {ahead} then f.q + 1 else f.q end,
            case when {ahead} then {seconds} when ({seconds}) > f.low then f.low
                 else coalesce({seconds}, f.low) end,
            case when not {ahead} and ({seconds}) > f.low
                 then cast(least(f.low, 900) // 60 as string) || ':'
                      || lpad(cast(least(f.low, 900) % 60 as string), 2, '0')
                 else r.game_clock end""",
    )
    return f"select * exclude (rn, q, low, shown) replace (q as quarter, shown as game_clock) from ({folded})"


def unsupported(rows: str) -> str:
    """``rows`` has no readable calls, so a banner is never evidence."""
    evidence = """(f.k_special is not null or r.special_state is not null
      or coalesce(f.k_away <> r.away_score, false) or coalesce(f.k_home <> r.home_score, false)
      or coalesce(r.down = 1 or r.down = f.k_down + 1, false) and f.k_down is not null)"""
    folded = fold(
        rows, "game_id", "spot",
        """r.spot as grp, r.special_state as k_special, r.away_score as k_away,
           r.home_score as k_home, r.down as k_down""",
        f"""case when {evidence} then r.spot else f.grp end,
            case when {evidence} then r.special_state else f.k_special end,
            case when {evidence} then r.away_score else f.k_away end,
            case when {evidence} then r.home_score else f.k_home end,
            case when {evidence} then r.down else f.k_down end""",
    )
    return f"""
      select * exclude (rn, grp, k_special, k_away, k_home, k_down, last, shown)
             replace (last as end_timestamp_seconds, shown as _banner_shown)
      from (select *, max(end_timestamp_seconds) over (partition by game_id, grp) as last,
                   bool_or(_banner_shown) over (partition by game_id, grp) as shown
            from ({folded})) where spot = grp"""


def touchdowns(rows: str) -> str:
    ahead = f"""
      select *, lead(special_state) over w as nx, lag(special_state) over w as px,
             list(away_score) over a as aa, list(home_score) over a as ah
      from {rows}
      window w as (partition by game_id order by spot),
             a as (partition by game_id order by spot rows between 1 following and 12 following)"""
    side = """(case when r.possession_team is not distinct from r.away_team then 'a'
                    when r.possession_team is not distinct from r.home_team then 'h' end)"""
    pair = "(coalesce(r.special_state = 'extra_point' and r.nx = 'kickoff', false))"

    def goal(which: str) -> str:
        return f"(f.{which} + 6)"

    def final(which: str, own: str) -> str:
        return f"coalesce(list_filter(r.{own}, lambda v: v in ({goal(which)}, {goal(which)} + 1))[1], {goal(which)})"

    hit = {w: f"({pair} and {side} = '{s}' and f.{w} is not null)" for w, s in (("na", "a"), ("nh", "h"))}
    step = []
    for new, own, pending in (("na", "away_score", "ka"), ("nh", "home_score", "kh")):
        step.append(f"coalesce(f.{pending}, case when {hit[new]} then {goal(new)} end, r.{own})")
    for new, ahead_list in (("na", "aa"), ("nh", "ah")):
        step.append(f"case when {hit[new]} then {final(new, ahead_list)} end")
    folded = fold(
        "looked", "game_id", "spot",
        "r.away_score as na, r.home_score as nh, cast(null as int) as ka, cast(null as int) as kh",
        ", ".join(step),
    )
    return f"""with recursive looked as ({ahead})
      select * exclude (rn, nx, px, aa, ah, na, nh, ka, kh)
             replace (na as away_score, nh as home_score) from ({folded})"""


def plays(rows: str) -> str:
    """Plays where no call text is readable."""
    d = {s: f"(coalesce(c.{s}_score, 0) - coalesce(p.{s}_score, 0))" for s in ("away", "home")}
    turnover = "coalesce(p.down = 4 and c.down = 1, false)"
    gained = """(case when c.down = p.down + 1 and p.distance is not null and c.distance is not null
                 then p.distance - c.distance else abs(c.yard_line - p.yard_line) end)"""
    boundary = f"(coalesce(p.possession_team <> c.possession_team, false) or {turnover})"
    scoring = f"({d['away']} >= 3 or {d['home']} >= 3)"
    special = "coalesce(p.special_state in ('extra_point', 'kickoff'), false)"
    return f"""
      with pairs as (
        select r as c, lag(r) over (partition by r.game_id order by r.spot) as p
        from (select r from {rows} r)),
      ruled as (
        select *, {gained} as g, c._banner_shown and not ({boundary} or {scoring}) as banner,
          case when p.special_state = 'extra_point' then 'pat'
               when p.special_state = 'kickoff' then 'kick'
               when {turnover} then 'downs'
               when {d['away']} >= 6 or {d['home']} >= 6 then 'td'
               when {d['away']} in (2, 3) or {d['home']} in (2, 3) then 'fg'
               when c.down = 1 and (c.distance = 10 or c.distance is null) then 'first'
               when c.down = p.down + 1 then 'next'
               when c.down = p.down then 'same'
               when {gained} <> 0 then 'gain' else 'run' end as rule
        from pairs where p.down is not null or p.special_state is not null),
      scored as (
        select *,
          case when {special} then p.special_state end as play_type,
          case rule when 'pat' then null when 'kick' then null when 'fg' then null
            when 'downs' then case when p.yard_line is not distinct from c.yard_line then 0 else g end
            when 'td' then case when p.field_side = 'opponent' and p.yard_line is not null then p.yard_line
                                when p.field_side = 'own' and p.yard_line is not null then 100 - p.yard_line
                                else g end
            else g end as yards_gained,
          case rule
            when 'pat' then case when {d['away']} = 1 or {d['home']} = 1 then 'extra point good'
                                 else 'extra point attempt' end
            when 'kick' then case when c.field_side <> '' and c.yard_line is not null
              then 'kickoff returned to ' || c.field_side || ' ' || c.yard_line else 'kickoff' end
            when 'downs' then 'turnover on downs' when 'td' then 'touchdown'
            when 'fg' then 'field goal good'
            when 'first' then case when g <> 0 then g || '-yard gain / first down' else 'first down' end
            when 'next' then case when g is null then 'short gain' when g > 0 then 'gain of ' || g
                                  when g = 0 then 'no gain' else abs(g) || '-yard loss' end
            when 'same' then 'no gain / incomplete / penalty'
            when 'gain' then 'gain of ' || g else 'play run' end as result,
          {boundary} or p.special_state is not distinct from 'kickoff' as possession_change,
          case when {special} or not banner then 1.0 else 0.0 end as call_confidence,
          case when {special} or {d['away']} <> 0 or {d['home']} <> 0 then 1.0
               when p.down is not null and c.down is not null then 0.85
               when banner then 0.65 else 0.4 end as result_confidence,
          ((p.quarter is not null)::int + (p.game_clock is not null)::int
            + (p.away_team is not null)::int + (p.home_team is not null)::int
            + (p.away_score is not null)::int + (p.home_score is not null)::int
            + (p.possession_team is not null)::int
            + case when {special} then 0 else (p.down is not null)::int
                + (p.distance is not null)::int + (p.yard_line is not null)::int end)
            / (case when {special} then 7.0::double else 10.0::double end) as situation,
          concat_ws(',', case when p.special_state is not null or c.special_state is not null then 'special_state' end,
            case when coalesce(p.away_score <> c.away_score, false) or coalesce(p.home_score <> c.home_score, false)
                 then 'score_change' end,
            case when c.down = p.down + 1 then 'legal_down_progression'
                 when p.down is not null and c.down = 1 then 'first_down_or_possession_transition' end) as evidence,
          case when p.special_state = 'extra_point' then 'PAT Kick' when p.special_state = 'kickoff' then 'Kickoff'
               when not banner then '{C.BANNER_NOT_SHOWN}' end as off_call,
          case when {special} then null when not banner then '{C.BANNER_NOT_SHOWN}' end as def_call
        from ruled)
      select c.game_id as game_id, cast(row_number() over (partition by c.game_id order by c.spot) - 1 as int) as play_number,
        p.start_timestamp_seconds as start_timestamp_seconds, c.start_timestamp_seconds as end_timestamp_seconds,
        p.quarter as quarter, p.game_clock as game_clock, p.down_distance as down_distance,
        p.possession_team as possession_team, p._stream_side as stream_side, play_type, result,
        cast(yards_gained as int) as yards_gained, possession_change, banner as previous_play_banner_shown,
        round(situation, 3) as situation_confidence, call_confidence::double as call_confidence,
        result_confidence::double as result_confidence,
        round((situation + call_confidence::double + result_confidence::double) / 3, 3) as overall_confidence,
        evidence as transition_evidence,
        concat_ws(' ', case when p.quarter <> 0 then 'Q' || p.quarter end, p.game_clock) ||
          case when p.quarter is null and p.game_clock is null then '' else ' — ' end ||
          concat_ws(' ', p.down_distance, 'at the ' || p.yard_line) || ' — ' ||
          coalesce(off_call, '?') || ' vs ' || coalesce(def_call, '?') || ' — ' || result ||
          case when c.down_distance is null and c.yard_line is null then ''
               else ' (→ ' || concat_ws(', ', c.down_distance, 'at the ' || c.yard_line) || ')' end as description
      from scored"""


GAME_STEPS = [
    ("frames", B.FRAMES),
    *scores("frames"),
    ("cleaned", situation("scored")),
    *spotted("cleaned"),
    *summaries("spotted"),
    ("s1", same_clock("summaries")),
    ("s2", before_special("s1")),
    ("s3", backfill("s2")),
    ("s4", downs("s3")),
    ("s5", stream_sides("s4")),
    ("s6", possession("s5")),
    ("s7", propagated("s6")),
    ("s8", clocks("s7")),
    ("s9", same_clock("s8")),
    ("s10", unsupported("s9")),
    ("s11", touchdowns("s10")),
    ("plays", plays("s11")),
]


def up_to(name: str, last: str) -> str:
    names = [n for n, _ in GAME_STEPS]
    return chain(*GAME_STEPS[: names.index(name) + 1], last=last)


def on_summaries(query: str, columns: str) -> str:
    return chain(("summaries", B.SUMMARIES), last=f"select {columns} from ({query})")


def _longest(a: str, b: str, alo: str, ahi: str, blo: str, bhi: str) -> str:
    """Longest common block of two stretches: first in ``a``, then in ``b`` among equals."""
    return f"""list_max(flatten(list_transform(range({alo}, {ahi}), lambda i: list_transform(range({blo}, {bhi}), lambda j:
      {{'k': list_max(list_filter(range(0, least({ahi} - i, {bhi} - j) + 1),
              lambda k: substr({a}, i + 1, k) = substr({b}, j + 1, k))), 'i': -i, 'j': -j}}))))"""


def ratios(pairs: str) -> tuple[tuple[str, str], ...]:
    """Chain steps that end in ``ratios`` (a, b, ratio): twice the letters in common blocks, found
    longest first and then on both sides of each, over all letters."""
    whole = _longest("a", "b", "cast(0 as bigint)", "cast(length(a) as bigint)", "cast(0 as bigint)", "cast(length(b) as bigint)")
    side = _longest("a", "b", "s.alo", "s.ahi", "s.blo", "s.bhi")
    return (
        ("pairs", f"select distinct a, b from ({pairs}) where a <> '' and b <> ''"),
        ("blocks", f"""
          select a, b, 0::bigint as alo, length(a)::bigint as ahi, 0::bigint as blo, length(b)::bigint as bhi, {whole} as m from pairs
          union all
          select a, b, s.alo, s.ahi, s.blo, s.bhi, {side} as m from (
            select a, b, unnest([{{'alo': alo, 'ahi': -m.i, 'blo': blo, 'bhi': -m.j}},
                                 {{'alo': m.k - m.i, 'ahi': ahi, 'blo': m.k - m.j, 'bhi': bhi}}]) as s
            from blocks where m.k > 0) where s.ahi > s.alo and s.bhi > s.blo"""),
        ("ratios", "select a, b, 2.0::double * sum(m.k) / (length(a) + length(b)) as ratio from blocks group by a, b"),
    )


def recursive(*steps: tuple[str, str], last: str) -> str:
    """As ``chain``; the step ``blocks`` refers to itself and so is not kept as a table."""
    return chain(*steps, last=last).replace("blocks as materialized (", "blocks as (")


def _key(text: str) -> str:
    return f"regexp_replace(upper({text}), '[^A-Z0-9]', '', 'g')"


def checked(calls: str, side: str = "offense") -> tuple[tuple[str, str], ...]:
    """Chain steps that end in ``checked``: ``calls`` (text, formation) with the catalog name and its status."""
    formed = "1 = 1" if side == "offense" else "1 = 0"
    return (
        ("catalog", B.CATALOG),
        ("calls", f"""select *, case when text <> '' then {_key('text')} end as c,
                             case when formation <> '' and {formed} then {_key('formation')} end as f from ({calls})"""),
        ("names", f"select distinct play_name, {_key('play_name')} as n from catalog where side = '{side}'"),
        ("exact", "select n, min(play_name) as exact_name from names group by n having count(*) = 1"),
        ("formed", f"""select distinct {_key("coalesce(formation_family, '') || coalesce(formation, '')")} as f, play_name,
                              {_key('play_name')} as n from catalog where side = 'offense'"""),
        ("open", "select distinct c, f from calls where c not in (select n from exact) and length(c) >= 3"),
        ("candidates", """
          select o.c, o.f, x.play_name, x.n from open o join formed x on o.f = x.f and o.f <> ''
          union all
          select o.c, o.f, x.play_name, x.n from open o, names x
          where o.f is null or o.f = '' or o.f not in (select f from formed)"""),
        *ratios("select c as a, n as b from candidates"),
        ("ranked", """
          select c, f, play_name, ratio, row_number() over w as r, coalesce(lead(ratio) over w, 0) as following
          from candidates join ratios on c = a and n = b
          window w as (partition by c, f order by ratio desc, play_name desc)"""),
        ("fuzzy", f"""select * from ranked where r = 1 and (ratio >= {C.FUZZY_ACCEPT}::double
          or (ratio >= {C.FUZZY_ACCEPT_WITH_MARGIN}::double and ratio - following >= {C.FUZZY_MARGIN}::double))"""),
        ("checked", """
          select calls.*, coalesce(upper(exact_name), upper(fuzzy.play_name)) as name,
                 case when text is null or text = '' then 'unreadable' when exact_name is not null then 'verified'
                      when fuzzy.play_name is not null then 'verified_fuzzy' else 'unverified' end as name_status
          from calls left join exact on calls.c = exact.n
          left join fuzzy on calls.c = fuzzy.c and calls.f is not distinct from fuzzy.f and exact_name is null"""),
    )


CHECKED_CALLS = recursive(*checked(B.CALLS), last="select call_id, text, name, name_status from checked")

CANDIDATES = recursive(
    *checked(f"""select cast(call_id % 50 as varchar) as game_id, call_id % 7 as spot, call_id as pos, text,
                        cast(null as varchar) as formation from ({B.CALLS})"""),
    ("supported", """
      select game_id, spot, name, count(*) as n, bool_or(name_status = 'verified') as exact,
             count(distinct c) as spellings, min(pos) as first
      from checked where name is not null group by game_id, spot, name"""),
    last="""select game_id, spot, case when n >= 2 and (exact or spellings >= 2) then name end as voted from supported
      qualify row_number() over (partition by game_id, spot order by n desc, first) = 1""",
)

def consensus(reads: str) -> str:
    """(game_id, spot, text): the best-supported text of ``reads`` (game_id, spot, pos, text)."""
    return recursive(
        ("counted", f"""
          select game_id, spot, trim(regexp_replace(upper(text), '[^A-Z0-9]+', ' ', 'g')) as clean,
                 count(*) as n, min(pos) as first
          from ({reads}) where text <> '' group by all having clean <> ''"""),
        ("squeezed", "select *, replace(clean, ' ', '') as s from counted"),
        *ratios("select x.s as a, y.s as b from squeezed x join squeezed y using (game_id, spot)"),
        ("scored", f"""
          select x.game_id, x.spot, x.clean, x.first,
                 sum(cast(floor(ratio * 1000000000 + 0.5::double) as bigint) * y.n)
                 + len(list_filter(string_split(x.clean, ' '), lambda w: list_contains({list(C.CONSENSUS_TOKENS)}, w))) * 1500000000
                 + least(length(x.clean), 24) * 30000000 as score
          from squeezed x join squeezed y using (game_id, spot) join ratios on a = x.s and b = y.s
          group by x.game_id, x.spot, x.clean, x.first"""),
        last="""select game_id, spot, clean as text from scored
          qualify row_number() over (partition by game_id, spot order by score desc, length(clean) desc, first) = 1""",
    )


CONSENSUS = consensus(
    f"select cast(call_id % 50 as varchar) as game_id, call_id % 7 as spot, call_id as pos, text from ({B.CALLS})"
)


def refined(summaries: str, looks: str, quality: str) -> str:
    """Calls after the closer look; ``quality`` is SQL for a text's quality, with {0} for the text."""

    def names(texts: str, side: str) -> str:
        return recursive(*checked(f"select distinct text, formation from ({texts})", side), last="select text, formation, name, name_status, c from checked")

    steps = [
        ("s", f"select *, lag(_formation) over (partition by game_id order by spot) as bf from ({summaries})"),
        ("known_off", names("select _prev_off as text, bf as formation from s", "offense")),
        ("known_def", names("select _prev_def as text, cast(null as varchar) as formation from s", "defense")),
        ("n", """
          select s.*, o.name_status not in ('verified', 'verified_fuzzy') as needs_off,
                 d.name_status not in ('verified', 'verified_fuzzy') as needs_def
          from s left join known_off o on o.text is not distinct from _prev_off and o.formation is not distinct from bf
          left join known_def d on d.text is not distinct from _prev_def"""),
        ("looks", f"""
          select n.game_id, n.spot, cast(floor(o.timestamp_seconds - n.start_timestamp_seconds) as int) as second,
                 off_text, def_text, heading
          from n join ({looks}) o on o.game_id = n.game_id and o.panel_visible and (needs_off or needs_def)
            and o.timestamp_seconds between n.start_timestamp_seconds
            and least(n.end_timestamp_seconds + 1, n.start_timestamp_seconds + 12)
          qualify row_number() over (partition by n.game_id, n.spot, second order by o.timestamp_seconds) = 1"""),
        ("heads", "select game_id, spot, string_agg(distinct heading, ',' order by heading) as h from looks where heading <> '' group by all"),
    ]
    for short, side in (("off", "offense"), ("def", "defense")):
        steps += [
            (f"reads_{short}", f"""
              select * from (
                select game_id, spot, -1 as pos, _prev_{short} as text, bf as formation from n where needs_{short}
                union all
                select game_id, spot, second, {short}_text, bf from looks join n using (game_id, spot) where needs_{short})
              where text <> ''"""),
            (f"names_{short}", names(f"select text, formation from reads_{short}", side)),
            (f"voted_{short}", f"""
              select game_id, spot, case when n >= 2 and (exact or spellings >= 2) then name end as voted from (
                select game_id, spot, name, count(*) as n, bool_or(name_status = 'verified') as exact,
                       count(distinct c) as spellings, min(pos) as first
                from reads_{short} r join names_{short} k on k.text = r.text and k.formation is not distinct from r.formation
                where name is not null group by game_id, spot, name)
              qualify row_number() over (partition by game_id, spot order by n desc, first) = 1"""),
            (f"best_{short}", consensus(f"select * from reads_{short}")),
            (f"told_{short}", f"""
              select game_id, spot, count(*) as looked, string_agg(distinct text, ',' order by text) as evidence
              from reads_{short} group by all"""),
        ]

    def call(short: str) -> str:
        old, new = quality.format(f"n._prev_{short}"), quality.format(f"b_{short}.text")
        return f"""case when v_{short}.voted is not null then v_{short}.voted
          when t_{short}.looked >= 3 and {new} >= {old} then b_{short}.text else n._prev_{short} end as _prev_{short}"""

    joins = " ".join(
        f"left join {step}_{short} {step[0]}_{short} using (game_id, spot)"
        for short in ("off", "def") for step in ("voted", "best", "told")
    )
    return chain(*steps, last=f"""
      select game_id, spot, {call('off')}, {call('def')}, coalesce(t_off.evidence, '') as off_evidence,
             coalesce(heads.h, '') as headings
      from n {joins} left join heads using (game_id, spot)""")

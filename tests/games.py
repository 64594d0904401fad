"""Random games: noisy frames of an invented match."""

from __future__ import annotations

import random

from snapcount import schemas

NAMES = [part.split()[0] for part in schemas.FRAMES.replace("\n", " ").split(",")]
CALLS = ["HB STRETCH", "HE STRETCH", "HBSTRETCH", "MESH SPOT", "NESH SPOT", "COVER 3 SKY", "COVER 3 SKV"]


def game(seed, frames=80, plain_teams=True):
    rng = random.Random(seed)
    state = {"quarter": 1, "down": 1, "distance": 10, "yard_line": 25, "away_score": 0, "home_score": 0}
    clock, special, rows = 420, None, []
    away, home = rng.choice([("NYJ", "TEN"), ("NYJ", "TEN"), (None, "TEN"), ("NYJ", None), (None, None)])
    if plain_teams:
        away, home = "NYJ", "TEN"
    team, field, side = rng.choice([away, home]), "own", "offense"
    for i in range(frames):
        if rng.random() < 0.25:
            special = None
            state["down"] = rng.choice([state["down"] % 4 + 1, 1, 1, rng.randint(1, 4)])
            state["distance"] = rng.choice([10, 7, 3, 0, None])
            state["yard_line"] = rng.choice([state["yard_line"], rng.randint(1, 50)])
            if rng.random() < 0.3:
                who = rng.choice(["away_score", "home_score"])
                state[who] += rng.choice([6, 3, 1, 7, 2])
                special = rng.choice(["extra_point", "extra_point", "kickoff", None])
            elif rng.random() < 0.3:
                special = rng.choice(["kickoff", "extra_point"])
            team = rng.choice([away, home, team])
            clock -= rng.choice([0, 5, 20, 40, 90])
            if clock < 0:
                clock = rng.choice([430, 300, 20])
                state["quarter"] = min(4, state["quarter"] + rng.choice([0, 1, 1]))

        def noisy(value, wrong, missing=0.12, bad=0.06):
            draw = rng.random()
            return None if draw < missing else wrong if draw < missing + bad else value

        off = special is not None
        banner = rng.random() < 0.4
        rows.append({
            "game_id": f"g{seed}",
            "frame_index": i * rng.choice([1]) * 30 + 3,
            "timestamp_seconds": i + 0.25,
            "quarter": noisy(state["quarter"], rng.randint(1, 4)),
            "game_clock": noisy(f"{clock // 60}:{clock % 60:02d}", rng.choice(["9:59", "x", "0:03"])),
            "down": None if off else noisy(state["down"], rng.randint(1, 4)),
            "distance": None if off else noisy(state["distance"], 5),
            "special_state": noisy(special, None, 0.1, 0),
            "yard_line": noisy(state["yard_line"], rng.randint(1, 50)),
            "field_side": noisy(field, "opponent", 0.4),
            "stream_side": noisy(side, "defense", 0.6, 0.2),
            "personnel": noisy("1 RB, 1 TE, 3 WR", "", 0.5),
            "formation": noisy("Gun - Trips TE", "Gun - Deuce", 0.6, 0.2),
            "away_team": noisy(away, "NVJ"),
            "home_team": noisy(home, "TFN"),
            "possession_team": noisy(team, "XXX", 0.4),
            "away_score": noisy(state["away_score"], rng.randint(0, 30), 0.1, 0.1),
            "home_score": noisy(state["home_score"], rng.randint(0, 30), 0.1, 0.1),
            "previous_play_banner_shown": noisy(banner, None),
            "prev_def_call": rng.choice(CALLS + ["", None]) if banner else None,
            "prev_off_call": rng.choice(CALLS + ["", None]) if banner else None,
        })
    return rows


def frames(spark, games):
    rows = [tuple(r[n] for n in NAMES) for rows in games for r in rows]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, schemas.FRAMES)

"""Alignments in tiles against the full table of a game."""

import random

import numpy as np
import pyarrow as pa
import pytest

from snapcount import schemas
from snapcount.operators import calibration
from workload import table_queries

WEIGHTS = calibration.C.ALIGNMENT_WEIGHTS
SCHEMA = "game_id string, play_number int, " + ", ".join(f"{n} {'string' if 'call' in n else 'int'}" for n in WEIGHTS)


def table(spark, games):
    return spark.createDataFrame(
        [(g, 10 * i, *(row.get(n) for n in WEIGHTS)) for g, rows in games.items() for i, row in enumerate(rows)], SCHEMA
    )


def same(field, x, y):
    if "call" not in field:
        return x == y
    x, y = x.replace(" ", ""), y.replace(" ", "")
    return x in y or y in x


def full_table(a, b):
    """Pairs of the best alignment, from every cell of the table."""

    def score(x, y):
        both = [k for k in WEIGHTS if x[k] is not None and y[k] is not None]
        points = [WEIGHTS[k] if same(k, x[k], y[k]) else -0.75 * WEIGHTS[k] for k in both]
        return sum(points) if len(both) >= 2 else -3.0

    best = {(i, 0): (-3.0 * i, 1) for i in range(len(a) + 1)} | {(0, j): (-3.0 * j, 2) for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            options = [best[i - 1, j - 1][0] + score(a[i - 1], b[j - 1]), best[i - 1, j][0] - 3, best[i, j - 1][0] - 3]
            best[i, j] = max(options), options.index(max(options))
    found, i, j = [], len(a), len(b)
    while i and j:
        move = best[i, j][1]
        if move == 0 and score(a[i - 1], b[j - 1]) > 0:
            found.append((10 * (i - 1), 10 * (j - 1)))
        i, j = i - (move != 2), j - (move != 1)
    return found


@pytest.mark.parametrize("tile", [3, 512])
def test_tiles_align_as_the_full_table_does(spark, tile):
    rng = random.Random(5)
    choices = {k: [None, "HB A", "HBA", "B"] if "call" in k else [None, 1, 2, 3] for k in WEIGHTS}
    games = [{f"g{g}": [{k: rng.choice(v) for k, v in choices.items()} for _ in range(rng.randint(0, 9))] for g in range(40)} for _ in range(2)]
    games[0]["only labels"], games[1]["only plays"] = games[0]["g1"], games[0]["g2"]
    got = calibration.align_plays(table(spark, games[0]), table(spark, games[1]), tile).collect()
    want = {(g, *pair) for g in games[0] if g in games[1] for pair in full_table(games[0][g], games[1][g])}
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 40


def test_an_inserted_play_is_skipped_and_empty_sides_have_no_pairs(spark):
    expected = [dict(quarter=1, down=d, distance=x, yard_line=y) for d, x, y in [(2, 9, 36), (3, 1, 44), (4, 2, 43)]]
    observed = [expected[0], dict(quarter=1, down=1, distance=10, yard_line=5), *expected[1:]]
    labels, plays = table(spark, {"g": expected}), table(spark, {"g": observed})
    assert sorted(tuple(r)[1:] for r in calibration.align_plays(labels, plays).collect()) == [(0, 0), (10, 20), (20, 30)]
    none = table(spark, {})
    assert calibration.align_plays(labels, none).count() == calibration.align_plays(none, plays).count() == 0


def test_tiles_of_a_batch_are_computed_together_in_bounded_groups(monkeypatch):
    rng = random.Random(8)

    def rows(n):
        return [{"place": p, "number": p, **{k: rng.choice([None, "A", "B"] if "call" in k else [None, 1, 2]) for k in WEIGHTS}} for p in range(n)]

    sizes = [(rng.randint(1, 6), rng.randint(1, 6)) for _ in range(500)]
    made = [{"game_id": f"g{g}", "i": 0, "j": 0, "i_rows": rows(a), "j_rows": rows(b), "top": None, "left": None} for g, (a, b) in enumerate(sizes)]
    scores = pa.list_(pa.float64())
    item = pa.struct([("place", pa.int32()), ("number", pa.int64()), *((k, pa.string() if "call" in k else pa.int32()) for k in WEIGHTS)])
    fields = [("game_id", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("i_rows", pa.list_(item)), ("j_rows", pa.list_(item)), ("top", scores), ("left", scores)]
    batch = pa.RecordBatch.from_pylist(made, schema=pa.schema(fields))
    whole = list(calibration._Tiles(batch, 6).groups())
    assert len(whole) == 1
    monkeypatch.setattr(calibration, "CELLS", 700)
    tiles = calibration._Tiles(batch, 6)
    groups = list(tiles.groups())
    assert sorted(np.concatenate(groups).tolist()) == list(range(500)) and len(groups) < 60
    found = {}
    for some in groups:
        assert len(some) * (max(sizes[g][0] for g in some) + 1) * (max(sizes[g][1] for g in some) + 1) <= 700
        rows_of, columns_of = (np.array([sizes[g][k] for g in some]) for k in (0, 1))
        at, left, right, _, _ = tiles.trace(some, rows_of, columns_of)
        numbers = tiles.labels.number.to_numpy()[left], tiles.plays.number.to_numpy()[right]
        for t, a, b in zip(at, *numbers, strict=True):
            found.setdefault(some[t], []).append((10 * a, 10 * b))
    for g, m in enumerate(made):
        assert found.get(g, []) == full_table(m["i_rows"], m["j_rows"])


def test_fields_are_compared_before_a_row_becomes_one_for_each(spark):
    fields = [f.split() for f in schemas.LABELS.replace("\n", " ").split(",")]

    def label(**values):
        return tuple(values.get(name) for name, _ in fields)

    labels = spark.createDataFrame(
        [label(game_id="g", play_number=1, quarter=2, result=" No-Gain ", formation="...", distance_label="inches"),
         label(game_id="g", play_number=2, down=3, result="Sack", offensive_play_call="HB dive")], schemas.LABELS,
    )
    names = [n for n in calibration.C.CALIBRATED_FIELDS if n != "game_clock_bucket"]
    plays = spark.createDataFrame(
        [("g", 5, "2:10", *({"quarter": "3", "result": "NOGAIN", "formation": "Gun"}.get(n) for n in names)),
         ("g", 6, "2:10", *({"down": "3", "offensive_play_call": "Punt"}.get(n) for n in names))],
        "game_id string, play_number int, game_clock string, " + ", ".join(f"{n} string" for n in names),
    )
    aligned = spark.createDataFrame([("g", 1, 5), ("g", 2, 6)], "game_id string, expected_number int, play_number int")
    found = calibration.compare_fields(labels, plays, aligned)
    assert {(r.play_number, r.observed_play_number, r.field, r.expected, r.observed, r.status) for r in found.collect()} == {
        (1, 5, "quarter", "2", "3", "mismatch"), (1, 5, "result", " No-Gain ", "NOGAIN", "match"), (1, 5, "formation", "...", "Gun", "match"),
        (1, 5, "distance", "0", None, "missing"), (2, 6, "down", "3", "3", "match"), (2, 6, "result", "Sack", None, "missing"),
        (2, 6, "offensive_play_call", "HB dive", "Punt", "mismatch"),
    }
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Generate", 1)[0]
    assert "regexp_replace" not in above


def test_lines_are_numbered_once(spark, tmp_path, monkeypatch):
    rows = [(o, n, 7 * o + n, 3 * o + n, 5.0 * n, "ANR"[n % 3], "FO"[o % 2]) for o in range(6) for n in range(1, 8)]
    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    reads, numbered = [], table_queries._numbered
    monkeypatch.setattr(table_queries, "_numbered", lambda *a: reads.append(a) or numbered(*a))
    labels, observed, aligned = table_queries._aligned_rows(spark, str(tmp_path))
    assert len(reads) == 1 and labels.count() == 42 and 0 < observed.count() < 42
    assert {tuple(r) for r in aligned.select("game_id", "play_number").collect()} <= {tuple(r) for r in observed.select("game_id", "play_number").collect()}

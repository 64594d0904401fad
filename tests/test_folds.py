"""Folds over many keys, and work that must not be done again for each reader."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from snapcount.operators import catalog as K
from snapcount.operators import repairs, stabilise
from snapcount.operators import sequence as S
from snapcount.operators.sequence import Machine, Sequence
from snapcount.plans import games


def _sums() -> Machine:
    # A class of a function is shipped by value; workers don't know this file.
    class _Sums(Machine):
        """Running sum of the values that are there; -1 if the rows are not plain lists."""

        def run(self, state, rows):
            out = []
            for value in rows["value"]:
                state += value or 0
                out.append(state if type(rows["value"]) is list else -1)
            return state, {"spot": rows["spot"], "total": out}

        def reach(self, rows):
            ends = {start: self.run(start, rows)[0] for start in range(200)}
            return ends, None

    return _Sums()


@pytest.mark.parametrize("width", [None, 3])
def test_folds_take_rows_as_lists(spark, width):
    """Keys are many and short, so a data frame a key or chunk was most of the time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(f"g{g}", s, None if s == 4 else 1 + s % 2) for g in range(40) for s in range(1 + g % 11)]
        df = spark.createDataFrame(rows, "game_id string, spot long, value int")
        found = S.fold(df, Sequence(("game_id",), "spot", width), _sums(), "spot long, total long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = {}
    for game, spot, value in rows:
        expected[game, spot] = expected.get((game, spot - 1), 0) + (value or 0)
    assert len(found) == len(rows) and {(r.game_id, r.spot): r.total for r in found} == expected


def test_machines_return_lists():
    score = stabilise.ScoreSteps("at").run(0, {"at": [1, 2, 3], "value": [3, 2, 9], "single": [False] * 3})
    assert score == (9, {"at": [1, 3], "value": [3, 9]})
    rows = {"at": [1, 2, 3], "_down": [1, 3, 2], "_forced": [True, False, False], "_backed": [False] * 3}
    assert repairs.DownEvidence("at").run(0, rows) == (2, {"at": [2]})
    assert S.Greedy(2, "_at", ["at"]).run(0, {"at": [5, 6, 7], "_at": [1, 2, 3]}) == (4, {"at": [5, 7]})


def _reads(df, marker):
    return df._jdf.queryExecution().optimizedPlan().toString().count(marker)


def test_a_large_catalog_does_not_compute_the_rows_again(spark):
    """Each check read its rows three times, so checks in a row read the first rows exponentially often."""
    plays = spark.createDataFrame(
        [(side, "Gun", "Ace", f"{side} Play {n}", "pass", n, "u") for side in K.SIDES for n in range(5)],
        "side string, formation_family string, formation string, play_name string, play_type string, pos long, source_url string",
    )
    catalog = K.Catalog(plays)
    catalog._small = False
    calls = spark.range(50).select(
        F.lit(True).alias("shown"),
        F.concat(F.lit("offence play "), F.col("id") % 5).alias("off"),
        F.concat(F.lit("DEFENSE PLAY "), F.col("id") % 5).alias("def"),
    )
    out = K.resolve_calls(calls, catalog, "off", "def", "shown", "own")
    assert _reads(out, "Range (") == 1
    assert {(r.own_off_status, r.own_def_status) for r in out.collect()} == {("verified_fuzzy", "verified")}


def test_plays_are_made_from_written_summaries(spark, monkeypatch):
    """Pairing reads its summaries several times; they are not repaired each time."""
    seen = []
    monkeypatch.setattr(games, "_summaries", lambda *_: spark.range(3).withColumnRenamed("id", "game_id"))
    monkeypatch.setattr(games.pairing, "pair_plays", lambda df, *_: seen.append(_reads(df, "Range (")) or df)
    frames = spark.range(3).withColumnRenamed("id", "game_id")
    games.plays_from_frames(frames, None)
    assert seen == [0]

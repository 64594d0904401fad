import random

import pytest

from snapcount import schemas
from snapcount.operators import catalog as K
from snapcount.operators import evidence, reports
from snapcount.functions.similarity import best_supported
from snapcount.operators.catalog import Catalog, validate_calls
from snapcount.operators.spots import consensus_by_key
from pyspark.sql import functions as F


def make(spark, offense=(), defense=(), places=()):
    rows = [("offense", n) for n in offense] + [("defense", n) for n in defense]
    names = spark.createDataFrame(rows, "side string, play_name string")
    plays = [
        ("offense", "offense", family, formation, "f", name, "p", kind, 1, f"u{i}", i)
        for i, (family, formation, name, kind) in enumerate(places)
    ]
    return Catalog(spark.createDataFrame(plays, schemas.CATALOG), names)


def check(spark, catalog, text, side="offense", formation=None, small=None):
    df = spark.createDataFrame([(text, formation)], "text string, formation string")
    if small is not None:
        catalog._small = small
    row = K.validate_calls(df, catalog, "text", side, "n", "formation").head()
    return row.n, row.n_status


@pytest.mark.parametrize("small", [True, False])
def test_calls_are_matched(spark, small):
    c = make(
        spark,
        ["H Mtn Flood H-Sneak", "Mtn Flood Hb Sneak", "Mesh", "Mesh Spot", "Duo", "Y Out", "Pa Deep Read", "Pa Deep Out"],
        ["Roll 23 Cloud", "Roll 28 Cloud"],
        [("Gun", "Trips TE", "Pa Deep Read", "pass")],
    )
    cases = [
        ("H MIN FLOOD HSNEAK", None, ("H MTN FLOOD H-SNEAK", "verified_fuzzy")),
        ("ME", None, (None, "unverified")),
        ("DUO", None, ("DUO", "verified")),
        ("YOUT", None, ("Y OUT", "verified")),
        ("PA DEEP REAO", "Gun - Trips TE", ("PA DEEP READ", "verified_fuzzy")),
        ("", None, (None, "unreadable")),
        (None, None, (None, "unreadable")),
    ]
    df = spark.createDataFrame([(i, t, f) for i, (t, f, _) in enumerate(cases)], "i int, text string, formation string")
    c._small = small
    got = K.validate_calls(df, c, "text", "offense", "n", "formation").orderBy("i").collect()
    assert [(r.n, r.n_status) for r in got] == [want for _, _, want in cases]
    assert check(spark, c, "ROLL 23 CHOUP", "defense", small=small) == ("ROLL 23 CLOUD", "verified_fuzzy")


def test_blocks_find_what_the_broadcast_finds(spark):
    names = ["AB", "ABC", "CAB", "BAT", "MESH", "HB DIVE", "HB DIVES", "DIVE HB", "COVER 3 SKY", "COVER 2 SKY", "PA Y OUT"]
    c = make(spark, names)
    texts = [n[:i] + x + n[i + 1:] for n in names for i in range(len(n)) for x in ("", "X", "B")]
    df = spark.createDataFrame([(t,) for t in sorted(set(texts))], "text string")

    def run(small):
        c._small = small
        return {(r.text, r.n, r.n_status) for r in K.validate_calls(df, c, "text", "offense", "n").collect()}

    assert run(True) == run(False)


@pytest.mark.parametrize("seed", range(2))
def test_blocks_find_what_the_broadcast_finds_on_random_names(spark, seed):
    rng = random.Random(seed)
    alphabet = "AB" if seed else "ABCDEFGHIJ3 -"
    names = sorted({"".join(rng.choices(alphabet, k=rng.randint(1, 16))).strip() for _ in range(150)} - {""})

    def edited(name):
        letters = list(name)
        for _ in range(rng.randint(0, 1 + len(name) // 4)):
            at = rng.randrange(len(letters) + 1)
            letters[at : at + rng.randint(0, 1)] = rng.choice([[], [rng.choice(alphabet)]])
        return "".join(letters)

    c = make(spark, names)
    df = spark.createDataFrame([(t,) for t in sorted({edited(rng.choice(names)) for _ in range(400)})], "text string")
    found = []
    for small in (True, False):
        c._small = small
        found.append({(r.text, r.n, r.n_status) for r in K.validate_calls(df, c, "text", "offense", "n").collect()})
    assert found[0] == found[1]
    assert {"verified_fuzzy", "unverified"} <= {status for _, _, status in found[0]}


def test_catalog_order_of_one_family_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["offense", None]), "Gun", rng.choice([None, "", "Ace", "Trips"]), f"n{rng.randint(0, 99):02}", "f", f"s{i:03}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "side string, formation_family string, formation string, play_name string, formation_slug string, play_slug string, i long")
    got = [r.i for r in K.in_catalog_order(df).orderBy("pos").collect()]
    assert [r.pos for r in K.in_catalog_order(df).orderBy("pos").collect()] == list(range(300))
    assert got == [r[6] for r in sorted(rows, key=lambda r: tuple((v is not None, v or "") for v in r[:6]))]
    assert K.in_catalog_order(df.limit(0)).count() == 0


def test_empty_catalog(spark):
    assert check(spark, make(spark), "HB STRETCH") == (None, "catalog_unavailable")


def test_types_and_formations(spark):
    c = make(spark, places=[
        ("Gun", "Normal", "HB Base", "run"), ("Singleback", "Ace", "HB Base", "pass"),
        ("Gun", "Deuce Close", "Bench Dig Curl", "pass"), ("Gun", "Trips TE", "Wide Trap", "run"),
        ("Singleback", "Ace", "Wide Trap", "run"),
    ])
    facts = K.offense_facts(c.plays)
    df = spark.createDataFrame(
        [("HB BASE", None), ("HB BASE", "Gun - Normal"), ("BENCH DIG CURL", None), ("WIDE TRAP", "Gun - X")],
        "norm string, formation string",
    ).join(facts, "norm", "left")
    got = {(r.norm, r.formation): (r.t, r.unique_formation) for r in df.withColumn("t", K.catalog_play_type(F.col("formation"))).collect()}
    assert got == {
        ("HB BASE", None): (None, None),
        ("HB BASE", "Gun - Normal"): ("run", None),
        ("BENCH DIG CURL", None): ("pass", "Gun - Deuce Close"),
        ("WIDE TRAP", "Gun - X"): ("run", None),
    }


def test_candidates_need_repeated_support(spark):
    c = make(spark, ["HB Stretch", "Smash Dagger"])
    rows = [("a", 1, 0, "HB STRETCH"), ("a", 1, 1, "HB STRETCH"), ("a", 1, 2, "HE STRETCH"),
            ("b", 1, 0, "HB STRETCH"), ("c", 1, 0, "SMASH DRAG"), ("c", 1, 1, "SMASH DRAG"), ("c", 1, 2, "SMASH DRAG")]
    df = spark.createDataFrame(rows, "game_id string, spot long, pos int, text string")
    df = df.withColumn("formation", F.lit(None).cast("string"))
    got = {r.game_id: r.voted for r in evidence.candidate_consensus(df, c, "offense").collect()}
    assert got == {"a": "HB STRETCH", "b": None, "c": None}


def test_unknown_calls_are_looked_up(spark):
    c = make(spark, ["HB Stretch"], ["Cover 3 Sky"])
    summaries = spark.createDataFrame(
        [("g", 0, 0.0, 4.0, None, "HB STRETCH", "XX"), ("g", 5, 5.0, 6.0, "Gun", "ZZZZ", "COVER 3 SKY")],
        "game_id string, spot long, start_timestamp_seconds double, end_timestamp_seconds double, "
        "_formation string, _prev_off string, _prev_def string",
    )
    seen = [("g", t, o, d, h, True) for t, o, d, h in [
        (0.5, "NO", "COVER 3 SKV", "PREVIOUS PLAY"), (1.2, "NO", "COVER 3 SKY", None), (5.5, "HB STRETCH", "NO", None),
        (6.1, "HB STRETCH", "NO", None), (7.5, "NO", "NO", None)]]
    obs = spark.createDataFrame(seen, schemas.OBSERVATIONS)
    rows = evidence.refine_calls(summaries, obs, c).orderBy("spot").collect()
    assert [(r._prev_off, r._prev_def) for r in rows] == [("HB STRETCH", "COVER 3 SKY"), ("HB STRETCH", "COVER 3 SKY")]
    assert rows[0]._prev_def_evidence == ["COVER 3 SKV", "COVER 3 SKY", "XX"]
    assert rows[0]._prev_off_evidence == [] and rows[0]._banner_heading_evidence == ["PREVIOUS PLAY"]
    assert rows[1]._prev_off_evidence == ["HB STRETCH", "ZZZZ"]


def test_audit(spark):
    c = make(spark, ["HB Stretch"], ["Cover 3 Sky"])
    names = "previous_offensive_play_call previous_defensive_play_call offensive_play_call defensive_play_call play_type".split()

    def plays(*rows):
        schema = "game_id string, play_number int, " + ", ".join(f"{n} string" for n in names)
        return spark.createDataFrame([("g", i, *r) for i, r in enumerate(rows)], schema)

    with pytest.raises(reports.NonCatalogCallsError, match="Non-catalog play calls"):
        reports.assert_catalog_calls(plays((None, None, "OCR GARBAGE", None, "run")), c)
    reports.assert_catalog_calls(
        plays((None, None, "HB STRETCH", "COVER 3 SKY", "run"), (None, None, "PAT Kick", None, "extra_point")), c
    )


def test_blank_formations_narrow_nothing_in_either_way(spark):
    plays = spark.createDataFrame(
        [
            ("offense", "HB DIVE", "", ""), ("offense", "ZIG ZAG OUT", None, None),
            ("offense", "MESH SPOT", "Gun", "Trips TE"), ("defense", "COVER 3 SKY", "Nickel", "Over"),
        ],
        "side string, play_name string, formation_family string, formation string",
    )
    texts = spark.createDataFrame(
        [(i, t, f) for i, (t, f) in enumerate(
            (t, f) for t in ("HB D1VE", "ZIG ZAG 0UT", "MESH SP0T", "COVER 3 SKV", "NOTHING LIKE", "", None)
            for f in ("", None, "Gun - Trips TE", "Unknown")
        )],
        "id long, text string, formation string",
    )
    for side in ("offense", "defense"):
        found = []
        for small in (True, False):
            one = Catalog(plays.withColumn("formation_slug", F.lit("f")))
            one._small = small
            rows = validate_calls(texts, one, "text", side, "name", "formation").select("id", "name", "name_status")
            found.append(sorted(map(tuple, rows.collect())))
        assert found[0] == found[1]
        names = {n for _, n, _ in found[0]}
        assert names == ({"HB DIVE", "ZIG ZAG OUT", "MESH SPOT", None} if side == "offense" else {"COVER 3 SKY", None})


def test_consensus_of_counts_is_that_of_the_list(spark):
    rng = random.Random(8)
    words = ["GUN", "GUM", "TRIPS", "TR1PS", "COVER", "C0VER", "3", "SKY", "SKV", "ZONE"]
    rows = [
        (f"k{k}", i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 3))))
        for k in range(60) for i in range(rng.randint(1, 12))
    ]
    reads = spark.createDataFrame(rows, "key string, at long, text string")
    expected = {}
    for key, at, text in rows:
        expected.setdefault(key, []).append(text)
    expected = {k: best_supported(v) for k, v in expected.items()}
    found = {r.key: r.text for r in consensus_by_key(reads, ["key"], "at", "text").collect()}
    assert found == {k: v for k, v in expected.items() if v}

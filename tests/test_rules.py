from pyspark.sql import functions as F

from snapcount.functions import metrics as M
from snapcount.functions import plays as R
from snapcount.functions import text as P
from snapcount.functions.similarity import best_supported


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head().v


def values(spark, *columns):
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).head()
    return [row[i] for i in range(len(columns))]


def test_quarters_and_clocks(spark):
    assert values(spark, *(P.parse_quarter(F.lit(t)) for t in ("2nd", "3RD", "4TH", "1ST", "Q3", "--"))) == [
        2, 3, 4, 1, 3, None,
    ]
    assert values(spark, *(P.parse_clock(F.lit(t)) for t in ("7:05", "17:51", "12:61 3:20", "x", "05:09"))) == [
        "7:05", "7:51", "3:20", None, "5:09",
    ]
    assert values(spark, *(P.clock_seconds(F.lit(t)) for t in ("7:05", "65:00", "", None))) == [425, None, None, None]
    assert values(spark, *(P.seconds_clock(F.lit(n)) for n in (34, 1000, -5))) == ["0:34", "15:00", "0:00"]


def test_down_distance_texts(spark):
    reads = ("3rd & 7", "2ND & 45", "4 AND 2", "1 & INCHES", "KICKOFF", "")
    got = values(spark, *(P.parse_down_distance(F.lit(t)) for t in reads))
    assert [tuple(g) for g in got] == [(3, 7), (2, None), (4, 2), (1, 0), (None, None), (None, None)]
    specials = ("KICK OFF", "KICKOFF", "PAT", "PATS")
    assert values(spark, *(P.parse_special_state(F.lit(t)) for t in specials)) == [None, "kickoff", "extra_point", None]
    assert value(spark, P.format_down_distance(F.lit(3), F.lit(0))) == "3 & inches"
    assert value(spark, P.parse_yard(F.lit("OWN 36"))) == 36
    assert value(spark, P.parse_yard(F.lit("123"))) == 3
    assert value(spark, P.parse_yard(F.lit("77"))) is None


def test_context_texts(spark):
    assert value(spark, P.parse_personnel(F.lit("} 1RBJ1TE|3 WR"))) == "1 RB, 1 TE, 3 WR"
    assert value(spark, P.canonical_formation(F.lit("~] GUN - HORMAL Y OFF CLOSE"))) == "Gun - Normal Y Off Close"
    assert value(spark, P.canonical_formation(F.lit("NO FAMILY"))) is None
    assert value(spark, P.canonical_formation(F.lit("GUN"))) == "Gun"
    assert value(spark, P.previous_play_heading(F.lit("PREVIOUS PLAY"))) == "PREVIOUS PLAY"
    assert value(spark, P.previous_play_heading(F.lit("PREVIOUS"))) is None
    assert value(spark, P.parse_team(F.lit("n.y.jets"))) == "NYJ"


def test_metric_rules(spark):
    def rows(*n):
        return F.array(*(F.lit(i) for i in n))

    assert value(spark, M.field_side(rows(0, 12, 10, 8, 6, 4, 2, 0))) == "own"
    assert value(spark, M.field_side(rows(0, 2, 4, 6, 8, 10, 12, 0))) == "opponent"
    assert value(spark, M.field_side(rows(0, 2, 4, 6))) is None
    args = (F.lit("AAA"), F.lit("BBB"))
    assert value(spark, M.possession_team(F.lit(1.0), F.lit(0.0), *args)) == "AAA"
    assert value(spark, M.possession_team(F.lit(0.1), F.lit(0.1), *args)) is None
    assert value(spark, M.panel_visible(F.lit(0.75), F.lit(0.25))) is True
    assert value(spark, M.panel_visible(F.lit(0.0), F.lit(0.0))) is False


def test_links(spark):
    assert value(spark, P.is_url(F.lit("https://a.b/c"))) is True
    assert value(spark, P.is_url(F.lit("ftp://a.b"))) is False
    assert value(spark, P.is_stream_url(F.lit("https://clips.twitch.tv/x"))) is True
    assert value(spark, P.is_stream_url(F.lit("https://example.com/twitch.tv"))) is False
    ids = value(spark, P.chat_channel_ids(F.lit("https://discord.com/channels/12/34")))
    assert tuple(ids) == (12, 34)
    assert value(spark, P.chat_channel_ids(F.lit("https://discord.com/x/12/34"))) is None


def test_consensus_prefers_agreement():
    assert best_supported(["HBSTRETCH", "HB STRETCH", "HB STRETCH", "HE STRETCH"]) == "HB STRETCH"
    assert best_supported([None, "", "--"]) is None


def row(**values):
    kinds = {"special_state": "string", "field_side": "string"}
    names = ["down", "distance", "yard_line", "away_score", "home_score", "special_state", "field_side"]
    return F.struct(*(F.lit(values.get(n)).cast(kinds.get(n, "int")).alias(n) for n in names))


def result(spark, prev, cur, play_type=None, change=False):
    column = R.play_result(prev, cur, F.lit(play_type).cast("string"), F.lit(change))
    got = value(spark, column)
    return got.yards_gained, got.result


def test_results(spark):
    pat = row(away_score=0, home_score=6, yard_line=15), row(away_score=0, home_score=7, yard_line=35)
    assert result(spark, *pat, "extra_point") == (None, "extra point good")
    downs = row(down=4, distance=2, yard_line=43), row(down=1, distance=10, yard_line=43)
    assert result(spark, *downs, "pass", True) == (0, "turnover on downs")
    kick = row(down=4, distance=3, yard_line=12, home_score=14), row(yard_line=35, home_score=17)
    assert result(spark, *kick) == (None, "field goal good")
    gain = row(down=2, distance=9, yard_line=36), row(down=3, distance=0, yard_line=44)
    assert result(spark, *gain, "pass") == (9, "9-yard completion")
    loss = row(down=1, distance=10), row(down=2, distance=12)
    assert result(spark, *loss, "run") == (-2, "2-yard loss")
    assert result(spark, row(down=2), row(down=2)) == (None, "no gain / incomplete / penalty")


def test_evidence(spark):
    def why(prev, cur, backed=False):
        return value(spark, R.evidence_reasons(prev, cur, F.lit(backed)))

    assert why(row(down=3), row(down=3), True) == []
    assert why(row(down=2), row(down=3)) == ["legal_down_progression"]
    assert why(row(down=2), row(), True) == ["validated_previous_play_banner"]
    assert why(row(special_state="kickoff", home_score=3), row(down=1, home_score=7)) == [
        "special_state", "score_change",
    ]

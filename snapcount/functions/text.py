"""Raw scoreboard and banner text to typed columns, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapcount import constants as C


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """Regex group, null when there is no match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def normalize_text(value: Column | str) -> Column:
    text = F.upper(F.coalesce(_col(value), F.lit("")))
    return F.trim(F.regexp_replace(text, "[^A-Z0-9]+", " "))


def compact_key(value: Column | str) -> Column:
    return F.regexp_replace(F.upper(_col(value)), "[^A-Z0-9]", "")


def parse_quarter(value: Column | str) -> Column:
    return _let(
        compact_key(value),
        lambda text: F.when(text.contains("ND"), 2)
        .when(text.contains("RD"), 3)
        .when(text.contains("TH"), 4)
        .when(text.contains("ST"), 1)
        .otherwise(_found(text, "[1-4]").try_cast("int")),
    )


def parse_clock(value: Column | str) -> Column:
    def first_valid(pattern: str, longest: int) -> Column:
        reads = F.regexp_extract_all(_col(value), F.lit(pattern), F.lit(1))
        split = F.transform(
            reads,
            lambda read: F.struct(
                F.split_part(read, F.lit(":"), F.lit(1)).try_cast("int").alias("m"),
                F.split_part(read, F.lit(":"), F.lit(2)).alias("s"),
            ),
        )
        valid = F.filter(
            split, lambda c: (c.m <= longest) & (c.s.try_cast("int") < 60)
        )
        best = F.get(valid, F.lit(0))
        return F.concat(best.m.cast("string"), F.lit(":"), best.s)

    return F.coalesce(
        first_valid(r"(\d{1,2}:\d{2})", 15), first_valid(r"(\d:\d{2})", 9)
    )


def parse_down_distance(value: Column | str) -> Column:
    """struct(down, distance); distance 0 stands for inches."""
    text = F.upper(_col(value))
    plain, spelled = r"([1-4]).*?&\s*(\d{1,2})", r"([1-4]).*?AND\s*(\d{1,2})"
    inches = r"([1-4]).*?(?:&|AND).*?IN(?:CH(?:ES)?)?"
    numbered = F.coalesce(_found(text, plain, 1), _found(text, spelled, 1))
    yards = F.when(
        _found(text, plain, 1).isNotNull(), _found(text, plain, 2)
    ).otherwise(_found(text, spelled, 2)).try_cast("int")
    down = F.coalesce(numbered, _found(text, inches, 1)).try_cast("int")
    distance = F.when(
        numbered.isNotNull(), F.when(yards.between(0, 40), yards)
    ).when(down.isNotNull(), F.lit(0))
    return F.struct(down.alias("down"), distance.alias("distance"))


def parse_special_state(value: Column | str) -> Column:
    return _let(
        normalize_text(value),
        lambda text: F.when(text.contains("KICKOFF"), "kickoff").when(
            text.rlike(r"\bPAT\b"), "extra_point"
        ),
    )


def format_down_distance(down: Column | str, distance: Column | str) -> Column:
    yards = F.when(_col(distance) == 0, "inches").otherwise(
        _col(distance).cast("string")
    )
    return F.concat(_col(down).cast("string"), F.lit(" & "), yards)


def parse_yard(value: Column | str) -> Column:
    numbers = F.regexp_extract_all(_col(value), F.lit(r"(\d{1,2})"), F.lit(1))
    last = F.get(numbers, F.size(numbers) - 1).try_cast("int")
    return F.when(last.between(1, 50), last)


def parse_int(value: Column | str) -> Column:
    return _found(_col(value), r"\d{1,3}").try_cast("int")


def parse_team(value: Column | str) -> Column:
    letters = F.regexp_replace(F.upper(_col(value)), "[^A-Z]", "")
    return F.when(F.length(letters) >= 2, F.substring(letters, 1, 3))


def clean_call(value: Column | str) -> Column:
    text = F.regexp_replace(F.upper(_col(value)), "^[^A-Z0-9]+", "")
    text = F.regexp_replace(text, "[^A-Z0-9]+$", "")
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def parse_personnel(value: Column | str) -> Column:
    text = normalize_text(value)
    pattern = r"(\d)\s*RB.*?(\d)\s*TE.*?(\d)\s*WR"
    return F.when(
        text.rlike(pattern),
        F.format_string(
            "%s RB, %s TE, %s WR",
            *(F.regexp_extract(text, pattern, group) for group in (1, 2, 3)),
        ),
    )


def _formation_word(word: Column) -> Column:
    runs = F.regexp_extract_all(word, F.lit("([A-Z]+|[0-9]+)"), F.lit(1))
    titled = F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")
    return F.when(word.isin(*C.UPPERCASE_FORMATION_WORDS), word).otherwise(titled)


def _joined_formation(words: Column) -> Column:
    head = F.get(words, F.lit(0))
    rest = F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")
    dashed = head.isin(*C.DASHED_FAMILIES) & (F.size(words) > 1)
    return F.when(dashed, F.concat(head, F.lit(" - "), rest)).otherwise(
        F.array_join(words, " ")
    )


def canonical_formation(value: Column | str) -> Column:
    fixed = normalize_text(value)
    for wrong, right in C.FORMATION_FIXES:
        fixed = F.replace(fixed, F.lit(wrong), F.lit(right))
    family = r"\b(?:" + "|".join(C.FORMATION_FAMILIES) + r")\b.*"
    kept = _let(
        fixed,
        lambda text: F.coalesce(
            _found(text, family), F.when(text.contains("Y OFF CLOSE"), text)
        ),
    )
    return _let(F.transform(F.split(kept, " +"), _formation_word), _joined_formation)


def previous_play_heading(value: Column | str) -> Column:
    text = clean_call(value)
    return F.when(text.contains("PREVIOUS") & text.contains("PLAY"), text)


def clock_seconds(value: Column | str) -> Column:
    text = _col(value)
    pattern = r"^([0-5]?\d):([0-5]\d)$"
    minutes = _found(text, pattern, 1).try_cast("int")
    return minutes * 60 + _found(text, pattern, 2).try_cast("int")


def seconds_clock(value: Column | str) -> Column:
    seconds = F.greatest(F.lit(0), F.least(F.lit(900), _col(value).cast("int")))
    text = F.format_string("%d:%02d", (seconds / 60).cast("int"), seconds % 60)
    return F.when(_col(value).isNotNull(), text)


def infer_play_type(call: Column | str) -> Column:
    def mentions(text: Column, words: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | text.contains(word)
        return found

    return _let(
        normalize_text(call),
        lambda text: F.when(text.contains("PAT"), "extra_point")
        .when(text.contains("KICK"), "kickoff")
        .when(mentions(text, C.RUN_WORDS), "run")
        .when(mentions(text, C.PASS_WORDS), "pass"),
    )


def call_quality(call: Column | str) -> Column:
    words = F.split(normalize_text(call), " ")
    return F.size(F.filter(words, lambda word: word.isin(*C.QUALITY_TOKENS)))


# Links ----------------------------------------------------------------------


def _authority(value: Column) -> Column:
    return F.regexp_extract(value, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def is_url(value: Column | str) -> Column:
    return F.coalesce(_col(value).rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def is_stream_url(value: Column | str, site: str = "twitch.tv") -> Column:
    host = F.lower(_authority(_col(value)))
    host = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", "")
    return F.coalesce(
        (host == site) | host.endswith(f".{site}"), F.lit(False)
    )


def chat_channel_ids(value: Column | str) -> Column:
    """struct(guild_id, channel_id) of a chat-channel link, null when invalid."""
    text = _col(value)
    path = F.regexp_extract(
        text, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1
    )
    parts = F.filter(F.split(path, "/"), lambda part: part != "")
    ids = F.transform(parts, lambda part: part.try_cast("bigint"))
    guild, channel = F.get(ids, F.lit(1)), F.get(ids, F.lit(2))
    valid = (
        _authority(text).isin("discord.com", "discordapp.com")
        & (F.size(parts) == 3)
        & (F.get(parts, F.lit(0)) == "channels")
        & guild.isNotNull()
        & channel.isNotNull()
    )
    return F.when(
        valid, F.struct(guild.alias("guild_id"), channel.alias("channel_id"))
    )

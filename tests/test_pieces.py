"""Large JSON files by byte ranges, against the whole files."""

from __future__ import annotations

import json
import random

import pytest

from snapcount.sources import pieces
from snapcount.sources.pieces import read_elements

TEXTS = ["", "a", "}", "{", '"', "\\", '\\"', '"states": [{', "]}, {[", "é}ü\n\t", "x" * 300, "},", "\\}"]
ELEMENT = "struct<a: string, b: struct<c: string, d: array<string>>, e: array<struct<f: string>>, g: int>"


def text(rnd: random.Random) -> str:
    return "".join(rnd.choice(TEXTS) for _ in range(rnd.randint(0, 3)))


def element(rnd: random.Random, g: int) -> dict:
    made = {"a": text(rnd), "b": {"c": text(rnd), "d": [text(rnd) for _ in range(rnd.randint(0, 2))]}, "e": [{"f": text(rnd)} for _ in range(rnd.randint(0, 3))], "g": g}
    return {k: made[k] for k in rnd.sample(sorted(made), len(made))}


def document(rnd: random.Random, size: int) -> dict:
    fields = {
        "version": rnd.randint(1, 9),
        "note": text(rnd),
        "other": [{"x": text(rnd)}, {"states_of": [{"y": 1}]}],
        "records": [[i, i / 2] for i in range(size)],
        "states": [element(rnd, g) for g in range(size)],
    }
    return {k: fields[k] for k in rnd.sample(sorted(fields), len(fields))}


@pytest.mark.parametrize("width", ["64", "700", "134217728"])
def test_ranges_give_the_rows_of_whole_files(spark, tmp_path, width):
    rnd = random.Random(int(width))
    documents = {}
    for i, size in enumerate([0, 1, 2, 7, 40]):
        documents[f"f{i}.json"] = made = document(rnd, size)
        written = json.dumps(made, indent=rnd.choice([None, 2]), ensure_ascii=bool(i % 2))
        (tmp_path / f"f{i}.json").write_text(written + "\n" * (i % 3))
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "cut.json").write_text('{"version": 5, "states": [{"g": 1}, {"g": 2}')
    (tmp_path / "bad.json").write_text("no json")
    (tmp_path / "bare.json").write_text('{"version": 3}')
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", width)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        headers, elements = read_elements(spark, str(tmp_path), "states", "version int, note string, records array<array<double>>", ELEMENT)
        found = {r["_file"].rsplit("/", 1)[1]: r["_header"] for r in headers.collect()}
        rows = elements.collect()
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    assert "empty.json" not in found and found["bare.json"].version == 3
    assert found["bad.json"] is None or found["bad.json"].version is None
    for name, made in documents.items():
        assert (found[name].version, found[name].note, found[name].records) == (made["version"], made["note"], made["records"])
        got = sorted((r["_pos"], r["_element"]) for r in rows if r["_file"].endswith("/" + name))
        assert [(p, e.asDict(recursive=True)) for p, e in got] == list(enumerate(made["states"]))
    assert not [r for r in rows if r["_file"].rsplit("/", 1)[1] not in documents]


def test_files_are_listed_and_read_by_tasks(spark, tmp_path):
    (tmp_path / "a b%.json").write_text('{"states": [{"g": 1}, {"g": 2}]}\n')
    (tmp_path / "_hidden.json").write_text('{"states": [{"g": 3}]}')
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "c.json").write_text('{"states": [{"g": 4}]}')
    rows = {}
    for path in (str(tmp_path), f"{tmp_path}/a*.json"):
        found = pieces._texts(spark, path)
        rows[path] = sorted((r._file.rsplit("/", 1)[1], r._text) for r in found.collect())
    assert not [f for f in pieces._texts(spark, str(tmp_path)).inputFiles() if f.endswith(".json")]
    assert rows[str(tmp_path)] == rows[f"{tmp_path}/a*.json"] and len(rows[str(tmp_path)]) == 4


def test_a_text_belongs_to_the_range_it_begins_in(tmp_path, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK_BYTES", 3)
    rnd = random.Random(2)
    for n in range(60):
        data = "".join(rnd.choice("ab}") for _ in range(rnd.randint(1, 30))).encode()
        (tmp_path / "x").write_bytes(data)
        size = rnd.randint(1, 9)
        with open(tmp_path / "x", "rb") as source:
            found = [t for b in range(0, len(data), size) for t in pieces.texts_of_range(source, b, min(b + size, len(data)))]
        *whole, rest = data.split(b"}")
        assert found == (whole + [rest] if rest else whole)

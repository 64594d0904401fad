"""Vector codes against a plain version, and on awkward rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapcount.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string"


def plain(rows: list[tuple], parts: int, entries: int, rounds: int, scale: int) -> tuple[dict, list]:
    """Codes and errors by comparing every part with every entry, in Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows]
    width = len(kept[0][1]) // parts
    first = [v for _, v in sorted(kept)][:entries]
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]

    def nearest(p: int, v: list[int]) -> tuple[int, int]:
        part = v[p * width : (p + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        moved = []
        for p in range(parts):
            groups: dict[int, list] = {}
            for _, v in kept:
                groups.setdefault(nearest(p, v)[1], []).append(v[p * width : (p + 1) * width])
            moved.append([
                [sum(x) // len(groups[e]) for x in zip(*groups[e], strict=True)] if e in groups else old
                for e, old in enumerate(books[p])
            ])
        books = moved
    found = {i: [nearest(p, v) for p in range(parts)] for i, v in kept}
    return {i: ("".join(f"{e:02x}" for _, e in x), sum(d for d, _ in x)) for i, x in found.items()}, books


@pytest.mark.parametrize("size", [1.0, 1e9])
def test_codes_against_all_entries(spark, size):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 0, 0.25, 1, rng.gauss(0, 1)]) * size for _ in range(12)], i % 3, None) for i in range(150)]
    rows += [(200 + i, rows[7][1], None, None) for i in range(40)]
    scale = 4096 if size == 1 else 1  # errors of larger whole numbers would not fit in a long
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    books = codes.fit(table, parts=4, entries=9, rounds=3, scale=scale)
    expected, entries = plain(rows, 4, 9, 3, scale)
    assert books.entries == entries
    found = {r.vec_id: (r.code, r.error) for r in codes.encode(table, books).collect()}
    assert found == expected


def test_candidates_hold_every_entry_within_the_radius():
    rng = np.random.default_rng(1)
    for width in (1, 3, 16):
        entries = rng.integers(-20, 20, (64, width))
        vectors = rng.integers(-25, 25, (300, width))
        slices = codes.Slices(entries)
        radius = slices.widest_radius(vectors)
        found = slices.candidates(vectors, radius)
        near = ((vectors[:, None, :] - entries) ** 2).sum(axis=2)
        inside = (np.abs(vectors[:, None, :] - entries) <= radius[:, None, None]).all(axis=2)
        assert ((found[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(bool) == inside).all()
        index, least = slices.nearest(vectors)
        assert (least == near.min(axis=1)).all() and (index == near.argmin(axis=1)).all()
        if width == 3:
            assert np.bitwise_count(slices.candidates(vectors, radius // 4 + 1)).mean() < 8
    with pytest.raises(ValueError):
        codes.Slices(np.zeros((65, 2), dtype=np.int64))


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i)] * 8, None if i % 2 else 1, "old") for i in range(5)]
    rows = [
        *good, (3, [3.0] * 8, 1, None), (None, [9.0] * 8, None, None), (10, None, 1, None), (11, [nan] + [0.0] * 7, 1, None),
        (12, [inf] + [0.0] * 7, 1, None), (13, [None] + [0.0] * 7, 1, None), (14, [], 1, None), (15, [1.0], 1, None),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    books = codes.fit(table)
    assert [len(part) for part in books.entries] == [7] * 8
    coded = codes.encode(table, books)
    assert coded.columns == ["vec_id", "embedding", "label", "code", "error"]
    found = coded.collect()
    assert sorted(r.vec_id for r in found if r.vec_id is not None) == [0, 1, 2, 3, 3, 4] and len(found) == 7
    assert all(r.error == 0 and r.code != "old" for r in found)
    none = spark.createDataFrame([], SCHEMA)
    assert codes.fit(none) is None and codes.encode(none, None).count() == 0
    assert codes.fit(spark.createDataFrame([(1, None, 1, None)], SCHEMA)) is None
    with pytest.raises(ValueError):
        codes.fit(spark.createDataFrame([(1, [1.0] * 9, 1, None)], SCHEMA))


def test_sums_over_labels_meet_every_row(spark, monkeypatch):
    rows = [(i, None if i % 5 == 0 else i % 4 if i < 300 else i, i) for i in range(400)]
    table = spark.createDataFrame(rows, "id long, label long, error long")
    expected: dict = {}
    for _, label, error in rows:
        expected[label] = expected.get(label, 0) + error
    for most in (100_000, 3):
        monkeypatch.setattr(codes, "BROADCAST_ROWS", most)
        found = codes.with_sum_over(table, "label", "error", "total")
        assert found.count() == 400
        assert all(r.total == expected[r.label] for r in found.select("label", F.col("total")).collect())

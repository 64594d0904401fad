"""The prefix trie against a plain version, with hot prefixes, long conversations and awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from snapcount.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def plain(rows: list[tuple]) -> list[tuple]:
    own: dict = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [t[3] for t in sorted(x)] for c, x in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members: dict = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children: dict = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        mine = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = mine + sum(saved[x] for x in below)
    ends: dict = {}
    for c in sorted(made):
        ends.setdefault(made[c], []).append(str(c))
    return sorted(
        (
            min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children.get(n, [])), leaves[n], saved[n],
            hashlib.sha256(",".join(ends.get(n, [])).encode()).hexdigest(),
        )
        for n, m in members.items()
    )


def conversations(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in [*range(-7, 60), 10**15, 10**15 + 5]:
        n = rng.choice([1, 2, 3, 8, 12])
        for t in range(n):
            rows.append((c, t, "user" if t % 2 == 0 else "bot", rng.choice(["hi", "hello ñ", "x" * t]), "d"))
    for c in range(100, 180):  # copies, and a frequent first turn
        rows += [(c, t, "user", f"same {t}", None) for t in range(10)]
    rows += [(200, t, "user", f"long {t % 50}", None) for t in range(300)] + [(201, t, "user", f"long {t % 50}", None) for t in range(290)]
    rows += [(300, None, None, None, None), (300, None, None, "", None), (300, 5, "a", "b", None), (300, 5, "a", "a", None)]
    rows += [(None, 1, "user", "lost", None), rows[3], rows[3], (305, 2, "", "", None), (310, 2, "only", "y" * 50_000, None)]
    rng.shuffle(rows)
    return rows


def found(spark, rows: list[tuple], **options) -> list[tuple]:
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in trie.nodes(table, **options).collect())


def test_nodes_against_a_plain_trie(spark):
    rows = conversations(1)
    assert found(spark, rows) == plain(rows)


def test_small_chunks_shards_and_pieces_change_nothing(spark, monkeypatch):
    for name, value in (("CHUNK", 16), ("CELL", 4), ("PIECE", 3), ("SHARD_ROWS", 100)):
        monkeypatch.setattr(trie, name, value)
    rows = conversations(2)
    assert found(spark, rows, limit=20) == plain(rows)
    monkeypatch.setattr(trie, "SPINE_ROWS", 30)
    assert found(spark, rows, limit=1) == plain(rows)


def test_awkward_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "a", "b", None)]) == []
    turnless = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    assert found(spark, [(turnless, 0, "a", "b", None)]) == plain([(turnless, 0, "a", "b", None)])
    assert len(plain([(turnless, 0, "a", "b", None)])) == 1


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(4)
    digests = rng.integers(0, 2**63, (5000, 2)).astype(np.uint64)
    table = trie.PerfectHash(digests)
    slots = table.slots(digests)
    assert sorted(slots) == list(range(5000))
    kept = np.empty_like(digests)
    kept[slots] = digests
    others = rng.integers(0, 2**63, (5000, 2)).astype(np.uint64)
    assert (table.slots(others) >= 0).any()
    assert (trie.verified_slots(table, kept, others) == -1).all()
    assert (trie.verified_slots(table, kept, digests) == slots).all()
    with pytest.raises(ValueError):
        trie.PerfectHash(np.concatenate([digests, digests[:1]]))

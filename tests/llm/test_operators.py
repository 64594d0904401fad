"""Each operator on awkward rows, and against a plain version."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snapcount.llm import decontam, html_text, licenses, likeness, packing, pii, quality, sharding, simhash, toxicity, winnow

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone meadow lantern copper whistle harbour violet engine paper candle winter".split()


def prose(seed: int, n: int = 60) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) * (rng.random() < 0.3) for _ in range(n)) + "."


def awkward() -> list[tuple]:
    """Nulls in any column, empty and long texts, copies, near copies, repeated rows."""
    copy = prose(1)
    texts = [copy, copy, copy + " end", prose(2), "", None, "   \n\t ", "x", prose(3, 9000), "ñ𝄞 é" * 40, prose(4), prose(4)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(3, prose(2), "en", "s0", 5), (None, prose(5), None, None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# -- 10 ---------------------------------------------------------------------------------


def test_simhash_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        words = prose(i // 4, 120).split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), None, None, None))
    rows += [(200 + i, t, None, None, None) for i, t in enumerate(["", None, " \n", "one two", "ONE two"])]
    found = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = {i: plain.simhash(t) for i, t, *_ in rows}
    assert {i: r.fp % 2**64 for i, r in found.items()} == prints
    assert {i: r.component_id for i, r in found.items()} == plain.components(prints)


def test_runs_of_any_size_have_the_reach_of_all_pairs():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = np.unique(
        np.concatenate([seeds ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(35)] + [seeds])
    )
    assert len(values) > simhash.LARGE_RUN
    expected = plain.components(dict(enumerate(int(v) for v in values)))
    whole = np.zeros(len(values), dtype=np.int64), np.full(len(values), len(values))
    assert list(simhash.compare_runs(values, *whole, 4)) == [expected[i] for i in range(len(values))]
    assert list(simhash.large_run(values, 4)) == [expected[i] for i in range(len(values))]


def test_simhash_keeps_one_of_each_group(spark, docs, none):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = plain.components({i: plain.simhash(t) for i, (_, t, *_) in enumerate(awkward())})
    assert kept.count() == len(set(groups.values()))
    assert {0, 3, 4} <= {r.doc_id for r in kept.collect()}
    assert simhash.keep_one(none).count() == 0
    clash = docs.withColumn("fp", F.lit("mine")).withColumn("component_id", F.lit(1))
    assert simhash.keep_one(clash).where("fp = 'mine'").count() == kept.count()
    assert simhash.near_duplicates(docs).count() == docs.count()


def test_radius_beyond_the_blocks_is_refused(docs):
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs, radius=5)


def test_near_copies_of_likeness_are_found_against_all_pairs(spark, docs, none):
    rng = random.Random(8)
    rows = []
    for i in range(240):
        words = prose(i // 6, 150).split()
        for _ in range(i % 6):
            words[rng.randrange(len(words))] = f"changed{i}"
        rows.append((i, " ".join(words), None, None, None))
    # Near copies of one text that are not alike with each other, in clusters, so that pairs around a hub decide.
    hub = prose(77, 160).split()
    for i in range(60):
        words = list(hub)
        for _ in range(2 + i % 4):
            words[rng.randrange(len(words))] = f"edit{i // 3}"
        rows.append((400 + i, " ".join(words[: 160 - i % 7]), None, None, None))
    # A chain in which the ends are not alike, and a key that most rows share.
    rows += [(300 + i, " ".join(prose(999, 400).split()[12 * i : 12 * i + 200]), None, None, None) for i in range(8)]
    table = spark.createDataFrame(rows, SCHEMA)
    sets = {r[0]: set(zip(*[r[1].split()[k:] for k in range(5)])) for r in rows}
    group = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in range(10):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    bits = {r[0]: plain.simhash(r[1]) for r in rows}
    assert sum((bits[a] ^ bits[b]).bit_count() > 4 for a, b in pairs) > len(pairs) // 2
    assert {r.doc_id for r in likeness.keep_one(table).collect()} == set(group.values())
    kept = likeness.keep_one(docs.withColumn("t", F.lit("own")))
    assert kept.columns == [*docs.columns, "t"]
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect() if r.doc_id is not None) == [
        (False, i) for i in (0, 3, 4, 7, 8, 9, 10)
    ]
    assert likeness.keep_one(none).count() == 0


def test_fingerprints_of_several_words_against_all_pairs():
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2, size=(40, 192), dtype=np.uint8)
    bits = rng.permutation(np.repeat(centres, 20, axis=0) ^ (rng.random((800, 192)) < 0.12))
    values = np.packbits(bits, axis=1).view(np.uint64)
    keys = np.sort(rng.integers(0, 9, 800))
    near = (bits[:, None] != bits[None]).sum(axis=2) <= 45
    near &= keys[:, None] == keys[None]
    expected = np.arange(800)
    for _ in range(12):
        expected = np.array([expected[row].min() for row in near])
    assert near.sum() > 1500 and 100 < len(set(expected)) < 700
    for large in (4, 60, 800):
        label = simhash.labels_of_runs(keys, values, 45, large)
        assert ((label[:, None] == label[None]) == (expected[:, None] == expected[None])).all()


def test_texts_of_a_key_are_compared_only_where_sizes_let_sets_be_alike(monkeypatch):
    rng = np.random.default_rng(9)
    n = (4 * 1.002 ** rng.integers(0, 3000, 4000)).astype(np.int64)
    k = np.sort(rng.integers(0, 2, 4000))
    n = np.concatenate([np.sort(n[k == 0]), np.sort(n[k == 1])])
    inside = (k[:, None] == k[None]) & (5 * np.minimum(n[:, None], n[None]) >= 4 * np.maximum(n[:, None], n[None]))
    assert likeness.alike_upto(k, n).tolist() == [int(np.flatnonzero(row).max()) + 1 for row in inside]
    # One fingerprint, so whatever is compared is linked; two sets that can't be alike are linked by others between them only.
    gap = np.where(n < 400, n, 100 * n)
    tiles, whole = [], simhash.near_tiles
    monkeypatch.setattr(simhash, "near_tiles", lambda *a: tiles.append(len(a[3])) or whole(*a))
    words = [pa.array(np.full(4000, 7))] * likeness.WORDS
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (k, gap, np.arange(4000))] + words, names=list("knt012"))
    found = pa.Table.from_batches(likeness.near_in_runs([batch], likeness.RADIUS))
    t, g = found.column("t").to_numpy(), found.column("g").to_numpy()
    assert len(t) == 4000 and len(set(g.tolist())) == 4 and ((gap[t] < 400) == (gap[g] < 400)).all()
    assert 0 < sum(tiles) < 2 * 32**2 / 4


def test_sets_of_shingles_are_read_once(spark, monkeypatch):
    hub = prose(77, 160).split()
    rows = [(i, " ".join([*hub[: 40 + 2 * i], f"edit{i}", *hub[42 + 2 * i : 155 - i % 7]]), None, None, None) for i in range(40)]
    passes, reads = [], likeness.add_columns
    monkeypatch.setattr(likeness, "add_columns", lambda *a: passes.append(a[1]) or reads(*a))
    assert 0 < likeness.keep_one(spark.createDataFrame(rows, SCHEMA)).count() < 40
    # Fingerprints, the hash of texts whose sets are wanted, these sets, and the hash of texts that are kept.
    assert len(passes) == 4


def test_pairs_of_likeness_meet_by_simhash(spark):
    rng = np.random.default_rng(6)
    keys, bits = likeness.key_shape(1000)
    first, second = [], []
    for n in rng.integers(6, 700, 300):
        whole = rng.integers(0, 1 << 64, size=n, dtype=np.uint64)
        part = n // 10  # of 5 shingles 4 are shared
        first.append(likeness.fingerprint(whole[part:], 8))
        second.append(likeness.fingerprint(whole[: n - part], 8))
    a, b = np.array(first), np.array(second)
    apart = np.bitwise_count(a ^ b)[:, : likeness.WORDS].sum(axis=1)
    assert apart.max() <= likeness.RADIUS and (np.bitwise_count(a ^ b)[:, 0] > 4).mean() > 0.5
    assert np.bitwise_count(a ^ b)[:, : likeness.MORE_WORDS].sum(axis=1).max() <= likeness.MORE_RADIUS
    assert (likeness.block_keys(a, keys, bits) == likeness.block_keys(b, keys, bits)).any(axis=1).all()
    assert np.bitwise_count(a[1:] ^ b[:-1])[:, : likeness.WORDS].sum(axis=1).min() > likeness.RADIUS

    rows = []
    for i in range(40):
        words = prose(i, 120).split()
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(words[8:])), (3 * i + 2, " ".join(words).upper())]
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    marked = likeness.signatures(table, 8)
    found = {}
    for r in likeness.meetings(marked, keys, bits).collect():
        found.setdefault(r.k, set()).add(r.t)
    hashes = [likeness.text_hash(t) for _, t in rows]
    signed = [h - (h >> 63 << 64) for h in hashes]
    assert {frozenset(m) for m in found.values()} == {frozenset(signed[3 * i : 3 * i + 2]) for i in range(40)}


def test_keys_grow_with_the_texts_and_keep_the_chance():
    lost = []
    for count in (0, 1, 10_000, 2_000_000, 50_000_000, 10**10):
        keys, bits = likeness.key_shape(count)
        assert bits >= likeness.ROWS and count / 2**bits <= likeness.RUN
        lost.append((1 - (1 - likeness.FLIP) ** bits) ** keys)
    assert max(lost) < 1 / 60_000


def test_runs_are_whole_over_batches():
    k = np.array([1, 1, 1, 1, 2, 2, 3, 4, 4, 4, 4, 4, 5])
    for step in (1, 2, 3, 5, 13):
        batches = [pa.RecordBatch.from_arrays([pa.array(k[i : i + step]), pa.array(np.arange(13)[i : i + step])], names=["k", "v"]) for i in range(0, 13, step)]
        parts = list(simhash.whole_runs([batches[0].slice(0, 0), *batches]))
        assert np.concatenate([v for _, v in parts]).tolist() == list(range(13))
        ends = [set(keys.tolist()) for keys, _ in parts]
        assert all(not a & b for i, a in enumerate(ends) for b in ends[:i])


def test_items_that_share_q_grams_with_a_text_are_looked_for_at_seeds_only():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(600)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(20)) for i in range(400)]
    index = decontam.build(items)
    document = text(300) + " " + items[7][1] + " " + text(300)
    hashed = decontam.grams(decontam.codes(decontam.plain(document)))
    at, entry = decontam.entries(hashed, np.arange(len(hashed)), index)
    known, slot = index.grams.slots(hashed)
    every = int((index.grams.begins[slot + 1] - index.grams.begins[slot]).sum())
    assert len(at) == len(entry) < every / 2
    # All q-grams of an item that stands there are among them.
    assert len(set(index.grams.of_place[entry][index.grams.of_item[entry] == 7])) == len(decontam.plain(items[7][1])) - decontam.Q + 1
    assert [(m["item_id"], m["edits"]) for m in decontam.matches([document], index)[0] if not m["edits"]] == [(7, 0)]


# -- 8 ----------------------------------------------------------------------------------


def graded(n: int = 120) -> tuple[list[str], np.ndarray]:
    good = np.array([float(i % 3 > 0) for i in range(n)])
    texts = []
    for i in range(n):
        lines = [prose(1000 * i + k, 12) for k in range(6)]
        if not good[i]:
            lines[1:] = [" ".join(w + "***" for w in line.split()) for line in lines[1:]]
        texts.append("\n".join(lines))
    return texts, good


def test_quality_of_held_out_texts():
    texts, good = graded()
    chain = quality.fit(texts[:80], good[:80], turns=60)
    found = quality.scores(chain, texts[80:])
    assert ((found >= 0.5) == (good[80:] == 1)).all()
    one_by_one = np.concatenate([quality.scores(chain, [t]) for t in texts[80:]])
    assert np.allclose(found, one_by_one)


def test_forward_backward_is_the_sum_over_all_labellings():
    rng = np.random.default_rng(0)
    lines, step = np.array([3, 1, 5]), rng.normal(size=(2, 2))
    odds = rng.normal(size=9)
    steps = quality.Steps(lines)
    found = quality.sigmoid(steps.forward(odds, step) + steps.backward(odds, step))
    at = 0
    for n in lines:
        total, bad = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            weight = np.exp(sum(odds[at + i] * y[i] for i in range(n)) + sum(step[a, b] for a, b in zip(y, y[1:])))
            total += weight
            bad += weight * np.array(y)
        assert np.allclose(found[at : at + n], bad / total)
        at += n


def test_quality_of_awkward_rows(spark, docs, none):
    texts, good = graded(60)
    chain = quality.fit(texts, good, turns=40)
    scored = quality.score(docs.withColumn("score", F.lit("old")), chain)
    assert scored.count() == docs.count() and scored.where("score between 0 and 1").count() == docs.count()
    assert quality.score(none, chain).count() == 0
    assert quality.score(docs, None).where("score = 0.5").count() == docs.count()
    assert quality.keep_good(docs, chain).columns == docs.columns
    labels = spark.createDataFrame([(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.fit_on(docs, labels) is None
    assert toxicity.fit_on(docs, labels) == 0.5


# -- 7 ----------------------------------------------------------------------------------


def test_passages_with_edits_are_found():
    rng = random.Random(2)
    items = [(i, prose(500 + i, 35)) for i in range(12)]
    index = decontam.build(items + [(99, items[0][1]), (None, prose(9)), (77, "tiny"), (78, None)])
    texts, expected = [], []
    for i, text in items:
        chars = list(decontam.plain(text))
        for _ in range(len(chars) // 20):
            chars[rng.randrange(len(chars))] = "#"
        texts.append(prose(i, 40) + " " + "".join(chars).upper() + "\n" + prose(i + 50, 40))
        expected.append([i])
    texts += [prose(900 + i, 300) for i in range(20)] + ["", None or ""]
    expected += [[]] * 22
    found = decontam.matches(texts, index)
    assert [[m["item_id"] for m in ms] for ms in found] == expected
    for text, ms in zip(texts, found, strict=True):
        for m in ms:
            segments = [s for s, item in zip(index.segments, index.items, strict=True) if item == m["item_id"]]
            best = min(plain.edit_distance_within("".join(map(chr, s)), decontam.plain(text)) for s in segments)
            assert best == m["edits"] <= decontam.edits_allowed(100)


def test_passages_across_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(decontam, "PIECE", 1000)
    item = prose(77, 30)
    index = decontam.build([(5, item)])
    for lead in range(120, 190, 7):
        assert decontam.matches([prose(3, lead) + " " + item + " " + prose(4, 400)], index)[0][0]["item_id"] == 5


def test_decontamination_of_awkward_rows(spark, docs, none, monkeypatch):
    bench = spark.createDataFrame([(1, prose(2)), (2, None), (3, ""), (None, prose(1)), (4, prose(3, 40))], "item_id long, text string")
    leaks = decontam.leaks(docs, bench)
    assert Counter((r.doc_id, r.item_id) for r in leaks.collect()) == Counter({(3, 1): 2, (8, 4): 1})
    clean = decontam.keep_clean(docs.withColumn("matches", F.lit(1)), bench)
    assert clean.columns == [*docs.columns, "matches"] and clean.count() == docs.count() - 3
    assert decontam.keep_clean(docs, bench.limit(0)).count() == docs.count()
    assert decontam.leaks(none, bench).count() == 0
    monkeypatch.setattr(decontam, "INDEX_CHARS", 200)
    assert sorted(decontam.leaks(docs, bench).collect()) == sorted(leaks.collect())


def test_any_stretch_of_an_item_is_found():
    item = decontam.plain(prose(71, 90))[:300]
    index = decontam.build([(5, item), (6, prose(72, 90))])
    for at in range(0, len(item) - 100 + 1, 3):
        quote = item[at : at + 100]
        edited = list(quote)
        for i in range(8):
            edited[6 + 12 * i] = "#"
        texts = [f"{prose(3, 40)} {q} {prose(4, 40)}" for q in (quote, "".join(edited), quote[:60] + "#" * 40)]
        found = [[(m["item_id"], m["edits"]) for m in ms] for ms in decontam.matches(texts, index)]
        assert found[0] == [(5, 0)] and [i for i, _ in found[1]] == [5] and found[1][0][1] <= 8 and not found[2], at


# -- 6 ----------------------------------------------------------------------------------


def test_personal_data_against_plain_patterns(spark):
    rng = random.Random(3)
    parts = (
        "a b9 @ . - _ + ( ) 1 23 456 0 255 300 x ñ 𝄞 @a.b 4111111111111111 1.2.3.4 [at] [dot] % +1(499)555-6503".split()
        + [" ", "\n", "4111 1111 1111 1111", "(499) 555-6503", "0.0.0.0"]
    )
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(25)))) for i in range(1500)]
    rows += [(2000, None), (2001, ""), (2002, "a." * 20000 + "@b" + ".c" * 20000 + " +1" + "2" * 40000 + "1." * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in pii.digest(pii.find(df, pii.fit(df))).collect()}
    for i, text in rows:
        spans = plain.pii(text)
        row = found[i]
        assert row.base_sha256 == plain.pii_digest(spans), text
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in spans) for k in plain.BASE]
        every = row.spans.split(",") if row.spans else []
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(every)
        order = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in every]
        assert order == sorted(order)


def test_redaction(spark, docs, none):
    rows = [(1, "écrire à ann@example.org ou +1 (499) 555-6503 !", None, None, 3), (2, "10.0.0.1, 4111 1111 1111 1111", None, None, 3)]
    models = dict.fromkeys(pii.KINDS)
    got = {r.doc_id: r for r in pii.redact(spark.createDataFrame(rows, SCHEMA), models).collect()}
    assert got[1].text == "écrire à [EMAIL] ou [PHONE] !" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "[IP], [CARD]"
    same = pii.redact(docs, pii.fit(docs))
    assert same.columns == docs.columns and same.count() == docs.count()
    assert Counter(r.text for r in same.collect()) == Counter(r[1] for r in awkward())
    assert pii.redact(none, models).count() == 0
    assert pii.fit(none) == models


def test_boosting_separates_and_sets_a_threshold():
    x = np.arange(16)
    y = ((x & 3) == 3).astype(int)
    model = pii.boost(x, y, np.ones(16))
    assert ((model.score(x) >= model.least) == (y == 1)).all()
    assert pii.boost(x, np.ones(16), np.ones(16)) is None


# -- 3 ----------------------------------------------------------------------------------


def test_bounds_have_the_least_padding():
    rng = random.Random(4)
    for trial in range(40):
        lengths = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 25))]
        found, counts = np.unique(lengths, return_counts=True)
        bounds = packing.best_bounds(found, counts, 1 + trial % 4)
        cost = sum(next(b for b in bounds if b >= n) - n for n in lengths)
        assert cost == plain.least_padding(lengths, 1 + trial % 4)
    assert packing.best_bounds(np.zeros(0, int), np.zeros(0, int), 3) == []


def test_batches_of_awkward_rows(docs, none):
    clash = docs.withColumn("batch", F.lit("old")).withColumn("bucket", F.lit("old"))
    rows = packing.pack(clash, buckets=3, budget=200).collect()
    assert len(rows) == docs.count()
    assert Counter(r.text for r in rows) == Counter(r[1] for r in awkward())
    batches: dict = {}
    for r in rows:
        assert r.n_tokens == len((r.text or "").split()) and 0 <= r.padding == r.bound - r.n_tokens
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for members in batches.values():
        assert len(members) == 1 or len(members) * members[0].bound <= 200
        assert sorted(r.slot for r in members) == list(range(len(members)))
    assert packing.pack(none).count() == 0
    assert sorted(map(str, packing.pack(docs).collect())) == sorted(map(str, packing.pack(docs).collect()))


# -- 9 ----------------------------------------------------------------------------------


def test_block_bounds_keep_the_nearest_exact():
    rng = random.Random(6)
    rows = [(i, prose(i, 30) + (" vile nasty" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    df = Counter(w for _, t, _ in rows for w in toxicity.counts(t))
    index = toxicity.build(rows, {w: n for w, n in df.items() if n >= 3}, len(rows))
    place = {int(d): i for i, d in enumerate(index.ids)}
    unit = {}
    for d, t, _ in rows:
        words, weight = index.vector(t)
        unit[place[d]] = dict(zip(words.tolist(), weight.tolist(), strict=True))
    for _ in range(60):
        words, weight = index.vector(prose(rng.randrange(1000, 2000), 25) + rng.choice(["", " vile"]))
        best, cosine = index.nearest(words, weight, 7)
        expected = plain.nearest(sorted(unit.items()), dict(zip(words.tolist(), weight.tolist(), strict=True)), 7)
        assert np.allclose(cosine, [c for c, _ in expected])
        assert len(set(best.tolist()) ^ {i for _, i in expected}) == 0 or np.isclose(cosine[-1], expected[-1][0])


def test_toxicity_of_held_out_and_awkward_rows(spark, docs, none):
    rows = [(i, prose(i, 30) + (" vile nasty rotten" if i % 4 == 0 else ""), None, None, None) for i in range(300)]
    table = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    index = toxicity.fit_on(table, labels)
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in toxicity.score(table, index).collect())
    scored = toxicity.score(docs.withColumn("evidence", F.lit(3)), index)
    assert scored.where("score between 0 and 1").count() == docs.count()
    assert toxicity.score(none, index).count() == 0


def test_copies_of_a_toxic_text_keep_their_terms(spark):
    rows = [(i, "vile nasty rotten scum" if i % 5 < 2 else prose(i, 30), None, None, None) for i in range(400)]
    table = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 5 < 2)) for i in range(300)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(table, toxicity.fit_on(table, labels)).collect()
    copies = [r for r in scored if r.doc_id % 5 < 2]
    assert len(copies) == 160 and all(r.evidence and r.evidence[0].cosine > 0.999 and r.score > 0.9 for r in copies)


def test_examples_without_a_marked_term_have_their_copies_as_neighbours():
    rows = [(i, prose(i, 30) + (" vile nasty rotten" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    rows.append((1000, "an unheard of slur zorgle", 1))
    index = toxicity.build(rows, dict.fromkeys(toxicity.vocabulary_of(rows), 1), len(rows))
    assert index.vocabulary.size == len({t for _, text, _ in rows for t in toxicity.counts(text)})
    found = list(index.judge([text for _, text, _ in rows]))
    for (i, text, _), (_, best, cosine) in zip(rows, found, strict=True):
        assert i in index.ids[best[cosine > 1 - 1e-9]], text


# -- 4 ----------------------------------------------------------------------------------


def test_winnowing_against_all_windows(monkeypatch):
    hashed = lambda g: int(winnow.rolling(np.array([ord(c) for c in g], dtype=np.uint32), len(g))[0])
    for text in ["", "a", "abcdefghijk", "aaaa" * 30, prose(1), prose(2, 300), "𝄞ñ" * 50]:
        expected = plain.winnow(text, hashed, winnow.GRAM, winnow.WINDOW)
        for piece in (500_000, 50):
            monkeypatch.setattr(winnow, "PIECE", piece)
            hashes, places = winnow.fingerprint(text)
            assert list(zip(hashes.tolist(), places.tolist(), strict=True)) == expected


def test_winnowing_of_awkward_rows(spark, docs, none):
    found = winnow.compared(docs).collect()
    assert len(found) == docs.count()
    order = sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    expected = Counter()
    for at, (doc_id, text, *_) in enumerate(order):
        text, other = text or "", order[(at + 1) % len(order)][1] or ""
        new = winnow.edited(text, other)
        a, b, c = (set(winnow.fingerprint(t)[0].tolist()) for t in (text, new, other))
        share = lambda p, q: len(p & q) / len(p | q) if p | q else 1.0
        expected[doc_id, len(text), winnow.written(winnow.fingerprint(text)[0]), round(share(a, b), 9), round(share(a, c), 9)] += 1
    assert expected == Counter(
        (r.doc_id, r.n_chars, r.fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found
    )
    assert winnow.compared(none).count() == 0
    assert winnow.compared(docs.limit(1)).count() == 1
    assert winnow.fingerprints(docs).count() == docs.count()
    # Ids beyond 2 ** 53 keep their neighbours, also beside a null.
    big = [(2**60 + i, prose(i), None, None, None) for i in range(40)] + [(None, prose(99), None, None, None)]
    far = {r.doc_id: r.fingerprint for r in winnow.compared(spark.createDataFrame(big, SCHEMA)).collect()}
    chained = winnow.compared(spark.createDataFrame(big, SCHEMA)).collect()
    assert len(far) == 41 and all(
        r.edited_sha256 == hashlib.sha256(winnow.edited(prose(r.doc_id - 2**60), prose(r.doc_id - 2**60 - 1)).encode()).hexdigest()
        for r in chained if r.doc_id is not None and r.doc_id > 2**60
    )


# -- 2 ----------------------------------------------------------------------------------


def test_shards_of_awkward_rows(docs, none):
    clash = docs.withColumn("shard", F.lit("old")).withColumn("position", F.lit("old")).withColumn("total", F.lit(1))
    for shards in (1, 4, 40):
        rows = sharding.assign(sharding.described(clash), shards).collect()
        assert len(rows) == docs.count() and {r.position for r in rows} == {"old"} and {r.total for r in rows} == {1}
        slots: dict = {}
        for r in rows:
            assert r.size == len((r.text or "").encode()) + 1 and 0 <= r.shard < shards
            slots.setdefault(r.shard, []).append(r.slot)
        counts = [len(slots.get(s, [])) for s in range(shards)]
        assert max(counts) - min(counts) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.assign(sharding.described(none)).count() == 0


def test_shards_match_the_mixture_and_are_written(spark, tmp_path):
    rows = [(i, f"t{i}", None, "hot" if i % 3 else f"s{i % 7}", 2) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mix = sharding.assign(sharding.described(docs), 16, cells=64).groupBy("source", "shard").count().collect()
    for source in {r.source for r in mix}:
        counts = [r["count"] for r in mix if r.source == source]
        assert len(counts) == 16 and max(counts) - min(counts) <= 2
    sharding.write(docs, str(tmp_path / "out"), 16)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3000


# -- 1 ----------------------------------------------------------------------------------


def test_licenses_of_awkward_rows(spark, docs, none):
    notice = dict((n, t) for n, _, t in licenses.TEMPLATES)
    mit = notice["mit-grant"]
    rows = [
        (1, prose(1) + "\n" + mit.upper() + "\n" + prose(2), None, None, None),
        (2, mit.replace("granted", "given"), None, None, None),
        (3, "Released under the MIT License.", None, None, None),
        (4, "released under a license", None, None, None),
        (5, prose(8, 4000) + " Licensed under CC BY-NC 4.0. " + prose(9, 4000), None, None, None),
        (None, notice["gpl-3.0-line"], None, None, None),
    ]
    table = spark.createDataFrame(rows, SCHEMA).unionByName(docs).withColumn("template", F.lit("old"))
    found = {(r.doc_id, r.template): r for r in licenses.scan(table).collect()}
    assert set(found) == {
        (1, "mit-grant"), (2, "mit-grant"), (3, "mit-line"), (5, "cc-by-nc-4.0-line"), (None, "gpl-3.0-line")
    }
    assert found[1, "mit-grant"].containment == 1.0 and 0.8 <= found[2, "mit-grant"].containment < 1
    assert licenses.scan(none).count() == 0
    assert licenses.scan(table, templates=[("a", "A", "too short")]).count() == 0


LGPL = """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES"""
THIRD = """3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""


def test_licenses_of_one_family_are_told_apart(spark):
    texts = {
        "LGPL-3.0": LGPL,
        "LGPL-2.1": LGPL.replace("version 3", "version 2.1"),
        "GPL-3.0": LGPL.replace("Lesser\n", "").replace("library", "program"),
        "GPL-2.0": LGPL.replace("Lesser\n", "").replace("library", "program").replace("version 3", "version 2"),
        "AGPL-3.0": LGPL.replace("Lesser", "Affero").replace("library", "program"),
        "BSD-2-Clause": BSD.format(""),
        "BSD-3-Clause": BSD.format(THIRD),
        "ISC": """Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby
            granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    }
    both = BSD.format("") + prose(3, 400) + BSD.format(THIRD)
    rows = [(i, prose(i) + "\n" + t + "\n" + prose(i + 50), None, None, None) for i, t in enumerate([*texts.values(), both])]
    found = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == set(enumerate(texts)) | {(len(texts), "BSD-2-Clause"), (len(texts), "BSD-3-Clause")}


def test_each_template_is_found_as_itself_alone(spark):
    rows = [(i, t, None, None, None) for i, (_, _, t) in enumerate(licenses.TEMPLATES)]
    found = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {(i, license_id) for i, (_, license_id, _) in enumerate(licenses.TEMPLATES)}


def test_every_template_shingle_has_an_anchor():
    runs = set()
    for _, _, text in licenses.TEMPLATES:
        words = licenses.words_of(text)
        runs |= {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    chosen = licenses.anchors(runs)
    assert all(any(a in w for a in chosen for w in run) for run in runs)


# -- 5 ----------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head>
<body class="has-sidebar"><nav><ul><li><a href="/x">no</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">no no no no</div><div class="post post-{i}"><h1>Title {i} &amp; more</h1><p>First  <b>bold&nbsp;text<br>here
<p>Second &lt;para&gt; {filler}</p><div class="share-buttons">no</div><form><p>no</p></form>
<ul><li>Item</li></ul></div><div id="comments"><p>no {filler}{filler}</p></div><footer>&copy; no</footer></body></html>"""


def page_text(i: int, filler: str) -> str:
    return f"Title {i} & more\nFirst bold text here\nSecond <para> {filler}\nItem"


def test_pages_by_host_paths(spark):
    rows = [(i, f"http://Host.example:80/{i}?q", PAGE.format(i=i, filler=prose(i, 30))) for i in range(6)]
    # Alone, this page would take its long notes; its host's path tells otherwise.
    odd = PAGE.format(i=7, filler="short").replace("<footer>", f"<section class='notes'><p>{prose(3, 80)}</p></section><footer>")
    rows += [(7, "http://host.example/7", odd), (8, None, None), (9, "", ""), (9, "", ""), (10, "nohost", "just text &eacute;")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("old"))
    found = [(r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect()]
    expected = [(i, page_text(i, prose(i, 30))) for i in range(6)]
    expected += [(7, page_text(7, "short")), (8, ""), (9, ""), (9, ""), (10, "just text é")]
    assert Counter(found) == Counter((i, t, len(t)) for i, t in expected)
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("broken", ["<", "<p", "<div class='x", "<!--", "<script>", "</div></p></article>", "<a <b>", "&#xFFFFFFF;", "<p>\0"])
def test_broken_pages_are_read(broken):
    assert "kept" in html_text.main_text(f"<div><p>kept text</p>{broken}", None)


def test_all_of_an_article_is_kept(spark):
    menu = "<div class='box'>" + "".join(f"<a href='/{k}'>Section number {k}</a>" for k in range(12)) + "</div>"
    inner = {
        "wrapped": "<div class=content><h1>Head {i}</h1><div class=body><p>{t}</p></div></div>",
        "deep": "<article><h1>Head {i}</h1><div class=a><div class=b><p>{t}</p></div></div><p>Last {i}</p></article>",
        "list": "<div class=content><h1>Head {i}</h1><p>Lead {i}</p><ul><li>{t}</li></ul></div>",
        "quote": "<div class=content><h1>Head {i}</h1><blockquote><p>{t}</p></blockquote><p>Last {i}</p></div>",
    }
    rows = [
        (100 * k + i, f"http://{name}.example/{i}", f"<body>{menu}{form.format(i=i, t=prose(i, 60))}</body>")
        for k, (name, form) in enumerate(inner.items())
        for i in range(4)
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_text.extract(pages).collect():
        i = r.page_id % 100
        assert f"Head {i}" in r.text and prose(i, 60) in r.text and "Section number" not in r.text, r
        assert (f"Last {i}" in r.text) == (r.page_id // 100 in (1, 3)) and (f"Lead {i}" in r.text) == (r.page_id // 100 == 2)
        assert html_text.main_text(dict((p, h) for p, _, h in rows)[r.page_id], None) == r.text


def test_slug_ids_do_not_make_boilerplate():
    page = """<article><p>One.</p><h2 id="related-work">Related work</h2><section id="social-effects"><p>Two.</p></section>
    <p class="share">gone</p><section class="related-posts"><p>gone</p></section><div id="comments-area">gone</div></article>"""
    assert html_text.main_text(page, None) == "One.\nRelated work\nTwo."

"""SimHash near-duplicates by bit-sliced comparison.

Texts become 64-bit fingerprints. Distinct fingerprints within ``radius`` bits of each
other are linked; a group is what links reach.

* Candidates: the 64 bits are cut into six blocks. Two fingerprints at most four bits apart
  agree in at least two whole blocks, so each of the 15 pairs of blocks is a key, and the pair
  meets under one of them. This loses nothing for any radius up to four.
* Comparison: fingerprints that share a key stand in one run of rows. Their bits are stored by
  plane (one 64-bit word holds one bit of 64 rows). A row meets 64 others at once: one XOR a
  plane, and the distances are held in carry-save counters, bit by bit. After every eight
  planes, words of which every lane is beyond the radius are given up.
* Large runs: a dense group, if one of eight rows is near a sixteenth of all, is first taken out by a search from that row, in which found rows are
  not compared again; what remains is compared in blocks. A run emits one link a row
  (a forest with the same reach), never all pairs.
* Groups: the links are turned into stars by alternating large and small stars, each round
  written to the shared folder.

Defined results: a null or blank text has fingerprint zero, and such texts are one group;
equal texts have equal fingerprints; repeated rows each get a row; an empty table gives an
empty table; a null ``doc_id`` counts only where its whole group has none (null
``component_id``). Columns other than the id and the text are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapcount.llm.common import add_columns, texts
from snapcount.session import cut, ship_package

SEED = 42
BLOCKS = (11, 11, 11, 11, 10, 10)
SHARED = 2
# Rows with one key from which on a dense group is taken out by search first.
LARGE_RUN = 512
# (row, word) pairs that are compared at once, or links that are joined; bounds the memory of a task.
PAIRS_AT_ONCE = 1 << 15
# Tiles of 64 rows and a word that are compared at once; few, so that their counters stay in a core's cache.
TILES_AT_ONCE = 256


def fingerprint(text: str, width: int = 4) -> int:
    """Majority of each bit over the XXH64 of all word shingles, as an unsigned number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = list(accumulate((len(w) + 1 for w in words)))
    begins = [0, *ends[: len(words) - width]]
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, dtype=np.int64)
    step = 1 << 15
    count = len(begins)
    for at in range(0, count, step):
        hashes = b"".join(
            [digest(whole[s : e - 1], SEED) for s, e in zip(begins[at : at + step], ends[at + width - 1 :])]
        )
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4, out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long; no shuffle."""

    def compute(batch: pa.RecordBatch) -> list:
        found = np.array([fingerprint(t, width) for t in texts(batch, text)], dtype=np.uint64)
        return [pa.array(found.view(np.int64))]

    return add_columns(docs, [(out, T.LongType())], compute)


# -- comparison of runs ------------------------------------------------------------------


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: word w of plane k holds bit k of rows 64 w to 64 w + 63. A row is one number, or several side by side."""
    wide = values[:, None] if values.ndim == 1 else values
    padded = np.zeros((-(-len(wide) // 64) * 64, wide.shape[1]), dtype="<u8")
    padded[: len(wide)] = wide
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return packed.view("<u8")


def near_lanes(sliced: np.ndarray, queries: np.ndarray, words: np.ndarray, lanes: np.ndarray, radius: int):
    """For pairs of a query and a word: which of the word's ``lanes`` are within ``radius``.

    Returns the indices of the pairs that have any, and their lanes.
    """
    bits = radius.bit_length()
    alive = np.flatnonzero(lanes)
    q, w, m = np.ascontiguousarray(np.atleast_2d(queries[alive].T)), words[alive], lanes[alive]
    counters = [np.zeros(len(alive), dtype=np.uint64) for _ in range(bits)]
    over = np.zeros(len(alive), dtype=np.uint64)
    one = np.uint64(1)
    for k in range(len(sliced)):
        carry = sliced[k][w] ^ (np.uint64(0) - ((q[k >> 6] >> np.uint64(k & 63)) & one))
        for c in counters:
            carried = c & carry
            c ^= carry
            carry = carried
        over |= carry
        if k % 8 == 7 and k >= radius:
            beyond, equal = over.copy(), ~over
            for place in range(bits - 1, -1, -1):
                if radius >> place & 1:
                    equal &= counters[place]
                else:
                    beyond |= equal & counters[place]
                    equal &= ~counters[place]
            m = m & ~beyond
            live = np.flatnonzero(m)
            if len(live) < len(m):
                alive, q, w, m, over = alive[live], q[:, live], w[live], m[live], over[live]
                counters = [c[live] for c in counters]
            if not len(alive):
                break
    return alive, m


def lanes_between(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Masks of the lanes of ``words`` whose rows are in ``first`` to ``last`` (exclusive)."""
    low = np.clip(first - 64 * words, 0, 64).astype(np.uint64)
    high = np.clip(last - 64 * words, 0, 64).astype(np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    below = lambda n: np.where(n >= 64, full, (np.uint64(1) << np.minimum(n, np.uint64(63))) - np.uint64(1))
    return below(high) & ~below(low)


def lane_rows(words: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the pair, row) of every lane that is set."""
    bits = np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    pair, lane = np.nonzero(bits)
    return pair, words[pair] * 64 + lane


def forest(size: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest row that each row reaches over the links ``a``-``b``."""
    label = np.arange(size) if label is None else label
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            break
    return label


def added(total: np.ndarray, one: np.ndarray, other: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Add two planes to the plane ``total``, lane by lane; the carry takes the place of ``one``."""
    np.bitwise_xor(total, one, out=held)
    np.bitwise_and(total, one, out=one)
    np.bitwise_xor(held, other, out=total)
    np.bitwise_and(held, other, out=held)
    return np.bitwise_or(one, held, out=one)


def near_tiles(sliced: np.ndarray, queries: np.ndarray, row: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int):
    """(row, word, lanes within ``radius``) of the pairs of a query row and a word that have any.

    Pairs come as tiles, (tile, 64 rows) with one ``word`` each. Eight planes at a time are added up by a tree
    of carry-save adders, in place; tiles become single pairs as soon as most pairs are beyond the radius.
    """
    bits = max(3, radius.bit_length())
    low = int(row.min())
    queries, near = np.ascontiguousarray(queries[low : int(row.max()) + 1].T), row - low
    counters = [np.zeros(row.shape, dtype=np.uint64) for _ in range(bits)]
    over = np.zeros(row.shape, dtype=np.uint64)
    spare = [np.empty(row.shape, dtype=np.uint64) for _ in range(5)]
    one = np.uint64(1)
    # Few pairs of random rows are within the radius once half of the planes, less some deviations, are beyond it.
    check = 2 * radius + 3 * math.isqrt(2 * radius)

    def differing(k: int, out: np.ndarray) -> np.ndarray:
        mask = np.uint64(0) - ((queries[k >> 6] >> np.uint64(k & 63)) & one)
        if near.ndim == 2:
            np.take(mask.reshape(-1, 64), near[:, 0] >> 6, axis=0, out=out, mode="clip")
            return np.bitwise_xor(out, sliced[k][word][:, None], out=out)
        np.take(mask, near, out=out, mode="clip")
        return np.bitwise_xor(out, sliced[k][word], out=out)

    for k in range(0, len(sliced), 8):
        a, b, c, d, held = spare
        for half, fours in ((k, c), (k + 4, d)):
            # The carry of the first pair waits in ``fours``, where that of both is put.
            added(counters[0], differing(half, fours), differing(half + 1, b), held)
            added(counters[0], differing(half + 2, a), differing(half + 3, b), held)
            added(counters[1], fours, a, held)
        carry = added(counters[2], c, d, held)
        for counter in counters[3:]:
            np.bitwise_and(counter, carry, out=a)
            np.bitwise_xor(counter, carry, out=counter)
            a, carry = carry, a
        over |= carry
        if k + 8 < min(check, len(sliced)):
            continue
        beyond, equal = over.copy(), ~over
        for place in range(bits - 1, -1, -1):
            if radius >> place & 1:
                equal &= counters[place]
            else:
                beyond |= equal & counters[place]
                equal &= ~counters[place]
        lanes = lanes & ~beyond
        live = np.flatnonzero(lanes)
        if len(live) < lanes.size // 2 or k + 8 >= len(sliced):
            tile = live >> 6 if near.ndim == 2 else live
            near, word, lanes = near.ravel()[live], word[tile], lanes.ravel()[live]
            counters, over = [x.ravel()[live] for x in counters], over.ravel()[live]
            spare = [np.empty(len(live), dtype=np.uint64) for _ in spare]
        if not len(live):
            break
    return near + low, word, lanes


def compare_runs(values: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int) -> np.ndarray:
    """Labels that join rows of a run (``first`` to ``last``) at most ``radius`` bits apart."""
    sliced = planes(values)
    size, blocks = len(values), sliced.shape[1]
    label = np.arange(size)
    queries = np.zeros((64 * blocks, len(sliced) >> 6), dtype=np.uint64)
    queries[:size] = values.reshape(size, -1)
    ends = np.zeros(64 * blocks, dtype=np.int64)
    ends[:size] = last
    ends[ends - np.arange(64 * blocks) <= 1] = 0
    # Each block of 64 rows meets the words from its own to the last one that any of its rows meets.
    block = np.arange(blocks)
    count = np.maximum((ends.reshape(-1, 64).max(axis=1) + 63 >> 6) - block, 0)
    done = np.concatenate([[0], np.cumsum(count)])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    links = 0
    for at in range(0, int(done[-1]), TILES_AT_ONCE):
        tile = np.arange(at, min(at + TILES_AT_ONCE, int(done[-1])))
        own = np.searchsorted(done, tile, "right") - 1
        word = own + tile - done[own]
        row = 64 * own[:, None] + np.arange(64)
        row, word, mask = near_tiles(sliced, queries, row, word, lanes_between(word[:, None], row + 1, ends[row]), radius)
        index, other = lane_rows(word, mask)
        found.append((row[index], other))
        links += len(other)
        if links >= PAIRS_AT_ONCE or at + TILES_AT_ONCE >= done[-1]:
            label = forest(size, *(np.concatenate(x) for x in zip(*found, strict=True)), label)
            found, links = [], 0
    return label


def reach(values: np.ndarray, seed: int, radius: int) -> np.ndarray:
    """Rows that ``seed`` reaches; rows that were found are not compared again."""
    found = np.zeros(len(values), dtype=bool)
    found[seed] = True
    frontier = np.array([seed])
    left = np.flatnonzero(~found)
    while len(frontier) and len(left):
        sliced = planes(values[left])
        width = sliced.shape[1]
        new = np.zeros(len(left), dtype=bool)
        step = max(1, PAIRS_AT_ONCE // width)
        words = np.arange(width)
        lanes = lanes_between(words, np.zeros(width, dtype=np.int64), np.full(width, len(left)))
        for at in range(0, len(frontier), step):
            some = frontier[at : at + step]
            word = np.tile(words, len(some))
            pair, mask = near_lanes(sliced, np.repeat(values[some], width, axis=0), word, np.tile(lanes, len(some)), radius)
            new[lane_rows(word[pair], mask)[1]] = True
            if new.all():
                break
        frontier = left[new]
        found[frontier] = True
        left = left[~new]
    return np.flatnonzero(found)


def dense_seed(values: np.ndarray, radius: int) -> int | None:
    """The row, of eight, that is near most others, if these are a sixteenth of all."""
    sliced, seeds = planes(values), len(values) * np.arange(8) // 8
    words = np.tile(np.arange(sliced.shape[1]), 8)
    seed = np.repeat(seeds, sliced.shape[1])
    pair, mask = near_lanes(sliced, values[seed], words, lanes_between(words, 0 * words, 0 * words + len(values)), radius)
    degree = np.zeros(len(values), dtype=np.int64)
    np.add.at(degree, seed[pair], np.bitwise_count(mask))
    best = int(degree.argmax())
    return best if degree[best] * 16 >= len(values) else None


def large_run(values: np.ndarray, radius: int, upto: np.ndarray | None = None) -> np.ndarray:
    """As ``compare_runs`` for one large run: dense groups go first."""
    label = np.arange(len(values))
    upto = np.full(len(values), len(values)) if upto is None else upto
    left = np.arange(len(values))
    while len(left) > LARGE_RUN and (seed := dense_seed(values[left], radius)) is not None:
        group = reach(values[left], seed, radius)
        label[left[group]] = left[group].min()
        left = np.delete(left, group)
    if len(left):
        rest = compare_runs(values[left], np.zeros(len(left), dtype=np.int64), np.searchsorted(left, upto[left]), radius)
        label[left] = left[rest]
    return label


def labels_of_runs(k: np.ndarray, values: np.ndarray, radius: int, large: int = LARGE_RUN, upto: np.ndarray | None = None) -> np.ndarray:
    """Labels that join rows of one ``k`` (sorted) that reach each other by steps of at most ``radius`` bits.

    A row need not be compared with the rows of its run from ``upto`` on; it ascends.
    """
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(k)]]))
    upto = np.repeat(starts + sizes, sizes) if upto is None else upto
    label = np.arange(len(k))
    big = sizes > large
    for s, n in zip(starts[big], sizes[big], strict=True):
        label[s : s + n] = s + large_run(values[s : s + n], radius, upto[s : s + n] - s)
    small = np.flatnonzero(np.repeat(~big & (sizes > 1), sizes))
    if len(small):
        size = sizes[~big & (sizes > 1)]
        begin = np.repeat(np.cumsum(size) - size, size)
        label[small] = small[compare_runs(values[small], begin, np.searchsorted(small, upto[small]), radius)]
    return label


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows that come sorted by the first; the last run waits for more rows."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        whole = int(np.searchsorted(columns[0], columns[0][-1]))
        if held and (whole or held[-1][0][-1] != columns[0][0]):
            yield [np.concatenate(c) for c in zip(*held, [c[:whole] for c in columns], strict=True)]
            held = []
        elif whole:
            yield [c[:whole] for c in columns]
        held.append([c[whole:] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def links_of_runs(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (k, fp) that come sorted by ``k``."""
    for k, v in whole_runs(batches):
        label = labels_of_runs(k, v.view(np.uint64), radius)
        at = np.flatnonzero(label != np.arange(len(k)))
        yield pa.RecordBatch.from_arrays([pa.array(v[at]), pa.array(v[label[at]])], names=["a", "b"])


def block_keys(fp: str, blocks: tuple[int, ...] = BLOCKS, shared: int = SHARED):
    """One key for each choice of ``shared`` blocks; its number is a part of the key."""
    parts, shift = [], 0
    for width in blocks:
        parts.append((F.shiftrightunsigned(F.col(fp), shift).bitwiseAND(F.lit((1 << width) - 1)), width))
        shift += width
    keys = []
    for number, chosen in enumerate(combinations(parts, shared)):
        key = F.lit(number).cast("long")
        for part, width in chosen:
            key = F.shiftleft(key, width).bitwiseOR(part)
        keys.append(key)
    return F.array(*keys)


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) between rows of ``distinct.fp`` with the reach of all pairs within ``radius``."""
    if radius > len(BLOCKS) - SHARED:
        raise ValueError(f"radius {radius} needs more blocks than {BLOCKS}")
    spark = distinct.sparkSession
    ship_package(spark)
    keyed = distinct.select(F.explode(block_keys("fp")).alias("k"), "fp")
    runs = keyed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k").sortWithinPartitions("k", "fp")
    return runs.mapInArrow(lambda batches: links_of_runs(batches, radius), "a long, b long").distinct()


def stars(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b): every linked node ``a`` with the smallest node ``b`` of its group (``a`` other than ``b``)."""
    spark = edges.sparkSession

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    now = state(e)
    for _ in range(rounds):
        if not now[0]:
            return e
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        e = cut(small.where("a <> b").distinct())
        before, now = now, state(e)
        if before == now:
            return e
    raise RuntimeError(f"groups not settled after {rounds} rounds on {spark.sparkContext.appName}")


def components(marked: DataFrame, radius: int = 4, doc_id: str = "doc_id") -> DataFrame:
    """(fp, component, component_id): group of every distinct fingerprint of ``marked``."""
    distinct = cut(marked.groupBy("fp").agg(F.min(doc_id).alias("first_id")))
    reached = stars(links(distinct.select("fp"), radius))
    grouped = distinct.join(reached.withColumnRenamed("a", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("b", "fp").alias("component")
    )
    least = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return grouped.join(least, "component").select("fp", "component", "component_id")


def near_duplicates(
    docs: DataFrame, radius: int = 4, width: int = 4, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = cut(fingerprints(read, "text", width).select("doc_id", "fp"))
    return marked.join(components(marked, radius), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id, first among equals.

    The texts are shuffled once, with the rows that stay decided on (id, fingerprint) alone.
    """
    marked = cut(fingerprints(docs.select("doc_id", "text"), "text", width).select("doc_id", "fp"))
    ids = marked.groupBy("fp").agg(F.min("doc_id").alias("d"))
    chosen = (
        components(marked, radius)
        .join(ids, "fp")
        .groupBy("component")
        .agg(F.min(F.struct(F.col("d").isNull().alias("no"), "d", "fp")).alias("one"))
        .select(F.col("one.fp").alias("__fp"), F.coalesce(F.col("one.d").cast("string"), F.lit("")).alias("__id"))
    )
    own = fingerprints(docs, "text", width, "__fp").withColumn("__id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    first = Window.partitionBy("__fp", "__id").orderBy("text")
    return (
        own.join(chosen, ["__fp", "__id"])
        .withColumn("__row", F.row_number().over(first))
        .where("__row = 1")
        .select(*docs.columns)
    )

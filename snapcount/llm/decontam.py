"""Benchmark passages in documents, by the q-gram lemma on diagonal bands.

Benchmark items are lower-cased with single spaces. A document contains an item if some part of it is
within e edits of a window of m characters of the item: any stretch of ``WINDOW`` characters, at any place, or the whole
item if it is shorter; e is ``RATE`` of m. By the q-gram lemma such a part shares at
least ``m + 1 - q (e + 1)`` q-grams with the window, all on diagonals (text position less item
position) that differ by at most e.

1. Density: text positions whose q-gram is none of the benchmark's, and stretches of
   m + e positions with fewer such q-grams than any window asks for, cannot be part of a region.
2. Seeds: e edits leave a stretch of ``SEED`` characters of a window unedited (of items too short for that, a q-gram).
   An item is looked for only near text positions where such a stretch of it stands, so a q-gram that many items
   hold is not paired with all of them.
3. Bands: the q-grams that are left are put, by item, in bands of 2 (e + 1) diagonals, each
   overlapping the next by half, so that the diagonals of one region lie in one band.
   Windows in which a band has fewer than the bound go.
4. Verification: windows that stand unedited in the text are runs on one diagonal; where an item has
   none, the edit distance of every window that is left, within the band, with free ends in the text.

The benchmark's index goes to every task and is bounded: benchmarks of more than
``INDEX_CHARS`` characters are cut into several indexes, and documents pass each. Texts are
read whole; long ones in pieces that overlap by more than a region.

Defined results: null and blank texts or items match nothing, as do items of fewer than q
characters; repeated documents each get their rows; repeated items are reported under the
smallest id; items without an id are left out; empty tables give empty tables. Other columns
are carried.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapcount.llm.common import add_columns, texts

Q = 8
WINDOW = 100
RATE = 0.08
INDEX_CHARS = 8_000_000
# Characters that are searched at once, and by how many pieces of a longer text overlap.
PIECE = 200_000
OVERLAP = 2 * WINDOW
MATCHES = T.ArrayType(
    T.StructType([T.StructField("item_id", T.LongType()), T.StructField("at", T.LongType()), T.StructField("edits", T.IntegerType())])
)
# Windows that are compared at once; bounds the memory of a task.
WINDOWS_AT_ONCE = 8192
# Bits of the filter in front of the index.
FILTER_BITS = 22
BREAK = 1
# Characters that e edits leave together in a window of ``WINDOW``, and of the cells of text around them; a cell is wider than a region.
SEED = 11
CELL = 128


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(code: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q-gram at each position (q a power of two); empty if there is none."""
    if len(code) < q:
        return np.zeros(0, dtype=np.uint32)
    hashed = (code + np.uint32(1)) * np.uint32(0x9E3779B1)
    factor, width = 0x85EBCA6B, 1
    while width < q:
        hashed = hashed[:-width] * np.uint32(factor) + hashed[width:]
        factor = factor * factor % 2**32
        width *= 2
    hashed ^= hashed >> np.uint32(15)
    return hashed * np.uint32(0x2C1B3C6D)


def edits_allowed(m: int) -> int:
    """Edits for a window of ``m`` characters; few enough that the lemma asks for a shared q-gram."""
    return max(0, min(int(RATE * m), m // Q - 1))


def joined(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (first ^ (last >> np.uint32(15))) * np.uint32(0x9E3779B1) + last


def seed_hashes(hashed: np.ndarray) -> np.ndarray:
    """Hash of the ``SEED`` characters at each position, from the q-grams they begin and end with."""
    return joined(hashed[: Q - SEED], hashed[SEED - Q :])


@dataclass
class Postings:
    """Where each value stands: item and place in it, by value, item and place."""

    values: np.ndarray
    begins: np.ndarray
    of_item: np.ndarray
    of_place: np.ndarray

    @classmethod
    def of(cls, per_item: list[np.ndarray], chosen: np.ndarray) -> Postings:
        """Of the ``chosen`` items."""
        items = np.flatnonzero(chosen)
        every = np.concatenate([per_item[0][:0], *[per_item[i] for i in items]])
        size = np.array([len(per_item[i]) for i in items], dtype=np.int64)
        order = np.argsort(every, kind="stable")
        values, begins = np.unique(every[order], return_index=True)
        place = np.arange(len(every)) - np.repeat(np.cumsum(size) - size, size)
        return cls(values, np.append(begins, len(every)), np.repeat(items, size)[order].astype(np.int32), place[order].astype(np.int32))

    def slots(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``values`` are known, their slots)."""
        if not len(self.values):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        slot = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        known = np.flatnonzero(self.values[slot] == values)
        return known, slot[known]


@dataclass
class Index:
    """Items of a benchmark and where each q-gram stands in them."""

    ids: np.ndarray
    texts: list[np.ndarray]
    window: np.ndarray
    least: np.ndarray
    edits: np.ndarray
    grams: Postings
    seeds: Postings
    short: Postings
    seen: np.ndarray
    shapes: list[tuple[int, int]]

    @cached_property
    def places(self) -> np.ndarray:
        """Slot and item of each entry of the q-grams, as one number; ascends."""
        return np.repeat(np.arange(len(self.grams.values)), np.diff(self.grams.begins)) * len(self.texts) + self.grams.of_item

    @property
    def segments(self) -> list[np.ndarray]:
        """All windows."""
        return [t[i : i + m] for t, m in zip(self.texts, self.window, strict=True) for i in range(len(t) - m + 1)]

    @property
    def items(self) -> np.ndarray:
        """The item of each window."""
        return np.repeat(self.ids, [len(t) - m + 1 for t, m in zip(self.texts, self.window, strict=True)])


def build(rows: list[tuple[int, str]]) -> Index | None:
    """Index of (item_id, text) rows; None if no item can match."""
    first: dict[str, int] = {}
    for item, text in sorted((i, plain(t or "")) for i, t in rows if i is not None):
        if len(text) >= Q:
            first.setdefault(text, item)
    if not first:
        return None
    wholes = [codes(text) for text in first]
    hashed = [grams(t) for t in wholes]
    everywhere = np.ones(len(wholes), dtype=bool)
    grams_ = Postings.of(hashed, everywhere)
    seen = np.zeros(1 << FILTER_BITS, dtype=bool)
    seen[grams_.values >> np.uint32(32 - FILTER_BITS)] = True
    window = np.array([min(len(t), WINDOW) for t in wholes])
    edits = np.array([edits_allowed(int(m)) for m in window])
    least = window + 1 - Q * (edits + 1)
    # For windows of like length: the widest region and the fewest q-grams it may share.
    shapes: dict[int, tuple[int, int]] = {}
    for m, e, n in zip(window.tolist(), edits.tolist(), least.tolist(), strict=True):
        width, few = shapes.get(m.bit_length(), (1, m))
        shapes[m.bit_length()] = max(width, m + e - Q + 1), min(few, n)
    # Edits leave this many characters, in one stretch more than there are edits.
    seeded = -(-(window - edits) // (edits + 1)) >= SEED
    return Index(
        np.array(list(first.values())), wholes, window, least, edits, grams_,
        Postings.of([seed_hashes(h) for h in hashed], seeded), Postings.of(hashed, ~seeded), seen, list(shapes.values()),
    )


def spans_of(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begins[i], begins[i] + 1, ... for counts[i] values each."""
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(begins, counts) + at


def dense(hit: np.ndarray, index: Index) -> np.ndarray:
    """Hits that lie in a stretch with as many hits as some window length asks for."""
    total = np.zeros(len(hit) + 1, dtype=np.int32)
    np.cumsum(hit, out=total[1:])
    change = np.zeros(len(hit) + 1, dtype=np.int32)
    for width, least in index.shapes:
        inside = total[width:] - total[:-width] if width <= len(hit) else total[:0]
        tail = total[-1] - total[len(inside) : -1]
        rich = np.flatnonzero(np.concatenate([inside[: len(hit)], tail]) >= least)
        # Ends past the last position all fall on the last cell, which is not read.
        change[rich] += 1
        change[np.minimum(rich + width, len(hit))] -= 1
    return np.flatnonzero(hit & (np.cumsum(change)[:-1] > 0)) if change.any() else np.zeros(0, dtype=np.int64)


def entries(hashed: np.ndarray, at: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(text position, entry in the postings) of the q-grams at ``at`` (ascending) of items that have a seed near them."""
    grams, items = index.grams, len(index.texts)
    known, slot = grams.slots(hashed[at])
    at = at[known]
    # Seeds begin where their first and last q-grams are such positions.
    ends = np.zeros(len(hashed) + SEED, dtype=bool)
    ends[at] = True
    cells = []
    begin = at[ends[at + SEED - Q]]
    for postings, place, values in (
        (index.seeds, begin, joined(hashed[begin], hashed[begin + SEED - Q])),
        (index.short, at, hashed[at]),
    ):
        found, found_slot = postings.slots(values)
        counts = postings.begins[found_slot + 1] - postings.begins[found_slot]
        cells.append(np.repeat(place[found] // CELL, counts) * items + postings.of_item[spans_of(postings.begins[found_slot], counts)])
    near = np.unique(np.concatenate(cells))
    near = np.unique(np.concatenate([near - items, near, near + items]))
    cell, item = near // items, near % items
    # Every such item with every q-gram of the cell; its entries stand together.
    low, high = np.searchsorted(at, cell * CELL), np.searchsorted(at, (cell + 1) * CELL)
    row = spans_of(low, high - low)
    wanted = slot[row] * items + np.repeat(item, high - low)
    first = np.searchsorted(index.places, wanted)
    counts = np.searchsorted(index.places, wanted, "right") - first
    return np.repeat(at[row], counts), spans_of(first, counts)


def unedited(code: np.ndarray, index: Index, item: np.ndarray, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, text position) of the first window of each run of q-grams that holds a whole window unedited."""
    order = np.lexsort((place, at - place, item))
    item, at, place = item[order], at[order], place[order]
    new = (np.diff(item) != 0) | (np.diff(at - place) != 0) | (np.diff(place) != 1)
    begin = np.flatnonzero(np.concatenate([[True], new]))
    length = np.diff(np.append(begin, len(item)))
    begin = begin[length + Q - 1 >= index.window[item[begin]]]
    same = [
        np.array_equal(code[p : p + m], index.texts[i][s : s + m])
        for i, p, s, m in zip(item[begin], at[begin], place[begin], index.window[item[begin]], strict=True)
    ]
    begin = begin[np.array(same, dtype=bool)]
    return item[begin], at[begin]


def windows(index: Index, key: np.ndarray, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of the windows that hold enough of the q-grams of one band; ``key`` and ``place`` ascend."""
    room = index.window[item] - Q
    last = np.arange(len(key)) + index.least[item] - 1
    end = np.minimum(last, len(key) - 1)
    row = np.flatnonzero((last < len(key)) & (key[end] == key) & (place[end] - place <= room))
    size = np.array([len(t) for t in index.texts])
    low = np.maximum(0, place[end[row]] - room[row])
    high = np.minimum(place[row], (size - index.window)[item[row]])
    # Both ends ascend within a band: what the window before has covered is left out.
    before = np.where(np.concatenate([[False], np.diff(key[row]) == 0])[: len(row)], np.concatenate([[0], high[:-1]])[: len(row)], -1)
    low = np.maximum(low, before + 1)
    count = np.maximum(0, high - low + 1)
    return np.repeat(row, count), spans_of(low, count)


def search(code: np.ndarray, index: Index, starts: list[int]) -> list[tuple[int, int, int]]:
    """(item, text position, edits) of verified regions; all that may have the fewest edits of an item in a piece.

    Pieces begin at ``starts``. The position is that of the end of the region less the window's length, so it
    is off by at most the edits.
    """
    hashed = grams(code)
    if not len(hashed):
        return []
    hit = index.seen[hashed >> np.uint32(32 - FILTER_BITS)]
    if not hit.any():
        return []
    at, entry = entries(hashed, dense(hit, index), index)
    if not len(at):
        return []
    item, place = (x[entry].astype(np.int64) for x in (index.grams.of_item, index.grams.of_place))
    whole, position = unedited(code, index, item, at, place)
    out = [(int(i), int(p), 0) for i, p in zip(whole, position, strict=True)]

    def piece(at: np.ndarray, item: np.ndarray) -> np.ndarray:
        return item * len(starts) + np.searchsorted(starts, at + index.window[item] // 2, "right") - 1

    shift = max(len(t) for t in index.texts) + 2 * WINDOW
    bands = len(code) + 2 * shift
    key = item * bands + (at - place + shift) // (index.edits[item] + 1)
    key, item, place = np.concatenate([key, key - 1]), np.concatenate([item, item]), np.concatenate([place, place])
    order = np.lexsort((place, key))
    key, item, place = key[order], item[order], place[order]
    # A q-gram of the item counts once in a band, on however many diagonals it stands.
    once = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(place) != 0)])
    key, item, place = key[once], item[once], place[once]
    row, start = windows(index, key, item, place)
    item, half = item[row], index.edits[item[row]] + 1
    low = key[row] % bands * half - shift - index.edits[item] + start
    left = ~np.isin(piece(low + index.edits[item] + half, item), piece(position, whole))
    item, start, low = item[left], start[left], low[left]
    for m in np.unique(index.window[item]):
        chosen = np.flatnonzero(index.window[item] == m)
        e = edits_allowed(int(m))
        for some in np.split(chosen, range(WINDOWS_AT_ONCE, len(chosen), WINDOWS_AT_ONCE)):
            parts = np.array([index.texts[i][s : s + m] for i, s in zip(item[some], start[some], strict=True)])
            distance, lane = banded(code, low[some], parts, 2 * (e + 1) + 2 * e, e)
            for i in np.flatnonzero(distance <= e):
                out.append((int(item[some[i]]), int(low[some[i]] + lane[i]), int(distance[i])))
    return out


def banded(code: np.ndarray, low: np.ndarray, parts: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edit distance of each window to the best text region on diagonals ``low`` to ``low + width``,
    and the diagonal, less ``low``, on which that region ends. Windows beyond ``most`` edits are given up, with one more."""
    lanes = np.arange(width, dtype=np.int16)
    padded = np.concatenate([np.zeros(width + WINDOW, np.uint32), code, np.zeros(width + 2 * WINDOW, np.uint32)])
    at = low[:, None] + lanes + width + WINDOW
    distance = np.zeros((len(low), width), dtype=np.int16)
    best, end = np.full(len(low), most + 1), np.zeros(len(low), dtype=np.int64)
    left = np.arange(len(low))
    for i in range(parts.shape[1]):
        here = distance + (padded[np.clip(at + i, 0, len(padded) - 1)] != parts[:, i : i + 1])
        np.minimum(here[:, :-1], distance[:, 1:] + np.int16(1), out=here[:, :-1])
        distance = np.minimum.accumulate(here - lanes, axis=1) + lanes
        if i % 8 == 7:
            # The least distance never falls.
            near = np.flatnonzero(distance.min(axis=1) <= most)
            if len(near) < len(left):
                left, distance, at, parts = left[near], distance[near], at[near], parts[near]
    best[left], end[left] = np.minimum(distance.min(axis=1), most + 1), distance.argmin(axis=1)
    return best, end


def matches(documents: list[str], index: Index | None) -> list[list[dict]]:
    """Matched items of each text: the best region of each (fewest edits, then the first)."""
    out: list[dict[int, tuple[int, int]]] = [{} for _ in documents]
    if index is None:
        return [[] for _ in documents]
    pieces: list[tuple[int, int, str]] = []

    def flush() -> None:
        if not pieces:
            return
        # Breaks between pieces are longer than an edit budget, so no region crosses them.
        gap = np.full(WINDOW, BREAK, dtype=np.uint32)
        parts, starts, length = [], [], 0
        for _, _, text in pieces:
            starts.append(length)
            parts += [codes(text), gap]
            length += len(text) + WINDOW
        for place, at, edits in search(np.concatenate(parts), index, starts):
            # The middle of a region lies in its piece, whatever the edits do to its ends.
            i = int(np.searchsorted(starts, at + index.window[place] // 2, "right")) - 1
            d, offset, _ = pieces[i]
            item = int(index.ids[place])
            best = (edits, offset + max(0, at - starts[i]))
            out[d][item] = min(out[d].get(item, best), best)
        pieces.clear()

    held = 0
    for d, text in enumerate(documents):
        text = plain(text)
        for at in range(0, max(1, len(text) - OVERLAP), PIECE):
            piece = text[at : at + PIECE + OVERLAP]
            pieces.append((d, at, piece))
            held += len(piece)
            if held >= PIECE:
                flush()
                held = 0
    flush()
    return [
        [{"item_id": item, "at": at, "edits": edits} for item, (edits, at) in sorted(found.items())] for found in out
    ]


def indexes(benchmark: DataFrame) -> list[Index]:
    """The benchmark's indexes, each over at most about ``INDEX_CHARS`` characters."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    slices = -(-size // INDEX_CHARS) or 1
    found = []
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k) if slices > 1 else items
        index = build([(r["item_id"], r["text"]) for r in part.collect()])
        if index:
            found.append(index)
    return found


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "matches") -> DataFrame:
    """``docs`` with the matched items (item_id, at: place in the plain text, edits); no shuffle."""
    found = docs.withColumn(out, F.array().cast(MATCHES))
    for index in indexes(benchmark):

        def compute(batch: pa.RecordBatch, index: Index = index) -> list:
            return [matches(texts(batch, text), index)]

        part = add_columns(found.withColumnRenamed(out, "__before"), [(out, MATCHES)], compute)
        found = part.withColumn(out, F.concat("__before", out)).drop("__before")
    return found


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, at, edits): a row for every document and item it contains."""
    found = find(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.at", "m.edits")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain a benchmark passage."""
    return find(docs, benchmark, out="__matches").where(F.size("__matches") == 0).select(*docs.columns)

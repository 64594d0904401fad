"""Vectors as codes: one codebook index for each of eight parts of a vector.

Components become integers (``floor(scale * x)``), so that every sum and distance is exact and no
order of rows changes a codebook. Codebooks are learnt by rounds of nearest entry and floored mean over all
vectors: tasks add up their own rows, Spark adds up the tasks, and only the codebooks themselves (parts x
entries x part width) reach the driver.

The nearest entry is found by slicing and intersecting: for each dimension the entries' coordinates are
sorted, and every prefix of that order has a uint64 mask of its entries. A first radius, a quarter of the distance to an
entry close by in the widest dimension, selects a range of each order; two prefix masks give the entries in
a range, and the masks of all dimensions are ANDed. An entry at most that far away lies in every
range, so candidates within the radius hold the nearest one and all its ties; where there is none, the radius grows.

Rows: null vectors and vectors with a null, NaN or infinite component are left out, as are vectors
of another length than most (of equally frequent lengths the longer counts). That length must be divisible by the number
of parts; vectors without components have distance 0 to all. First entries are the rows with the smallest ids; null ids come
last, equal ids in the order of their components. Repeated rows each count. With fewer rows than entries, the
codebooks are as long as there are rows. An empty table gives no rows. Components of any finite size are
exact (beyond 64-bit sums, Python integers are used), but an error above 2**63 - 1 cannot be a long and raises. Other columns stay; ones named ``code`` or ``error`` are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from snapcount.session import BROADCAST_ROWS, cut, ship_package

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
MOST_ENTRIES = 64  # bits of a mask
FIRST_RADIUS = 4  # the part of the widest radius that is tried first


def integers(column: pa.Array, length: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a batch, and their integer components."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(lengths == length)
    values = pc.list_flatten(column.take(pa.array(places)))
    floats = pc.cast(values, pa.float64()).to_numpy(zero_copy_only=False).reshape(len(places), length)
    finite = np.isfinite(floats).all(axis=1)
    places, floats = places[finite], floats[finite]
    limit = math.isqrt(2**60 // max(length, 1))
    if not floats.size or scale * np.abs(floats).max() < limit:
        return places, np.floor(floats * scale).astype(np.int64)
    exact = [[int(x) * scale if abs(x) >= 2**52 else math.floor(x * scale) for x in row] for row in floats.tolist()]
    return places, np.array(exact, dtype=object).reshape(floats.shape)


class Slices:
    """Sorted coordinates of one part's entries, with a mask of entries for every prefix."""

    def __init__(self, entries: np.ndarray):
        count, width = entries.shape
        if count > MOST_ENTRIES:
            raise ValueError(f"at most {MOST_ENTRIES} entries")
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.coordinates = np.ascontiguousarray(np.take_along_axis(entries, order, axis=0).T)
        bits = np.uint64(1) << order.T.astype(np.uint64)
        self.masks = np.zeros((width, count + 1), dtype=np.uint64)
        self.masks[:, 1:] = np.bitwise_or.accumulate(bits, axis=1)
        self.order = order.T
        self.widest = int(np.argmax(self.coordinates[:, -1] - self.coordinates[:, 0])) if width else 0

    def widest_radius(self, vectors: np.ndarray) -> np.ndarray:
        """A distance, rounded up, within which every vector has an entry."""
        line = self.coordinates[self.widest]
        near = np.minimum(np.searchsorted(line, vectors[:, self.widest]), len(line) - 1)
        return roots(((vectors - self.entries[self.order[self.widest, near]]) ** 2).sum(axis=1))

    def candidates(self, vectors: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries that are within the radius in every dimension."""
        found = np.full(len(vectors), ~np.uint64(0))
        for j, line in enumerate(self.coordinates):
            low = np.searchsorted(line, vectors[:, j] - radius, side="left")
            high = np.searchsorted(line, vectors[:, j] + radius, side="right")
            found &= self.masks[j, high] ^ self.masks[j, low]
        return found

    def best(self, vectors: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index (-1: none) and squared distance of the nearest candidate, of equally near ones the lowest."""
        index = np.full(len(vectors), -1, dtype=np.int64)
        least = np.zeros(len(vectors), dtype=np.result_type(vectors, self.entries))
        for e, entry in enumerate(self.entries):
            rows = np.flatnonzero(found >> np.uint64(e) & np.uint64(1))
            squared = ((vectors[rows] - entry) ** 2).sum(axis=1)
            closer = (index[rows] < 0) | (squared < least[rows])
            rows, squared = rows[closer], squared[closer]
            index[rows], least[rows] = e, squared
        return index, least

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry; of equally near ones the lowest.

        A vector is settled once its best candidate is no farther than the radius. Otherwise the radius becomes that
        candidate's distance, or, with no candidate, twice as wide.
        """
        if not vectors.shape[1]:
            return np.zeros(len(vectors), dtype=np.int64), np.zeros(len(vectors), dtype=np.int64)
        if self.entries.dtype == object and vectors.dtype != object:
            vectors = vectors.astype(object)
        index = np.full(len(vectors), -1, dtype=np.int64)
        least = np.zeros(len(vectors), dtype=np.result_type(vectors, self.entries))
        widest = self.widest_radius(vectors)
        radius, open_ = widest // FIRST_RADIUS + 1, np.arange(len(vectors))
        while len(open_):
            part, within = vectors[open_], radius[open_]
            found, squared = self.best(part, self.candidates(part, within))
            settled = (found >= 0) & (squared <= within**2)
            index[open_[settled]], least[open_[settled]] = found[settled], squared[settled]
            wider = np.where(found >= 0, roots(squared), np.minimum(2 * within, widest[open_]))
            radius[open_] = wider
            open_ = open_[~settled]
        return index, least


def roots(squared: np.ndarray) -> np.ndarray:
    """Square roots, rounded up or one more."""
    if squared.dtype == object:
        return np.array([math.isqrt(x) + 1 for x in squared], dtype=object)
    return np.sqrt(squared.astype(np.float64)).astype(np.int64) + 1


def narrow(codebooks: list[list[list[int]]]) -> list[np.ndarray]:
    """Codebooks as arrays, of 64-bit integers where squares of differences fit."""
    width = len(codebooks[0][0])
    limit = math.isqrt(2**60 // max(PARTS * width, 1))
    wide = any(abs(x) >= limit for part in codebooks for entry in part for x in entry)
    return [np.array(part, dtype=object if wide else np.int64).reshape(len(part), width) for part in codebooks]


class Codebooks:
    """Entries of every part: ``entries[part][entry][position]``, whole numbers."""

    def __init__(self, length: int, entries: list[list[list[int]]], scale: int = SCALE, vector: str = "embedding"):
        self.length, self.entries, self.scale, self.vector = length, entries, scale, vector

    def sha256(self) -> str:
        """Digest of all components by part, entry and position."""
        flat = ",".join(str(x) for part in self.entries for entry in part for x in entry)
        return hashlib.sha256(flat.encode()).hexdigest()

    def assigned(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """Places of the usable vectors, then of each part the vectors, indexes and distances."""
        column = batch.column(batch.schema.get_field_index(self.vector))
        places, vectors = integers(column, self.length, self.scale)
        yield places
        width = self.length // len(self.entries)
        for p, entries in enumerate(narrow(self.entries)):
            part = vectors[:, p * width : (p + 1) * width]
            yield part, *Slices(entries).nearest(part)


def usual_length(vectors: DataFrame, vector: str) -> int | None:
    """The most frequent length of a vector that is not null."""
    counts = vectors.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).count()
    found = counts.orderBy(F.desc("count"), F.desc("n")).head()
    return found and found["n"]


def first_entries(vectors: DataFrame, key: str, vector: str, length: int, entries: int, scale: int) -> list[list[int]]:
    """Components of the usable rows with the smallest ids."""
    exact = T.ArrayType(T.DecimalType(38, 0))
    schema = T.StructType([T.StructField(key, vectors.schema[key].dataType), T.StructField("components", T.ArrayType(T.StringType()))])
    arrow = to_arrow_schema(schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, found = integers(batch.column(1), length, scale)
            ids = batch.column(0).take(pa.array(places)).cast(arrow.field(0).type)
            texts = pa.array([[str(x) for x in row] for row in found.tolist()], type=arrow.field(1).type)
            yield pa.RecordBatch.from_arrays([ids, texts], schema=arrow)

    # Texts carry any size; where they fit, numbers put equal ids in order of their components.
    rows = vectors.select(key, vector).mapInArrow(whole, schema)
    numbers = F.transform("components", lambda x: x.try_cast("decimal(38,0)")).cast(exact)
    first = rows.orderBy(F.col(key).asc_nulls_last(), numbers, "components").limit(entries)
    return [[int(x) for x in row["components"]] for row in first.select("components").collect()]


def sums(vectors: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and componentwise sum of the parts assigned to each entry, over all rows."""
    schema = "part int, entry int, position int, n long, total decimal(38,0)"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    parts, entries, width = len(books.entries), len(books.entries[0]), books.length // len(books.entries)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, entries), dtype=np.int64)
        total = np.zeros((parts, entries, width), dtype=object)
        for batch in batches:
            _, *found = books.assigned(batch)
            for p, (part, index, _) in enumerate(found):
                count[p] += np.bincount(index, minlength=entries)
                for e in np.unique(index):
                    total[p, e] += part[index == e].sum(axis=0)
        used = [(p, e, i) for p, e in np.argwhere(count) for i in range(-1, width)]
        columns = [
            [p for p, _, _ in used],
            [e for _, e, _ in used],
            [i for _, _, i in used],
            [int(count[p, e]) if i < 0 else 0 for p, e, i in used],
            [0 if i < 0 else int(total[p, e, i]) for p, e, i in used],
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(map(int, c), type=f.type) if f.name != "total" else pa.array([str(x) for x in c]).cast(f.type) for c, f in zip(columns, arrow, strict=True)],
            schema=arrow,
        )

    added = (
        vectors.select(books.vector)
        .mapInArrow(each, schema)
        .groupBy("part", "entry", "position")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    )
    found: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for row in added.collect():  # parts x entries x (width + 1) rows at most
        n, totals = found.get((row.part, row.entry), (0, [0] * width))
        if row.position < 0:
            n = row.n
        else:
            totals[row.position] = int(row.total)
        found[row.part, row.entry] = n, totals
    return found


def fit(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> Codebooks | None:
    """Codebooks of all vectors; None where there is no usable vector."""
    ship_package(vectors.sparkSession)
    if not 1 <= entries <= MOST_ENTRIES:
        raise ValueError(f"1 to {MOST_ENTRIES} entries, not {entries}")
    length = usual_length(vectors, vector)
    if length is None:
        return None
    if length % parts:
        raise ValueError(f"vectors of {length} components have no {parts} equal parts")
    first = first_entries(vectors, key, vector, length, entries, scale)
    if not first:
        return None
    width = length // parts
    books = Codebooks(length, [[row[p * width : (p + 1) * width] for row in first] for p in range(parts)], scale, vector)
    for _ in range(rounds):
        found = sums(vectors, books)
        moved = [
            [
                [total // found[p, e][0] for total in found[p, e][1]] if (p, e) in found else entry
                for e, entry in enumerate(part)
            ]
            for p, part in enumerate(books.entries)
        ]
        books = Codebooks(length, moved, scale, vector)
    return books


def encode(vectors: DataFrame, books: Codebooks | None) -> DataFrame:
    """The usable rows with ``code``, two hex digits a part, and ``error``, the summed squared distances."""
    kept = [c for c in vectors.columns if c not in ("code", "error")]
    schema = T.StructType(
        [vectors.schema[c] for c in kept] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    )
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema)
    arrow = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, *found = books.assigned(batch)
            codes = np.column_stack([index for _, index, _ in found]).astype(np.uint8)
            errors = sum(least for _, _, least in found)
            digits = [bytes(row).hex() for row in codes]
            taken = batch.take(pa.array(places))
            columns = [taken.column(taken.schema.get_field_index(c)).cast(arrow.field(c).type) for c in kept]
            columns += [pa.array(digits, type=pa.string()), pa.array(errors.tolist(), type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return vectors.mapInArrow(each, schema)


def with_sum_over(coded: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Append the sum of ``value`` over rows with equal ``by``, nulls being equal to each other.

    The rows are written once. Sums of the most frequent keys, ``BROADCAST_ROWS`` at most, are broadcast; what other keys
    there are then has a small share of the rows each, and meets its rows by a shuffle. So no key,
    however frequent, brings its rows into one task.
    """
    rows = cut(coded)
    sums = cut(rows.groupBy(F.col(by).alias("__by")).agg(F.sum(value).alias(name), F.count(F.lit(1)).alias("__n")))
    frequent = sums.orderBy(F.desc("__n"), F.col("__by").asc_nulls_first()).limit(BROADCAST_ROWS)
    same = F.col(by).eqNullSafe(F.col("__by"))
    marked = rows.drop(name).join(F.broadcast(frequent.withColumn("__hit", F.lit(True))), same, "left")
    columns = [*[c for c in rows.columns if c != name], name]
    if sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return marked.select(*columns)
    hit = marked.filter(F.col("__hit")).select(*columns)
    rest = marked.filter(F.col("__hit").isNull()).drop("__by", "__n", "__hit", name).join(sums, same).select(*columns)
    return hit.unionByName(rest)

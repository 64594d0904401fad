"""Document fingerprints by winnowing.

Every run of ``GRAM`` code points gets a rolling hash; of every ``WINDOW`` hashes in a row the least is
chosen, the rightmost of equals. Two texts that share ``GRAM + WINDOW - 1`` code points in a row so
share a chosen hash, and no run shorter than ``GRAM`` is noticed. Places of chosen hashes are
kept, so that a match can be shown.

Likeness is the share of common chosen hashes among all of both (Jaccard).

Texts are read whole, in pieces of ``PIECE`` hashes that overlap by a window; memory beyond
the text itself does not grow with it.

Defined results: a null text counts as empty; an empty text has no hash, an empty fingerprint
and likeness 1 to another empty one, 0 to others; a text shorter than a gram has one hash of
the whole; equal texts have equal fingerprints, repeated rows each get a row; an empty table gives
an empty table. Columns other than the id and the text are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapcount.llm.common import text_of
from snapcount.session import ship_package

GRAM = 12
WINDOW = 24
PIECE = 500_000
BASE = 0x9E3779B1


def rolling(code: np.ndarray, gram: int) -> np.ndarray:
    """Mixed polynomial hash of every ``gram`` code points in a row (32 bits)."""
    powers: dict[int, np.ndarray] = {1: (code + np.uint32(1)) * np.uint32(0x85EBCA6B)}
    size = 1
    while 2 * size <= gram:
        half = powers[size]
        powers[2 * size] = half[:-size] * np.uint32(pow(BASE, size, 2**32)) + half[size:]
        size *= 2
    hashed, done = powers[size], size
    while done < gram:
        size //= 2
        if done + size <= gram:
            hashed = hashed[: len(hashed) - size] * np.uint32(pow(BASE, size, 2**32)) + powers[size][done:]
            done += size
    hashed = hashed ^ (hashed >> np.uint32(16))
    hashed *= np.uint32(0x2C1B3C6D)
    return hashed ^ (hashed >> np.uint32(15))


def least_of_windows(keys: np.ndarray, window: int) -> np.ndarray:
    """Least key of every ``window`` keys in a row."""
    window = min(window, len(keys))
    size, least = 1, keys
    while 2 * size <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = window - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def fingerprint(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(chosen hashes, their places) in the order of the text."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(code):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    gram = min(gram, len(code))
    grams = len(code) - gram + 1
    full = np.uint64(0xFFFFFFFF)
    chosen = []
    for at in range(0, max(1, grams - window + 1), PIECE):
        hashed = rolling(code[at : at + PIECE + gram + window - 2], gram)
        place = np.arange(at, at + len(hashed), dtype=np.uint64)
        keys = (hashed.astype(np.uint64) << np.uint64(32)) | (full - place)
        least = least_of_windows(keys, window)
        chosen.append(least[np.concatenate([[True], least[1:] != least[:-1]])])
    keys = np.concatenate(chosen)
    if len(chosen) > 1:
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return (keys >> np.uint64(32)).astype(np.uint32), (full - (keys & full)).astype(np.int64)


def written(hashes: np.ndarray) -> str:
    """Eight hex digits for each chosen hash."""
    return hashes.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Common hashes among all, both sorted and distinct."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def edited(text: str, other: str) -> str:
    """The last third of ``text`` replaced by as much of the beginning of ``other``."""
    third = len(text) // 3
    return text[: len(text) - third] + other[:third]


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, positions) of every document; no shuffle."""
    ship_package(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t) for t in batch.column(1).to_pylist()]
            prints = pa.array([written(h) for h, _ in found], type=pa.string())
            places = pa.array([p for _, p in found], type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), prints, places], names=["doc_id", "fingerprint", "positions"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of(text)).mapInArrow(each, f"doc_id {kind}, fingerprint string, positions array<bigint>")


def in_order(docs: DataFrame, cells: int | None = None) -> DataFrame:
    """(cell, tail, doc_id, text): cells of neighbouring ids in descending order, each followed by
    the first document after it (``tail`` true); the last cell by the first document of all.

    One shuffle of the texts. All that is collected is an approximate bound and the greatest id of each
    cell; the number of cells is a parameter.
    """
    spark = docs.sparkSession
    cells = cells or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [(i + 1) / cells for i in range(cells)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ends = rows.agg(F.percentile_approx("doc_id", shares, 10 * cells).alias("e")).first()["e"] or []
    ends = np.array(sorted(set(ends)), dtype=np.int64)

    @F.pandas_udf("int")
    def cell_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, ids.to_numpy()).astype(np.int32))

    # Null ids, which come last, count as the least; without nulls pandas keeps whole numbers whole.
    marked = rows.withColumn("cell", cell_of(F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))))
    tops = {r["cell"]: r["top"] for r in marked.groupBy("cell").agg(F.max("doc_id").alias("top")).collect()}
    used = sorted(tops)
    # The greatest id of a cell comes after the cell above; the greatest of all after the lowest cell.
    above = {c: used[(i + 1) % len(used)] for i, c in enumerate(used)}
    known = range(used[-1] + 1) if used else []
    top = F.get(F.array(*[F.lit(tops.get(c)).cast("long") for c in known]), F.col("cell"))
    up = F.get(F.array(*[F.lit(above.get(c)).cast("int") for c in known]), F.col("cell"))
    own = F.struct(F.col("cell"), F.lit(False).alias("tail"))
    after = F.struct(up.alias("cell"), F.lit(True).alias("tail"))
    places = F.array(own)
    if used:
        places = F.when(F.col("doc_id").eqNullSafe(top), F.array(own, after)).otherwise(places)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        marked.select(F.explode(places).alias("p"), "doc_id", "text")
        .select("p.cell", "p.tail", "doc_id", "text")
        .repartition(parts, "cell")
        .sortWithinPartitions("cell", "tail", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    )


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and its likeness to that and to the next."""
    ship_package(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (cell, id, text, hashes, distinct hashes, places)
        for batch in batches:
            rows: list[tuple] = []
            for cell, tail, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None and tail:
                    continue
                hashes, places = fingerprint(text)
                distinct = np.unique(hashes)
                if held is not None and held[0] == cell:
                    _, own_id, own, own_hashes, own_distinct, own_places = held
                    changed = edited(own, text)
                    new, _ = fingerprint(changed)
                    rows.append(
                        (
                            own_id,
                            len(own),
                            hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                            written(own_hashes),
                            written(new),
                            likeness(own_distinct, np.unique(new)),
                            likeness(own_distinct, distinct),
                            own_places,
                        )
                    )
                held = None if tail else (cell, doc_id, text, hashes, distinct, places)
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=k) for c, k in zip(columns, KINDS, strict=True)], names=NAMES
                )

    return in_order(docs).mapInArrow(each, SCHEMA)


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, positions array<bigint>"
)
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
KINDS = [
    pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int64())
]

"""Length buckets with the least padding, and batches under a token budget.

1. The lengths of all documents come down to a histogram by ``grid`` step: exact to
   ``EXACT``, then in steps of at most 1/512 of the length, so it has a few thousand rows
   however many or long the documents are.
2. Dynamic programming over the histogram chooses at most ``buckets`` upper bounds. The cost of a
   bucket is what its documents are padded by; the sum is the least that bounds on the
   grid can reach. (Costs obey the quadrangle inequality, but the table is small enough
   to take the minimum over all splits.)
3. Inside a bucket documents are put in a seeded order and cut into batches of
   ``floor(budget / bound)`` documents, one at least. A document longer than the budget
   is a batch of its own. Places in the order are counted by hash cell, so a bucket with most
   documents is many tasks.

Defined results: a null or blank text has no token and is packed with padding only; equal rows
get different places; a null id is ordered by the hash, which takes in the text; an empty table gives an empty table. Columns of the
input stay, but those named as a new column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcount.llm.common import positions, text_of
from snapcount.session import cut

BUCKETS = 12
BUDGET = 16_384
EXACT = 1024
SEED = 17
NEW = ("n_tokens", "bucket", "bound", "batch", "slot", "padding")


def words(text: str = "text") -> Column:
    """Tokens of a text where no other length is given: runs of characters that aren't white space."""
    trimmed = F.btrim(text_of(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")) - F.when(trimmed == "", 1).otherwise(0)


def grid(length: Column) -> Column:
    """Least grid length that is not below ``length``."""
    step = F.pow(F.lit(2.0), F.ceil(F.log2((length + 1).cast("double"))) - 10)
    return F.when(length <= EXACT, length.cast("long")).otherwise((F.ceil(length / step) * step).cast("long"))


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds with the least padding for a histogram (``lengths`` ascending); fewest if equal."""
    n = len(lengths)
    if not n:
        return []
    upto = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    cost = lengths.astype(np.float64) * upto[1:]  # of the first bucket, up to the last length
    weighted = np.concatenate([[0], np.cumsum(lengths * counts)]).astype(np.float64)
    best = cost - weighted[1:]
    cuts = [np.zeros(n, dtype=np.int64)]
    totals = [best[-1]]
    for _ in range(1, min(buckets, n)):
        new, cut = best.copy(), np.zeros(n, dtype=np.int64)
        for j in range(1, n):
            # The last bucket holds lengths i to j, those before it are packed at best[i - 1].
            one = best[:j] + lengths[j] * (upto[j + 1] - upto[1 : j + 1]) - (weighted[j + 1] - weighted[1 : j + 1])
            i = int(one.argmin())
            if one[i] < new[j]:
                new[j], cut[j] = one[i], i + 1
        best = new
        cuts.append(cut)
        totals.append(best[-1])
        if best[-1] == 0:
            break
    level = int(np.argmin(totals))
    bounds, j = [], n - 1
    while j >= 0:
        bounds.append(int(lengths[j]))
        i = cuts[level][j] if level else 0
        j = i - 1
        level = max(0, level - 1)
    return bounds[::-1]


def bounds_of(docs: DataFrame, length: Column, buckets: int = BUCKETS) -> list[int]:
    """Best bounds for all lengths of ``docs``."""
    rows = docs.groupBy(length.alias("n")).count().groupBy(grid(F.col("n")).alias("g")).agg(F.sum("count").alias("count")).collect()
    found = sorted((r["g"], r["count"]) for r in rows)
    lengths, counts = (np.array([r[i] for r in found], dtype=np.int64) for i in (0, 1))
    return best_bounds(lengths, counts, buckets)


def pack(
    docs: DataFrame,
    length: Column | None = None,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    seed: int = SEED,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``docs``, or its columns ``keep``, with n_tokens, bucket, bound, batch, slot and padding.

    ``length`` is any token count; words without it. ``batch`` counts from 0 in its bucket.
    ``keep`` has to hold doc_id.
    """
    length = words() if length is None else length
    seeded = F.xxhash64(F.lit(seed), F.col("doc_id"), text_of())
    kept = [c for c in docs.columns if c not in NEW and c != "__hash"]
    # Counting tokens is most of the work: it is done once, beside the columns the caller keeps.
    counted = cut(docs.select(*[c for c in kept if c in (keep or kept)], length.cast("long").alias("n_tokens"), seeded.alias("__hash")))
    bounds = bounds_of(counted, F.col("n_tokens"), buckets)
    top = F.lit(len(bounds) - 1).cast("int")
    upper = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(0).cast("long"))
    bucket = top
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[i], i).otherwise(bucket)
    placed = counted.withColumn("bucket", bucket.cast("int"))
    cell = F.shiftrightunsigned(F.col("__hash").bitwiseXOR(F.lit(-(2**63)).cast("long")), 52)
    order = [F.col("__hash"), F.col("doc_id")]
    ranked = positions(placed, order, cell, ["bucket"], position="__at", total="__all")
    bound = F.get(upper, F.col("bucket"))
    size = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(bound, F.lit(1))).cast("long"))
    return (
        ranked.withColumn("bound", bound)
        .withColumn("batch", F.floor(F.col("__at") / size).cast("long"))
        .withColumn("slot", (F.col("__at") % size).cast("long"))
        .withColumn("padding", F.col("bound") - F.col("n_tokens"))
        .drop("__hash", "__at", "__all")
    )

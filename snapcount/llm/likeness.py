"""Near-duplicates by exact word-shingle likeness (Jaccard) of at least 0.8.

Texts become the set of their ``WIDTH``-word shingles. Texts with one sequence of words are one text; two
texts are linked if the likeness of their sets is ``LIKE`` or more; a group is what links reach.

* Fingerprints: SimHash. Each bit is the majority of one hash bit over the distinct shingles. A bit differs between sets of likeness 0.8
  with a chance of 0.15, and of ``FLIP`` at most (four shingles of five). 64 bits at such distances can't be told from
  other texts, so a fingerprint has as many words as the keys need.
* Candidates: ``BANDS`` keys a text, each a block of ``ROWS`` bits of its own; texts of a key are compared bit-sliced (``simhash``)
  over ``WORDS`` words and are near within ``RADIUS`` bits, then those that reach each other again over ``MORE_WORDS`` words, within ``MORE_RADIUS`` bits. A pair of likeness 0.8 shares no key with a chance of at most
  ``(1 - (1 - FLIP) ** ROWS) ** BANDS``, one in 300,000, and lies beyond a radius with one in 75,000; a liker pair with less.
  Texts of a key come by the size of their sets, and are compared only where sizes let sets be alike.
  Above ``RUN`` texts a key, blocks are longer and there are more of them, with the same chance (``key_shape``).
* First round: texts of a key that reach each other within both radii share a meeting, and every text of a meeting
  is compared with its hub, the text that shares most meetings with others. So a large group of copies of one text makes a link a row.
* Second round: around hubs whose texts are not one group by then, only those pairs meet that what they share with the hub leaves
  possible (``around_hubs``). No pair that shares a meeting and could be alike is passed over, and its texts
  don't all meet each other.
* Verification: the exact likeness of the two sets of shingle hashes (XXH64).

Defined results: null and blank texts are one text; texts of fewer words than a shingle are one shingle; very long texts are
read whole, their fingerprint in steps of ``STEP`` shingles; repeated rows are one text; an empty table gives an empty table; columns
that are not ``doc_id`` and ``text`` are carried, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapcount.llm.common import BATCH_ROWS, add_columns, texts
from snapcount.llm.simhash import SEED, labels_of_runs, stars, whole_runs
from snapcount.session import cut, ship_package, spread

WIDTH = 5
BANDS = 60
ROWS = 8
# Sizes of sets that meet under one key, as steps of the logarithm.
SIZE_STEP = 0.02
# Chance, at worst, that a bit differs between sets of likeness 0.8.
FLIP = 3 / 16
# Words of a fingerprint that are compared, and the bits in which near ones may differ: in the texts of a key, and again in what is near there.
WORDS, RADIUS = 3, 60
MORE_WORDS, MORE_RADIUS = 8, 138
# Texts of one key, on average, from which on keys have more bits; and those of one key from which on dense groups are searched first.
RUN = 8192
LARGE_RUN = 4096
# Shingles that vote at once; their votes must fit in a byte.
STEP = 255
LONGS = T.ArrayType(T.LongType())


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words_of(text)), SEED)


def shingles(text: str) -> np.ndarray:
    """Distinct hashes of the word shingles; never empty."""
    words = words_of(text)
    whole = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    if len(words) <= WIDTH:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], dtype=np.uint64)
    begins = [0, *ends[: len(words) - WIDTH]]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(whole[s : e - 1], SEED) for s, e in zip(begins, ends[WIDTH - 1 :], strict=True)])
    # Sorting is much faster than numpy's search for distinct values.
    ordered = np.sort(np.frombuffer(hashes, dtype=">u8").astype(np.uint64))
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]


def key_shape(count: int) -> tuple[int, int]:
    """(keys, bits of a key) for ``count`` texts."""
    bits = max(ROWS, math.ceil(math.log2(max(count, 1) / RUN)))
    return math.ceil(BANDS * (1 - FLIP) ** (ROWS - bits)), bits


@lru_cache
def salts_of(words: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, size=words, dtype=np.uint64)


def fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of a set of shingle hashes: the majority of each bit, in ``words`` words of 64 bits."""
    salts = salts_of(words)
    votes = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(hashes), STEP):
        x = hashes[at : at + STEP, None] ^ salts
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1)
        # Eight votes are added at once, as the bytes of a word.
        votes += np.add.reduce(bits.view(np.uint64), axis=0).view(np.uint8)
    return np.packbits(2 * votes > len(hashes)).view(np.uint64)


def block_keys(prints: np.ndarray, keys: int, bits: int) -> np.ndarray:
    """Keys of each fingerprint, one a block of ``bits`` bits; the number of the block is a part of its key."""
    blocks = np.unpackbits(prints.view(np.uint8), axis=1)[:, : keys * bits].reshape(len(prints), keys, bits)
    return blocks @ (np.int64(1) << np.arange(bits)) + (np.arange(keys) << 40)


def signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def with_hash(docs: DataFrame) -> DataFrame:
    return add_columns(docs, [("__t", T.LongType())], lambda batch: [signed([text_hash(t) for t in texts(batch)])])


def id_text() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, t, n, print): hash of the text, number of its shingles and their fingerprint; no shuffle."""

    def compute(batch: pa.RecordBatch) -> list:
        documents = texts(batch)
        sets = [shingles(t) for t in documents]
        prints = [fingerprint(s, words).view(np.int64).tolist() for s in sets]
        return [signed([text_hash(t) for t in documents]), [len(s) for s in sets], prints]

    fields = [("t", T.LongType()), ("n", T.LongType()), ("print", LONGS)]
    return add_columns(docs.select("doc_id", "text"), fields, compute).select("doc_id", "t", "n", "print")


def with_keys(batches: Iterator[pa.RecordBatch], keys: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (k, n, t, words of the fingerprint) of each key of rows (t, n, print)."""
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH_ROWS):
            t, n, prints = whole.slice(at, BATCH_ROWS).columns
            prints = prints.flatten().to_numpy().reshape(len(t), -1)
            columns = [n.to_numpy(), t.to_numpy(), *prints[:, :WORDS].T]
            rows = [block_keys(prints, keys, bits).ravel(), *[np.repeat(c, keys) for c in columns]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["k", "n", "t", *[f"w{i}" for i in range(WORDS)]])


def alike_upto(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The end of the rows of its ``k`` that are small enough for each row; rows come sorted by ``k`` and ``n``."""
    run = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]])) << 40
    return np.searchsorted(run + n, run + 5 * n // 4, "right")


def near_in_runs(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (t, k, g) of texts that are within ``radius`` of another of their key; ``g`` is one of those that they reach."""
    for k, n, t, *words in whole_runs(batches):
        label = labels_of_runs(k, np.stack(words, axis=1).view(np.uint64), radius, LARGE_RUN, alike_upto(k, n))
        near = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (t[near], k[near], t[label[near]])], names=["t", "k", "g"])


def meetings(marked: DataFrame, keys: int, bits: int) -> DataFrame:
    """(t, k): texts that share a key and reach each other within the radii have one ``k``."""
    ship_package(marked.sparkSession)
    once = cut(marked.groupBy("t").agg(F.first("n").alias("n"), F.first("print").alias("print")))
    words = "".join(f", w{i} long" for i in range(WORDS))
    keyed = once.mapInArrow(lambda batches: with_keys(batches, keys, bits), f"k long, n long, t long{words}")

    def near(rows: DataFrame, radius: int) -> DataFrame:
        runs = spread(rows, "k").sortWithinPartitions("k", "n")
        return runs.mapInArrow(lambda batches: near_in_runs(batches, radius), "t long, k long, g long").select("t", F.xxhash64("k", "g").alias("k"))

    more = once.select("n", "t", *[F.col("print")[i].alias(f"w{i}") for i in range(MORE_WORDS)])
    again = near(keyed, RADIUS).join(more, "t").select("k", *more.columns)
    return cut(near(again, MORE_RADIUS))


def pair(t: str, other: str) -> list[Column]:
    return [F.least(t, other).alias("a"), F.greatest(t, other).alias("b")]


def alike_in_length(n: str, other: str) -> Column:
    """Whether sets of these sizes can have a likeness of 0.8."""
    return 5 * F.least(n, other) >= 4 * F.greatest(n, other)


def alike() -> Column:
    """Whether two sets of ``n`` and ``on`` shingles that share ``shared`` have a likeness of 0.8."""
    return 9 * F.col("shared") >= 4 * (F.col("n") + F.col("on"))


def sets_of(docs: DataFrame, ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(t, s): the shingles of every text of ``pairs`` (t, o).

    ``ids`` (t, id) names one document of each text; each text that is needed is read once.
    """
    wanted = pairs.select(F.explode(F.array("t", "o")).alias("__t")).distinct().join(ids.select(F.col("t").alias("__t"), "id"), "__t")
    held = with_hash(docs.select("doc_id", "text")).withColumn("id", id_text()).drop("doc_id")
    once = held.join(wanted, ["__t", "id"]).dropDuplicates(["__t"]).select("__t", "text")
    sets = add_columns(once, [("s", LONGS)], lambda batch: [[shingles(t).view(np.int64).tolist() for t in texts(batch)]])
    return cut(sets.select(F.col("__t").alias("t"), "s"))


def compared(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (t, o) with the sizes of both sets (n, on), how many shingles they share, and those of t alone (``added``)."""
    both = pairs.join(sets, "t").join(sets.toDF("o", "os"), "o")
    return both.select(
        "t", "o", F.size("s").alias("n"), F.size("os").alias("on"),
        F.size(F.array_intersect("s", "os")).alias("shared"), F.array_except("s", "os").alias("added"),
    )


def untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs (t, o) that were not compared, in either direction."""
    once = pairs.select(F.least("t", "o").alias("t"), F.greatest("t", "o").alias("o")).distinct()
    return once.join(tried.select(F.least("t", "o").alias("t"), F.greatest("t", "o").alias("o")), ["t", "o"], "left_anti")


def with_groups(rows: DataFrame, links: DataFrame, of: str = "t", group: str = "g") -> DataFrame:
    joined = rows.drop(group).join(stars(links).toDF(of, group), of, "left")
    return joined.withColumn(group, F.coalesce(group, of))


def mixed(rows: DataFrame, key: str) -> DataFrame:
    """Rows of those keys that still hold texts of different groups."""
    rows = cut(rows)
    several = rows.groupBy(key).agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select(key)
    return cut(rows.join(several, key, "left_semi"))


def around_hubs(met: DataFrame) -> DataFrame:
    """(t, o): all pairs of texts around one hub that can still be alike; ``met`` as ``compared`` has it, o the hub, with groups g.

    Let x not be alike with its hub h. What x and y share lies in h, at most as much as each of them shares with h, or
    is in neither's part of h. So either these shares suffice, which only texts smaller than h can reach, or x
    and y share enough shingles that h lacks: r of them. With the rarest first, the rarest of those is then
    among the first ``size - r + 1`` of both texts, so pairs meet only there, and seldom at a frequent shingle.
    """
    row = met.select("o", "t", "n", "shared", "added", "g", (~alike()).alias("apart"))
    size = lambda n: F.floor(F.log(n) / SIZE_STEP)
    low, high = F.ceil(4 * F.col("n") / 5), F.floor(9 * F.col("shared") / 4 - F.col("n"))
    new = (F.col("x_g") != F.col("g")) & (F.col("x_t") != F.col("t"))
    enough = F.ceil(4 * (F.col("n") + F.col("x_n")) / 9)

    def as_x(rows: DataFrame, *own: str) -> DataFrame:
        return rows.where("apart").select(*[F.col(c).alias(f"x_{c}") for c in ("t", "n", "shared", "g", *own)], "o", *set(rows.columns) & {"s", "size"})

    sized = row.drop("added").withColumn("size", size(F.col("n")))
    smaller = row.drop("added").where(high >= low).withColumn("size", F.explode(F.sequence(size(low), size(high))))
    by_share = as_x(smaller).join(sized.drop("apart"), ["o", "size"]).where(new & (F.least("shared", "x_shared") >= enough))

    seen = row.withColumn("extra", F.size("added")).withColumn("s", F.explode("added")).drop("added")
    seen = cut(seen.join(seen.groupBy("o", "s").agg(F.count(F.lit(1)).alias("c")), ["o", "s"]))
    rarest = F.row_number().over(Window.partitionBy("o", "t").orderBy("c", "s"))
    seen = seen.withColumn("rank", rarest).drop("c")
    seen = cut(seen.where(F.col("rank") <= F.col("extra") + 1 - F.greatest(low - F.col("shared"), F.lit(1))))
    needed = F.greatest(enough - F.least("shared", "x_shared"), F.lit(1))
    by_shingle = as_x(seen, "extra", "rank").join(seen.drop("apart"), ["o", "s"]).where(
        new & alike_in_length("n", "x_n") & (F.col("rank") <= F.col("extra") - needed + 1) & (F.col("x_rank") <= F.col("x_extra") - needed + 1)
    )
    return by_share.select("t", F.col("x_t").alias("o")).union(by_shingle.select("t", F.col("x_t").alias("o")))


def groups(docs: DataFrame, members: DataFrame, ids: DataFrame) -> DataFrame:
    """(a, b): every text ``a`` that is linked, with the least text ``b`` of its group (``a`` other than ``b``).

    ``members`` (t, k) are the texts of each meeting.
    """
    shared = cut(members.join(members.groupBy("k").agg(F.count("*").alias("c")), "k"))
    # The text that shares most meetings with others is the likeliest to be alike with many of them.
    weight = shared.groupBy("t").agg(F.sum("c").alias("w"))
    shared = cut(shared.drop("c").join(weight, "t"))
    hub = cut(shared.groupBy("k").agg(F.max(F.struct("w", "t")).alias("h")).select("k", F.col("h.t").alias("o")))
    met = cut(shared.join(hub, "k").where("t <> o").select("t", "o").distinct())
    sets = sets_of(docs, ids, met)
    met = cut(compared(sets, met))
    links = met.where(alike()).select(F.col("t").alias("a"), F.col("o").alias("b"))
    itself = met.select("o", "on").distinct().select(
        F.col("o").alias("t"), "o", F.col("on").alias("n"), "on", F.col("on").alias("shared"), F.array().cast(LONGS).alias("added")
    )
    open_ = mixed(with_groups(met.union(itself), links), "o")
    # These are texts that met a hub, or hubs, so their sets are known.
    rest = cut(compared(sets, cut(untried(around_hubs(open_), met))))
    return stars(links.union(rest.where(alike()).select(F.col("t").alias("a"), F.col("o").alias("b"))))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id, first among equals."""
    keys, bits = key_shape(docs.count())
    marked = cut(signatures(docs, max(MORE_WORDS, -(-keys * bits // 64))))
    least = marked.groupBy("t").agg(F.min("doc_id").alias("d"))
    ids = least.select("t", F.coalesce(F.col("d").cast("string"), F.lit("")).alias("id"))
    chosen = (
        least.join(groups(docs, meetings(marked, keys, bits), ids).toDF("t", "g"), "t", "left")
        .groupBy(F.coalesce("g", "t").alias("g"))
        .agg(F.min(F.struct(F.col("d").isNull().alias("no"), "d", "t")).alias("one"))
        .select(F.col("one.t").alias("__t"), F.coalesce(F.col("one.d").cast("string"), F.lit("")).alias("__id"))
    )
    own = with_hash(docs).withColumn("__id", id_text())
    order = Window.partitionBy("__t", "__id").orderBy("text")
    return (
        own.join(chosen, ["__t", "__id"])
        .withColumn("__row", F.row_number().over(order))
        .where("__row = 1")
        .select(*docs.columns)
    )

"""Conversations that begin alike, as a prefix trie: which turns many of them share, and what sharing saves.

``rebuilt`` numbers the turns of every conversation, ``prefixes`` gives every prefix a digest, and ``nodes``
counts. A prefix's digest is the sum (two lanes modulo 2**64) of a mixed hash of each turn with its place, so a
conversation is cut into chunks of ``CHUNK`` turns: each chunk adds up its own turns, and chunks after the first start
from the sum of those before. No conversation, however long, is numbered or digested by one task.

The nodes are the distinct digests. A *shard* gets whole subtrees and builds a node table for them: a minimal perfect
hash gives each digest its slot, the digest kept there verifies every look-up, counts are scattered into flat numpy
arrays, and sums go up through the array of parent slots, the deepest nodes first. To keep subtrees small, the
nodes with more than ``LIMIT`` turns below them (the spine: every node above it is one, too) are left out first; what lies below
is many small subtrees, dealt out by the digest of their top. The sums of the tops, added up by Spark for each
parent, then enter the spine's own table, which is one task. The spine has at most ``SPINE_ROWS`` nodes: if it has
more, the limit is raised. So a very frequent first turn or a conversation with thousands of copies
meets in counts only. A conversation of very many turns that no other one shares is one chain in one table; its rows are 60 bytes each.

The members that end at a node go into one SHA-256, which cannot be split: sorted ranges of them are turned into
pieces of text in parallel, and one task per node reads the pieces in order, one at a time.

Rows: null role or text counts as empty, a null turn comes first, equal turns are ordered by their digest (so repeated rows are
turns of their own). Rows without a conversation id belong to none and are left out. ``c % 5`` of a negative id is from 0 to 4.
An empty table has no nodes; a table with only turnless rebuilt conversations has the root alone. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapcount.llm.common import positions
from snapcount.llm.warc import schema_and_arrow
from snapcount.session import at_most, cut, ship_package, spread

CHUNK = 4096  # turns of a conversation that one row holds
CELL = 256  # turns that are ranked together
LIMIT = 1024  # turns below a node that make it part of the spine
SPINE_ROWS = 100_000
SHARD_ROWS = 500_000
PIECE = 4096  # ids in a piece of text
HEAD = 8  # a rebuilt conversation takes fewer than nine turns from another one
ROOT = bytes(16)

NODES = (
    "digest binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, top boolean"
)


# -- turns and their digests ---------------------------------------------------------------


def numbered(conversations: DataFrame) -> DataFrame:
    """Each turn's place in its conversation, its hash, and its size: conv_id, place, turns, hash, size."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    hashed = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        hashed.alias("hash"),
        F.octet_length(text).cast("long").alias("size"),
    )
    cell = F.coalesce(F.floor(F.col("turn") / CELL), F.lit(-(2**56)))
    order = [F.col("turn").asc_nulls_first(), F.col("hash")]
    return positions(rows, order, cell, keys=["conv_id"], position="place", total="turns").drop("turn")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation's turns after its head was taken from another conversation, and every conversation's length."""
    own = cut(numbered(conversations))
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9))
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(5))
    heads = (
        own.filter((F.pmod("conv_id", F.lit(5)) == 0) & (F.col("place") < HEAD))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "hash", "size"))).alias("first"))
    )
    taken = F.least("head", F.coalesce(F.size("first").cast("long"), F.lit(0)))
    plan = (
        own.filter("place = 0")
        .select("conv_id", "turns", head.alias("head"), base.alias("base"))
        .join(heads, "base", "left")
        .select("conv_id", "head", taken.alias("taken"), "first", (taken + F.greatest(F.col("turns") - F.col("head"), F.lit(0))).alias("length"))
    )
    plan = cut(plan)
    borrowed = plan.filter("taken > 0").select(
        "conv_id", "length", F.explode(F.slice("first", F.lit(1), F.col("taken").cast("int"))).alias("t")
    )
    kept = own.join(plan.select("conv_id", "head", "taken", "length"), "conv_id").filter("place >= head")
    rows = borrowed.select("conv_id", "length", "t.place", "t.hash", "t.size").unionByName(
        kept.select("conv_id", "length", (F.col("place") - F.col("head") + F.col("taken")).alias("place"), "hash", "size")
    )
    return rows, plan.select("conv_id", "length")


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of each 64-bit number spread over all of it."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lanes(digests: list[bytes]) -> np.ndarray:
    """Two 64-bit numbers a digest."""
    return np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64).reshape(-1, 2)


def binary(numbers: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(numbers.astype(">u8")).tobytes()
    return pa.Array.from_buffers(pa.binary(16), len(numbers), [None, pa.py_buffer(data)]).cast(pa.binary())


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)


def running(terms: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums from the start of each run, modulo 2**64. No run is empty."""
    total = np.cumsum(terms, axis=0, dtype=np.uint64)
    before = np.concatenate([np.zeros((1, 2), np.uint64), total])[starts_of(lengths)]
    return total - np.repeat(before, lengths, axis=0)


def prefixes(turns: DataFrame) -> DataFrame:
    """A row for each chunk of a conversation: conv_id, chunk, length, the ``before`` digest, then sums within the
    chunk (``sums``) and sizes, one a turn."""
    schema, arrow = schema_and_arrow("conv_id long, chunk long, length long, sums array<binary>, sizes array<long>, last binary")
    chunks = turns.groupBy("conv_id", F.floor(F.col("place") / CHUNK).alias("chunk")).agg(
        F.max("length").alias("length"), F.sort_array(F.collect_list(F.struct("place", "hash", "size"))).alias("items")
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            items = batch.column(3)
            lengths, flat = items.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), items.flatten()
            place = flat.field(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            hashes = lanes(flat.field(1).to_pylist())
            odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
            sums = running(mixed(hashes + (place[:, None] + np.uint64(1)) * odd), lengths)
            ends = np.cumsum(lengths)
            offsets = pa.array(np.concatenate([[0], ends]), type=pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2),
                    pa.ListArray.from_arrays(offsets, binary(sums)).cast(arrow.field(3).type),
                    pa.ListArray.from_arrays(offsets, flat.field(2)).cast(arrow.field(4).type),
                    binary(sums[ends - 1]),
                ],
                schema=arrow,
            )

    ship_package(turns.sparkSession)
    local = cut(chunks.mapInArrow(each, schema))
    return with_starts(local).drop("last")


def with_starts(local: DataFrame) -> DataFrame:
    """Add the digest ``before`` each chunk: the sums of the conversation's earlier chunks, a row a chunk."""
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)

    def lane(at: int) -> Column:
        number = F.conv(F.hex(F.substring("last", at, 8)), 16, 10).cast("decimal(20,0)")
        total = F.coalesce(F.sum(number).over(earlier), F.lit(0)) % F.lit(str(2**64)).cast("decimal(38,0)")
        return F.lpad(F.conv(total.cast("decimal(20,0)").cast("string"), 10, 16), 16, "0")

    long = local.filter(F.col("length") > CHUNK)
    starts = long.select("conv_id", "chunk", F.unhex(F.concat(lane(1), lane(9))).alias("before"))
    short = local.filter(F.col("length") <= CHUNK).withColumn("before", F.lit(bytearray(ROOT)))
    return short.unionByName(long.join(starts, ["conv_id", "chunk"]))


# -- node tables ---------------------------------------------------------------------------


class PerfectHash:
    """Slots 0 to n - 1 for n distinct digests.

    Level by level, the digests that are alone at their place of a bit array keep it; the others go on to the next level.
    A slot is the number of bits before it. A digest that is not in the table may get a slot as well: compare what is kept there.
    """

    LEVELS = 100

    def __init__(self, digests: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest, taken = digests, 0
        while len(rest):
            if len(self.levels) == self.LEVELS:
                raise ValueError("equal digests with different turns, sizes or parents")
            places = self.places(rest, len(self.levels), 2 * len(rest))
            used = np.bincount(places, minlength=2 * len(rest)) == 1
            self.levels.append((used, np.cumsum(used) - 1 + taken))
            taken += int(used.sum())
            rest = rest[~used[places]]
        self.size = taken

    @staticmethod
    def places(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        seeded = mixed(digests[:, 0] + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64))
        return (mixed(seeded ^ digests[:, 1]) % np.uint64(size)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for those that no level has a bit for."""
        found, rest = np.full(len(digests), -1, dtype=np.int64), np.arange(len(digests))
        for level, (used, ranks) in enumerate(self.levels):
            places = self.places(digests[rest], level, len(used))
            hit = used[places]
            found[rest[hit]] = ranks[places[hit]]
            rest = rest[~hit]
        return found


def verified_slots(table: PerfectHash, kept: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Slots of the digests that the table really has; -1 for the others."""
    slots = table.slots(digests)
    wrong = (slots < 0) | (kept[slots] != digests).any(axis=1)
    return np.where(wrong, -1, slots)


def accumulate(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sums over the subtree of every node, in slot order.

    ``rows`` has digest and parent (two lanes), depth, size, and of each node what is known without the nodes of this
    table: n_convs and conv_id (smallest) of members, n_children, n_leaves and saved_tokens of children elsewhere.
    """
    table = PerfectHash(rows["digest"])
    slot = table.slots(rows["digest"])
    flat = {name: np.empty_like(values) for name, values in rows.items()}
    for name, values in rows.items():
        flat[name][slot] = values
    if (flat["digest"][slot] != rows["digest"]).any():
        raise ValueError("a node lost its slot")
    parent = verified_slots(table, flat["digest"], flat["parent"])
    order = np.argsort(-flat["depth"], kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(flat["depth"][order])) + 1)
    for level in levels:
        flat["n_leaves"][level] += flat["n_children"][level] == 0
        flat["saved_tokens"][level] += (flat["n_convs"][level] - 1) * flat["size"][level]
        inner = level[parent[level] >= 0]
        above = parent[inner]
        np.add.at(flat["n_children"], above, 1)
        np.minimum.at(flat["conv_id"], above, flat["conv_id"][inner])
        for name in ("n_convs", "n_leaves", "saved_tokens"):
            np.add.at(flat[name], above, flat[name][inner])
    flat["top"] = parent < 0
    flat["parent_conv_id"] = np.where(parent < 0, 0, flat["conv_id"][parent])
    return flat


# Columns of a node before its table is built.
PLAIN = "digest binary, parent binary, depth long, size long, n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long"


def tables(rows: DataFrame) -> DataFrame:
    """Node tables, one for each partition of ``rows``: every node with the sums over its subtree.

    ``top`` marks nodes whose parent is in no table of the same partition.
    """
    schema, arrow = schema_and_arrow(NODES)
    names = [part.split()[0] for part in PLAIN.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        read = {}
        for i, name in enumerate(names):
            column = whole.column(i)
            digest = name in ("digest", "parent")
            read[name] = lanes(column.to_pylist()) if digest else column.to_numpy().astype(np.int64)
        made = accumulate(read)
        columns = []
        for field in arrow:
            values = made[field.name]
            if field.name in ("digest", "parent"):
                columns.append(binary(values))
            elif field.name == "parent_conv_id":
                columns.append(pa.array(values, type=field.type, mask=made["top"]))
            else:
                columns.append(pa.array(values, type=field.type))
        yield from pa.Table.from_arrays(columns, schema=arrow).to_batches(max_chunksize=10_000)

    return rows.select(*names).mapInArrow(each, schema)


def each_prefix(paths: DataFrame, spine: frozenset[bytes] = frozenset(), light: bool = False) -> DataFrame:
    """A row for each prefix of each conversation: digest, parent, depth, size, left (turns from here to the end), conv_id.

    ``light`` adds ``root``, the first digest on the way that is not in ``spine`` (null for those in it); ``paths`` then
    has a column ``first``, that digest if an earlier chunk has it.
    """
    schema, arrow = schema_and_arrow(
        "digest binary, parent binary, depth long, size long, left long, conv_id long" + (", root binary" if light else "")
    )
    columns = ["conv_id", "chunk", "length", "before", "sums", "sizes"] + (["first"] if light else [])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, chunk, length = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            before, sums = lanes(batch.column(3).to_pylist()), batch.column(4)
            lengths = sums.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = starts_of(lengths)
            digests = lanes(sums.flatten().to_pylist()) + np.repeat(before, lengths, axis=0)
            parents = np.concatenate([np.zeros((1, 2), np.uint64), digests[:-1]])
            parents[starts] = before
            inside = np.arange(len(digests)) - np.repeat(starts, lengths)
            depth = np.repeat(chunk * CHUNK, lengths) + inside + 1
            made = [
                binary(digests), binary(parents), pa.array(depth), batch.column(5).flatten(),
                pa.array(np.repeat(length, lengths) - depth + 1), pa.array(np.repeat(conv, lengths)),
            ]
            if light:
                texts = made[0].to_pylist()
                roots: list[bytes | None] = []
                for start, n, first in zip(starts, lengths, batch.column(6).to_pylist(), strict=True):
                    at = start
                    while first is None and at < start + n and texts[at] in spine:
                        at += 1
                    if first is None and at < start + n:
                        first = texts[at]
                    roots += [None] * (at - start) + [first] * (start + n - at)
                made.append(pa.array(roots, type=pa.binary()))
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, arrow, strict=True)], schema=arrow)

    return paths.select(*columns).mapInArrow(each, schema)


def heavy(paths: DataFrame, limit: int) -> frozenset[bytes]:
    """Digests of the nodes with more than ``limit`` turns below, or fewer of them if these are too many to hold."""
    sums = each_prefix(paths).groupBy("digest").agg(F.sum("left").alias("below"))
    found = cut(sums.filter(F.col("below") > limit))
    while not at_most(found.filter(F.col("below") > limit), SPINE_ROWS):
        limit *= 4
    return frozenset(bytes(r.digest) for r in found.filter(F.col("below") > limit).select("digest").collect())


def with_first(paths: DataFrame, spine: frozenset[bytes]) -> DataFrame:
    """Add the first digest outside the spine, if it lies in an earlier chunk of the conversation."""
    long = paths.filter(F.col("length") > CHUNK).withColumn("first", F.lit(None).cast("binary"))
    lights = each_prefix(long, spine, light=True).filter("root is not null")
    firsts = lights.groupBy("conv_id").agg(F.min_by("root", "depth").alias("first"), F.min("depth").alias("at"))
    begins = (F.col("chunk") * CHUNK) >= F.col("at")
    later = paths.filter(F.col("length") > CHUNK).join(firsts, "conv_id", "left")
    later = later.withColumn("first", F.when(begins, F.col("first"))).drop("at")
    return paths.filter(F.col("length") <= CHUNK).withColumn("first", F.lit(None).cast("binary")).unionByName(later)


def member_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each digest, ascending and comma-joined: digest, ends_sha256."""
    piece, piece_arrow = schema_and_arrow("digest binary, first long, ids string")
    whole, whole_arrow = schema_and_arrow("digest binary, ends_sha256 string")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, ids, done = None, [], []

        def close() -> None:
            if ids:
                done.append((digest, ids[0], ",".join(map(str, ids))))

        for batch in batches:
            for at, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != digest or len(ids) == PIECE:
                    close()
                    digest, ids = at, []
                ids.append(conv)
            yield pa.RecordBatch.from_pylist([dict(zip(piece_arrow.names, x, strict=True)) for x in done], schema=piece_arrow)
            done = []
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(piece_arrow.names, x, strict=True)) for x in done], schema=piece_arrow)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, state, done = None, None, []
        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if at != digest:
                    if state is not None:
                        done.append((digest, state.hexdigest()))
                    digest, state = at, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(whole_arrow.names, x, strict=True)) for x in done], schema=whole_arrow)
            done = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"digest": digest, "ends_sha256": state.hexdigest()}], schema=whole_arrow)

    count = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ends.select("digest", "conv_id").repartitionByRange(count, "digest", "conv_id")
    pieces = ranged.sortWithinPartitions("digest", "conv_id").mapInArrow(join, piece)
    return spread(pieces, "digest").sortWithinPartitions("digest", "first").mapInArrow(hashed, whole)


def nodes(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations, with what its subtree holds."""
    spark = conversations.sparkSession
    turns, lengths = rebuilt(conversations)
    paths = prefixes(turns)
    spine = heavy(paths, limit)
    rows = each_prefix(with_first(paths, spine), spine, light=True)
    last = F.col("left") == 1
    plain = cut(
        rows.groupBy("root", "digest", "parent", "depth", "size")
        .agg(
            F.sum(last.cast("long")).alias("n_convs"),
            F.coalesce(F.min(F.when(last, F.col("conv_id"))), F.lit(2**63 - 1)).alias("conv_id"),
        )
        .withColumns({c: F.lit(0).cast("long") for c in ("n_children", "n_leaves", "saved_tokens")})
    )
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + plain.count() // SHARD_ROWS)
    light = cut(tables(plain.filter("root is not null").repartition(shards, "root")))

    added = (
        light.filter("top")
        .groupBy(F.col("parent").alias("digest"))
        .agg(
            F.sum("n_convs").alias("n_convs"),
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_children"),
            F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("saved_tokens"),
        )
    )
    own = plain.filter("root is null").select("digest", "parent", "depth", "size", F.col("n_convs").alias("n0"), F.col("conv_id").alias("c0"))
    heavy_rows = own.join(added, "digest", "left").select(
        "digest", "parent", "depth", "size",
        (F.col("n0") + F.coalesce("n_convs", F.lit(0))).alias("n_convs"),
        F.least("c0", "conv_id").alias("conv_id"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")),
    )
    upper = cut(tables(heavy_rows.repartition(1)))  # SPINE_ROWS at most

    counts = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    turnless = lengths.filter("length = 0")
    below = light.filter("top and depth = 1").unionByName(upper.filter("depth = 1")).withColumn("n_children", F.lit(1).cast("long"))
    alone = turnless.withColumns({c: F.lit(int(c == "n_convs")).cast("long") for c in counts})
    sums = below.select("conv_id", *counts).unionByName(alone.select("conv_id", *counts))
    sums = sums.agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in counts)).filter("n_convs > 0")
    root = sums.select(
        F.lit(bytearray(ROOT)).alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"),
        "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", F.lit(False).alias("top"),
    )
    root = cut(root)
    known = upper.select("digest", "conv_id").unionByName(root.select("digest", "conv_id"))
    parents = known.select(F.col("digest").alias("parent"), F.col("conv_id").alias("above"))
    found = light.unionByName(upper).join(F.broadcast(parents), "parent", "left")  # SPINE_ROWS + 1 at most
    found = found.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).drop("above").unionByName(root)

    ends = each_prefix(paths.filter(F.floor((F.col("length") - 1) / CHUNK) == F.col("chunk"))).filter(last)
    ends = ends.select("digest", "conv_id").unionByName(turnless.select(F.lit(bytearray(ROOT)).alias("digest"), "conv_id"))
    return found.join(member_digests(ends), "digest", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )

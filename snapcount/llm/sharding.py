"""Shards that all match the mixture, by proportional stratified interleaving.

Rows get a seeded place in their source: ordered by the MD5 digest of seed, id and text
checksum. The fraction ``(2 place + 1) / (2 rows of the source)`` says how far into
its source a row is. All rows in the order of fraction (then source and digest) form one
sequence in which every stretch holds the sources in proportion; it is cut into shards of
equal row counts, at most one apart (law ``rows``). A shard so has each source's
share to within one row at either end.

Both places are found without a global sort: rows are ranked inside cells (prefixes of the digest,
then equal stretches of the fraction), and only counts of cells, at most ``cells`` for each source,
are put in order. A source with a third of all rows is ranked by as many tasks as it has cells.
DataFrame functions only; the texts themselves are not shuffled unless the caller keeps them.

Defined results: a null text has size 1 and the checksum of the empty text; a null source is a
source of its own; repeated rows take different slots; fewer rows than shards leave shards
empty; an empty table gives an empty table. Columns of the input named ``shard`` or ``slot`` are replaced,
others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcount.llm.common import positions, text_of

SHARDS = 16
SEED = 2024
CELLS = 4096


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes and one) and ``text_crc32``."""
    return docs.withColumn("size", F.octet_length(text_of(text)).cast("long") + 1).withColumn(
        "text_crc32", F.crc32(text_of(text).cast("binary"))
    )


def seeded(seed: int, *columns: str) -> Column:
    """A digest that orders rows as if shuffled; the same in every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def assign(
    docs: DataFrame,
    shards: int = SHARDS,
    source: str = "source",
    keys: tuple[str, ...] = ("doc_id", "text_crc32"),
    seed: int = SEED,
    cells: int = CELLS,
) -> DataFrame:
    """``docs`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard)."""
    rows = docs.drop(*[c for c in ("shard", "slot") if c in docs.columns]).withColumn("__digest", seeded(seed, *keys))
    prefix = F.conv(F.substring("__digest", 1, 8), 16, 10).cast("long")
    by_digest = [F.col("__digest"), *[F.col(k) for k in keys]]
    placed = positions(
        rows, by_digest, F.floor(prefix * cells / F.lit(2**32)).cast("long"), [source], cells, "__place", "__rows"
    )
    # A fraction in whole numbers: 2 place + 1 of 2 rows.
    share = (2 * F.col("__place") + 1) / (2 * F.col("__rows"))
    placed = placed.withColumn("__share", share)
    ordered = positions(
        placed.drop("__rows"),
        [F.col("__share"), F.coalesce(F.col(source).cast("string"), F.lit("")), *by_digest],
        F.floor(F.col("__share") * cells).cast("long"),
        (),
        cells,
        "__at",
        "__rows",
    )
    whole = F.expr(f"(__at * {shards}) div __rows")
    first = F.expr(f"(((__at * {shards}) div __rows) * __rows + {shards - 1}) div {shards}")
    return (
        ordered.withColumn("shard", whole.cast("int"))
        .withColumn("slot", F.col("__at") - first)
        .drop("__digest", "__place", "__share", "__at", "__rows")
    )


def write(docs: DataFrame, path: str, shards: int = SHARDS, source: str = "source") -> None:
    """Write whole rows as one folder a shard, in the order of slots."""
    assigned = assign(described(docs), shards, source)
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Several files a shard: rows of a shard are dealt by stretches of slots.
    dealt = assigned.repartitionByRange(max(spread, shards), "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.write.mode("overwrite").partitionBy("shard").parquet(path)

"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from snapcount.session import ship_package

# Rows of one Arrow batch in operators that look at whole texts.
BATCH_ROWS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def add_columns(
    df: DataFrame,
    fields: Sequence[tuple[str, T.DataType]],
    compute: Callable[[pa.RecordBatch], Sequence],
) -> DataFrame:
    """Append columns that ``compute`` derives from each Arrow batch of rows.

    All columns of ``df`` stay; one with the name of a new column is replaced.
    No shuffle: each task streams its batches and keeps nothing between them.
    """
    spark = df.sparkSession
    ship_package(spark)
    new = [name for name, _ in fields]
    kept = [c for c in df.columns if c not in new]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in fields])
    arrow = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                made = compute(batch)
                columns = [batch.column(batch.schema.get_field_index(c)).cast(arrow.field(c).type) for c in kept]
                columns += [
                    x if isinstance(x, pa.Array) else pa.array(x, type=arrow.field(n).type)
                    for n, x in zip(new, made, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(each, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def positions(
    df: DataFrame,
    order: Sequence[Column],
    spread_by: Column,
    keys: Sequence[str] = (),
    cells: int = 4096,
    position: str = "position",
    total: str = "total",
) -> DataFrame:
    """Position of each row from 0 in the order (``spread_by``, ``order``) within ``keys``,
    and the rows of its group.

    ``spread_by`` is an integer cell from 0 to ``cells - 1`` that agrees with the order.
    Rows are ranked within a cell and cells are counted with map-side sums, so that
    a group with a third of all rows is ranked by up to ``cells`` tasks. Only the counts, at
    most ``cells`` rows a group, are put in order in one task.
    """
    cell, inside, before = "__cell", "__inside", "__before"
    group = [f"__k{i}" for i in range(len(keys))]
    marked = df.withColumn(cell, spread_by).withColumns(
        {g: F.coalesce(F.col(k).cast("string"), F.lit("\0null")) for g, k in zip(group, keys, strict=True)}
    )
    counts = marked.groupBy(*group, cell).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = counts.select(
        *group,
        cell,
        F.coalesce(F.sum("__n").over(upto), F.lit(0)).cast("long").alias(before),
        F.sum("__n").over(whole).cast("long").alias(total),
    )
    ranked = marked.drop(total).withColumn(
        inside, F.row_number().over(Window.partitionBy(*group, cell).orderBy(*order)).cast("long") - 1
    )
    return (
        ranked.join(offsets, [*group, cell])
        .withColumn(position, F.col(before) + F.col(inside))
        .drop(*group, cell, inside, before)
    )

"""Ordered work per key that does not need a whole key in one task.

A ``Sequence`` says how rows are ordered inside a key. With ``width`` unset, a
key is one partition of work. With ``width`` set, every key is cut into chunks
of that many order values (so at most that many rows); each operator then works
chunk by chunk and hands a small carry row from chunk to chunk. Both give the
same rows: ``width`` only decides how a very long key is spread over tasks. Carry
rows (one per chunk) are checkpointed, so that plans do not double each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapcount.session import cut, spread

CHUNK = "_chunk"
BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, 0)


@dataclass(frozen=True)
class Sequence:
    keys: tuple[str, ...] = ("game_id",)
    order: str = "frame_index"
    width: int | None = None

    @property
    def parts(self) -> tuple[str, ...]:
        return self.keys if self.width is None else (*self.keys, CHUNK)

    def within(self, *extra: str) -> Sequence:
        """The same order, inside finer keys."""
        return replace(self, keys=(*self.keys, *extra))

    def by(self, *keys: str) -> Sequence:
        return replace(self, keys=keys)

    def mark(self, df: DataFrame) -> DataFrame:
        if self.width is None or CHUNK in df.columns:
            return df
        return df.withColumn(CHUNK, F.floor(F.col(self.order) / F.lit(self.width)))

    def unmark(self, df: DataFrame) -> DataFrame:
        return df.drop(CHUNK)

    def up(self, *extra: Column) -> WindowSpec:
        return Window.partitionBy(*self.parts, *extra).orderBy(self.order)

    def down(self, *extra: Column) -> WindowSpec:
        return Window.partitionBy(*self.parts, *extra).orderBy(F.desc(self.order))


@dataclass(frozen=True)
class Look:
    """One ordered lookup; see the constructors below."""

    kind: str
    value: Column


def fill(value: Column) -> Look:
    """Latest non-null value, this row included."""
    return Look("fill", value)


def latest(value: Column) -> Look:
    """Latest non-null value before this row."""
    return Look("latest", value)


def coming(value: Column) -> Look:
    """Next non-null value after this row."""
    return Look("coming", value)


def before(value: Column) -> Look:
    """The value of the row before, null or not."""
    return Look("before", value)


def after(value: Column) -> Look:
    """The value of the row after, null or not."""
    return Look("after", value)


def running_sum(value: Column) -> Look:
    return Look("sum", value)


def running_min(value: Column) -> Look:
    return Look("min", value)


def min_before(value: Column) -> Look:
    return Look("min_before", value)


def max_before(value: Column) -> Look:
    return Look("max_before", value)


def whole_min(value: Column) -> Look:
    return Look("whole_min", value)


def whole_max(value: Column) -> Look:
    return Look("whole_max", value)


def _boxed(look: Look) -> Column:
    return F.struct(look.value.alias("v"))


def _local(look: Look, seq: Sequence) -> Column:
    whole = Window.partitionBy(*seq.parts)
    match look.kind:
        case "fill":
            return F.last(look.value, True).over(seq.up().rowsBetween(*UP_TO))
        case "latest":
            return F.last(look.value, True).over(seq.up().rowsBetween(*BEFORE))
        case "coming":
            return F.last(look.value, True).over(seq.down().rowsBetween(*BEFORE))
        case "before":
            return F.lag(_boxed(look)).over(seq.up())
        case "after":
            return F.lead(_boxed(look)).over(seq.up())
        case "sum":
            return F.sum(look.value).over(seq.up().rowsBetween(*UP_TO))
        case "min":
            return F.min(look.value).over(seq.up().rowsBetween(*UP_TO))
        case "min_before":
            return F.min(look.value).over(seq.up().rowsBetween(*BEFORE))
        case "max_before":
            return F.max(look.value).over(seq.up().rowsBetween(*BEFORE))
        case "whole_min":
            return F.min(look.value).over(whole)
        case _:
            return F.max(look.value).over(whole)


def _of_chunk(look: Look, order: str) -> Column:
    position = F.when(look.value.isNotNull(), F.col(order))
    match look.kind:
        case "fill" | "latest":
            return F.max_by(look.value, position)
        case "coming":
            return F.min_by(look.value, position)
        case "before":
            return F.max_by(_boxed(look), F.col(order))
        case "after":
            return F.min_by(_boxed(look), F.col(order))
        case "sum":
            return F.sum(look.value)
        case "min" | "min_before" | "whole_min":
            return F.min(look.value)
        case _:
            return F.max(look.value)


def _over_chunks(look: Look, carried: Column, keys: tuple[str, ...]) -> Column:
    up = Window.partitionBy(*keys).orderBy(CHUNK)
    down = Window.partitionBy(*keys).orderBy(F.desc(CHUNK))
    match look.kind:
        case "fill" | "latest" | "before":
            return F.last(carried, True).over(up.rowsBetween(*BEFORE))
        case "coming" | "after":
            return F.last(carried, True).over(down.rowsBetween(*BEFORE))
        case "sum":
            return F.sum(carried).over(up.rowsBetween(*BEFORE))
        case "min" | "min_before":
            return F.min(carried).over(up.rowsBetween(*BEFORE))
        case "max_before":
            return F.max(carried).over(up.rowsBetween(*BEFORE))
        case "whole_min":
            return F.min(carried).over(Window.partitionBy(*keys))
        case _:
            return F.max(carried).over(Window.partitionBy(*keys))


def _joined(look: Look, local: Column, carried: Column) -> Column:
    match look.kind:
        case "fill" | "latest" | "coming" | "before" | "after":
            return F.coalesce(local, carried)
        case "sum":
            return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
        case "min" | "min_before" | "whole_min":
            return F.least(local, carried)
        case _:
            return F.greatest(local, carried)


def scan(df: DataFrame, seq: Sequence, **looks: Look) -> DataFrame:
    """Add one column per lookup; all of them share a single carry round."""
    df = seq.mark(df)
    local = df.withColumns({name: _local(look, seq) for name, look in looks.items()})
    if seq.width is not None:
        edges = df.groupBy(*seq.parts).agg(
            *(_of_chunk(look, seq.order).alias(name) for name, look in looks.items())
        )
        carries = edges.select(
            *seq.parts,
            *(
                _over_chunks(look, F.col(name), seq.keys).alias(f"_carry_{name}")
                for name, look in looks.items()
            ),
        )
        local = local.join(cut(carries), list(seq.parts), "left").withColumns(
            {
                name: _joined(look, F.col(name), F.col(f"_carry_{name}"))
                for name, look in looks.items()
            }
        )
        local = local.drop(*(f"_carry_{name}" for name in looks))
    unbox = {
        name: F.col(name).getField("v")
        for name, look in looks.items()
        if look.kind in ("before", "after")
    }
    return local.withColumns(unbox) if unbox else local


def attach(df: DataFrame, seq: Sequence, per_key: DataFrame) -> DataFrame:
    """Join one row per key to every row of the key, without regrouping ``df``."""
    if seq.width is None:
        return df.join(per_key, list(seq.keys), "left")
    df = seq.mark(df)
    per_chunk = df.select(*seq.parts).distinct().join(per_key, list(seq.keys), "left")
    return df.join(cut(per_chunk), list(seq.parts), "left")


def latest_as_of(df: DataFrame, seq: Sequence, notes: DataFrame, *names: str) -> DataFrame:
    """Add the latest non-null value of each of ``names`` in ``notes`` (keys, order, names) at or before a row.

    Notes are merged into the sequence, each before the rows of its place, and carried
    forward in one pass; nothing of a key is held. A note may be at a place without a row.
    """
    place, order = "_place", F.col(seq.order).cast("bigint")
    marked = seq.mark(notes.select(*seq.keys, seq.order, *names))
    noted = marked.withColumn(place, F.struct(order.alias("at"), F.lit(0).alias("row"))).drop(seq.order)
    rows = seq.mark(df).withColumn(place, F.struct(order.alias("at"), F.lit(1).alias("row")))
    merged = rows.unionByName(noted, allowMissingColumns=True)
    carried = scan(merged, replace(seq, order=place), **{name: fill(F.col(name)) for name in names})
    return carried.filter(F.col(place)["row"] == 1).drop(place)


def same_value_runs(df: DataFrame, seq: Sequence, same: Column, name: str) -> DataFrame:
    """Number islands by the order value of their first row.

    ``same`` says whether a row belongs with the row before it.
    """
    return scan(df, seq, **{name: fill(F.when(~F.coalesce(same, F.lit(False)), F.col(seq.order)))})


def next_rows(
    df: DataFrame, seq: Sequence, value: Column, count: int, name: str
) -> DataFrame:
    """Array of ``value`` (never null) over the next ``count`` rows."""
    df = seq.mark(df)
    leads = [F.lead(value, k).over(seq.up()) for k in range(1, count + 1)]
    df = df.withColumn(name, F.array_compact(F.array(*leads)))
    if seq.width is None:
        return df
    # Every chunk has a row, so the heads of the next ``count`` chunks suffice.
    head = F.slice(F.concat(F.array(value), F.col(name)), 1, count)
    heads = df.groupBy(*seq.parts).agg(F.min_by(head, seq.order).alias("_head"))
    chunks = Window.partitionBy(*seq.keys).orderBy(CHUNK)
    then = [F.lead("_head", k).over(chunks) for k in range(1, count + 1)]
    heads = heads.select(*seq.parts, F.flatten(F.array_compact(F.array(*then))).alias("_then"))
    return (
        df.join(cut(heads), list(seq.parts), "left")
        .withColumn(name, F.slice(F.concat(F.col(name), F.col("_then")), 1, count))
        .drop("_then")
    )


def near_rows(
    df: DataFrame, seq: Sequence, flag: Column, reach: int, name: str
) -> DataFrame:
    """Whether ``flag`` holds within ``reach`` rows before or after."""
    df = seq.mark(df)
    flag = F.coalesce(flag, F.lit(False))
    local = F.max(flag).over(seq.up().rowsBetween(-reach, reach))
    df = df.withColumn(name, local)
    if seq.width is None:
        return df
    df = df.withColumn("_row", F.row_number().over(seq.up()))
    flagged = F.when(flag, F.col("_row"))
    up = Window.partitionBy(*seq.keys).orderBy(CHUNK)
    down = Window.partitionBy(*seq.keys).orderBy(F.desc(CHUNK))
    edges = (
        df.groupBy(*seq.parts)
        .agg(
            F.count("*").alias("_rows"),
            F.min(flagged).alias("_first"),
            F.max(flagged).alias("_last"),
        )
        .withColumn("_offset", F.sum("_rows").over(up) - F.col("_rows"))
        .select(
            *seq.parts,
            "_offset",
            F.max(F.col("_offset") + F.col("_last")).over(up.rowsBetween(*BEFORE)).alias("_prior"),
            F.min(F.col("_offset") + F.col("_first")).over(down.rowsBetween(*BEFORE)).alias("_next"),
        )
    )
    place = F.col("_offset") + F.col("_row")
    close = F.coalesce(place - F.col("_prior") <= reach, F.lit(False)) | F.coalesce(
        F.col("_next") - place <= reach, F.lit(False)
    )
    return (
        df.join(cut(edges), list(seq.parts), "left")
        .withColumn(name, F.col(name) | close)
        .drop("_row", "_offset", "_prior", "_next")
    )


# Folds ----------------------------------------------------------------------


Columns = dict[str, list]


class Machine:
    """A state machine over the ordered rows of one key, with integer state.

    ``run`` walks rows from a state and returns (last state, output rows).
    ``reach`` tells where each starting state ends, as (moves, other): a state
    not in ``moves`` ends in ``other``, or unchanged when ``other`` is None.
    Rows are lists by column name, as keys are many and mostly short. Chunked,
    both see one chunk at a time.
    """

    start = 0

    def run(self, state: int, rows: Columns) -> tuple[int, Columns]:
        raise NotImplementedError

    def reach(self, rows: Columns) -> tuple[dict[int, int], int | None]:
        raise NotImplementedError


def _key_types(df: DataFrame, names: tuple[str, ...]) -> list[T.StructField]:
    return [df.schema[name] for name in names]


def _lists(batch: pd.DataFrame, whole: set[str]) -> Columns:
    """The columns as lists; whole numbers stay so where some are null."""
    lists = {name: list(batch[name]) for name in batch.columns}
    for name in whole.intersection(batch.columns[batch.dtypes == float]):
        lists[name] = [None if value != value else int(value) for value in lists[name]]
    return lists


def _key_runs(rows: Columns, names: list[str]) -> Iterator[tuple[tuple, Columns]]:
    """(key, rows) of neighbours with one key."""
    keys = list(zip(*(rows[name] for name in names)))
    bounds = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
    for low, high in zip(bounds, bounds[1:]):
        yield keys[low], {name: values[low:high] for name, values in rows.items()}


def _whole_runs(batches: Iterator[pd.DataFrame], names: list[str], whole: set[str]) -> Iterator[list[tuple[tuple, Columns]]]:
    """As ``_key_runs``, batch by batch, but the last key of a batch waits for its other rows."""
    held: list[tuple[tuple, Columns]] = []
    for batch in batches:
        runs: list[tuple[tuple, Columns]] = []
        for key, rows in _key_runs(_lists(batch, whole), names):
            if held and held[0][0] == key:
                for name, values in held[0][1].items():
                    values.extend(rows[name])
                continue
            runs += held
            held = [(key, rows)]
        yield runs
    yield held


def fold(df: DataFrame, seq: Sequence, machine: Machine, out: str) -> DataFrame:
    """Run ``machine`` over every key; ``out`` is the DDL of its output columns.

    Rows stream past the state in sorted batches, so no key is held whole.
    Chunked: each chunk first reports where every state would end, those small
    maps are composed in order, and then all chunks run with their own start.
    """
    df = seq.mark(df)
    keys, parts, order = list(seq.keys), list(seq.parts), seq.order
    schema = T.StructType(
        _key_types(df, seq.keys) + T.StructType.fromDDL(out).fields
    )
    whole = {field.name for field in df.schema if isinstance(field.dataType, T.IntegralType)}
    names = schema.fieldNames()

    def ran(runs: Iterator[tuple[tuple, Columns]], current: tuple | None, state: int) -> tuple[tuple | None, int, pd.DataFrame]:
        found: Columns = {name: [] for name in names}
        for key, rows in runs:
            if key != current:
                current = key
                state = rows["_state"][0] if seq.width is not None else machine.start
            state, result = machine.run(state, rows)
            for name, values in result.items():
                found[name].extend(values)
            count = len(next(iter(result.values())))
            for name, value in zip(keys, key):
                found[name].extend([value] * count)
        return current, state, pd.DataFrame(found, columns=names)

    def streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, machine.start
        for batch in batches:
            current, state, result = ran(_key_runs(_lists(batch, whole), parts), current, state)
            if len(result):
                yield result

    def ordered(rows: DataFrame) -> DataFrame:
        return spread(rows, *parts).sortWithinPartitions(*parts, order)

    if seq.width is None:
        return ordered(df).mapInPandas(streamed, schema)

    reach_schema = T.StructType(
        _key_types(df, seq.parts)
        + T.StructType.fromDDL("froms array<bigint>, tos array<bigint>, other bigint").fields
    )

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for runs in _whole_runs(batches, parts, whole):
            ends = [(key, *machine.reach(rows)) for key, rows in runs]
            found = [(*key, list(moves), list(moves.values()), other) for key, moves, other in ends]
            yield pd.DataFrame(found, columns=reach_schema.fieldNames()).astype({"other": "Int64"})

    def started(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, machine.start
        for batch in batches:
            states = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, name) for name in keys)
                if key != current:
                    current, state = key, machine.start
                states.append(state)
                other = state if pd.isna(row.other) else int(row.other)
                state = int(dict(zip(row.froms, row.tos)).get(state, other))
            yield batch[list(keys) + ["chunk_no"]].assign(_state=states)

    # Read twice, and few columns, so not computed twice.
    df = cut(df)
    reaches = ordered(df).mapInPandas(reached, reach_schema)
    starts = (
        reaches.withColumnRenamed(CHUNK, "chunk_no")
        .repartition(*keys)
        .sortWithinPartitions(*keys, "chunk_no")
        .mapInPandas(
            started,
            T.StructType(
                _key_types(df, seq.keys)
                + T.StructType.fromDDL("chunk_no bigint, _state bigint").fields
            ),
        )
        .withColumnRenamed("chunk_no", CHUNK)
    )
    return ordered(df.join(cut(starts), parts)).mapInPandas(streamed, schema)


class Walk:
    """Per-key state of ``walk``: takes rows in order, returns output rows."""

    def add(self, row: tuple) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []


def walk(
    df: DataFrame, keys: list[str], order: str, start: Callable[[], Walk], out: str
) -> DataFrame:
    """Stream each key's rows in order past a small state.

    Rows come batch by batch from sorted partitions, so memory does not grow
    with a key. For states that cannot be composed; give it reduced rows.
    """
    schema = T.StructType(_key_types(df, tuple(keys)) + T.StructType.fromDDL(out).fields)
    names = schema.fieldNames()
    # Nested values do not sort in pandas, so order is left to Spark.
    ordered = spread(df, *keys).sortWithinPartitions(*keys, order)
    places = [ordered.columns.index(key) for key in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            rows: list[tuple] = []
            for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                this = tuple(row[place] for place in places)
                if this != key:
                    if state is not None:
                        rows += [(*key, *result) for result in state.end()]
                    key, state = this, start()
                rows += [(*key, *result) for result in state.add(row)]
            yield pd.DataFrame(rows, columns=names)
        if state is not None:
            yield pd.DataFrame([(*key, *result) for result in state.end()], columns=names)

    return ordered.mapInPandas(run, schema)


class Greedy(Machine):
    """Accept a row when it is at least ``gap`` positions after the last one.

    The state is one more than the last accepted position; 0 means none.
    """

    def __init__(self, gap: int, position: str, keep: list[str]) -> None:
        self.gap, self.position, self.keep = gap, position, keep

    def run(self, state, rows):
        taken = []
        for place, position in enumerate(rows[self.position]):
            if state == 0 or position + 1 - state >= self.gap:
                taken.append(place)
                state = int(position) + 1
        return state, {name: [rows[name][place] for place in taken] for name in self.keep}

    def reach(self, rows):
        places = np.array(rows[self.position])
        last = [0] * len(places)
        following = np.searchsorted(places, places + self.gap)
        for i in range(len(places) - 1, -1, -1):
            nxt = following[i]
            last[i] = last[nxt] if nxt < len(places) else int(places[i]) + 1
        moves = {}
        for state in range(max(1, int(places[0]) + 2 - self.gap), int(places[0]) + 1):
            opens = np.searchsorted(places, state - 1 + self.gap)
            moves[state] = last[opens] if opens < len(places) else state
        return moves, last[0]


def per_key_mode(
    df: DataFrame, keys: list[str], value: str, position: str, weight: Column | None = None
) -> DataFrame:
    """Most frequent non-empty value per key; on a tie the one seen first."""
    text = F.col(value).cast("string")
    counted = (
        df.filter(text.isNotNull() & (text != ""))
        .groupBy(*keys, value)
        .agg(
            F.sum(weight if weight is not None else F.lit(1)).alias("_n"),
            F.min(position).alias("_first"),
        )
    )
    return counted.groupBy(*keys).agg(
        F.max_by(value, F.struct(F.col("_n"), (-F.col("_first")).alias("_f"))).alias(value)
    )

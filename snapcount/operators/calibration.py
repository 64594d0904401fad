"""Compare plays with labelled truth: align, then check field by field."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from snapcount import constants as C
from snapcount.functions import text as P
from snapcount.functions.similarity import normalized
from snapcount.session import checkpoint_dir, cut, ship_package, spread

# Rows and columns of a part of an alignment's score table.
TILE = 512
# Cells of such parts that are computed at once; bounds the memory of a task.
CELLS = 1 << 18


def normalized_match(left: Column, right: Column) -> Column:
    """Whether normalized texts agree loosely. One without letters or digits agrees with any."""
    return (
        left.contains(right)
        | right.contains(left)
        | (F.replace(left, F.lit(" "), F.lit("")) == F.replace(right, F.lit(" "), F.lit("")))
    )


def expected_values(labels: DataFrame) -> dict[str, Column]:
    """The labelled value of each compared field, as text."""
    end_distance = F.coalesce(
        F.nullif("end_distance_label", F.lit("")), F.col("end_distance").cast("string")
    )
    special = {
        "game_clock_bucket": F.col("clock_bucket"),
        "distance": F.when(F.col("distance_label") == "inches", 0).otherwise(F.col("distance")),
        "end_down_distance": F.concat(F.col("end_down").cast("string"), F.lit(" & "), end_distance),
    }
    return {n: special.get(n, F.col(n)).cast("string") for n in C.CALIBRATED_FIELDS}


def observed_values(plays: DataFrame) -> dict[str, Column]:
    minutes = F.nullif(F.regexp_extract("game_clock", r"^(\d{1,2}):\d{2}$", 1), F.lit(""))
    bucket = F.concat(minutes.try_cast("int").cast("string"), F.lit("+"))
    return {
        n: (bucket if n == "game_clock_bucket" else F.col(n)).cast("string")
        for n in C.CALIBRATED_FIELDS
    }


@lru_cache(maxsize=1 << 16)
def _close(left: str, right: str) -> bool:
    """Whether normalized texts agree loosely."""
    return left in right or right in left or left.replace(" ", "") == right.replace(" ", "")


class _Side:
    """One side of the tiles of a batch: their rows as flat columns, and where those of each tile begin."""

    def __init__(self, rows: pa.ListArray, coded: dict[str, dict]) -> None:
        offsets = rows.offsets.to_numpy()
        flat = rows.values.slice(offsets[0], offsets[-1] - offsets[0])
        self.begin, self.size = offsets[:-1] - offsets[0], np.diff(offsets)
        self.number = flat.field("number")
        self.codes = {name: self._coded(flat.field(name), coded.setdefault(name, {})) for name in C.ALIGNMENT_WEIGHTS}

    @staticmethod
    def _coded(values: pa.Array, known: dict) -> np.ndarray:
        """Values as numbers that equal values of both sides share; -1 for null."""
        found = values.dictionary_encode()
        texts = np.array([known.setdefault(v, len(known)) for v in found.dictionary.to_pylist()] + [-1], dtype=np.int64)
        return texts[found.indices.fill_null(len(texts) - 1).to_numpy(zero_copy_only=False)]

    def padded(self, name: str, some: np.ndarray, width: int) -> np.ndarray:
        """Codes of the tiles ``some``, one a row; -1 beyond their ends."""
        place = self.begin[some, None] + np.arange(width)
        inside = np.arange(width) < self.size[some, None]
        return np.where(inside, self.codes[name][np.where(inside, place, 0)], -1)


class _Tiles:
    """Parts of score tables, those of one Arrow batch: some labelled rows against some observed rows each.

    ``top`` has the scores of the table's row above (one more than the columns), ``left`` those of the column
    before; without them the tile lies at that edge of the table, where every step is a gap. Tiles of like sizes
    are computed together, ``CELLS`` cells at once (or one tile).
    """

    def __init__(self, batch: pa.RecordBatch, tile: int) -> None:
        self.batch, coded = batch, {}
        self.labels, self.plays = (_Side(batch.column(f"{b}_rows"), coded) for b in "ij")
        self.texts = {n: [normalized(v) for v in coded[n]] for n in C.ALIGNMENT_WEIGHTS if n in C.LOOSE_TEXT_FIELDS}
        self.edges = {s: tile * batch.column(b).to_numpy() for s, b in (("top", "j"), ("left", "i"))}

    def groups(self) -> Iterator[np.ndarray]:
        """Places of tiles that are computed together."""
        rows, columns = self.labels.size, self.plays.size
        order = np.lexsort((columns, rows))
        at = 0
        while at < len(order):
            # Sorted, so the last one has the most rows.
            cells = (rows[order[at:]] + 1) * (np.maximum.accumulate(columns[order[at:]]) + 1) * np.arange(1, len(order) - at + 1)
            to = at + max(1, int(np.searchsorted(cells, CELLS, "right")))
            yield order[at:to]
            at = to

    def _close_cells(self, name: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two grids of codes, neither of them null, agree cell by cell."""
        if name not in self.texts:
            return left == right
        texts = self.texts[name]
        pairs, cell = np.unique(left * len(texts) + right, return_inverse=True)
        return np.array([_close(texts[p // len(texts)], texts[p % len(texts)]) for p in pairs.tolist()], dtype=bool)[cell]

    def _agreement(self, some: np.ndarray) -> np.ndarray:
        """Agreement of every labelled with every observed row, (tile, row, column)."""
        rows, columns = self.labels.size[some].max(), self.plays.size[some].max()
        total = np.zeros((len(some), rows, columns))
        compared = np.zeros(total.shape, dtype=np.int8)
        for name, weight in C.ALIGNMENT_WEIGHTS.items():
            left = np.broadcast_to(self.labels.padded(name, some, rows)[:, :, None], total.shape)
            right = np.broadcast_to(self.plays.padded(name, some, columns)[:, None, :], total.shape)
            both = (left >= 0) & (right >= 0)
            if not both.any():
                continue
            total[both] += np.where(self._close_cells(name, left[both], right[both]), weight, -0.75 * weight)
            compared += both
        return np.where(compared >= 2, total, C.ALIGNMENT_GAP)

    def _border(self, side: str, some: np.ndarray, width: int) -> np.ndarray:
        """Scores along one border of the tiles ``some``, ``width`` steps and the corner."""
        scores = C.ALIGNMENT_GAP * (self.edges[side][some, None] + np.arange(width + 1.0))
        column = self.batch.column(side).take(pa.array(some))
        for at in np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)):
            known = column[int(at)].values.to_numpy()
            scores[at, : len(known)] = known
        return scores

    def rows(self, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row by row of the tiles ``some``: agreement, scores (with the column before) and moves (0 match, 1 up, 2 left).

        What lies beyond the end of a tile means nothing; nothing within it depends on that.
        """
        pairs = self._agreement(some)
        rows, columns = pairs.shape[1:]
        scores, left = self._border("top", some, columns), self._border("left", some, rows)
        steps = C.ALIGNMENT_GAP * np.arange(columns + 1)
        yield np.zeros((len(some), columns)), scores, np.zeros((len(some), columns), dtype=np.int8)
        for i in range(rows):
            pair = pairs[:, i]
            match, up = scores[:, :-1] + pair, scores[:, 1:] + C.ALIGNMENT_GAP
            best = np.where(match >= up, match, up)
            moves = np.where(match >= up, 0, 1).astype(np.int8)
            # A run of left moves costs a gap each, so the best start is a running max.
            start = np.concatenate([left[:, i + 1 : i + 2], best], axis=1)
            reach = np.maximum.accumulate(start - steps, axis=1) + steps
            scores = np.concatenate([start[:, :1], np.maximum(best, reach[:, :-1] + C.ALIGNMENT_GAP)], axis=1)
            moves[scores[:, 1:] > best] = 2
            yield pair, scores, moves

    def borders(self, some: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Scores of the last row and of the last column of each tile."""
        rows, columns = self.labels.size[some], self.plays.size[some]
        each = np.arange(len(some))
        bottom: list = [None] * len(some)
        ends = []
        for i, (_, scores, _) in enumerate(self.rows(some)):
            ends.append(scores[each, columns])
            for at in np.flatnonzero(rows == i):
                bottom[at] = scores[at, : columns[at] + 1].copy()
        last = np.array(ends).T
        return bottom, [last[at, : rows[at] + 1] for at in each]

    def trace(self, some: np.ndarray, row: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The way back from a cell of each tile.

        Which tile (a place in ``some``), labelled and observed row (places in the flat columns) are aligned, and
        the cells at which the ways leave the tiles.
        """
        steps = [(pair > 0, moves) for pair, _, moves in self.rows(some)]
        good, moves = np.stack([g for g, _ in steps]), np.stack([m for _, m in steps])
        row, column = row.copy(), column.copy()
        aligned = [np.zeros((3, 0), dtype=np.int64)]
        going = np.flatnonzero((row > 0) & (column > 0))
        while len(going):
            r, c = row[going], column[going]
            move = moves[r, going, c - 1]
            hit = (move == 0) & good[r, going, c - 1]
            tiles = some[going[hit]]
            aligned.append(np.stack([going[hit], self.labels.begin[tiles] + r[hit] - 1, self.plays.begin[tiles] + c[hit] - 1]))
            row[going] -= move != 2
            column[going] -= move != 1
            going = going[(row[going] > 0) & (column[going] > 0)]
        return *np.concatenate(aligned, axis=1), row, column


def _blocks(df: DataFrame, tile: int, block: str) -> DataFrame:
    """Rows of each game in order, ``tile`` of them to a row."""
    number = F.col("play_number").cast("bigint").alias("number")
    rows = df.select("game_id", number, *C.ALIGNMENT_WEIGHTS)
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("game_id").orderBy("number", *C.ALIGNMENT_WEIGHTS)) - 1)
    item = F.struct("place", "number", *C.ALIGNMENT_WEIGHTS)
    return placed.groupBy("game_id", F.floor(F.col("place") / tile).alias(block)).agg(
        F.sort_array(F.collect_list(item)).alias(f"{block}_rows")
    )


_BORDERS = "game_id string, i bigint, j bigint, side string, scores array<double>"
_TRACED = "game_id string, expected_number int, play_number int, r bigint, c bigint"


def _with_borders(tiles: DataFrame, borders: DataFrame) -> DataFrame:
    for side in ("top", "left"):
        known = borders.filter(F.col("side") == side).select("game_id", "i", "j", F.col("scores").alias(side))
        tiles = tiles.join(known, ["game_id", "i", "j"], "left")
    return tiles


def align_plays(labels: DataFrame, plays: DataFrame, tile: int = TILE) -> DataFrame:
    """(game_id, expected_number, play_number): matched plays, by the best global alignment of each game.

    A game's score table is cut into tiles of ``tile`` labelled times ``tile`` observed rows. The tiles of one
    antidiagonal need only the last row and column of those on the one before, so all of them, of all games,
    are computed at once; these borders are kept, and no others. The way back goes through one tile a game and
    round, computed again from its borders. A game that fits in a tile needs no border and one round, whatever
    its neighbours need; a task computes ``CELLS`` cells of like tiles at a time, or one tile. Games without labels or without plays have no pairs. Equal play numbers are
    ordered by their values; nulls in a compared field count as not read.
    """
    spark = labels.sparkSession
    ship_package(spark)
    folder = f"{checkpoint_dir(spark)}/alignment-{uuid.uuid4().hex}"
    left, right = cut(_blocks(labels, tile, "i")), cut(_blocks(plays, tile, "j"))

    def extent(blocks: DataFrame, block: str, rows: str) -> DataFrame:
        return blocks.groupBy("game_id").agg(F.max(block).alias(f"last_{block}"), F.sum(F.size(f"{block}_rows")).alias(rows))

    games = cut(extent(left, "i", "r").join(extent(right, "j", "c"), "game_id"))
    far = games.agg(F.max(F.col("last_i") + F.col("last_j"))).head()[0] or 0

    def bordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles = _Tiles(batch, tile)
            for some in tiles.groups():
                bottom, end = tiles.borders(some)
                game, i, j = (batch.column(n).take(pa.array(some)) for n in ("game_id", "i", "j"))
                for side, i, j, scores in (("top", pc.add(i, 1), j, bottom), ("left", i, pc.add(j, 1), end)):
                    ends = np.cumsum([0, *map(len, scores)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(scores)))
                    yield pa.RecordBatch.from_arrays([game, i, j, pa.array([side] * len(some)), lists], names=border_schema.names)

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles, game = _Tiles(batch, tile), batch.column("game_id")
            above, before = (tile * batch.column(n).to_numpy() for n in "ij")
            row, column = batch.column("r").to_numpy() - above, batch.column("c").to_numpy() - before
            for some in tiles.groups():
                at, left_at, right_at, r, c = tiles.trace(some, row[some], column[some])
                expected = tiles.labels.number.take(pa.array(left_at)).cast(pa.int32())
                found = tiles.plays.number.take(pa.array(right_at)).cast(pa.int32())
                none, nowhere = pa.nulls(len(at), pa.int64()), pa.nulls(len(some), pa.int32())
                yield pa.RecordBatch.from_arrays([game.take(pa.array(some[at])), expected, found, none, none], names=traced_schema.names)
                ends = [pa.array(above[some] + r), pa.array(before[some] + c)]
                yield pa.RecordBatch.from_arrays([game.take(pa.array(some)), nowhere, nowhere, *ends], names=traced_schema.names)

    border_schema = to_arrow_schema(T.StructType.fromDDL(_BORDERS))
    traced_schema = to_arrow_schema(T.StructType.fromDDL(_TRACED))
    none = spark.createDataFrame([], _BORDERS)

    def borders_for(diagonal: Column | int, upto: int) -> DataFrame:
        """Borders of tiles, as the diagonals before them made them."""
        if upto <= 0:
            return none
        made = spark.read.schema(f"{_BORDERS}, diagonal int").option("basePath", folder).parquet(f"{folder}/diagonal=*")
        return made.filter(F.col("diagonal") == diagonal).drop("diagonal") if isinstance(diagonal, int) else made.drop("diagonal")

    def tiles(places: DataFrame, borders: DataFrame) -> DataFrame:
        found = places.join(left, ["game_id", "i"]).join(right, ["game_id", "j"])
        return spread(_with_borders(found, borders), "game_id", "i", "j")

    for d in range(far):
        low, high = F.greatest(d - F.col("last_j"), F.lit(0)), F.least("last_i", F.lit(d))
        places = games.filter(F.col("last_i") + F.col("last_j") > d).select(
            "game_id", F.explode(F.sequence(low, high)).alias("i")
        )
        places = places.withColumn("j", F.lit(d) - F.col("i"))
        made = tiles(places, borders_for(d - 1, d)).mapInArrow(bordered, _BORDERS)
        made.write.mode("overwrite").parquet(f"{folder}/diagonal={d}")

    found, at = [], games.select("game_id", "r", "c")
    while at.head(1):
        places = at.withColumns({"i": F.floor((F.col("r") - 1) / tile), "j": F.floor((F.col("c") - 1) / tile)})
        step = cut(tiles(places, borders_for(F.lit(None), far)).mapInArrow(traced, _TRACED))
        found.append(step.filter("r is null").select("game_id", "expected_number", "play_number"))
        at = step.filter("r > 0 and c > 0").select("game_id", "r", "c")
    if not found:
        return spark.createDataFrame([], "game_id string, expected_number int, play_number int")
    return reduce(DataFrame.unionByName, found)


def compare_fields(labels: DataFrame, plays: DataFrame, aligned: DataFrame) -> DataFrame:
    """One row per labelled field: expected, observed, and match status.

    Labels and plays meet once per play, as wide rows. Each field is compared there, loose texts normalized
    once, and only then does a row become one for each field, so the shuffle carries plays and not fields.
    """
    expected = labels.select(
        "game_id", F.col("play_number").alias("expected_number"),
        F.col("stream_side").alias("side"), F.col("possession_team").alias("team"),
        *(v.alias(f"_e_{n}") for n, v in expected_values(labels).items()),
    )
    matched = plays.join(aligned, ["game_id", "play_number"])
    observed = matched.select(
        "game_id", "expected_number", F.col("play_number").alias("observed_play_number"),
        *(v.alias(f"_o_{n}") for n, v in observed_values(plays).items()),
    )
    wide = expected.join(observed, ["game_id", "expected_number"], "left").withColumns(
        {f"_{s}n_{n}": P.normalize_text(f"_{s}_{n}") for n in C.LOOSE_TEXT_FIELDS for s in "eo"}
    )

    def cell(field: str) -> Column:
        """What becomes the row of a labelled field; null for others."""
        left, right = F.col(f"_e_{field}"), F.col(f"_o_{field}")
        agrees = normalized_match(F.col(f"_en_{field}"), F.col(f"_on_{field}")) if field in C.LOOSE_TEXT_FIELDS else left == right
        status = F.when(right.isNull(), "missing").when(agrees, "match").otherwise("mismatch")
        row = F.struct(F.lit(field).alias("field"), left.alias("expected"), right.alias("observed"), status.alias("status"))
        return F.when(left.isNotNull(), row)

    return (
        wide.select(
            "game_id", F.col("expected_number").alias("play_number"), "observed_play_number", F.col("side").alias("stream_side"),
            F.col("team").alias("possession_team"), F.explode(F.array(*map(cell, C.CALIBRATED_FIELDS))).alias("_cell"),
        )
        .filter("_cell is not null")
        .select("game_id", "play_number", "observed_play_number", "stream_side", "possession_team", "_cell.*")
    )


def calibration_summary(comparisons: DataFrame, labels: DataFrame) -> DataFrame:
    """Per game: matched, mismatched, missing, ignored, and field accuracy."""
    counts = comparisons.groupBy("game_id").agg(
        *(
            F.count_if(F.col("status") == status).alias(name)
            for status, name in (
                ("match", "matched_fields"),
                ("mismatch", "mismatched_fields"),
                ("missing", "missing_fields"),
            )
        ),
        F.count("*").alias("_compared"),
    )
    sizes = labels.groupBy("game_id").agg(F.count("*").alias("expected_plays"))
    zero = F.lit(0).cast("bigint")
    done = sizes.join(counts, "game_id", "left")
    names = ("matched_fields", "mismatched_fields", "missing_fields", "_compared")
    done = done.withColumns({n: F.coalesce(n, zero) for n in names})
    share = F.try_divide(F.col("matched_fields").cast("double"), F.col("_compared"))
    return done.select(
        "game_id",
        "expected_plays",
        *names[:3],
        (F.col("expected_plays") * len(C.CALIBRATED_FIELDS) - F.col("_compared")).alias(
            "ignored_unlabeled_fields"
        ),
        F.coalesce(F.round(share, 4), F.lit(0.0)).alias("field_accuracy"),
    )

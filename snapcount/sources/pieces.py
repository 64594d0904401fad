"""Large JSON files in many tasks: one object with a long array of objects, read by byte ranges.

Spark reads a JSON document that is not one line in one task. Here a file is read as text that ends at every closing
brace, by byte ranges. Tasks list and read the files, as the driver cannot hold the ranges of very many. Where a piece
starts (inside a string or not, and how deep) follows from sums over the pieces before it: within a byte range for both
cases, as the range may begin inside a string, and then over the ranges of the file. Pieces then are put together to elements, each parsed alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import closing
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from snapcount.session import cut, ship_package, spread
from snapcount.sources.stores import store

PLACE = ["_block", "_seq"]
BLOCK = ["_file", "_block"]
# Bytes that are read at once, and rows and bytes that a task hands on at once.
CHUNK_BYTES = 1 << 20
BATCH_ROWS = 4096
# Least size of a range, unless the session's setting is smaller.
LEAST_RANGE = 4 << 20


def _bare(text: Column, quoted: bool) -> Column:
    """Text without strings and escapes; ``quoted`` if it begins inside a string."""
    plain = F.regexp_replace(text, r"(?s)\\.", "")
    return F.regexp_replace(F.concat(F.lit('"'), plain) if quoted else plain, r'"[^"]*+"?', "")


def _count(text: Column, of: str) -> Column:
    return F.length(text) - F.length(F.translate(text, of, ""))


def _before(*order: str) -> WindowSpec:
    """The rows before, by the last of the columns, within the file and the others."""
    return Window.partitionBy("_file", *order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)


def _so_far(value: Column, window: WindowSpec) -> Column:
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def _most_bytes(spark: SparkSession) -> int:
    """Bytes of a range at most, as the session has it for its own readers."""
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _path, _block, _end): byte ranges of the files at ``path``, listed by a task."""
    ship_package(spark)
    most, tasks = _most_bytes(spark), spark.sparkContext.defaultParallelism
    names = ["_file", "_path", "_block", "_end"]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            system, root = store(path)
            one = system.get_file_info(root)
            found = [one] if one.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root))
            found = [i for i in found if i.type == fs.FileType.File and i.size and not i.base_name.startswith(("_", "."))]
            size = min(most, max(LEAST_RANGE, sum(i.size for i in found) // tasks))
            for at in range(0, len(found), BATCH_ROWS):
                rows = [(quote(i.path), i.path, b, min(b + size, i.size)) for i in found[at : at + BATCH_ROWS] for b in range(0, i.size, size)]
                yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*rows, strict=True)], names=names)

    one = spark.range(1).coalesce(1)
    return cut(one.mapInArrow(listed, "_file string, _path string, _block long, _end long"))


def texts_of_range(source: pa.NativeFile, begin: int, end: int) -> Iterator[bytes]:
    """The texts between closing braces that begin within a byte range, without their brace; the last one may end without."""
    start, skipping, waiting = max(begin - 1, 0), begin > 0, []
    source.seek(start)
    while data := source.read(CHUNK_BYTES):
        waiting.append(data)
        if b"}" not in data:
            continue
        *whole, rest = b"".join(waiting).split(b"}")
        waiting = [rest]
        for text in whole:
            if not skipping:
                yield text
            skipping = False
            start += len(text) + 1
            if start >= end:
                return
    rest = b"".join(waiting)
    if rest and not skipping:
        yield rest


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _block, _seq, _text): the files between closing braces, by byte ranges."""
    if not re.search(r"[*?{\[,]", path):
        try:
            system, root = store(path)
            known = system.get_file_info(root).type != fs.FileType.NotFound
        except pa.ArrowInvalid:
            known = False
        if known:
            return _texts_by_tasks(spark, path)
    # Patterns and stores that only Spark knows are listed by the driver.
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
        F.col("value").alias("_text"),
    )


def _texts_by_tasks(spark: SparkSession, path: str) -> DataFrame:
    names = [*BLOCK, "_seq", "_text"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = store(path)[0]
        rows, held = [], 0

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*rows, strict=True)], names=names)

        for batch in batches:
            for file, place, begin, end in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                with closing(system.open_input_file(place)) as source:
                    for seq, text in enumerate(texts_of_range(source, begin, end)):
                        rows.append((file, begin, seq, text.decode("utf-8", "replace")))
                        held += len(text)
                        if len(rows) >= BATCH_ROWS or held >= CHUNK_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return spread(_ranges(spark, path), *BLOCK).mapInArrow(read, "_file string, _block long, _seq long, _text string")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of the files between closing braces, with the depth each starts at and whether in a string."""
    text = F.col("_text")
    raw = _texts(spark, path)
    quotes = _count(F.regexp_replace(text, r"(?s)\\.", ""), '"')
    measured = raw.withColumn("_quotes", quotes)
    for start in (0, 1):
        bare = _bare(text, start == 1)
        closing = F.when((F.col("_quotes") + start) % 2 == 0, 1).otherwise(0)
        measured = measured.withColumn(f"_rise{start}", _count(bare, "[{") - _count(bare, "]") - closing)
    inside = _before("_block", "_seq")
    odd = F.col("_odd") == 1
    measured = measured.withColumn("_odd", _so_far(F.col("_quotes"), inside) % 2).withColumns(
        {
            "_up0": F.when(odd, F.col("_rise1")).otherwise(F.col("_rise0")),
            "_up1": F.when(odd, F.col("_rise0")).otherwise(F.col("_rise1")),
        }
    )
    # One row for each byte range of a file.
    ranges = measured.groupBy(*BLOCK).agg(*(F.sum(c).alias(c) for c in ("_quotes", "_up0", "_up1")))
    starts = (
        ranges.withColumn("_in", _so_far(F.col("_quotes"), _before("_block")) % 2)
        .withColumn("_from", _so_far(F.when(F.col("_in") == 1, F.col("_up1")).otherwise(F.col("_up0")), _before("_block")))
        .select(*BLOCK, "_in", "_from")
    )
    placed = measured.withColumns({"_r0": _so_far(F.col("_up0"), inside), "_r1": _so_far(F.col("_up1"), inside)})
    risen = F.when(F.col("_in") == 1, F.col("_r1")).otherwise(F.col("_r0"))
    return placed.join(starts, BLOCK).select(
        "_file",
        *PLACE,
        "_text",
        (F.col("_from") + risen).alias("_depth"),
        ((F.col("_in") + F.col("_odd")) % 2 == 1).alias("_quoted"),
    )


def read_elements(spark: SparkSession, path: str, key: str, header: str, element: str) -> tuple[DataFrame, DataFrame]:
    """(``_file``, ``_header``) of each file, and (``_file``, ``_pos``, ``_element``) of the objects in its array ``key``.

    ``header`` and ``element`` are schemas; the header is the file without these objects, and is null if it is not
    JSON. ``key`` is a key of the outer object alone, and its array holds objects alone, of any depth. A file without the
    key, or with an empty array, has no elements; neither has a file that ends inside the array. An object that
    does not fit the schema is null. The header and each object are held whole; the file is not. An empty file has
    no row. The files are read twice; their pieces are written once to the checkpoint folder.
    """
    opening = rf'(?s)^(.*?"{key}"\s*:\s*\[\s*)(\{{.*)$'
    place = F.struct(*PLACE)
    between = (F.col("_depth") == 2) & ~F.col("_quoted")
    before = F.regexp_extract("_text", opening, 1)
    bare = F.when(F.col("_quoted"), _bare(before, True)).otherwise(_bare(before, False))
    inside_array = F.col("_depth") + _count(bare, "[{") - _count(bare, "]") == 2
    pieces = cut(
        _pieces(spark, path)
        .filter(~((F.col("_depth") <= 0) & (F.trim(F.translate("_text", "\r\n\t", "")) == "")))
        .withColumns(
            {
                "_opens": (F.col("_depth") <= 2) & F.col("_text").rlike(opening) & inside_array,
                "_closes": between & F.col("_text").rlike(r"^\s*\]"),
            }
        )
    )
    opened = pieces.filter("_opens").groupBy("_file").agg(F.min(place).alias("_first"))
    closed = (
        pieces.filter("_closes")
        .select("_file", place.alias("_place"))
        .join(opened, "_file")
        .filter(F.col("_place") > F.col("_first"))
        .groupBy("_file")
        .agg(F.min("_place").alias("_last"))
    )
    bounds = opened.join(closed, "_file", "left")
    bounded = pieces.withColumn("_place", place).join(bounds, "_file", "left")
    first = F.col("_place") == F.col("_first")
    within = (F.col("_place") >= F.col("_first")) & (F.col("_place") < F.col("_last"))

    def joined(text: Column) -> Column:
        listed = F.sort_array(F.collect_list(F.struct(*PLACE, text.alias("t"))))
        return F.concat_ws("", F.transform(listed, lambda piece: piece["t"]))

    closed_text = F.concat("_text", F.lit("}"))
    head = bounded.filter(~F.coalesce(within, F.lit(False)) | first)
    head_text = F.when(F.coalesce(first, F.lit(False)), F.regexp_extract("_text", opening, 1)).otherwise(closed_text)
    headers = head.groupBy("_file").agg(F.from_json(joined(head_text), header).alias("_header"))

    body = bounded.filter(within).withColumn("_starts", F.when(first | between, 1).otherwise(0))
    counted = body.groupBy(*BLOCK).agg(F.sum("_starts").alias("_n"))
    offsets = counted.select(*BLOCK, _so_far(F.col("_n"), _before("_block")).alias("_offset"))
    upto = Window.partitionBy(*BLOCK).orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    numbered = body.withColumn("_nth", F.sum("_starts").over(upto)).join(offsets, BLOCK)
    own = (
        F.when(first, F.regexp_extract(closed_text, opening, 2))
        .when(between, F.regexp_replace(closed_text, r"^[\s,]+", ""))
        .otherwise(closed_text)
    )
    elements = numbered.groupBy("_file", (F.col("_offset") + F.col("_nth") - 1).alias("_pos")).agg(
        F.from_json(joined(own), element).alias("_element")
    )
    return headers, elements

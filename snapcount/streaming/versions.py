"""Tables that a stream writes batch by batch, kept short by compaction.

A table is a folder with one part for each batch, partitioned by a bucket of the game. Two kinds: rows of a *log* all
count; of a *state*, those of the last batch that lists the game count. What a batch wrote counts once ``games`` lists
its games, which is written last; a batch that runs twice replaces its own parts.

``compact`` writes what counts as one base and lists it, again last. Readers take the last listed base and the batches after
it, so that a read touches a bounded number of batches. Parts older than the base before are removed: a
reader that began before a compaction still finds its files.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapcount.sources.stores import drop_folder, store

BUCKETS = 256
LISTED = "games"


def bucket(buckets: int = BUCKETS):
    return F.pmod(F.xxhash64("game_id"), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str) -> None:
    """Write ``rows`` by bucket, a file a bucket and more for large ones: else every task had a file for every bucket."""
    marked = rows.withColumn("bucket", bucket())
    marked.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


class Versions:
    """The tables below ``folder``; ``states`` and ``logs`` are their names."""

    def __init__(self, spark: SparkSession, folder: str, states: tuple[str, ...] = (), logs: tuple[str, ...] = ()):
        self.spark, self.folder, self.states, self.logs = spark, folder.rstrip("/"), states, logs

    def _numbers(self, name: str) -> list[int]:
        """Numbers of the finished parts of a table or of its bases."""
        system, root = store(f"{self.folder}/{name}")
        found = []
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            number = re.fullmatch(r"batch=(\d+)", info.base_name)
            if number and system.get_file_info(f"{info.path}/_SUCCESS").type == fs.FileType.File:
                found.append(int(number[1]))
        return sorted(found)

    def base(self, before: int | None = None) -> int:
        """The last listed base, -1 without one."""
        return max((n for n in self._numbers(f"{LISTED}.base") if before is None or n < before), default=-1)

    def _schema(self, name: str, new: T.StructType | None = None) -> T.StructType | None:
        system, path = store(f"{self.folder}/{name}.schema.json")
        if new is not None:
            with system.open_output_stream(path) as out:
                out.write(new.json().encode())
            return new
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with system.open_input_stream(path) as data:
            return T.StructType.fromJson(json.loads(data.read()))

    def write(self, name: str, rows: DataFrame, batch: int) -> None:
        """Replace what ``batch`` has in a table. ``rows`` have ``game_id`` and no columns ``batch`` and ``bucket``."""
        if self._schema(name) is None:
            system, root = store(self.folder)
            system.create_dir(root, recursive=True)
            self._schema(name, rows.schema)
        _write(rows, f"{self.folder}/{name}/batch={batch}")

    def finish(self, games: DataFrame, batch: int) -> None:
        """Let what ``batch`` wrote count, for these games."""
        self.write(LISTED, games.select("game_id"), batch)

    def rows(
        self, name: str, before: int | None = None, buckets: list[int] | None = None, base: int | None = None
    ) -> DataFrame | None:
        """All rows of a table with their ``batch`` and ``bucket``; None if it was never written."""
        schema = self._schema(name)
        if schema is None:
            return None
        base = self.base(before) if base is None else base
        schema = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.IntegerType())])
        parts = []
        for root, wanted in (
            (f"{name}.base", [base] if base >= 0 else []),
            (name, [n for n in self._numbers(name) if n > base and (before is None or n < before)]),
        ):
            if wanted:
                paths = [f"{self.folder}/{root}/batch={n}" for n in wanted]
                reader = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{root}")
                parts.append(reader.parquet(*paths))
        if not parts:
            return self.spark.createDataFrame([], schema)
        found = reduce(DataFrame.unionByName, parts)
        return found if buckets is None else found.filter(F.col("bucket").isin(buckets))

    def latest(
        self, name: str, before: int | None = None, buckets: list[int] | None = None, base: int | None = None
    ) -> DataFrame | None:
        """Rows of a state: of each game, those of the last batch that lists it."""
        rows, listed = self.rows(name, before, buckets, base), self.rows(LISTED, before, buckets, base)
        if rows is None or listed is None:
            return None
        last = listed.groupBy("game_id").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["game_id", "batch"]).drop("batch", "bucket")

    def compact(self, batch: int) -> None:
        """Make everything up to ``batch`` one base, from the base before: it may run again."""
        older = self.base(batch)
        for name in (*self.states, *self.logs):
            rows = (self.latest if name in self.states else self.rows)(name, batch + 1, base=older)
            if rows is None:
                continue
            _write(rows.drop("batch", "bucket"), f"{self.folder}/{name}.base/batch={batch}")
        listed = self.rows(LISTED, batch + 1, base=older)
        if listed is None:
            return
        _write(listed.select("game_id").distinct(), f"{self.folder}/{LISTED}.base/batch={batch}")
        for name in (*self.states, *self.logs, LISTED):
            for root, last in ((name, older), (f"{name}.base", older - 1)):
                for number in self._numbers(root):
                    if number <= last:
                        drop_folder(f"{self.folder}/{root}/batch={number}")

"""Files that tasks write under their own names in a shared store, made visible together.

Spark's writers choose file names themselves. Where a name matters, tasks write to a staging folder, under names that
no other attempt uses, and return what they wrote as rows. These rows, once written as a table, say which files
count: files of lost or repeated attempts are not in it. ``publish`` moves the listed files to their names in a
second job. A move that has been done before is left alone, so the job may run again after a loss of executors.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcount.session import checkpoint_dir, cut, ship_package, spread


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file, and its path there."""
    system, path = fs.FileSystem.from_uri(uri)
    return system, path.rstrip("/") or "/"


def staging_folder(spark: SparkSession, folder: str | None = None) -> str:
    """A new folder for unfinished files: beside the files of ``folder``, or in the checkpoint folder."""
    base = folder or checkpoint_dir(spark)
    return f"{base.rstrip('/')}/_staging-{uuid.uuid4().hex}"


def publish(files: DataFrame, staging: str, folder: str) -> int:
    """Move the files of ``files`` (``staged``, ``name``) from ``staging`` to their names under ``folder``.

    An older file of the same name is replaced. Names are relative paths. Returns the number of names.
    """
    ship_package(files.sparkSession)
    schema = "name string"

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        _, unfinished = store(staging)
        for batch in batches:
            for staged, name in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                source, target = posixpath.join(unfinished, staged), posixpath.join(root, name)
                system.create_dir(posixpath.dirname(target), recursive=True)
                # A missing source was moved by an earlier attempt, or is being moved by another one.
                if system.get_file_info(source).type != fs.FileType.NotFound:
                    try:
                        system.move(source, target)
                    except OSError:
                        if system.get_file_info(target).type == fs.FileType.NotFound:
                            raise
                elif system.get_file_info(target).type == fs.FileType.NotFound:
                    raise FileNotFoundError(target)
            yield pa.RecordBatch.from_arrays([batch.column(1)], names=["name"])

    moved = spread(files.select("staged", "name").distinct(), "name").mapInArrow(move, schema).count()
    drop_folder(staging)
    return moved


def drop_folder(folder: str) -> None:
    """Remove a folder of unfinished files, if it is there."""
    system, path = store(folder)
    with suppress(FileNotFoundError):
        system.delete_dir(path)


def write_named(rows: DataFrame, name: str, order: list[str], folder: str) -> int:
    """Write one CSV file with a header for each value of the column ``name``, a relative path below ``folder``.

    The rows of a file are in order of ``order``. Files are written as by ``write_lines``.
    """
    columns = [c for c in rows.columns if c != name]
    lines = rows.select(F.col(name).alias("__name"), *order, F.to_csv(F.struct(*columns)).alias("__line"))
    return write_lines(lines, order, folder, [",".join(columns)])


def write_lines(lines: DataFrame, order: list[str], folder: str, first: list[str]) -> int:
    """Write one text file for each ``__name``, a relative path below ``folder``: ``first``, then each ``__line`` by ``order``.

    A file is written by one task, line by line, so its lines are never held together. Files of the same names are
    replaced, others stay; lines without a name are left out. A run that fails before all files are written leaves
    nothing.
    """
    spark = lines.sparkSession
    ship_package(spark)
    staging = staging_folder(spark, folder)
    header = "".join(f"{line}\n" for line in first)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(staging)
        system.create_dir(root, recursive=True)
        current, out = None, None
        for batch in batches:
            begun = []
            for file, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != current:
                    if out is not None:
                        out.close()
                    current, staged = file, uuid.uuid4().hex
                    out = system.open_output_stream(posixpath.join(root, staged))
                    out.write(header.encode())
                    begun.append((staged, file))
                out.write(f"{line}\n".encode())
            yield pa.RecordBatch.from_arrays([pa.array([b[i] for b in begun], pa.string()) for i in (0, 1)], names=["staged", "name"])
        if out is not None:
            out.close()

    named = spread(lines.filter(F.col("__name").isNotNull()), "__name")
    ordered = named.sortWithinPartitions("__name", *order).select("__name", "__line")
    return publish(cut(ordered.mapInArrow(each, "staged string, name string")), staging, folder)



class Conflict(RuntimeError):
    """Someone else has committed this version."""


def create_once(spark: SparkSession, uri: str, data: bytes) -> None:
    """Create a file with this content, or fail with ``Conflict`` if it is there: of several writers one succeeds."""
    system, path = store(uri)
    system.create_dir(posixpath.dirname(path), recursive=True)
    unfinished = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(unfinished) as out:
        out.write(data)
    try:
        if isinstance(system, fs.LocalFileSystem):
            os.link(unfinished, path)
            return
        jvm = spark._jvm.org.apache.hadoop.fs
        context = jvm.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
        none = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
        none[0] = jvm.Options.Rename.NONE
        source = f"{uri.rstrip('/')}{unfinished.removeprefix(path)}"
        context.rename(jvm.Path(source), jvm.Path(uri), none)
    except Exception as error:
        if system.get_file_info(path).type != fs.FileType.NotFound:
            raise Conflict(uri) from error
        raise
    finally:
        with suppress(FileNotFoundError):
            system.delete_file(unfinished)


class Snapshots:
    """A table of which every version is whole: numbered folders, and a pointer file for each that is committed.

    A writer makes a folder of its own and then creates the pointer of the next version, which only one writer can.
    Readers take the last pointer. The last ``keep`` versions stay.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 10):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def versions(self) -> list[int]:
        system, root = store(f"{self.folder}/_versions")
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(int(info.base_name) for info in found if info.base_name.isdigit())

    def read(self, version: int | None = None) -> DataFrame | None:
        """The last version (or ``version``); None if there is none."""
        known = self.versions()
        if not known:
            return None
        system, path = store(f"{self.folder}/_versions/{known[-1] if version is None else version:08d}")
        with system.open_input_stream(path) as data:
            return self.spark.read.parquet(f"{self.folder}/{data.read().decode()}")

    def write(self, rows: DataFrame, after: int) -> int:
        """Commit ``rows`` as the version after ``after`` (-1: the first); ``Conflict`` if there is one already."""
        name = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        try:
            create_once(self.spark, f"{self.folder}/_versions/{after + 1:08d}", name.encode())
        except Conflict:
            drop_folder(f"{self.folder}/{name}")
            raise
        for old in self.versions()[: -self.keep]:
            system, path = store(f"{self.folder}/_versions/{old:08d}")
            with system.open_input_stream(path) as data:
                gone = data.read().decode()
            system.delete_file(path)
            drop_folder(f"{self.folder}/{gone}")
        return after + 1

    def change(self, work, attempts: int = 20) -> int:
        """Commit ``work(rows)``, where rows are the last version (None at first); again if another writer was faster."""
        for _ in range(attempts):
            last = max(self.versions(), default=-1)
            try:
                return self.write(work(None if last < 0 else self.read(last)), last)
            except Conflict:
                continue
        raise Conflict(f"{self.folder}: {attempts} attempts")

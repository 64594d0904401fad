"""Session helpers: checkpoints, shipped code, and checked sizes."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Names of a catalog or channel list that may be broadcast (a few MB at most).
BROADCAST_ROWS = 100_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a session on one machine may go without a setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="snapcount-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the checkpoint folder and go on from there.

    A table, unlike an RDD checkpoint, is columnar, so later steps read only the
    columns they use; and it survives the loss of executors.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/snapcount-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by ``keys`` before Python work.

    With a given number of partitions, adaptive execution does not merge them:
    their bytes are few, but each row costs much more than a byte count shows.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(count, *keys)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers on every executor."""
    root = Path(__file__).resolve().parent
    shipped = getattr(spark.sparkContext, "_snapcount_shipped", None)
    if shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="snapcount-code-")) / "snapcount.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._snapcount_shipped = True


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows, reading no more than needed."""
    return df.limit(rows + 1).count() <= rows

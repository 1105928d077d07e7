"""Helpers that the operators of this package share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many rows (of a few numbers each) may be broadcast.
BROADCAST_ROWS = 100_000
#: Whether an action removes its shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one, but only if all tasks run on this machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="strandline-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared checkpoint folder.

    The folder is that of ``shared_folder``.  Spark removes the files
    when nothing refers to the rows any more, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.  The shuffle
    files that the rows came through go as soon as the rows are written, not
    when the driver next collects its garbage.
    """
    conf = df.sparkSession.conf
    shared_folder(df.sparkSession)
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        # A new reference: one that is executed again must not find its shuffle files gone.
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.set(CLEANUP, before)


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already durable) with a broadcast hint if its counted rows are within the bound, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name

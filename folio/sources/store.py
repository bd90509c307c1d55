"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where that is unset (one machine)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="folio-"))
    return sc.getCheckpointDir()


def small_batches(spark: SparkSession, limit: str = "4m") -> None:
    """Arrow batches bound by bytes, for the session: a task then holds some texts at a time, not ten thousand."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)


def snapshot(spark: SparkSession, path: str) -> str:
    """A name for the files below a folder as they are: it changes with any file's name, size or time. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)").alias("h"))
    n, total = files.agg(F.count("*"), F.coalesce(F.sum("h"), F.lit(0))).first()
    return f"{n}-{int(total) % (1 << 64):016x}"


def cut(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(rows: DataFrame, most: int = 500_000) -> DataFrame:
    """``rows`` written once, for a join with a large table: sent to the tasks if there are at most ``most``, so that the large table is
    not shuffled for them; else joined as usual."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= most else rows

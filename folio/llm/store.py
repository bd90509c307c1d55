"""Where intermediate rows live, and how rows are dealt out by id."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, limit: str = "4m") -> None:
    """Arrow batches bound by bytes, for the session: a task then holds a few long texts at a time, not ten thousand."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)


def own_columns(df: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def with_fields(df: DataFrame, **more: str) -> T.StructType:
    """The schema of ``df`` with further fields of the given DDL types."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, T.DataType.fromDDL(v)) for k, v in more.items())])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one where that is unset on one machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="folio-"))
    return sc.getCheckpointDir()


#: Spark then deletes a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage; the shuffle files it took go at once."""
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query takes the setting from the time it is made
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


#: A table of at most so many rows of bounded size is sent to all tasks; a larger one is joined by shuffle.
FEW = 20_000


def join_sized(rows: DataFrame, few: DataFrame, keys: list[str], size: int, how: str = "inner", salts: int = 16) -> DataFrame:
    """A join with a table of ``size`` rows, one per key: sent to all tasks if it is small, else salted, so that a hot key is no
    single task."""
    if size <= FEW:
        return rows.join(F.broadcast(few), keys, how)
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(spread, [*keys, "_salt"], how).drop("_salt")


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], spread_by: str, n: str = "n", most: int = 2000) -> DataFrame:
    """A join with a table of one row per key that says in ``n`` how many rows have the key.

    Keys of more than ``most`` rows (or a 10,000th of all, if that is more) are dealt over several tasks by a hash of ``spread_by``. There
    are at most 10,000 of them, so their list is sent to all tasks.
    """
    total = counted.agg(F.sum(n)).first()[0] or 0
    most = max(most, -(-total // 10_000))
    parts = F.when(F.col(n) > most, F.ceil(F.col(n) / most)).otherwise(1).cast("int")
    hot = counted.where(F.col(n) > most).select(*keys, parts.alias("_parts"))
    salt = F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_parts").cast("long")), F.lit(0)).cast("int")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_parts")
    return dealt.join(counted.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))), [*keys, "_salt"]).drop("_salt")


def join_dealt(rows: DataFrame, table: DataFrame, keys: list[str], sizes: DataFrame, spread_by: str, n: str = "n", most: int = 2000) -> DataFrame:
    """A join with a table of one row per key, of which ``sizes`` (keys, n) says how many rows have the key; hot keys as in ``join_counted``.

    Only ``sizes`` is read more than once, so ``table`` may be wide and need not be written.
    """
    total = sizes.agg(F.sum(n)).first()[0] or 0
    most = max(most, -(-total // 10_000))
    hot = F.broadcast(sizes.where(F.col(n) > most).select(*keys, F.ceil(F.col(n) / most).cast("int").alias("_parts")))
    salt = F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_parts").cast("long")), F.lit(0)).cast("int")
    dealt = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_parts")
    copies = table.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")


def range_bounds(ids: DataFrame, col: str, rows_per_range: int = 1000, max_ranges: int = 1 << 16) -> np.ndarray:
    """Lower bounds of ranges of ``col`` that hold about ``rows_per_range`` rows each.

    At most ``max_ranges`` longs reach the driver. Nulls have no range of their own; they sort below all bounds.
    """
    n = ids.count()
    ranges = int(min(max_ranges, max(1, n // rows_per_range)))
    if ranges == 1:
        return np.empty(0, dtype=np.int64)
    at = [i / ranges for i in range(1, ranges)]
    got = ids.agg(F.percentile_approx(F.col(col).cast("long"), at, max(10_000, 4 * ranges)).alias("q")).first()["q"] or []
    return np.unique(np.asarray(got, dtype=np.int64))


def range_of(col: str, bounds: np.ndarray) -> Column:
    """Number of the range that a long falls into (0 for null)."""

    @F.pandas_udf("int")
    def find(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), dtype=np.int32)
        out[known] = np.searchsorted(bounds, ids[known].to_numpy(dtype=np.int64), side="right")
        return pd.Series(out)

    return find(F.col(col).cast("long"))


class IdFilter:
    """A fixed-size bitmap of hashed ids: says surely when an id is absent.

    ``bits`` bounds what the driver holds (``bits / 8`` bytes), whatever the number of ids.
    """

    def __init__(self, ids: DataFrame, col: str, bits: int = 1 << 25):
        self.bits = bits
        slot = F.pmod(F.xxhash64(F.col(col)), F.lit(bits))
        words = (
            ids.select(slot.alias("slot"))
            .groupBy((F.col("slot") / 32).cast("long").alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, CAST(slot % 32 AS INT)))").alias("mask"))
            .toPandas()
        )
        packed = np.zeros(bits // 32, dtype=np.uint32)
        packed[words["word"].to_numpy(dtype=np.int64)] = words["mask"].to_numpy(dtype=np.int64).astype(np.uint32)
        self.shared = ids.sparkSession.sparkContext.broadcast(packed)

    def slot(self, col: str) -> Column:
        return F.pmod(F.xxhash64(F.col(col)), F.lit(self.bits))


def may_hold(packed: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((packed[slots >> 5] >> (slots & 31).astype(np.uint32)) & 1).astype(bool)

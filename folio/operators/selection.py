"""The element of a given rank per key, without sorting a key's values in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.sources.store import cut

#: A table of at most so many keys is sent to all tasks.
FEW_KEYS = 20_000


def _with(rows: DataFrame, keys: list[str], state: DataFrame, size: int) -> DataFrame:
    """``rows`` with what ``state`` (a row per key) says of their key; null keys meet too."""
    named = state.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(named[f"_k_{k}"]) for k in keys])
    return rows.join(F.broadcast(named) if size <= FEW_KEYS else named, same).drop(*(f"_k_{k}" for k in keys))


def element_at_rank(rows: DataFrame, keys: list[str], value: str, at: Column, few: int = 10_000, bins: int = 4096, rounds: int = 64) -> DataFrame:
    """(keys, value): the element of rank ``at`` (from 0, an expression over the key's number of values ``_n``) of each key's sorted numbers.

    Histogram selection: a key with more than ``few`` values has them counted in ``bins`` equal stretches between its least and its
    greatest; the stretch that holds the rank is the next round's whole, until it holds a single number or few values, and only those
    are sorted. Tasks count before anything is shuffled, so a key of any size moves ``bins`` rows a task. Each round reads the rows
    again; a round narrows by at least one value and usually by ``bins`` times. Null values do not count; a rank outside gives no row.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    now = cut(sizes.withColumn("_at", at.cast("long")).where("_at >= 0 AND _at < _n"))
    found = []
    for _ in range(rounds):
        wide = now.where(f"_n > {few} AND _lo <> _hi")
        found.append(now.where(f"_n <= {few} OR _lo = _hi"))
        size = wide.count()
        if not size:
            break
        quarter = lambda c: F.col(c).cast("double") / 4  # noqa: E731  so that no difference overflows
        stretch = F.least(F.floor((quarter("_v") - quarter("_lo")) / (quarter("_hi") - quarter("_lo")) * bins), F.lit(bins - 1))
        inside = _with(rows, keys, wide.drop("_n"), size).where("_v BETWEEN _lo AND _hi").withColumn("_bin", stretch)
        counted = inside.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.first("_at").alias("_at"))
        upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bin"))  # a row per stretch
        now = cut(counted.withColumn("_upto", upto).where("_at < _upto AND _at >= _upto - _n").withColumn("_at", F.col("_at") - F.col("_upto") + F.col("_n")).drop("_upto", "_bin"))
    else:
        found.append(now.where(f"_n > {few} AND _lo <> _hi"))
    ranges = reduce(DataFrame.unionByName, found)
    one = ranges.where("_lo = _hi").select(*keys, F.col("_lo").alias(value))
    some = ranges.where("_lo <> _hi").drop("_n")
    inside = _with(rows, keys, some, some.count()).where("_v BETWEEN _lo AND _hi")
    placed = inside.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("_v")) - 1)  # few rows a key
    return placed.where("_place = _at").select(*keys, F.col("_v").alias(value)).unionByName(one)


def smallest(rows: DataFrame, order: Column, tie: str, target: int) -> DataFrame:
    """The ``target`` rows of the smallest hexadecimal hashes ``order``, equal hashes by ``tie``; all rows if there are fewer.

    The hash of rank ``target`` - 1 is selected by its first 12 digits; rows below it stay where they are, and only the few that share
    its digits are sorted.
    """
    keyed = rows.withColumn("_h", order).withColumn("_x", F.conv(F.substring("_h", 1, 12), 16, 10).cast("long"))
    bound = element_at_rank(keyed.withColumn("_all", F.lit(1)), ["_all"], "_x", F.least(F.lit(target), F.col("_n")) - 1).first()
    if bound is None:
        return rows.limit(0)
    below, level = keyed.where(F.col("_x") < bound["_x"]), keyed.where(F.col("_x") == bound["_x"])
    return below.unionByName(level.orderBy("_h", tie).limit(target - below.count())).drop("_h", "_x")

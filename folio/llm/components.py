"""Connected components of an edge table, without gathering any component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.store import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge: (node, component), the component being its smallest node.

    Alternates the large-star and small-star steps (Kiveris et al. 2014), each one aggregate and one join per round, so a
    node with many neighbours is split by Spark's skewed-join handling; the number of rounds grows with the logarithm of
    the diameter. No edges give no rows; loops and repeated edges count once.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = cut(edges.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct())
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        now = cut(small.distinct())
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

"""Selection by rank against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from folio.operators import datasets as D
from folio.operators import monitoring as O
from folio.operators.selection import element_at_rank, smallest


@pytest.fixture(scope="module")
def values():
    rng = random.Random(5)
    rows = [("hot", rng.gauss(0, 1) * 10 ** rng.randrange(-3, 9)) for _ in range(3000)] + [("ties", float(rng.randrange(3))) for _ in range(500)] + [("one", 7.0)] * 400
    return rows + [("few", 1.5), ("few", -2.0), (None, 4.0), (None, 5.0), (None, None), ("none", None), ("wide", -1.7e308), ("wide", 1.7e308), ("wide", 0.0), *[("wide", 1.0)] * 50]


@pytest.mark.parametrize(("p", "few", "bins"), [(0.95, 10, 4), (0.5, 1, 16), (0.0, 5, 4), (1.0, 100, 64), (0.95, 10_000, 4096)])
def test_elements_equal_sorting(spark, values, p, few, bins):
    table = spark.createDataFrame(values, "k string, v double").repartition(5)
    got = element_at_rank(table, ["k"], "v", F.floor((F.col("_n") - 1) * p), few, bins)
    want = {}
    for k in {k for k, _ in values}:
        own = sorted(v for x, v in values if x == k and v is not None)
        if own:
            want[k] = own[int((len(own) - 1) * p)]
    assert got.columns == ["k", "v"] and {r["k"]: r["v"] for r in got.collect()} == want


def test_percentile_by_key(spark, values):
    table = spark.createDataFrame(values, "k string, v double")
    assert O.lower_percentile(table, ["k"], "v", 0.95, few=50).count() == 6
    assert O.lower_percentile(table.limit(0), ["k"], "v", 0.95).collect() == []


@pytest.mark.parametrize("target", [0, 1, 7, 500, 999, 1000])
def test_smallest_hashes(spark, target):
    table = spark.range(1000).select(F.col("id"), F.lit("x").alias("extra"))
    order = F.md5(F.concat(F.lit("7|"), F.col("id").cast("string")))
    want = [r["id"] for r in table.orderBy(order, "id").limit(target).collect()]
    assert sorted(r["id"] for r in smallest(table, order, "id", target).collect()) == sorted(want)
    assert smallest(table.limit(0), order, "id", 5).collect() == []


def test_repeated_ids_are_sampled_to_size(spark):
    table = spark.range(40).select((F.col("id") % 4).alias("id"))
    assert D.sample_exactly(table, 13, 1).count() == 13
    with pytest.raises(ValueError, match="fewer"):
        D.sample_exactly(table, 41, 1)

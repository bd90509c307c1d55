"""API, log, task and health analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.datasets import numbered
from folio.operators.selection import element_at_rank

LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s*\|\s*(\w+)\s*\|\s*([^ ]+) - (.*)$"
LEVELS = {"L0": (True, True, 8, 0), "L1": (False, True, 5, 0), "L2": (False, False, 3, 0), "L3": (False, False, 2, 2)}


def lower_percentile(rows: DataFrame, keys: list[str], value: str, p: float, few: int = 10_000) -> DataFrame:
    """(keys, pct): the element int((n - 1) * p) of each key's sorted values, selected by histograms. Null values do not count."""
    return element_at_rank(rows, keys, value, F.floor((F.col("_n") - 1) * p), few).withColumnRenamed(value, "pct")


def request_totals() -> list[Column]:
    return [F.count("*").alias("requests"), F.count_if("is_error").alias("errors"), F.round(F.avg("duration_ms"), 8).alias("avg_ms")]


def parse_logs(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ts, level, module and message; lines of another form go."""
    part = lambda k: F.regexp_extract(raw, LOG_LINE, k)
    good = lines.where(F.col(raw).rlike(LOG_LINE))
    return good.withColumns({"ts": F.to_timestamp(part(1), "yyyy-MM-dd HH:mm:ss"), "level": F.upper(part(2)), "module": part(3), "message": part(4)})


def alerts(metrics: DataFrame, key: str) -> DataFrame:
    """(key, type, level): one row per threshold that a sample breaks."""
    rule = lambda hit, kind, level: F.when(hit, F.struct(F.lit(kind).alias("type"), F.lit(level).alias("level")))
    rules = F.array(
        rule(F.col("cpu") > 80, "cpu", "warning"), rule(F.col("mem") > 90, "memory", "critical"), rule(F.col("backlog") > 100, "queue", "critical"), rule(F.col("pool_exhausted"), "database", "critical"),
    )
    return metrics.select(key, F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("a")).select(key, "a.type", "a.level")


def degradation(metrics: DataFrame) -> DataFrame:
    """Adds the level of each sample and the flags that go with it."""
    level = F.when(F.col("pool_exhausted"), "L3").when((F.col("cpu") > 90) | (F.col("mem") > 90) | (F.col("backlog") > 100), "L2").when(F.col("cpu") > 80, "L1").otherwise("L0")
    flag = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in LEVELS.items() for x in (k, v[i]))), F.col("degradation"))
    return metrics.withColumn("degradation", level).withColumns({"recommendations": flag(0), "rerank": flag(1), "top_k": flag(2), "max_queries": flag(3)})


def level_changes(levels: DataFrame, order: list[str], block: int = 100_000) -> DataFrame:
    """Rows whose level differs from the one before in the whole order; ``before`` is null on the first row.

    Rows are numbered over range partitions; a block of neighbours meets in one task and gets the last level of the block before.
    """
    placed = numbered(levels, *map(F.col, order)).withColumn("_block", F.floor(F.col("place") / block))
    last = placed.where(F.col("place") % block == block - 1).select((F.col("_block") + 1).alias("_block"), F.col("degradation").alias("_carried"))
    inside = F.lag("degradation").over(Window.partitionBy("_block").orderBy("place"))
    before = placed.withColumn("_inside", inside).join(last, "_block", "left").withColumn("before", F.coalesce("_inside", "_carried"))
    return before.where(F.col("before").isNull() | (F.col("before") != F.col("degradation"))).drop("_block", "_inside", "_carried", "place")


def service_health(outcomes: DataFrame, last: int = 50) -> DataFrame:
    """(service, samples, error_rate, streak, duration_s, healthy) after each service's last outcomes.

    ``outcomes`` has (service, seq, ok, duration_s). Only each task's ``last`` newest outcomes of a service are shuffled.
    """
    newest = F.row_number().over(Window.partitionBy("service").orderBy(F.desc("seq")))
    tail = outcomes.withColumn("_k", newest).where(F.col("_k") <= last)
    made = tail.groupBy("service").agg(
        F.count("*").alias("samples"), F.avg((~F.col("ok")).cast("double")).alias("error_rate"), (F.coalesce(F.min(F.when(F.col("ok"), F.col("_k"))), F.count("*") + 1) - 1).alias("streak"), F.max_by("duration_s", "seq").alias("duration_s"),
    )
    sick = (F.col("streak") > 5) | ((F.col("samples") >= 6) & (F.col("error_rate") > 0.5)) | (F.col("duration_s") > 10)
    return made.select("service", "samples", F.round("error_rate", 4).alias("error_rate"), F.col("streak").cast("long").alias("streak"), F.round("duration_s", 4).alias("duration_s"), (~sick).alias("healthy"))

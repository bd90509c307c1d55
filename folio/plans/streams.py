"""Queries that run the streaming jobs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.plans.administration import BATCH
from folio.plans.monitoring import HEALTH, TREND
from folio.plans.registry import Tables, query
from folio.streaming import jobs as J


def stream(t: Tables, name: str) -> DataFrame:
    rows = J.read_stream(t.spark, f"{t.sf_dir}/{name}.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else rows


def api_log(t: Tables) -> DataFrame:
    rows = stream(t, "events")
    return rows.select("ts", F.concat(F.lit("GET /"), "event_type").alias("endpoint"), F.col("value").alias("duration_ms"), (F.col("event_type") == "error").alias("is_error"))


@query(f"WITH m AS ({TREND}) SELECT * FROM m WHERE minute + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def w01_minute_trend(t: Tables) -> DataFrame:
    return J.minute_trend(t.spark, api_log(t))


@query("""WITH w AS (SELECT *, to_timestamp(floor(epoch(ts) / 600) * 600 - k * 600) AT TIME ZONE 'UTC' AS start FROM {f_api_log}, range(6) r(k))
SELECT start, endpoint, count(*) AS requests, count(*) FILTER (is_error) AS errors, round(avg(duration_ms), 8) AS avg_ms FROM w GROUP BY ALL""")
def w02_rolling_report(t: Tables) -> DataFrame:
    return J.rolling_report(t.spark, api_log(t))


@query(f"WITH {BATCH}".replace(", (epoch(max(b)) - epoch(min(a)))::BIGINT AS seconds", ""))
def w03_batch_progress(t: Tables) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "failed").when(F.col("l_returnflag") == "R", "completed").otherwise("processing")
    rows = stream(t, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("document_no"), status.alias("status"), F.col("l_shipdate").alias("ts"))
    return J.batch_progress(t.spark, rows)


@query("SELECT user_id, question, document_id, query_count, last_queried, created_at FROM {f_query_history}")
def w04_history_counter(t: Tables) -> DataFrame:
    asked = F.expr("concat(event_type, ' question ', CAST(floor(value/50) AS INT))")
    return J.history_counter(t.spark, stream(t, "events").select("user_id", asked.alias("question"), (F.col("user_id") % 20).alias("document_id"), "ts"))


@query()
def w05_ingest(t: Tables) -> DataFrame:
    chunks, status = J.ingest(t.spark, stream(t, "documents"))
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return status.join(counts, "doc_id", "left").select("doc_id", "status", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query(f"WITH {HEALTH}")
def w06_service_health(t: Tables) -> DataFrame:
    rows = stream(t, "events")
    outcomes = rows.select(F.col("event_type").alias("service"), F.col("event_id").alias("seq"), (F.col("value") % 7 >= 3).alias("ok"), (F.col("value") / 40).alias("duration_s"))
    return J.service_health(t.spark, outcomes)


@query("""WITH RECURSIVE k AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY user_id, event_type
UNION ALL SELECT k.user_id, k.event_type, min(e.ts) FROM k JOIN events e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts > k.ts + INTERVAL 600 SECOND GROUP BY k.user_id, k.event_type)
SELECT user_id, event_type, ts FROM k""")
def w07_idempotent(t: Tables) -> DataFrame:
    return J.idempotent(t.spark, stream(t, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"])

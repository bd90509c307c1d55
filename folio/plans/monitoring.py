"""Queries of monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.operators import monitoring as O
from folio.plans.registry import Tables, query

HORIZON = "ts >= TIMESTAMP '2024-01-10 00:00:00'"
_LOG = r"lg AS (SELECT event_id, strptime(regexp_extract(raw, '^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})', 1), '%Y-%m-%d %H:%M:%S') AS ts, upper(regexp_extract(raw, '\|\s*(\w+)\s*\|', 1)) AS level, regexp_extract(raw, '\|\s*\w+\s*\|\s*([^ ]+) - ', 1) AS module, regexp_extract(raw, '\|\s*\w+\s*\|\s*[^ ]+ - (.*)$', 1) AS message FROM {f_log_lines} WHERE raw LIKE '%|%|%')"


@query(f"""WITH l AS (SELECT * FROM {{f_api_log}} WHERE {HORIZON}) SELECT count(*) AS requests, count(*) FILTER (is_error) AS errors, round(avg(duration_ms), 8) AS avg_ms, round(count(*) FILTER (is_error) / count(*), 4) AS error_rate,
(SELECT v FROM (SELECT duration_ms AS v, row_number() OVER (ORDER BY duration_ms) - 1 AS k, count(*) OVER () AS n FROM l) WHERE k = floor((n - 1) * 0.95)) AS p95_ms, count(DISTINCT CASE WHEN user_id <> 'anonymous' THEN user_id END) AS users FROM l""")
def o01_api_summary(t: Tables) -> DataFrame:
    rows = t("f_api_log").where(HORIZON)
    known = F.when(F.col("user_id") != "anonymous", F.col("user_id"))
    made = rows.agg(*O.request_totals(), F.round(F.count_if("is_error") / F.count("*"), 4).alias("error_rate"), F.count_distinct(known).alias("users"))
    p95 = O.lower_percentile(rows.withColumn("scope", F.lit("all")), ["scope"], "duration_ms", 0.95).withColumnRenamed("pct", "p95_ms")
    return made.withColumn("scope", F.lit("all")).join(p95, "scope").drop("scope")


@query("""WITH k AS (SELECT endpoint, duration_ms AS v, row_number() OVER (PARTITION BY endpoint ORDER BY duration_ms) - 1 AS k, count(*) OVER (PARTITION BY endpoint) AS n FROM {f_api_log}),
c AS (SELECT endpoint, string_agg(concat(status_code, '=', n), ',' ORDER BY status_code) AS codes FROM (SELECT endpoint, status_code, count(*) AS n FROM {f_api_log} GROUP BY ALL) GROUP BY endpoint)
SELECT a.endpoint, count(*) AS requests, count(*) FILTER (is_error) AS errors, round(avg(duration_ms), 8) AS avg_ms, any_value(p.v) AS p95_ms, any_value(codes) AS codes FROM {f_api_log} a JOIN c USING (endpoint) JOIN (SELECT endpoint, v FROM k WHERE k = floor((n - 1) * 0.95)) p USING (endpoint) GROUP BY a.endpoint""")
def o02_endpoint_stats(t: Tables) -> DataFrame:
    rows = t("f_api_log")
    codes = rows.groupBy("endpoint", "status_code").agg(F.count("*").alias("n")).groupBy("endpoint").agg(F.array_sort(F.collect_list(F.struct("status_code", "n"))).alias("c"))
    named = F.array_join(F.transform("c", lambda x: F.concat(x["status_code"], F.lit("="), x["n"])), ",")
    p95 = O.lower_percentile(rows, ["endpoint"], "duration_ms", 0.95).withColumnRenamed("pct", "p95_ms")
    return rows.groupBy("endpoint").agg(*O.request_totals()).join(p95, "endpoint").join(codes.select("endpoint", named.alias("codes")), "endpoint")


@query("SELECT user_id, count(*) AS requests FROM {f_api_log} GROUP BY user_id ORDER BY requests DESC, user_id LIMIT 20")
def o03_top_users(t: Tables) -> DataFrame:
    return t("f_api_log").groupBy("user_id").agg(F.count("*").alias("requests")).orderBy(F.desc("requests"), "user_id").limit(20)


TREND = "SELECT date_trunc('minute', ts) AS minute, count(*) AS requests, count(*) FILTER (is_error) AS errors, round(avg(duration_ms), 8) AS avg_ms FROM {f_api_log} GROUP BY ALL"


@query(TREND)
def o04_minute_trend(t: Tables) -> DataFrame:
    return t("f_api_log").groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(*O.request_totals())


@query("WITH k AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) SELECT user_id, event_type, value AS pct FROM k WHERE k = floor((n - 1) * 0.95)")
def o05_percentile(t: Tables) -> DataFrame:
    return O.lower_percentile(t("events"), ["user_id", "event_type"], "value", 0.95)


@query("SELECT status, count(*) FILTER (seconds < 1) AS under_1, count(*) FILTER (seconds >= 1 AND seconds < 3) AS under_3, count(*) FILTER (seconds >= 3 AND seconds < 10) AS under_10, count(*) FILTER (seconds >= 10) AS from_10 FROM {f_batch_events} GROUP BY status")
def o06_runtime_histogram(t: Tables) -> DataFrame:
    s = F.col("seconds")
    return t("f_batch_events").groupBy("status").agg(F.count_if(s < 1).alias("under_1"), F.count_if((s >= 1) & (s < 3)).alias("under_3"), F.count_if((s >= 3) & (s < 10)).alias("under_10"), F.count_if(s >= 10).alias("from_10"))


@query("""SELECT * FROM (SELECT 'batch' AS source, batch_id, document_no, ts FROM {f_batch_events} WHERE status = 'failed' UNION ALL SELECT 'runtime', batch_id, document_no, ts FROM {f_batch_events} WHERE status = 'processing' AND seconds > 45)
ORDER BY ts DESC, batch_id, document_no, source LIMIT 100""")
def o07_failed_tasks(t: Tables) -> DataFrame:
    rows, cols = t("f_batch_events"), ["batch_id", "document_no", "ts"]
    failed = rows.where("status = 'failed'").select(F.lit("batch").alias("source"), *cols)
    stuck = rows.where("status = 'processing' AND seconds > 45").select(F.lit("runtime").alias("source"), *cols)
    return failed.unionByName(stuck).orderBy(F.desc("ts"), "batch_id", "document_no", "source").limit(100)


@query("""WITH a AS (SELECT l_suppkey AS worker, count(*) AS processed FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), b AS (SELECT l_suppkey AS worker, count(*) AS active FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber > 5 GROUP BY ALL)
SELECT worker, coalesce(processed, 0) AS processed, coalesce(active, 0) AS active, active IS NOT NULL AS healthy FROM a FULL OUTER JOIN b USING (worker)""")
def o08_worker_rollup(t: Tables) -> DataFrame:
    rows = t("lineitem")
    done = rows.where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("worker")).agg(F.count("*").alias("processed"))
    busy = rows.where("l_returnflag = 'N' AND l_linenumber > 5").groupBy(F.col("l_suppkey").alias("worker")).agg(F.count("*").alias("active"))
    both = done.join(busy, "worker", "full_outer")
    return both.select("worker", F.coalesce("processed", F.lit(0)).alias("processed"), F.coalesce("active", F.lit(0)).alias("active"), F.col("active").isNotNull().alias("healthy"))


@query(f"WITH {_LOG} SELECT event_id, ts, level, message FROM lg WHERE level IN ('ERROR', 'WARNING') AND {HORIZON} AND contains(lower(message), 'value') AND regexp_matches(message, 'value \\d+5$') ORDER BY ts DESC, event_id LIMIT 50")
def o09_log_search(t: Tables) -> DataFrame:
    rows = O.parse_logs(t("f_log_lines")).where(F.col("level").isin("ERROR", "WARNING")).where(HORIZON)
    rows = rows.where(F.contains(F.lower("message"), F.lit("value")) & F.col("message").rlike(r"value \d+5$"))
    return rows.orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "ts", "level", "message")


@query(f"""WITH {_LOG}, g AS (SELECT 'level' AS kind, level AS name, count(*) AS n FROM lg GROUP BY ALL UNION ALL SELECT 'hour', strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00'), count(*) FROM lg GROUP BY ALL
UNION ALL SELECT * FROM (SELECT 'type', left(split_part(message, ':', 1), 120) AS name, count(*) AS n FROM lg GROUP BY ALL ORDER BY n DESC, name LIMIT 10)) SELECT * FROM g""")
def o10_log_summary(t: Tables) -> DataFrame:
    rows = O.parse_logs(t("f_log_lines"))
    count = lambda kind, c: rows.groupBy(c.alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    types = count("type", F.left(F.substring_index("message", ":", 1), F.lit(120))).orderBy(F.desc("n"), "name").limit(10)
    return count("level", F.col("level")).unionByName(count("hour", F.date_format("ts", "yyyy-MM-dd HH:00"))).unionByName(types)


@query("""SELECT event_id, 'cpu' AS type, 'warning' AS level FROM {f_metrics} WHERE cpu > 80 UNION ALL SELECT event_id, 'memory', 'critical' FROM {f_metrics} WHERE mem > 90
UNION ALL SELECT event_id, 'queue', 'critical' FROM {f_metrics} WHERE backlog > 100 UNION ALL SELECT event_id, 'database', 'critical' FROM {f_metrics} WHERE pool_exhausted""")
def o11_alerts(t: Tables) -> DataFrame:
    return O.alerts(t("f_metrics"), "event_id")


@query("""WITH l AS (SELECT event_id, ts, CASE WHEN pool_exhausted THEN 'L3' WHEN cpu > 90 OR mem > 90 OR backlog > 100 THEN 'L2' WHEN cpu > 80 THEN 'L1' ELSE 'L0' END AS degradation FROM {f_metrics})
SELECT event_id, degradation, before, CASE degradation WHEN 'L0' THEN 8 WHEN 'L1' THEN 5 WHEN 'L2' THEN 3 ELSE 2 END AS top_k, degradation = 'L0' AS recommendations, degradation IN ('L0', 'L1') AS rerank FROM
(SELECT *, lag(degradation) OVER (ORDER BY ts, event_id) AS before FROM l) WHERE before IS NULL OR before <> degradation""")
def o12_degradation(t: Tables) -> DataFrame:
    return O.level_changes(O.degradation(t("f_metrics")), ["ts", "event_id"]).select("event_id", "degradation", "before", "top_k", "recommendations", "rerank")


HEALTH = """k AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY seq DESC) AS k FROM {f_service_outcomes} QUALIFY k <= 50),
h AS (SELECT service, count(*) AS samples, avg((NOT ok)::INT) AS error_rate, coalesce(min(CASE WHEN ok THEN k END), count(*) + 1) - 1 AS streak, arg_max(duration_s, seq) AS duration_s FROM k GROUP BY service)
SELECT service, samples, round(error_rate, 4) AS error_rate, streak, round(duration_s, 4) AS duration_s, NOT (streak > 5 OR (samples >= 6 AND error_rate > 0.5) OR duration_s > 10) AS healthy FROM h"""


@query(f"WITH {HEALTH}")
def o13_service_health(t: Tables) -> DataFrame:
    return O.service_health(t("f_service_outcomes"))

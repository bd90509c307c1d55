"""Queries of the document catalogue: pages, tags, shares, sessions, statistics, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.lexical import top
from folio.plans.registry import Tables, query

NOW = "TIMESTAMP '1996-01-01 00:00:00'"


@query("""SELECT id, file_name, row_number() OVER w AS place, count(*) OVER (PARTITION BY user_id) AS total, ceil(count(*) OVER (PARTITION BY user_id) / 10.0)::BIGINT AS total_pages, user_id
FROM {f_docs_catalog} WHERE status = 'completed' AND file_name ILIKE '%_EN_%' WINDOW w AS (PARTITION BY user_id ORDER BY created_at DESC, id) QUALIFY place BETWEEN 3 AND 12""")
def q01_document_page(t: Tables) -> DataFrame:
    rows = t("f_docs_catalog").where((F.col("status") == "completed") & F.ilike("file_name", F.lit("%_EN_%")))
    totals = rows.groupBy("user_id").agg(F.count("*").alias("total"), F.ceil(F.count("*") / 10).alias("total_pages"))
    page = rows.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), "id"))).where(F.col("place").between(3, 12))
    return page.join(totals, "user_id").select("id", "file_name", "place", "total", "total_pages", "user_id")


_ASK = "rq AS (SELECT c_custkey AS id, concat('src', c_custkey % 20) AS user_id FROM customer)"


@query(f"WITH {_ASK} SELECT r.id, CASE WHEN d.id IS NULL THEN 'not_found' WHEN d.user_id <> r.user_id THEN 'not_owned' WHEN d.status <> 'completed' THEN 'not_ready' ELSE 'ok' END AS outcome FROM rq r LEFT JOIN {{f_docs_catalog}} d USING (id)")
def q02_ownership(t: Tables) -> DataFrame:
    asked = t("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("src"), F.col("c_custkey") % 20).alias("asker"))
    rows = asked.join(t("f_docs_catalog").select("id", "user_id", "status"), "id", "left")
    outcome = F.when(F.col("status").isNull(), "not_found").when(F.col("user_id") != F.col("asker"), "not_owned").when(F.col("status") != "completed", "not_ready").otherwise("ok")
    return rows.select("id", outcome.alias("outcome"))


@query("SELECT id, file_name, coalesce(chunk_count, image_count) AS chunk_count, coalesce(chunk_count, 0) > 1 AS has_many, image_count > 0 AS has_images FROM {f_docs_catalog}")
def q03_serialize(t: Tables) -> DataFrame:
    meta = F.struct(F.col("image_count").alias("chunk_count"))
    rows = t("f_docs_catalog").withColumn("meta", meta)
    return rows.select("id", "file_name", F.coalesce("chunk_count", "meta.chunk_count").alias("chunk_count"), (F.coalesce("chunk_count", F.lit(0)) > 1).alias("has_many"), (F.col("image_count") > 0).alias("has_images"))


def live_status(events: DataFrame) -> DataFrame:
    """(batch_id, live): the status of each batch's latest event; of several at one time that of the last document, and of its events
    the last in order of status."""
    return events.groupBy("batch_id").agg(F.max_by("status", F.struct("ts", "document_no", "status")).alias("live"))


@query("""WITH l AS (SELECT l_orderkey AS id, arg_max(CASE l_returnflag WHEN 'A' THEN 'failed' WHEN 'R' THEN 'completed' ELSE 'processing' END, (l_shipdate, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'failed' WHEN 'R' THEN 'completed' ELSE 'processing' END)) AS live FROM lineitem GROUP BY ALL)
SELECT d.id, coalesce(live, status) AS status, CASE coalesce(live, status) WHEN 'completed' THEN 100 WHEN 'failed' THEN 0 ELSE 50 END AS progress, CASE WHEN coalesce(live, status) = 'failed' THEN 'processing failed' END AS error FROM {f_docs_catalog} d LEFT JOIN l USING (id)""")
def q04_status(t: Tables) -> DataFrame:
    live = live_status(t("f_batch_events")).withColumnRenamed("batch_id", "id")
    rows = t("f_docs_catalog").join(live, "id", "left").select("id", F.coalesce("live", "status").alias("status"))
    progress = F.when(F.col("status") == "completed", 100).when(F.col("status") == "failed", 0).otherwise(50)
    return rows.select("id", "status", progress.alias("progress"), F.when(F.col("status") == "failed", "processing failed").alias("error"))


@query("SELECT tag, count(*) AS usage_count, row_number() OVER (ORDER BY count(*) DESC, tag) AS place FROM {f_document_tags} WHERE tag ILIKE '%SRC%' GROUP BY tag QUALIFY place <= 10")
def q05_tags(t: Tables) -> DataFrame:
    used = t("f_document_tags").where(F.ilike("tag", F.lit("%SRC%"))).groupBy("tag").agg(F.count("*").alias("usage_count"))
    best = used.orderBy(F.desc("usage_count"), "tag").limit(10)  # ten rows from here on
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("usage_count"), "tag")))


@query("""SELECT document_id, tag FROM {f_document_tags} UNION SELECT doc_id, concat('lang:', lang) FROM documents UNION SELECT doc_id, concat('src:', source) FROM documents WHERE doc_id % 3 = 0""")
def q06_assign_tags(t: Tables) -> DataFrame:
    docs, have = t("documents"), t("f_document_tags")
    wanted = docs.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("lang:"), "lang").alias("tag")).union(docs.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("src:"), "source")))
    return have.union(wanted.distinct().join(have, ["document_id", "tag"], "left_anti"))


@query("""WITH rm AS (SELECT doc_id AS document_id, concat('src:', source) AS tag FROM documents WHERE doc_id % 3 = 0), g AS (SELECT tag, count(*) AS n FROM {f_document_tags} JOIN rm USING (document_id, tag) GROUP BY ALL)
SELECT tag, greatest(0, count(*) - coalesce(any_value(n), 0)) AS usage_count FROM {f_document_tags} LEFT JOIN g USING (tag) GROUP BY tag""")
def q07_remove_tags(t: Tables) -> DataFrame:
    have = t("f_document_tags")
    gone = t("documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("src:"), "source").alias("tag"))
    lost = have.join(gone, ["document_id", "tag"], "left_semi").groupBy("tag").agg(F.count("*").alias("n"))
    used = have.groupBy("tag").agg(F.count("*").alias("m")).join(lost, "tag", "left")
    return used.select("tag", F.greatest(F.lit(0), F.col("m") - F.coalesce("n", F.lit(0))).alias("usage_count"))


@query("SELECT id, file_name, string_agg(tag, ',' ORDER BY tag) AS tags FROM {f_docs_catalog} JOIN {f_document_tags} ON document_id = id GROUP BY ALL")
def q08_document_tags(t: Tables) -> DataFrame:
    tags = t("f_document_tags").groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))
    return t("f_docs_catalog").join(tags, F.col("id") == F.col("document_id")).select("id", "file_name", "tags")


_REASON = f"CASE WHEN s.id IS NULL THEN 'missing' WHEN expires_at <= {NOW} THEN 'expired' WHEN access_count >= max_access_count THEN 'limit_reached' WHEN has_password AND r.pw IS NULL THEN 'password_required' WHEN has_password AND NOT r.pw THEN 'wrong_password' ELSE 'ok' END"


@query(f"""WITH r AS (SELECT l_orderkey + l_linenumber % 2 AS link_id, l_linenumber, l_orderkey, CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS pw FROM lineitem)
SELECT l_orderkey, l_linenumber, {_REASON} AS reason, access_count + CASE WHEN {_REASON} = 'ok' THEN 1 ELSE 0 END AS access_count FROM r LEFT JOIN {{f_share_links}} s ON s.id = r.link_id""")
def q09_share_access(t: Tables) -> DataFrame:
    asked = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") + F.col("l_linenumber") % 2).alias("id"), F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False).alias("pw"))
    rows = asked.join(t("f_share_links"), "id", "left")
    reason = (
        F.when(F.col("expires_at").isNull(), "missing").when(F.col("expires_at") <= F.expr(NOW), "expired").when(F.col("access_count") >= F.col("max_access_count"), "limit_reached")
        .when(F.col("has_password") & F.col("pw").isNull(), "password_required").when(F.col("has_password") & ~F.col("pw"), "wrong_password").otherwise("ok")
    )
    return rows.withColumn("reason", reason).select("l_orderkey", "l_linenumber", "reason", (F.col("access_count") + F.when(F.col("reason") == "ok", 1).otherwise(0)).alias("access_count"))


@query(f"SELECT document_id, count(*) FILTER (expires_at > {NOW}) AS active, count(*) FILTER (expires_at <= {NOW}) AS purged, arg_max(id, (created_at, id)) FILTER (expires_at > {NOW}) AS newest FROM {{f_share_links}} GROUP BY ALL")
def q10_share_links(t: Tables) -> DataFrame:
    live = F.col("expires_at") > F.expr(NOW)
    return t("f_share_links").groupBy("document_id").agg(F.count_if(live).alias("active"), F.count_if(~live).alias("purged"), F.max_by("id", F.when(live, F.struct("created_at", "id"))).alias("newest"))


@query(f"SELECT user_id, count(*) FILTER (NOT is_revoked AND expires_at > {NOW}) AS active, count(*) FILTER (expires_at <= {NOW}) AS purged, count(*) FILTER (NOT is_revoked) AS to_revoke FROM {{f_sessions}} GROUP BY ALL")
def q11_sessions(t: Tables) -> DataFrame:
    live = F.col("expires_at") > F.expr(NOW)
    return t("f_sessions").groupBy("user_id").agg(F.count_if(~F.col("is_revoked") & live).alias("active"), F.count_if(~live).alias("purged"), F.count_if(~F.col("is_revoked")).alias("to_revoke"))


@query("SELECT source, md5(text) AS text_key, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def q12_duplicate_keys(t: Tables) -> DataFrame:
    return t("documents").groupBy("source", F.md5(F.encode("text", "UTF-8")).alias("text_key")).agg(F.count("*").alias("n")).where("n > 1")


@query("""SELECT count(*) AS documents, coalesce(sum(chunk_count), 0)::BIGINT AS chunks, coalesce(sum(image_count), 0)::BIGINT AS images, round(avg(CASE WHEN status = 'completed' THEN greatest(0, epoch(updated_at) - epoch(created_at)) END), 2) AS avg_seconds,
printf('%.2f MB', sum(file_size) / 1048576.0) AS size FROM {f_docs_catalog}""")
def q13_statistics(t: Tables) -> DataFrame:
    seconds = F.when(F.col("status") == "completed", F.greatest(F.lit(0), F.unix_timestamp("updated_at") - F.unix_timestamp("created_at")))
    return t("f_docs_catalog").agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("image_count"), F.lit(0)).alias("images"),
        F.round(F.avg(seconds), 2).alias("avg_seconds"), F.format_string("%.2f MB", F.sum("file_size") / 1048576).alias("size"),
    )


BATCH = """ls AS (SELECT batch_id, document_no, arg_max(status, (ts, status)) AS status, min(ts) AS a, max(ts) AS b FROM {f_batch_events} GROUP BY ALL)
SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status NOT IN ('completed', 'failed')) AS processing,
CAST(floor(100.0 * count(*) FILTER (status IN ('completed', 'failed')) / count(*)) AS BIGINT) AS progress, (epoch(max(b)) - epoch(min(a)))::BIGINT AS seconds FROM ls GROUP BY batch_id"""


def batch_rollup(events: DataFrame) -> DataFrame:
    """Progress of each batch from status events (batch_id, document_no, status, ts): the latest event of a document counts,
    of several at one time the last in order of status."""
    last = events.groupBy("batch_id", "document_no").agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    done, failed = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    return last.groupBy("batch_id").agg(
        F.count("*").alias("total"), done.alias("completed"), failed.alias("failed"), (F.count("*") - done - failed).alias("processing"),
        F.floor(100 * (done + failed) / F.count("*")).alias("progress"), (F.unix_timestamp(F.max("b").cast("timestamp")) - F.unix_timestamp(F.min("a").cast("timestamp"))).alias("seconds"),
    )


@query(f"WITH {BATCH}")
def q14_batch_rollup(t: Tables) -> DataFrame:
    return batch_rollup(t("f_batch_events"))

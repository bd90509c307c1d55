"""Streams that are fed file by file, one file a trigger, against their batch twins."""

import tempfile
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folio.operators.similarity import merge_history
from folio.streaming import jobs as J


def fed(spark, rows, parts):
    """``rows`` as a stream of ``parts`` files, of which each trigger takes one."""
    path = tempfile.mkdtemp(prefix="folio-feed-")
    for k in range(parts):
        rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(parts)) == k).coalesce(1).write.mode("append").parquet(path)
    return J.read_stream(spark, path, files_per_trigger=1)


def test_progress_over_several_triggers(spark):
    events = spark.range(900).selectExpr("id % 7 batch_id", "id % 40 document_no", "element_at(array('completed','failed','processing'), CAST(1 + hash(id) % 3 + 3 AS INT) % 3 + 1) status", "timestamp_seconds(hash(id, 1) % 1000) ts")
    known = {}
    for r in events.collect():
        docs = known.setdefault(r["batch_id"], {})
        docs[r["document_no"]] = max(docs.get(r["document_no"], (r["ts"], r["status"])), (r["ts"], r["status"]))
    want = set()
    for batch, docs in known.items():
        said = [s for _, s in docs.values()]
        done, failed = said.count("completed"), said.count("failed")
        want.add((batch, len(said), done, failed, len(said) - done - failed, 100 * (done + failed) // len(said)))
    got = J.batch_progress(spark, fed(spark, events, 3), buckets=4).select("batch_id", "total", "completed", "failed", "processing", "progress")
    assert {tuple(r) for r in got.collect()} == want and len({r[2:4] for r in want}) > 1


def test_history_over_several_triggers(spark):
    asked = spark.range(400).selectExpr("nullif(id % 9, 4) user_id", "concat('q', id % 5) question", "id % 3 document_id", "timestamp_seconds(id * 7919 % 5000) ts")
    new = asked.select("user_id", "question", "document_id", F.lit(1).cast("long").alias("query_count"), F.col("ts").alias("last_queried"), F.col("ts").alias("created_at"))
    got = J.history_counter(spark, fed(spark, asked, 3), buckets=4)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in merge_history(new.limit(0), new).select(*got.columns).collect()} and got.count() == 40


def test_ingest_over_several_triggers(spark):
    docs = spark.createDataFrame([(1, "Some text. " * 200), (2, "  "), (3, None), (4, "short")], "doc_id long, text string")
    chunks, status = J.ingest(spark, fed(spark, docs, 2))
    assert {tuple(r) for r in status.select("doc_id", "status").collect()} == {(1, "completed"), (2, "failed"), (3, "failed"), (4, "completed")}
    assert {r["doc_id"] for r in chunks.collect()} == {1, 4} and {tuple(r) for r in chunks.drop("batch").collect()} == {tuple(r) for r in J.parent_child_chunks(docs).select(*chunks.drop("batch").columns).collect()}


def test_service_health_over_several_triggers(spark):
    rows = spark.range(300).selectExpr("concat('s', id % 3) service", "id seq", "id % 7 >= 3 OR id > 280 ok", "CAST(id % 20 AS DOUBLE) duration_s")
    from folio.operators.monitoring import service_health

    want = service_health(rows)
    got = J.service_health(spark, J.read_stream(spark, _written(rows)))
    cols = [c for c in got.columns if c in want.columns]
    assert {tuple(r) for r in got.select(*cols).collect()} == {tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in want.select(*cols).collect()} and len(cols) >= 4


def _written(rows):
    path = tempfile.mkdtemp(prefix="folio-feed-")
    rows.write.mode("overwrite").parquet(path)
    return path


def test_idempotent_events_carry_the_last_kept_time_over_batches(spark, tmp_path):
    at = lambda s: datetime(2026, 1, 1) + timedelta(seconds=s)
    batches = [
        [(1, "a", 0), (1, "a", 600), (1, "a", 600), (1, "a", 601), (1, "a", 1201), (None, "a", 100), (None, "a", 300), (2, None, 5), (3, "a", None), (2, None, 5)],
        [(1, "a", 1300), (1, "a", 1202), (None, "a", 750), (2, None, 601), (2, None, 1100), (4, "b", 5000), (1, "a", 600)],
        [(4, "b", 4400), (4, "b", 5600), (4, "b", 5601), (1, "a", 4401), (5, "c", 4400), (2, None, 4500)],
    ]
    schema = "user_id long, kind string, ts timestamp"
    for rows in batches:
        made = spark.createDataFrame([(u, e, None if s is None else at(s)) for u, e, s in rows], schema)
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last, latest, want = {}, None, []
    for rows in batches:
        for u, e, s in sorted((r for r in rows if r[2] is not None), key=lambda r: r[2]):
            if (latest is None or s > latest - 600) and s - last.get((u, e), -601) > 600:
                last[u, e] = s
                want.append((u, e, at(s)))
        latest = max([latest or 0, *(r[2] for r in rows if r[2] is not None)])
    stream = J.read_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    got = [tuple(r) for r in J.idempotent(spark, stream, ["user_id", "kind"]).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) == 11


def test_idempotent_events_of_many_keys_are_not_handled_key_by_key(spark, tmp_path):
    spark.range(40_000).selectExpr("id % 20000 AS k", "timestamp_seconds(1700000000 + id DIV 20000 * 300) AS ts").write.parquet(str(tmp_path / "in"))
    started = time.perf_counter()
    assert J.idempotent(spark, J.read_stream(spark, str(tmp_path / "in")), ["k"]).count() == 20_000
    assert time.perf_counter() - started < 15

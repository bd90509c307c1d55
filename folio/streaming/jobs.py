"""Structured Streaming jobs: each gives what its batch twin gives over the same rows.

Every job reads a growing folder of files, keeps its state in Spark's state store under a checkpoint folder, and runs what is
there (``availableNow``) or forever (another trigger). Results land in tables under the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folio.functions import text as X
from folio.operators.chunking import parent_child_chunks
from folio.operators.monitoring import request_totals
from folio.operators.similarity import merge_history
from folio.sources.buckets import Buckets
from folio.sources.store import shared_dir


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A Parquet file or folder as a stream."""
    rows = spark.read.parquet(path)
    files = rows.inputFiles()
    single = len(files) == 1 and files[0].rstrip("/").endswith(path.rstrip("/").rpartition("/")[2])
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_trigger)
    if single:
        folder, _, name = path.rstrip("/").rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


class Run:
    """One run of a job: where its checkpoint and its results are."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.out, self.state = f"{self.base}/out", f"{self.base}/state"

    def drain(self, stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None] | None = None) -> None:
        """Processes all rows that are there, appending to ``out`` or through ``sink``."""
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", self.state).trigger(availableNow=True)
        writer = writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", self.out)
        query = writer.start()
        query.awaitTermination()
        if query.exception():
            raise query.exception()

    def fold(self, stream: DataFrame, change: Callable[[DataFrame, int], None]) -> int:
        """Applies ``change`` to each micro-batch and its number, and gives the last number; -1 without any."""
        last = -1

        def step(rows: DataFrame, batch: int) -> None:
            nonlocal last
            change(rows, batch)
            last = batch

        self.drain(stream, "append", step)
        return last

    def latest(self) -> Callable[[DataFrame, int], None]:
        """A sink that keeps each batch's full result under its number, so a repeated batch overwrites itself."""
        return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{self.out}/batch={batch}")

    def remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def result(self, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.out)


def minute_trend(spark: SparkSession, log: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Requests, errors and mean duration per minute, emitted once the watermark has passed a minute; later rows are dropped."""
    run = Run(spark, "minute-trend")
    made = log.withWatermark("ts", delay).groupBy(F.window("ts", "1 minute")).agg(*request_totals()).select(F.col("window.start").alias("minute"), "requests", "errors", "avg_ms")
    run.drain(made, "append")
    return run.result(made.schema)


def rolling_report(spark: SparkSession, log: DataFrame, length: str = "1 hour", slide: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Requests and errors per endpoint and sliding window, as last known for each."""
    run = Run(spark, "rolling-report")
    made = log.withWatermark("ts", delay).groupBy(F.window("ts", length, slide), "endpoint").agg(*request_totals()).select(F.col("window.start").alias("start"), "endpoint", "requests", "errors", "avg_ms")
    run.drain(made, "update", run.latest())
    rows = spark.read.schema("start timestamp, endpoint string, requests long, errors long, avg_ms double, batch long").parquet(run.out)
    return rows.groupBy("start", "endpoint").agg(F.max_by(F.struct("requests", "errors", "avg_ms"), "batch").alias("r")).select("start", "endpoint", "r.*")


def batch_progress(spark: SparkSession, events: DataFrame, buckets: int = 64) -> DataFrame:
    """Progress per batch as status events (batch_id, document_no, status, ts) arrive; the latest event of a document counts.

    What is known of the documents is a table in buckets of (batch, document): a micro-batch rewrites the buckets of its documents, those
    of one large batch are spread over all buckets, and no batch is gathered anywhere. A repeated micro-batch gives the same.
    """
    run = Run(spark, "batch-progress")
    table = Buckets(spark, run.out, ["batch_id", "document_no"], "batch_id long, document_no long, us long, status string", buckets)
    rows = events.select(F.col("batch_id").cast("long").alias("batch_id"), F.col("document_no").cast("long").alias("document_no"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "status")
    latest = lambda rows: rows.groupBy("batch_id", "document_no").agg(F.max(F.struct("us", "status")).alias("r")).select("batch_id", "document_no", "r.*")
    last = run.fold(rows, lambda new, batch: table.change(latest(new), batch, lambda old, new: latest(old.unionByName(new))))
    done = table.read(last).groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    ended = F.col("completed") + F.col("failed")
    return done.select("*", (F.col("total") - ended).alias("processing"), F.floor(100 * ended / F.col("total")).alias("progress"))


def history_counter(spark: SparkSession, asked: DataFrame, buckets: int = 64) -> DataFrame:
    """Question counts kept up to date: each micro-batch is aggregated and merged into the buckets of its keys; others stay as they lie.

    ``asked`` has (user_id, question, document_id, ts). A change is named by its batch, so a repeated batch gives the same.
    """
    run = Run(spark, "history")
    schema = "user_id long, question string, document_id long, query_count long, last_queried timestamp, created_at timestamp"
    table = Buckets(spark, run.out, ["user_id", "question", "document_id"], schema, buckets)

    def upsert(rows: DataFrame, batch: int) -> None:
        new = rows.groupBy("user_id", "question", "document_id").agg(F.count("*").alias("query_count"), F.max("ts").alias("last_queried"), F.min("ts").alias("created_at"))
        table.change(new.where("user_id IS NOT NULL"), batch, merge_history)

    return table.read(run.fold(asked, upsert))


def ingest(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, status) of new documents (doc_id, text): normalised, chunked and appended, with one status row each."""
    run = Run(spark, "ingest")

    def load(rows: DataFrame, batch: int) -> None:
        made = parent_child_chunks(rows)
        made.write.mode("overwrite").parquet(f"{run.out}/chunks/batch={batch}")
        blank = F.coalesce(X.normalize_document(F.col("text")), F.lit("")) == ""
        rows.select("doc_id", F.when(blank, "failed").otherwise("completed").alias("status")).write.mode("overwrite").parquet(f"{run.out}/status/batch={batch}")

    run.drain(docs.select("doc_id", "text"), "append", load)
    chunks = spark.read.schema("doc_id long, chunk_index int, parent_chunk_index int, content string").parquet(f"{run.out}/chunks")
    return chunks, spark.read.schema("doc_id long, status string").parquet(f"{run.out}/status")


def service_health(spark: SparkSession, outcomes: DataFrame, last: int = 50) -> DataFrame:
    """Health of each service from its last outcomes (service, seq, ok, duration_s), which are its state."""
    run = Run(spark, "service-health")
    schema = "service string, samples long, error_rate double, streak long, duration_s double, healthy boolean"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, oks, durations = state.get if state.exists else ([], [], [])
        kept = pd.DataFrame({"seq": list(seqs), "ok": list(oks), "duration_s": list(durations)})
        kept = pd.concat([kept, *(frame[["seq", "ok", "duration_s"]].nlargest(last, "seq") for frame in frames)]).nlargest(last, "seq").iloc[::-1]
        oks = [bool(x) for x in kept["ok"]]
        state.update(([int(x) for x in kept["seq"]], oks, [float(x) for x in kept["duration_s"]]))
        streak = next((k for k, ok in enumerate(reversed(oks)) if ok), len(oks))
        rate, took = 1 - sum(oks) / len(oks), float(kept["duration_s"].iloc[-1])
        sick = streak > 5 or (len(oks) >= 6 and rate > 0.5) or took > 10
        yield pd.DataFrame([(key[0], len(oks), rate, streak, took, not sick)], columns=[c.split()[0] for c in schema.split(", ")])

    made = outcomes.select("service", "seq", "ok", "duration_s").groupBy("service").applyInPandasWithState(step, schema, "seqs array<long>, oks array<boolean>, durations array<double>", "update", GroupStateTimeout.NoTimeout)
    run.drain(made, "update", run.latest())
    rows = spark.read.schema(f"{schema}, batch long").parquet(run.out)
    return rows.groupBy("service").agg(F.max_by(F.struct("samples", "error_rate", "streak", "duration_s", "healthy"), "batch").alias("r")).select("service", "r.*").withColumns({c: F.round(c, 4) for c in ("error_rate", "duration_s")})


def spaced(events: DataFrame, last: DataFrame, keys: list[str], span: int) -> DataFrame:
    """(keys, _us) of each key's first event, and after that of the first one more than ``span`` microseconds after the last that was kept.

    ``last`` has (keys, last) of keys that had events before, one row a key. Rows are sorted by key and time and walked in that order with
    one number at hand, so neither a key nor its events are gathered.
    """
    rows = events.select(*keys, "_us", F.lit(False).alias("_old")).unionByName(last.select(*keys, F.col("last").alias("_us"), F.lit(True).alias("_old")))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_old").desc(), "_us")) == 1

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            kept = []
            for begins, old, us in zip(*(batch.column(c).to_pylist() for c in ("_first", "_old", "_us")), strict=True):
                kept.append((begins or us - at > span) and not old)
                if begins or kept[-1]:
                    at = us
            yield batch.filter(pa.array(kept, type=pa.bool_())).select([*keys, "_us"])

    return rows.withColumn("_first", first).mapInArrow(walk, T.StructType([*(events.schema[k] for k in keys), T.StructField("_us", T.LongType())]))


def idempotent(spark: SparkSession, events: DataFrame, keys: list[str], ts: str = "ts", keep: int = 600) -> DataFrame:
    """(keys, ts) of the events that are no repeats: the first of each key, and after that the first one more than ``keep`` seconds
    after the last that was kept.

    What is known of the keys is a table a micro-batch: the time of each key's last kept event, which goes when event time has passed it
    by ``keep`` seconds, and the latest time so far. Events of a micro-batch are taken in order of time, events later than the watermark
    (``keep`` seconds, as of the micro-batches before) are dropped, as are those without a time, and of equal times one stays. A repeated
    micro-batch starts from the table before it and gives the same.
    """
    run = Run(spark, "idempotent")
    span, fields = keep * 1_000_000, [events.schema[k] for k in keys]
    known = T.StructType([*fields, T.StructField("last", T.LongType()), T.StructField("latest", T.LongType())])
    made = T.StructType([*fields, T.StructField(ts, T.TimestampType())])
    table = lambda batch: f"{run.base}/last/batch={batch}"

    def step(rows: DataFrame, batch: int) -> None:
        old = spark.read.schema(known).parquet(table(batch - 1)) if batch else spark.createDataFrame([], known)
        new = rows.select(*keys, F.unix_micros(ts).alias("_us")).where("_us IS NOT NULL")
        before, now = old.agg(F.max("latest")).first()[0], new.agg(F.max("_us")).first()[0]
        if before is not None:
            new = new.where(F.col("_us") > before - span)
        spaced(new, old, keys, span).select(*keys, F.timestamp_micros("_us").alias(ts)).write.mode("overwrite").parquet(f"{run.out}/batch={batch}")
        latest = max((x for x in (before, now) if x is not None), default=0)
        kept = spark.read.schema(made).parquet(f"{run.out}/batch={batch}").select(*keys, F.unix_micros(ts).alias("last"))
        lasts = old.select(*keys, "last").unionByName(kept).groupBy(*keys).agg(F.max("last").alias("last")).where(F.col("last") >= latest - 2 * span)
        lasts.withColumn("latest", F.lit(latest).cast("long")).write.mode("overwrite").parquet(table(batch))
        run.remove(table(batch - 2))

    run.drain(events, "append", step)
    return run.result(made).select(*made.names)

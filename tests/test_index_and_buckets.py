"""The persisted lexical index against the one-off search; bucketed tables against plain sets of rows."""

import tempfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.operators import index as I
from folio.operators import lexical as L
from folio.operators.index import LexicalIndex
from folio.operators.similarity import merge_history
from folio.sources.buckets import Buckets
from folio.sources.store import snapshot
from folio.sources.views import table


def rounded(df, *cols):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_index_equals_one_off_search_and_is_pruned(spark, data):
    chunks = table(spark, data, "f_chunks").select("chunk_id", "content").union(spark.createDataFrame([("none", None), ("blank", "  ")], "a string, b string"))
    path = tempfile.mkdtemp(prefix="folio-index-")
    index = LexicalIndex.build(chunks, path)
    asked = table(spark, data, "f_questions")
    cols = ("query_id", "chunk_id", "score", "rank")
    assert rounded(index.top(asked), *cols) == rounded(L.bm25_top(asked, chunks.na.fill("")), *cols)
    assert rounded(index.weights(), "token", "chunk_id", "weight") == rounded(L.bm25_index(chunks.na.fill(""), "chunk_id", "content"), "token", "chunk_id", "weight")
    word = chunks.select(F.explode(F.split(F.lower("content"), "[^a-z]+")).alias("w")).where("length(w) > 6").first()["w"]
    one = index.top(spark.createDataFrame([(1, word), (2, ""), (3, None)], "query_id int, question string"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert {r["query_id"] for r in one.collect()} == {1} and "PartitionFilters: [isnotnull(bucket" in plan
    marks = sorted(p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet"))
    assert LexicalIndex.of(chunks.limit(0), path).totals["docs"] == chunks.count() and sorted(p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")) == marks


def test_search_by_shuffle_equals_search_in_tasks(spark, data, monkeypatch):
    index = LexicalIndex.build(table(spark, data, "f_chunks").select("chunk_id", "content"), tempfile.mkdtemp(prefix="folio-index-"))
    asked, cols = table(spark, data, "f_questions"), ("query_id", "chunk_id", "score", "rank")
    in_tasks = rounded(index.top(asked, 7), *cols)
    monkeypatch.setattr(I, "FEW", -1)
    assert in_tasks and rounded(index.top(asked, 7), *cols) == in_tasks


@pytest.mark.parametrize(("rows", "cells", "k"), [(1, 1, 1), (10, 20, 3), (1000, 40, 2), (1 << 18, 1 << 22, 4), (50, 7, 100)])
def test_sums_of_a_task_equal_naive(monkeypatch, rows, cells, k):
    monkeypatch.setattr(I, "ROWS", rows), monkeypatch.setattr(I, "CELLS", cells)
    rng = np.random.default_rng(rows)
    ids = [None, *(f"c{i:03}" for i in range(60))]
    posted = [(i, int(c), float(rng.integers(-1, 4))) for i in ids for c in rng.choice(9, rng.integers(0, 9), replace=False)]
    asks = [(c, q, int(rng.integers(1, 3))) for c in range(9) for q in sorted(rng.choice(6, rng.integers(0, 6), replace=False))]
    starts = np.searchsorted([c for c, _, _ in asks], np.arange(10))
    add = I.scorer(starts, np.array([q for _, q, _ in asks]), np.array([m for _, _, m in asks], dtype=float), pa.array([f"q{i}" for i in range(6)]), "id", k)
    sums = {}
    for i, c, w in posted:
        for q, m in ((q, m) for d, q, m in asks if d == c):
            sums[q, i] = sums.get((q, i), 0) + m * w
    want = {(f"q{q}", i, s) for p in range(6) for q, i, s in sorted(((q, i, s) for (q, i), s in sums.items() if q == p and s > 0), key=lambda r: (-r[2], r[1] or ""))[:k]}
    columns = list(zip(*posted, strict=True))
    table_ = pa.table({"id": pa.array(columns[0], pa.string()), "code": pa.array(columns[1], pa.int64()), "weight": pa.array(columns[2])})
    got = [r for b in add(iter(table_.to_batches(max_chunksize=7))) for r in b.to_pylist()]
    assert {(r["query_id"], r["id"], r["score"]) for r in got} == want and len(got) == len(want)
    assert list(add(iter([]))) == []


def test_empty_index(spark):
    index = LexicalIndex.build(spark.createDataFrame([], "chunk_id string, content string"), tempfile.mkdtemp(prefix="folio-index-"))
    assert index.top(spark.createDataFrame([(1, "word")], "query_id int, question string")).count() == 0 and index.weights().count() == 0


def test_snapshot_follows_the_files(spark):
    path = tempfile.mkdtemp(prefix="folio-snapshot-")
    spark.range(3).write.mode("overwrite").parquet(path)
    first = snapshot(spark, path)
    assert snapshot(spark, path) == first
    spark.range(1).write.mode("append").parquet(path)
    assert snapshot(spark, path) != first


def folders(path):
    return {(p.parent.parent.name, p.parent.name) for p in Path(path, "rows").rglob("*.parquet")}


def test_changes_touch_only_their_buckets(spark):
    path = tempfile.mkdtemp(prefix="folio-buckets-")
    made = Buckets(spark, path, ["id"], "id long, x long", buckets=16)
    rows = spark.range(200).select("id", (F.col("id") * 2).alias("x"))
    made.append(rows, 0)
    made.append(spark.createDataFrame([(7, 99), (None, 1)], "id long, x long"), 1)
    whole = {(r["id"], r["x"]) for r in made.read(1).collect()}
    assert whole == {(i, 2 * i) for i in range(200)} | {(7, 99), (None, 1)}
    before = folders(path)
    made.delete(spark.createDataFrame([(7,), (12,), (555,)], "id long"), 2)
    after = {(r["id"], r["x"]) for r in made.read(2).collect()}
    assert after == {(i, x) for i, x in whole if i not in (7, 12)}
    assert {v for v, _ in folders(path) - before} == {"version=2"} and len(folders(path) - before) <= 3
    for _ in range(2):  # a repeated change gives the same
        made.change(spark.createDataFrame([(3, 1000)], "id long, x long"), 3, lambda old, new: old.unionByName(new))
        assert {(r["id"], r["x"]) for r in made.read(3).collect()} == after | {(3, 1000)}
    made.change(spark.createDataFrame([], "id long, x long"), 4, lambda old, new: new)
    assert made.read(4).count() == len(after) + 1 and made.heads(0) == set()
    heads = made.heads(4) | made.heads(3)
    assert {(f"version={v}", f"bucket={b}") for b, v in heads} == folders(path)
    asked = made.read(4, spark.createDataFrame([(5,), (3,)], "id long"))
    assert {(r["id"], r["x"]) for r in asked.collect()} == {(5, 10), (3, 6), (3, 1000)} and len(asked.inputFiles()) < len(made.read(4).inputFiles())


def test_upserts_in_buckets_equal_one_merge(spark):
    schema = "user_id long, question string, document_id long, query_count long, last_queried long, created_at long"
    made = Buckets(spark, tempfile.mkdtemp(prefix="folio-upsert-"), ["user_id", "question", "document_id"], schema, buckets=8)
    rows = spark.range(300).selectExpr("nullif(id % 7, 3) user_id", "concat('q', id % 11) question", "id % 3 document_id", "1L query_count", "id last_queried", "id created_at")
    for k in range(3):
        made.change(rows.where(F.col("last_queried") % 3 == k), k, merge_history)
    assert rounded(made.read(2), *made.schema.replace(" long", "").replace(" string", "").split(", ")) == rounded(merge_history(rows.limit(0), rows), *made.schema.replace(" long", "").replace(" string", "").split(", "))

"""Search within scopes, reranking that may fail, prompts without results, level changes across blocks."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions import prompts as P
from folio.operators import lexical as L
from folio.operators import monitoring as O
from folio.operators import retrieval as R

TEXTS = {("a", "a1"): "red apple pie", ("a", "a2"): "green apple", ("b", "b1"): "red car red road", ("b", "b2"): "", ("c", "c1"): "blue sea apple", ("c", "c2"): "sea sea sea"}
ASKED = {1: "red apple", 2: "red apple apple", 3: "sea", 4: "apple", 5: "apple"}
SCOPES = {1: "ab", 2: "abc", 3: "a", 4: "ab", 6: "abc"}


def plain_bm25(query, scope):
    chunks = {c: Counter(re.findall("[0-9a-z]+", t)) for (d, c), t in TEXTS.items() if d in scope}
    if not chunks:
        return []
    df = Counter(w for c in chunks.values() for w in c)
    idf = {w: math.log(len(chunks) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean, average = sum(idf.values()) / max(1, len(idf)), sum(sum(c.values()) for c in chunks.values()) / len(chunks)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in idf.items()}
    score = {c: round(sum(m * idf.get(w, 0) * n[w] * 2.5 / (n[w] + 1.5 * (0.25 + 0.75 * sum(n.values()) / average)) for w, m in Counter(query.split()).items()), 8) for c, n in chunks.items()}
    return [(c, s) for c, s in sorted(score.items(), key=lambda x: (-x[1], x[0])) if s > 0]


def test_statistics_are_those_of_the_scope(spark):
    chunks = spark.createDataFrame([(c, d, t) for (d, c), t in TEXTS.items()], "chunk_id string, document_id string, content string")
    questions = spark.createDataFrame(list(ASKED.items()), "query_id long, question string")
    allowed = spark.createDataFrame([(q, d) for q, ds in SCOPES.items() for d in ds] + [(1, "a")], "query_id long, document_id string")
    named, members = L.scopes(allowed)
    assert named.select("scope").distinct().count() == 3 and members.count() == 2 + 3 + 1
    got = L.bm25_scoped(questions, chunks, allowed).orderBy("query_id", "rank").collect()
    want = [(q, c, s) for q, text in ASKED.items() for c, s in plain_bm25(text, SCOPES.get(q, ""))]
    assert [(r["query_id"], r["chunk_id"]) for r in got] == [w[:2] for w in want] and [r["score"] for r in got] == pytest.approx([w[2] for w in want])
    assert L.bm25_scoped(questions, chunks, allowed.limit(0)).collect() == []


def test_vectors_outside_the_scope_are_not_seen(spark):
    rng = np.random.default_rng(1)
    rows = [(k, k % 5, rng.normal(size=4).tolist()) for k in range(60)]
    vectors = spark.createDataFrame(rows, "chunk_id long, document_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(q, rows[q][2]) for q in range(7)], "query_id long, embedding array<double>")
    allowed = [(q, d) for q in range(6) for d in range(5) if (q + d) % 3]
    got = R.vector_top(queries, vectors, 3, allowed=spark.createDataFrame(allowed, "query_id long, document_id long")).orderBy("query_id", "rank").collect()
    unit = np.array([r[2] for r in rows]) / np.linalg.norm([r[2] for r in rows], axis=1, keepdims=True)
    want = []
    for q in range(7):
        near = sorted(((-round(float(unit[q] @ unit[k]), 8), k) for k, d, _ in rows if (q, d) in set(allowed)))[:3]
        want += [(q, k) for _, k in near]
    assert [(r["query_id"], r["chunk_id"]) for r in got] == want


def test_a_failing_scorer_keeps_the_order(spark):
    def score(questions, contents):
        if contents.str.contains("poison").any():
            raise RuntimeError("model failed")
        return contents.str.len()

    rows = [(1, 1, "q", "aa"), (1, 2, "q", "aaaa"), (1, 3, "q", "aaa"), (2, 1, "q", "b"), (2, 2, "q", "poison"), (3, 1, "q", "c"), (3, 2, "q", "cc")]
    table = spark.createDataFrame(rows, "query_id int, rank int, question string, content string").coalesce(1)
    got = {(r["query_id"], r["new_rank"]): (r["original_rank"], r["rerank_score"], r["rerank_applied"]) for r in R.rerank(table, R.guarded(score), 2).collect()}
    assert got == {(1, 1): (2, 4.0, True), (1, 2): (3, 3.0, True), (2, 1): (1, None, False), (2, 2): (2, None, False), (3, 1): (2, 2.0, True), (3, 2): (1, 1.0, True)}


def test_hybrid_context_of_a_question_without_hits(spark):
    chunks = spark.createDataFrame([("d_0", "d", 0, 0, "red apple", 1, "text"), ("d_1", "d", 1, 0, "green pear", 2, "table"), ("e_0", "e", 0, -1, "lonely", 1, None)], "chunk_id string, document_id string, chunk_index int, parent_chunk_index int, content string, page int, type string")
    questions = spark.createDataFrame([(1, "red apple"), (2, "nothing")], "query_id int, question string")
    near = spark.createDataFrame([(1, "d_1", 1), (1, "e_0", 2)], "query_id int, chunk_id string, rank int")
    found, told = R.hybrid_context(questions, near, near.where("rank = 1").withColumn("chunk_id", F.lit("d_0")), chunks, F.length("content"), 5)
    best = found.orderBy("rank").collect()
    assert [r["document_id"] for r in best] == ["d", "e"] and best[0]["content"] == "red apple\n\ngreen pear" and best[0]["page_no"] == 1 and best[0]["rerank_applied"]
    got = {r["query_id"]: r for r in told.collect()}
    assert (got[1]["vector_hits"], got[1]["bm25_hits"], got[1]["retrieved_chunks"], got[1]["evidence_coverage"], got[1]["strategy"]) == (2, 1, 2, 1.0, "hybrid_rerank")
    assert (got[2]["vector_hits"], got[2]["retrieved_chunks"], got[2]["top_score"], got[2]["strategy"], got[2]["rerank_applied"]) == (0, 0, 0.0, "hybrid", False)


def test_prompt_without_results(spark):
    questions = spark.createDataFrame([(1, "q one"), (2, "q two")], "query_id int, question string")
    results = spark.createDataFrame([(1, 1, "d", 3, "text")], "query_id int, rank int, document_id string, page int, content string")
    got = {r["query_id"]: r["prompt"] for r in R.prompts(questions, results).collect()}
    assert got[2] == P.WITHOUT_CONTEXT.replace("{question}", "q two") and "[来源: d, 第 3 页]\ntext" in got[1]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_levels_are_compared_across_blocks(spark, block):
    levels = ["L0", "L0", "L1", "L1", "L1", "L2", "L0", "L0"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(levels)], "ts int, degradation string").repartition(4)
    got = [(r["ts"], r["before"]) for r in O.level_changes(rows, ["ts"], block).orderBy("ts").collect()]
    assert got == [(0, None), (2, "L0"), (5, "L1"), (6, "L2")]

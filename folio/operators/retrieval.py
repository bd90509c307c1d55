"""Retrieval over tables of queries: exact vector search, fusion, parent context, diagnostics, decisions, prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import prompts as P
from folio.operators.chunking import merge_overlapping
from folio.operators.datasets import filled
from folio.operators.lexical import top
from folio.sources.store import cut, small_side

REFUSAL = "未找到足够依据"


def vector_hits(queries: DataFrame, vectors: DataFrame, k: int, each: bool = False, least: float | None = None, apart: bool = False, allowed: DataFrame | None = None, block: int = 1024) -> DataFrame:
    """(query_id, chunk_id, document_id, score, hits): per task and batch of vectors the k nearest of each query, or with ``each`` of
    each query and document; the k nearest of all are among them.

    ``queries`` has (query_id, embedding), ``vectors`` (chunk_id, document_id, embedding). Queries go to the executors in blocks of
    about ``block`` by a hash of their id; each batch of vectors is one matrix product. ``least`` drops lower scores, ``apart`` a query's
    own document; ``hits`` sums up to what was left before the cut to k. ``allowed`` (query_id, document_id) restricts the search
    before the cut: vectors of documents in no scope of the block are left out by a join, the others bring the numbers of the block's
    queries that may see them, ``block`` at most. A zero vector has similarity 0.
    """
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // block))
    kinds, out = dict(vectors.dtypes), None
    for number in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).select("query_id", "embedding").orderBy("query_id")
        part = part.toPandas()
        shared = spark.sparkContext.broadcast((part["query_id"].to_numpy(), _unit(part["embedding"])))
        source = vectors.select("chunk_id", "document_id", "embedding")
        if allowed is not None:
            numbers = spark.createDataFrame([(q, n) for n, q in enumerate(part["query_id"].tolist())], f"query_id {dict(queries.dtypes)['query_id']}, n int")
            may = allowed.join(F.broadcast(numbers), "query_id").groupBy("document_id").agg(F.collect_set("n").alias("may"))
            source = source.join(may, "document_id")

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, wanted = shared.value
            for frame in frames:
                if not len(frame) or not len(names):
                    continue
                frame = frame.sort_values(["document_id", "chunk_id"] if each else "chunk_id", kind="stable", ignore_index=True)
                score = np.round(wanted @ _unit(frame["embedding"]).T, 8)
                docs = frame["document_id"].to_numpy()
                open_ = np.ones(score.shape, dtype=bool) if least is None else score >= least
                if apart:
                    open_ &= docs[None, :] != names[:, None]
                if "may" in frame:
                    seen = np.zeros_like(open_)
                    seen[np.concatenate(frame["may"].to_list()), np.repeat(np.arange(len(docs)), frame["may"].map(len))] = True
                    open_ &= seen
                group = np.cumsum(np.append(False, docs[1:] != docs[:-1])) if each else np.zeros(len(docs), dtype=np.int64)
                rows, cols, hits = [], [], []
                for q in range(len(names)):
                    at = np.flatnonzero(open_[q])
                    if not len(at):
                        continue
                    if not each and len(at) > 4 * k:  # whatever ties with the k-th stays in
                        at = at[score[q, at] >= -np.partition(-score[q, at], k - 1)[k - 1]]
                    order = at[np.lexsort((at, -score[q, at], group[at]))]
                    first = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
                    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                    order = order[place < k]
                    rows.append(np.full(len(order), q)), cols.append(order), hits.append(np.append(open_[q].sum(), np.zeros(len(order) - 1, dtype=np.int64)))
                if rows:
                    rows, cols = np.concatenate(rows), np.concatenate(cols)
                    yield pd.DataFrame({"query_id": names[rows], "chunk_id": frame["chunk_id"].to_numpy()[cols], "document_id": docs[cols], "score": score[rows, cols], "hits": np.concatenate(hits).astype(np.int64)})

        schema = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {kinds['chunk_id']}, document_id {kinds['document_id']}, score double, hits long"
        found = source.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def vector_top(queries: DataFrame, vectors: DataFrame, k: int, allowed: DataFrame | None = None, each: bool = False) -> DataFrame:
    """(query_id, chunk_id, document_id, score, rank): the k nearest by cosine similarity, exactly; with ``each`` in each document."""
    hits = vector_hits(queries, vectors, k, each=each, allowed=allowed).drop("hits")
    return top(hits, ["query_id", "document_id"] if each else "query_id", k, F.desc("score"), F.asc("chunk_id"))


def _unit(vectors: pd.Series) -> np.ndarray:
    if not len(vectors):
        return np.empty((0, 0))
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def coerce_score(score: Column, distance: Column) -> Column:
    return F.coalesce(score, F.greatest(F.lit(0.0), 1 - distance), F.lit(0.0))


def tag(hits: DataFrame, source: str) -> DataFrame:
    """Adds the retriever's name to ``sources``."""
    old = F.col("sources") if "sources" in hits.columns else F.array().cast("array<string>")
    return hits.withColumn("sources", F.array_union(old, F.array(F.lit(source))))


def rrf(lists: DataFrame, k: int, constant: int = 60, digits: int | None = 4) -> DataFrame:
    """(query_id, chunk_id, score, sources, rank): reciprocal-rank fusion of ranked lists in one table with (query_id, chunk_id, rank, sources)."""
    score = F.sum(1.0 / (constant + F.col("rank")))
    fused = lists.groupBy("query_id", "chunk_id").agg((F.round(score, digits) if digits is not None else F.round(score, 12)).alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    return top(fused, "query_id", k, F.desc("score"), F.asc("chunk_id"))


def weighted(lists: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): sum of each list's score times its weight; lists without one weigh alike."""
    even = 1.0 / max(1, len(weights))
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("list")), F.lit(even))
    fused = lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("score") * weight), 8).alias("score"))
    return top(fused, "query_id", k, F.desc("score"), F.asc("chunk_id"))


def parent_context(hits: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Children replaced by their parents: (query_id, document_id, parent_chunk_index, content, page, score, matched, rank).

    ``content`` merges the parent's chunks in order without repeating overlaps; hits without a parent (index below 0 or
    unknown) stay alone.
    """
    found = cut(chunks.select("chunk_id", "document_id", "parent_chunk_index", "content", "page").join(small_side(hits.select("query_id", "chunk_id", "score")), "chunk_id"))
    keyed = F.coalesce(F.col("parent_chunk_index"), F.lit(-1)) >= 0
    grouped = found.where(keyed).groupBy("query_id", "document_id", "parent_chunk_index").agg(F.max("score").alias("score"), F.array_sort(F.collect_list("content")).alias("matched"))
    wanted = small_side(grouped.select("document_id", "parent_chunk_index").distinct())
    parents = chunks.join(wanted, ["document_id", "parent_chunk_index"], "left_semi").groupBy("document_id", "parent_chunk_index").agg(
        F.min("page").alias("page"), F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("rows")
    )
    parents = parents.select("document_id", "parent_chunk_index", "page", merge_overlapping(F.transform("rows", lambda r: r["content"])).alias("content"))
    whole = grouped.join(parents, ["document_id", "parent_chunk_index"])
    alone = found.where(~keyed).select("query_id", "document_id", "parent_chunk_index", "content", "page", "score", F.array("content").alias("matched"))
    return top(whole.unionByName(alone), "query_id", k, F.desc("score"), F.asc("document_id"), F.asc("parent_chunk_index"))


def diagnostics(questions: DataFrame, results: DataFrame, coverage_of: int = 5) -> DataFrame:
    """(query_id, retrieved_chunks, citation_count, top_score, evidence_coverage, vector_hits, bm25_hits); zeros without results."""
    has = lambda s: F.count_if(F.array_contains("sources", s))
    made = results.groupBy("query_id").agg(
        F.count("*").alias("retrieved_chunks"), F.count_distinct("document_id").alias("citation_count"), F.max("score").alias("top_score"),
        F.round(F.least(F.lit(1.0), F.count_distinct("document_id") / coverage_of), 4).alias("evidence_coverage"), has("vector").alias("vector_hits"), has("bm25").alias("bm25_hits"),
    )
    return questions.select("query_id").join(made, "query_id", "left").na.fill(0)


def no_answer(diagnosed: DataFrame, scoped: Column, least_score: float = 0.08, least_coverage: float = 0.18) -> DataFrame:
    """Adds ``grounded`` and ``reason``: whether a scoped question must be refused, and why."""
    reason = F.when(~scoped, None).when(F.col("retrieved_chunks") == 0, "no_results").when(F.col("top_score") < least_score, "low_retrieval_score").when(F.col("evidence_coverage") < least_coverage, "low_evidence_coverage")
    return diagnosed.withColumn("reason", reason).withColumn("grounded", F.col("reason").isNotNull())


def prompts(questions: DataFrame, results: DataFrame, thinking: bool = True) -> DataFrame:
    """(query_id, prompt): each question's results in rank order in the template, or the template without context if it has none.

    ``questions`` has (query_id, question), ``results`` (query_id, rank, document_id, page, content).
    """
    source = F.concat(F.lit("[来源: "), F.coalesce(F.col("document_id").cast("string"), F.lit("unknown")), F.lit(", 第 "), F.coalesce("page", F.lit(1)).cast("string"), F.lit(" 页]\n"), "content")
    blocks = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", source.alias("s")))).alias("rows"))
    context = F.array_join(F.transform("rows", lambda r: r["s"]), "\n\n")
    asked = questions.join(blocks, "query_id", "left")
    grounded = filled(P.THINKING if thinking else P.SIMPLE, version=F.lit(P.VERSION), context=context, question=F.col("question"))
    return asked.select("query_id", F.when(F.col("rows").isNull(), filled(P.WITHOUT_CONTEXT, question=F.col("question"))).otherwise(grounded).alias("prompt"))


def guarded(score: Callable[[pd.Series, pd.Series], np.ndarray], question: str = "question", content: str = "content", query: str = "query_id") -> Column:
    """A scorer of (questions, contents) that may fail, as a Column: null where it does.

    A batch that fails is scored again query by query, so a failure is that of the queries whose rows cause it.
    """

    @F.pandas_udf("double")
    def run(q: pd.Series, c: pd.Series, who: pd.Series) -> pd.Series:
        try:
            return pd.Series(np.asarray(score(q, c), dtype=np.float64))
        except Exception:  # whatever a model raises
            out = pd.Series(np.nan, index=q.index)
            for _, at in who.groupby(who, dropna=False).groups.items():
                try:
                    out.loc[at] = np.asarray(score(q.loc[at], c.loc[at]), dtype=np.float64)
                except Exception:
                    continue
            return out.where(out.notna(), None)

    return run(F.col(question), F.col(content), F.col(query))


def rerank(candidates: DataFrame, scorer: Column, k: int) -> DataFrame:
    """The k best of each query's candidates by ``scorer`` (built in, or ``guarded``), equal scores in the former order.

    Keeps the base score; adds rerank_score, original_rank, new_rank and rerank_applied. A query with a candidate that has no score
    (null or NaN) keeps its order, without scores and with rerank_applied false.
    """
    made = F.round(scorer, 6)
    scored = candidates.withColumnRenamed("rank", "original_rank").withColumn("rerank_score", F.when(~F.isnan(made), made))
    scored = scored.withColumn("rerank_applied", F.min(F.col("rerank_score").isNotNull()).over(Window.partitionBy("query_id")))
    scored = scored.withColumn("rerank_score", F.when(F.col("rerank_applied"), F.col("rerank_score")))
    return top(scored, "query_id", k, F.desc("rerank_score"), F.asc("original_rank")).withColumnRenamed("rank", "new_rank")


def hybrid_context(questions: DataFrame, near: DataFrame, lexical: DataFrame, chunks: DataFrame, scorer: Column, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """The whole hybrid retrieval of each question: (results, diagnostics).

    ``near`` and ``lexical`` are ranked hits (query_id, chunk_id, rank) of the two searches, 2k of each; ``questions`` has (query_id,
    question), normalised; ``scorer`` sees query_id, question and content. They are fused to 2k, replaced by their parents, reranked to k
    and enriched: (query_id, rank, chunk_id, document_id, page_no, source_type, content, score, rerank_score, rerank_applied). Diagnostics
    have a row for every question: rewritten_query, strategy, retrieved_chunks, citation_count (results with a matched text), top_score,
    evidence_coverage (their share), vector_hits, bm25_hits, rerank_applied.
    """
    lists = [tag(hits, name).select("query_id", "chunk_id", "rank", "sources") for hits, name in ((near, "vector"), (lexical, "bm25"))]
    wide = parent_context(rrf(lists[0].unionByName(lists[1]), 2 * k), chunks, 2 * k)
    best = rerank(wide.join(questions, "query_id"), scorer, k).withColumnRenamed("new_rank", "rank")
    best = cut(best)
    asked = small_side(best.select("document_id", "parent_chunk_index").distinct())
    types = chunks.join(asked, ["document_id", "parent_chunk_index"], "left_semi").groupBy("document_id", "parent_chunk_index").agg(F.min_by("type", "chunk_index").alias("type"))
    found = best.join(types, ["document_id", "parent_chunk_index"], "left").select(
        "query_id", "rank", F.concat("document_id", F.lit("_parent_"), "parent_chunk_index").alias("chunk_id"), "document_id", F.col("page").alias("page_no"), F.coalesce("type", F.lit("text")).alias("source_type"),
        "content", "score", "rerank_score", "rerank_applied", (F.size(F.filter("matched", lambda m: m != "")) > 0).alias("cited"),
    )
    made = found.groupBy("query_id").agg(F.count("*").alias("retrieved_chunks"), F.count_if("cited").alias("citation_count"), F.round(F.min_by("score", "rank"), 4).alias("top_score"), F.bool_or("rerank_applied").alias("rerank_applied"))
    hits = [h.groupBy("query_id").agg(F.count("*").alias(n)) for h, n in ((near, "vector_hits"), (lexical, "bm25_hits"))]
    told = questions.select("query_id", F.col("question").alias("rewritten_query")).join(made, "query_id", "left").join(hits[0], "query_id", "left").join(hits[1], "query_id", "left")
    told = told.na.fill(0).na.fill(False, ["rerank_applied"])
    coverage = F.when(F.col("retrieved_chunks") > 0, F.round(F.col("citation_count") / F.col("retrieved_chunks"), 4)).otherwise(0.0)
    return found.drop("cited"), told.withColumns({"evidence_coverage": coverage, "strategy": F.when(F.col("rerank_applied"), "hybrid_rerank").otherwise("hybrid")})

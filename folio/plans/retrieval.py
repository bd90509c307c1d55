"""Queries of retrieval and fusion. Vector hits of question q are the nearest of the vector with its id; vector v stands for the first chunk of document v."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import prompts as P
from folio.functions import text as X
from folio.operators import retrieval as R
from folio.plans.lexical import BM25_TOP, chunk_index
from folio.plans.registry import Tables, query
from folio.sources.store import small_side

_NEAR = """nn AS (SELECT q.vec_id AS query_id, v.vec_id AS vec, v.label AS label, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])), 8) AS score
FROM (SELECT * FROM embeddings WHERE {where}) q, embeddings v)"""
_VECTOR = _NEAR.replace("{where}", "vec_id IN (SELECT query_id FROM {f_questions})") + """,
vector AS (SELECT query_id, concat(vec, '_chunk_0') AS chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concat(vec, '_chunk_0')) AS rank FROM nn QUALIFY rank <= 10)"""
_RRF = f"""{BM25_TOP}, {_VECTOR},
lists AS (SELECT query_id, chunk_id, rank, 'vector' AS src FROM vector UNION ALL SELECT query_id, chunk_id, rank, 'bm25' FROM bm25),
rrf AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 4) AS score, array_to_string(list_sort(list_distinct(list(src))), ',') AS sources FROM lists GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM rrf QUALIFY rank <= 10)"""
_PARENT = f"""{_RRF}, found AS (SELECT f.query_id, f.score, c.* FROM fused f JOIN {{f_chunks}} c USING (chunk_id)),
grp AS (SELECT query_id, document_id, parent_chunk_index, max(score) AS score, count(*)::INT AS matched FROM found GROUP BY ALL),
pages AS (SELECT document_id, parent_chunk_index, min(page) AS page FROM {{f_chunks}} GROUP BY ALL),
parents AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, parent_chunk_index) AS rank FROM grp JOIN pages USING (document_id, parent_chunk_index) QUALIFY rank <= 10)"""
_RESULT = f"{_RRF}, res AS (SELECT f.*, c.document_id, c.content, c.page, c.type FROM fused f JOIN {{f_chunks}} c USING (chunk_id) WHERE rank <= 5)"
_DIAG = f"""{_RESULT}, d AS (SELECT q.query_id, count(chunk_id) AS retrieved_chunks, count(DISTINCT document_id) AS citation_count, coalesce(max(score), 0.0) AS top_score, round(least(1.0, count(DISTINCT document_id) / 5), 4) AS evidence_coverage,
count(*) FILTER (contains(sources, 'vector')) AS vector_hits, count(*) FILTER (contains(sources, 'bm25')) AS bm25_hits FROM {{f_questions}} q LEFT JOIN res USING (query_id) GROUP BY q.query_id)"""


def vector_hits(t: Tables, k: int = 10) -> DataFrame:
    vectors = t("embeddings").select(F.concat("vec_id", F.lit("_chunk_0")).alias("chunk_id"), F.col("vec_id").alias("document_id"), "embedding")
    asked = t("embeddings").join(t("f_questions").select("query_id"), F.col("vec_id") == F.col("query_id")).select("query_id", "embedding")
    return R.vector_top(asked, vectors, k)


def fused(t: Tables, k: int = 10) -> DataFrame:
    lists = R.tag(vector_hits(t), "vector").select("query_id", "chunk_id", "rank", "sources").unionByName(R.tag(chunk_index(t).top(t("f_questions")), "bm25").select("query_id", "chunk_id", "rank", "sources"))
    return R.rrf(lists, k)


def results(t: Tables) -> DataFrame:
    return t("f_chunks").select("chunk_id", "document_id", "content", "page", "type").join(small_side(fused(t).where("rank <= 5")), "chunk_id")


@query(f"WITH {_NEAR.replace('{where}', 'vec_id % 50 = 0')} SELECT query_id, vec AS chunk_id, label::BIGINT AS document_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec) AS rank FROM nn QUALIFY rank <= 10")
def r01_vector_top(t: Tables) -> DataFrame:
    asked = t("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.vector_top(asked, t("f_chunk_vectors"), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_NEAR.replace('{where}', 'vec_id % 50 = 0')} SELECT query_id, vec AS chunk_id, label::BIGINT AS document_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec) AS rank FROM nn JOIN {{f_vector_scopes}} s USING (query_id) WHERE s.document_id = label QUALIFY rank <= 10")
def r01_scoped_vector_top(t: Tables) -> DataFrame:
    asked = t("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.vector_top(asked, t("f_chunk_vectors"), 10, allowed=t("f_vector_scopes")).withColumn("score", F.round("score", 6))


@query(f"WITH {_VECTOR} SELECT query_id, chunk_id, round(greatest(0.0, 1 - (1 - score)), 6) AS score, 'vector' AS sources FROM vector")
def r02_coerce_and_tag(t: Tables) -> DataFrame:
    hits = vector_hits(t).select("query_id", "chunk_id", (1 - F.col("score")).alias("distance"), F.lit(None).cast("double").alias("score"))
    return R.tag(hits, "vector").select("query_id", "chunk_id", F.round(R.coerce_score(F.col("score"), F.col("distance")), 6).alias("score"), F.array_join("sources", ",").alias("sources"))


@query(f"WITH {_RRF} SELECT * FROM fused")
def r03_hybrid_rrf(t: Tables) -> DataFrame:
    return fused(t).withColumn("sources", F.array_join("sources", ","))


@query(f"WITH {_PARENT} SELECT query_id, document_id, parent_chunk_index, page, score, matched, rank FROM parents")
def r04_parent_context(t: Tables) -> DataFrame:
    return R.parent_context(fused(t), t("f_chunks"), 10).select("query_id", "document_id", "parent_chunk_index", "page", "score", F.size("matched").alias("matched"), "rank")


@query(f"WITH {_RESULT} SELECT query_id, rank, chunk_id, document_id, page AS page_no, coalesce(type, 'text') AS source_type, score FROM res")
def r05_enrich(t: Tables) -> DataFrame:
    return results(t).select("query_id", "rank", "chunk_id", "document_id", F.col("page").alias("page_no"), F.coalesce("type", F.lit("text")).alias("source_type"), "score")


@query(f"WITH {_DIAG} SELECT * FROM d")
def r06_diagnostics(t: Tables) -> DataFrame:
    return R.diagnostics(t("f_questions"), results(t))


@query(f"WITH {_DIAG} SELECT query_id, CASE WHEN retrieved_chunks = 0 THEN 'no_results' WHEN top_score < 0.02 THEN 'low_retrieval_score' WHEN evidence_coverage < 0.5 THEN 'low_evidence_coverage' END AS reason, retrieved_chunks = 0 OR top_score < 0.02 OR evidence_coverage < 0.5 AS grounded FROM d")
def r07_no_answer(t: Tables) -> DataFrame:
    return R.no_answer(R.diagnostics(t("f_questions"), results(t)), F.lit(True), 0.02, 0.5).select("query_id", "reason", "grounded")


@query(rf"""WITH {_RESULT}, s AS (SELECT query_id, chunk_id, rank AS original_rank, score, list_distinct(list_filter(regexp_extract_all(lower(question), '[0-9a-z]+'), lambda w: w NOT IN ({", ".join(f"'{w}'" for w in X.STOPWORDS)}))) AS x,
list_distinct(list_filter(regexp_extract_all(lower(content), '[0-9a-z]+'), lambda w: w NOT IN ({", ".join(f"'{w}'" for w in X.STOPWORDS)}))) AS y FROM res JOIN {{f_questions}} USING (query_id)),
j AS (SELECT *, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS rerank_score FROM s)
SELECT query_id, chunk_id, original_rank, score, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, original_rank) AS new_rank FROM j""")
def r08_rerank(t: Tables) -> DataFrame:
    scorer = X.jaccard(X.tokens(F.col("question")), X.tokens(F.col("content")))
    done = R.rerank(results(t).join(t("f_questions"), "query_id"), scorer, 5)
    return done.select("query_id", "chunk_id", "original_rank", "score", "rerank_score", "new_rank")


_MULTI = _NEAR.replace("{where}", "vec_id % 50 = 0") + """, per AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec) AS rank FROM nn QUALIFY rank <= 3)"""


def per_document(t: Tables, k: int = 3) -> DataFrame:
    """The k nearest vectors in each document, for every query of the stated set."""
    asked = t("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.vector_top(asked, t("f_chunk_vectors"), k, each=True)


@query(f"WITH {_MULTI} SELECT query_id, label::BIGINT AS document_id, vec AS chunk_id, round(score, 4) AS score, rank FROM per")
def r09_multi_document(t: Tables) -> DataFrame:
    return per_document(t).withColumn("score", F.round("score", 4))


@query(f"WITH {_MULTI}, f AS (SELECT query_id, concat(label, '_', vec) AS chunk_id, round(sum(1.0 / (60 + rank)), 12) AS score FROM per GROUP BY ALL) SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f QUALIFY rank <= 20")
def r10_multi_rrf(t: Tables) -> DataFrame:
    lists = R.tag(per_document(t).withColumn("chunk_id", F.concat_ws("_", "document_id", "chunk_id")), "vector")
    return R.rrf(lists, 20, digits=None).select("query_id", "chunk_id", "score", "rank")


@query(f"""WITH {BM25_TOP}, {_VECTOR}, l AS (SELECT query_id, chunk_id, score * 0.7 AS s FROM vector UNION ALL SELECT query_id, chunk_id, score * 0.3 FROM bm25), f AS (SELECT query_id, chunk_id, round(sum(s), 8) AS score FROM l GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f QUALIFY rank <= 10""")
def r11_weighted_fusion(t: Tables) -> DataFrame:
    cols = ["query_id", "chunk_id", "score"]
    lists = vector_hits(t).select(*cols, F.lit("vector").alias("list")).unionByName(chunk_index(t).top(t("f_questions")).select(*cols, F.lit("bm25").alias("list")))
    return R.weighted(lists, {"vector": 0.7, "bm25": 0.3}, 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_RESULT} SELECT query_id, document_id, count(*) AS matched_chunks, round(avg(score), 4) AS avg_score FROM res GROUP BY ALL")
def r12_document_stats(t: Tables) -> DataFrame:
    return results(t).groupBy("query_id", "document_id").agg(F.count("*").alias("matched_chunks"), F.round(F.avg("score"), 4).alias("avg_score"))


@query(f"WITH {_RESULT} SELECT query_id, rank, coalesce(c.file_name, concat('document ', document_id)) AS document_name, page, chunk_id, left(content, 200) AS content, score FROM res LEFT JOIN {{f_docs_catalog}} c ON c.id = res.document_id")
def r13_citations(t: Tables) -> DataFrame:
    named = results(t).join(t("f_docs_catalog").select(F.col("id").alias("document_id"), "file_name"), "document_id", "left")
    name = F.coalesce("file_name", F.concat(F.lit("document "), "document_id"))
    return named.select("query_id", "rank", name.alias("document_name"), "page", "chunk_id", F.left("content", F.lit(200)).alias("content"), "score")


_WORDS = f"list_distinct(list_filter(regexp_extract_all(lower({{0}}), '[0-9a-z]+'), lambda w: w NOT IN ({', '.join(repr(w) for w in X.STOPWORDS)})))"
_HYBRID = rf"""{_PARENT}, asked AS (SELECT query_id, regexp_replace(regexp_replace(question, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS question FROM {{f_questions}}),
texts AS (SELECT document_id, parent_chunk_index, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS content, arg_min(type, chunk_index) AS type FROM {{f_chunks}} GROUP BY ALL),
pair AS (SELECT p.*, type, {_WORDS.format('question')} AS x, {_WORDS.format('content')} AS y FROM parents p JOIN asked USING (query_id) JOIN texts USING (document_id, parent_chunk_index)),
jac AS (SELECT *, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS rerank_score FROM pair),
final AS (SELECT query_id, concat(document_id, '_parent_', parent_chunk_index) AS chunk_id, document_id, page AS page_no, type AS source_type, score, rerank_score, true AS rerank_applied, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS new_rank FROM jac QUALIFY new_rank <= 5)"""


def hybrid(t: Tables) -> tuple[DataFrame, DataFrame]:
    asked = t("f_questions").select("query_id", X.normalize_query(F.col("question")).alias("question"))
    scorer = X.jaccard(X.tokens(F.col("question")), X.tokens(F.col("content")))
    return R.hybrid_context(asked, vector_hits(t), chunk_index(t).top(asked), t("f_chunks"), scorer, 5)


@query(f"WITH {_HYBRID} SELECT query_id, new_rank AS rank, chunk_id, document_id, page_no, source_type, score, rerank_score, rerank_applied FROM final")
def r14_hybrid_pipeline(t: Tables) -> DataFrame:
    return hybrid(t)[0].drop("content")


@query(f"""WITH {_HYBRID}, made AS (SELECT query_id, count(*) AS n, round(arg_min(score, new_rank), 4) AS top_score FROM final GROUP BY query_id)
SELECT query_id, question AS rewritten_query, coalesce(n, 0) AS retrieved_chunks, coalesce(n, 0) AS citation_count, coalesce(top_score, 0) AS top_score, (n IS NOT NULL)::INT::DOUBLE AS evidence_coverage,
(SELECT count(*) FROM vector v WHERE v.query_id = asked.query_id) AS vector_hits, (SELECT count(*) FROM bm25 b WHERE b.query_id = asked.query_id) AS bm25_hits, n IS NOT NULL AS rerank_applied, CASE WHEN n IS NULL THEN 'hybrid' ELSE 'hybrid_rerank' END AS strategy FROM asked LEFT JOIN made USING (query_id)""")
def r14_diagnostics(t: Tables) -> DataFrame:
    return hybrid(t)[1]


@query(f"""WITH {_DIAG}, g AS (SELECT *, CASE WHEN retrieved_chunks = 0 THEN 'no_results' WHEN top_score < 0.02 THEN 'low_retrieval_score' WHEN evidence_coverage < 0.5 THEN 'low_evidence_coverage' END AS reason FROM d)
SELECT query_id, 'hybrid' AS strategy, citation_count, reason AS fallback_reason, top_score, evidence_coverage, CASE WHEN reason IS NOT NULL THEN '{R.REFUSAL}' END AS answer FROM g""")
def r15_answer_record(t: Tables) -> DataFrame:
    judged = R.no_answer(R.diagnostics(t("f_questions"), results(t)), F.lit(True), 0.02, 0.5)
    return judged.select("query_id", F.lit("hybrid").alias("strategy"), "citation_count", F.col("reason").alias("fallback_reason"), "top_score", "evidence_coverage", F.when(F.col("grounded"), F.lit(R.REFUSAL)).alias("answer"))


def _template(text: str) -> str:
    """DuckDB: a template with its version, the context ``ctx`` and ``question`` in place."""
    quoted = text.replace("'", "''").replace("{version}", P.VERSION)
    return f"replace(replace('{quoted}', '{{context}}', ctx), '{{question}}', question)"


_PROMPT = f"""WITH {_RESULT}, c AS (SELECT q.query_id, any_value(question) AS question, string_agg(CASE WHEN chunk_id IS NOT NULL THEN concat('[来源: ', document_id, ', 第 ', page, ' 页]', chr(10), content) END, chr(10)||chr(10) ORDER BY rank) AS ctx
FROM {{f_questions}} q LEFT JOIN res ON res.query_id = q.query_id GROUP BY q.query_id)
SELECT query_id, CASE WHEN ctx IS NULL THEN {_template(P.WITHOUT_CONTEXT).replace('ctx', chr(39) * 2)} ELSE {{template}} END AS prompt FROM c"""


@query(_PROMPT.replace("{template}", _template(P.THINKING)))
def r16_prompt(t: Tables) -> DataFrame:
    return R.prompts(t("f_questions"), results(t))


@query(_PROMPT.replace("{template}", _template(P.SIMPLE)))
def r16_simple_prompt(t: Tables) -> DataFrame:
    return R.prompts(t("f_questions"), results(t), thinking=False)

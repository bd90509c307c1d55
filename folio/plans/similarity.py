"""Queries of similarity and recommendation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators import lexical as L
from folio.operators import similarity as M
from folio.plans.lexical import TFIDF, token_set
from folio.plans.registry import Tables, query

_MEAN = """mv AS (SELECT label AS document_id, list(x ORDER BY pos) AS embedding FROM (SELECT label, pos, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label)"""
_COS = "list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"
_PAIRS = _COS.format(a="x.embedding", b="y.embedding")
_NEXT = "pr AS (SELECT x.doc_id AS a, y.doc_id AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1)"


def document_pairs(t: Tables) -> DataFrame:
    """Each document with the next by id."""
    ids = t("documents").select(F.col("doc_id").alias("a"))
    return ids.join(ids.select(F.col("a").alias("b")), F.col("b") == F.col("a") + 1)


@query(f"WITH {_MEAN} SELECT document_id::BIGINT AS document_id, list_transform(embedding, lambda x: round(x, 5) + 0.0) AS embedding FROM mv")
def m01_mean_vector(t: Tables) -> DataFrame:
    """Rounded means; one that rounds to zero is a zero without a sign."""
    return M.mean_vectors(t("f_chunk_vectors")).select("document_id", F.transform("embedding", lambda x: F.round(x, 5) + 0.0).alias("embedding"))


@query(f"WITH {_MEAN} SELECT x.document_id::BIGINT AS a, y.document_id::BIGINT AS b, round({_PAIRS}, 4) AS similarity FROM mv x JOIN mv y ON y.document_id = x.document_id + 1")
def m02_cosine(t: Tables) -> DataFrame:
    means = M.mean_vectors(t("f_chunk_vectors"))
    x, y = means.select(F.col("document_id").alias("a"), F.col("embedding").alias("x")), means.select(F.col("document_id").alias("b"), F.col("embedding").alias("y"))
    return x.join(y, F.col("b") == F.col("a") + 1).select("a", "b", F.round(M.cosine(F.col("x"), F.col("y")), 4).alias("similarity"))


@query(f"""WITH s AS (SELECT x.vec_id AS query_id, y.vec_id AS document_id, round({_COS.format(a='x.embedding::DOUBLE[]', b='y.embedding::DOUBLE[]')}, 8) AS score FROM embeddings x JOIN embeddings y ON x.vec_id % 50 = 0 AND y.vec_id <> x.vec_id),
g AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total FROM s WHERE score >= 0.2)
SELECT query_id, document_id, round(score, 4) AS similarity, total, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM g QUALIFY rank <= 5""")
def m03_similar_documents(t: Tables) -> DataFrame:
    asked = t("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return M.similar_documents(asked, t("embeddings").select(F.col("vec_id").alias("document_id"), "embedding"), 0.2, 5)


_WORDS = f"{TFIDF}, kw AS (SELECT doc_id, list(keyword ORDER BY keyword) AS words FROM tfidf GROUP BY doc_id)"


@query(f"""WITH {_WORDS}, {_NEXT}, emb AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), j AS (SELECT a, b, coalesce(x.words, []) AS wa, coalesce(y.words, []) AS wb FROM pr LEFT JOIN kw x ON x.doc_id = a LEFT JOIN kw y ON y.doc_id = b),
o AS (SELECT a, b, least(6, len(list_intersect(wa, wb))) AS n, len(list_distinct(list_concat(wa, wb))) AS u FROM j)
SELECT a, b, round(CASE WHEN u > 0 THEN n / u ELSE 0.0 END, 4) AS overlap, round({_COS.format(a='p.e', b='q.e')}, 4) AS semantic, round(0.75 * {_COS.format(a='p.e', b='q.e')} + 0.25 * CASE WHEN u > 0 THEN n / u ELSE 0.0 END, 3) AS similarity
FROM o JOIN emb p ON p.vec_id = a JOIN emb q ON q.vec_id = b""")
def m04_blended(t: Tables) -> DataFrame:
    words = L.tfidf_keywords(t("documents"), "doc_id", "text", 10).groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("keyword").alias("words"))
    scored = M.keyword_overlap(document_pairs(t), words)
    vec = t("embeddings")
    scored = scored.join(vec.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), "a").join(vec.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "b")
    semantic = M.cosine(F.col("x"), F.col("y"))
    return scored.select("a", "b", F.round("overlap", 4).alias("overlap"), F.round(semantic, 4).alias("semantic"), F.round(M.blended(semantic, F.col("overlap")), 3).alias("similarity"))


_CAND = """cand AS (SELECT x.id AS a, y.id AS b, y.created_at FROM {f_docs_catalog} x JOIN {f_docs_catalog} y USING (user_id) WHERE y.status = 'completed' AND x.id <> y.id QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY y.created_at DESC, y.id) <= 100)"""


@query(f"""WITH {_WORDS.replace("<= 10", "<= 15")}, {_CAND}, tk AS (SELECT doc_id, {token_set('text')} AS s FROM documents WHERE text <> ''), ev AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 3 = 0),
j AS (SELECT a, b, created_at, x.s AS sa, y.s AS sb, p.e AS ea, q.e AS eb, coalesce(k.words, []) AS wa, coalesce(l.words, []) AS wb
  FROM cand JOIN tk x ON x.doc_id = a JOIN tk y ON y.doc_id = b LEFT JOIN ev p ON p.vec_id = a LEFT JOIN ev q ON q.vec_id = b LEFT JOIN kw k ON k.doc_id = a LEFT JOIN kw l ON l.doc_id = b),
o AS (SELECT *, list_sort(list_intersect(wa, wb))[:6] AS topics, len(list_distinct(list_concat(wa, wb))) AS u, CASE WHEN ea IS NOT NULL AND eb IS NOT NULL THEN {_COS.format(a='ea', b='eb')}
  WHEN len(sa) = 0 OR len(sb) = 0 THEN 0.0 ELSE len(list_intersect(sa, sb)) / len(list_distinct(list_concat(sa, sb))) END AS semantic FROM j),
f AS (SELECT *, CASE WHEN u > 0 THEN len(topics) / u ELSE 0.0 END AS overlap FROM o), g AS (SELECT *, round(0.75 * semantic + 0.25 * overlap, 9) AS score FROM f)
SELECT a, b, round(semantic, 4) AS semantic, round(overlap, 4) AS overlap, round(score, 4) AS similarity, array_to_string(topics, ',') AS topics, row_number() OVER (PARTITION BY a ORDER BY round(score, 4) DESC, created_at DESC, b) AS rank FROM g WHERE score >= 0.4 QUALIFY rank <= 5""")
def m04_recommend(t: Tables) -> DataFrame:
    """Recommendations for every document among the latest of its user. Documents whose id 3 divides have a vector; for the others, tokens stand."""
    words = L.tfidf_keywords(t("documents"), "doc_id", "text", 15).groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("keyword").alias("words"))
    vectors = t("embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("id"), "embedding")
    made = M.recommend_latest(t("f_docs_catalog"), t("f_docs_catalog"), t("documents").select(F.col("doc_id").alias("id"), "text"), words, vectors, 0.4, 5)
    return made.withColumn("topics", F.array_join("topics", ","))


@query()
def m05_compare_score(t: Tables) -> DataFrame:
    texts = t("documents").select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    after = t("documents").select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    scored = M.compared(texts.join(after, "a"), "ta", "tb").select("a", "b", F.round("semantic", 4).alias("semantic"), F.round("lexical", 4).alias("lexical"))
    return scored.select("a", "b", "semantic", "lexical", F.round(0.65 * F.col("semantic") + 0.35 * F.col("lexical"), 4).alias("overall"))


@query(f"""WITH {TFIDF}, {_NEXT}, l AS (SELECT a, b, keyword, score AS sa FROM pr JOIN tfidf ON doc_id = a), r AS (SELECT a, b, keyword, score AS sb FROM pr JOIN tfidf ON doc_id = b),
m AS (SELECT a, b, CASE WHEN sa IS NULL THEN 'unique_b' WHEN sb IS NULL THEN 'unique_a' ELSE 'common' END AS kind, keyword, round(coalesce(sa, 0) + coalesce(sb, 0), 4) AS score FROM l FULL OUTER JOIN r USING (a, b, keyword))
SELECT *, row_number() OVER (PARTITION BY a, b, kind ORDER BY score DESC, keyword) AS rank FROM m QUALIFY rank <= 5""")
def m06_topic_split(t: Tables) -> DataFrame:
    words = L.tfidf_keywords(t("documents"), "doc_id", "text", 10).withColumnRenamed("doc_id", "id")
    return M.topic_split(document_pairs(t), words, 5)


_LEVEL = "CASE WHEN s >= 0.8 THEN '两份文档高度相似' WHEN s >= 0.6 THEN '两份文档中等相似' WHEN s >= 0.4 THEN '两份文档存在部分相似' ELSE '两份文档差异较大' END"
_SAID = "coalesce(array_to_string((list(keyword ORDER BY rank) FILTER (kind = '{0}'))[:{1}], '、'), '{2}')"


@query(f"""WITH {TFIDF}, {_NEXT}, l AS (SELECT a, b, keyword, score AS sa FROM pr JOIN tfidf ON doc_id = a), r AS (SELECT a, b, keyword, score AS sb FROM pr JOIN tfidf ON doc_id = b),
m AS (SELECT a, b, CASE WHEN sa IS NULL THEN 'unique_b' WHEN sb IS NULL THEN 'unique_a' ELSE 'common' END AS kind, keyword, round(coalesce(sa, 0) + coalesce(sb, 0), 4) AS score FROM l FULL OUTER JOIN r USING (a, b, keyword)),
k AS (SELECT *, row_number() OVER (PARTITION BY a, b, kind ORDER BY score DESC, keyword) AS rank FROM m), tp AS (SELECT a, b, {_SAID.format('common', 5, '暂无明显共同主题')} AS c, {_SAID.format('unique_a', 3, '暂无明显独有主题')} AS ua, {_SAID.format('unique_b', 3, '暂无明显独有主题')} AS ub FROM k GROUP BY a, b),
j AS (SELECT a, b, abs(coalesce(x.chunk_count, 0) - coalesce(y.chunk_count, 0)) AS chunk_delta, abs(x.file_size - y.file_size) AS size_delta, least(x.file_size, y.file_size) / greatest(x.file_size, y.file_size, 1) AS s
FROM pr JOIN {{f_docs_catalog}} x ON x.id = a JOIN {{f_docs_catalog}} y ON y.id = b)
SELECT a, b, chunk_delta, size_delta, {_LEVEL} AS level, concat({_LEVEL}, '。共同主题：', coalesce(c, '暂无明显共同主题'), '。文档A偏向：', coalesce(ua, '暂无明显独有主题'), '。文档B偏向：', coalesce(ub, '暂无明显独有主题'), '。') AS summary FROM j LEFT JOIN tp USING (a, b)""")
def m07_structure_delta(t: Tables) -> DataFrame:
    """The ratio of sizes stands for the similarity of a pair."""
    cat = t("f_docs_catalog").select("id", F.coalesce("chunk_count", F.lit(0)).alias("c"), F.col("file_size").alias("s"))
    x, y = (cat.select(F.col("id").alias(k), F.col("c").alias(f"c{k}"), F.col("s").alias(f"s{k}")) for k in "ab")
    words = L.tfidf_keywords(t("documents"), "doc_id", "text", 10).withColumnRenamed("doc_id", "id")
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "keyword")))), lambda r: r["keyword"]).alias(kind)
    topics = M.topic_split(document_pairs(t), words, 5).groupBy("a", "b").agg(of("common"), of("unique_a"), of("unique_b"))
    both = document_pairs(t).join(x, "a").join(y, "b").join(topics, ["a", "b"], "left")
    alike = F.least("sa", "sb") / F.greatest("sa", "sb", F.lit(1))
    summary = M.compare_summary(alike, F.col("common"), F.col("unique_a"), F.col("unique_b"))
    return both.select("a", "b", F.abs(F.col("ca") - F.col("cb")).alias("chunk_delta"), F.abs(F.col("sa") - F.col("sb")).alias("size_delta"), M.verdict(alike).alias("level"), summary.alias("summary"))


_RECENT = """rc AS (SELECT * FROM {f_query_history} QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY last_queried DESC, user_id, question) <= 1000),
sg AS (SELECT h.document_id, q.vec_id AS query_id, h.question, h.query_count, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])), 8) AS similarity, h.user_id
FROM rc h JOIN embeddings v ON v.vec_id = h.vec_id JOIN embeddings q ON q.vec_id % 50 = 0 AND q.label % 20 = h.document_id)"""


def suggestions(t: Tables) -> DataFrame:
    """Recent history rows of each query vector's document with their similarity."""
    recent = L.top(t("f_query_history"), "document_id", 1000, F.desc("last_queried"), F.asc("user_id"), F.asc("question")).drop("rank")
    vec = t("embeddings")
    asked = vec.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), (F.col("label") % 20).cast("long").alias("document_id"), F.col("embedding").alias("q"))
    rows = recent.join(vec.select("vec_id", F.col("embedding").alias("v")), "vec_id").join(asked, "document_id")
    return rows.withColumn("similarity", F.round(M.cosine(F.col("q"), F.col("v")), 8))


@query(f"WITH {_RECENT} SELECT query_id, document_id, user_id, question, round(similarity, 4) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, question, user_id) AS rank FROM sg WHERE similarity >= 0.1 QUALIFY rank <= 10")
def m08_suggest_similar(t: Tables) -> DataFrame:
    best = L.top(suggestions(t).where("similarity >= 0.1"), "query_id", 10, F.desc("similarity"), F.asc("question"), F.asc("user_id"))
    return best.select("query_id", "document_id", "user_id", "question", F.round("similarity", 4).alias("similarity"), "rank")


@query("SELECT document_id, user_id, question, query_count, 1.0::DOUBLE AS similarity, row_number() OVER (PARTITION BY document_id ORDER BY query_count DESC, question, user_id) AS rank FROM {f_query_history} QUALIFY rank <= 5")
def m09_suggest_popular(t: Tables) -> DataFrame:
    best = L.top(t("f_query_history"), "document_id", 5, F.desc("query_count"), F.asc("question"), F.asc("user_id"))
    return best.select("document_id", "user_id", "question", "query_count", F.lit(1.0).alias("similarity"), "rank")


@query(f"""WITH {_RECENT}, f AS (SELECT * FROM sg WHERE length(question) >= 2 AND similarity >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id, question ORDER BY similarity DESC, query_count DESC) = 1),
r AS (SELECT query_id, question, round(0.7 * similarity + 0.3 * ln(1 + query_count) / 10, 6) AS final FROM f)
SELECT query_id, question, final, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, question) AS rank FROM r QUALIFY rank <= 5""")
def m10_rank_suggestions(t: Tables) -> DataFrame:
    return M.rank_suggestions(suggestions(t), ["query_id"], 5, 0.1).select("query_id", "question", "final", "rank")


@query("""SELECT user_id, question, document_id, sum(n)::BIGINT AS query_count, max(ts) AS last_queried, min(ts) AS created_at FROM
(SELECT user_id, concat(event_type, ' question ', CAST(floor(value/50) AS INT)) AS question, user_id % 20 AS document_id, 1 AS n, ts FROM events UNION ALL
SELECT user_id, concat(event_type, ' question ', CAST(floor(value/50) AS INT)), user_id % 20, 1, ts FROM events WHERE event_type = 'click') GROUP BY ALL""")
def m11_history_upsert(t: Tables) -> DataFrame:
    old = t("f_query_history").select("user_id", "question", "document_id", "query_count", "last_queried", "created_at")
    asked = F.expr("concat(event_type, ' question ', CAST(floor(value/50) AS INT))")
    new = t("events").where("event_type = 'click'").select("user_id", asked.alias("question"), (F.col("user_id") % 20).alias("document_id"), F.lit(1).cast("long").alias("query_count"), F.col("ts").alias("last_queried"), F.col("ts").alias("created_at"))
    return M.merge_history(old, new)

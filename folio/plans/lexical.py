"""Queries of lexical analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators import evidence as V
from folio.operators import lexical as L
from folio.operators.index import LexicalIndex
from folio.plans.registry import Tables, query
from folio.plans.segments import _SECTIONS, BLOCKS, LOW
from folio.sources.store import shared_dir, snapshot

_STOP = "(" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + ")"
_TERMS = "(" + ", ".join(f"'{w}'" for w in X.STOP_TERMS) + ")"


def toks(source: str, key: str, text: str) -> str:
    """DuckDB: one row per token, stop words out."""
    return f"(SELECT {key}, token FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[0-9a-z]+')) AS token FROM {source}) WHERE token NOT IN {_STOP})"


def sents(source: str, key: str, text: str) -> str:
    """DuckDB: (key, i, sentence), i from 0."""
    return rf"""(SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY k) - 1 AS i, s AS sentence FROM (SELECT {key}, k, regexp_replace(p, '^\s+|\s+$', '', 'g') AS s FROM
 (SELECT {key}, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (SELECT {key}, string_split(regexp_replace({text}, '([。！？!?；;.\n])', '\1' || chr(1), 'g'), chr(1)) AS ps FROM {source}))) WHERE s <> '')"""


TFIDF = f"""sent AS {sents('documents', 'doc_id', 'text')},
st AS (SELECT doc_id, i, token FROM (SELECT doc_id, i, unnest(regexp_extract_all(lower(sentence), '[0-9a-z]+')) AS token FROM sent) WHERE token NOT IN {_STOP}),
w AS (SELECT doc_id, token AS keyword, count(*) AS frequency, count(DISTINCT i) AS df FROM st GROUP BY ALL), sz AS (SELECT doc_id, count(DISTINCT i) AS docs, count(*) AS total FROM st GROUP BY doc_id),
ti AS (SELECT doc_id, keyword, frequency, round(frequency / total * (ln((docs + 1) / (df + 1)) + 1), 9) AS x FROM w JOIN sz USING (doc_id)),
tfidf AS (SELECT doc_id, keyword, round(x, 4) AS score, frequency FROM ti QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY x DESC, keyword) <= 10)"""

BM25 = f"""tok AS {toks('{f_chunks}', 'chunk_id', 'content')}, tf AS (SELECT chunk_id, token, count(*) AS n FROM tok GROUP BY ALL), dl AS (SELECT chunk_id, sum(n) AS dl FROM tf GROUP BY ALL),
al AS (SELECT (SELECT count(*) FROM {{f_chunks}}) AS docs, (SELECT count(*) FROM tok) / (SELECT count(*) FROM {{f_chunks}}) AS avgdl),
rawidf AS (SELECT token, ln(docs - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT token, count(*) AS df FROM tf GROUP BY ALL), al),
idf AS (SELECT token, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM rawidf) ELSE idf END AS idf FROM rawidf),
ix AS (SELECT token, chunk_id, idf * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS weight FROM tf JOIN dl USING (chunk_id) JOIN idf USING (token), al)"""
BM25_TOP = f"""{BM25}, qt AS (SELECT query_id, token, count(*) AS m FROM {toks('{f_questions}', 'query_id', 'question')} GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(sum(m * weight), 8) AS score FROM qt JOIN ix USING (token) GROUP BY ALL) QUALIFY rank <= 10),
bm25 AS (SELECT * FROM bm WHERE score > 0)"""


def chunk_index(t: Tables) -> LexicalIndex:
    """The index of the chunks, written once for a snapshot of the documents and shared by all queries of an application."""
    name = snapshot(t.spark, f"{t.sf_dir}/documents.parquet")
    return LexicalIndex.of(t("f_chunks"), f"{shared_dir(t.spark)}/lexical-index-{t.spark.sparkContext.applicationId}-{name}")


@query(f"SELECT doc_id, token, count(*) AS n FROM {toks('documents', 'doc_id', 'text')} GROUP BY ALL")
def l01_tokens(t: Tables) -> DataFrame:
    return L.term_counts(t("documents"), "doc_id", "text")


@query(f"SELECT doc_id, token, count(*) AS n FROM {toks('documents', 'doc_id', 'text')} GROUP BY ALL")
def l01_all_tokens(t: Tables) -> DataFrame:
    return l01_tokens(t)


@query(f"SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_extract_all(lower(question), '[A-Za-z0-9]+')) AS term FROM {{f_questions}}) WHERE length(term) > 1 AND term NOT IN {_TERMS} AND NOT regexp_full_match(term, '[0-9]+')")
def l02_query_terms(t: Tables) -> DataFrame:
    return t("f_questions").select("query_id", F.explode(X.query_terms(F.col("question"))).alias("term"))


@query(f"SELECT doc_id, token, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id)::BIGINT AS total FROM {toks('documents', 'doc_id', 'text')} GROUP BY doc_id, token")
def l03_term_frequency(t: Tables) -> DataFrame:
    counts = L.term_counts(t("documents"), "doc_id", "text")
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy("doc_id")))


@query(f"WITH {TFIDF} SELECT * FROM tfidf")
def l04_tfidf_keywords(t: Tables) -> DataFrame:
    return L.tfidf_keywords(t("documents"), "doc_id", "text", 10)


@query(f"""WITH p AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS pos FROM (SELECT doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS k FROM (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z]+') AS ts FROM documents)) WHERE token NOT IN {_STOP}),
e AS (SELECT a.doc_id, a.token AS src, b.token AS dst FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos - a.pos BETWEEN 1 AND 3 AND a.token <> b.token)
SELECT doc_id, src, dst, count(*) AS weight FROM (SELECT * FROM e UNION ALL SELECT doc_id, dst, src FROM e) GROUP BY ALL""")
def l05_cooccurrence(t: Tables) -> DataFrame:
    return L.cooccurrence(t("documents"), "doc_id", "text")


@query()
def l06_textrank(t: Tables) -> DataFrame:
    return L.textrank_keywords(t("documents"), "doc_id", "text", 10)


@query()
def l07_hybrid_keywords(t: Tables) -> DataFrame:
    return L.hybrid_keywords(t("documents"), "doc_id", "text", 10)


def token_set(text: str) -> str:
    """DuckDB: the distinct tokens of a text, bigrams of Han runs included."""
    runs = f"regexp_extract_all(lower({text}), '([0-9a-z]+|[\\x{{4e00}}-\\x{{9fff}}]+)')"
    pieces = f"flatten(list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '^[0-9a-z]') THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))"
    return f"list_distinct(list_filter({pieces}, lambda w: w NOT IN {_STOP}))"


_JACCARD = f"""WITH a AS (SELECT id, {token_set('ideal_answer')} AS x, {token_set('answer')} AS y FROM {{f_predictions}})
SELECT id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS similarity FROM a"""


@query(_JACCARD)
def l08_token_jaccard(t: Tables) -> DataFrame:
    return t("f_predictions").select("id", F.round(X.jaccard(X.tokens(F.col("ideal_answer")), X.tokens(F.col("answer"))), 6).alias("similarity"))


@query(_JACCARD)
def l08_all_predictions(t: Tables) -> DataFrame:
    return l08_token_jaccard(t)


@query(f"WITH {BM25} SELECT token, chunk_id, round(weight, 6) AS weight FROM ix")
def l09_bm25_index(t: Tables) -> DataFrame:
    return chunk_index(t).weights().select("token", "chunk_id", F.round("weight", 6).alias("weight"))


@query(f"WITH {BM25_TOP} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bm25")
def l10_bm25_top(t: Tables) -> DataFrame:
    return chunk_index(t).top(t("f_questions")).withColumn("score", F.round("score", 6))


SUMMARY = rf"""base AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents),
sn AS {sents('base', 'doc_id', 'text')}, tot AS (SELECT doc_id, count(*) AS total FROM sn GROUP BY doc_id),
fr AS (SELECT doc_id, token, count(*) AS n FROM {toks('base', 'doc_id', 'text')} GROUP BY ALL), mx AS (SELECT doc_id, max(n) AS most FROM fr GROUP BY doc_id),
ws AS (SELECT doc_id, i, sum(n) / max(most) / count(*) AS word FROM (SELECT doc_id, i, token FROM (SELECT doc_id, i, unnest(regexp_extract_all(lower(sentence), '[0-9a-z]+')) AS token FROM sn) WHERE token NOT IN {_STOP}) JOIN fr USING (doc_id, token) JOIN mx USING (doc_id) GROUP BY doc_id, i),
sc AS (SELECT doc_id, i, sentence, total, round(word + 0.15 * (1 - i / total) + CASE WHEN length(sentence) > 320 THEN -0.05 ELSE 0.0 END, 9) AS score FROM sn JOIN ws USING (doc_id, i) JOIN tot USING (doc_id) WHERE total > 1),
bst AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) <= greatest(2, least(total, 400 // 90 + 1))),
md AS (SELECT doc_id, regexp_replace(string_agg(CASE WHEN regexp_matches(sentence, '[。！？.!?]$') THEN sentence ELSE sentence || '。' END, '' ORDER BY i), '^\s+|\s+$', '', 'g') AS made FROM bst GROUP BY doc_id),
summ AS (SELECT doc_id, length(text) AS source_length, CASE WHEN length(text) <= 400 THEN text WHEN made IS NULL THEN regexp_replace(left(text, 400), '[，,；;。.!? ]+$', '') || '...'
  WHEN length(made) > 400 THEN regexp_replace(left(made, 400), '[，,；;。.!? ]+$', '') || '...' ELSE made END AS summary FROM base LEFT JOIN md USING (doc_id))"""


SCOPED = f"""tok AS {toks('{f_chunks}', 'chunk_id', 'content')}, tf AS (SELECT chunk_id, document_id, token, count(*) AS n FROM tok JOIN {{f_chunks}} USING (chunk_id) GROUP BY ALL), dl AS (SELECT chunk_id, sum(n) AS dl FROM tf GROUP BY ALL),
al AS (SELECT query_id, count(*) AS docs, sum(coalesce(dl, 0)) / count(*) AS avgdl FROM {{f_scopes}} JOIN {{f_chunks}} USING (document_id) LEFT JOIN dl USING (chunk_id) GROUP BY query_id),
rawidf AS (SELECT query_id, token, ln(any_value(docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM {{f_scopes}} JOIN tf USING (document_id) JOIN al USING (query_id) GROUP BY query_id, token),
idf AS (SELECT query_id, token, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY query_id) ELSE idf END AS idf FROM rawidf),
qt AS (SELECT query_id, token, count(*) AS m FROM {toks('{f_questions}', 'query_id', 'question')} GROUP BY ALL),
sc AS (SELECT query_id, chunk_id, round(sum(m * idf * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * dl / avgdl))), 8) AS score FROM qt JOIN idf USING (query_id, token) JOIN tf USING (token) JOIN {{f_scopes}} USING (query_id, document_id) JOIN dl USING (chunk_id) JOIN al USING (query_id) GROUP BY ALL)"""


@query(f"WITH {SCOPED} SELECT * FROM (SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 10) WHERE score > 0")
def l10_bm25_scoped(t: Tables) -> DataFrame:
    return L.bm25_scoped(t("f_questions"), t("f_chunks"), t("f_scopes")).withColumn("score", F.round("score", 6))


@query(f"WITH {SUMMARY} SELECT doc_id, summary FROM summ")
def l11_summary(t: Tables) -> DataFrame:
    return L.extractive_summary(t("documents"), "doc_id", "text", 400).drop("source_length")


@query(f"WITH {SUMMARY} SELECT doc_id, summary, source_length::INT AS source_length, round(length(summary) / source_length, 4) AS compression_ratio, 'extractive' AS method, '简洁' AS style, false AS fallback FROM summ")
def l12_summary_envelope(t: Tables) -> DataFrame:
    """The ratio of an empty text is not a number, as in the SQL."""
    made = L.extractive_summary(t("documents"), "doc_id", "text", 400)
    ratio = F.when(F.col("source_length") == 0, F.lit(float("nan"))).otherwise(F.round(F.length("summary") / F.col("source_length"), 4))
    return made.select("doc_id", "summary", "source_length", ratio.alias("compression_ratio"), F.lit("extractive").alias("method"), F.lit("简洁").alias("style"), F.lit(False).alias("fallback"))


_HAN = r"\x{4e00}-\x{9fff}"


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def terms(text: str) -> str:
    """DuckDB: the distinct query terms of a text, as a list."""
    runs = rf"list_filter(regexp_extract_all(lower({text}), '[A-Za-z0-9{_HAN}]+'), lambda t: t NOT IN {_TERMS} AND NOT regexp_full_match(t, '[0-9]+'))"
    grams = lambda n: f"list_transform(range(1, length(t) - {n - 2}), lambda i: substr(t, i, {n}))"
    chars = rf"list_filter(string_split(t, ''), lambda c: regexp_full_match(c, '[{_HAN}]') AND c NOT IN {_list(X.STOP_CHARS)})"
    han = f"list_concat(CASE WHEN length(t) <= 3 THEN [t] ELSE list_concat({grams(2)}, {grams(3)}) END, {chars}, CASE WHEN length(t) <= 8 THEN [t] ELSE [] END)"
    return f"list_distinct(list_filter(flatten(list_transform({runs}, lambda t: CASE WHEN regexp_matches(t, '[{_HAN}]') THEN {han} WHEN length(t) > 1 THEN [t] ELSE [] END)), lambda t: t <> '' AND t NOT IN {_TERMS}))"


def has(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_MEN = "(contains({0}, '男') AND contains({0}, '女'))"
_BASE = r"regexp_replace(regexp_replace(trim({0}), '[（(]续\d+[）)]$', ''), '\s+', ' ', 'g')"
GUIDES = rf"""{_SECTIONS.replace("{f_markdown}", "(SELECT file_name AS document_id, line_no, line FROM {f_guides})")},
secs AS (SELECT document_id AS file_name, row_number() OVER w - 1 AS section_index, heading, body, first_value(heading) OVER w AS first_heading, true AS found FROM sections WINDOW w AS (PARTITION BY document_id ORDER BY section_no)
  UNION ALL SELECT file_name, 0, regexp_replace(file_name, '\.md$', ''), regexp_replace(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT regexp_matches(line, '^#{{1,6}}\s+')), '^\s+|\s+$', '', 'g'), regexp_replace(file_name, '\.md$', ''), false
  FROM {{f_guides}} WHERE file_name NOT IN (SELECT document_id FROM sections) GROUP BY file_name),
{BLOCKS.format(keys="file_name, section_index, heading, first_heading, found", source="secs")},
bk AS (SELECT s.*, coalesce(b.block_index, 0) AS block_index, coalesce(b.content, s.body) AS content FROM (SELECT file_name, section_index, heading, first_heading, found, body FROM secs WHERE body <> '') s LEFT JOIN blocks b USING (file_name, section_index)),
asked AS (SELECT r.*, question, split_part(reference, '#', 1) AS file_name, substr(reference, length(split_part(reference, '#', 1)) + 2) AS wanted FROM {{f_references}} r JOIN {{f_samples}} USING (id)),
placed AS (SELECT a.*, wanted <> '' AND EXISTS (FROM secs s WHERE s.found AND s.file_name = a.file_name AND s.heading = a.wanted) AS exact FROM asked a),
cand AS (SELECT id, ref_no, question, file_name, heading, CASE WHEN exact THEN 0 ELSE section_index END AS section_index, block_index, content, NOT exact AND wanted <> '' AS fallback_root, first_heading
  FROM placed JOIN bk USING (file_name) WHERE NOT exact OR heading = wanted),
flg AS (SELECT *, fallback_root AND {has("question", X.EARLY_MARKERS)} AS early, fallback_root AND regexp_matches(first_heading, '{X.CHAPTER_LIKE}') AS chapters, {_BASE.format("heading")} = {_BASE.format("first_heading")} AS base, {_MEN.format("content")} AS pair, {_MEN.format("question")} AS asks FROM cand),
pref AS (SELECT * FROM (SELECT *, bool_or(pair) OVER (PARTITION BY id, ref_no) AS anyone FROM flg WHERE NOT (early OR chapters) OR base) WHERE NOT (early AND asks AND anyone) OR pair),
trm AS (SELECT *, {terms("question")} AS qt, {terms("content")} AS ct, {terms("heading")} AS ht FROM pref),
scored AS (SELECT *, round(coalesce(list_sum(list_transform(list_intersect(qt, ct), lambda x: length(x))), 0) + 1.5 * coalesce(list_sum(list_transform(list_intersect(qt, ht), lambda x: length(x))), 0) - greatest(0, length(content) - 360) * 0.01
  - CASE WHEN {LOW.format("content")} THEN 5 ELSE 0 END + CASE WHEN early THEN greatest(0, 8 - section_index * 3) ELSE 0 END + CASE WHEN asks AND pair THEN 8 WHEN asks AND {has("content", ["男", "女"])} THEN 2 ELSE 0 END
  + CASE WHEN {has("question", X.QUANTITY_MARKERS)} AND regexp_matches(content, '[0-9一二三四五六七八九十两百千]+') THEN 2 ELSE 0 END, 9)::DOUBLE AS score FROM trm),
rnk AS (SELECT *, max(score) OVER g AS best, row_number() OVER (g ORDER BY score DESC, section_index, block_index) AS place, row_number() OVER (g ORDER BY section_index, block_index) AS first FROM scored WINDOW g AS (PARTITION BY id, ref_no)),
chosen AS (SELECT * FROM rnk WHERE CASE WHEN trim(question) = '' THEN first <= 2 WHEN best <= 0 THEN first = 1 ELSE place = 1 OR (score >= greatest(1.5, best * 0.55) AND place <= CASE WHEN early THEN 1 ELSE 2 END) END),
ev AS (SELECT s.id, coalesce(string_agg(CASE WHEN file_name IS NOT NULL THEN concat('[source] ', file_name, '#' || heading, chr(10), content) END, chr(10) || chr(10) ORDER BY ref_no, section_index, block_index), '') AS evidence FROM {{f_samples}} s LEFT JOIN chosen c ON c.id = s.id GROUP BY s.id)"""


def candidates(t: Tables) -> DataFrame:
    return V.preferred(V.candidate_evidence(t("f_samples"), t("f_references"), V.sectioned(t("f_guides"))))


@query(f"WITH {GUIDES} SELECT id, ref_no, section_index, block_index, heading, early, score FROM scored")
def l13_evidence_score(t: Tables) -> DataFrame:
    return candidates(t).select("id", "ref_no", "section_index", "block_index", "heading", "early", "score")


@query(f"WITH {GUIDES} SELECT id, ref_no, section_index, block_index, fallback_root, score FROM chosen")
def l14_evidence_selection(t: Tables) -> DataFrame:
    return V.select_evidence(candidates(t)).select("id", "ref_no", "section_index", "block_index", "fallback_root", "score")


@query(f"WITH {GUIDES} SELECT id, evidence FROM ev")
def l15_evidence_text(t: Tables) -> DataFrame:
    return V.evidence_text(t("f_samples"), V.select_evidence(candidates(t)))


@query("SELECT id, ref_no, reference FROM {f_references} WHERE split_part(reference, '#', 1) NOT IN (SELECT file_name FROM {f_guides})")
def l15_unknown_references(t: Tables) -> DataFrame:
    return V.unknown_references(t("f_references"), t("f_guides"))

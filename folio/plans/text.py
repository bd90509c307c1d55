"""Queries of scalar text functions, predicates and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.plans.registry import Tables, query

MIME = {
    "application/pdf": ".pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx", "application/msword": ".doc", "text/plain": ".txt", "text/markdown": ".md",
    "text/x-markdown": ".md", "text/csv": ".csv", "text/tab-separated-values": ".tsv", "application/json": ".json", "application/x-ndjson": ".jsonl", "text/html": ".html", "application/xhtml+xml": ".html",
    "application/xml": ".xml", "text/xml": ".xml", "image/png": ".png", "image/jpeg": ".jpg", "image/bmp": ".bmp", "image/webp": ".webp",
}
ALLOWED = ".pdf .docx .doc .txt .md .csv .tsv .json .jsonl .html .htm .xml .png .jpg .jpeg .bmp .webp".split()


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'),
  '\x{00A0}', ' ', 'g'), '[\x{FEFF}\x{200B}-\x{200F}\x{2060}]', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10)||chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents""")
def t01_normalize(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", X.normalize_document(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\x{3000}', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents""")
def t02_clean_record(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", X.clean_record(F.col("text")).alias("text"))


@query(r"""SELECT doc_id,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10)||chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10)||chr(10), 'g'), '^\s+|\s+$', '', 'g') AS block FROM documents""")
def t03_plain_body(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", X.plain_body(F.col("text")).alias("body"), X.block_text(F.col("text")).alias("block"))


@query(r"""SELECT document_id, line_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'),
  '[*_`>#]+', ' ', 'g'), '[|—]', ' ', 'g'), '\s+', ' ', 'g'), '^[- \t\r\n]+|[- \t\r\n]+$', '', 'g') AS line FROM {f_markdown}""")
def t04_strip_markdown(t: Tables) -> DataFrame:
    return t("f_markdown").select("document_id", "line_no", X.strip_inline_markdown(F.col("line")).alias("line"))


@query(r"""SELECT doc_id, query, CASE WHEN query <> '' THEN left(query, 2000) END AS embedding_text
FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS query FROM documents)""")
def t05_query_text(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", X.normalize_query(F.col("text")).alias("query"), X.embedding_text(F.col("text")).alias("embedding_text"))


@query(r"""WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^\p{L}\p{Nd}]', '', 'g')) AS m, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS k FROM documents)
SELECT doc_id, round(CASE WHEN m = 0 THEN 0.0 ELSE k / m END, 6) AS ratio FROM c WHERE CASE WHEN m = 0 THEN 0.0 ELSE k / m END >= 0.9""")
def t06_script_filter(t: Tables) -> DataFrame:
    ratio = X.script_ratio(F.col("text"), "A-Za-z")
    return t("documents").select("doc_id", ratio.alias("ratio")).where("ratio >= 0.9").select("doc_id", F.round("ratio", 6).alias("ratio"))


@query(r"""SELECT doc_id FROM documents WHERE NOT list_bool_or(list_transform(['stor', 'poem', 'roleplay', 'story', 'novel', '翻译', '小说'],
  lambda w: contains(lower(regexp_replace(text, '\s+', ' ', 'g')), w)))""")
def t07_blocklist(t: Tables) -> DataFrame:
    words = ["stor", "poem", "roleplay", "story", "novel", "翻译", "小说"]
    return t("documents").where(~X.any_in(F.lower(X.clean_record(F.col("text"))), words)).select("doc_id")


@query(r"""SELECT doc_id, pos, line = '' OR regexp_full_match(line, '[^\p{L}]+') OR (regexp_matches(line, '[.。·]{4,}') AND k < 10) OR k < 6 AS low
FROM (SELECT *, length(regexp_replace(line, '[^A-Za-z0-9\x{4e00}-\x{9fff}]', '', 'g')) AS k FROM (SELECT doc_id, pos, regexp_replace(line, '[ \t]+', ' ', 'g') AS line FROM {f_lines}))""")
def t08_low_information(t: Tables) -> DataFrame:
    return t("f_lines").select("doc_id", "pos", X.is_low_information(F.col("line")).alias("low"))


@query(r"""SELECT doc_id, pos, CASE WHEN line = '' THEN 'blank' WHEN regexp_full_match(line, '\d{1,4}|第?\s*\d+\s*页') THEN 'dropped'
  WHEN starts_with(line, '#') OR regexp_matches(line, '^(第[一二三四五六七八九十百零\d]+[章节部分篇]|[一二三四五六七八九十]+[、.）)]|\d+(\.\d+){0,3}[、.）)])')
    OR (length(line) <= 28 AND NOT regexp_matches(line, '[。！？!?；;，,]$')) THEN 'heading'
  WHEN regexp_matches(line, '^([-*•●▪▶]|(\d+|[A-Za-z])[.)、])') THEN 'item' ELSE 'text' END AS kind FROM {f_lines}""")
def t09_line_kind(t: Tables) -> DataFrame:
    line = F.col("line")
    kind = F.when(line == "", "blank").when(X.is_dropped_line(line), "dropped").when(X.is_heading_line(line), "heading").when(X.is_list_item(line), "item").otherwise("text")
    return t("f_lines").select("doc_id", "pos", kind.alias("kind"))


@query(r"""SELECT doc_id, pos, line <> '' AND length(line) <= 80 AND (regexp_full_match(line, '第\s*[0-9零一二三四五六七八九十百千两]+\s*[章节卷篇回部集]\s*.*') OR regexp_full_match(line, '(?i)(chapter|part)\s+\d+\b.*')
  OR regexp_full_match(line, '\d+(?:\.\d+){0,2}[、.．]\s*\S.*')) AS heading, regexp_matches(line, '^第\s*[0-9零一二三四五六七八九十百千两]+\s*[章节卷篇回部集]') AS chapter_like,
  regexp_replace(regexp_replace(line, '[（(]续\d+[）)]$', ''), '\s+', ' ', 'g') AS base FROM {f_lines}""")
def t10_chapter_heading(t: Tables) -> DataFrame:
    line = F.col("line")
    return t("f_lines").select("doc_id", "pos", X.is_chapter_heading(line).alias("heading"), line.rlike(X.CHAPTER_LIKE).alias("chapter_like"), X.heading_base(line).alias("base"))


@query(r"""SELECT document_id, regexp_replace(array_to_string(list_filter(string_split(string_agg(line, chr(10) ORDER BY line_no), chr(10)), lambda x: NOT regexp_matches(x, '^#{1,6}\s+')), chr(10)), '^\s+|\s+$', '', 'g') AS text
FROM {f_markdown} GROUP BY document_id""")
def t11_strip_headings(t: Tables) -> DataFrame:
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return t("f_markdown").groupBy("document_id").agg(whole.alias("text")).select("document_id", X.without_headings(F.col("text")).alias("text"))


@query("SELECT id, regexp_matches(answer, '未找到足够依据|没有足够依据|暂无足够证据|无法从提供的文档中找到|无法根据当前文档确定') AS refused FROM {f_predictions}")
def t12_refusal(t: Tables) -> DataFrame:
    return t("f_predictions").select("id", X.any_in(F.col("answer"), X.REFUSALS).alias("refused"))


def char_overlap(pairs: DataFrame, key: str, reference: str, prediction: str) -> DataFrame:
    """(key, overlap): F1 of the characters other than white space as multisets; 1 if both are empty, 0 if one is.

    The characters of a pair are counted on their own row, so nothing is shuffled.
    """
    def sorted_chars(c: str):
        return F.array_sort(F.filter(F.split(X.sub(F.col(c), r"(?U)\s+", ""), ""), lambda x: x != ""))

    counted = pairs.select(key, sorted_chars(reference).alias("a"), sorted_chars(prediction).alias("b"))
    both = F.aggregate(F.array_intersect("a", "b"), F.lit(0), lambda n, c: n + F.least(F.size(F.filter("a", lambda x: x == c)), F.size(F.filter("b", lambda x: x == c))))
    na, nb = F.size("a"), F.size("b")
    score = F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0) | (F.col("m") == 0), 0.0).otherwise(2 * F.col("m") / (na + nb))
    return counted.withColumn("m", both).select(key, F.round(score, 4).alias("overlap"))


@query(r"""WITH c AS (SELECT id, 'a' AS side, unnest(string_split(regexp_replace(ideal_answer, '\s+', '', 'g'), '')) AS ch FROM {f_predictions}
  UNION ALL SELECT id, 'b', unnest(string_split(regexp_replace(answer, '\s+', '', 'g'), '')) FROM {f_predictions}),
n AS (SELECT id, ch, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM c WHERE ch <> '' GROUP BY id, ch)
SELECT id, round(2.0 * sum(least(na, nb)) / (sum(na) + sum(nb)), 4) AS overlap FROM n GROUP BY id""")
def t13_char_overlap(t: Tables) -> DataFrame:
    return char_overlap(t("f_predictions"), "id", "ideal_answer", "answer")


@query(r"""SELECT doc_id, regexp_matches(text, 'First|At first|开头|一开始|最初|起初|前文|最早') AS early, (contains(text, '男') AND contains(text, '女')) AS gender, regexp_matches(text, '几|多少|数量|共有|一共|number|many') AS quantity FROM documents""")
def t14_intent(t: Tables) -> DataFrame:
    text = F.col("text")
    gender = (F.contains(text, F.lit("男")) & F.contains(text, F.lit("女"))) | F.contains(text, F.lit("男女"))
    return t("documents").select("doc_id", X.any_in(text, [*X.EARLY_MARKERS, "First", "At first"]).alias("early"), gender.alias("gender"), X.any_in(text, [*X.QUANTITY_MARKERS, "number", "many"]).alias("quantity"))


@query(f"""WITH u AS (SELECT *, CASE WHEN contains(file_name, '.') THEN lower(regexp_extract(file_name, '\\.[^.]*$')) ELSE '' END AS ext FROM {{f_uploads}}),
m AS (SELECT unnest({list(MIME)}) AS content_type, unnest({list(MIME.values())}) AS mime_ext),
r AS (SELECT id, file_size, CASE WHEN list_contains({ALLOWED}, ext) THEN ext WHEN mime_ext IS NOT NULL THEN mime_ext WHEN ext = '' AND starts_with(u.content_type, 'text/') THEN '.txt' END AS kind FROM u LEFT JOIN m USING (content_type))
SELECT id, kind, CASE WHEN kind IS NULL THEN 'unsupported_type' WHEN file_size > 10485760 THEN 'too_large' ELSE 'accepted' END AS outcome FROM r""")
def t15_intake(t: Tables) -> DataFrame:
    name = F.col("file_name")
    own = F.when(F.contains(name, F.lit(".")), F.lower(F.regexp_extract(name, r"\.[^.]*$", 0))).otherwise("")
    by_mime = F.element_at(F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv)), F.col("content_type"))
    kind = F.when(own.isin(ALLOWED), own).when(by_mime.isNotNull(), by_mime).when((own == "") & F.startswith("content_type", F.lit("text/")), ".txt")
    outcome = F.when(F.col("kind").isNull(), "unsupported_type").when(F.col("file_size") > 10 << 20, "too_large").otherwise("accepted")
    return t("f_uploads").withColumn("kind", kind).select("id", "kind", outcome.alias("outcome"))


@query(r"""WITH r AS (SELECT document_id, chunk_index, content, sum(length(content)) OVER (PARTITION BY document_id ORDER BY chunk_index) - length(content) AS before FROM {f_chunks})
SELECT document_id, string_agg(left(content, CAST(1600 - before AS BIGINT)), chr(10)||chr(10) ORDER BY chunk_index) AS preview FROM r WHERE before < 1600 GROUP BY document_id""")
def t16_preview(t: Tables) -> DataFrame:
    before = F.sum(F.length("content")).over(Window.partitionBy("document_id").orderBy("chunk_index")) - F.length("content")
    rows = t("f_chunks").withColumn("before", before).where("before < 1600").withColumn("content", F.expr("left(content, CAST(1600 - before AS INT))"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"])
    return rows.groupBy("document_id").agg(F.array_join(parts, "\n\n").alias("preview"))


@query(r"""WITH r AS (SELECT conversation_id, turn, concat('<thinking>1. look: ', left(content, 20), chr(10), '2. check: ', right(content, 10), '</thinking><answer>', content, '</answer>') AS raw FROM {f_messages} WHERE role = 'assistant')
SELECT conversation_id, turn, regexp_replace(regexp_extract(raw, '(?s)<answer>(.*?)</answer>', 1), '^\s+|\s+$', '', 'g') AS answer,
  array_to_string(regexp_extract_all(regexp_extract(raw, '(?s)<thinking>(.*?)</thinking>', 1), '(\d+)\.\s*([^:\n]+):\s*([^\n]+)', 2), '|') AS titles, len(regexp_extract_all(regexp_extract(raw, '(?s)<thinking>(.*?)</thinking>', 1), '(\d+)\.\s*([^:\n]+):\s*([^\n]+)', 3))::INT AS steps FROM r""")
def t17_reasoning(t: Tables) -> DataFrame:
    raw = F.expr("concat('<thinking>1. look: ', left(content, 20), '\\n', '2. check: ', right(content, 10), '</thinking><answer>', content, '</answer>')")
    rows = t("f_messages").where("role = 'assistant'").select("conversation_id", "turn", raw.alias("raw"))
    thought, answer = F.regexp_extract("raw", r"(?s)<thinking>(.*?)</thinking>", 1), F.regexp_extract("raw", r"(?s)<answer>(.*?)</answer>", 1)
    step = F.lit(r"(\d+)\.\s*([^:\n]+):\s*([^\n]+)")
    steps = F.arrays_zip(*(F.regexp_extract_all(thought, step, F.lit(k)).alias(n) for k, n in enumerate(("no", "title", "content"), 1)))
    whole = F.when(F.col("raw").rlike(r"(?s)<answer>.*?</answer>"), answer).otherwise(F.col("raw"))
    made = rows.select("conversation_id", "turn", X.strip(whole).alias("answer"), steps.alias("steps"))
    return made.select("conversation_id", "turn", "answer", F.array_join("steps.title", "|").alias("titles"), F.size("steps").alias("steps"))


@query(r"""SELECT id, CASE WHEN s = '' THEN 'document' ELSE s END AS slug FROM (SELECT id, regexp_replace(regexp_replace(file_name, '[^0-9A-Za-z\x{4e00}-\x{9fff}_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM {f_docs_catalog})""")
def t18_slug(t: Tables) -> DataFrame:
    return t("f_docs_catalog").select("id", X.slug(F.col("file_name")).alias("slug"))


@query("SELECT chunk_id FROM {f_chunks} WHERE contains(lower(concat_ws(' ', content, page, chunk_index, type)), 'tion th')")
def t19_chunk_search(t: Tables) -> DataFrame:
    return t("f_chunks").where(F.contains(F.lower(F.concat_ws(" ", "content", "page", "chunk_index", "type")), F.lit("tion th"))).select("chunk_id")

"""Queries of segmentation and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators import chunking as C
from folio.plans.registry import Tables, query

_HEAD = r"(starts_with(line, '#') OR regexp_matches(line, '^(第[一二三四五六七八九十百零\d]+[章节部分篇]|[一二三四五六七八九十]+[、.）)]|\d+(\.\d+){0,3}[、.）)])') OR (length(line) <= 28 AND NOT regexp_matches(line, '[。！？!?；;，,]$')))"
_SOLO = rf"(line <> '' AND ({_HEAD} OR regexp_matches(line, '^([-*•●▪▶]|(\d+|[A-Za-z])[.)、])')))"
_CHAPTER = r"(line <> '' AND length(line) <= 80 AND (regexp_full_match(line, '第\s*[0-9零一二三四五六七八九十百千两]+\s*[章节卷篇回部集]\s*.*') OR regexp_full_match(line, '(?i)(chapter|part)\s+\d+\b.*') OR regexp_full_match(line, '\d+(?:\.\d+){0,2}[、.．]\s*\S.*')))"
_PARAS = f"""m AS (SELECT *, {_CHAPTER} AS heading FROM {{f_lines}}),
i AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (SELECT *, heading OR coalesce(lag(heading OR line = '') OVER (PARTITION BY doc_id ORDER BY pos), true) AS st FROM m)),
paras AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1)::INT AS para_no, paragraph, heading FROM
  (SELECT doc_id, island, string_agg(line, chr(10) ORDER BY pos) AS paragraph, bool_or(heading) AS heading FROM i WHERE line <> '' GROUP BY doc_id, island))"""
_SECTIONS = r"""h AS (SELECT *, regexp_matches(line, '^#{1,6}\s+') AS head FROM {f_markdown}),
n AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY line_no) AS no FROM h),
b AS (SELECT document_id, no, max(CASE WHEN head THEN trim(regexp_replace(line, '^#{1,6}\s+', '')) END) AS heading, regexp_replace(coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY line_no), ''), '^\s+|\s+$', '', 'g') AS body FROM n WHERE no > 0 GROUP BY document_id, no),
sections AS (SELECT document_id, min(no)::BIGINT AS section_no, heading, arg_max(body, no) AS body FROM b WHERE body <> '' GROUP BY document_id, heading)"""


@query(rf"""WITH k AS (SELECT doc_id, pos, line, {_SOLO} AS solo FROM {{f_lines}} WHERE NOT regexp_full_match(line, '\d{{1,4}}|第?\s*\d+\s*页')),
i AS (SELECT *, sum(CASE WHEN solo OR prev THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (SELECT *, coalesce(lag(solo OR line = '') OVER (PARTITION BY doc_id ORDER BY pos), true) AS prev FROM k))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1)::INT AS block_no, block FROM
(SELECT doc_id, island, string_agg(CASE WHEN first OR glued THEN line ELSE chr(10) || line END, '' ORDER BY pos) AS block FROM
  (SELECT *, lag(line) OVER w IS NULL AS first, coalesce(regexp_matches(lag(line) OVER w, '[-—/（(\[【：:]$') OR regexp_matches(line, '^[）)\]】、，,。.；;：:]'), false) AS glued FROM i WHERE line <> '' WINDOW w AS (PARTITION BY doc_id, island ORDER BY pos)) GROUP BY doc_id, island)""")
def c01_line_blocks(t: Tables) -> DataFrame:
    return C.line_blocks(t("f_lines"))


@query()
def c02_pack_overlap(t: Tables) -> DataFrame:
    return C.parent_child_chunks(t("documents"), size=1500, overlap=180, parent_size=1 << 30, parent_overlap=0).select("doc_id", "chunk_index", "content")


@query()
def c03_long_blocks(t: Tables) -> DataFrame:
    return C.parent_child_chunks(t("documents"), size=200, overlap=40, parent_size=1 << 30, parent_overlap=0).select("doc_id", "chunk_index", "content")


@query()
def c04_parent_child(t: Tables) -> DataFrame:
    return C.parent_child_chunks(t("documents"))


_REPEATED = rf"""WITH p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM {{f_lines}} GROUP BY doc_id HAVING count(DISTINCT page) >= 3),
s AS (SELECT doc_id, line, count(DISTINCT page) AS n FROM {{f_lines}} WHERE line <> '' AND length(line) <= 40 AND NOT {_HEAD} AND NOT regexp_matches(line, '[。！？!?]') GROUP BY doc_id, line),
r AS (SELECT s.doc_id, s.line FROM s JOIN p USING (doc_id) WHERE n >= greatest(3, pages // 3))
SELECT doc_id, pos, line FROM {{f_lines}} l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = l.doc_id AND r.line = l.line)"""


@query(_REPEATED)
def c05_repeated_lines(t: Tables) -> DataFrame:
    lines = t("f_lines")
    return lines.join(C.repeated_short_lines(lines), ["doc_id", "line"], "left_anti").select("doc_id", "pos", "line")


@query(_REPEATED.replace("f_lines", "f_book_lines"))
def c05_running_heads(t: Tables) -> DataFrame:
    """Lines of texts whose pages share a running head."""
    lines = t("f_book_lines")
    return lines.join(C.repeated_short_lines(lines), ["doc_id", "line"], "left_anti").select("doc_id", "pos", "line")


@query(r"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS pos, s AS sentence FROM
(SELECT doc_id, k, regexp_replace(p, '^\s+|\s+$', '', 'g') AS s FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (SELECT doc_id, string_split(regexp_replace(text, '([。！？!?；;.\n])', '\1' || chr(1), 'g'), chr(1)) AS ps FROM documents))) WHERE s <> ''""")
def c06_sentences(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.posexplode(X.sentences(F.col("text"), "。！？!?；;.\n")).alias("pos", "sentence"))


@query(f"WITH {_PARAS} SELECT * FROM paras")
def c07_paragraphs(t: Tables) -> DataFrame:
    return C.paragraphs(t("f_lines"))


@query(f"""WITH {_PARAS.replace("f_lines", "f_book_lines")}, n AS (SELECT *, greatest(sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY para_no), 1) AS section_no, bool_or(heading) OVER (PARTITION BY doc_id) AS has FROM paras)
SELECT * FROM (SELECT doc_id, section_no::BIGINT AS section_no, max(CASE WHEN heading THEN paragraph END) AS heading, coalesce(string_agg(CASE WHEN NOT heading THEN paragraph END, chr(10)||chr(10) ORDER BY para_no), '') AS body FROM n WHERE has GROUP BY doc_id, section_no) WHERE body <> ''""")
def c08_heading_sections(t: Tables) -> DataFrame:
    return C.heading_sections(C.paragraphs(t("f_book_lines")))


@query(f"""WITH {_PARAS}, w AS (SELECT doc_id, list(paragraph ORDER BY para_no) AS ps, sum(length(paragraph)) AS n FROM paras GROUP BY doc_id HAVING NOT bool_or(heading)),
g AS (SELECT doc_id, n, CASE WHEN n < 900 THEN [array_to_string(ps, chr(10)||chr(10))] ELSE list_transform([list_reduce(list_transform(ps, lambda x: {{'done': []::VARCHAR[], 'open': x, 'n': length(x)}}), lambda a, b: CASE WHEN a.n + b.n > 1200 THEN {{'done': list_append(a.done, a.open), 'open': b.open, 'n': b.n}} ELSE {{'done': a.done, 'open': a.open || chr(10) || chr(10) || b.open, 'n': a.n + b.n}} END)], lambda r: list_append(r.done, r.open))[1] END AS gs FROM w)
SELECT doc_id, k::INT AS section_no, CASE WHEN n < 900 THEN 'Content' ELSE concat('Section ', k) END AS title, body FROM (SELECT doc_id, n, unnest(gs) AS body, generate_subscripts(gs, 1) AS k FROM g)""")
def c09_length_sections(t: Tables) -> DataFrame:
    return C.length_sections(C.paragraphs(t("f_lines")))


@query(f"""WITH {_SECTIONS} SELECT document_id, concat('# ', document_id, chr(10), chr(10), string_agg(concat('## ', heading, chr(10), body), chr(10)||chr(10) ORDER BY section_no)) AS markdown FROM sections GROUP BY document_id""")
def c10_render_sections(t: Tables) -> DataFrame:
    made = C.markdown_sections(t("f_markdown")).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("section_no", F.concat(F.lit("## "), "heading", F.lit("\n"), "body").alias("s")))).alias("rows"))
    return made.select("document_id", F.concat(F.lit("# "), "document_id", F.lit("\n\n"), F.array_join(F.transform("rows", lambda r: r["s"]), "\n\n")).alias("markdown"))


@query(f"WITH {_SECTIONS} SELECT * FROM sections")
def c11_markdown_sections(t: Tables) -> DataFrame:
    return C.markdown_sections(t("f_markdown"))


LOW = r"({0} = '' OR regexp_full_match({0}, '[^\p{{L}}]+') OR (regexp_matches({0}, '[.。·]{{{{4,}}}}') AND length(regexp_replace({0}, '[^A-Za-z0-9\x{{4e00}}-\x{{9fff}}]', '', 'g')) < 10) OR length(regexp_replace({0}, '[^A-Za-z0-9\x{{4e00}}-\x{{9fff}}]', '', 'g')) < 6)"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _greedy(items: str, glue: str) -> str:
    """DuckDB: greedy concatenations of at most 360 characters."""
    more = f"a.open || {glue} || b.open"
    fold = f"list_reduce(list_transform({items}, lambda x: {{{{'done': []::VARCHAR[], 'open': x}}}}), lambda a, b: CASE WHEN length({more}) > 360 THEN {{{{'done': list_append(a.done, {_TRIM.format('a.open')}), 'open': b.open}}}} ELSE {{{{'done': a.done, 'open': {more}}}}} END)"
    return f"CASE WHEN len({items}) = 0 THEN []::VARCHAR[] ELSE list_transform([{fold}], lambda r: list_append(r.done, {_TRIM.format('r.open')}))[1] END"


_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(replace(b, chr(13), chr(10)), '([。！？!?；;])', '\1' || chr(1), 'g'), chr(1)), lambda p: {_TRIM.format('p')}), lambda p: p <> '')"
_CLEAN_BODY = r"regexp_replace(regexp_replace(replace(regexp_replace(body, '\r\n?', chr(10), 'g'), chr(65279), ''), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
#: (keys, block_index, content) of sections with a body; of ``source`` with ``keys``.
BLOCKS = rf"""raw AS (SELECT {{keys}}, list_filter(list_transform(string_split(regexp_replace({_TRIM.format(_CLEAN_BODY)}, '\n\s*\n+', chr(1), 'g'), chr(1)), lambda b: {_TRIM.format('b')}), lambda b: NOT {LOW.replace('{0}', 'b')}) AS rs FROM {{source}}),
pcs AS (SELECT {{keys}}, list_filter(flatten(list_transform(rs, lambda b: CASE WHEN length(b) <= 360 THEN [b] ELSE {_greedy(_SENTENCES, "''")} END)), lambda b: NOT {LOW.replace('{0}', 'b')}) AS ps FROM raw),
allb AS (SELECT {{keys}}, list_concat(ps, {_greedy('ps', "chr(10) || chr(10)")}) AS bs FROM pcs),
uniq AS (SELECT {{keys}}, list_filter(bs, lambda b, i: list_position(bs, b) = i AND NOT {LOW.replace('{0}', 'b')}) AS bs FROM allb),
blocks AS (SELECT {{keys}}, unnest(bs) AS content, generate_subscripts(bs, 1)::INT - 1 AS block_index FROM uniq)"""


@query(f"WITH {_SECTIONS}, {BLOCKS.format(keys='document_id, section_no', source='sections')} SELECT document_id, section_no, block_index, content FROM blocks")
def c12_candidate_blocks(t: Tables) -> DataFrame:
    return C.markdown_sections(t("f_markdown")).select("document_id", "section_no", F.posexplode(C.candidate_blocks(F.col("body"))).alias("block_index", "content"))


_INLINE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[*_`>#]+', ' ', 'g'), '[|—]', ' ', 'g'), '\s+', ' ', 'g'), '^[- \t\r\n]+|[- \t\r\n]+$', '', 'g')"""


_POINTS = rf"""WITH l AS (SELECT document_id, chunk_index, content, list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^(```|~~~)')) AS ls FROM {{f_chunks}}),
b AS (SELECT *, list_filter(list_transform(list_filter(ls, lambda x: regexp_matches(x, '^[-*+]\s+|^\d+[.)、]\s*')), lambda x: {_INLINE.format(r"regexp_replace(x, '^([-*+]|\d+[.)、])\s*', '')")}), lambda x: x <> '') AS bs,
  list_filter(list_transform(string_split(regexp_replace(content, '[。！？；;\n]', chr(1), 'g'), chr(1)), lambda p: {_INLINE.format('p')}), lambda p: length(p) >= 4) AS ps FROM l),
c AS (SELECT *, list_filter(list_transform(CASE WHEN len(bs) > 0 THEN bs ELSE ps END, lambda p: CASE WHEN length(p) > 80 THEN regexp_replace(left(p, 80), '[，,;；:： ]+$', '') ELSE p END), lambda p: p <> '') AS cs FROM b)
SELECT document_id, chunk_index, coalesce(array_to_string((list_filter(cs, lambda p, i: list_position(cs, p) = i))[:4], '|'), '') AS points FROM c"""


@query(_POINTS)
def c13_answer_points(t: Tables) -> DataFrame:
    return t("f_chunks").select("document_id", "chunk_index", F.array_join(X.answer_points(F.col("content")), "|").alias("points"))


@query(_POINTS)
def c13_all_chunks(t: Tables) -> DataFrame:
    return c13_answer_points(t)


@query("SELECT document_id, count(*) AS chunk_count, count(DISTINCT parent_chunk_index) AS parent_chunk_count, count(DISTINCT page) AS page_count, bool_or(type = 'table') AS has_tables, bool_or(type = 'ocr') AS ocr_used FROM {f_chunks} GROUP BY document_id")
def c14_processing_rollup(t: Tables) -> DataFrame:
    return t("f_chunks").groupBy("document_id").agg(
        F.count("*").alias("chunk_count"), F.count_distinct("parent_chunk_index").alias("parent_chunk_count"), F.count_distinct("page").alias("page_count"),
        F.bool_or(F.col("type") == "table").alias("has_tables"), F.bool_or(F.col("type") == "ocr").alias("ocr_used"),
    )


@query()
def c15_overlap_merge(t: Tables) -> DataFrame:
    chunks = C.parent_child_chunks(t("documents"))
    rows = chunks.groupBy("doc_id", "parent_chunk_index").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("rows"))
    return rows.select("doc_id", "parent_chunk_index", C.merge_overlapping(F.transform("rows", lambda r: r["content"])).alias("content"))

"""Queries of sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.monitoring import parse_logs
from folio.plans.registry import Tables, query
from folio.sources import corpus as S
from folio.sources.buckets import Buckets
from folio.sources.store import shared_dir


def fresh(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT 'documents' AS source, 'lang=' || coalesce(nullif(lang, ''), 'none') AS folder, '.txt' AS extension, sum(coalesce(strlen(text), 0) + 1)::BIGINT AS bytes FROM documents GROUP BY ALL
UNION ALL SELECT 'turns', 'role=' || coalesce(nullif(role, ''), 'none'), '.txt', sum(coalesce(strlen(text), 0) + 1)::BIGINT FROM conversations GROUP BY ALL""")
def s01_scan_files(t: Tables) -> DataFrame:
    """A corpus of text files in folders by language and role, beside Parquet files that are no documents; sizes by folder."""
    path, named = fresh(t, "corpus"), lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("none")).alias(c)
    t("documents").select("text", named("lang")).write.partitionBy("lang").text(f"{path}/documents")
    t("conversations").select("text", named("role")).write.partitionBy("role").text(f"{path}/turns")
    t("labels").write.parquet(f"{path}/labels")
    parts = [F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", k).alias(c) for k, c in ((1, "source"), (2, "folder"))]
    return S.scan_files(t.spark, path).select(*parts, "extension", "length").groupBy("source", "folder", "extension").agg(F.sum("length").alias("bytes"))


@query()
def s02_decode(t: Tables) -> DataFrame:
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    return S.decode(t("documents").select("doc_id", raw.alias("content")), "content").select("doc_id", "text")


@query("SELECT n_nationkey AS row_no, concat_ws(' | ', 'n_nationkey: ' || n_nationkey, 'n_name: ' || nullif(n_name, ''), 'n_regionkey: ' || n_regionkey) AS text FROM nation UNION ALL SELECT p_partkey + 1000, concat_ws(' | ', 'p_name: ' || nullif(p_name, ''), 'p_brand: ' || nullif(p_brand, '')) FROM part UNION ALL SELECT -1, '[表头] n_nationkey | n_name | n_regionkey' UNION ALL SELECT 999, '[表头] p_name | p_brand'")
def s03_delimited(t: Tables) -> DataFrame:
    """Two delimited files, each with its header line before its rows."""
    nation, part = t("nation").select("n_nationkey", "n_name", "n_regionkey"), t("part").select("p_name", "p_brand")
    rows = nation.select(F.col("n_nationkey").cast("long").alias("row_no"), S.delimited_rows(nation).alias("text")).union(t("part").select(F.col("p_partkey") + 1000, S.delimited_rows(part)))
    return rows.union(t.spark.createDataFrame([(-1, S.delimited_header(nation)), (999, S.delimited_header(part))], "row_no long, text string"))


@query("SELECT conv_id, turn, role, length(text)::INT AS chars FROM conversations")
def s04_json_lines(t: Tables) -> DataFrame:
    path = fresh(t, "jsonl")
    t("conversations").select(F.concat(F.lit("  "), F.to_json(F.struct("conv_id", "turn", "role", "text"))).alias("value")).union(t("conversations").select(F.lit(""))).write.text(path)
    lines = t.spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")
    rows = lines.select(F.from_json("value", "conv_id long, turn int, role string, text string").alias("r")).select("r.*")
    return rows.select("conv_id", F.col("turn").cast(dict(t("conversations").dtypes)["turn"]).alias("turn"), "role", F.length("text").alias("chars"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 7 <> 3 THEN concat('{', chr(10), '  "doc_id": ', doc_id, ',', chr(10), '  "meta": {', chr(10), '    "lang": ', to_json(coalesce(lang, '')), ',', chr(10), '    "tags": [', chr(10), '      ', to_json(coalesce(source, '')), ',', chr(10), '      "中文"', chr(10), '    ]', chr(10), '  }', chr(10), '}') END AS text, doc_id % 7 = 3 AS failed FROM documents""")
def s04_json_documents(t: Tables) -> DataFrame:
    """JSON documents, every seventh of which is cut off."""
    meta = F.struct(F.coalesce("lang", F.lit("")).alias("lang"), F.array(F.coalesce("source", F.lit("")), F.lit("中文")).alias("tags")).alias("meta")
    made = F.to_json(F.struct("doc_id", meta))
    rows = t("documents").select("doc_id", F.when(F.col("doc_id") % 7 == 3, F.left(made, F.lit(9))).otherwise(made).alias("json"))
    return S.pretty_json(rows, "json").select("doc_id", "text", F.col("error").isNotNull().alias("failed"))


@query()
def s05_html_text(t: Tables) -> DataFrame:
    return S.extract_markup(t("pages"), "page_id", "html", "html").select("page_id", "fragment_no", "text")


@query()
def s06_xml_text(t: Tables) -> DataFrame:
    xml = F.concat(F.lit("<doc><id>"), "doc_id", F.lit("</id><body>"), F.when(F.col("doc_id") % 5 == 0, F.lit("<broken")).otherwise(F.regexp_replace("text", "[<&>]", " ")), F.lit("</body></doc>"))
    return S.extract_markup(t("documents").select("doc_id", xml.alias("xml")), "doc_id", "xml", "xml").select("doc_id", "fragment_no", "text")


@query("SELECT doc_id, CASE WHEN starts_with(ltrim(text), '#') THEN text ELSE concat('# ', doc_id, chr(10), chr(10), text) END AS markdown FROM documents")
def s07_markdown_corpus(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", S.with_title(F.col("text"), F.col("doc_id").cast("string")).alias("markdown"))


@query("SELECT doc_id, text, lang FROM documents")
def s08_jsonl_round_trip(t: Tables) -> DataFrame:
    path, rows = fresh(t, "records"), t("documents").select("doc_id", "text", "lang")
    rows.write.json(path)
    return t.spark.read.schema(rows.schema).json(path)


@query("SELECT CASE WHEN html IS NULL OR page_id % 11 = 5 THEN 'error' ELSE 'ok' END AS status, count(*) AS n FROM pages GROUP BY ALL")
def s09_manifest(t: Tables) -> DataFrame:
    """Every eleventh page has lost its source and fails."""
    pages = t("pages").withColumn("html", F.when(F.col("page_id") % 11 != 5, F.col("html")))
    return S.manifest(S.extract_markup(pages, "page_id", "html", "html"), "page_id").groupBy("status").agg(F.count("*").alias("n"))


CHUNKS = "chunk_id string, document_id long, chunk_index int, content string, page int, type string, parent_chunk_index int"


def chunk_store(t: Tables, chunks: DataFrame) -> Buckets:
    """A new store of chunks in buckets of their documents, with ``chunks`` as its first version."""
    store = Buckets(t.spark, fresh(t, "chunks"), ["document_id"], CHUNKS)
    store.append(S.renumber_chunks(chunks.drop("chunk_id")), 0)
    return store


@query("""SELECT concat(document_id, '_chunk_', row_number() OVER w - 1) AS chunk_id, document_id, (row_number() OVER w - 1)::INT AS chunk_index, content, page, type, coalesce(parent_chunk_index, -1) AS parent_chunk_index
FROM {f_chunks} WHERE chunk_index % 4 <> 1 WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)""")
def s10_append_chunks(t: Tables) -> DataFrame:
    """Two appends: documents with even ids, then the others."""
    blanked = t("f_chunks").withColumn("content", F.when(F.col("chunk_index") % 4 == 1, "  ").otherwise(F.col("content")))
    store = chunk_store(t, blanked.where("document_id % 2 = 0"))
    store.append(S.renumber_chunks(blanked.where("document_id % 2 <> 0").drop("chunk_id")), 1)
    return store.read(1)


@query("SELECT document_id, string_agg(content, chr(10) ORDER BY page, chunk_index) AS text FROM {f_chunks} GROUP BY document_id")
def s11_read_chunks(t: Tables) -> DataFrame:
    return S.document_texts(t("f_chunks"))


@query("SELECT document_id, string_agg(content, chr(10) ORDER BY page, chunk_index) AS text FROM {f_chunks} WHERE document_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY document_id")
def s11_read_documents(t: Tables) -> DataFrame:
    """The texts of the toxic documents, for which only their buckets of the store are read."""
    return S.document_texts(chunk_store(t, t("f_chunks")).read(0, t("labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))))


@query("SELECT chunk_id FROM {f_chunks} WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def s12_delete_chunks(t: Tables) -> DataFrame:
    store = chunk_store(t, t("f_chunks"))
    store.delete(t("labels").where("toxic = 1").select(F.col("doc_id").alias("document_id")), 1)
    return store.read(1).select("chunk_id")


@query(r"SELECT event_id, strptime(left(raw, 19), '%Y-%m-%d %H:%M:%S') AS ts, upper(regexp_extract(raw, '\|\s*(\w+)\s*\|', 1)) AS level, regexp_extract(raw, '\|\s*\w+\s*\|\s*([^ ]+) - ', 1) AS module, regexp_extract(raw, '\|\s*\w+\s*\|\s*[^ ]+ - (.*)$', 1) AS message FROM {f_log_lines} WHERE raw LIKE '%|%|%'")
def s13_application_log(t: Tables) -> DataFrame:
    return parse_logs(t("f_log_lines")).drop("raw")


@query("SELECT idx, question, human_answer AS answer, 'qa' AS major FROM {f_public_qa}")
def s15_nested_records(t: Tables) -> DataFrame:
    path = fresh(t, "nested")
    rows = t("f_public_qa").select("idx", "question", F.array("human_answer").alias("human_answers"), F.struct(F.lit("qa").alias("major"), F.lit("x").alias("minor")).alias("task_type"))
    rows.write.json(path)
    back = t.spark.read.schema(rows.schema).json(path)
    return back.select("idx", "question", F.get("human_answers", F.lit(0)).alias("answer"), F.col("task_type.major").alias("major"))


@query("""WITH b AS (SELECT document_id, page, CASE WHEN chunk_index % 5 = 3 THEN 1 WHEN chunk_index % 5 = 4 THEN 2 ELSE 0 END AS b, string_agg(content, chr(10)||chr(10) ORDER BY chunk_index) AS s FROM {f_chunks} GROUP BY ALL),
p AS (SELECT document_id, page, concat('## Page ', page, chr(10), chr(10), string_agg(concat(CASE b WHEN 1 THEN '### OCR Notes' || chr(10) || chr(10) WHEN 2 THEN '### Extra Content' || chr(10) || chr(10) ELSE '' END, s), chr(10)||chr(10) ORDER BY b)) AS s FROM b GROUP BY document_id, page)
SELECT document_id, concat('# ', document_id, chr(10), chr(10), string_agg(s, chr(10)||chr(10) ORDER BY page)) AS markdown FROM p GROUP BY document_id""")
def s16_render_pages(t: Tables) -> DataFrame:
    kind = F.when(F.col("chunk_index") % 5 == 3, "ocr").when(F.col("chunk_index") % 5 == 4, "table").otherwise("text")
    return S.render_pages(t("f_chunks").withColumn("type", kind), F.col("document_id").cast("string"))

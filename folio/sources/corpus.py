"""Reading and writing corpora: files, encodings, delimited and JSON records, markup, chunk tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.sources.store import small_batches

EXTENSIONS = ".pdf .docx .doc .txt .md .markdown .csv .tsv .json .jsonl .html .htm .xml .png .jpg .jpeg".split()


#: File bytes a core up to which a table is dealt over the cores before work in its rows.
SMALL = 16 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Rows just read from files, dealt over all cores where the files hold less than ``SMALL`` bytes a core.

    A Parquet row group is read by one task, so a table of few row groups would be worked on by as few cores. Larger tables have more
    row groups and stay as they are read: what is shuffled here is at most ``SMALL`` a core, of the columns in use.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if size < cores * SMALL else rows


def scan_files(spark: SparkSession, path: str, extensions: list[str] = EXTENSIONS) -> DataFrame:
    """(path, length, extension) of the files below a folder, sorted by path. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.withColumn("extension", kind).where(kind.isin(extensions)).orderBy("path")


def _decode_one(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    try:
        return raw.decode("gb18030")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def decode(rows: DataFrame, content: str, out: str = "text") -> DataFrame:
    """Bytes as text: UTF-8 where valid (decoded by Spark), else GB18030, else Latin-1. Only the rest goes through Python."""

    @F.pandas_udf("string")
    def other(content: pd.Series) -> pd.Series:
        return content.map(_decode_one)

    valid = F.is_valid_utf8(F.col(content).cast("string"))
    native = rows.where(F.coalesce(valid, F.lit(True))).withColumn(out, F.decode(content, "UTF-8"))
    return native.unionByName(rows.where(~valid).withColumn(out, other(content)))


def delimited_header(table: DataFrame) -> str:
    """The line that names a table's headers; empty ones are left out, and a table without any has no such line."""
    names = [c.strip() for c in table.columns if c.strip()]
    return f"[表头] {' | '.join(names)}" if names else ""


def delimited_rows(table: DataFrame) -> Column:
    """A row as ``header: value`` pairs; empty headers and values are left out."""
    parts = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in table.columns if c.strip()]
    return F.concat_ws(" | ", *parts)


class _Texts(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.found.append(data.strip())


def html_texts(source: str) -> list[str]:
    """All non-blank text nodes, script and style bodies included; of a source without any, what is left between tags, on one line."""
    parser = _Texts()
    parser.feed(source)
    parser.close()
    if parser.found:
        return parser.found
    rest = " ".join(re.sub("<[^>]+>", " ", source).split())
    return [rest] if rest else []


def xml_texts(source: str) -> list[str]:
    """All non-blank text of an XML document; the source itself if it is not well-formed."""
    try:
        return [t.strip() for t in ElementTree.fromstring(source).itertext() if t.strip()]
    except ElementTree.ParseError:
        return [source]


def extract_markup(rows: DataFrame, id_col: str, source: str, kind: str) -> DataFrame:
    """(id_col, fragment_no, text, status, error): one row per text node; a failing document gives one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, text in zip(frame["id"], frame["source"], strict=True):
                try:
                    found = (xml_texts if kind == "xml" else html_texts)(text)
                    out += [(i, k, t, "ok", None) for k, t in enumerate(found)] or [(i, 0, "", "ok", None)]
                except Exception as e:  # a bad document must not stop the job; its row says why
                    out.append((i, 0, None, "error", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["id", "fragment_no", "text", "status", "error"])

    small_batches(rows.sparkSession)
    given = rows.select(F.col(id_col).alias("id"), F.col(source).alias("source"))
    return given.mapInPandas(run, f"id {dict(rows.dtypes)[id_col]}, fragment_no int, text string, status string, error string").withColumnRenamed("id", id_col)


def pretty_json(rows: DataFrame, source: str) -> DataFrame:
    """``rows`` with ``text``: the JSON document in ``source`` with an indent of two, other scripts as they are, and ``error`` where it
    cannot be read. Null gives null."""

    @F.pandas_udf("text string, error string")
    def reparse(given: pd.Series) -> pd.DataFrame:
        out = []
        for text in given:
            try:
                out.append((None if text is None else json.dumps(json.loads(text), ensure_ascii=False, indent=2), None))
            except ValueError as e:
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["text", "error"])

    return rows.withColumn("_made", reparse(source)).select(*rows.columns, "_made.*")


def with_title(text: Column, stem: Column) -> Column:
    """Markdown that starts with a heading: the stem where it has none."""
    return F.when(F.startswith(F.ltrim(text), F.lit("#")), text).otherwise(F.concat(F.lit("# "), stem, F.lit("\n\n"), text))


def manifest(extracted: DataFrame, id_col: str) -> DataFrame:
    """(id_col, status, error, fragments, chars) per document."""
    return extracted.groupBy(id_col).agg(F.max("status").alias("status"), F.max("error").alias("error"), F.count("*").alias("fragments"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


def renumber_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks ready to append: blank ones dropped, ids numbered anew, defaults filled in.

    ``chunks`` has (document_id, chunk_index, content, page, type, parent_chunk_index).
    """
    kept = chunks.where(X.strip(F.coalesce("content", F.lit(""))) != "")
    number = (F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index")) - 1).alias("chunk_index")
    made = kept.select("document_id", number, "content", F.coalesce("page", F.lit(1)).alias("page"), F.coalesce("type", F.lit("text")).alias("type"), F.coalesce("parent_chunk_index", F.lit(-1)).alias("parent_chunk_index"))
    return made.withColumn("chunk_id", F.concat("document_id", F.lit("_chunk_"), "chunk_index"))


def document_texts(chunks: DataFrame) -> DataFrame:
    """(document_id, text): non-blank chunks in order of page and index."""
    rows = chunks.where(F.col("content") != "").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", "chunk_index", "content"))).alias("r"))
    return rows.select("document_id", F.array_join(F.transform("r", lambda x: x["content"]), "\n").alias("text"))


def render_pages(chunks: DataFrame, title: Column) -> DataFrame:
    """(document_id, markdown): per page its text, then OCR notes, then other content."""
    bucket = F.when(F.col("type") == "text", 0).when(F.col("type") == "ocr", 1).otherwise(2)
    per = chunks.groupBy("document_id", "page", bucket.alias("b")).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("r"))
    head = F.when(F.col("b") == 1, "### OCR Notes\n\n").when(F.col("b") == 2, "### Extra Content\n\n").otherwise("")
    per = per.select("document_id", "page", "b", F.concat(head, F.array_join(F.transform("r", lambda x: x["content"]), "\n\n")).alias("s"))
    pages = per.groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct("b", "s"))).alias("r"))
    pages = pages.select("document_id", "page", F.concat(F.lit("## Page "), "page", F.lit("\n\n"), F.array_join(F.transform("r", lambda x: x["s"]), "\n\n")).alias("s"))
    whole = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", "s"))).alias("r"))
    return whole.select("document_id", F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(F.transform("r", lambda x: x["s"]), "\n\n")).alias("markdown"))

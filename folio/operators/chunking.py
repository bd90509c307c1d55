"""Segmentation: lines to blocks, blocks to chunks, headings to sections."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.sources.store import small_batches


def glue(lines: list[Column] | Column) -> Column:
    """Wrapped lines as one block: joined directly after an opening or dash, or before a closing mark; else by a line feed."""
    opens, closes = r"[-—/（(\[【：:]$", r"^[）)\]】、，,。.；;：:]"
    step = lambda acc, x: F.when(acc == "", x).when(acc.rlike(opens) | x.rlike(closes), F.concat(acc, x)).otherwise(F.concat(acc, F.lit("\n"), x))
    return F.aggregate(lines, F.lit(""), step)


def line_blocks(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, block_no, block): headings and list items alone, blank lines part blocks, page numbers vanish.

    ``lines`` has (doc, pos, line) with trimmed lines. Gaps and islands over one window per document.
    """
    line = F.col("line")
    alone = X.is_heading_line(line) | X.is_list_item(line)
    kept = lines.where(~X.is_dropped_line(line)).withColumn("solo", alone)
    order = Window.partitionBy(doc).orderBy("pos")
    before = F.lag(F.col("solo") | (line == ""), 1, True).over(order)
    island = F.sum((F.col("solo") | before).cast("int")).over(order)
    blocks = kept.withColumn("island", island).where("line <> ''").groupBy(doc, "island").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    number = F.row_number().over(Window.partitionBy(doc).orderBy("island")) - 1
    return blocks.select(doc, number.alias("block_no"), glue(F.transform("rows", lambda r: r["line"])).alias("block"))


def repeated_short_lines(lines: DataFrame, doc: str = "doc_id", longest: int = 40, least: int = 3) -> DataFrame:
    """(doc, line): short lines that are no headings, have no end mark and stand on a third of a document's pages or more."""
    pages = lines.groupBy(doc).agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= least)
    line = F.col("line")
    short = lines.where((line != "") & (F.length("line") <= longest) & ~X.is_heading_line(line) & ~line.rlike("[。！？!?]"))
    seen = short.groupBy(doc, "line").agg(F.count_distinct("page").alias("n"))
    return seen.join(pages, doc).where(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("pages") / 3))).select(doc, "line")


def paragraphs(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, para_no, paragraph, heading): blank lines part paragraphs, chapter headings stand alone."""
    marked = lines.withColumn("heading", X.is_chapter_heading(F.col("line")))
    order = Window.partitionBy(doc).orderBy("pos")
    starts = F.col("heading") | F.lag(F.col("heading") | (F.col("line") == ""), 1, True).over(order)
    islands = marked.withColumn("island", F.sum(starts.cast("int")).over(order)).where("line <> ''")
    made = islands.groupBy(doc, "island").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"), F.bool_or("heading").alias("heading"))
    number = F.row_number().over(Window.partitionBy(doc).orderBy("island")) - 1
    return made.select(doc, number.alias("para_no"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("paragraph"), "heading")


def heading_sections(paras: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, section_no, heading, body) from explicit headings; what stands before the first joins its section; empty ones go."""
    order = Window.partitionBy(doc).orderBy("para_no")
    number = F.greatest(F.sum(F.col("heading").cast("int")).over(order), F.lit(1))
    has = F.bool_or("heading").over(Window.partitionBy(doc))
    placed = paras.withColumn("section_no", number).withColumn("has", has).where("has")
    grouped = placed.groupBy(doc, "section_no").agg(
        F.max(F.when(F.col("heading"), F.col("paragraph"))).alias("heading"),
        F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("para_no", "paragraph")))).alias("rows"),
    )
    body = F.array_join(F.transform("rows", lambda r: r["paragraph"]), "\n\n")
    return grouped.withColumn("body", X.strip(body)).where("body <> ''").select(doc, "section_no", "heading", "body")


def length_groups(items: Column, size: int) -> Column:
    """Greedy groups of an array of strings by summed length, as an array of arrays; a left fold inside the row."""
    kind = "struct<done:array<array<string>>,open:array<string>,n:int>"
    start = F.from_json(F.lit('{"done":[],"open":[],"n":0}'), kind)

    def step(acc: Column, x: Column) -> Column:
        full = (F.size(acc["open"]) > 0) & (acc["n"] + F.length(x) > size)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(x)).otherwise(F.concat(acc["open"], F.array(x))).alias("open"),
            F.when(full, F.length(x)).otherwise(acc["n"] + F.length(x)).alias("n"),
        )

    return F.aggregate(items, start, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def length_sections(paras: DataFrame, doc: str = "doc_id", size: int = 1200, trigger: int = 900) -> DataFrame:
    """(doc, section_no, title, body) for documents without headings; below ``trigger`` characters one section ``Content``."""
    whole = paras.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("para_no", "paragraph"))).alias("rows"), F.sum(F.length("paragraph")).alias("n"), F.bool_or("heading").alias("has")).where("NOT has")
    texts = F.transform("rows", lambda r: r["paragraph"])
    groups = F.when(F.col("n") < trigger, F.array(texts)).otherwise(length_groups(texts, size))
    made = whole.select(doc, "n", F.posexplode(groups).alias("k", "parts"))
    title = F.when(F.col("n") < trigger, F.lit("Content")).otherwise(F.concat(F.lit("Section "), F.col("k") + 1))
    return made.select(doc, (F.col("k") + 1).alias("section_no"), title.alias("title"), F.array_join("parts", "\n\n").alias("body"))


def markdown_sections(lines: DataFrame, doc: str = "document_id") -> DataFrame:
    """(doc, section_no, heading, body): the last body of a repeated heading at its first place; empty bodies go.

    ``lines`` has (doc, line_no, line).
    """
    is_heading = F.col("line").rlike(r"^#{1,6}\s+")
    order = Window.partitionBy(doc).orderBy("line_no")
    numbered = lines.withColumn("head", is_heading).withColumn("no", F.sum(is_heading.cast("int")).over(order)).where("no > 0")
    bodies = numbered.groupBy(doc, "no").agg(
        F.max(F.when(F.col("head"), X.strip(X.sub(F.col("line"), r"^#{1,6}\s+", "")))).alias("heading"),
        F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "line")))).alias("rows"),
    )
    bodies = bodies.withColumn("body", X.strip(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))).where("body <> ''")
    return bodies.groupBy(doc, "heading").agg(F.min("no").alias("section_no"), F.max_by("body", "no").alias("body")).select(doc, "section_no", "heading", "body")


# Overlapping chunks look back over text already emitted; they run in one pass over Arrow batches.

#: Up to the last place in a stretch of text where it may be cut.
_TO_CUT = re.compile(r"(?s:.*)[\n。！？.!?；;，, ]")
_SOLO = re.compile(rf"#|{X.HEADING}|{X.LIST_ITEM}|.{{0,27}}[^。！？!?；;，,]\Z")
_DROP = re.compile(r"\d{1,4}|第?\s*\d+\s*页")
#: A line break that wrapping put after an opening mark or dash, or before a closing mark.
_WRAP = re.compile(r"(?<=[-—/（(\[【：:])\n|\n(?=[）)\]】、，,。.；;：:])")


def cuts(block: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Where a block is cut: stretches of at most ``size`` characters, each ending behind the last mark or blank of its second half if
    there is one, and starting ``overlap`` before the end of the one before."""
    start = 0
    while start + size < len(block):
        found = _TO_CUT.match(block, start + min(size, max(overlap + 1, size // 2)), start + size)
        end = found.end() if found else start + size
        yield start, end
        start = max(start + 1, end - overlap) if end - overlap > start else end
    yield start, len(block)


def split_long(block: str, size: int, overlap: int) -> list[str]:
    """The non-blank stretches of a block."""
    return [piece for a, b in cuts(block, size, overlap) if (piece := block[a:b].strip())]


def pack_with_overlap(blocks: list[str], size: int, overlap: int) -> list[str]:
    """Chunks of whole blocks, a blank line between them; each starts with trailing blocks of the one before, as many as hold
    ``overlap`` characters and let the next block fit.

    With lengths summed up from the front, a chunk's end and the start of the next are found by bisection.
    """
    pieces = [p for b in blocks for p in (split_long(b, size, overlap) if len(b) > size else [b])]
    bare = [0, *accumulate(map(len, pieces))]
    spaced = [n + 2 * k for k, n in enumerate(bare)]  # with the blank line after each
    out, start = [], 0
    while start < len(pieces):
        end = max(start + 1, bisect_right(spaced, spaced[start] + size + 2) - 1)
        out.append("\n\n".join(pieces[start:end]).strip())
        if end == len(pieces):
            break
        held = max(start, bisect_right(bare, bare[end] - overlap) - 1) if overlap > 0 else end
        start = min(end, max(held, bisect_left(spaced, spaced[end + 1] - 2 - size)))
    return [c for c in out if c]


def blocks_of(text: str) -> list[str]:
    """The blocks of a normalised text, by the islands of ``line_blocks``."""
    lines = [x for x in map(str.strip, text.splitlines()) if not _DROP.fullmatch(x)]
    alone = [bool(x) and bool(_SOLO.match(x)) for x in lines]
    island = accumulate(a or b or not line for a, b, line in zip(alone, [True, *alone], ["", *lines]))
    groups = groupby(zip(island, lines, strict=True), key=lambda p: p[0])
    joined = ("\n".join(x for _, x in rows if x) for _, rows in groups)
    return [_WRAP.sub("", b) for b in joined if b]


def parent_child_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 500, overlap: int = 50, parent_size: int = 1500, parent_overlap: int = 180) -> DataFrame:
    """(id_col, chunk_index, parent_chunk_index, content): parents cut into child chunks, numbered through the document."""
    small_batches(docs.sparkSession)
    floor = max(50, size), max(50, parent_size)
    laps = max(0, min(overlap, floor[0] // 2)), max(0, min(parent_overlap, floor[1] // 2))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text in zip(frame["id"], frame["text"], strict=True):
                k = 0
                for p, parent in enumerate(pack_with_overlap(blocks_of(text), floor[1], laps[1])):
                    for child in pack_with_overlap(blocks_of(parent), floor[0], laps[0]):
                        rows.append((doc, k, p, child))
                        k += 1
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "parent_chunk_index", "content"])

    source = docs.select(F.col(id_col).alias("id"), X.normalize_document(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).where("text <> ''")
    kind = dict(docs.dtypes)[id_col]
    return source.mapInPandas(run, f"id {kind}, chunk_index int, parent_chunk_index int, content string").withColumnRenamed("id", id_col)


def candidate_blocks(section: Column, size: int = 360) -> Column:
    """Evidence blocks of a section: paragraphs (long ones by sentences), then the same packed up to ``size``; distinct, no noise."""
    noise = X.is_low_information
    raw = F.filter(F.transform(F.split(X.block_text(section), r"\n\s*\n+"), X.strip), lambda b: (b != "") & ~noise(b))

    def join(items: Column, glue: str) -> Column:
        """Greedy concatenations of at most ``size`` characters: the numbers of the items that start one, then their texts."""
        kind = "struct<starts:array<int>,n:int,i:int>"
        start = F.from_json(F.lit('{"starts":[],"n":0,"i":0}'), kind)

        def step(acc: Column, x: Column) -> Column:
            new = (acc["i"] == 0) | (acc["n"] + len(glue) + F.length(x) > size)
            return F.struct(
                F.when(new, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
                F.when(new, F.length(x)).otherwise(acc["n"] + len(glue) + F.length(x)).alias("n"), (acc["i"] + 1).alias("i"),
            )

        def texts(acc: Column) -> Column:
            ends = lambda k: F.coalesce(F.get(acc["starts"], k + 1), acc["i"])
            return F.transform(acc["starts"], lambda a, k: X.strip(F.array_join(F.slice(items, a + 1, ends(k) - a), glue)))

        return F.aggregate(items, start, step, texts)

    pieces = F.flatten(F.transform(raw, lambda b: F.when(F.length(b) <= size, F.array(b)).otherwise(X.let(X.sentences(b, "。！？!?；;"), lambda s: join(s, "")))))
    # what is joined of blocks that are no noise is none either
    return X.let(F.filter(pieces, lambda b: ~noise(b)), lambda atomic: F.array_distinct(F.concat(atomic, join(atomic, "\n\n"))))


def merged(parts: list[str], most: int, least: int) -> str:
    """Texts in order as one. An overlap starts where the tail of what there is holds the first ``least`` + 1 characters of the next."""
    out: list[str] = []
    tail = ""
    for x in parts:
        if not tail:
            out, tail = [x], x[-most:]
            continue
        n, at = 0, tail.find(x[: least + 1]) if len(x) > least else -1
        while 0 <= at < len(tail) - least:
            if x.startswith(tail[at:]):
                n = len(tail) - at
                break
            at = tail.find(x[: least + 1], at + 1)
        out += [x[n:]] if n else ["\n\n", x]
        tail = (tail + out[-1] if n else tail + "\n\n" + x)[-most:]
    return "".join(out)


def merge_overlapping(parts: Column, most: int = 240, least: int = 16) -> Column:
    """Texts in order as one: an overlap of over ``least`` and at most ``most`` characters is kept once, else a blank line parts them."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None or any(x is None for x in r) else merged(list(r), most, least))

    return run(parts)

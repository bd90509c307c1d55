"""Evidence for questions: references resolved to sections, their blocks scored, selected and rendered.

A reference is ``file`` or ``file#heading``. All steps are joins and windows over (question, reference); a window holds the blocks of
one reference, so of one document at most. Sections are cut into blocks once, however many questions refer to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators import chunking as C
from folio.operators.lexical import evidence_score

GENDERS = ("男", "女")


def parsed(references: DataFrame) -> DataFrame:
    """``references`` (id, ref_no, reference) with file_name and wanted, the heading after the first ``#`` (empty without one)."""
    name = F.substring_index("reference", "#", 1)
    return references.withColumns({"file_name": name, "wanted": F.substring(F.col("reference"), F.length(name) + 2, F.length("reference"))})


def unknown_references(references: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, ref_no, reference): references to files that ``documents`` (file_name, ...) lacks. Evidence is whole only if there are none."""
    return parsed(references).join(documents.select("file_name").distinct(), "file_name", "left_anti").select("id", "ref_no", "reference")


def sectioned(lines: DataFrame, file: str = "file_name") -> DataFrame:
    """(file_name, section_index, heading, body, first_heading, found): the sections of each file in order.

    ``lines`` has (file, line_no, line). A file without sections is one section under its name without the ending, its text without
    heading lines; ``found`` is false there.
    """
    lines = lines.select(F.col(file).alias("file_name"), "line_no", "line")
    place = Window.partitionBy("file_name").orderBy("section_no")
    named = C.markdown_sections(lines, "file_name").withColumns({"section_index": F.row_number().over(place) - 1, "first_heading": F.first("heading").over(place), "found": F.lit(True)})
    rest = lines.join(named.select("file_name").distinct(), "file_name", "left_anti").groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("rows"))
    stem = F.regexp_replace("file_name", r"(?<=.)\.[^./]*$", "")
    whole = rest.select("file_name", F.lit(0).alias("section_index"), stem.alias("heading"), X.without_headings(F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("body"), stem.alias("first_heading"), F.lit(False).alias("found"))
    return named.select(whole.columns).unionByName(whole)


def blocked(sections: DataFrame) -> DataFrame:
    """``sections`` by candidate block: (..., block_index, content). A section whose blocks are all noise is one block; a blank one has none."""
    blocks, whole = C.candidate_blocks(F.col("body")), X.strip(F.col("body"))
    blocks = F.when(F.size(blocks) > 0, blocks).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))
    return sections.select("file_name", "section_index", "heading", "first_heading", "found", F.posexplode(blocks).alias("block_index", "content"))


def candidate_evidence(questions: DataFrame, references: DataFrame, sections: DataFrame) -> DataFrame:
    """(id, ref_no, question, file_name, heading, section_index, block_index, content, fallback_root, first_heading): what each reference may mean.

    A heading that the file has gives that section alone; any other reference all sections of the file, with ``fallback_root`` where a
    heading was asked for in vain. ``questions`` has (id, question), ``references`` (id, ref_no, reference), ``sections`` is of
    ``sectioned``. References to unknown files give nothing (see ``unknown_references``).
    """
    asked = parsed(references).join(questions.select("id", F.coalesce("question", F.lit("")).alias("question")), "id")
    named = sections.where("found").select("file_name", F.col("heading").alias("wanted"), F.lit(True).alias("exact"))
    placed = asked.join(named, ["file_name", "wanted"], "left").withColumn("exact", F.col("exact").isNotNull() & (F.col("wanted") != ""))
    meant = placed.join(blocked(sections), "file_name").where(~F.col("exact") | (F.col("heading") == F.col("wanted")))
    return meant.select(
        "id", "ref_no", "question", "file_name", "heading", F.when(F.col("exact"), 0).otherwise(F.col("section_index")).alias("section_index"), "block_index", "content",
        (~F.col("exact") & (F.col("wanted") != "")).alias("fallback_root"), "first_heading",
    )


def preferred(candidates: DataFrame) -> DataFrame:
    """``candidates`` without those that a preference rules out, with ``early`` and ``score``.

    Of a file that stands in for a missing heading, a question about beginnings takes the first section and its continuations, and of
    those the blocks that name both genders, if it asks for them and there are any; a file of chapters gives its first chapter.
    """
    group = Window.partitionBy("id", "ref_no")
    both = F.contains("content", F.lit(GENDERS[0])) & F.contains("content", F.lit(GENDERS[1]))
    asks_gender = F.contains("question", F.lit(GENDERS[0])) & F.contains("question", F.lit(GENDERS[1]))
    early = F.col("fallback_root") & X.any_in(F.col("question"), X.EARLY_MARKERS)
    chapters = F.col("fallback_root") & X.strip(F.col("first_heading")).rlike(X.CHAPTER_LIKE)
    base = X.heading_base(F.col("heading")) == X.heading_base(F.col("first_heading"))
    kept = candidates.withColumn("early", early).where(~(early | chapters) | base).withColumn("both", both)
    kept = kept.withColumn("any", F.max("both").over(group)).where(~(F.col("early") & asks_gender & F.col("any")) | F.col("both")).drop("both", "any")
    score = evidence_score(F.col("question"), F.col("heading"), F.col("content"), F.col("section_index"), F.col("fallback_root"))
    return kept.withColumn("score", F.round(score, 9))


def select_evidence(scored: DataFrame, most: int = 2, floor: float = 1.5, share: float = 0.55) -> DataFrame:
    """The blocks of each (id, ref_no) that carry its evidence, from ``preferred``.

    Blocks with at least ``max(floor, share * best)``, the best ``most`` of them (one for an early question), or the best one if none
    reaches that; equal scores go by place. Without a positive score the first block stands, for a blank question the first ``most``.
    """
    group = Window.partitionBy("id", "ref_no")
    ranked = scored.withColumns({"best": F.max("score").over(group), "place": F.row_number().over(group.orderBy(F.desc("score"), "section_index", "block_index"))})
    ranked = ranked.withColumn("first", F.row_number().over(group.orderBy("section_index", "block_index")))
    good = (F.col("score") >= F.greatest(F.lit(floor), F.col("best") * share)) & (F.col("place") <= F.when(F.col("early"), 1).otherwise(most))
    keep = F.when(X.strip(F.col("question")) == "", F.col("first") <= most).when(F.col("best") <= 0, F.col("first") == 1).otherwise(good | (F.col("place") == 1))
    return ranked.where(keep).drop("best", "place", "first")


def evidence_text(questions: DataFrame, selected: DataFrame) -> DataFrame:
    """(id, evidence) of every question: its blocks under their sources, by reference and place; empty without any."""
    source = F.concat(F.lit("[source] "), "file_name", F.when(F.col("heading") != "", F.concat(F.lit("#"), "heading")).otherwise(""), F.lit("\n"), "content")
    rows = selected.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ref_no", "section_index", "block_index", source.alias("s")))).alias("rows"))
    made = F.coalesce(F.array_join(F.transform("rows", lambda r: r["s"]), "\n\n"), F.lit(""))
    return questions.select("id").join(rows, "id", "left").select("id", made.alias("evidence"))


def with_evidence(samples: DataFrame, references: DataFrame, lines: DataFrame) -> DataFrame:
    """``samples`` (id, question, ...) with refs, their references in order, and evidence; ``lines`` has (file_name, line_no, line)."""
    chosen = select_evidence(preferred(candidate_evidence(samples, references, sectioned(lines))))
    refs = references.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_no", "reference"))), lambda r: r["reference"]).alias("refs"))
    return samples.join(refs, "id", "left").join(evidence_text(samples, chosen), "id")

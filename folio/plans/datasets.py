"""Queries of dataset preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators import chunking as C
from folio.operators import datasets as D
from folio.operators.evidence import with_evidence
from folio.plans.lexical import GUIDES
from folio.plans.registry import Tables, query
from folio.plans.segments import _POINTS, _SECTIONS
from folio.sources.store import cut

_CLEAN = r"regexp_replace(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_RATIO = r"(length(regexp_replace({0}, '[^A-Za-z]', '', 'g')) >= 0.7 * greatest(1, length(regexp_replace({0}, '[^\p{{L}}\p{{Nd}}]', '', 'g'))))"
_BAD = "regexp_matches(lower({0}), '" + "|".join(X.CREATIVE_WORDS) + "')"
_QA = f"""qa AS (SELECT idx AS id, config, {_CLEAN.format('question')} AS question, {_CLEAN.format('human_answer')} AS answer FROM {{f_public_qa}}),
hc AS (SELECT * FROM qa WHERE question <> '' AND answer <> '' AND length(question) <= 512 AND length(answer) <= 256 AND {_RATIO.format('question')} AND {_RATIO.format('answer')} AND NOT {_BAD.format('question')} AND NOT {_BAD.format('answer')})"""


def dialogue(t: Tables) -> DataFrame:
    rows = t("f_public_qa").select(F.col("idx").alias("id"), "question", F.array("human_answer").alias("human_answers"), F.array().cast("array<string>").alias("model_answers"), F.col("config").alias("source"))
    return D.normalize_dialogue(rows, "A-Za-z")


@query(f"WITH {_QA} SELECT id, config AS source_split, question, answer, 3 AS n_messages FROM hc")
def d01_dialogue_normalize(t: Tables) -> DataFrame:
    return dialogue(t).select("id", "source_split", "question", "answer", F.size("messages").alias("n_messages"))


@query(f"""WITH {_QA}, ci AS (SELECT id, config || ' qa' AS source_split, question || chr(10) || chr(10) || '补充信息：' || chr(10) || config AS question, answer FROM qa WHERE question <> '' AND answer <> '' AND NOT {_BAD.format('question')}
 AND NOT regexp_matches(lower(question), '{"|".join(D.TASK_WORDS)}'))
SELECT * FROM ci WHERE length(question) <= 512 AND length(answer) <= 256 AND {_RATIO.format('question')} AND {_RATIO.format('answer')}""")
def d02_instruction_normalize(t: Tables) -> DataFrame:
    rows = t("f_public_qa").select(F.col("idx").alias("id"), F.col("question").alias("instruction"), F.col("config").alias("input"), F.col("human_answer").alias("output"), F.struct(F.col("config").alias("major"), F.lit("qa").alias("minor")).alias("task_type"), F.lit("").alias("domain"))
    return D.normalize_instruction(rows, "A-Za-z").select("id", "source_split", "question", "answer")


@query(f"WITH {_QA} SELECT id, question, answer FROM qa QUALIFY row_number() OVER (PARTITION BY question, answer ORDER BY id) = 1")
def d03_dedupe(t: Tables) -> DataFrame:
    rows = t("f_public_qa").select(F.col("idx").alias("id"), X.clean_record(F.col("question")).alias("question"), X.clean_record(F.col("human_answer")).alias("answer"))
    return D.dedupe(rows, "id")


@query(f"""WITH {_QA}, tk AS (SELECT * FROM hc ORDER BY CASE config WHEN 'exam' THEN 1 ELSE 2 END, id LIMIT 600)
SELECT id, config, md5('42|' || id) AS place FROM tk QUALIFY row_number() OVER (PARTITION BY question, answer ORDER BY CASE config WHEN 'exam' THEN 1 ELSE 2 END, id) = 1""")
def d04_capped_collect(t: Tables) -> DataFrame:
    rows = dialogue(t).withColumnRenamed("source_split", "config").drop("messages")
    return D.capped_collect(rows, ["exam", "wiki"], 600, 42).select("id", "config", "place")


def sections(t: Tables) -> DataFrame:
    return C.markdown_sections(t("f_markdown"))


@query(f"""WITH {_SECTIONS}, f AS (SELECT DISTINCT document_id, file_name FROM {{f_markdown}}), s AS (SELECT document_id, heading, row_number() OVER (PARTITION BY document_id ORDER BY section_no) AS rank FROM sections QUALIFY rank <= 3)
SELECT concat(f.document_id, '-answerable-', lpad(coalesce(rank, 1)::VARCHAR, 3, '0')) AS id, file_name, CASE WHEN heading IS NULL THEN file_name ELSE concat(file_name, '#', heading) END AS evidence, false AS allow_no_answer FROM f LEFT JOIN s USING (document_id)
UNION ALL SELECT concat(document_id, '-rejectable-001'), file_name, NULL, true FROM f""")
def d05_seed_annotations(t: Tables) -> DataFrame:
    files = t("f_markdown").select("document_id", "file_name").distinct()
    return D.seed_annotations(sections(t), files)


@query("SELECT id, concat('new ', question) AS question, allow_no_answer, CASE WHEN NOT allow_no_answer THEN 2 END AS points FROM {f_annotations}")
def d06_overrides(t: Tables) -> DataFrame:
    records = t("f_annotations")
    overrides = records.select("id", F.concat(F.lit("new "), "question").alias("new_question"), F.array(F.lit("a"), F.lit("b")).alias("points"))
    merged, _ = D.apply_overrides(records.select("id", "question", "allow_no_answer"), overrides)
    return merged.select("id", "question", "allow_no_answer", F.when(F.col("points").isNotNull(), F.size("points")).alias("points"))


@query("SELECT id, CASE WHEN id % 7 = 0 THEN 'blank_question' ELSE 'no_answer_points' END AS problem FROM {f_annotations} WHERE id % 7 = 0 OR (NOT allow_no_answer AND id % 3 = 0)")
def d07_incomplete(t: Tables) -> DataFrame:
    points = F.when(F.col("id") % 3 != 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    records = t("f_annotations").withColumn("question", F.when(F.col("id") % 7 == 0, " ").otherwise(F.col("question"))).withColumn("points", points)
    return D.incomplete(records)


_EVERY = f"""{_SECTIONS}, ex AS (SELECT document_id, heading, 1 AS no FROM sections QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY section_no) = 1),
al AS (SELECT document_id, list(heading ORDER BY section_no) AS every, list(heading ORDER BY section_no) FILTER (heading NOT IN (SELECT e.heading FROM ex e WHERE e.document_id = s.document_id)) AS fresh FROM sections s GROUP BY document_id),
an AS (SELECT document_id, k + 2 AS no, CASE WHEN k < len(coalesce(fresh, [])) THEN fresh[k + 1] ELSE every[(k - len(coalesce(fresh, []))) % len(every) + 1] END AS heading FROM al, range(7) r(k))"""
_TEMPLATE = "replace([" + ", ".join(f"'{x}'" for x in D.TEMPLATES) + "][(no - 1) % 5 + 1], '{heading}', heading)"


def answerable(t: Tables) -> DataFrame:
    from folio.operators.lexical import top

    every = cut(sections(t).select("document_id", "section_no", "heading"))  # read four times; texts stay out
    have = top(every, "document_id", 1, F.asc("section_no")).select("document_id", "heading", F.lit(1).alias("no"))
    return D.expand_answerable(every, have, 8)


@query(f"WITH {_EVERY} SELECT document_id, no::INT AS no, heading, {_TEMPLATE} AS question FROM an")
def d08_expand_answerable(t: Tables) -> DataFrame:
    return answerable(t)


_TOPICS = "(VALUES " + ", ".join(f"({i}, '{n}', [{', '.join(repr(w) for w in ws)}]::VARCHAR[])" for i, (n, ws) in enumerate(D.TOPICS)) + ") tp(o, name, words)"
_REJ = f"""tx AS (SELECT document_id, string_agg(line, chr(10) ORDER BY line_no) AS content FROM {{f_markdown}} GROUP BY document_id),
rj AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY o) AS no, concat('文档是否给出了《', document_id, '》相关的', name, '？') AS question FROM tx, {_TOPICS} WHERE len(list_filter(words, lambda w: contains(lower(content), w))) = 0 QUALIFY no <= 2)"""


def rejectable(t: Tables) -> DataFrame:
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    texts = t("f_markdown").groupBy("document_id").agg(whole.alias("content")).withColumn("title", F.col("document_id").cast("string"))
    return D.expand_rejectable(texts, texts.select("document_id", F.lit("").alias("question")).limit(0), 2)


@query(f"WITH {_REJ} SELECT document_id, no::INT AS no, question FROM rj")
def d09_expand_rejectable(t: Tables) -> DataFrame:
    return rejectable(t)


@query(f"WITH {_EVERY}, {_REJ} SELECT concat(document_id, '-answerable-', lpad(no::VARCHAR, 3, '0')) AS id, document_id, {_TEMPLATE} AS question, false AS allow_no_answer FROM an UNION ALL SELECT concat(document_id, '-rejectable-', lpad(no::VARCHAR, 3, '0')), document_id, question, true FROM rj")
def d10_annotation_union(t: Tables) -> DataFrame:
    name = lambda kind: F.concat("document_id", F.lit(f"-{kind}-"), F.lpad(F.col("no").cast("string"), 3, "0")).alias("id")
    yes = answerable(t).select(name("answerable"), "document_id", "question", F.lit(False).alias("allow_no_answer"))
    return yes.unionByName(rejectable(t).select(name("rejectable"), "document_id", "question", F.lit(True).alias("allow_no_answer")))


_FILL = "replace(replace('{}', '{{question}}', question), '{{evidence}}', CASE WHEN evidence = '' THEN '{}' ELSE evidence END)"


@query(f"""WITH {GUIDES}, pts AS (SELECT document_id, string_split(points, '|') AS ps FROM ({_POINTS}) WHERE chunk_index = 1 AND points <> ''), rf AS (SELECT id, string_agg(reference, ', ' ORDER BY ref_no) AS refs FROM {{f_references}} GROUP BY id)
SELECT s.id, question, evidence, allow_no_answer AS rejectable, '{D.DOCUMENT_SYSTEM}' AS system_message, {_FILL.format(D.ASK, D.NO_EVIDENCE)} AS user_message,
 CASE WHEN allow_no_answer THEN '{D.REFUSAL_ANSWER}' ELSE concat(CASE WHEN len(ps) > 0 THEN concat('根据提供的文档证据，答案包括：', array_to_string(ps, '；'), '。') ELSE '根据提供的文档证据，可以直接从证据片段中组织答案。' END, ' 引用：', refs, '。') END AS assistant_message
FROM {{f_samples}} s JOIN ev ON ev.id = s.id JOIN rf ON rf.id = s.id LEFT JOIN pts ON pts.document_id = s.target_document""")
def d11_training_record(t: Tables) -> DataFrame:
    points = t("f_chunks").where("chunk_index = 1").select(F.col("document_id").alias("target_document"), X.answer_points(F.col("content")).alias("points"))
    samples = with_evidence(t("f_samples"), t("f_references"), t("f_guides")).join(points, "target_document", "left")
    said = lambda k, name: F.col("messages")[k]["content"].alias(name)
    return D.training_records(samples).select("id", "question", "evidence", "rejectable", said(0, "system_message"), said(1, "user_message"), said(2, "assistant_message"))


_SPLIT = """n AS (SELECT count(*) AS n FROM {f_annotations}), sz AS (SELECT CASE WHEN n >= 10 THEN greatest(1, round_even(n * 0.1, 0)) ELSE round_even(n * 0.1, 0) END AS v FROM n),
sp AS (SELECT id, CASE WHEN place <= v THEN 'validation' WHEN place <= 2 * v THEN 'test' ELSE 'train' END AS split FROM (SELECT id, row_number() OVER (ORDER BY md5('42|' || id), id) AS place FROM {f_annotations}), sz)"""


@query(f"WITH {_SPLIT} SELECT * FROM sp")
def d12_split(t: Tables) -> DataFrame:
    return D.split_records(t("f_annotations").select("id"), 42)


_REPEAT = "rp AS (SELECT CASE WHEN use = 0 THEN id::VARCHAR ELSE concat(id, '__dup', use) END AS id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS n FROM {f_annotations}), range(3) r(use) WHERE place + use * n < n * 5 // 2)"


@query(f"WITH {_REPEAT} SELECT * FROM rp")
def d13_repeat(t: Tables) -> DataFrame:
    records = t("f_annotations").select("id")
    return D.repeat_to(records, records.count() * 5 // 2)


@query("SELECT id FROM {f_annotations} ORDER BY md5('7|' || id), id LIMIT 50")
def d14_sample(t: Tables) -> DataFrame:
    return D.sample_exactly(t("f_annotations").select("id"), 50, 7)


@query(f"""WITH {_QA}, {_REPEAT}, h AS (SELECT id::VARCHAR AS id, 'dialogue' AS source_dataset FROM hc QUALIFY row_number() OVER (ORDER BY md5('7|' || id), id) <= count(*) OVER () // 2)
SELECT id, source_dataset, md5('42|' || id) AS place FROM (SELECT id, 'local' AS source_dataset FROM rp UNION ALL SELECT * FROM h)""")
def d15_mix(t: Tables) -> DataFrame:
    records = t("f_annotations").select("id")
    local = D.repeat_to(records, records.count() * 5 // 2).select("id", F.lit("local").alias("source_dataset"))
    asked = dialogue(t).select("id")
    public = D.sample_exactly(asked, asked.count() // 2, 7).select(F.col("id").cast("string").alias("id"), F.lit("dialogue").alias("source_dataset"))
    return local.unionByName(public).withColumn("place", D.hash_order("id", 42))


@query("""WITH s AS (SELECT target_document % 50 AS grp, count(*) AS n FROM {f_annotations} GROUP BY ALL), v AS (SELECT grp, n, CASE WHEN n >= 10 THEN greatest(1, round_even(n * 0.1, 0)) ELSE round_even(n * 0.1, 0) END AS v FROM s)
SELECT grp, n, (n - 2 * v)::BIGINT AS train, ((n - 2 * v) * 3)::BIGINT AS capacity, (n - 2 * v) * 3 >= 20 AS feasible FROM v""")
def d16_capacity(t: Tables) -> DataFrame:
    sizes = t("f_annotations").groupBy((F.col("target_document") % 50).alias("grp")).agg(F.count("*").alias("n"))
    part = F.bround(F.col("n") * 0.1, 0).cast("long")
    part = F.when(F.col("n") >= 10, F.greatest(part, F.lit(1))).otherwise(part)
    train = F.col("n") - 2 * part
    return sizes.select("grp", "n", train.alias("train"), (train * 3).alias("capacity"), (train * 3 >= 20).alias("feasible"))


@query(r"""WITH m AS (SELECT *, max(CASE WHEN role <> 'assistant' AND trim(content) <> '' THEN turn END) OVER (PARTITION BY conversation_id) AS last FROM {f_messages})
SELECT conversation_id, count(*)::INT AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles FROM m WHERE turn <= last AND trim(content) <> '' GROUP BY conversation_id""")
def d17_inference_messages(t: Tables) -> DataFrame:
    raw = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    made = t("f_messages").groupBy("conversation_id").agg(raw.alias("raw")).withColumn("kept", D.inference_messages(F.col("raw"))).where(F.size("kept") > 0)
    return made.select("conversation_id", F.size("kept").alias("n_messages"), F.array_join(F.transform("kept", lambda m: m["role"]), ",").alias("roles"))

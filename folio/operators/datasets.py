"""Preparation of question-answering datasets."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators.lexical import top
from folio.operators.selection import smallest
from folio.sources.store import cut

# Prompts, words, templates and topics that records are made of.
SYSTEM = "你是中文问答助手。请提供准确、简洁、克制的回答。"
DOCUMENT_SYSTEM = "你是企业文档问答助手。你必须只依据提供的证据作答，优先输出简洁、可引用、可核验的结论。如果证据不足，请明确回答“未找到足够依据”，不要编造。"
REFUSAL_ANSWER = "未找到足够依据。当前提供的文档片段中没有能直接回答该问题的明确信息，因此不应继续推断或编造答案。"
NO_EVIDENCE = "（当前没有可用证据，若无法回答请明确拒答。）"
ASK = (
    "问题：{question}\n\n"
    "证据片段：\n{evidence}\n\n"
    "回答要求：\n"
    "1. 只能依据证据回答；\n"
    "2. 如果证据不足，回答“未找到足够依据”；\n"
    "3. 如能回答，先用 1 句话给出结论，再给出 2-4 个要点；\n"
    "4. 不要扩写，不要编造，不要输出与证据无关的背景，并尽量保留引用。\n"
)
TASK_WORDS = "创作 角色 文学 情感 主观 推荐 闲聊 chat".split()
TEMPLATES = ["{heading}主要讲了什么？", "根据文档，{heading}包含哪些关键要点？", "文档如何解释{heading}？", "{heading}的核心内容是什么？", "围绕{heading}，文档强调了哪些重点？"]
TOPICS = [
    ("官方 GitHub 仓库地址", ["github", "gitlab"]),
    ("完整数据集下载链接", ["huggingface", "modelscope", "下载", "链接", "http://", "https://"]),
    ("线上 API 默认端口号", ["端口", "port", ":8000", ":8080", "api"]),
    ("商业许可证条款", ["license", "许可证", "授权"]),
    ("公开 benchmark 分数", ["benchmark", "准确率", "f1", "bleu", "rouge"]),
    ("GPU 显存需求数值", ["显存", "gpu", "cuda", "gb"]),
    ("作者邮箱联系方式", ["邮箱", "email", "@"]),
    ("完整超参数配置表", ["超参数", "learning rate", "batch size", "学习率", "batch"]),
    ("官方课程视频链接", []),
    ("完整实验环境下载包", []),
    ("逐项成本预算表", []),
    ("默认线上服务 SLA 指标", []),
]


def hash_order(col: str, seed: int) -> Column:
    """A fixed permutation of ids."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(col).cast("string")))


def messages(question: Column, answer: Column, system: str = SYSTEM) -> Column:
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", question), turn("assistant", answer))


def filled(template: str, **values: Column) -> Column:
    """A fixed template with columns in its named places."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[p] if k % 2 else F.lit(p) for k, p in enumerate(parts) if p))


def normalize_dialogue(rows: DataFrame, script: str = X.HAN, ratio: float = 0.7, most_prompt: int = 512, most_answer: int = 256) -> DataFrame:
    """(id, source_split, question, answer, messages) of acceptable records.

    ``rows`` has id, question, human_answers, model_answers (arrays) and source; the first non-blank human answer counts, else the
    first of the model's. Too long, blocklisted or mostly foreign records go.
    """
    said = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), X.clean_record), lambda x: x != "")
    answer = F.coalesce(F.get(said(F.col("human_answers")), F.lit(0)), F.get(said(F.col("model_answers")), F.lit(0)), F.lit(""))
    made = rows.select("id", X.clean_record(F.col("question")).alias("question"), answer.alias("answer"), X.clean_record(F.col("source")).alias("source"))
    good = lambda c, n: (F.col(c) != "") & (F.length(c) <= n) & (X.script_ratio(F.col(c), script) >= ratio) & ~X.any_in(F.lower(F.col(c)), X.CREATIVE_WORDS)
    split = F.when(F.col("source") == "", "train").otherwise(F.col("source"))
    return made.where(good("question", most_prompt) & good("answer", most_answer)).select("id", split.alias("source_split"), "question", "answer", messages(F.col("question"), F.col("answer")).alias("messages"))


def normalize_instruction(rows: DataFrame, script: str = X.HAN, ratio: float = 0.7, most_prompt: int = 512, most_answer: int = 256) -> DataFrame:
    """As ``normalize_dialogue`` for rows of id, instruction, input, output, task_type (major, minor) and domain."""
    clean = {c: X.clean_record(F.col(c)) for c in ("instruction", "input", "output", "domain")}
    tasks = F.array_join(F.filter(F.array(X.clean_record(F.col("task_type.major")), X.clean_record(F.col("task_type.minor"))), lambda x: x != ""), " ")
    made = rows.select("id", *(v.alias(k) for k, v in clean.items()), tasks.alias("task"))
    meta = F.lower(F.concat_ws(" ", "task", "domain", "instruction"))
    question = F.when(F.col("input") == "", F.col("instruction")).otherwise(F.concat("instruction", F.lit("\n\n补充信息：\n"), "input"))
    made = made.where((F.col("instruction") != "") & (F.col("output") != "") & ~X.any_in(meta, [*X.CREATIVE_WORDS, *TASK_WORDS])).withColumn("question", question)
    sized = (F.length("question") <= most_prompt) & (F.length("output") <= most_answer)
    scripted = (X.script_ratio(F.col("question"), script) >= ratio) & (X.script_ratio(F.col("output"), script) >= ratio)
    split = F.when(F.col("task") != "", F.col("task")).when(F.col("domain") != "", F.col("domain")).otherwise("train")
    return made.where(sized & scripted).select("id", split.alias("source_split"), "question", F.col("output").alias("answer"), messages(F.col("question"), F.col("output")).alias("messages"))


def dedupe(records: DataFrame, order: str) -> DataFrame:
    """The first record of each (question, answer)."""
    return top(records, ["question", "answer"], 1, F.asc(order)).drop("rank")


def capped_collect(records: DataFrame, config_order: list[str], target: int, seed: int) -> DataFrame:
    """Accepts in config order until ``target``, then removes repeats, then shuffles: adds ``place`` (the final order).

    The target is the feature: rows are numbered over range partitions in config and id order, and those below it stay.
    """
    rank = F.array_position(F.array(*map(F.lit, config_order)), F.col("config"))
    taken = records.withColumn("order", F.struct(rank.alias("c"), F.col("id"))).where(rank > 0)
    kept = dedupe(numbered(taken, F.col("order")).where(F.col("place") < target).drop("place"), "order").drop("order")
    return kept.withColumn("place", hash_order("id", seed))


def seed_annotations(sections: DataFrame, documents: DataFrame, most: int = 3) -> DataFrame:
    """(id, file_name, evidence, allow_no_answer): the first sections of each file (the file itself without any) and one to refuse.

    ``sections`` has (document_id, section_no, heading), ``documents`` (document_id, file_name).
    """
    first = top(sections, "document_id", most, F.asc("section_no"))
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    yes = documents.join(first, "document_id", "left").select(
        F.concat(stem, F.lit("-answerable-"), F.lpad(F.coalesce("rank", F.lit(1)).cast("string"), 3, "0")).alias("id"), "file_name",
        F.when(F.col("heading").isNull(), F.col("file_name")).otherwise(F.concat("file_name", F.lit("#"), "heading")).alias("evidence"), F.lit(False).alias("allow_no_answer"),
    )
    no = documents.select(F.concat(stem, F.lit("-rejectable-001")).alias("id"), "file_name", F.lit(None).cast("string").alias("evidence"), F.lit(True).alias("allow_no_answer"))
    return yes.unionByName(no)


def apply_overrides(records: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged records, records without an override). ``overrides`` has (id, new_question, points); points only for the answerable."""
    joined = records.join(overrides, "id", "left")
    points = F.when(~F.col("allow_no_answer"), F.col("points"))
    merged = joined.where("new_question IS NOT NULL").withColumn("question", F.col("new_question")).withColumn("points", points).drop("new_question")
    return merged, joined.where("new_question IS NULL").select("id")


def incomplete(records: DataFrame) -> DataFrame:
    """(id, problem): blank questions and answerable records without points."""
    blank = F.coalesce(X.strip(F.col("question")) == "", F.lit(True))
    problem = F.when(blank, "blank_question").when(~F.col("allow_no_answer") & (F.coalesce(F.size("points"), F.lit(0)) <= 0), "no_answer_points")
    return records.select("id", problem.alias("problem")).where("problem IS NOT NULL")


def expand_answerable(sections: DataFrame, existing: DataFrame, target: int = 8) -> DataFrame:
    """(document_id, no, heading, question): fills each document's quota from unused sections in order, then round-robin over all.

    ``sections`` has (document_id, section_no, heading) of sections with answer points, ``existing`` (document_id, heading, no) of
    answerable records. Numbers go on from the highest existing.
    """
    have = existing.groupBy("document_id").agg(F.count("*").alias("n"), F.max("no").alias("last"))
    fresh = sections.join(existing.select("document_id", "heading").distinct(), ["document_id", "heading"], "left_anti")
    all_ = sections.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "heading"))).alias("every"))
    new = fresh.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "heading"))).alias("fresh"))
    base = all_.join(new, "document_id", "left").join(have, "document_id", "left").select(
        "document_id", F.transform("every", lambda s: s["heading"]).alias("every"), F.coalesce(F.transform("fresh", lambda s: s["heading"]), F.array().cast("array<string>")).alias("fresh"),
        F.greatest(F.lit(0), target - F.coalesce("n", F.lit(0))).alias("missing"), F.coalesce("last", F.lit(0)).alias("last"),
    )
    rows = base.where("missing > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("missing").cast("int") - 1)))
    used = F.size("fresh")
    heading = F.when(F.col("k") < used, F.get("fresh", F.col("k"))).otherwise(F.get("every", F.pmod(F.col("k") - used, F.size("every"))))
    no = (F.col("last") + F.col("k") + 1).cast("int")
    template = F.get(F.array(*map(F.lit, TEMPLATES)), F.pmod(no - 1, F.lit(len(TEMPLATES))))
    made = rows.select("document_id", no.alias("no"), heading.alias("heading"), template.alias("template"))
    return made.select("document_id", "no", "heading", F.replace("template", F.lit("{heading}"), F.col("heading")).alias("question"))


def expand_rejectable(documents: DataFrame, existing: DataFrame, target: int = 2) -> DataFrame:
    """(document_id, no, question): topics whose words the content lacks, in order, then topics without words; known questions skipped.

    ``documents`` has (document_id, title, content), ``existing`` (document_id, question) of records to refuse. A document's topics
    are filtered in its own row.
    """
    have = existing.groupBy("document_id").agg(F.collect_set("question").alias("asked"), F.count("*").alias("n"))
    low = F.lower("content")
    topics = [F.when(~X.any_in(low, words) if words else F.lit(True), F.concat(F.lit("文档是否给出了《"), "title", F.lit(f"》相关的{name}？"))) for name, words in TOPICS]
    rows = documents.join(have, "document_id", "left").select(
        "document_id", F.filter(F.array(*topics), lambda q: q.isNotNull()).alias("open"), F.coalesce("asked", F.array().cast("array<string>")).alias("asked"), F.coalesce("n", F.lit(0)).alias("n")
    )
    picked = F.slice(F.array_except("open", "asked"), F.lit(1), F.greatest(F.lit(0), target - F.col("n")).cast("int"))
    return rows.select("document_id", F.posexplode(picked).alias("k", "question"), "n").select("document_id", (F.col("n") + F.col("k") + 1).cast("int").alias("no"), "question")


def ideal_answer(points: Column, refs: Column, refuse: Column) -> Column:
    """The reference answer from points and evidence, or the refusal."""
    kept = F.filter(F.transform(F.coalesce(points, F.array().cast("array<string>")), X.strip), lambda p: p != "")
    body = F.when(F.size(kept) > 0, F.concat(F.lit("根据提供的文档证据，答案包括："), F.array_join(kept, "；"), F.lit("。"))).otherwise("根据提供的文档证据，可以直接从证据片段中组织答案。")
    cited = F.when(F.coalesce(F.size(refs), F.lit(0)) > 0, F.concat(body, F.lit(" 引用："), F.array_join(refs, ", "), F.lit("。"))).otherwise(body)
    return F.when(refuse, REFUSAL_ANSWER).otherwise(cited)


def training_records(samples: DataFrame) -> DataFrame:
    """(id, question, evidence, ideal_answer, rejectable, messages) of samples (id, question, evidence, points, refs, allow_no_answer).

    Null evidence is none; the user's message then says so.
    """
    evidence = F.coalesce("evidence", F.lit(""))
    answer = ideal_answer(F.col("points"), F.col("refs"), F.col("allow_no_answer"))
    ask = filled(ASK, question=F.coalesce("question", F.lit("")), evidence=F.when(evidence == "", F.lit(NO_EVIDENCE)).otherwise(evidence))
    return samples.select("id", "question", evidence.alias("evidence"), answer.alias("ideal_answer"), F.col("allow_no_answer").alias("rejectable"), messages(ask, answer, DOCUMENT_SYSTEM).alias("messages"))


def split_sizes(n: int, validation: float = 0.1, test: float = 0.1) -> tuple[int, int, int]:
    """(train, validation, test) sizes: halves round to even, one each at least from ten records on."""
    v, s = round(n * validation), round(n * test)
    if n >= 10:
        v, s = max(v, 1), max(s, 1)
    return max(n - v - s, 0), v, s


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Adds ``place`` from 0 in the given order, without one task that sees all rows: rows are range-partitioned and counted by part."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id())
    ranged = cut(ranged)
    firsts = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_k").alias("_first"))  # a row per partition
    base = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    placed = ranged.join(F.broadcast(firsts.select("_part", "_first", base.alias("_base"))), "_part")
    return placed.withColumn("place", F.col("_base") + F.col("_k") - F.col("_first")).drop("_part", "_k", "_first", "_base")


def split_records(records: DataFrame, seed: int, validation: float = 0.1, test: float = 0.1) -> DataFrame:
    """Adds ``split``: the first of a fixed permutation validate, the next test, the rest train."""
    n = records.count()
    _, v, s = split_sizes(n, validation, test)
    placed = numbered(records.withColumn("_h", hash_order("id", seed)), F.col("_h"), F.col("id"))
    split = F.when(F.col("place") < v, "validation").when(F.col("place") < v + s, "test").otherwise("train")
    return placed.withColumn("split", split).drop("_h", "place")


def repeat_to(records: DataFrame, target: int, most: int = 3) -> DataFrame:
    """Cycles records in id order up to ``target`` rows; repeats get ids ``__dup{n}``. Raises if there are too few."""
    n = records.count()
    if not n or target > n * most:
        raise ValueError(f"{n} records cannot fill {target} places at {most} uses each")
    uses = F.explode(F.sequence(F.lit(0), F.lit(-(-target // n) - 1)))
    rows = numbered(records, F.col("id")).withColumn("use", uses).where(F.col("place") + F.col("use") * n < target)
    name = F.when(F.col("use") == 0, F.col("id").cast("string")).otherwise(F.concat(F.col("id").cast("string"), F.lit("__dup"), F.col("use")))
    return rows.withColumn("id", name).drop("place", "use")


def sample_exactly(records: DataFrame, target: int, seed: int) -> DataFrame:
    """The first ``target`` records of a fixed permutation. Raises if there are too few."""
    if records.count() < target:
        raise ValueError(f"fewer than {target} records")
    return smallest(records, hash_order("id", seed), "id", target)


def least_records_for(target: int, most: int = 3, validation: float = 0.1, test: float = 0.1) -> int:
    """The smallest number of records whose training split can fill ``target`` places."""
    n = max(1, math.ceil(target / most))
    while split_sizes(n, validation, test)[0] * most < target:
        n += 1
    return n


def inference_messages(raw: Column) -> Column:
    """Messages without blank ones and without assistant turns at the end."""
    kept = F.filter(raw, lambda m: (X.strip(m["role"]) != "") & (X.strip(m["content"]) != ""))
    last = F.aggregate(F.transform(kept, lambda m, i: F.when(m["role"] != "assistant", i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return F.slice(kept, F.lit(1), last)

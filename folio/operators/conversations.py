"""Conversation context: recent turns, token budgets, summaries, prompts, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONV = "conversation_id"


def in_order(rows: str = "rows") -> Column:
    return F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias(rows)


def recent(messages: DataFrame, turns: int = 10) -> DataFrame:
    """The last ``2 * turns`` messages of each conversation."""
    back = F.row_number().over(Window.partitionBy(CONV).orderBy(F.desc("turn")))
    return messages.withColumn("_back", back).where(F.col("_back") <= 2 * turns).drop("_back")


def within_budget(messages: DataFrame, budget: int = 4000) -> DataFrame:
    """The longest run of last messages whose tokens (half a token per character) fit the budget."""
    cost = F.floor(F.length("content") / 2)
    spent = F.sum(cost).over(Window.partitionBy(CONV).orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumn("_spent", spent).where(F.col("_spent") <= budget).drop("_spent")


def needs_compression(messages: DataFrame, turns: int = 10, budget: int = 4000) -> DataFrame:
    """(conversation_id, n, tokens, compress)."""
    made = messages.groupBy(CONV).agg(F.count("*").alias("n"), F.sum(F.floor(F.length("content") / 2)).alias("tokens"))
    return made.withColumn("compress", (F.col("n") > 2 * turns) | (F.col("tokens") > budget))


def summaries(messages: DataFrame, most: int = 3) -> DataFrame:
    """(conversation_id, summary): the first questions, and a marker if there were answers."""
    rows = messages.groupBy(CONV).agg(in_order())
    asked = F.transform(F.filter("rows", lambda m: m["role"] == "user"), lambda m: m["content"])
    said = F.when(F.size(asked) > 0, F.concat(F.lit("用户主要询问了: "), F.array_join(F.slice(asked, 1, most), ", ")))
    replied = F.when(F.exists("rows", lambda m: m["role"] == "assistant"), F.lit("助手提供了相关回答"))
    return rows.select(CONV, F.concat_ws("; ", said, replied).alias("summary"))


def prompts(history: DataFrame, system: str, question: str) -> DataFrame:
    """(conversation_id, prompt) from the messages that are kept."""
    name = lambda m: F.when(m["role"] == "user", "用户").otherwise("助手")
    lines = F.array_join(F.transform("rows", lambda m: F.concat(name(m), F.lit(": "), m["content"], F.lit("\n"))), "")
    whole = F.concat(F.lit(f"{system}\n## 对话历史\n"), lines, F.lit(f"\n## 当前问题\n用户: {question}\n\n请基于以上对话历史回答当前问题。"))
    return history.groupBy(CONV).agg(in_order()).select(CONV, whole.alias("prompt"))


def rollup(messages: DataFrame) -> DataFrame:
    """(conversation_id, message_count, last_message, updated_at) of user and assistant messages."""
    return messages.where(F.col("role").isin("user", "assistant")).groupBy(CONV).agg(
        F.count("*").alias("message_count"), F.left(F.max_by("content", "turn"), F.lit(100)).alias("last_message"), F.max("created_at").alias("updated_at")
    )


def _exported(messages: DataFrame, thinking: bool, sources: bool) -> DataFrame:
    """(conversation_id, rows, started, updated): messages in order; a message may have a ``thinking`` text and ``sources``
    (document_name, content, score)."""
    more = [c for c, wanted in (("thinking", thinking), ("sources", sources)) if wanted]
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "content", "created_at", *more)), lambda a, b: F.when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).otherwise(0))
    return messages.groupBy(CONV).agg(rows.alias("rows"), F.min("created_at").alias("started"), F.max("created_at").alias("updated"))


def export_markdown(messages: DataFrame, title: Column, thinking: bool = False, sources: bool = False) -> DataFrame:
    """(conversation_id, markdown): a header and one section per message; with ``thinking`` and ``sources``, which are columns then,
    those of the assistant's messages follow their text. A source's text is cut to 200 characters."""
    rows = _exported(messages, thinking, sources)
    who = lambda m: F.when(m["role"] == "user", "👤 用户").otherwise("🤖 助手")
    mine = lambda m, text: F.when((m["role"] == "assistant") & text.isNotNull(), text).otherwise("")
    cited = lambda s, i: F.concat((i + 1).cast("string"), F.lit(". **"), F.coalesce(s["document_name"], F.lit("未知文档")), F.lit("** (相似度: "), F.format_string("%.2f", F.coalesce(s["score"], F.lit(0.0))), F.lit(")\n   > "), F.left(F.coalesce(s["content"], F.lit("")), F.lit(200)), F.lit("...\n\n"))

    def part(m: Column) -> Column:
        parts = [F.lit("## "), who(m), F.lit(" ("), F.date_format(m["created_at"], "HH:mm:ss"), F.lit(")\n\n"), m["content"], F.lit("\n\n")]
        if thinking:
            parts.append(mine(m, F.when(m["thinking"] != "", F.concat(F.lit("### 💭 思考过程\n\n"), m["thinking"], F.lit("\n\n")))))
        if sources:
            parts.append(mine(m, F.when(F.size(m["sources"]) > 0, F.concat(F.lit("### 📚 引用来源\n\n"), F.array_join(F.transform(m["sources"], cited), "")))))
        return F.concat(*parts, F.lit("---\n\n"))

    head = F.concat(F.lit("# "), title, F.lit("\n**创建时间**: "), F.date_format("started", "yyyy-MM-dd HH:mm:ss"), F.lit("\n**消息数量**: "), F.size("rows"), F.lit("\n\n---\n\n"))
    return rows.select(CONV, F.concat(head, F.array_join(F.transform("rows", part), "")).alias("markdown"))


def export_json(messages: DataFrame, title: Column, thinking: bool = False, sources: bool = False) -> DataFrame:
    """(conversation_id, json): the conversation and its messages in order. A message without thinking or sources has no such field."""
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")

    def message(m: Column) -> Column:
        fields = [m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"), at(m["created_at"]).alias("created_at")]
        if thinking:
            fields.append(F.when(m["thinking"] != "", m["thinking"]).alias("thinking"))
        if sources:
            fields.append(F.when(F.size(m["sources"]) > 0, m["sources"]).alias("sources"))
        return F.struct(*fields)

    rows = _exported(messages, thinking, sources)
    head = F.struct(F.col(CONV).cast("string").alias("id"), title.alias("title"), F.size("rows").alias("message_count"), at(F.col("started")).alias("created_at"), at(F.col("updated")).alias("updated_at"))
    return rows.select(CONV, F.to_json(F.struct(head.alias("conversation"), F.transform("rows", message).alias("messages"))).alias("json"))

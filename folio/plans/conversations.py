"""Queries of conversation context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.operators import conversations as X
from folio.plans.registry import Tables, query


@query("SELECT conversation_id, turn, role FROM {f_messages} QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) <= 4")
def x01_recent_turns(t: Tables) -> DataFrame:
    return X.recent(t("f_messages"), 2).select("conversation_id", "turn", "role")


_BUDGET = "bg AS (SELECT * FROM (SELECT *, sum(length(content) // 2) OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS spent FROM {f_messages}) WHERE spent <= 400)"


@query(f"WITH {_BUDGET} SELECT conversation_id, turn FROM bg")
def x02_token_budget(t: Tables) -> DataFrame:
    return X.within_budget(t("f_messages"), 400).select("conversation_id", "turn")


@query("SELECT conversation_id, count(*) AS n, sum(length(content) // 2)::BIGINT AS tokens, count(*) > 8 OR sum(length(content) // 2) > 400 AS compress FROM {f_messages} GROUP BY ALL")
def x03_needs_compression(t: Tables) -> DataFrame:
    return X.needs_compression(t("f_messages"), 4, 400)


@query("""SELECT conversation_id, concat_ws('; ', CASE WHEN count(*) FILTER (role = 'user') > 0 THEN concat('用户主要询问了: ', array_to_string((list(content ORDER BY turn) FILTER (role = 'user'))[1:3], ', ')) END,
CASE WHEN bool_or(role = 'assistant') THEN '助手提供了相关回答' END) AS summary FROM {f_messages} GROUP BY ALL""")
def x04_context_summary(t: Tables) -> DataFrame:
    return X.summaries(t("f_messages"))


@query(f"""WITH {_BUDGET} SELECT conversation_id, concat('Be brief.', chr(10), '## 对话历史', chr(10), string_agg(concat(CASE WHEN role = 'user' THEN '用户' ELSE '助手' END, ': ', content, chr(10)), '' ORDER BY turn),
chr(10), '## 当前问题', chr(10), '用户: Why?', chr(10), chr(10), '请基于以上对话历史回答当前问题。') AS prompt FROM bg GROUP BY ALL""")
def x05_prompt(t: Tables) -> DataFrame:
    return X.prompts(X.within_budget(t("f_messages"), 400), "Be brief.", "Why?")


@query("SELECT conversation_id, count(*) AS message_count, left(arg_max(content, turn), 100) AS last_message, max(created_at) AS updated_at FROM {f_messages} WHERE role IN ('user', 'assistant') GROUP BY ALL")
def x06_rollup(t: Tables) -> DataFrame:
    return X.rollup(t("f_messages"))


@query("""WITH c AS (SELECT conversation_id, any_value(user_id) AS user_id, max(created_at) AS updated_at FROM {f_messages} GROUP BY ALL)
SELECT user_id, conversation_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY user_id) AS total, strftime(updated_at + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time FROM c WINDOW w AS (PARTITION BY user_id ORDER BY updated_at DESC, conversation_id) QUALIFY place BETWEEN 2 AND 6""")
def x07_conversation_page(t: Tables) -> DataFrame:
    rows = t("f_messages").groupBy("conversation_id").agg(F.first("user_id").alias("user_id"), F.max("created_at").alias("updated_at"))
    totals = rows.groupBy("user_id").agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "conversation_id"))
    page = rows.withColumn("place", place).where(F.col("place").between(2, 6)).join(totals, "user_id")
    local = F.date_format(F.from_utc_timestamp("updated_at", "Asia/Shanghai"), "yyyy-MM-dd HH:mm:ss")
    return page.select("user_id", "conversation_id", "place", "total", local.alias("local_time"))


@query("SELECT conversation_id, concat('对话 ', row_number() OVER (PARTITION BY user_id ORDER BY conversation_id)) AS title FROM (SELECT DISTINCT conversation_id, user_id FROM {f_messages})")
def x08_auto_title(t: Tables) -> DataFrame:
    rows = t("f_messages").select("conversation_id", "user_id").distinct()
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("conversation_id"))
    return rows.select("conversation_id", F.concat(F.lit("对话 "), number).alias("title"))


@query("""SELECT conversation_id, concat('# 对话 ', conversation_id, chr(10), '**创建时间**: ', strftime(min(created_at), '%Y-%m-%d %H:%M:%S'), chr(10), '**消息数量**: ', count(*), chr(10), chr(10), '---', chr(10), chr(10),
string_agg(concat('## ', CASE WHEN role = 'user' THEN '👤 用户' ELSE '🤖 助手' END, ' (', strftime(created_at, '%H:%M:%S'), ')', chr(10), chr(10), content, chr(10), chr(10), '---', chr(10), chr(10)), '' ORDER BY turn)) AS markdown FROM {f_messages} GROUP BY conversation_id""")
def s14_export_markdown(t: Tables) -> DataFrame:
    return X.export_markdown(t("f_messages"), F.concat(F.lit("对话 "), "conversation_id"))


def reasoned(t: Tables) -> DataFrame:
    """Messages of which some have a thinking text and sources."""
    source = lambda name: F.struct(F.lit(name).cast("string").alias("document_name"), "content", (F.col("turn") / 4).alias("score"))
    turn = F.col("turn")
    return t("f_messages").select("*", F.when(turn % 4 < 2, F.concat(F.lit("turn "), turn)).alias("thinking"), F.when(turn % 3 > 0, F.array(source("a.md"), source(None))).alias("sources"))


_NL = "chr(10)"
_CITED = "concat('{0}. **{1}** (相似度: ', printf('%.2f', turn / 4), ')', chr(10), '   > ', left(content, 200), '...', chr(10), chr(10))"


@query(f"""SELECT conversation_id, concat('# 对话 ', conversation_id, {_NL}, '**创建时间**: ', strftime(min(created_at), '%Y-%m-%d %H:%M:%S'), {_NL}, '**消息数量**: ', count(*), {_NL}, {_NL}, '---', {_NL}, {_NL},
string_agg(concat('## ', CASE WHEN role = 'user' THEN '👤 用户' ELSE '🤖 助手' END, ' (', strftime(created_at, '%H:%M:%S'), ')', {_NL}, {_NL}, content, {_NL}, {_NL},
 CASE WHEN role = 'assistant' AND turn % 4 < 2 THEN concat('### 💭 思考过程', {_NL}, {_NL}, 'turn ', turn, {_NL}, {_NL}) END, CASE WHEN role = 'assistant' AND turn % 3 > 0 THEN concat('### 📚 引用来源', {_NL}, {_NL}, {_CITED.format(1, 'a.md')}, {_CITED.format(2, '未知文档')}) END,
 '---', {_NL}, {_NL}), '' ORDER BY turn)) AS markdown FROM {{f_messages}} GROUP BY conversation_id""")
def s14_export_with_sources(t: Tables) -> DataFrame:
    return X.export_markdown(reasoned(t), F.concat(F.lit("对话 "), "conversation_id"), thinking=True, sources=True)


_AT = "strftime({0}, '%Y-%m-%dT%H:%M:%S')"


@query(f"""SELECT conversation_id, concat('{{"conversation":{{"id":"', conversation_id, '","title":"对话 ', conversation_id, '","message_count":', count(*), ',"created_at":"', {_AT.format('min(created_at)')}, '","updated_at":"', {_AT.format('max(created_at)')}, '"}},"messages":[',
string_agg(concat('{{"role":', to_json(role), ',"content":', to_json(content), ',"created_at":"', {_AT.format('created_at')}, '"', CASE WHEN turn % 4 < 2 THEN concat(',"thinking":"turn ', turn, '"') END,
 CASE WHEN turn % 3 > 0 THEN concat(',"sources":[{{"document_name":"a.md","content":', to_json(content), ',"score":', turn / 4, '}},{{"content":', to_json(content), ',"score":', turn / 4, '}}]') END, '}}'), ',' ORDER BY turn), ']}}') AS json FROM {{f_messages}} GROUP BY conversation_id""")
def s14_export_json(t: Tables) -> DataFrame:
    return X.export_json(reasoned(t), F.concat(F.lit("对话 "), "conversation_id"), thinking=True, sources=True)

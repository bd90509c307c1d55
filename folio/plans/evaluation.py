"""Queries of retrieval and prediction evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.plans.registry import Tables, query
from folio.plans.text import char_overlap

_EVAL = """j AS (SELECT e.experiment, a.id, a.allow_no_answer, a.target_document, e.retrieved_document, e.predicted_no_answer, e.manual_relevance, e.latency_ms,
  CASE WHEN e.retrieved_document = a.target_document THEN 1.0 ELSE 0.0 END AS hit FROM {f_annotations} a JOIN {f_eval_results} e ON e.id = a.id),
tot AS (SELECT count(*) AS total FROM {f_annotations})"""


def evaluate(annotations: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """One row of means per experiment. ``annotations`` has (id, target_documents, allow_no_answer), ``results`` (keys, id,
    retrieved_documents, citations, latency_ms, manual_relevance, predicted_no_answer); the last result of an id counts."""
    last = results.groupBy(*keys, "id").agg(F.max_by(F.struct("retrieved_documents", "citations", "latency_ms", "manual_relevance", "predicted_no_answer"), "seq").alias("r"))
    rows = annotations.join(last, "id").select(*keys, "id", "target_documents", "allow_no_answer", "r.*")
    none = F.size("target_documents") == 0
    hit = F.when(none | F.arrays_overlap("target_documents", "retrieved_documents"), 1.0).otherwise(0.0)
    matched = F.size(F.filter("citations", lambda c: F.array_contains("target_documents", c)))
    cited = F.when(F.size("citations") == 0, F.when(none, 1.0).otherwise(0.0)).otherwise(F.round(matched / F.size("citations"), 4))
    agree = (F.col("predicted_no_answer") == F.col("allow_no_answer")).cast("double")
    mean = lambda c, n, d=4: F.round(F.avg(c), d).alias(n)
    return rows.groupBy(*keys).agg(F.count("*").alias("covered"), mean(hit, "hit_rate"), mean(cited, "citation_rate"), mean(agree, "no_answer_accuracy"), mean("manual_relevance", "relevance"), mean("latency_ms", "latency_ms", 2))


def evaluated(t: Tables) -> DataFrame:
    got = t("f_eval_results").select("experiment", "id", F.array("retrieved_document").alias("retrieved_documents"), F.array("retrieved_document").alias("citations"), "latency_ms", "manual_relevance", "predicted_no_answer", F.lit(0).alias("seq"))
    asked = t("f_annotations").select("id", F.array("target_document").alias("target_documents"), "allow_no_answer")
    return evaluate(asked, got, ["experiment"])


@query(f"""WITH {_EVAL} SELECT experiment, count(*) AS covered, round(avg(hit), 4) AS hit_rate, round(avg(hit), 4) AS citation_rate, round(avg((predicted_no_answer = allow_no_answer)::INT), 4) AS no_answer_accuracy,
round(avg(manual_relevance), 4) AS relevance, round(avg(latency_ms), 2) AS latency_ms FROM j GROUP BY experiment""")
def e01_retrieval_eval(t: Tables) -> DataFrame:
    return evaluated(t)


@query(f"""WITH {_EVAL} SELECT experiment, concat('| ', experiment, ' | ', printf('%.4f', round(avg(hit), 4)), ' | ', count(*), '/', any_value(total), ' |') AS row FROM j, tot GROUP BY experiment""")
def e02_experiment_matrix(t: Tables) -> DataFrame:
    total = t("f_annotations").count()
    return evaluated(t).select("experiment", F.format_string(f"| %s | %.4f | %d/{total} |", "experiment", "hit_rate", "covered").alias("row"))


@query(r"""WITH c AS (SELECT id, 'a' AS side, unnest(string_split(regexp_replace(ideal_answer, '\s+', '', 'g'), '')) AS ch FROM {f_predictions} UNION ALL SELECT id, 'b', unnest(string_split(regexp_replace(answer, '\s+', '', 'g'), '')) FROM {f_predictions}),
n AS (SELECT id, ch, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM c WHERE ch <> '' GROUP BY id, ch), o AS (SELECT id, round(2.0 * sum(least(na, nb)) / (sum(na) + sum(nb)), 4) AS overlap FROM n GROUP BY id)
SELECT count(*) AS total, count(*) FILTER (rejectable) AS rejectable_total, round(avg((rejectable = regexp_matches(answer, '未找到足够依据|没有足够依据|暂无足够证据|无法从提供的文档中找到|无法根据当前文档确定'))::INT), 4) AS no_answer_precision, round(avg(CASE WHEN NOT rejectable THEN overlap END), 4) AS answer_overlap FROM {f_predictions} JOIN o USING (id)""")
def e03_prediction_eval(t: Tables) -> DataFrame:
    rows = t("f_predictions")
    scored = rows.join(char_overlap(rows, "id", "ideal_answer", "answer"), "id")
    agree = (F.col("rejectable") == X.any_in(F.col("answer"), X.REFUSALS)).cast("double")
    return scored.agg(F.count("*").alias("total"), F.count_if("rejectable").alias("rejectable_total"), F.round(F.avg(agree), 4).alias("no_answer_precision"), F.round(F.avg(F.when(~F.col("rejectable"), F.col("overlap"))), 4).alias("answer_overlap"))

"""Aggregates over judged metrics, and retrieval diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T

LABELS = ("relevant", "doubtful", "irrelevant")


def evaluation_frame(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, question, answer, contexts, ground_truth: the input of judged metrics."""
    return questions.join(answers, "query_id").select("query_id", "question", "answer", F.transform("context", lambda c: c["text"]).alias("contexts"), "ground_truth")


def metric_means(metrics: DataFrame) -> DataFrame:
    """metric, mean and number of its values (metric, value) that are neither null nor NaN; mean is null if there are none."""
    valid = F.when(~F.isnan("value"), F.col("value"))
    return metrics.groupBy("metric").agg(F.avg(valid).alias("mean"), F.count(valid).alias("n_valid"))


def overall(means: DataFrame) -> DataFrame:
    """overall (the unweighted mean of the means there are, else 0.0) and its verdict."""
    return means.agg(F.coalesce(F.avg("mean"), F.lit(0.0)).alias("overall")).withColumn("verdict", verdict(F.col("overall")))


def verdict(value: Column) -> Column:
    return F.when(value >= 0.7, "good").when(value >= 0.5, "fair").otherwise("poor")


def distance_ranges(hits: DataFrame) -> DataFrame:
    """label, n, distances as min..max with 6 digits ("n/a" without any), for all LABELS."""
    spark = hits.sparkSession
    labels = spark.createDataFrame([(x,) for x in LABELS], "label string")
    found = hits.groupBy("label").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"))
    shown = F.coalesce(F.format_string("%.6f..%.6f", "low", "high"), F.lit("n/a"))
    return labels.join(found, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "n/a").otherwise(shown).alias("distances"))


def relevance(text: Column, keywords: list[str], sure: int = 2) -> Column:
    """The label by how many of the keywords stand in the squeezed lower-case text: `sure` or more, fewer, none."""
    hits = T.keyword_hits(T.squeeze(F.lower(F.coalesce(text, F.lit("")))), keywords)
    return F.when(hits >= sure, LABELS[0]).when(hits >= 1, LABELS[1]).otherwise(LABELS[2])


def classify(question: Column, text: Column, rules: list[dict], default: dict) -> Column:
    """Relevance by ordered topic rules: the first rule whose words (`all` of them, or `any`) stand in the question decides.

    A rule: {any | all: words of the question, keywords: words of the text, sure: hits for the first label, otherwise: a label for fewer}.
    """
    q = T.squeeze(F.lower(F.coalesce(question, F.lit(""))))

    def label(rule: dict) -> Column:
        graded = relevance(text, rule["keywords"], rule.get("sure", 2))
        return F.when(graded == LABELS[0], LABELS[0]).otherwise(rule["otherwise"]) if "otherwise" in rule else graded

    out = label(default)
    for rule in reversed(rules):
        n = T.keyword_hits(q, rule.get("all") or rule["any"])
        out = F.when(n == len(rule["all"]) if rule.get("all") else n > 0, label(rule)).otherwise(out)
    return out


def sufficient(n_context: Column, question: Column, text: Column, topics: dict[str, list[str]]) -> Column:
    """Whether there is context, and one of a topic's words stands in it if the question names the topic."""
    ok = n_context > 0
    for topic, support in topics.items():
        ok = ok & (~F.contains(F.lower(question), F.lit(topic)) | (T.keyword_hits(F.lower(F.coalesce(text, F.lit(""))), support) > 0))
    return ok


#: The topic rules of the threshold report and the simulation, for a Russian-language corpus on guarantees.
REPORT_RULES = [
    {"any": ["алимент"], "keywords": ["алим"], "sure": 1, "otherwise": "irrelevant"},
    {"any": ["оспарива", "отказ"], "keywords": ["не вправе", "оспарива", "отказ", "независим", "основного обязательства", "выплат"], "otherwise": "doubtful"},
    {"all": ["обязанности", "гарант", "бенефициар"], "keywords": ["гарант", "требован", "бенефициар", "документ", "статья 374", "статья 375"]},
]
TAX_WORDS = ["налог", "ндс", "налого"]
GUARANTEE_WORDS = ["гарант", "бенефициар", "принципал", "статья 368", "независим"]
REPORT_DEFAULT = {"keywords": GUARANTEE_WORDS}
SUPPORT = {"налогов": ["налог", "ндс"], "алиментов": ["алим"]}


def report_label(question: Column, text: Column) -> Column:
    """The report's label. Tax questions come before the other rules but for alimony: one tax word is relevant, else two of the guarantee's words are doubtful."""
    q = T.squeeze(F.lower(F.coalesce(question, F.lit(""))))
    body = T.squeeze(F.lower(F.coalesce(text, F.lit(""))))
    about_tax = F.when(T.keyword_hits(body, TAX_WORDS) >= 1, "relevant").when(T.keyword_hits(body, GUARANTEE_WORDS) >= 2, "doubtful").otherwise("irrelevant")
    first = classify(question, text, REPORT_RULES[:1], REPORT_DEFAULT)
    rest = classify(question, text, REPORT_RULES[1:], REPORT_DEFAULT)
    return F.when(F.contains(q, F.lit("алимент")), first).when(F.contains(q, F.lit("налог")), about_tax).otherwise(rest)

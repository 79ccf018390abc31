"""Judged metrics from single verdicts: a judge says yes or no to one statement at a time, and aggregates make the metrics.

faithfulness         share of the answer's claims (its sentences) that the context supports
context_precision    average precision of the fragments in their order, useful ones being those that lead to the reference answer
context_utilization  the same for the answer that was given
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import sentences as S

#: The metrics of a run, in order.
METRICS = ("faithfulness", "context_precision", "context_utilization")
FAITHFULNESS, PRECISION, UTILIZATION = METRICS
REQUEST = "query_id, metric, item, question, statement, evidence"


def claims(answer: Column, language: str = "en") -> Column:
    """The claims of an answer: its sentences. An empty or null answer makes none."""
    return S.sentence_array(F.coalesce(answer, F.lit("")), language)


def requests(cases: DataFrame, language: str = "en") -> DataFrame:
    """REQUEST rows of cases (query_id, question, answer, contexts, ground_truth): what a judge has to decide.

    A claim is a statement, with all fragments as its evidence; a fragment is the evidence for the reference answer, or for the one given. Items count from 1.
    Null fragments are no items. A case without claims or fragments asks nothing.
    """
    fragments = F.filter(F.coalesce("contexts", F.array().cast("array<string>")), lambda c: c.isNotNull())
    given = cases.select("query_id", F.coalesce("question", F.lit("")).alias("question"), claims(F.col("answer"), language).alias("claims"), fragments.alias("fragments"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("answer", "ground_truth")))
    stated = given.select("query_id", F.lit(FAITHFULNESS).alias("metric"), "question", F.array_join("fragments", "\n\n").alias("evidence"), F.posexplode("claims").alias("at", "statement"))
    out = stated.select("query_id", "metric", (F.col("at") + 1).alias("item"), "question", "statement", "evidence")
    for metric, reference in ((PRECISION, "ground_truth"), (UTILIZATION, "answer")):
        useful = given.select("query_id", F.lit(metric).alias("metric"), "question", F.col(reference).alias("statement"), F.posexplode("fragments").alias("at", "evidence"))
        out = out.unionByName(useful.select("query_id", "metric", (F.col("at") + 1).alias("item"), "question", "statement", "evidence"))
    return out


def metrics(verdicts: DataFrame, cases: DataFrame) -> DataFrame:
    """query_id, metric, value for each case and each of METRICS, from verdicts (query_id, metric, item, verdict).

    Items without a verdict are left out and those after them move up; a metric without any verdict is null. Fragments none of which is useful
    have a precision of 0. Verdicts of one query meet in one task: as many as its claims and fragments.
    """
    order = Window.partitionBy("query_id", "metric").orderBy("item")
    known = verdicts.where("verdict is not null").select("query_id", "metric", "item", F.col("verdict").cast("int").alias("yes"))
    placed = known.withColumn("rank", F.row_number().over(order)).withColumn("so_far", F.sum("yes").over(order))
    sums = placed.groupBy("query_id", "metric").agg(F.count("*").alias("n"), F.sum("yes").alias("yes"), F.sum(F.col("yes") * F.col("so_far") / F.col("rank")).alias("gain"))
    precision = F.when(F.col("yes") > 0, F.col("gain") / F.col("yes")).otherwise(F.lit(0.0))
    valued = sums.select("query_id", "metric", F.when(F.col("metric") == FAITHFULNESS, F.col("yes") / F.col("n")).otherwise(precision).alias("value"))
    every = cases.select("query_id").distinct().select("query_id", F.explode(F.array(*map(F.lit, METRICS))).alias("metric"))
    return every.join(valued, ["query_id", "metric"], "left").select("query_id", "metric", "value")


def word_set(text: Column) -> Column:
    """The different lower-cased words of a text: letters and digits of any script."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def overlap_verdict(statement: Column, evidence: Column, percent: int = 50) -> Column:
    """An offline judge: yes if so many percent of the statement's different words stand in the evidence; null for a statement without words."""
    words = word_set(statement)
    return F.when(F.size(words) > 0, 100 * F.size(F.array_intersect(words, word_set(evidence))) >= percent * F.size(words))

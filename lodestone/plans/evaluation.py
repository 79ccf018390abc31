"""An evaluation run: answers without the cache, judged metrics, their means and the verdict."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import evaluation as V
from lodestone.plans.answering import Chat, answer
from lodestone.sources import resolve
from lodestone.sources.config import Profile, Settings, load_questions
from lodestone.sources.index import Index
from lodestone.sources.storage import written

#: The metrics of a run, in order.
METRICS = ("faithfulness", "context_precision", "context_utilization")


class Scorer(Protocol):
    """A judge: the metrics of one case; NaN or a missing one where it cannot tell."""

    def score(self, question: str, answer: str, contexts: list[str], ground_truth: str) -> dict[str, float]: ...


def questions(spark: SparkSession, path: str | Path) -> tuple[str, DataFrame]:
    """(name, query_id, query, ground_truth) of an evaluation set; query_id is the place in it."""
    name, cases = load_questions(path)
    return name, spark.createDataFrame([(n, q, truth) for n, (q, truth) in enumerate(cases)], "query_id long, query string, ground_truth string")


def answered(cases: DataFrame, index: Index, settings: Settings = Settings(), profile: Profile = Profile(), **models) -> DataFrame:
    """query_id, question, answer, contexts, ground_truth: every case answered anew, without reading or filling the cache."""
    made = answer(cases.select("query_id", "query"), index, None, settings, profile, **models).select("query_id", "answer", F.col("context_docs").alias("context"))
    return written(V.evaluation_frame(cases.withColumnRenamed("query", "question"), made), "evaluated")


def judged(frame: DataFrame, scorer: Scorer) -> DataFrame:
    """query_id, metric, value: a row for each of METRICS and each case; null where the judge could not tell."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for case in part.itertuples():
                found = scorer.score(case.question, case.answer, list(case.contexts), case.ground_truth)
                rows += [(case.query_id, m, found.get(m)) for m in METRICS]
            yield pd.DataFrame(rows, columns=["query_id", "metric", "value"]).astype({"value": "float64"})

    return written(frame.mapInPandas(run, "query_id long, metric string, value double"), "judged")


def report(metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mean and number of valid values of each metric; overall and verdict)."""
    means = V.metric_means(metrics)
    return means, V.overall(means)


def run(spark: SparkSession, path: str | Path, index: Index, scorer: Scorer, settings: Settings = Settings(), profile: Profile = Profile(), chat: Chat | None = None) -> dict:
    """The whole run. Usage statistics are switched off first; who judges is the scorer's affair (resolve.judge() says where the settings point)."""
    resolve.keep_private()
    name, cases = questions(spark, path)
    metrics = judged(answered(cases, index, settings, profile, chat=chat), scorer)
    means, overall = report(metrics)
    return {"name": name, "metrics": metrics, "means": means, **overall.first().asDict()}

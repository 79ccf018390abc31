"""What a session needs before Python functions of this package run on its executors."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, if it isn't installed there."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def query(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The function, with its session made ready first."""

    @functools.wraps(function)
    def run(spark: SparkSession, *args, **options) -> DataFrame:
        return function(ready(spark), *args, **options)

    return run

"""User analyses over named tables, within a time cap and a row cap."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from granary.operators import budget

MAX_SECONDS = 12.0
MAX_METRICS = 200


def analysis(tables: Mapping[str, DataFrame], function: Callable[[Mapping[str, DataFrame]], DataFrame]) -> DataFrame:
    """The metric rows (metric, value) a user function declares over named tables."""
    out = function(tables)
    if out.columns != ["metric", "value"]:
        raise ValueError(f"an analysis returns metric and value, not {out.columns}")
    return out


def run_analysis(
    tables: Mapping[str, DataFrame],
    function: Callable[[Mapping[str, DataFrame]], DataFrame],
    seconds: float = MAX_SECONDS,
    rows: int = MAX_METRICS,
) -> list:
    """Collect an analysis; its Spark jobs are cancelled when the time is up, and too many rows are an error."""
    spark = next(iter(tables.values())).sparkSession
    tag = f"analysis-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, lambda: spark.interruptTag(tag))
    spark.addTag(tag)
    timer.start()
    try:
        return budget.bounded_rows(analysis(tables, function), rows)
    finally:
        timer.cancel()
        spark.removeTag(tag)

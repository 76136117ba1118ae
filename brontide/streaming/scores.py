"""Trailing scores of an unbounded stream: the hopping windows of the decision timeline, with a
watermark for late rows. Each decision comes out once, when the watermark passes it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trailing_scores(stream: DataFrame, keys: list[str], time: str, value: str, context: str, stride: str, late: str, full: float) -> DataFrame:
    """keys, t (the window's end, left out of it), n, score: the capped sum of ``value`` over the context before t."""
    seen = stream.withWatermark(time, late).groupBy(*keys, F.window(time, context, stride)).agg(F.count("*").alias("n"), F.sum(value).alias("_s"))
    return seen.select(*keys, F.col("window.end").alias("t"), "n", F.least(F.lit(1.0), F.col("_s") / full).alias("score"))

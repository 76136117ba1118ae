"""Algebra of half-open intervals [start, end) in whole microseconds, per key.

Everything is window functions over the keys, so one shuffle by key serves a whole chain.
Touching intervals merge; empty ones vanish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def union_intervals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Normal form: sorted, disjoint, not touching. keys, start, end."""
    order = W.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    marked = df.where("end > start").select(*keys, "start", "end").withColumn("_new", new)
    island = F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("_island", island).groupBy(*keys, "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    ).drop("_island")


def _sweep(a: DataFrame, b: DataFrame, keys: list[str], keep: Column) -> DataFrame:
    """Pieces between neighbouring bounds where ``keep`` holds of how many of a and b cover them."""

    def bounds(df, in_a, in_b):
        steps = F.array(
            F.struct(F.col("start").alias("x"), F.lit(in_a).alias("da"), F.lit(in_b).alias("db")),
            F.struct(F.col("end").alias("x"), F.lit(-in_a).alias("da"), F.lit(-in_b).alias("db"))
        )
        return df.where("end > start").select(*keys, F.inline(steps))

    steps = bounds(a, 1, 0).unionByName(bounds(b, 0, 1)).groupBy(*keys, "x").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    order = W.partitionBy(*keys).orderBy("x")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    pieces = steps.select(
        *keys, F.col("x").alias("start"), F.lead("x").over(order).alias("end"), F.sum("da").over(so_far).alias("in_a"),
        F.sum("db").over(so_far).alias("in_b")
    )
    return union_intervals(pieces.where(F.col("end").isNotNull() & keep), keys)


def subtract_intervals(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _sweep(a, b, keys, (F.col("in_a") > 0) & (F.col("in_b") == 0))


def intersect_intervals(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _sweep(a, b, keys, (F.col("in_a") > 0) & (F.col("in_b") > 0))


def measure(df: DataFrame, keys: list[str], name: str = "length") -> DataFrame:
    """Length of the union, per key."""
    return union_intervals(df, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias(name))


def clipped_measure(df: DataFrame, keys: list[str], low, high, name: str = "length") -> DataFrame:
    """Length of the union inside [low, high), per key."""
    inside = F.greatest(F.lit(0), F.least(F.col("end"), high) - F.greatest(F.col("start"), low))
    return union_intervals(df, keys).groupBy(*keys).agg(F.sum(inside).alias(name))


def cells(decisions: DataFrame, keys: list[str], stride: int, duration: Column) -> DataFrame:
    """The cell [t, t + stride) of each decision, cut at the recording's end; merged."""
    return union_intervals(decisions.select(*keys, F.col("t").alias("start"), F.least(F.col("t") + stride, duration).alias("end")), keys)


def exposure(decisions: DataFrame, uncertain: DataFrame, gaps: DataFrame | None, keys: list[str], stride: int, duration: Column) -> DataFrame:
    """Time that counts: cells of available decisions, without gaps and uncertain time."""
    out = cells(decisions.where("available"), keys, stride, duration)
    if gaps is not None:
        out = subtract_intervals(out, gaps, keys)
    return subtract_intervals(out, uncertain, keys)


def as_array(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Per key the sorted intervals as one array column."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(name))


def from_json_pairs(df: DataFrame, keys: list[str], column: str, scale: int = 1_000_000) -> DataFrame:
    """Intervals kept as JSON text [[a, b], ...] in seconds."""
    pairs = F.explode(F.from_json(column, "array<array<double>>"))
    return df.select(*keys, pairs.alias("_p")).select(
        *keys, (F.col("_p")[0] * scale).cast("bigint").alias("start"), (F.col("_p")[1] * scale).cast("bigint").alias("end")
    )

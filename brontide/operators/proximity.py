"""As-of and band joins with an equality key, and anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, columns: list[str], tolerance: int) -> DataFrame:
    """For each left row the last right row at or before it and at most ``tolerance`` old: one
    union and one window, whatever the distances; no pairs. Right rows win ties in time."""
    state = F.struct(F.col(right_t).alias("at"), *[F.col(c) for c in columns])
    r = right.select(*keys, F.col(right_t).alias("_t"), state.alias("_state"), F.lit(0).alias("_side"))
    extra = [c for c in left.columns if c not in keys]
    lt = left.select(*keys, F.col(left_t).alias("_t"), F.lit(1).alias("_side"), F.struct(*extra).alias("_left"))
    both = r.unionByName(lt, allowMissingColumns=True)
    seen = F.last("_state", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0))
    out = both.withColumn("_seen", seen).where("_side = 1")
    fresh = F.col("_t") - F.col("_seen.at") <= tolerance
    return out.select(
        *keys, *[F.col(f"_left.{c}").alias(c) for c in extra], F.when(fresh, F.col("_seen.at")).alias("asof_t"),
        *[F.when(fresh, F.col(f"_seen.{c}")).alias(c if c not in extra else f"{c}_right") for c in columns]
    )


def within_band(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, band: int, name: str = "coincident") -> DataFrame:
    """Left rows with a flag: whether a right row lies within +/- band. The right side is cut
    into cells of the band's width, so the join has an equality in time as well."""
    cell = lambda c: F.floor(F.col(c) / band)
    near = F.explode(F.array(cell(right_t) - 1, cell(right_t), cell(right_t) + 1))
    r = right.select(
        *keys, F.col(right_t).alias("_rt"), near.alias("_cell")
    ).groupBy(*keys, "_cell").agg(F.sort_array(F.collect_set("_rt")).alias("_ts"))
    hit = F.coalesce(F.exists("_ts", lambda x: F.abs(x - F.col(left_t)) <= band), F.lit(False))
    return left.withColumn("_cell", cell(left_t)).join(r, [*keys, "_cell"], "left").withColumn(name, hit).drop("_cell", "_ts")


def missing(expected: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows whose keys were not seen."""
    return expected.join(seen.select(*keys).distinct(), keys, "left_anti")


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side; empty if the sets are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))

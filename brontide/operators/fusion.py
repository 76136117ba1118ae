"""Two modalities on one timeline: alignment, late and early fusion, model variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def align(left: DataFrame, right: DataFrame, keys: list[str], shared: list[str] = (), check: bool = True) -> DataFrame:
    """One-to-one full outer join. With ``check``, keys that are missing on a side or repeated,
    and shared columns that differ (nulls being equal), stop the job from inside it."""
    once = lambda d: d.groupBy(*keys).agg(F.count("*").alias("_c"), *[F.first(c).alias(c) for c in d.columns if c not in keys])
    lt, rt = once(left).withColumn("_l", F.lit(True)), once(right)
    rt = rt.select(
        *keys, F.col("_c").alias("_rc"), F.lit(True).alias("_r"),
        *[F.col(c).alias(f"_r_{c}" if c in shared else c) for c in right.columns if c not in keys]
    )
    out = lt.join(rt, keys, "full_outer")
    if check:
        bad = F.col("_l").isNull() | F.col("_r").isNull() | (F.col("_c") > 1) | (F.col("_rc") > 1)
        for c in shared:
            bad = bad | ~F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        out = out.withColumn(
            "_l", F.when(bad, F.raise_error(F.lit("timelines do not match"))).otherwise(F.col("_l").cast("string"))
        ).where("_l IS NOT NULL")
    return out.drop("_l", "_r", "_c", "_rc", *[f"_r_{c}" for c in shared])


def check_alpha(alpha: Column, allowed: list[float]) -> Column:
    """The weight, or the job stops if it is none of those allowed."""
    return F.when(alpha.isin(allowed), alpha).otherwise(
        F.raise_error(F.concat(F.lit("weight not registered: "), alpha.cast("string"))).cast("double")
    )


def specific(df: DataFrame, suffix: str, columns: list[str] = ("available", "score")) -> DataFrame:
    """A modality's columns under names of its own: available becomes available<suffix>."""
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in columns})


def generic(df: DataFrame, suffix: str, columns: list[str] = ("available", "score")) -> DataFrame:
    """A modality's columns under the names that alarms and metrics take; the columns that had these
    names go. What the modality lacks stops the job."""
    if lost := [f"{c}{suffix}" for c in columns if f"{c}{suffix}" not in df.columns]:
        raise ValueError(f"no columns {lost}")
    return df.drop(*columns).withColumnsRenamed({f"{c}{suffix}": c for c in columns})


def second_counts() -> Column:
    return F.col("available2") & F.col("score2").isNotNull()


def late_score(alpha: Column, q: Column | None = None) -> tuple[Column, Column]:
    """The weighted score where the second modality counts, else the first one's; and whether it is weighted."""
    active = (second_counts() if q is None else q) & (alpha != 0)
    return F.when(active, (1 - alpha) * F.col("score1") + alpha * F.col("score2")).otherwise(F.col("score1")), active


def late(
    df: DataFrame, alpha: Column, threshold: Column, first_threshold: Column, outage: bool = False, allowed: list[float] | None = None
) -> DataFrame:
    """Weighted score where the second modality counts, else the first one's score with its own
    threshold; a missing score is never multiplied by zero. Adds score, threshold, q. A weight that
    is none of those ``allowed`` stops the job."""
    alpha = check_alpha(alpha, allowed) if allowed else alpha
    q = F.lit(False) if outage else second_counts()
    score, active = late_score(alpha, q)
    return df.withColumns({"q": q, "score": score, "threshold": F.when(active, threshold).otherwise(first_threshold)})


def early(df: DataFrame, columns: list[str], prefix: str = "early__") -> DataFrame:
    """Columns of the second modality under the first one's prefix, null when it is unavailable."""
    return df.withColumns({prefix + c: F.when(F.col("available2"), F.col(c)) for c in columns})


def variant_scores(alpha_fixed: float, alpha_chosen: Column) -> dict[str, Column]:
    """The score of each variant: F0 (first modality), F1 (fixed weight), F2 (chosen weight), F3 (early score)."""
    q = F.col("available2") & F.col("score2").isNotNull()
    mixed = lambda a: F.when(q & (a != 0), (1 - a) * F.col("score1") + a * F.col("score2")).otherwise(F.col("score1"))
    each = {"F0": F.col("score1"), "F1": mixed(F.lit(alpha_fixed)), "F2": mixed(alpha_chosen), "F3": F.col("score_early")}
    return {model: score.cast("double") for model, score in each.items()}


def variants(df: DataFrame, alpha_fixed: float, alpha_chosen: Column, threshold: Column) -> DataFrame:
    """The variants of :func:`variant_scores`, stacked in one pass over the rows."""
    each = variant_scores(alpha_fixed, alpha_chosen)
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), s.alias("score")) for m, s in each.items()])).alias("_v")
    keep = [c for c in df.columns if c not in ("score", "threshold", "model")]
    return df.select(*keep, stacked).select(*keep, "_v.model", "_v.score", threshold.alias("threshold"))


def binarise(df: DataFrame) -> DataFrame:
    """1.0 at or over the row's threshold, 0.0 below, null without a score."""
    return df.withColumn("high", F.when(F.col("score").isNotNull(), (F.col("score") >= F.col("threshold")).cast("double")))

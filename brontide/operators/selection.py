"""Threshold and fusion-parameter choice over swept candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import alarms as A
from . import fusion as U
from . import matching as M
from . import metrics as Q
from .staging import stored

#: Thresholds and fusion weights that are tried; 1.01 never alarms.
THRESHOLDS = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.01]
ALPHAS = [0.0, 0.1, 0.25, 0.5]
MAX_FALSE_PER_HOUR = 1.0
#: What speaks against a fused candidate, in the order named, and how a choice came about.
SENSITIVITY, FALSE_ALARMS, NO_GAIN, LATE, EXPOSURE = "sensitivity_loss", "FAR_increase", "no_strict_improvement", "common_event_delay_penalty", "coverage_loss"
PROTECTED, NONE_ELIGIBLE = "protected_improvement", "no_eligible_nonzero_candidate"


def grid(df: DataFrame, name: str, values: list[float]) -> DataFrame:
    """Every row with every value: an explode of literals, not a join."""
    return df.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def ranked(candidates: DataFrame, fold: list[str], adaptive: bool, limit: float = MAX_FALSE_PER_HOUR) -> DataFrame:
    """Feasible candidates (false per hour within the limit), best first: highest sensitivity,
    fewest false per hour, shortest median delay (none last), smaller alpha, larger threshold."""
    order = [
        F.desc("sensitivity"), F.asc("false_per_hour"), F.asc_nulls_last("delay_median")
    ] + ([F.asc("alpha")] if adaptive else []) + [F.desc("threshold")]
    return candidates.where(F.col("false_per_hour") <= limit).withColumn("place", F.row_number().over(W.partitionBy(*fold).orderBy(*order)))


def choose(candidates: DataFrame, fold: list[str], adaptive: bool = False, limit: float = MAX_FALSE_PER_HOUR) -> DataFrame:
    return ranked(candidates, fold, adaptive, limit).where("place = 1").drop("place")


def protection(candidates: DataFrame, base: DataFrame, fold: list[str], paired: DataFrame, max_delay: float) -> DataFrame:
    """Whether a fused candidate may replace its base: no worse in events detected and false alarms,
    better in one, the median of its delays less the base's within ``max_delay`` (over events that
    both detect; vacuous without any), on equal exposure. Adds reason and eligible. ``paired``:
    fold, alpha, threshold, common_events, common_delay_delta."""
    b = base.select(*fold, F.struct("detected", "false_per_hour", "evaluable").alias("_b"))
    c = candidates.join(b, fold).join(paired, [*fold, "alpha", "threshold"], "left").fillna(0, ["common_events"])
    of = lambda name: (F.col(name), F.col(f"_b.{name}"))
    (found, found0), (false, false0), (exposed, exposed0) = of("detected"), of("false_per_hour"), of("evaluable")
    against = {
        SENSITIVITY: found < found0, FALSE_ALARMS: false > false0, NO_GAIN: (found <= found0) & (false >= false0),
        LATE: F.coalesce(F.col("common_delay_delta") > max_delay, F.lit(False)), EXPOSURE: exposed != exposed0
    }
    reasons = F.array_join(F.array_compact(F.array(*[F.when(test, name) for name, test in against.items()])), ";")
    return c.withColumn("eligible", (reasons == "") & (F.col("alpha") > 0)).withColumn(
        "reason", F.when(reasons == "", PROTECTED).otherwise(reasons)
    ).drop("_b")


def many(df: DataFrame, grids: dict[str, list]) -> DataFrame:
    for name, values in grids.items():
        df = grid(df, name, values)
    return df


def sweep(
    alarms: DataFrame, events: DataFrame, budget: DataFrame, keys: list[str], fold: list[str], grids: dict[str, list]
) -> tuple[DataFrame, DataFrame]:
    """Detection of every grid point at once: (measures by fold and point; of each recording and point the alarms
    and the delay of every event detected, and with a null event_id the alarms outside events). ``alarms``:
    keys, fold, the grids' columns, declaration; ``events``: keys, fold, event_id, start, end. Events are
    neither multiplied by the grid nor counted per point: only what alarms find depends on it."""
    unit = list(dict.fromkeys([*keys, *fold]))
    inside = M.declared_in(alarms.select(*unit, *grids, "declaration"), events.select(*unit, "event_id", "start", "end"), unit)
    found = stored(inside.groupBy(*unit, *grids, "event_id").agg(F.count("*").alias("alarms"), F.min(F.col("declaration") - F.col("onset")).alias("delay")), "found")
    matched = F.count("event_id")
    counts = found.groupBy(*fold, *grids).agg(
        matched.alias("detected"), (F.sum("alarms") - matched).alias("false_declarations"), F.percentile("delay", 0.5).alias("delay_median")
    )
    time = budget.groupBy(*fold).agg(F.sum("evaluable").alias("evaluable"))
    n = events.groupBy(*fold).agg(F.count("*").alias("events"))
    whole = time.join(n, fold, "left").fillna(0, ["events"]) if fold else time.crossJoin(n)  # without a fold: a row each
    out = many(whole, grids).join(counts, [*fold, *grids], "left").fillna(0, ["detected", "false_declarations"])
    return out.withColumns(Q.rates("sensitivity", "false_per_hour")), found


def select_fusion(
    aligned: DataFrame, events: DataFrame, budget: DataFrame, keys: list[str], fold: list[str], stride: int, max_delay: float,
    limit: float = MAX_FALSE_PER_HOUR
) -> tuple[DataFrame, DataFrame]:
    """Per fold the parameters of the variants: F0, the threshold of the first modality alone; F1, that
    of the fixed weight 0.5; F2, weight and threshold among those protected against F0, or F0;
    F3, that of the early score. Back: (choices, all candidates with the verdict on them). Folds
    without a feasible threshold are calibration-limited and have no choice.

    ``aligned``: keys, fold, t, duration, barrier_until, barrier_next, available, available2, score1, score2,
    score_early; ``events``: keys, fold, event_id, start, end; ``budget``: fold and the times.
    Rows whose second score does not count stand under F0's threshold, and so there are two
    sweeps, and the second begins with the choice of the first. A decision is one row in both, with
    the number of thresholds that it reaches for each score (:func:`.alarms.alarm_levels`)."""
    unit, least = list(dict.fromkeys([*keys, *fold])), sorted(THRESHOLDS)
    one = {"family": ["base", "early"], "at": THRESHOLDS}
    scores = {"base": F.col("score1"), "early": F.col("score_early")}
    aligned = stored(aligned, "aligned")
    alarms = A.alarm_levels(aligned, unit, stride, least, "family", {n: (c, A.reached(c, least)) for n, c in scores.items()}, ends=False)
    alone, found = sweep(alarms, events, budget, keys, fold, one)
    alone = stored(alone.withColumnRenamed("at", "threshold"), "alone")
    base, early = (choose(alone.where(F.col("family") == f), fold, limit=limit) for f in ("base", "early"))
    base = stored(base, "base")
    chosen = base.select(*fold, F.col("threshold").alias("base_threshold"))
    delays = found.where("event_id IS NOT NULL AND family = 'base'").join(chosen, fold).where("at = base_threshold").select(
        *dict.fromkeys([*fold, *keys]), "event_id", F.col("delay").alias("delay0")
    )

    two = {"alpha": ALPHAS[1:], "at": THRESHOLDS}
    fused_by = {}
    for alpha in ALPHAS[1:]:
        score, active = U.late_score(F.lit(alpha))
        alone_high = F.when(F.col("score1") >= F.col("base_threshold"), len(least)).otherwise(0)
        fused_by[alpha] = (score, F.when(active, A.reached(score, least)).otherwise(alone_high))
    alarms = A.alarm_levels(aligned.join(chosen, fold), unit, stride, least, "alpha", fused_by, ends=False)
    fused, found = sweep(alarms, events, budget, keys, fold, two)
    both = found.where("event_id IS NOT NULL").join(delays.hint("merge"), [*dict.fromkeys([*fold, *keys]), "event_id"])
    paired = both.groupBy(*fold, "alpha", F.col("at").alias("threshold")).agg(
        F.count("*").alias("common_events"), F.median(F.col("delay") - F.col("delay0")).alias("common_delay_delta")
    )
    fused = stored(protection(fused.withColumnRenamed("at", "threshold"), base, fold, paired, max_delay), "fused")

    best = choose(fused.where("eligible"), fold, adaptive=True, limit=limit)
    fixed = choose(fused.where("alpha = 0.5"), fold, limit=limit)
    measures = lambda d, n: d.select(
        *fold, F.struct("alpha", "threshold", "detected", "events", "false_per_hour", "delay_median", "common_events", "common_delay_delta").alias(n)
    )
    zero = base.withColumns({"alpha": F.lit(0.0), "common_events": F.col("detected"), "common_delay_delta": F.when(F.col("detected") > 0, 0.0)})
    out = measures(zero, "f0").join(measures(best, "f2"), fold, "left").join(measures(fixed, "f1"), fold, "left").join(
        early.select(*fold, F.col("threshold").alias("f3_threshold")), fold, "left"
    )
    out = out.withColumns({"reason": F.when(F.col("f2").isNotNull(), PROTECTED).otherwise(NONE_ELIGIBLE), "f2": F.coalesce("f2", "f0")})
    choices = out.select(
        *fold, F.col("f0.threshold").alias("eeg_threshold"), "f2.alpha", "f2.threshold", F.col("f1.threshold").alias("f1_threshold"), "f3_threshold", "reason",
        *[F.col(f"f0.{c}").alias(f"inner_eeg_{n}") for c, n in (("detected", "detected"), ("events", "events"), ("false_per_hour", "far"), ("delay_median", "delay"))],
        *[F.col(f"f2.{c}").alias(f"inner_fusion_{n}") for c, n in (("detected", "detected"), ("false_per_hour", "far"), ("delay_median", "delay"))], "f2.common_events", "f2.common_delay_delta")
    feasible = F.coalesce(F.col("false_per_hour") <= limit, F.lit(False))
    return choices, fused.withColumn("feasible", feasible)

"""Detection metrics per recording and rolled up; score quality; confusion measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import intervals as I
from . import ranges as G
from .staging import stored

HOUR = 3_600_000_000
TIMES = ["raw", "startup", "uncertain", "other_unavailable", "evaluable"]


def time_budget(recordings: DataFrame, decisions: DataFrame, uncertain: DataFrame, keys: list[str], startup: int, stride: int) -> DataFrame:
    """raw = startup + uncertain + other_unavailable + evaluable, exactly. Startup is without the
    uncertain part of it. ``recordings``: keys, duration."""
    whole = recordings.select(*keys, F.lit(0).cast("bigint").alias("start"), F.col("duration").alias("end"))
    begin = recordings.select(*keys, F.lit(0).cast("bigint").alias("start"), F.least(F.lit(startup), F.col("duration")).alias("end"))
    parts = [
        I.measure(I.intersect_intervals(whole, uncertain, keys), keys, "uncertain"),
        I.measure(I.subtract_intervals(begin, uncertain, keys), keys, "startup"),
        I.measure(I.exposure(decisions, uncertain, None, keys, stride, F.col("duration")), keys, "evaluable"),
    ]
    out = recordings.select(*keys, F.col("duration").alias("raw"))
    for p in parts:
        out = out.join(p, keys, "left")
    out = out.fillna(0, ["uncertain", "startup", "evaluable"])
    return out.withColumn("other_unavailable", F.col("raw") - F.col("startup") - F.col("uncertain") - F.col("evaluable"))


DELAYS = {"delay_median": 0.5, "delay_q25": 0.25, "delay_q75": 0.75}


def detection(judged: DataFrame, level: list[str], few: bool = True) -> DataFrame:
    """Counts, alarm time and delays of :func:`.matching.judged` rows at any level, in one aggregation.
    Delays are those of the events, never averages of averages. Duplicates count as false. ``few``:
    the delays of a unit fit into one task, as those of a recording do; else their quantiles are
    found without gathering them."""
    alarm, event = F.col("kind") == "alarm", F.col("kind") == "event"
    length = F.col("alarm.end") - F.col("declaration")
    delay = F.when(F.col("detected"), F.col("delay"))
    counts = judged.groupBy(*level).agg(
        F.count_if(event).alias("events"), F.count_if(F.col("detected")).alias("detected"), F.count_if(F.col("overlap_detected")).alias("overlap_detected"),
        F.count_if(alarm & (F.col("status") != "matched")).alias("false_declarations"), F.count_if(alarm & (F.col("status") == "duplicate")).alias("duplicate_declarations"), F.count_if(alarm).alias("total_declarations"),
        F.coalesce(F.sum(F.when(alarm, length)), F.lit(0)).alias("active"), F.coalesce(F.max(F.when(alarm, length)), F.lit(0)).alias("longest"),
        F.count(delay).alias("delay_n"), *([F.percentile(delay, q).alias(n) for n, q in DELAYS.items()] if few else []), F.min(delay).alias("delay_min"), F.max(delay).alias("delay_max"))
    if few:
        return counts
    spread = G.quantiles(judged.where("kind = 'event' AND detected"), level, "delay", DELAYS)
    return (counts.join(spread, level, "left") if level else counts.join(F.broadcast(spread), F.lit(True), "left")).select(  # without a level: a row each
        *[c for c in counts.columns if c not in ("delay_min", "delay_max")], *DELAYS, "delay_min", "delay_max"
    )


def summarize(judged: DataFrame, budget: DataFrame, level: list[str], few: bool = True) -> DataFrame:
    """Detection measures and time at any level (see :func:`detection`); ratios without a denominator are null. ``budget``:
    the columns of :func:`time_budget`, with those of ``level``; units without alarms and events count."""
    time = budget.groupBy(*level).agg(*[F.sum(c).alias(c) for c in TIMES])
    found = detection(judged, level, few)
    out = time.join(found, level, "left") if level else time.crossJoin(found)  # a row each
    out = out.fillna(0, [c for c in found.columns if c not in level and not c.startswith("delay_")] + ["delay_n"])
    return out.withColumn("missed", F.col("events") - F.col("detected")).withColumns(rates("sensitivity", "overlap_sensitivity", "false_per_hour", "warning_fraction"))


def rates(*names: str) -> dict[str, Column]:
    """Ratios of counts and times by name; null without a denominator."""
    of = {
        "sensitivity": ("detected", "events", 1), "overlap_sensitivity": ("overlap_detected", "events", 1),
        "false_per_hour": ("false_declarations", "evaluable", HOUR), "warning_fraction": ("active", "evaluable", 1),
    }
    return {n: F.try_divide(F.col(a).cast("double") * k, F.col(b).cast("double")) for n, (a, b, k) in of.items() if n in names}


def score_counts(scored: DataFrame, level: list[str]) -> DataFrame:
    """How many rows with label 0 or 1 each score of a level has (n), and how many of them have 1 (p); stored."""
    counts = scored.where("label >= 0 AND score IS NOT NULL AND NOT isnan(score)").groupBy(*level, "score").agg(
        F.sum(F.col("label").cast("bigint")).alias("p"), F.count("*").alias("n")
    )
    return stored(counts, "scores")


def rolled_up(counts: DataFrame, level: list[str]) -> DataFrame:
    """:func:`score_counts` of a coarser level, from those of a finer one."""
    return stored(counts.groupBy(*level, "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), "scores")


def score_quality(scored: DataFrame, level: list[str]) -> DataFrame:
    """Average precision (steps, ties together) and area under the ROC curve (average ranks) of
    scored rows with label 0 or 1; null unless both occur. Rows are first counted per score."""
    return counted_quality(score_counts(scored, level), level)


def counted_quality(by_score: DataFrame, level: list[str], few: bool = False) -> DataFrame:
    """:func:`score_quality` from :func:`score_counts`. How many rows lie below a score is a prefix sum over
    ranges of scores (:mod:`.ranges`), so a level of any size is spread over tasks. ``few``: the
    scores of a unit fit into one task, as those of a recording do, and one window over it serves."""
    if few:
        unit, sums = W.partitionBy(*level), ("p", "n")
        below = unit.orderBy("score").rowsBetween(W.unboundedPreceding, -1)
        s = by_score.withColumns(
            {f"{c}_before": F.coalesce(F.sum(c).over(below), F.lit(0)) for c in sums} | {f"{c}_total": F.sum(c).over(unit) for c in sums}
        )
    else:
        s = G.running(by_score, level, "score", ["p", "n"])
    tp, seen = F.col("p_total") - F.col("p_before"), F.col("n_total") - F.col("n_before")
    s = s.withColumns({"_ap": F.col("p") * tp / seen, "_rank": F.col("p") * (F.col("n_before") + (F.col("n") + 1) / 2)})
    out = s.groupBy(*level).agg(
        F.sum("n").alias("window_n"), F.sum("p").alias("window_positive"), F.sum("_ap").alias("_ap"), F.sum("_rank").alias("_rank")
    )
    pos, neg = F.col("window_positive"), F.col("window_n") - F.col("window_positive")
    both = (pos > 0) & (neg > 0)
    return out.select(
        *level, "window_n", "window_positive", F.when(both, F.try_divide(F.col("_ap"), pos)).alias("average_precision"),
        F.when(both, F.try_divide(F.col("_rank") - pos * (pos + 1) / 2, (pos * neg).cast("double"))).alias("roc_auc")
    )


def confusion(scored: DataFrame, level: list[str], at: float = 0.5) -> DataFrame:
    """Recall, precision, F1 and balanced accuracy of score >= at; 0 where undefined."""
    hit, pos = F.col("score") >= at, F.col("label") == 1
    c = scored.groupBy(*level).agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn")
    )
    r = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns(
        {
            "recall": r(tp, tp + fn), "precision": r(tp, tp + fp), "f1": r(2 * tp, 2 * tp + fp + fn),
            "balanced_accuracy": (r(tp, tp + fn) + r(tn, tn + fp)) / 2
        }
    )

"""Descriptive tables: responses around events, coverage, shifts, contributions, contingency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fusion as U
from . import intervals as I
from . import overlap as O
from . import proximity as P
from . import ranges as G


def response_windows(
    events: DataFrame, windows: DataFrame, keys: list[str], value: str, before: tuple[int, int], pre: int, post: int, least: int
) -> DataFrame:
    """Medians of ``value`` over usable windows in the baseline, just before, during and after each
    event, and how the event differs from its baseline, which counts once it has ``least`` windows."""
    t, on, off = F.col("t"), F.col("start"), F.col("end")
    parts = {
        "baseline": (t >= on - before[0]) & (t <= on - before[1]), "preictal": (t >= on - pre) & (t <= on), "ictal": (t >= on) & (t < off),
        "postictal": (t >= off) & (t < off + post)
    }
    near = windows.where("usable").select(*keys, "t", value)
    e = events.select(*keys, "event_id", "start", "end")
    j = O.overlaps(e, near, keys, (on - before[0], off + post), O.point(t), ("e", "w")).select(*keys, "e.*", F.col("w.t").alias("t"), f"w.{value}")
    med = lambda c: F.median(F.when(c, F.col(value)))
    out = j.groupBy(*keys, "event_id").agg(
        *[med(c).alias(f"{n}_median") for n, c in parts.items()], F.max(F.when(parts["ictal"], F.col(value))).alias("ictal_max"),
        F.count_if(parts["baseline"]).alias("n_baseline"), F.count_if(parts["ictal"]).alias("n_ictal")
    )
    out = e.select(*keys, "event_id").distinct().join(out, [*keys, "event_id"], "left").fillna(0, ["n_baseline", "n_ictal"])
    ready = F.col("n_baseline") >= least
    out = out.withColumn("baseline_median", F.when(ready, F.col("baseline_median"))).withColumns(
        {"baseline_ready": ready, "analyzable": ready & (F.col("n_ictal") > 0)}
    )
    return out.withColumns(
        {
            "median_change": F.col("ictal_median") - F.col("baseline_median"), "max_change": F.col("ictal_max") - F.col("baseline_median"),
            "relative_change": F.try_divide(F.col("ictal_median"), F.col("baseline_median")) - 1
        }
    )


def response_summary(responses: DataFrame, level: list[str]) -> DataFrame:
    a = F.col("analyzable")
    rise = a & F.coalesce(F.col("median_change") > 0, F.lit(False))
    m = lambda f, c: f(F.when(a, F.col(c)))
    out = responses.groupBy(*level).agg(
        F.count("*").alias("events"), F.count_if(a).alias("analyzable_events"), F.count_if(rise).alias("increase_events"),
        m(F.median, "baseline_median").alias("baseline_median"), m(F.min, "median_change").alias("min_change"),
        m(F.median, "median_change").alias("median_change"), m(F.max, "median_change").alias("max_change")
    )
    return out.withColumn("increase_fraction", F.try_divide(F.col("increase_events").cast("double"), F.col("analyzable_events").cast("double")))


def coverage(recordings: DataFrame, decisions: DataFrame, uncertain: DataFrame, keys: list[str], startup: int, stride: int) -> DataFrame:
    """Exact seconds of good, poor, startup, uncertain and missing time, and window fractions."""
    dur = F.col("duration")
    good = I.measure(I.exposure(decisions, uncertain, None, keys, stride, dur), keys, "evaluable")
    poor_rows = decisions.where(~F.col("available") & (F.col("t") >= startup)).withColumn("available", F.lit(True))
    poor = I.measure(I.exposure(poor_rows, uncertain, None, keys, stride, dur), keys, "poor_quality")
    whole = recordings.select(*keys, F.lit(0).cast("bigint").alias("start"), F.col("duration").alias("end"))
    begin = whole.withColumn("end", F.least(F.lit(startup), F.col("end")))
    unsure = I.measure(I.intersect_intervals(whole, uncertain, keys), keys, "uncertain")
    start = I.measure(I.subtract_intervals(begin, uncertain, keys), keys, "startup")
    counts = decisions.groupBy(*keys).agg(
        F.avg(F.when(F.col("t") >= startup, F.col("available").cast("double"))).alias("good_window_fraction"), F.median("score").alias("median_score")
    )
    out = recordings.select(*keys, F.col("duration").alias("raw"))
    for p in (good, poor, unsure, start, counts):
        out = out.join(p, keys, "left")
    out = out.fillna(0, ["evaluable", "poor_quality", "uncertain", "startup"])
    lost = F.col("raw") - F.col("startup") - F.col("uncertain") - F.col("poor_quality") - F.col("evaluable")
    return out.withColumns(
        {"acquisition_missing": F.greatest(F.lit(0), lost), "coverage_pct": F.try_divide(100.0 * F.col("evaluable"), F.col("raw").cast("double"))}
    )


def shift_quantiles(df: DataFrame, level: list[str], value: str, background: Column, at: list[float] = (0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Exact quantiles of the background rows; levels of any size are spread over tasks (:mod:`.ranges`)."""
    return G.quantiles(df.where(background), level, value, {f"q{round(x * 100):02d}": x for x in at})


def contribution(exposure: DataFrame, active_cells: DataFrame, keys: list[str]) -> DataFrame:
    """Evaluable time in which the second modality counts (q1), and in which it does not (q0)."""
    total = I.measure(exposure, keys, "evaluable")
    q1 = I.measure(I.intersect_intervals(exposure, active_cells, keys), keys, "q1")
    out = total.join(q1, keys, "left").fillna(0, ["q1"])
    return out.withColumns(
        {"q0": F.col("evaluable") - F.col("q1"), "q1_fraction": F.try_divide(F.col("q1").cast("double"), F.col("evaluable").cast("double"))}
    )


def event_classes(joined: DataFrame, before: Column, after: Column) -> DataFrame:
    """What another stream does to each event, from the delays (null: not detected) of the two."""
    b, f = before.isNotNull(), after.isNotNull()
    return joined.withColumns(
        {
            "classification": F.when(b & f, "preserved").when(f, "rescued").when(b, "lost").otherwise("still_missed"),
            "changed_delay_only": b & f & F.coalesce(before != after, F.lit(False))
        }
    )


#: The groups of events by which modality detects them, and the states at false alarms.
BOTH, FIRST, SECOND, NEITHER = "both", "eeg_only", "ecg_only", "neither"
UNAVAILABLE, NOT_READY, WITHIN, LARGER = "unavailable", "baseline_not_ready", "within_10bpm_recent_baseline", "larger_hr_deviation"


def detection_group(joined: DataFrame, first: str, second: str) -> DataFrame:
    a, b = F.col(first), F.col(second)
    return joined.withColumn("detection_group", F.when(a & b, BOTH).when(a, FIRST).when(b, SECOND).otherwise(NEITHER))


def complementarity(responses: DataFrame, first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Responses beside the detection of the same events by two modalities, one to one: an event that a
    side lacks or has twice stops the job. ``first``, ``second``: keys, detected, delay."""
    side = lambda d, n: d.select(*keys, F.col("detected").alias(f"{n}_detected"), F.col("delay").alias(f"{n}_delay"))
    out = U.align(U.align(responses, side(first, "eeg"), keys), side(second, "ecg"), keys)
    return detection_group(out, "eeg_detected", "ecg_detected")


def false_alarm_state(alarms: DataFrame, states: DataFrame, others: DataFrame, keys: list[str], stride: int, limit: float = 10.0) -> DataFrame:
    """What the second modality was like at each false alarm of the first, by its last row at most a stride
    old: unavailable, without a baseline yet, near it or further off (beyond ``limit``); and whether a
    false alarm of the second falls within a stride. ``alarms``: keys, declaration; ``states``: keys,
    t, usable, ready, delta; ``others``: keys, declaration."""
    a = P.asof_backward(alarms.select(*keys, "declaration"), states, keys, "declaration", "t", ["usable", "ready", "delta"], stride)
    usable, ready = F.coalesce("usable", F.lit(False)), F.coalesce("ready", F.lit(False))
    state = F.when(~usable, UNAVAILABLE).when(~ready, NOT_READY).when(F.abs("delta") <= limit, WITHIN).otherwise(LARGER)
    a = a.withColumns({"ecg_state": state, "hr_delta": F.when(usable & ready, F.col("delta"))}).drop("asof_t", "usable", "ready", "delta")
    return P.within_band(
        a, others.select(*keys, F.col("declaration").alias("_other")), keys, "declaration", "_other", stride, "other_false_within_stride"
    ).drop("_rt")


def patient_summary(responses: DataFrame, cover: DataFrame, level: list[str]) -> DataFrame:
    """:func:`response_summary` beside the totals of coverage at the same level."""
    sums = ["raw", "startup", "uncertain", "poor_quality", "acquisition_missing", "evaluable"]
    totals = cover.groupBy(*level).agg(*[F.sum(c).alias(c) for c in sums]).withColumn(
        "coverage_pct", F.try_divide(100.0 * F.col("evaluable"), F.col("raw").cast("double"))
    )
    return response_summary(responses, level).join(totals, level)


def sanity_sample(frames: DataFrame, group: str, item: str, at: int) -> DataFrame:
    """The row at time ``at`` of each group's first item, for a look at it."""
    first = frames.groupBy(group).agg(F.min(item).alias(item))
    return frames.where(F.col("t") == at).join(first, [group, item])


def distinct_values(df: DataFrame, level: list[str], columns: list[str]) -> DataFrame:
    """Per group the distinct values of each column, sorted."""
    return df.groupBy(*level).agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns])

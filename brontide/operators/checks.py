"""Checks that stop a job or report rows: equal tables, reconciled scores, controls, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import alarms as A
from . import fusion as U
from .staging import stored


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with their number, that one table has more often than the other; empty if they are equal
    whatever the order. One aggregation in place of two differences."""
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("the tables have different columns")
    one = "surplus_of_a_row" + "_" * max(map(len, a.columns))  # no column's name
    both = a.withColumn(one, F.lit(1)).unionByName(b.withColumn(one, F.lit(-1)))
    out = both.groupBy(*a.columns).agg(F.sum(one).alias("surplus"))
    return out.where("surplus <> 0")


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-14) -> DataFrame:
    """Keys without a single partner, or whose values differ by more than the tolerance (nulls are equal)."""
    side = lambda d, n: d.groupBy(*keys).agg(F.count("*").alias(f"n_{n}"), F.first(value).alias(n))
    j = side(a, "first").join(side(b, "second"), keys, "full_outer").fillna(0, ["n_first", "n_second"])
    x, y = F.col("first"), F.col("second")
    apart = F.when(x.isNull() | y.isNull(), ~x.eqNullSafe(y)).otherwise(F.abs(x - y) > tolerance)
    return j.where((F.col("n_first") != 1) | (F.col("n_second") != 1) | apart)


def disjoint(a: list, b: list) -> None:
    if set(a) & set(b):
        raise ValueError(f"items on both sides: {sorted(set(a) & set(b))}")


def negative_controls(
    aligned: DataFrame, keys: list[str], stride: int, alpha: float, threshold: float, first_threshold: float, largest: float = 0.5
) -> DataFrame:
    """With weight zero, or with the second modality out, fusion must be the first modality exactly.
    Per control: decisions, how many differ in score or threshold, alarms, and how many alarms
    (declaration, end, reason) only one of the two streams has. ``aligned``: keys, t, duration,
    barrier_until, barrier_next, available, available2, score1, score2."""
    cases = [("NC1_alpha_zero", 0.0, False), ("NC2_entire_outage", alpha, True), ("NC2_max_alpha_outage", largest, True)]
    aligned = stored(aligned, "aligned")
    scored = {"base": (F.col("score1"), F.lit(first_threshold))}
    for name, a, outage in cases:
        fused = U.late(aligned, F.lit(a), F.lit(threshold), F.lit(first_threshold), outage).drop("q")
        aligned = fused.withColumnsRenamed({c: f"{c}_{name}" for c in ("score", "threshold")})
        scored[name] = (F.col(f"score_{name}"), F.col(f"threshold_{name}"))
    off = lambda score, at: ~score.eqNullSafe(F.col("score1")) | (at != first_threshold)
    n = aligned.agg(F.count("*").alias("decisions"), *[F.count_if(off(*scored[name])).alias(name) for name, _, _ in cases]).where("decisions > 0")
    rows = n.select("decisions", F.inline(F.array(*[F.struct(F.lit(name).alias("control"), F.col(name).alias("differing")) for name, _, _ in cases])))
    # A decision is one row for all controls: each is high or not, at a single level.
    high = {name: (score, F.when(score >= at, 1).otherwise(0)) for name, (score, at) in scored.items()}
    alarms = A.alarm_levels(aligned, keys, stride, [first_threshold], "control", high)
    same = alarms.groupBy(*keys, "declaration", "end", "reason").agg(F.collect_set("control").alias("in_"))
    in_base = F.array_contains("in_", "base")
    each = same.withColumn(
        "control", F.explode(F.array(*[F.lit(n) for n, _, _ in cases]))
    ).withColumn("here", F.array_contains("in_", F.col("control")))
    found = each.groupBy("control").agg(F.count_if("here").alias("alarms"), F.count_if(F.col("here") != in_base).alias("differing_alarms"))
    out = rows.join(found, "control", "left").fillna(0, ["alarms", "differing_alarms"])
    return out.withColumn("passed", (F.col("differing") == 0) & (F.col("differing_alarms") == 0))


def annotation_flags(events: DataFrame, slack_s: int = 5) -> DataFrame:
    """Adds flags: what is odd in a listed event. ``events``: header_start_s and duration_s (null without
    a file), registration_start_s, start_clock_s, end_clock_s (null if unreadable), start_s, end_s."""
    c = F.col
    has = c("duration_s").isNotNull()
    drift = c("registration_start_s") - c("header_start_s")
    drift = F.abs(F.when(drift < -43_200, drift + 86_400).otherwise(drift))
    tests = [
        ("file_not_found", ~has),
        ("registration_start_text_disagrees_with_edf_header", has & (drift > slack_s)),
        ("seizure_start_unparsed", c("start_clock_s").isNull()),
        ("seizure_end_unparsed", c("end_clock_s").isNull()),
        ("negative_seizure_start_offset", c("start_s") < 0),
        ("seizure_end_before_start", c("end_s") < c("start_s")),
        ("seizure_start_after_edf_end", has & (c("start_s") > c("duration_s") + slack_s)),
        ("seizure_end_after_edf_end", has & (c("end_s") > c("duration_s") + slack_s)),
    ]
    return events.withColumn("flags", F.array_join(F.array_compact(F.array(*[F.when(t, n) for n, t in tests])), " | "))


def group_audit(recordings: DataFrame, events: DataFrame, group: str, texts: list[str]) -> DataFrame:
    """Per group: recordings, events, hours, and the distinct values of each text column, joined."""
    joined = lambda t: F.array_join(F.sort_array(F.collect_set(F.nullif(F.col(t), F.lit("")))), " ; ").alias(t)
    r = recordings.groupBy(group).agg(F.count("*").alias("recordings"), F.round(F.sum("duration_s") / 3600.0, 3).alias("hours"), *map(joined, texts))
    return r.join(events.groupBy(group).agg(F.count("*").alias("events")), group, "left").fillna(0, ["events"])


def inventory(recordings: DataFrame, events: DataFrame) -> DataFrame:
    """One row: how many recordings and events there are, how many are eligible, and their seconds.
    ``recordings``: duration_s, eligible; ``events``: eligible, uncertain."""
    ok = F.col("eligible")
    r = recordings.agg(
        F.count("*").alias("recordings"), F.count_if(ok).alias("eligible_recordings"), F.sum("duration_s").alias("total_seconds"),
        F.sum(F.when(ok, F.col("duration_s"))).alias("eligible_seconds")
    )
    e = events.agg(
        F.count("*").alias("events"), F.count_if(ok).alias("eligible_events"), F.count_if(~ok).alias("quarantined_events"),
        F.count_if("uncertain").alias("uncertain_events")
    )
    return r.crossJoin(e)  # a row each


def state_at(points: DataFrame, decisions: DataFrame, keys: list[str], point: str, stride: int, column: str) -> DataFrame:
    """The state of the decision whose cell [t, t + stride) holds each point, null without one. Cells of
    the grid (t is a multiple of stride) are found by division, so it is an equi join."""
    cell = lambda c: F.floor(F.col(c) / stride)
    d = decisions.select(*keys, cell("t").alias("_cell"), F.col(column).alias(f"{column}_at"))
    return points.withColumn("_cell", cell(point)).join(d.hint("merge"), [*keys, "_cell"], "left").drop("_cell")

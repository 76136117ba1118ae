"""Beat series: intervals with validity, rhythm features, past-only reference, lead choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rr_series(beats: DataFrame, keys: list[str], low: float, high: float, unit: float = 1_000_000.0) -> DataFrame:
    """``beats``: keys, x. One row an interval: rr (in units), valid (low <= rr <= high), rate (60 / rr),
    mid (its middle); invalid ones stay, marked."""
    order = W.partitionBy(*keys).orderBy("x")
    before = F.lag("x").over(order)
    rr = (F.col("x") - before) / unit
    out = beats.select(*keys, "x", before.alias("_b"), rr.alias("rr")).where("_b IS NOT NULL")
    return out.select(
        *keys, "x", "rr", F.col("rr").between(low, high).alias("valid"), F.try_divide(F.lit(60.0), F.col("rr")).alias("rate"),
        ((F.col("x") + F.col("_b")) / 2 / unit).alias("mid")
    )


def rhythm_features(rr: DataFrame, keys: list[str], group: list[str], middle: Column) -> DataFrame:
    """Nine features per group from valid intervals: rates and intervals (median, mean), slope of
    the rate on real time, median rate from ``middle`` on (the window's start and half its length,
    in the unit of mid) less that before it, spread, successive differences between valid
    neighbours only, and relative spread. Null where undefined."""
    order = W.partitionBy(*keys).orderBy("x")
    step = F.when(F.col("valid") & F.lag("valid").over(order), F.col("rr") - F.lag("rr").over(order))
    d = rr.withColumn("step", step).where("valid")
    late = F.col("mid") >= middle
    a = d.groupBy(*group).agg(
        F.count("*").alias("n_valid"), F.median("rate").alias("median_hr"), F.avg("rate").alias("mean_hr"), F.median("rr").alias("median_rr"), F.avg("rr").alias("mean_rr"),
        F.regr_slope("rate", "mid").alias("_slope"), (F.median(F.when(late, F.col("rate"))) - F.median(F.when(~late, F.col("rate")))).alias("early_late_hr"),
        F.when(F.count("*") > 1, F.stddev_samp("rr")).alias("sdrr_s"), F.sqrt(F.avg(F.col("step") * F.col("step"))).alias("rmssd_s"))
    return a.withColumns({"hr_slope_bpm_min": F.col("_slope") * 60, "rr_cv": F.try_divide(F.col("sdrr_s"), F.col("mean_rr"))}).drop("_slope")


def relative_reference(windows: DataFrame, keys: list[str], block: int, back: int, least_blocks: int, value: str) -> DataFrame:
    """Median of ``value`` over the usable windows exactly block, 2 block, ... back before t (none
    of the present one), once there are ``least_blocks``; and the difference and ratio to it. The
    frame runs over the windows of the same phase, so no join is needed."""
    phase = W.partitionBy(*keys, F.pmod(F.col("t"), F.lit(block))).orderBy("t").rangeBetween(-back, -block)
    past = F.collect_list(F.when(F.col("usable"), F.col(value))).over(phase)
    out = windows.withColumn("_past", F.sort_array(past)).withColumn("n_past", F.size("_past"))
    n = F.col("n_past")
    mid = (F.get("_past", F.floor((n - 1) / 2).cast("int")) + F.get("_past", F.floor(n / 2).cast("int"))) / 2
    ready = n >= least_blocks
    out = out.withColumns({"reference_ready": ready, "reference": F.when(ready, mid)}).drop("_past")
    now = F.when(F.col("usable"), F.col(value))
    return out.withColumns({"relative_delta": now - F.col("reference"), "relative_ratio": F.try_divide(now, F.col("reference"))})


def interval_reference(windows: DataFrame, keys: list[str], block: int = 60, back: int = 300, least_blocks: int = 2) -> DataFrame:
    """As :func:`relative_reference`, over the intervals of the past windows taken together: medians of
    rate and interval, and the present window's differences to them. ``windows``: keys, t, usable,
    intervals (the valid ones), median_rate, median_rr. Windows before one block don't count."""
    phase = W.partitionBy(*keys, F.pmod(F.col("t"), F.lit(block))).orderBy("t").rangeBetween(-back, -block)
    past = F.collect_list(F.when(F.col("usable") & (F.col("t") >= block), F.col("intervals"))).over(phase)
    out = windows.withColumn("_past", past).withColumn("baseline_good", F.size("_past") * block)
    ready = F.size("_past") >= least_blocks
    rr = F.flatten("_past")
    out = out.withColumns(
        {
            "baseline_ready": ready, "baseline_rate": F.when(ready, array_median(F.transform(rr, lambda x: 60.0 / x))),
            "baseline_rr": F.when(ready, array_median(rr))
        }
    ).drop("_past")
    now = lambda c: F.when(F.col("usable"), F.col(c))
    return out.withColumns(
        {
            "relative_rate_delta": now("median_rate") - F.col("baseline_rate"),
            "relative_rate_ratio": F.try_divide(now("median_rate"), F.col("baseline_rate")),
            "relative_rr_delta": now("median_rr") - F.col("baseline_rr")
        }
    )


def array_median(a: Column) -> Column:
    s, n = F.sort_array(a), F.size(a)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def choose_lead(leads: DataFrame, keys: list[str], agreement: str, rates_differ: Column, least_agreement: float = 0.70) -> DataFrame:
    """``leads``: keys, lead (0 or 1), good, valid_fraction, coverage, contrast, rate. None good, one
    good, two that disagree grossly, or the better by (valid fraction, coverage, contrast, lower
    number)."""
    best = F.max_by("lead", F.when(F.col("good"), F.struct("valid_fraction", "coverage", "contrast", (-F.col("lead")).alias("low"))))
    a = leads.groupBy(*keys).agg(
        F.count_if("good").alias("n_good"), best.alias("_best"), F.max(F.when(F.col("good"), F.col("lead"))).alias("_only"),
        F.max("rate").alias("rate_high"), F.min("rate").alias("rate_low"), F.first(agreement).alias(agreement)
    )
    apart = rates_differ | (F.col(agreement) < least_agreement)
    reason = F.when(F.col("n_good") == 0, "both_poor").when(
        F.col("n_good") == 1, F.concat(F.lit("only_lead_"), (F.col("_only") + 1).cast("string"), F.lit("_good"))
    ).when(apart, "gross_interlead_disagreement").otherwise("both_good_agree_lexicographic_quality")
    out = a.withColumn("reason", reason)
    lead = F.when(F.col("n_good") == 1, F.col("_only")).when((F.col("n_good") == 2) & ~apart, F.col("_best"))
    return out.select(*keys, "n_good", lead.alias("lead"), "reason")


def compressed_rr(peaks: Column, rate: float, low: float = 0.30, high: float = 2.0) -> Column:
    """The older interval filter on an array of peak positions: invalid intervals are removed and
    those that remain close up."""
    rr = F.zip_with(F.slice(peaks, 2, F.size(peaks)), F.slice(peaks, 1, F.size(peaks) - 1), lambda b, a: (b - a) / rate)
    return F.filter(rr, lambda x: (x >= low) & (x <= high))


#: Names of the older features.
OLDER = ["n_r_peaks", "valid_rr_count", "mean_hr_bpm", "mean_rr_s", "sdnn_s", "rmssd_s", "pnn50", "rr_cv", "hr_trend_bpm_per_min"]
_SUMS = ["t", "x", "y", "xx", "xy", "d", "dd", "steps", "large"]
_NEAR = 0.8  # a usual interval; squares are taken about it, so that little cancels


def walked(rr: Column) -> Column:
    """Sums over an array of intervals, in one walk along it: t, time passed; x and xx, middles of the
    intervals and their squares; y and xy, rates, and by middles; d and dd, intervals about a usual
    one, and squares; steps, squared differences of neighbours, and large, how many of them exceed 50 ms."""
    nothing = F.struct(*[F.lit(0.0).alias(c) for c in _SUMS], F.lit(None).cast("double").alias("last"))

    def walk(s: Column, x: Column) -> Column:
        at, rate, off, step = s["t"] + x / 2, 60.0 / x, x - _NEAR, F.coalesce(x - s["last"], F.lit(0.0))
        now = [x, at, rate, at * at, at * rate, off, off * off, step * step, F.when(F.abs(step) > 0.050, 1.0).otherwise(0.0)]
        return F.struct(*[(s[c] + v).alias(c) for c, v in zip(_SUMS, now, strict=True)], x.alias("last"))

    return F.aggregate(rr, nothing, walk)


def spread(s: Column, n: Column, free: int) -> Column:
    """Standard deviation from the sums of :func:`walked`, with ``free`` degrees of freedom taken off."""
    return F.sqrt(F.greatest(F.lit(0.0), F.try_divide(s["dd"] - s["d"] * s["d"] / n, n - free)))


def with_older_rhythm(df: DataFrame, peaks: str, rate: float) -> DataFrame:
    """Adds the older nine features of an array of peak positions, from intervals that close up where others
    were removed; with fewer than two intervals all but the counts are null, as all are for null."""
    rr = F.when(F.size(peaks) > 1, compressed_rr(F.col(peaks), rate)).when(F.col(peaks).isNotNull(), F.array().cast("array<double>"))
    d = df.withColumn("_rr", rr).withColumn("_s", walked(F.col("_rr")))
    s, n = F.col("_s"), F.size("_rr").cast("double")
    mean = F.try_divide(s["t"], n)
    slope = F.try_divide(n * s["xy"] - s["x"] * s["y"], n * s["xx"] - s["x"] * s["x"])
    values = [
        F.try_divide(s["y"], n), mean, spread(s, n, 1), F.sqrt(F.try_divide(s["steps"], n - 1)), F.try_divide(s["large"], n - 1),
        F.try_divide(spread(s, n, 1), mean), 60 * slope,
    ]
    counts = {"n_r_peaks": F.when(F.col(peaks).isNotNull(), F.size(peaks).cast("double")), "valid_rr_count": F.when(F.col("_rr").isNotNull(), n)}
    return d.withColumns(counts | {name: F.when(n >= 2, v) for name, v in zip(OLDER[2:], values, strict=True)}).drop("_rr", "_s")

"""Queries on rhythm, channels, reports, sources, sets and models."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import clock as C
from ..operators import channels as H
from ..operators import checks as V
from ..operators import fusion as U
from ..operators import intervals as I
from ..operators import alarms as A
from ..operators import benchmark as BM
from ..operators import leads as L
from ..operators import matching as M
from ..operators import models as N
from ..operators import proximity as P
from ..operators import reports as R
from ..operators import rhythm as Y
from ..operators import spectra as X
from ..operators import timeline as T
from ..operators.staging import stored
from . import binding as B
from . import detection as D

K = B.KEY


def _r(c, n=8):
    return F.round(F.col(c), n).alias(c)


def _rr(spark, sf):
    return Y.rr_series(B.samples(spark, sf).select("rec", "x").distinct(), K, 0.5, 24.0, float(B.HOUR))


def q23_rr_series(spark, sf):
    return _rr(spark, sf).select("rec", "x", "rr", "valid", "rate", "mid")


RHYTHM = ["median_hr", "mean_hr", "median_rr", "mean_rr", "sdrr_s", "rmssd_s", "hr_slope_bpm_min", "early_late_hr", "rr_cv"]


def q24_rhythm_features(spark, sf):
    return Y.rhythm_features(_rr(spark, sf), K, K, F.lit(B.DURATION / 2 / B.HOUR)).select("rec", "n_valid", *map(_r, RHYTHM))


def q25_relative_reference(spark, sf):
    d = B.decisions2(spark, sf).select("rec", "t", F.col("available").alias("usable"), F.round(F.col("score") * 40_000).alias("score"))  # whole cents: medians are exact
    out = Y.relative_reference(d, K, 24 * B.HOUR, 120 * B.HOUR, 3, "score")
    return out.select("rec", "t", "n_past", "reference_ready", "reference", "relative_delta", "relative_ratio")


def q26_lead_choice(spark, sf):
    s = B.samples(spark, sf).where("kind IN ('click', 'purchase')").withColumn("lead", (F.col("kind") == "purchase").cast("int"))
    lag = F.col("x") - F.lag("x").over(W.partitionBy("rec", "lead").orderBy("x", "event_id"))
    a = s.withColumn("gap", lag).groupBy("rec", "lead").agg(
        F.count("*").alias("n"), F.count_if(F.col("gap").between(B.HOUR, 100 * B.HOUR)).alias("v"),
        F.count_distinct(F.floor(F.col("x") / (24 * B.HOUR))).alias("days"), F.max("cents").alias("contrast")
    )
    both = W.partitionBy("rec")
    a = a.withColumns(
        {
            "good": F.col("n") >= 12, "valid_fraction": F.col("v") / F.col("n"), "coverage": F.col("days") / 30, "rate": F.col("n").cast("double"),
            "agreement": F.min("n").over(both) / F.max("n").over(both)
        }
    )
    gap = F.col("rate_high") - F.col("rate_low") > F.greatest(F.lit(10.0), 0.15 * F.col("rate_low"))
    return Y.choose_lead(a, K, "agreement", gap, 0.5)


NAMES = ["rms", "std", "line_length", "hjorth_activity", "hjorth_mobility", "hjorth_complexity"]


def _vectors(spark, sf):
    return B.table(spark, sf, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 8).alias("montage"), "embedding")


def q27_channel_time_features(spark, sf):
    return H.time_features(_vectors(spark, sf), "embedding").select("vec_id", *map(_r, NAMES))


def q28_cross_channel_reduce(spark, sf):
    out = H.reduce_channels(H.time_features(_vectors(spark, sf), "embedding"), ["montage"], NAMES)
    return out.select("montage", *[_r(c) for c in out.columns if c != "montage"])


def q29_channel_correlation(spark, sf):
    return H.correlation_summary(_vectors(spark, sf), ["montage"], "vec_id", "embedding").select(
        "montage", F.col("n_channels").cast("bigint").alias("n_channels"), _r("mean_abs_channel_corr"), _r("std_abs_channel_corr")
    )


def q30_welch_bands(spark, sf):
    return X.channel_features(_prices(spark, sf), "samples", 128.0).drop("samples")


def _responses(spark, sf):
    d = B.decisions2(spark, sf).select("rec", "t", F.col("available").alias("usable"), "score")
    return R.response_windows(B.events(spark, sf), d, K, "score", (60 * B.HOUR, 12 * B.HOUR), 4 * B.HOUR, 12 * B.HOUR, 3)


def q31_response_windows(spark, sf):
    out = _responses(spark, sf)
    return out.select(
        "rec", "event_id", "n_baseline", "n_ictal", "baseline_ready", "analyzable",
        *map(
            _r,
            ["baseline_median", "preictal_median", "ictal_median", "postictal_median", "ictal_max", "median_change", "max_change", "relative_change"]
        )
    )


def q31b_response_summary(spark, sf):
    out = R.response_summary(_responses(spark, sf), K)
    return out.select(
        "rec", "events", "analyzable_events", "increase_events",
        *map(_r, ["baseline_median", "min_change", "median_change", "max_change", "increase_fraction"])
    )


def q32_coverage(spark, sf):
    out = R.coverage(B.recordings(spark, sf), B.decisions2(spark, sf), B.uncertain(spark, sf), K, B.LONG, B.STRIDE)
    return out.select(
        "rec", "raw", "startup", "uncertain", "poor_quality", "acquisition_missing", "evaluable", _r("coverage_pct"), _r("good_window_fraction"),
        _r("median_score")
    )


def q33_recording_shift_quantiles(spark, sf):
    d = B.decisions(spark, sf).withColumn("grp", F.col("rec") % 5)
    out = R.shift_quantiles(d, ["grp"], "score", F.col("available"))
    return out.select("grp", *[_r(c) for c in out.columns if c != "grp"])


def _clocks(spark, sf):
    """Clock texts made of each event's time and value: one or two digits, either separator."""
    s = B.samples(spark, sf).withColumn("s", F.pmod(F.floor(F.col("x") / 1_000_000), F.lit(86_400)))
    part = lambda c, wide: F.when(wide, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
    text = lambda c, wide: F.concat(
        part(F.floor(c / 3600), wide), F.lit("."), part(F.floor(c / 60) % 60, wide), F.when(wide, ":").otherwise("."), part(c % 60, wide)
    )
    s = s.withColumn("z", F.pmod(F.col("s") + F.col("cents") * 7, F.lit(86_400)))
    return s.withColumns({"a": text(F.col("s"), F.col("cents") % 2 == 0), "b": text(F.col("z"), F.col("cents") % 3 == 0)})


def q34_clock_parse(spark, sf):
    c = _clocks(spark, sf).select("event_id", "a", C.clock_seconds(F.col("a")).alias("s"), C.clock_seconds(F.col("b")).alias("z"))
    return c.select(
        "event_id", "a", F.col("s").cast("bigint").alias("clock_s"), C.relative_seconds(F.col("s"), F.col("z")).cast("bigint").alias("relative_s"),
        C.signed_difference(F.col("s"), F.col("z")).cast("bigint").alias("signed_s"),
        C.lenient_relative(F.col("s"), F.col("z")).cast("bigint").alias("lenient_s")
    )


def q34b_clock_candidates(spark, sf):
    k = F.col("cents") % 5
    raw = F.when(
        k == 0, F.concat("a", F.lit(" (ELECTROGRAPHIC ONSET); "), "b", F.lit(" (clinical onset)"))
    ).when(k == 1, F.concat("a", F.lit(" opure "), "b")).when(k == 2, F.concat("a", F.lit(" (Electric Onset)"))).otherwise(F.concat(F.lit(" "), "a", F.lit(" ")))
    c = _clocks(spark, sf).select("event_id", raw.alias("raw")).withColumn("c", C.candidates(F.col("raw")))
    p = C.primary_candidate(F.col("c"))
    return c.select(
        "event_id", F.size("c").cast("bigint").alias("n"), p["raw_clock"].alias("primary_clock"), p["clock_s"].cast("bigint").alias("primary_s"),
        p["kind"].alias("primary_kind")
    )


def q35_forward_fill(spark, sf):
    order = W.partitionBy("rec").orderBy("x", "event_id").rowsBetween(W.unboundedPreceding, 0)
    s = B.samples(spark, sf).withColumn("clock", F.when(F.col("kind") == "purchase", F.col("cents")))
    return s.select(
        "rec", "event_id", "clock", F.last("clock", ignorenulls=True).over(order).alias("filled"), F.col("clock").isNull().alias("inherited")
    )


def q36_folds_loro(spark, sf):
    r = B.recordings(spark, sf).select((F.col("rec") % 5).alias("grp"), F.concat(F.lit("rec-"), F.col("rec").cast("string")).alias("item"))
    return T.leave_one_out(r, "grp", "item", "|").select("grp", F.col("fold").cast("bigint").alias("fold"), "train", "test")


def _training(spark, sf):
    ev = B.events(spark, sf).withColumn("number", F.lit(1).cast("bigint"))
    d = T.label(B.decisions(spark, sf), ev, B.uncertain(spark, sf), K, 6 * B.HOUR)
    # Merged: where only its times are read, a planner takes the exploded grid for as small as its recordings.
    wide = d.join(B.decisions2(spark, sf).select("rec", "t", F.col("score").alias("eeg__two")).hint("merge"), ["rec", "t"], "left")
    return wide.withColumn("grp", F.col("rec") % 5).withColumn("eeg__one", F.col("score")).drop("score")


def q37_nested_models(spark, sf):
    """Held-out logistic scores of five groups; the rows are stored, as each step reads them."""
    frame = stored(_training(spark, sf).select("rec", "grp", "t", "label", "available", "training_eligible", "eeg__one", "eeg__two"), "frame")
    out = N.HeldOutModels(frame, "grp", ["eeg__one", "eeg__two"]).nested(list(range(5)))
    return out.select("rec", "t", "fold", "label", "score")


def q38_negative_sample(spark, sf):
    d = _training(spark, sf).where("training_eligible AND available").withColumn("key", F.col("rec") * 10_000 + F.col("t") / B.HOUR)
    return N.negative_sample(d.withColumn("key", F.col("key").cast("bigint")), ["rec"], "key", 7, 3).select("rec", "t", "label")


def q39_anti_missing(spark, sf):
    days = B.recordings(spark, sf).select("rec", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(29).cast("bigint"))).alias("day"))
    seen = B.samples(spark, sf).select("rec", F.floor(F.col("x") / (24 * B.HOUR)).alias("day"))
    return P.missing(days, seen, ["rec", "day"])


def q39b_set_difference(spark, sf):
    of = lambda k: B.samples(spark, sf).where(F.col("kind") == k).select("rec", F.floor(F.col("x") / (24 * B.HOUR)).alias("day")).distinct()
    return P.same_set(of("click"), of("purchase"))


def _contribution(spark, sf):
    d, d2 = B.decisions(spark, sf), B.decisions2(spark, sf)
    ex = I.exposure(d, B.uncertain(spark, sf), None, K, B.STRIDE, F.col("duration"))
    q = I.cells(d2.where("available"), K, B.STRIDE, F.col("duration"))
    alpha = F.when(F.col("rec") % 3 == 0, 0.0).otherwise(0.25)
    return R.contribution(ex, q, K).withColumns({"grp": F.col("rec") % 5, "alpha": alpha}).withColumn(
        "active", F.when(F.col("alpha") > 0, F.col("q1")).otherwise(0)
    )


def q40_contribution_rollup(spark, sf):
    return _contribution(spark, sf).groupBy("grp", "alpha").agg(
        F.count("*").alias("folds"), *[F.sum(c).alias(c) for c in ("evaluable", "q1", "q0", "active")]
    ).withColumn("q1_fraction", F.try_divide(F.col("q1").cast("double"), F.col("evaluable").cast("double")))


def _second_alarms(spark, sf):
    d = T.around(B.decisions2(spark, sf), {"barrier": B.uncertain(spark, sf)}, K).withColumn("threshold", F.lit(D.ALARM_AT))
    return A.alarm_stream(d, K, B.STRIDE)


def q41_detection_groups(spark, sf):
    """Responses to events beside the detection of the same events by either modality."""
    ev = B.events(spark, sf)
    out = R.complementarity(
        _responses(spark, sf), *[M.event_matches(a, ev, K) for a in (D._alarms(spark, sf), _second_alarms(spark, sf))], ["rec", "event_id"]
    )
    return out.select(
        "rec", "event_id", "analyzable", _r("median_change"), "eeg_detected", "eeg_delay", "ecg_detected", "ecg_delay", "detection_group"
    )


def q42_early_fusion(spark, sf):
    one = B.decisions(spark, sf).select("rec", "t", F.col("score").alias("score1"))
    two = B.decisions2(spark, sf).select("rec", "t", F.col("available").alias("available2"), F.col("score").alias("rate"))
    return U.early(U.align(one, two, ["rec", "t"]), ["rate"]).select("rec", "t", "score1", "early__rate")


def q43_negative_controls(spark, sf):
    one = B.ready(spark, sf).withColumnRenamed("score", "score1")
    two = B.decisions2(spark, sf).select("rec", "t", F.col("available").alias("available2"), F.col("score").alias("score2"))
    return V.negative_controls(U.align(one, two, ["rec", "t"]), K, B.STRIDE, 0.25, 0.45, 0.5)


def q44_onset_state(spark, sf):
    out = V.state_at(B.events(spark, sf).select("rec", "event_id", "start"), B.decisions2(spark, sf), K, "start", B.STRIDE, "available")
    return out.select("rec", "event_id", F.col("available_at").alias("available_at_onset"))


def q45_reconcile_scores(spark, sf):
    one = B.decisions(spark, sf).where("available").select("rec", "t", "score")
    two = B.decisions2(spark, sf).where("available").select("rec", "t", "score")
    return V.reconcile(one, two, ["rec", "t"], "score", 0.25).groupBy("rec").agg(F.count("*").alias("n"))


def q46_table_differences(spark, sf):
    of = lambda k: B.samples(spark, sf).where(F.col("kind") == k).select("rec", F.floor(F.col("x") / (24 * B.HOUR)).alias("day"))
    return V.differences(of("click"), of("purchase"))


def q47_interval_reference(spark, sf):
    """Days as windows: the valid intervals of the five days before, taken together."""
    rr = Y.rr_series(B.samples(spark, sf).select("rec", "x").distinct(), K, 0.5 * B.HOUR, 24.0 * B.HOUR, 1.0)
    rr = rr.where("valid").select("rec", F.floor(F.col("x") / (24 * B.HOUR)).alias("t"), "rr")
    w = rr.groupBy("rec", "t").agg(
        F.collect_list("rr").alias("intervals"), F.median("rr").alias("median_rr"), F.median(60.0 / F.col("rr")).alias("median_rate")
    )
    out = Y.interval_reference(w.withColumn("usable", F.lit(True)), K, 1, 5, 2)
    hourly = lambda c: F.round(F.col(c) * B.HOUR, 8).alias(c)
    return out.select(
        "rec", "t", F.col("baseline_good").cast("bigint").alias("baseline_good"), "baseline_ready", "baseline_rr", "relative_rr_delta",
        hourly("baseline_rate"), hourly("relative_rate_delta"), _r("relative_rate_ratio")
    )


def _prices(spark, sf):
    s = B.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_extendedprice"))).alias("s")
    )
    return s.select("l_suppkey", F.transform("s", lambda x: x["l_extendedprice"]).alias("samples"))


def q48_lead_arbitration(spark, sf):
    """Suppliers in twos as the leads of a window."""
    d = _prices(spark, sf).select(F.floor(F.col("l_suppkey") / 2).alias("window"), (F.col("l_suppkey") % 2).cast("int").alias("lead"), "samples")
    return L.arbitrate(L.quality_gates(L.measure_leads(d, "samples", 64.0)), ["window"], 64.0)


def q49_older_lead_features(spark, sf):
    return L.reduce_leads(
        L.older_features(_prices(spark, sf), "samples", 64.0).withColumn("grp", F.col("l_suppkey") % 5), ["grp"], ["n_r_peaks", "mean_rr_s", "rmssd_s"]
    )


def _pieces(samples, size):
    """part and samples: successive windows of ``size``; if that leaves a rest, also the last
    ``size`` samples, as part -1, so that all samples count and all windows are as long."""
    full = F.floor(F.size(samples) / size).cast("int")
    parts = F.filter(F.sequence(F.lit(-1), full - 1), lambda k: (k >= 0) | (F.size(samples) % size > 0))
    start = lambda k: F.when(k >= 0, k * size).otherwise(F.greatest(F.lit(0), F.size(samples) - size))
    return F.transform(parts, lambda k: F.struct(k.cast("bigint").alias("part"), F.slice(samples, start(k) + 1, size).alias("samples")))


def q50_window_features(spark, sf):
    """Suppliers in fours as the channels; by part, windows are aligned at the start of the series, and those of part -1 at its end."""
    d = _prices(spark, sf).select(
        F.floor(F.col("l_suppkey") / 4).alias("window"), (F.col("l_suppkey") % 4).alias("channel"), F.inline(_pieces("samples", 512))
    )
    return X.window_features(d, ["window", "part"], "channel", "samples", 128.0)


def q51_inventory(spark, sf):
    r = B.recordings(spark, sf).select((F.col("duration") / 1_000_000).alias("duration_s"), (F.col("rec") % 3 != 0).alias("eligible"))
    e = B.events(spark, sf).select((F.col("rec") % 3 != 0).alias("eligible"), (F.col("end") - F.col("start") > 6 * B.HOUR).alias("uncertain"))
    return V.inventory(r, e)


def _relative(spark, sf):
    d = B.decisions2(spark, sf).select("rec", "t", F.col("available").alias("usable"), F.round(F.col("score") * 40_000).alias("score"))
    return Y.relative_reference(d, K, 24 * B.HOUR, 120 * B.HOUR, 3, "score")


def q60_false_alarm_state(spark, sf):
    """The second modality at the first one's false alarms, and its false alarms beside them."""
    wrong = [M.match_alarms(a, B.events(spark, sf), K)[0].where("status <> 'matched'") for a in (D._alarms(spark, sf), _second_alarms(spark, sf))]
    states = _relative(spark, sf).select("rec", "t", "usable", F.col("reference_ready").alias("ready"), F.col("relative_delta").alias("delta"))
    return R.false_alarm_state(*wrong[:1], states, wrong[1], K, B.STRIDE, 2000.0)


def q61_patient_summary(spark, sf):
    grouped = lambda d: d.withColumn("grp", F.col("rec") % 5)
    cover = R.coverage(B.recordings(spark, sf), B.decisions2(spark, sf), B.uncertain(spark, sf), K, B.LONG, B.STRIDE)
    out = R.patient_summary(grouped(_responses(spark, sf)), grouped(cover), ["grp"])
    return out.select(
        "grp", "events", "analyzable_events", "increase_events", *map(_r, ["baseline_median", "median_change", "increase_fraction", "coverage_pct"]),
        "raw", "startup", "uncertain", "poor_quality", "evaluable"
    )


def q62_sanity_sample(spark, sf):
    d = B.decisions2(spark, sf).withColumn("grp", F.col("rec") % 5)
    return R.sanity_sample(d, "grp", "rec", B.LONG).select("grp", "rec", "t", "available", "score")


def _fusion_frame(spark, sf):
    two = B.decisions2(spark, sf).select("rec", "t", F.col("available").alias("available2"), F.col("score").alias("ecg__two"))
    return _training(spark, sf).select("rec", "grp", "t", "label", "available", "training_eligible", "eeg__one").join(two.hint("merge"), ["rec", "t"])


def q63_inner_scores(spark, sf):
    """Scores of three models for the choice of thresholds, for every group that is held out in turn."""
    frame = stored(_fusion_frame(spark, sf), "frame")
    return N.FusionModels(frame, "grp", ["eeg__one"], ["ecg__two"], ["rec", "t"], kind="logistic").inner(list(range(5)))


def q64_forest_scores(spark, sf):
    """Scores of each group by a forest over the others."""
    frame = stored(_fusion_frame(spark, sf), "frame")
    return N.HeldOutModels(frame, "grp", ["eeg__one", "ecg__two"], "forest").nested(list(range(5))).select("rec", "t", "fold", "label", "score")


def q81_older_benchmark(spark, sf):
    """The older benchmark's tables over all labelled decisions, every group held out in turn, with logistic models in
    place of the forests."""
    rows = _fusion_frame(spark, sf).where("training_eligible").select("rec", "grp", "t", "label", "eeg__one", "ecg__two")
    scored = BM.predictions(stored(rows, "frame"), "grp", ["eeg__one"], ["ecg__two"], ["rec", "t"], list(range(5)), "logistic")
    return BM.summary(stored(scored, "scores"), "grp")


def q65_anchor_rows(spark, sf):
    """Suppliers in fours as the channels, and the first two of them as the leads, of an anchor; whole series cut to the shortest of each anchor."""
    d = _prices(spark, sf).withColumns({"anchor": F.floor(F.col("l_suppkey") / 4), "channel": (F.col("l_suppkey") % 4).cast("int")})
    d = d.withColumn("n", F.min(F.size("samples")).over(W.partitionBy("anchor"))).withColumn("samples", F.expr("slice(samples, 1, n)")).drop("n")
    return X.anchor_rows(d, d.where("channel < 2"), ["anchor"], "channel", "samples", 128.0, 128.0)


def q66_distinct_values(spark, sf):
    s = B.samples(spark, sf).select((F.col("rec") % 5).alias("grp"), "kind", F.floor(F.col("x") / (24 * B.HOUR)).alias("day"))
    out = R.distinct_values(s, ["grp"], ["kind", "day"])
    return out.select(
        "grp", F.array_join("kind", "|").alias("kinds"), F.array_join(F.transform("day", lambda d: d.cast("string")), "|").alias("days")
    )


def q52_annotation_flags(spark, sf):
    """Listed events made of the samples, with all that can be odd about them."""
    c = F.col("cents")
    odd = lambda n, x: F.when(c % n != 0, x)
    start = odd(7, c % 900 - 20)
    d = B.samples(spark, sf).withColumn("h", (F.col("rec") * 7919) % 86_400).select(
        "event_id", F.col("h").alias("header_start_s"), F.when(F.col("kind") != "error", F.lit(600)).alias("duration_s"), ((F.col("h") + F.when(c % 5 == 0, 20).otherwise(3)) % 86_400).alias("registration_start_s"),
        odd(7, c).alias("start_clock_s"), odd(11, c).alias("end_clock_s"), start.alias("start_s"), odd(11, start + c % 40 - 5).alias("end_s"))
    return V.annotation_flags(d).select("event_id", "flags")


_P = B.prelude()
_RR = f"""rr AS (SELECT rec, x, (x - lag(x) OVER w) / {float(B.HOUR)} AS rr, (x + lag(x) OVER w) / 2 / {float(B.HOUR)} AS mid FROM (SELECT DISTINCT rec, x
  FROM ev) WINDOW w AS (PARTITION BY rec ORDER BY x)),
rv AS (SELECT *, rr BETWEEN 0.5 AND 24.0 AS valid, 60.0 / nullif(rr, 0) AS rate FROM rr WHERE rr IS NOT NULL)"""
_MED = "median(CASE WHEN {} THEN score END)"
_RES = f"""rs AS (SELECT r.rec, r.event_id, r.a, r.b, w.t, w.score FROM refs r LEFT
  JOIN dec2 w ON w.rec = r.rec AND w.available AND w.t >= r.a - {60 * B.HOUR} AND w.t < r.b + {12 * B.HOUR}),
re0 AS (SELECT rec, event_id, {_MED.format(f't >= a - {60 * B.HOUR} AND t <= a - {12 * B.HOUR}')} AS bm,
  {_MED.format(f't >= a - {4 * B.HOUR} AND t <= a')} AS preictal_median, {_MED.format('t >= a AND t < b')} AS ictal_median,
  {_MED.format(f't >= b AND t < b + {12 * B.HOUR}')} AS postictal_median,
  max(CASE WHEN t >= a AND t < b THEN score END) AS ictal_max, count(*) FILTER (WHERE t >= a - {60 * B.HOUR} AND t <= a - {12 * B.HOUR}) AS n_baseline,
  count(*) FILTER (WHERE t >= a AND t < b) AS n_ictal FROM rs GROUP BY rec, event_id),
re AS (SELECT *, CASE WHEN n_baseline >= 3 THEN bm END AS baseline_median, n_baseline >= 3 AS baseline_ready, n_baseline >= 3 AND n_ictal > 0 AS analyzable,
  ictal_median - (CASE WHEN n_baseline >= 3 THEN bm END) AS median_change, ictal_max - (CASE WHEN n_baseline >= 3 THEN bm END) AS max_change,
  ictal_median / nullif(CASE WHEN n_baseline >= 3 THEN bm END, 0) - 1 AS relative_change FROM re0)"""
_EMB = """em AS (SELECT vec_id, vec_id // 8 AS montage, CAST(embedding AS DOUBLE[]) AS a FROM embeddings),
e1 AS (SELECT *, list_transform(range(2, len(a) + 1), lambda i: a[i] - a[i - 1]) AS d FROM em),
e2 AS (SELECT *, list_transform(range(2, len(d) + 1), lambda i: d[i] - d[i - 1]) AS dd FROM e1),
tf AS (SELECT vec_id, montage, a, sqrt(list_avg(list_transform(a, lambda x: (x - list_avg(a)) * (x - list_avg(a))))) AS rms, list_stddev_pop(a) AS std,
  list_avg(list_transform(d, lambda x: abs(x))) AS line_length, list_var_pop(a) AS hjorth_activity, coalesce(sqrt(list_var_pop(d) / nullif(list_var_pop(a), 0)),
  0) AS hjorth_mobility,
  coalesce(sqrt(list_var_pop(dd) / nullif(list_var_pop(d), 0)) / nullif(sqrt(list_var_pop(d) / nullif(list_var_pop(a), 0)), 0), 0) AS hjorth_complexity
  FROM e2)"""
_TR = f"""lb AS (SELECT g.rec, g.t, d.available, d.score, EXISTS (SELECT 1 FROM unc u WHERE u.rec = g.rec AND u.a <= g.t AND g.t < u.b) AS un, EXISTS (SELECT 1
  FROM refs r WHERE r.rec = g.rec AND r.a <= g.t AND g.t < r.b) AS hit,
  EXISTS (SELECT 1 FROM refs r WHERE r.rec = g.rec AND r.a - {6 * B.HOUR} <= g.t AND g.t < r.b + {6 * B.HOUR}) AS near FROM grid g JOIN dec1 d USING (rec, t)),
tr AS (SELECT *, CASE WHEN hit THEN 1 ELSE 0 END AS label FROM lb WHERE NOT un AND (hit OR NOT near) AND available)"""
_DAY = 24 * B.HOUR
_TWO = f"a1_ AS (SELECT * FROM {B.alarms_sql(f'(SELECT *, {D.ALARM_AT} AS thr FROM dec1)')}), j1 AS (SELECT * FROM {B.judged_sql('a1_')}), a2_ AS (SELECT * FROM {B.alarms_sql(f'(SELECT *, {D.ALARM_AT} AS thr FROM dec2)')}), j2 AS (SELECT * FROM {B.judged_sql('a2_')})"
_REL = f"""p AS (SELECT d.rec, d.t, any_value(d.available) AS usable, any_value(round(d.score * 40000)) AS score, CAST(count(q.score) AS INT) AS n_past,
  median(round(q.score * 40000)) AS med FROM dec2 d LEFT
  JOIN dec2 q ON q.rec = d.rec AND q.available AND q.t <= d.t - {24 * B.HOUR} AND q.t >= d.t - {120 * B.HOUR} AND (d.t - q.t) % {24 * B.HOUR} = 0
  GROUP BY d.rec, d.t),
z AS (SELECT *, n_past >= 3 AS reference_ready, CASE WHEN n_past >= 3 THEN med END AS reference FROM p)"""
_text = lambda c, wide: f"CASE WHEN {wide} THEN format('{{:02d}}.{{:02d}}:{{:02d}}', {c} // 3600, {c} // 60 % 60, {c} % 60) ELSE format('{{}}.{{}}.{{}}', {c} // 3600, {c} // 60 % 60, {c} % 60) END"
_CLOCKS = f"""c0 AS (SELECT event_id, cents, x // 1000000 % 86400 AS s, (x // 1000000 % 86400 + cents * 7) % 86400 AS z FROM ev), ck AS (SELECT *, {_text('s', 'cents % 2 = 0')} AS a, {_text('z', 'cents % 3 = 0')} AS b FROM c0)"""
_rs = lambda cols: ", ".join(f"round({c}, 8) AS {c}" for c in cols)

ORACLE = {
    "q23_rr_series": f"{_P}, {_RR} SELECT rec, x, valid, rr, rate, mid FROM rv",
    "q24_rhythm_features": f"""{_P}, {_RR}, st AS (SELECT *, CASE WHEN valid AND lag(valid) OVER w THEN rr - lag(rr) OVER w END AS step
  FROM rv WINDOW w AS (PARTITION BY rec ORDER BY x)),
f AS (SELECT rec, count(*) AS n_valid, median(rate) AS median_hr, avg(rate) AS mean_hr, median(rr) AS median_rr, avg(rr) AS mean_rr, stddev_samp(rr) AS sdrr_s,
  sqrt(avg(step * step)) AS rmssd_s, regr_slope(rate, mid) * 60 AS hr_slope_bpm_min,
  median(rate) FILTER (WHERE mid >= {B.DURATION / 2 / B.HOUR}) - median(rate) FILTER (WHERE mid < {B.DURATION / 2 / B.HOUR}) AS early_late_hr,
  stddev_samp(rr) / avg(rr) AS rr_cv FROM st WHERE valid GROUP BY rec)
SELECT rec, n_valid, {_rs(RHYTHM)} FROM f""",
    "q25_relative_reference": f"""{_P}, p AS (SELECT d.rec, d.t, any_value(d.available) AS usable, any_value(round(d.score * 40000)) AS score,
  CAST(count(q.score) AS INT) AS n_past, median(round(q.score * 40000)) AS med FROM dec2 d LEFT
  JOIN dec2 q ON q.rec = d.rec AND q.available AND q.t <= d.t - {_DAY} AND q.t >= d.t - {5 * _DAY} AND (d.t - q.t) % {_DAY} = 0 GROUP BY d.rec, d.t),
z AS (SELECT *, n_past >= 3 AS reference_ready, CASE WHEN n_past >= 3 THEN med END AS reference FROM p)
SELECT rec, t, n_past, reference_ready, reference, CASE WHEN usable THEN score END - reference AS relative_delta,
  CASE WHEN usable THEN score END / nullif(reference, 0) AS relative_ratio FROM z""",
    "q26_lead_choice": f"""{_P}, s AS (SELECT *, CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END AS lead_, x - lag(x) OVER (PARTITION BY rec, kind
  ORDER BY x, event_id) AS gap FROM ev WHERE kind IN ('click', 'purchase')),
a AS (SELECT rec, lead_, count(*) AS n, count(*) FILTER (WHERE gap BETWEEN {B.HOUR} AND {100 * B.HOUR}) / count(*)::DOUBLE AS vf,
  count(DISTINCT x // {_DAY}) / 30.0::DOUBLE AS cov, max(cents) AS con FROM s GROUP BY rec, lead_),
g AS (SELECT rec, count(*) FILTER (WHERE n >= 12) AS n_good, max(n) AS hi, min(n) AS lo, max(lead_) FILTER (WHERE n >= 12) AS only_ FROM a GROUP BY rec),
b AS (SELECT rec, lead_ AS best FROM a WHERE n >= 12 QUALIFY row_number() OVER (PARTITION BY rec ORDER BY vf DESC, cov DESC, con DESC, lead_) = 1),
z AS (SELECT *, CASE WHEN n_good = 0 THEN 'both_poor' WHEN n_good = 1 THEN 'only_lead_' || (only_ + 1) || '_good' WHEN hi - lo > greatest(10.0,
  0.15 * lo) OR lo / hi::DOUBLE < 0.5 THEN 'gross_interlead_disagreement' ELSE 'both_good_agree_lexicographic_quality' END AS reason FROM g LEFT
  JOIN b USING (rec))
SELECT rec, n_good, CASE WHEN n_good = 1 THEN only_ WHEN reason = 'both_good_agree_lexicographic_quality' THEN best END AS lead, reason FROM z""",
    "q27_channel_time_features": f"WITH {_EMB} SELECT vec_id, {_rs(NAMES)} FROM tf",
    "q28_cross_channel_reduce": f"WITH {_EMB} SELECT montage, {', '.join(f'round(avg({c}), 8) AS {c}_mean, round(stddev_pop({c}), 8) AS {c}_std_across_channels' for c in NAMES)} FROM tf GROUP BY montage",
    "q29_channel_correlation": f"""WITH {_EMB}, u AS (SELECT montage, vec_id, unnest(a) AS v, unnest(range(len(a))) AS i
  FROM em), k AS (SELECT montage, count(DISTINCT vec_id) AS n_channels FROM em WHERE list_var_pop(a) > 0 GROUP BY montage),
c AS (SELECT p.montage, p.vec_id AS x, q.vec_id AS y, abs(corr(p.v, q.v)) AS r FROM u p JOIN u q ON p.montage = q.montage AND p.i = q.i AND p.vec_id < q.vec_id
  GROUP BY ALL)
SELECT k.montage, n_channels, round(avg(r), 8) AS mean_abs_channel_corr, round(stddev_pop(r), 8) AS std_abs_channel_corr FROM k LEFT
  JOIN c ON c.montage = k.montage GROUP BY k.montage, n_channels""",
    "q31_response_windows": f"{_P}, {_RES} SELECT rec, event_id, n_baseline, n_ictal, baseline_ready, analyzable, {_rs(['baseline_median', 'preictal_median', 'ictal_median', 'postictal_median', 'ictal_max', 'median_change', 'max_change', 'relative_change'])} FROM re",
    "q31b_response_summary": f"""{_P}, {_RES}, s AS (SELECT rec, count(*) AS events, count(*) FILTER (WHERE analyzable) AS analyzable_events,
  count(*) FILTER (WHERE analyzable AND median_change > 0) AS increase_events, median(baseline_median) FILTER (WHERE analyzable) AS baseline_median,
  min(median_change) FILTER (WHERE analyzable) AS min_change, median(median_change) FILTER (WHERE analyzable) AS median_change,
  max(median_change) FILTER (WHERE analyzable) AS max_change FROM re GROUP BY rec)
SELECT rec, events, analyzable_events, increase_events, {_rs(['baseline_median', 'min_change', 'median_change', 'max_change'])},
  round(increase_events::DOUBLE / nullif(analyzable_events, 0), 8) AS increase_fraction FROM s""",
    "q32_coverage": f"""{_P}, c2 AS (SELECT rec, t AS a, least(t + {B.STRIDE}, {B.DURATION}) AS b FROM dec2
  WHERE available), c3 AS (SELECT rec, t AS a, least(t + {B.STRIDE}, {B.DURATION}) AS b FROM dec2
  WHERE NOT available AND t >= {B.LONG}), bg AS (SELECT rec, 0 AS a, {B.LONG} AS b FROM recs),
x AS (SELECT rec, sum(b - a)::BIGINT AS evaluable FROM {B.sweep_sql(B.union_sql('c2'), 'unc', B.MINUS)}
  GROUP BY rec), y AS (SELECT rec, sum(b - a)::BIGINT AS poor_quality FROM {B.sweep_sql(B.union_sql('c3'), 'unc', B.MINUS)} GROUP BY rec),
s AS (SELECT rec, sum(b - a)::BIGINT AS startup FROM {B.sweep_sql('bg', 'unc', B.MINUS)}
  GROUP BY rec), n AS (SELECT rec, avg(CASE WHEN t >= {B.LONG} THEN available::INT::DOUBLE END) AS gw, median(score) AS ms FROM dec2 GROUP BY rec)
SELECT rec, raw, coalesce(s.startup, 0) AS startup, uncertain, coalesce(poor_quality, 0) AS poor_quality, greatest(0, raw - coalesce(s.startup,
  0) - uncertain - coalesce(poor_quality, 0) - coalesce(x.evaluable, 0)) AS acquisition_missing, coalesce(x.evaluable, 0) AS evaluable,
  round(100.0 * coalesce(x.evaluable, 0)::DOUBLE / raw, 8) AS coverage_pct, round(gw, 8) AS good_window_fraction, round(ms, 8) AS median_score
FROM (SELECT rec, raw, uncertain FROM budget) LEFT JOIN x USING (rec) LEFT JOIN y USING (rec) LEFT JOIN s USING (rec) LEFT JOIN n USING (rec)""",
    "q33_recording_shift_quantiles": f"{_P} SELECT rec % 5 AS grp, {', '.join(f'round(quantile_cont(score, {q}), 8) AS q{round(q * 100):02d}' for q in (0.25, 0.5, 0.75, 0.95, 0.99))} FROM dec1 WHERE available GROUP BY 1",
    "q34_clock_parse": f"{_P}, {_CLOCKS} SELECT event_id, a, s AS clock_s, (s - z + 86400) % 86400 AS relative_s, CASE WHEN s - z >= 43200 THEN s - z - 86400 WHEN s - z < -43200 THEN s - z + 86400 ELSE s - z END AS signed_s, CASE WHEN s - z < -43200 THEN s - z + 86400 ELSE s - z END AS lenient_s FROM ck",
    "q34b_clock_candidates": f"{_P}, {_CLOCKS} SELECT event_id, CASE WHEN cents % 5 < 2 THEN 2 ELSE 1 END::BIGINT AS n, CASE WHEN cents % 5 = 0 THEN b ELSE a END AS primary_clock, CASE WHEN cents % 5 = 0 THEN z ELSE s END AS primary_s, CASE cents % 5 WHEN 0 THEN 'clinical' WHEN 2 THEN 'electrographic' ELSE 'unspecified' END AS primary_kind FROM ck",
    "q35_forward_fill": f"{_P}, c AS (SELECT *, CASE WHEN kind = 'purchase' THEN cents END AS clock FROM ev) SELECT rec, event_id, clock, last_value(clock IGNORE NULLS) OVER (PARTITION BY rec ORDER BY x, event_id ROWS UNBOUNDED PRECEDING) AS filled, clock IS NULL AS inherited FROM c",
    "q36_folds_loro": f"""{_P}, i AS (SELECT rec % 5 AS grp, 'rec-' || rec AS item FROM recs), n AS (SELECT grp, item, row_number() OVER (PARTITION BY grp
  ORDER BY item) - 1 AS fold FROM i)
SELECT n.grp, n.fold, (SELECT string_agg(o.item, '|' ORDER BY o.item) FROM i o WHERE o.grp = n.grp AND o.item <> n.item) AS train, n.item AS test FROM n""",
    "q38_negative_sample": f"""{_P}, {_TR}, k AS (SELECT *, rec * 10000 + t // {B.HOUR} AS key FROM tr), r AS (SELECT *, count(*) FILTER (WHERE label = 1) OVER (PARTITION BY rec) AS p, row_number() OVER (PARTITION BY rec, label ORDER BY md5('7:' || key), key) AS d FROM k) SELECT rec, t, label FROM r WHERE label = 1 OR d <= 3 * p""",
    "q39_anti_missing": f"{_P} SELECT rec, day FROM (SELECT rec, unnest(range(30)) AS day FROM recs) EXCEPT SELECT rec, x // {_DAY} FROM ev",
    "q39b_set_difference": f"""{_P}, c AS (SELECT DISTINCT rec, x // {_DAY} AS day FROM ev WHERE kind = 'click'), p AS (SELECT DISTINCT rec, x // {_DAY} AS day
  FROM ev WHERE kind = 'purchase')
SELECT *, 'left' AS side FROM (FROM c EXCEPT FROM p) UNION ALL SELECT *, 'right' FROM (FROM p EXCEPT FROM c)""",
    "q40_contribution_rollup": f"""{_P}, c2 AS (SELECT rec, t AS a, least(t + {B.STRIDE}, {B.DURATION}) AS b FROM dec2
  WHERE available), q AS (SELECT rec, sum(b - a)::BIGINT AS q1 FROM {B.sweep_sql('expo', B.union_sql('c2'), B.BOTH)} GROUP BY rec),
z AS (SELECT rec % 5 AS grp, CASE WHEN rec % 3 = 0 THEN 0.0 ELSE 0.25 END::DOUBLE AS alpha, evaluable, coalesce(q1, 0) AS q1 FROM budget LEFT JOIN q USING (rec)
  WHERE evaluable > 0)
SELECT grp, alpha, count(*) AS folds, sum(evaluable)::BIGINT AS evaluable, sum(q1)::BIGINT AS q1, sum(evaluable - q1)::BIGINT AS q0,
  sum(CASE WHEN alpha > 0 THEN q1 ELSE 0 END)::BIGINT AS active, sum(q1)::BIGINT::DOUBLE / sum(evaluable)::BIGINT AS q1_fraction FROM z GROUP BY grp, alpha""",
    "q41_detection_groups": f"""{_P}, {_RES}, {_TWO}, e1 AS (SELECT rec, event_id, decl - onset AS d FROM j1
  WHERE status = 'matched'), e2 AS (SELECT rec, event_id, decl - onset AS d FROM j2 WHERE status = 'matched')
SELECT re.rec, re.event_id, analyzable, round(median_change, 8) AS median_change, e1.d IS NOT NULL AS eeg_detected, e1.d AS eeg_delay,
  e2.d IS NOT NULL AS ecg_detected, e2.d AS ecg_delay,
  CASE WHEN e1.d IS NOT NULL AND e2.d IS NOT NULL THEN 'both' WHEN e1.d IS NOT NULL THEN 'eeg_only' WHEN e2.d IS NOT NULL THEN 'ecg_only' ELSE 'neither' END AS detection_group
FROM re LEFT JOIN e1 ON e1.rec = re.rec AND e1.event_id = re.event_id LEFT JOIN e2 ON e2.rec = re.rec AND e2.event_id = re.event_id""",
    "q60_false_alarm_state": f"""{_P}, {_TWO}, {_REL}, w AS (SELECT rec, decl FROM j1 WHERE status <> 'matched'),
s AS (SELECT w.rec, w.decl, z.usable, z.reference_ready AS ready, CASE WHEN z.usable THEN z.score END - z.reference AS delta FROM w LEFT
  JOIN z ON z.rec = w.rec AND z.t <= w.decl AND z.t >= w.decl - {B.STRIDE} QUALIFY row_number() OVER (PARTITION BY w.rec, w.decl
  ORDER BY z.t DESC NULLS LAST) = 1)
SELECT rec, decl AS declaration, CASE WHEN NOT coalesce(usable,
  false) THEN 'unavailable' WHEN NOT ready THEN 'baseline_not_ready' WHEN abs(delta) <= 2000 THEN 'within_10bpm_recent_baseline' ELSE 'larger_hr_deviation' END AS ecg_state, CASE WHEN usable AND ready THEN delta END AS hr_delta,
  EXISTS (SELECT 1 FROM j2 WHERE j2.rec = s.rec AND j2.status <> 'matched' AND abs(j2.decl - s.decl) <= {B.STRIDE}) AS other_false_within_stride FROM s""",
    "q62_sanity_sample": f"{_P} SELECT rec % 5 AS grp, rec, t, available, score FROM dec2 WHERE t = {B.LONG} AND rec IN (SELECT min(rec) FROM recs GROUP BY rec % 5)",
    "q66_distinct_values": f"{_P} SELECT rec % 5 AS grp, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds, array_to_string(list_sort(list_distinct(list(x // {_DAY}))), '|') AS days FROM ev GROUP BY 1",
    "q43_negative_controls": f"""{_P}, k AS (FROM (VALUES ('base', 0.0, true, 0.5), ('NC1_alpha_zero', 0.0, false, 0.45), ('NC2_entire_outage', 0.25, true,
  0.45), ('NC2_max_alpha_outage', 0.5, true, 0.45)) v(control, al, out_, th)),
f AS (SELECT d.rec, d.t, d.available, control, d.score AS score1, al <> 0 AND NOT out_ AND e.available AND e.score IS NOT NULL AS active,
  CASE WHEN active THEN (1 - al) * d.score + al * e.score ELSE d.score END AS score, CASE WHEN active THEN th ELSE 0.5 END AS thr FROM dec1 d
  JOIN dec2 e USING (rec, t), k),
x AS (SELECT * FROM {B.alarms_sql('f', 'rec, control')}), n AS (SELECT control, count(*) AS decisions, count(*) FILTER (WHERE score IS DISTINCT
  FROM score1 OR thr <> 0.5) AS differing FROM f WHERE control <> 'base' GROUP BY 1),
y AS (SELECT control, count(*) AS alarms FROM x GROUP BY 1),
z AS (SELECT k.control, (SELECT count(*) FROM ((SELECT rec, decl, fin, reason FROM x WHERE x.control = k.control EXCEPT SELECT rec, decl, fin, reason FROM x
  WHERE x.control = 'base') UNION ALL (SELECT rec, decl, fin, reason FROM x WHERE x.control = 'base' EXCEPT SELECT rec, decl, fin, reason FROM x
  WHERE x.control = k.control))) AS differing_alarms FROM k WHERE k.control <> 'base')
SELECT n.control, decisions, differing, coalesce(alarms, 0) AS alarms, differing_alarms, differing = 0 AND differing_alarms = 0 AS passed FROM n LEFT
  JOIN y USING (control) JOIN z USING (control)""",
    "q44_onset_state": f"{_P} SELECT r.rec, r.event_id, d.available AS available_at_onset FROM refs r LEFT JOIN dec2 d ON d.rec = r.rec AND d.t <= r.a AND r.a < d.t + {B.STRIDE}",
    "q45_reconcile_scores": f"{_P} SELECT coalesce(a.rec, b.rec) AS rec, count(*) AS n FROM (FROM dec1 WHERE available) a FULL JOIN (FROM dec2 WHERE available) b ON a.rec = b.rec AND a.t = b.t WHERE a.rec IS NULL OR b.rec IS NULL OR abs(a.score - b.score) > 0.25 GROUP BY 1",
    "q46_table_differences": f"{_P} SELECT rec, x // {_DAY} AS day, CAST(sum(CASE kind WHEN 'click' THEN 1 ELSE -1 END) AS BIGINT) AS surplus FROM ev WHERE kind IN ('click', 'purchase') GROUP BY ALL HAVING surplus <> 0",
    "q47_interval_reference": f"""{_P}, r AS (SELECT rec, x // {_DAY} AS t, (x - lag(x) OVER (PARTITION BY rec ORDER BY x))::DOUBLE AS rr
  FROM (SELECT DISTINCT rec, x FROM ev)), v AS (SELECT * FROM r WHERE rr BETWEEN {B.HOUR} * 0.5 AND {B.HOUR} * 24.0),
n AS (SELECT rec, t, median(rr) AS mrr, median(60 / rr) AS mra FROM v GROUP BY ALL),
b AS (SELECT n.rec, n.t, count(DISTINCT v.t) AS baseline_good, median(60 / v.rr) AS bra, median(v.rr) AS brr FROM n LEFT
  JOIN v ON v.rec = n.rec AND v.t BETWEEN n.t - 5 AND n.t - 1 AND v.t >= 1 GROUP BY ALL),
z AS (SELECT rec, t, baseline_good, baseline_good >= 2 AS ready, CASE WHEN baseline_good >= 2 THEN bra END AS bra,
  CASE WHEN baseline_good >= 2 THEN brr END AS brr, mra, mrr FROM b JOIN n USING (rec, t))
SELECT rec, t, baseline_good, ready AS baseline_ready, brr AS baseline_rr, mrr - brr AS relative_rr_delta, round(bra * {B.HOUR}, 8) AS baseline_rate,
  round((mra - bra) * {B.HOUR}, 8) AS relative_rate_delta, round(mra / bra, 8) AS relative_rate_ratio FROM z""",
    "q51_inventory": f"""{_P} SELECT * FROM (SELECT count(*) AS recordings, count(*) FILTER (WHERE rec % 3 <> 0) AS eligible_recordings,
  sum({B.DURATION} / 1000000.0)::DOUBLE AS total_seconds, sum({B.DURATION} / 1000000.0) FILTER (WHERE rec % 3 <> 0)::DOUBLE AS eligible_seconds FROM recs),
(SELECT count(*) AS events, count(*) FILTER (WHERE rec % 3 <> 0) AS eligible_events, count(*) FILTER (WHERE rec % 3 = 0) AS quarantined_events,
  count(*) FILTER (WHERE b - a > {6 * B.HOUR}) AS uncertain_events FROM refs)""",
    "q52_annotation_flags": f"""{_P}, o AS (SELECT event_id, kind <> 'error' AS has, cents % 5 = 0 AS drifts,
  CASE WHEN cents % 7 <> 0 THEN cents % 900 - 20 END AS st, CASE WHEN cents % 7 <> 0 AND cents % 11 <> 0 THEN cents % 900 - 20 + cents % 40 - 5 END AS en,
  cents % 7 = 0 AS ns, cents % 11 = 0 AS ne FROM ev)
SELECT event_id, concat_ws(' | ', CASE WHEN NOT has THEN 'file_not_found' END,
  CASE WHEN has AND drifts THEN 'registration_start_text_disagrees_with_edf_header' END, CASE WHEN ns THEN 'seizure_start_unparsed' END,
  CASE WHEN ne THEN 'seizure_end_unparsed' END,
  CASE WHEN st < 0 THEN 'negative_seizure_start_offset' END, CASE WHEN en < st THEN 'seizure_end_before_start' END,
  CASE WHEN has AND st > 605 THEN 'seizure_start_after_edf_end' END, CASE WHEN has AND en > 605 THEN 'seizure_end_after_edf_end' END) AS flags FROM o""",
    "q42_early_fusion": f"{_P} SELECT d.rec, d.t, d.score AS score1, CASE WHEN e.available THEN e.score END AS early__rate FROM dec1 d JOIN dec2 e USING (rec, t)",
}
ORACLE["q61_patient_summary"] = f"""{_P}, {_RES}, s AS (SELECT rec % 5 AS grp, count(*) AS events, count(*) FILTER (WHERE analyzable) AS analyzable_events,
  count(*) FILTER (WHERE analyzable AND median_change > 0) AS increase_events, median(baseline_median) FILTER (WHERE analyzable) AS baseline_median,
  median(median_change) FILTER (WHERE analyzable) AS median_change FROM re GROUP BY 1),
c AS (SELECT rec % 5 AS grp, sum(raw)::BIGINT AS raw, sum(startup)::BIGINT AS startup, sum(uncertain)::BIGINT AS uncertain,
  sum(poor_quality)::BIGINT AS poor_quality, sum(evaluable)::BIGINT AS evaluable FROM ({ORACLE['q32_coverage']}) GROUP BY 1)
SELECT grp, events, analyzable_events, increase_events, {_rs(['baseline_median', 'median_change'])}, round(increase_events::DOUBLE / nullif(analyzable_events,
  0), 8) AS increase_fraction, round(100.0 * evaluable::DOUBLE / raw, 8) AS coverage_pct, raw, startup, uncertain, poor_quality, evaluable FROM s
  JOIN c USING (grp)"""
QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "q" and k[1:3].isdigit()}

"""Leads with known beats, windows cut from recordings, checks."""

import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from brontide.functions import dsp
from brontide.operators import channels as H
from brontide.operators import checks as V
from brontide.operators import leads as L
from brontide.operators import rhythm as Y
from brontide.operators import spectra as X
from brontide.operators import timeline as T

FS = 128.0


def pulses(at, seconds=60, noise=0.02, seed=0, height=100.0):
    t = np.arange(int(seconds * FS)) / FS
    rng = np.random.default_rng(seed)
    return height * sum(np.exp(-0.5 * ((t - a) / 0.015) ** 2) for a in at) + height * noise * rng.standard_normal(len(t))


def test_pairs_of_leads(spark):
    steady, slow = np.arange(0.7, 59.5, 0.8), np.arange(0.7, 59.5, 1.4)
    flat, broken = np.zeros(int(60 * FS)), pulses(steady)
    broken[5] = np.nan
    cases = {0: (pulses(steady), pulses(steady, noise=0.05, seed=1)), 1: (flat, pulses(steady)), 2: (flat, broken), 3: (pulses(steady), pulses(slow))}
    rows = [(w, lead, x.tolist(), -150.0, 150.0) for w, pair in cases.items() for lead, x in enumerate(pair)]
    d = spark.createDataFrame(rows, "w int, lead int, samples array<double>, low double, high double")
    q = L.quality_gates(L.measure_leads(d, "samples", FS, "low", "high")).cache()
    reason = {(r.w, r.lead): r.reason for r in q.collect()}
    assert reason[0, 0] == reason[1, 1] == reason[3, 1] == "good" and reason[2, 1] == "nonfinite"
    assert reason[1, 0] == "flat_or_low_variation|low_qrs_variation|few_beats|invalid_rr|rr_gaps|low_peak_contrast"
    assert abs(q.where("w = 0 AND lead = 0").first().median_rate - 75) < 1
    got = {r.w: (r.lead, r.reason) for r in L.arbitrate(q, ["w"], FS).collect()}
    assert got[1] == (1, "only_lead_2_good") and got[2] == (None, "both_poor") and got[3] == (None, "gross_interlead_disagreement")
    assert got[0][1] == "both_good_agree_lexicographic_quality" and got[0][0] in (0, 1)
    clipped = L.quality_gates(L.measure_leads(d.where("w = 0").withColumn("high", F.lit(50.0)), "samples", FS, "low", "high"))
    assert {r.reason for r in clipped.collect()} == {"saturation"}


def test_no_later_sample_matters():
    x = pulses(np.arange(0.7, 59.5, 0.8))
    y = x.copy()
    y[4000:] += 500
    assert np.array_equal(dsp.beat_band(x[:4000], FS), dsp.beat_band(y[:4000], FS))
    assert dsp.beat_agreement(np.array([]), np.array([]), 1) is None


def test_older_features_close_gaps(spark):
    rng = np.random.default_rng(3)
    lists = [[0, 128, 256, 900, 1028], [0, 128], [], None, np.cumsum(rng.integers(60, 300, 60)).tolist()]  # the gap of 644 samples goes
    d = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, p array<bigint>")
    f = {r.i: r for r in Y.with_older_rhythm(d, "p", FS).collect()}
    assert f[0].valid_rr_count == 3 and f[0].mean_hr_bpm == 60 and f[0].rmssd_s == 0 and f[0].pnn50 == 0 and f[0].sdnn_s < 1e-9
    assert (f[1].valid_rr_count, f[1].mean_hr_bpm, f[2].n_r_peaks, f[2].valid_rr_count, f[3].n_r_peaks, f[3].valid_rr_count) == (1, None, 0, 0, None, None)
    rr = np.diff(lists[4]) / FS
    rr = rr[(rr >= 0.3) & (rr <= 2)]
    mid, r = np.cumsum(rr) - rr / 2, f[4]
    want = [len(lists[4]), len(rr), (60 / rr).mean(), rr.mean(), rr.std(ddof=1), np.sqrt((np.diff(rr) ** 2).mean()), (np.abs(np.diff(rr)) > 0.05).mean()]
    want += [rr.std(ddof=1) / rr.mean(), 60 * np.polyfit(mid, 60 / rr, 1)[0]]
    assert np.allclose([r[n] for n in Y.OLDER], want, rtol=1e-10)
    x = pulses(np.arange(0.7, 59.5, 0.8))
    d = spark.createDataFrame([(0, x.tolist()), (1, [0.0] * 10), (2, None)], "w int, samples array<double>")
    got = {r.w: (r.mean_hr_bpm, r.n_r_peaks) for r in L.older_features(d, "samples", FS).collect()}
    assert abs(got[0][0] - 75) < 0.5 and got[1] == got[2] == (None, None)
    q = {r.w: (r.n_peaks, r.median_hr_bpm) for r in L.qrs_quality(d, "samples", FS).collect()}
    assert q[0][0] >= 70 and q[2] == (None, None)
    r = L.reduce_leads(spark.createDataFrame([(0, 1.0), (0, 4.0), (0, None), (1, None)], "w int, a double"), ["w"], ["a"])
    assert sorted(map(tuple, r.collect())) == [(0, 2.5, 3.0), (1, None, None)]


def test_prominence():
    x = np.array([0, 3, 1, 2, 1.5, 5, 0.0])
    assert dsp.prominences(x, np.array([1, 3, 5])).tolist() == [2.0, 0.5, 5.0]


def test_windows_are_those_of_the_whole_recording(spark):
    fs, total = 4.0, 1003
    x = np.arange(int(total * fs), dtype=float)
    chunk, halo = 300, 60
    rows = []
    for i in range(-(-total // chunk)):
        a, b = max(0, i * chunk - halo), min(total, (i + 1) * chunk)
        rows.append(("p", 0, float(a), fs, x[int(a * fs) : int(b * fs)].tolist()))
    d = spark.createDataFrame(rows, "path string, channel_index int, start_s double, sampling_rate double, samples array<double>")
    for context, first in ((10, 10), (60, 60), (60, 10)):
        got = {r.t: r.samples for r in T.cut_windows(d, context, 5, first, chunk, halo).collect()}
        assert sorted(got) == [t for t in range(first, total, 5) if t >= context]
        assert all(s == x[int((t - context) * fs) : int(t * fs)].tolist() for t, s in got.items())
    with pytest.raises(ValueError):
        T.cut_windows(d, 90, 5, 10, chunk, halo)


def test_window_features(spark):
    rng = np.random.default_rng(3)
    w = rng.standard_normal((3, 256))
    rows = [(0, c, w[c].tolist()) for c in range(3)] + [
        (1, 0, [1.0] * 256), (1, 1, [2.0] * 256), (2, 0, w[0].tolist()), (2, 1, [float("nan")] * 256), (3, 0, w[0].tolist()), (3, 1, [0.0] * 256)
    ]
    out = X.window_features(spark.createDataFrame(rows, "w int, c int, s array<double>"), ["w"], "c", "s", FS)
    assert len(out.columns) == 2 + 46
    got = {r.w: r for r in out.collect()}
    each = [dsp.channel_features(x, FS) for x in w]
    assert all(
        abs(got[0][f"{k}_mean"] - np.mean([e[k] for e in each])) < 1e-9 and abs(
            got[0][f"{k}_std_across_channels"] - np.std([e[k] for e in each])
        ) < 1e-9 for k in X.NAMES
    )
    assert abs(got[0].mean_abs_channel_corr - np.abs(np.corrcoef(w)[np.triu_indices(3, 1)]).mean()) < 1e-9
    assert got[1].unavailable_reason == got[2].unavailable_reason == "nonfinite_or_all_flat" and got[1].rms_mean is None and got[2].rms_mean is None
    assert got[3].unavailable_reason == "" and got[3].mean_abs_channel_corr is None and H.reduce_channels


def test_reference_needs_two_blocks(spark):
    rows = [(0, t, t != 180, [0.5, 1.0] if t < 200 else [2.0], 60.0, 1.0) for t in range(0, 361, 60)]
    d = spark.createDataFrame(rows, "rec int, t bigint, usable boolean, intervals array<double>, median_rate double, median_rr double")
    got = {r.t: (r.baseline_good, r.baseline_ready, r.baseline_rr, r.relative_rr_delta) for r in Y.interval_reference(d, ["rec"]).collect()}
    assert got[60] == (0, False, None, None) and got[120][:2] == (60, False)
    assert got[180] == (120, True, 0.75, None) and got[360][:3] == (240, True, 1.0)


def test_checks(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, None)], "k int, v double")
    assert V.differences(a, a.orderBy(F.desc("k"))).isEmpty()
    assert sorted(map(tuple, V.differences(a, a.distinct()).collect())) == [(1, 1.0, 1)]
    one = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k int, v double")
    two = spark.createDataFrame([(1, 1.0 + 1e-15), (2, None), (3, 3.1), (4, 0.0)], "k int, v double")
    assert sorted(r.k for r in V.reconcile(one, two, ["k"], "v").collect()) == [3, 4]
    with pytest.raises(ValueError):
        V.disjoint([1, 2], [2])
    r = V.group_audit(
        spark.createDataFrame([("p", 3600.0, "b"), ("p", 1800.0, "a"), ("q", 1.0, "")], "g string, duration_s double, m string"),
        spark.createDataFrame([("p",)], "g string"), "g", ["m"]
    )
    assert sorted(map(tuple, r.select("g", "recordings", "hours", "m", "events").collect())) == [("p", 2, 1.5, "a ; b", 1), ("q", 1, 0.0, "", 0)]


def test_kernels_travel_without_the_package(tmp_path):
    """Executors have no copy of the package: kernels load, and run, where it can't be imported."""
    dsp.detect_beats(pulses(np.arange(0.7, 9.5, 0.8), 10), FS)
    (tmp_path / "k").write_bytes(cloudpickle.dumps((dsp.detect_beats, dsp.centred_beats, dsp.prominent_beats, dsp)))
    code = "import pickle, numpy as np\na, b, c, m = pickle.load(open('k', 'rb'))\nx = np.sin(np.arange(4000.0)) ** 9\na(x, 128.0), b(x, 128.0), c(x, 128.0), m.channel_features(x, 128.0)\nimport importlib.util\nassert importlib.util.find_spec('brontide') is None\nassert not m._RESPONSES or len(m._RESPONSES) < 4"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60, env={})

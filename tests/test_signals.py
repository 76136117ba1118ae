"""Kernels with known physics; an EDF round trip; clocks and annotations."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brontide.functions import clock as C
from brontide.functions import dsp
from brontide.operators import channels as H
from brontide.operators import rhythm as Y
from brontide.sources import annotations as N
from brontide.sources import edf as E
from brontide.sources import provenance as P


def test_spectra():
    fs, t = 512.0, np.arange(5120) / 512.0
    f = dsp.channel_features(np.sin(2 * np.pi * 10 * t), fs)
    assert 9.5 <= f["dominant_frequency"] <= 10.5 and f["alpha_relative_power"] > 0.9 and f["spectral_entropy"] < 0.35 and abs(f["total_power_1_45"] - 0.5) < 1e-3
    assert abs(dsp.channel_features(2 * np.sin(2 * np.pi * 10 * t), fs)["total_power_1_45"] / f["total_power_1_45"] - 4) < 1e-9
    freq = np.arange(1, 45.01, 0.25)
    psd = np.full(len(freq), 2.0)
    assert abs(
        sum(dsp.band_power(freq, psd, *b) for b in dsp.BANDS.values()) - 88
    ) < 1e-9 and abs(dsp.band_power(freq, psd, 4.1, 8.1) - 8) < 1e-9 and dsp.band_power(freq, psd, 0.5, 4) == 0
    flat = dsp.channel_features(np.full(5120, 3.0), fs)
    assert flat["rms"] == flat["hjorth_mobility"] == flat["hjorth_complexity"] == flat["total_power_1_45"] == 0 and flat["dominant_frequency"] is None
    shifted = dsp.channel_features(7 + np.sin(2 * np.pi * 10 * t), fs)
    assert abs(shifted["rms"] - np.sqrt(0.5)) < 1e-6 and abs(shifted["hjorth_mobility"] - f["hjorth_mobility"]) < 1e-9
    rows = np.random.default_rng(4).normal(size=(3, 2048)).cumsum(axis=1)
    many = dsp.feature_matrix(rows, 256.0)
    assert all(np.allclose(many[i], [dsp.channel_features(r, 256.0)[n] for n in dsp.CHANNEL_FEATURES]) for i, r in enumerate(rows))
    with pytest.raises(ValueError):
        dsp.channel_features(np.zeros(100), 50.0)


def test_power_of_a_broken_line_is_exact():
    rng = np.random.default_rng(9)
    freq, psd = np.arange(1, 12, 0.5), rng.random((4, 22))
    fine = np.unique(np.concatenate([np.linspace(2.3, 9.9, 20001), freq[(freq > 2.3) & (freq < 9.9)]]))
    want = [np.trapezoid(np.interp(fine, freq, p), fine) for p in psd]
    assert np.allclose(dsp.band_power(freq, psd, 2.3, 9.9), want, rtol=1e-12) and not dsp.band_power(freq, psd, 9.0, 20.0).any()


def best_pairing(a, b, tolerance):
    """Largest number of pairs, by trying, for each beat, every partner and none."""
    if not a:
        return 0
    tries = [best_pairing(a[1:], b[:i] + b[i + 1 :], tolerance) + 1 for i, y in enumerate(b) if abs(a[0] - y) <= tolerance]
    return max([best_pairing(a[1:], b, tolerance), *tries])


def test_agreement_pairs_as_many_beats_as_can_be():
    rng = np.random.default_rng(5)
    for _ in range(150):
        a, b = (np.sort(rng.choice(30, rng.integers(0, 7), replace=False)) for _ in range(2))
        want = 2 * best_pairing(a.tolist(), b.tolist(), 3) / (len(a) + len(b)) if len(a) + len(b) else None
        assert dsp.beat_agreement(a, b, 3) == want


def test_strongest_apart_leaves_a_record_of_each_stretch():
    assert dsp.strongest_apart([], np.zeros(0), 5).tolist() == []
    assert dsp.strongest_apart([0, 3, 6, 20], np.array([1.0, 3.0, 2.0, 1.0]), 5).tolist() == [3, 20]
    assert dsp.strongest_apart([0, 3, 6], np.array([2.0, 1.0, 1.0]), 5).tolist() == [0, 6]  # 3 gives way, and 6 is apart from 0
    rng, n = np.random.default_rng(2), 100_000  # in linear memory
    places, strength = np.cumsum(rng.integers(1, 9, n)), rng.integers(0, 50, n).astype(float)
    i, want = 0, []
    while i < n:
        j = next((k for k in range(i + 1, n) if places[k] - places[i] >= 12 or strength[k] > strength[i]), n)
        if j == n or places[j] - places[i] >= 12:
            want.append(places[i])
        i = j
    assert dsp.strongest_apart(places, strength, 12).tolist() == want
    assert dsp.strongest_apart([0, 4, 8, 12], np.array([1.0, 2.0, 3.0, 4.0]), 5).tolist() == [12]


def test_filters_and_beats():
    fs = 256.0
    t = np.arange(int(60 * fs)) / fs
    at = np.arange(1.0, 59.0, 1.0)
    x = 0.2 * np.sin(2 * np.pi * 0.3 * t) + sum(np.exp(-0.5 * ((t - a) / 0.012) ** 2) for a in at)
    got = dsp.detect_beats(x, fs) / fs
    assert abs(len(got) - len(at)) <= 1 and max(min(abs(g - at)) for g in got) < 0.08
    sos = dsp.bandpass_sections(5, 25, fs)
    for hz, low, high in ((11.0, 0.9, 1.1), (0.5, 0, 0.01), (100.0, 0, 0.05)):
        y = dsp.filter_causal(sos, np.sin(2 * np.pi * hz * t))[int(5 * fs) :]
        assert low <= np.sqrt(2 * np.mean(y**2)) <= high, hz
    assert np.allclose(dsp.filter_causal(sos, x)[:2000], dsp.filter_causal(sos, np.concatenate([x[:2000], -x[2000:]]))[:2000])
    assert dsp.beat_agreement(np.array([1.0, 2.0, 3.0]), np.array([1.05, 2.5, 3.0]), 0.1) == 2 * 2 / 6
    assert dsp.find_peaks(
        np.array([0, 2, 2, 0, 3, 0, 1, 0]), 1, 3
    ).tolist() == [4] or dsp.find_peaks(np.array([0, 2, 2, 0, 3, 0, 1, 0]), 1, 3).tolist() == [1, 4]


def test_rhythm(spark):
    b = spark.createDataFrame([(0, x) for x in (0, 100, 350, 470)], "rec int, x bigint")
    rr = Y.rr_series(b, ["rec"], 0.30, 2.0, 100.0)
    got = sorted((r.x, r.valid, round(r.rate, 9)) for r in rr.collect())
    assert got == [(100, True, 60.0), (350, False, 24.0), (470, True, 50.0)]
    f = Y.rhythm_features(rr, ["rec"], ["rec"], F.lit(2.35)).first()
    assert f.rmssd_s is None and f.median_hr == 55.0 and f.early_late_hr == -10.0
    beats = np.cumsum([90, 110, 70, 260, 80, 95, 120])
    rr = Y.rr_series(spark.createDataFrame([(0, int(x)) for x in [0, *beats]], "rec int, x bigint"), ["rec"], 0.30, 2.0, 100.0)
    f = Y.rhythm_features(rr, ["rec"], ["rec"], F.lit(4.15)).first()
    early, late = [60 / 0.9, 60 / 1.1, 60 / 0.7], [60 / 0.8, 60 / 0.95, 60 / 1.2]
    assert abs(f.early_late_hr - (np.median(late) - np.median(early))) < 1e-9 and f.n_valid == 6
    one = spark.range(1).select(Y.compressed_rr(F.array(*map(F.lit, [0, 20, 100, 200, 450])), 100.0).alias("r")).first().r
    assert [round(x, 9) for x in one] == [0.8, 1.0]


def test_flat_and_opposite_channels(spark):
    wave = np.sin(np.arange(64)).tolist()
    d = spark.createDataFrame(
        [(0, 0, [1.0] * 64), (0, 1, wave), (0, 2, [-x for x in wave]), (1, 0, [1.0] * 64), (1, 1, wave)], "w int, c int, s array<double>"
    )
    got = {r.w: r.mean_abs_channel_corr for r in H.correlation_summary(d, ["w"], "c", "s").collect()}
    assert abs(got[0] - 1) < 1e-9 and got[1] is None


def write_edf(path, signals, record_s=1.0):
    """``signals``: (label, samples a record, int16 array)."""
    n, records = len(signals), len(signals[0][2]) // signals[0][1]
    pad = lambda x, w: str(x).ljust(w).encode("latin-1")[:w]
    head = b"".join(
        [
            pad("0", 8), pad("p", 80), pad("r", 80), pad("01.01.24", 8), pad("23.59.50", 8), pad(256 * (n + 1), 8), pad("", 44), pad(records, 8),
            pad(record_s, 8), pad(n, 4)
        ]
    )
    cols = [
        (lambda s: s[0], 16), (lambda s: "", 80), (lambda s: "uV", 8), (lambda s: -100, 8), (lambda s: 100, 8), (lambda s: -1000, 8),
        (lambda s: 1000, 8), (lambda s: "", 80), (lambda s: s[1], 8), (lambda s: "", 32)
    ]
    head += b"".join(pad(f(s), w) for f, w in cols for s in signals)
    body = b"".join(s[2][r * s[1] : (r + 1) * s[1]].astype("<i2").tobytes() for r in range(records) for s in signals)
    path.write_bytes(head + body)


def test_edf_round_trip(spark, tmp_path):
    a, b = np.arange(-40, 40), np.arange(40) * 10
    write_edf(tmp_path / "x.edf", [("EEG Fp1", 8, a), ("EKG", 4, b)])
    E.register(spark)
    h = spark.read.format("edf_header").load(str(tmp_path)).first()
    assert (h.n_signals, h.duration_s, h.signals[1].sampling_rate, h.signals[1].offset_samples) == (2, 10.0, 4.0, 8)
    got = E.load(spark, str(tmp_path), chunk_s=3).where("channel_index = 1").orderBy("start_s").collect()
    assert [r.start_s for r in got] == [0.0, 3.0, 6.0, 9.0] and np.allclose(np.concatenate([r.samples for r in got]), b / 10)
    assert np.allclose(E.read_segment(str(tmp_path / "x.edf"), [0], 2.5, 1.0)[0], a[20:28] / 10)
    with pytest.raises(ValueError):
        E.read_segment(str(tmp_path / "x.edf"), [0], 9.5, 1.0)
    (tmp_path / "x.edf").write_bytes((tmp_path / "x.edf").read_bytes()[:-4])
    with pytest.raises(ValueError):
        E.read_header(str(tmp_path / "x.edf"))


def test_clocks_and_annotations(spark):
    c = spark.createDataFrame(
        [("16:13.23",), ("24.00.00",), ("12.60.00",), ("12.00",), ("12.00.00 trailing",), ("1 6.49.25",), (" 7.8:9 ",)], "raw string"
    )
    assert [r.s for r in c.select(C.clock_seconds(F.col("raw"), strict=False).alias("s")).collect()] == [58403, None, None, None, None, None, 25689]
    assert [r.s for r in c.select(C.lenient_clock(F.col("raw")).alias("s")).collect()] == [58403, None, None, None, 43200, 60565, 25689]
    several = spark.createDataFrame(
        [("12.0.10 (ELECTROGRAPHIC ONSET); 12.00.20 (clinical onset)",), ("1.2.3 opure 1.2.5 (Electric Onset)",)], "raw string"
    ).select(C.candidates(F.col("raw")).alias("c"))
    assert [[(x.raw_clock, x.clock_s, x.kind) for x in r.c] for r in several.collect()] == [
        [("12.0.10", 43210, "electrographic"), ("12.00.20", 43220, "clinical")], [("1.2.3", 3723, "unspecified"), ("1.2.5", 3725, "electrographic")]
    ]
    for bad in (
        "12.00.00 opure", "12.00.00 (UNKNOWN ONSET)", "25.00.00", "12.00.00 (clinical)", "12.00.00 ()", "12.00.00 (clinical onset, late)", ""
    ):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "raw string").select(C.candidates(F.col("raw"))).collect()
    text = "Seizure n 1\nFile name: f.edf\nRegistration start time: 23.59.50\nRegistration end time: 00.01.30\nSeizure start time: 00.00.05\nSeizure end time: 00.00.15\n"
    heads = spark.createDataFrame([("a", "f.edf", 23 * 3600 + 59 * 60 + 50, 100), ("b", "f.edf", 0, 100)], "source string, file_name string, start_s int, duration_s int")
    parse = lambda x: N.parse_events(N.event_blocks(spark.createDataFrame([("a", x)], "source string, value string")), heads)
    r = parse(text).collect()
    assert len(r) == 1  # another source has a file of the same name
    r = r[0]
    assert (r.onset_s, r.offset_s, r.number) == (15, 25, 1)
    with pytest.raises(Exception):
        parse(text.replace("00.00.15", "00.02.00")).collect()


def montage(swap=None, drop=None, number=None):
    """Declared channels and signals of a file in order, with one of them changed."""
    names = N.COMMON_EEG + ["EKG 1", "EKG 2"]
    declared = [[i + 1, n] for i, n in enumerate(names)]
    labels = [f"EEG {n.title()}" if "EKG" not in n else n[-1] for n in names] + ["EKG", "MK"]
    if swap:
        declared[swap[0]][1], labels[swap[0]] = swap[1:]
    if drop is not None:
        del declared[drop]
    if number:
        declared[number[0]][0] = number[1]
    return declared, labels


def frames(spark, cases):
    d = [(f"l{i}", n, name) for i, (declared, _) in enumerate(cases) for n, name in declared]
    s = [(f"f{i}", f"l{i}", False, k, x) for i, (_, labels) in enumerate(cases) for k, x in enumerate(labels)]
    return spark.createDataFrame(d, "source string, number int, name string"), spark.createDataFrame(
        s, "file string, source string, large boolean, index int, label string"
    )


def test_channels_fail_closed(spark):
    cases = [
        montage(), montage(), montage((20, "EKG 2", "EKG")), montage((3, "XX9", "EEG XX9")), montage((3, "F4", "EEG Q7")),
        montage((3, "FP1", "EEG Fp1")), montage(drop=20), montage(drop=0), montage(number=(18, 99))
    ]
    d, s = frames(spark, cases)
    got = {}
    for r in N.channel_faults(d, s).collect():
        got.setdefault(r.file, set()).add(r.fault)
    eeg = "missing_common_eeg"
    assert got == {
        "f2": {"ecg_label_mismatch"}, "f3": {"unknown_identity", eeg}, "f4": {"eeg_label_mismatch"}, "f5": {"duplicate_identity", eeg},
        "f6": {"missing_lead"}, "f7": {eeg}, "f8": {"outside_header", eeg}
    }
    with pytest.raises(Exception):
        N.reconcile_channels(d, s).collect()
    d, s = frames(spark, cases[:2])
    rows = N.reconcile_channels(d, s).withColumn("group", F.lit("g"))
    assert [r.canonical_name for r in N.agreed_channels(rows, "group", "ECG").orderBy("channel_number_1based").collect()] == N.LEADS
    with pytest.raises(Exception):
        N.agreed_channels(
            rows.withColumn(
                "official_name", F.when((F.col("file") == "f1") & (F.col("canonical_name") == "O1"), "o1").otherwise(F.col("official_name"))
            ),
            "group", "EEG"
        ).collect()
    x = N.channel_indices(rows, s).orderBy("file").first()
    assert (x.eeg_names, x.ecg_indices, x.ecg_names, x.extra_named_ecg_indices) == (N.COMMON_EEG, [19, 20], ["1", "2"], [21])
    odd = [[5 if n == 9 else 9 if n == 5 else n, "1" if name == "O1" else name] for n, name in montage()[0]]
    labels = montage()[1]
    labels[4], labels[8] = labels[8], labels[4]
    d, s = frames(spark, [(sorted(odd), labels)])
    assert [r.alias_note != "" for r in N.reconcile_channels(d, s).where("canonical_name = 'O1'").collect()] == [True]
    for bad in ("Channel 1: Fp1\nChannel 1: F3\n", "Channel 1: Fp1\nChannel 2\n", "Channel 1:\n", "nothing"):
        with pytest.raises(Exception):
            N.declared_channels(spark.createDataFrame([("a", bad)], "source string, value string")).collect()


def test_registrations(spark):
    schema = "source string, file_name string, number int, registration_start string, registration_end string, start_s int, duration_s int"
    check = lambda rows, **k: N.check_registrations(spark.createDataFrame(rows, schema), **k).orderBy("number").collect()
    a, b, c = ("p", "f", 1, "10.00.00", "11.00.00", 36000, 3600), ("p", "f", 2, None, None, 36000, 3600), (
        "p", "f", 3, "1 0.00.00", "11.00.00", 36000, 3600
    )
    got = check([a, b, c])
    assert [(r.effective_start, r.inherited, r.discrepancy_s) for r in got] == [
        ("10.00.00", False, 0), ("10.00.00", True, 0), ("1 0.00.00", False, 0)
    ]
    late = ("p", "f", 1, "07.00.00", "11.00.00", 36000, 3600)
    assert check([late], adjudicated={("p", 1): 10800})[0].discrepancy_s == 10800
    for bad in ([a, a], [b], [a, ("p", "f", 2, "10.00.01", "11.00.00", 36000, 3600)], [late], [("p", "f", 1, "later", "11.00.00", 36000, 3600)]):
        with pytest.raises(Exception):
            check(bad)


def test_checksums_and_lenient_lists(spark, tmp_path):
    (tmp_path / "data").mkdir()
    for n in ("a", "b"):
        (tmp_path / "data" / n).write_text(n)
    import hashlib

    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    (tmp_path / "sums").write_text(f"{digest('a')}  a\n{digest('a').upper()}  b\n{digest('c')}  c\n")
    listed = N.checksum_list(spark, str(tmp_path / "sums"))
    got = {r.file_name: r.status for r in N.verify_checksums(listed, N.file_hashes(spark, str(tmp_path / "data"))).collect()}
    assert got == {"a": "OK", "b": "FAIL", "c": "MISSING"}
    text = "Seizure n 1\nFile name: PNO6-1.edf\nRegistration start time: 1 6.49.25\nSeizure start time: about 17 . 0 . 5 or so\nSeizure end time: never\n"
    r = N.lenient_events(spark.createDataFrame([("a", text)], "source string, value string")).first()
    assert (
        r.file_name, r.registration_start_clock_s, r.start_clock_s, r.end_clock_s, r.registration_end_clock_s
    ) == ("PN06-1.edf", 60565, 61205, None, None)


def test_staleness_is_inherited(spark, tmp_path, monkeypatch):
    names = "abcdef"
    a, b, c, d, e, f = (str(tmp_path / x) for x in names)
    for n in names:
        (tmp_path / n).write_text(n)
    P.stamp(spark, b, "cache", {}, [a])
    P.stamp(spark, c, "cache", {}, [a])
    P.stamp(spark, d, "result", {}, [b, c])
    read = []
    hash_all = P._hash_all
    monkeypatch.setattr(P, "_hash_all", lambda s, paths: read.append(paths) or hash_all(s, paths))
    assert P.status(spark, d) == "current" and len(read) == 1 and len(read[0]) == 4  # a diamond: each file once
    assert P.statuses(spark, [a, d, e, f + "?"]) == {a: "unstamped", d: "current", e: "unstamped", f + "?": "missing"}
    (tmp_path / "a").write_text("changed")
    assert set(P.statuses(spark, [b, c, d]).values()) == {"stale"}
    with pytest.raises(ValueError):
        P.require_current(spark, d)
    P.stamp(spark, e, "x", {}, [f])
    P.stamp(spark, f, "x", {}, [e])
    with pytest.raises(ValueError):
        P.status(spark, e)
    with pytest.raises(FileNotFoundError):
        P.stamp(spark, e, "x", {}, [str(tmp_path / "none")])
    assert P.sha256(spark, a, 3) == hashlib.sha256(b"cha").hexdigest()


def test_windows_take_in_the_whole_series(spark):
    from brontide.plans import features

    d = spark.range(1, 1300, 37).select(
        "id", F.sequence(F.lit(1), F.col("id").cast("int")).alias("samples")
    ).select("id", features._pieces("samples", 512).alias("p"))
    for r in d.collect():
        assert {x for p in r.p for x in p.samples} == set(range(1, r.id + 1))
        assert all(len(p.samples) == min(512, r.id) for p in r.p)
        assert [p.part for p in r.p] == ([-1] if r.id % 512 else []) + list(range(r.id // 512))
    sf = "/root/testdata/sf0.001"
    series = [(r.l_suppkey, [float(x) for x in r.samples]) for r in features._prices(spark, sf).collect()]
    want = {}
    for k, x in series:
        for part, piece in [(i, x[i * 512 : i * 512 + 512]) for i in range(len(x) // 512)] + ([(-1, x[-512:])] if len(x) % 512 else []):
            want.setdefault((k // 4, part), []).append(dsp.channel_features(np.array(piece), 128.0)["rms"])
    got = {(r.window, r.part): r.rms_mean for r in features.q50_window_features(spark, sf).collect()}
    assert got.keys() == want.keys() and any(len(x) > 512 for _, x in series)
    assert all(
        abs(got[k] - np.mean(v)) < 1e-6 * np.mean(v) for k, v in want.items() if got[k] is not None
    ) and any(v is not None for v in got.values())

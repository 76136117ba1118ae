"""Sinks, the inventory and rows of both modalities."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brontide.operators import spectra as X
from brontide.sources import annotations as N
from brontide.sources import edf as E
from brontide.sources import inventory as V
from brontide.sources import sinks as K
from test_signals import write_edf


def test_tables_with_manifests(spark, tmp_path):
    d = spark.range(10)
    path = str(tmp_path / "t")
    spec = K.write_table(d, path, "k", {"a": 1}, {})
    assert K.write_table(d, path, "k", {"a": 1}, {}) == spec and K.changed_files(spark, path).isEmpty()
    with pytest.raises(ValueError):
        K.write_table(d, path, "k", {"a": 2}, {})
    assert set(K.frozen(spark, [path])) == {f"{path}/{f['file']}" for f in spec["files"]}
    who = K.write_metadata(spark, str(tmp_path / "m.json"), {str(tmp_path / "u"): d}, {"policy": 1})
    assert K.metadata_identity(spark, str(tmp_path / "m.json")) == who
    part = next((tmp_path / "u").glob("part*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    (tmp_path / "u" / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        K.metadata_identity(spark, str(tmp_path / "m.json"))


def test_partitioned_tables_and_crashes(spark, tmp_path, monkeypatch):
    d = spark.range(20).withColumn("p", F.concat(F.lit("a b="), (F.col("id") % 2).cast("string"))).coalesce(1)
    path = str(tmp_path / "x y" / "t")
    for step in ("file_hashes", "write_text", "move"):
        with monkeypatch.context() as m:
            m.setattr(K, step, lambda *a: (_ for _ in ()).throw(OSError("crash")))
            with pytest.raises(OSError):
                K.write_table(d, path, "k", {}, {}, ("p",))
        assert not K.exists(spark, path)
    spec = K.write_table(d, path, "k", {}, {}, ("p",))
    assert len({f["file"] for f in spec["files"]}) == 2 and K.changed_files(spark, path).isEmpty()
    assert spark.read.parquet(path).count() == 20 and [x.name for x in (tmp_path / "x y").iterdir()] == ["t"]
    assert len(K.frozen(spark, [path])) == 2
    (tmp_path / "foreign").mkdir()
    with pytest.raises(ValueError):
        K.write_table(d, str(tmp_path / "foreign"), "k", {}, {})


def test_large_files_are_hashed_in_blocks(spark, tmp_path):
    size = 2_200_000_000  # sparse; more than Spark's readers take as one value
    with open(tmp_path / "large", "wb") as f:
        f.truncate(size)
    h, zeros = hashlib.sha256(), bytes(1 << 20)
    for i in range(0, size, 1 << 20):
        h.update(zeros[: size - i])
    assert [tuple(r) for r in K.file_hashes(spark, str(tmp_path)).collect()] == [("large", size, h.hexdigest())]


def test_rows_records_and_resuming(spark, tmp_path):
    K.write_rows(spark, [{"a": 1, "b": None}, {"a": 2.5, "b": "x"}], str(tmp_path / "rows"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "rows")).collect()] == [("1", None), ("2.5", "x")]
    with pytest.raises(ValueError):
        K.recorded(spark, str(tmp_path), "job", lambda: (_ for _ in ()).throw(ValueError("no")))
    assert K.read_json(spark, str(tmp_path / "job.failure.json"))["message"] == "no"
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps({"n": 1}, indent=2))
    assert K.json_rows(spark, str(tmp_path / "j"), "n int").first().n == 1
    seen = []
    make = lambda d: seen.append(d.count()) or d.withColumn("y", F.col("id") * 2)

    def broken(d):
        return d.withColumn("y", F.when(F.col("id") < 9, F.raise_error(F.lit("stop"))).cast("bigint"))

    with pytest.raises(Exception, match="stop"):
        K.resume_into(spark.range(5), str(tmp_path / "r"), ["id"], broken)
    assert [x.name.split("-")[0] for x in (tmp_path / "r").iterdir()] == ["_making"]  # what a failed run has left doesn't count
    assert K.resume_into(spark.range(5), str(tmp_path / "r"), ["id"], make).count() == 5
    assert K.resume_into(spark.range(8), str(tmp_path / "r"), ["id"], make).count() == 8
    assert K.resume_into(spark.range(8), str(tmp_path / "r"), ["id"], make).count() == 8 and [n for n in seen if n] == [5, 3]


def test_inventory_is_checked_before_it_is_written(spark, tmp_path):
    names = N.COMMON_EEG + ["EKG 1", "EKG 2"]
    event = "\nSeizure n {}\nFile name: {}\nRegistration start time: 10.00.00\nRegistration end time: 11.00.00\nSeizure start time: {}\nSeizure end time: 10.20.30; 10.20.40\n"
    listing = "".join(f"Channel {i + 1}: {n}\n" for i, n in enumerate(names))
    texts = lambda *ev: spark.createDataFrame([("p", listing + "".join(event.format(*e) for e in ev))], "source string, value string")
    headers = spark.createDataFrame(
        [("p", "a.edf", 36000, 3600), ("p", "b.edf", 36000, 3600)], "source string, file_name string, start_s int, duration_s int"
    )
    signals = spark.createDataFrame(
        [(f, "p", False, i, n[-1] if "EKG" in n else f"EEG {n}") for f in ("a.edf", "b.edf") for i, n in enumerate(names)],
        "file string, source string, large boolean, index int, label string"
    )
    good = [(1, "a.edf", "10.20.00"), (2, "b.edf", "10.19.00 (clinical onset); 10.19.30 (electric onset)")]
    made = V.build(texts(*good), headers, signals)
    ev = {r.number: r for r in made["events"].collect()}
    assert (ev[1].onset_s, ev[1].offset_s, ev[2].onset_s, ev[1].uncertain_flag) == (1200, 1230, 1140, True)
    assert [
        tuple(r) for r in made["recordings"].orderBy("file_name").select("file_name", "event_count", "n_eeg", "n_ecg").collect()
    ] == [("a.edf", 1, 19, 2), ("b.edf", 1, 19, 2)]
    who = V.write(made, str(tmp_path / "inv"), {"policy": "v1"})
    assert K.metadata_identity(spark, str(tmp_path / "inv/inventory.json")) == who and V.replay(
        V.build(texts(*good), headers, signals), str(tmp_path / "inv")
    ).isEmpty()
    changed = V.build(texts(good[0], (2, "b.edf", "10.18.00")), headers, signals)
    assert {r.table for r in V.replay(changed, str(tmp_path / "inv")).collect()} == {"events"}
    for bad in ([good[0]], [*good, (3, "c.edf", "10.20.00")], [good[0], (1, "b.edf", "10.20.00")], [good[0], (2, "b.edf", "10.21.00")]):
        with pytest.raises(Exception):
            V.build(texts(*bad), headers, signals)


def test_matrix_needs_one_rate(tmp_path):
    write_edf(tmp_path / "x.edf", [("EEG Fp1", 8, np.arange(80)), ("EEG Fp2", 8, np.arange(80)), ("EKG", 4, np.arange(40))])
    m, fs = E.read_matrix(str(tmp_path / "x.edf"), [0, 1], 1.0, 2.0)
    assert m.shape == (2, 16) and fs == 8.0
    with pytest.raises(ValueError):
        E.read_matrix(str(tmp_path / "x.edf"), [0, 2], 1.0, 2.0)


def test_parts_of_a_recording(spark, tmp_path):
    write_edf(tmp_path / "x.edf", [("EEG Fp1", 8, np.arange(80))])
    E.register(spark)
    d = spark.read.format("edf").option("chunk_s", "3").option("parts", "3").load(str(tmp_path))
    assert d.rdd.getNumPartitions() == 3 and [r.start_s for r in d.orderBy("start_s").collect()] == [0.0, 3.0, 6.0, 9.0]


def test_only_wanted_records_are_read(spark, tmp_path, monkeypatch):
    """Ten seconds of one channel of an hour: the bytes read are the header's and these records'."""
    from pyspark.sql import datasource as D

    n = 3600
    write_edf(tmp_path / "x.edf", [(f"EEG {i}", 16, np.arange(16 * n) % 2000 - 1000) for i in range(12)])
    read = []

    class Counting:
        def __init__(self, f):
            self.f = f

        def read(self, k):
            read.append(k)
            return self.f.read(k)

        def __getattr__(self, name):
            return getattr(self.f, name)

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

    real = E.open_file
    monkeypatch.setattr(E, "open_file", lambda path: Counting(real(path)))
    reader = E._PrunedReader({"path": str(tmp_path), "chunk_s": "10"})
    left = list(reader.pushFilters([D.EqualTo(("channel_index",), 3), D.GreaterThanOrEqual(("start_s",), 100.0), D.LessThan(("start_s",), 110.0), D.IsNotNull(("label",))]))
    assert len(left) == 1
    rows = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(rows) == 1 and sum(read) == 256 * 13 + 10 * 16 * 2
    d = E.load(spark, str(tmp_path), chunk_s=10, split_bytes=400_000)
    assert d.rdd.getNumPartitions() == 4  # 1.4 MB
    for _ in range(2):  # what one scan prunes is there for the next
        got = d.where("channel_index = 3 AND start_s >= 100 AND start_s < 110").collect()
        assert [(r.start_s, len(r.samples)) for r in got] == [(100.0, 160)] and d.count() == 360 * 12
    whole = E.read_segment(str(tmp_path / "x.edf"), list(range(12)), 7.0, 5.0)
    assert all(np.array_equal(whole[c], E.read_segment(str(tmp_path / "x.edf"), [c], 7.0, 5.0)[c]) for c in whole)


def test_recordings_by_path(spark, tmp_path):
    (tmp_path / "p" / "q r").mkdir(parents=True)
    for name in ("p/a.edf", "p/b.edf", "p/q r/c.edf"):
        write_edf(tmp_path / name, [("EEG Fp1", 8, np.arange(80))])
    E.register(spark)
    names = lambda path, **o: sorted(r.path.rsplit("/", 1)[-1] for r in spark.read.format("edf_header").options(**o).load(path).collect())
    assert names(f"{tmp_path}/p") == names(f"file://{tmp_path}/p") == ["a.edf", "b.edf"]
    assert names(f"{tmp_path}/p", recursiveFileLookup="true") == ["a.edf", "b.edf", "c.edf"]
    assert names(f"{tmp_path}/p/b*.edf") == ["b.edf"] and names(f"{tmp_path}/p/q r/c.edf") == ["c.edf"]
    with pytest.raises(Exception):
        names(f"{tmp_path}/none")


def test_anchor_rows(spark):
    fs, t = 256.0, np.arange(2560) / 256.0
    beat = sum(np.exp(-0.5 * ((t - a) / 0.012) ** 2) for a in np.arange(0.5, 10, 0.8))
    wave = lambda hz: np.sin(2 * np.pi * hz * t).tolist()
    eeg = spark.createDataFrame([(0, c, wave(h)) for c, h in enumerate((6, 10, 20))], "anchor int, channel int, samples array<double>")
    ecg = spark.createDataFrame([(0, 0, beat.tolist()), (0, 1, (-2 * beat).tolist())], "anchor int, channel int, samples array<double>")
    r = X.anchor_rows(eeg, ecg, ["anchor"], "channel", "samples", fs, fs).first()
    assert (r.n_eeg_channels, r.n_ecg_channels, r.sampling_rate_hz) == (3, 2, fs) and abs(r.ecg__ecg_channel_agreement - 1) < 1e-6
    assert abs(r.ecg__mean_hr_bpm_median - 75) < 2 and r.ecg__n_r_peaks_range == 0 and abs(r.eeg__rms_mean - np.sqrt(0.5)) < 1e-3
    assert [len(c) for c in X.columns_by_prefix(list(r.asDict()), "eeg__", "ecg__")] == [46, 19]
    with pytest.raises(ValueError):
        X.anchor_rows(eeg, ecg, ["anchor"], "channel", "samples", fs, 128.0)


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace as Of

    from brontide.operators.staging import shared_dir

    session = lambda named, master: Of(conf=Of(get=lambda *_: named), sparkContext=Of(master=master))
    assert shared_dir(session("hdfs://x/y/", "yarn")) == "hdfs://x/y" and shared_dir(session(None, "local[2]"))
    with pytest.raises(ValueError):
        shared_dir(session(None, "spark://host:7077"))

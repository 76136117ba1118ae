"""EDF recordings as Spark data sources.

``edf_header`` gives one row a file; ``edf`` gives one row for each channel and chunk, with
the physical samples. A file is dealt to as many tasks as its size asks for (``split_bytes``,
64 MB by default, or ``parts``), each with a range of its chunks. Of a chunk only its records
are read, and of those only the channels asked for (option ``channels``, or, through :func:`load`, a filter on
``channel_index``); chunks that filters on ``start_s`` rule out are not read at all. Neither a
long recording nor a wide one sits in one row.

The driver lists files and opens none. Paths may be local (on a cluster, in a folder that all
executors mount) or of any file system that Arrow opens: hdfs, s3, gs, abfs.
"""

from __future__ import annotations

import fnmatch
import math
import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

_SIGNAL = (
    ("label", 16), ("transducer", 80), ("unit", 8), ("physical_min", 8), ("physical_max", 8), ("digital_min", 8), ("digital_max", 8),
    ("prefilter", 80), ("samples_per_record", 8), ("reserved", 32)
)
HEADER_SCHEMA = "path string, patient_id string, recording_id string, start_date string, start_time string, header_bytes bigint, n_records bigint, record_s double, duration_s double, n_signals int, signals array<struct<label:string,transducer:string,unit:string,physical_min:double,physical_max:double,digital_min:int,digital_max:int,prefilter:string,samples_per_record:int,sampling_rate:double,offset_samples:bigint>>"
SEGMENT_SCHEMA = "path string, channel_index int, label string, start_s double, sampling_rate double, samples array<double>"


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path:
        return pyarrow.fs.LocalFileSystem(), path.removeprefix("file:")
    if path.startswith("file://"):
        return pyarrow.fs.LocalFileSystem(), path.removeprefix("file://")
    scheme, rest = path.split("://", 1)
    return pyarrow.fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{rest}")


def open_file(path: str):
    fs, at = file_system(path)
    return fs.open_input_file(at)


def read_header(path: str) -> dict:
    """The header of a file; raises if it does not fit itself or the file's length."""
    with open_file(path) as f:
        return _header(path, f)


def _header(path: str, f) -> dict:
    f.seek(0)
    fixed = f.read(256)
    if len(fixed) < 256:
        raise ValueError(f"{path}: truncated header")
    text = lambda a, b: fixed[a:b].decode("latin-1").strip()
    n, size, records, record_s = int(text(252, 256)), int(text(184, 192)), int(text(236, 244)), float(text(244, 252))
    if size != 256 * (n + 1) or records <= 0 or record_s <= 0 or n <= 0:
        raise ValueError(f"{path}: inconsistent header")
    rest = f.read(size - 256).decode("latin-1")
    if len(rest) < size - 256:
        raise ValueError(f"{path}: truncated header")
    signals: list[dict] = [{} for _ in range(n)]
    at = 0
    for name, width in _SIGNAL:
        for s in signals:
            s[name] = rest[at : at + width].strip()
            at += width
    offset = 0
    for s in signals:
        s |= {k: float(s[k]) for k in ("physical_min", "physical_max")} | {k: int(s[k]) for k in ("digital_min", "digital_max", "samples_per_record")}
        if s["samples_per_record"] <= 0:
            raise ValueError(f"{path}: a signal without samples")
        s |= {"sampling_rate": s["samples_per_record"] / record_s, "offset_samples": offset}
        offset += s["samples_per_record"]
    if f.size() < size + records * offset * 2:
        raise ValueError(f"{path}: fewer samples than declared")
    return {
        "path": path, "patient_id": text(8, 88), "recording_id": text(88, 168), "start_date": text(168, 176), "start_time": text(176, 184),
        "header_bytes": size, "n_records": records, "record_s": record_s, "duration_s": records * record_s, "n_signals": n, "signals": signals,
        "record_samples": offset
    }


def to_physical(signal: dict, digital: np.ndarray) -> np.ndarray:
    span = signal["digital_max"] - signal["digital_min"]
    if not span:
        raise ValueError("a signal without digital range")
    return (digital - signal["digital_min"]) * ((signal["physical_max"] - signal["physical_min"]) / span) + signal["physical_min"]


def _digital(f, h: dict, channels: list[int], first: int, last: int) -> dict[int, np.ndarray]:
    """Samples as stored, of some channels in the records [first, last): whole records in one read where
    most of each is wanted, else each channel's part of each record."""
    signals = [h["signals"][c] for c in channels]
    if 2 * sum(s["samples_per_record"] for s in signals) > h["record_samples"]:
        f.seek(h["header_bytes"] + first * h["record_samples"] * 2)
        raw = f.read((last - first) * h["record_samples"] * 2)
        if len(raw) < (last - first) * h["record_samples"] * 2:
            raise EOFError(f"{h['path']}: ends within record {first + len(raw) // (2 * h['record_samples'])}")
        whole = np.frombuffer(raw, "<i2").reshape(last - first, -1)
        return {c: whole[:, s["offset_samples"] : s["offset_samples"] + s["samples_per_record"]].reshape(-1) for c, s in zip(channels, signals, strict=True)}
    parts: dict[int, list[np.ndarray]] = {c: [] for c in channels}
    for r in range(first, last):
        for c, s in zip(channels, signals, strict=True):
            f.seek(h["header_bytes"] + (r * h["record_samples"] + s["offset_samples"]) * 2)
            raw = f.read(s["samples_per_record"] * 2)
            if len(raw) < s["samples_per_record"] * 2:
                raise EOFError(f"{h['path']}: ends within record {r}")
            parts[c].append(np.frombuffer(raw, "<i2"))
    return {c: np.concatenate(p) for c, p in parts.items()}


def _segment(f, h: dict, channels: list[int], start_s: float, duration_s: float) -> dict[int, np.ndarray]:
    first, last = int(start_s // h["record_s"]), min(h["n_records"], math.ceil((start_s + duration_s) / h["record_s"] - 1e-9))
    if start_s < 0 or duration_s <= 0 or start_s + duration_s > h["duration_s"] + 1e-9:
        raise ValueError(f"{h['path']}: segment outside the recording")
    out = {}
    for c, x in _digital(f, h, list(dict.fromkeys(channels)), first, last).items():
        s = h["signals"][c]
        a = round((start_s - first * h["record_s"]) * s["sampling_rate"])
        out[c] = to_physical(s, x[a : a + round(duration_s * s["sampling_rate"])].astype(float))
    return out


def read_segment(path: str, channels: list[int], start_s: float, duration_s: float) -> dict[int, np.ndarray]:
    """Physical samples of some channels in [start, start + duration), by seeking to them."""
    with open_file(path) as f:
        return _segment(f, _header(path, f), channels, start_s, duration_s)


def read_matrix(path: str, channels: list[int], start_s: float, duration_s: float) -> tuple[np.ndarray, float]:
    """Physical samples of some channels as the rows of a matrix, and their rate, which they must
    share; cut to the shortest."""
    signals = read_header(path)["signals"]
    rates = sorted({signals[c]["sampling_rate"] for c in channels})
    if len(rates) != 1:
        raise ValueError(f"{path}: channels must share one sampling rate, not {rates}")
    segment = read_segment(path, channels, start_s, duration_s)
    n = min(len(x) for x in segment.values())
    return np.stack([segment[c][:n] for c in channels]), rates[0]


def _files(options: dict) -> list[tuple[str, int]]:
    """Path and size of the recordings at a path: a file, a folder's (or, with ``recursiveFileLookup``, all
    below it), or those that a pattern in the last part of the path names."""
    path = (options.get("path") or "").rstrip("/")
    fs, at = file_system(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else path.split("://")[0] + "://"
    pattern = "*.edf"
    info = fs.get_file_info(at)
    if info.type == pyarrow.fs.FileType.File:
        found = [info]
    else:
        if info.type == pyarrow.fs.FileType.NotFound:
            at, pattern = at.rsplit("/", 1) if "/" in at else (".", at)
        deep = str(options.get("recursivefilelookup", options.get("recursiveFileLookup", "false"))).lower() == "true"
        listed = fs.get_file_info(pyarrow.fs.FileSelector(at, allow_not_found=True, recursive=deep))
        found = [x for x in listed if x.type == pyarrow.fs.FileType.File and fnmatch.fnmatch(x.base_name, pattern)]
    if not found:
        raise FileNotFoundError(path)
    return sorted((prefix + x.path, x.size) for x in found)


@dataclass
class Share(InputPartition):
    path: str
    part: int = 0
    parts: int = 1


class _HeaderReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [Share(p) for p, _ in _files(self.options)]

    def read(self, partition):
        h = read_header(partition.path)
        keys = [x.split()[0] for x in HEADER_SCHEMA.split(", signals")[0].split(", ")]
        fields = [
            "label", "transducer", "unit", "physical_min", "physical_max", "digital_min", "digital_max", "prefilter", "samples_per_record",
            "sampling_rate", "offset_samples"
        ]
        yield (*[h[k] for k in keys], [tuple(s[x] for x in fields) for s in h["signals"]])


class EdfHeaderSource(DataSource):
    @classmethod
    def name(cls):
        return "edf_header"

    def schema(self):
        return HEADER_SCHEMA

    def reader(self, schema):
        return _HeaderReader(self.options)


_COMPARED = {GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, EqualTo: operator.eq}


class _SegmentReader(DataSourceReader):
    def __init__(self, options):
        self.options = options
        self.channels = [int(c) for c in options["channels"].split(",")] if options.get("channels") else None
        self.chunk_s, self.halo_s = float(options.get("chunk_s", 300)), float(options.get("halo_s", 0))
        self.parts, self.split_bytes = int(options.get("parts", 0)), int(options.get("split_bytes", 64 << 20))
        self.times: list[tuple] = []

    def partitions(self):
        out = []
        for path, size in _files(self.options):
            n = self.parts if self.parts > 0 else max(1, math.ceil(size / self.split_bytes))
            out += [Share(path, i, n) for i in range(n)]
        return out

    def chunks(self, partition: Share, total: float) -> list[tuple[float, float]]:
        """Start and length of the chunks of a share that the filters on time let through."""
        n = math.ceil(total / self.chunk_s)
        out = []
        for i in range(partition.part * n // partition.parts, (partition.part + 1) * n // partition.parts):
            start = max(0.0, i * self.chunk_s - self.halo_s)
            if all(_COMPARED[kind](start, value) for kind, value in self.times):
                out.append((start, min(total, (i + 1) * self.chunk_s) - start))
        return out

    def read(self, partition):
        names = [f.split()[0] for f in SEGMENT_SCHEMA.split(", ")]
        with open_file(partition.path) as f:
            h = _header(partition.path, f)
            signals = h["signals"]
            channels = list(range(len(signals))) if self.channels is None else [c for c in dict.fromkeys(self.channels) if 0 <= c < len(signals)]
            for start, length in self.chunks(partition, h["duration_s"]) if channels else ():
                for c, x in _segment(f, h, channels, start, length).items():
                    samples = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.float64()))
                    columns = [
                        pa.array([partition.path]), pa.array([c], pa.int32()), pa.array([signals[c]["label"]]), pa.array([start]),
                        pa.array([signals[c]["sampling_rate"]]), samples
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)


class _PrunedReader(_SegmentReader):
    def pushFilters(self, filters):
        for f in filters:
            column = tuple(getattr(f, "attribute", ()))
            if isinstance(f, (EqualTo, In)) and column == ("channel_index",):
                wanted = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.channels = [c for c in wanted if self.channels is None or c in self.channels]
            elif type(f) in _COMPARED and column == ("start_s",):
                self.times.append((type(f), float(f.value)))
            else:
                yield f


class EdfSource(DataSource):
    @classmethod
    def name(cls):
        return "edf"

    def schema(self):
        return SEGMENT_SCHEMA

    def reader(self, schema):
        return _SegmentReader(self.options)


class PrunedEdfSource(EdfSource):
    @classmethod
    def name(cls):
        return "edf_pruned"

    def reader(self, schema):
        return _PrunedReader(self.options)


def register(spark) -> None:
    """Makes the formats ``edf`` and ``edf_header`` known; filters on ``edf`` prune nothing, see :func:`load`."""
    for source in (EdfHeaderSource, EdfSource, PrunedEdfSource):
        spark.dataSource.register(source)


def load(spark, path: str, **options) -> DataFrame:
    """Segments of recordings; filters on ``channel_index`` and ``start_s`` decide what is read.

    Spark keeps what a scan's filters have pruned, and a later scan of the same DataFrame without any
    filter would be pruned likewise. Every scan has one here, so each is pruned by its own."""
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("edf_pruned").options(**options).load(path).where("start_s >= 0")

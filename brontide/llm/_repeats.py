"""Numpy kernels and Arrow stages that find windows repeated across documents.

A *window* is ``window`` consecutive units (bytes or words) of one document.  Every
window is owned by one *trigger*: the leftmost ``gram``-unit string inside it whose
rolling hash is least.  Ownership depends on the window's own content only, so equal
windows have equal triggers wherever they occur, and each window has exactly one.

Documents are dealt into *parts* of bounded size.  A part asks questions (sorted,
without repetition, so a hot string is asked once a part) and gets back one bit a
question; texts cross the network once, the questions only for what repeats.
"""

from __future__ import annotations

import contextlib
import ctypes
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_ID = -(2**63)  # a null doc_id sorts before every other
_POS_BITS = 20
_CHUNK = 1 << 18
_MUL = 0x9E3779B97F4A7C15
_BYTE_VALUES = np.random.default_rng(20240601).integers(0, 2**64, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gram_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Rolling hash of every ``width`` consecutive values (uint64), by doubling."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    power, out, done = {1: values}, None, 0
    k = 1
    while k * 2 <= width:
        h = power[k]
        power[2 * k] = h[:-k] * np.uint64(pow(_MUL, k, 2**64)) + h[k:]
        k *= 2
    for k in sorted(power, reverse=True):
        if width & k:
            if out is None:
                out = power[k]
            else:
                n = len(values) - (done + k) + 1
                out = out[:n] * np.uint64(pow(_MUL, k, 2**64)) + power[k][done : done + n]
            done += k
    return mix(out)


def owned_runs(units: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """Runs of windows with the same trigger: (first start, last start, document, trigger hash).

    ``bounds``: where each document starts in ``units``, and the end.
    """
    lens = np.diff(bounds)
    doc_of = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    span = window - gram + 1
    low = np.uint64((1 << _POS_BITS) - 1)
    found = []
    for c in range(0, max(0, len(units) - window + 1), _CHUNK):
        part = units[c : c + _CHUNK + window - 1]
        h = gram_hashes(_BYTE_VALUES[part] if part.dtype == np.uint8 else part, gram)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        k, full = 1, len(h) - span + 1
        while k * 2 <= span:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        if k < span:
            least = np.minimum(least[:full], least[span - k : span - k + full])
        own = (least & low).astype(np.int64)
        s = np.arange(c, c + full)
        ok = doc_of[s] == doc_of[s + (window - 1)]
        s, own = s[ok], own[ok]
        if not len(s):
            continue
        d = doc_of[s]
        new = np.ones(len(s), bool)
        new[1:] = (own[1:] != own[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:] - 1, len(s) - 1)
        found.append((s[at], s[last], d[at], h[own[at]]))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.int32), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, count of them."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return shift + np.arange(total)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Buckets by the high half; increasing with the key."""
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


def slices(sorted_buckets: np.ndarray):
    """(bucket, from, to) of each run."""
    if not len(sorted_buckets):
        return
    at = np.flatnonzero(np.append(True, sorted_buckets[1:] != sorted_buckets[:-1]))
    for i, j in zip(at, np.append(at[1:], len(sorted_buckets)), strict=True):
        yield int(sorted_buckets[i]), int(i), int(j)


def suffix_ranks(values: np.ndarray, window: int, at: np.ndarray | None = None) -> np.ndarray:
    """Rank, in lexicographic order, of the ``window`` values from each place (of those in ``at``,
    if given): a suffix array cut at that depth. Ranks of short strings make those of longer
    ones, as many at a time as fit 64 bits. Equal ranks: equal strings."""

    def ranked(x):
        order = np.argsort(x)
        x = x[order]
        new = np.empty(len(x), bool)
        new[:1] = True
        np.not_equal(x[1:], x[:-1], out=new[1:])
        out = np.empty(len(x), np.uint64)
        out[order] = np.cumsum(new, dtype=np.uint64)
        return out

    if len(values) < window:
        return np.zeros(0, np.uint64)
    v, k = values.astype(np.uint64), 1
    if values.dtype == np.uint8:
        while k < 8 and 2 * k <= window:
            v = (v[:-k] << np.uint64(8 * k)) | v[k:]
            k *= 2
    r = ranked(v)
    while True:
        bits = max(1, int(r.max()).bit_length())
        steps = [min(i * k, window - k) for i in range(min(-(-window // k), 64 // bits))]
        k += steps[-1]
        places = at if k == window and at is not None else np.arange(len(values) - k + 1)
        v = r[places]
        for step in steps[1:]:
            v = (v << np.uint64(bits)) | r[places + step]
        r = ranked(v)
        if k == window:
            return r


def deal(docs: DataFrame, part_bytes: int) -> tuple[DataFrame, int, int]:
    """(doc_id, text, part) dealt by part; the number of parts; bytes of text."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = d.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    n = max(1, -(-total // part_bytes))
    return d.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartition(n, "part"), n, total


def release() -> None:
    """Hand freed memory back, as a worker lives on through many groups."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def read_part(table: pa.Table) -> tuple[np.ndarray, list[bytes], list]:
    """Sort keys, UTF-8 texts and ids of a part, always in the same order."""
    raw = table.column("doc_id").to_pylist()
    texts = [x or b"" for x in table.column("text").cast(pa.large_binary()).to_pylist()]
    did = [NO_ID if x is None else x for x in raw]
    order = sorted(range(len(did)), key=lambda i: (did[i], texts[i]))
    return np.array([did[i] for i in order], np.int64), [texts[i] for i in order], [raw[i] for i in order]


# ---- round 1: which triggers occur in more than one document ----------------------------

GRAM_ASK = "bucket int, part int, keys binary, many binary"
REPLY = "part int, round int, bucket int, bits binary"


def gram_question(keys: np.ndarray, dids: np.ndarray):
    """Sorted distinct triggers; whether two documents of this part hold each."""
    order = np.lexsort((dids, keys))
    k, d = keys[order], dids[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:] - 1, len(k) - 1).astype(np.int64)
    return k[at], (d[at] != d[last]) if len(at) else np.zeros(0, bool)


def gram_ask_rows(part: int, keys: np.ndarray, many: np.ndarray, buckets: int) -> pa.Table:
    rows = [
        (b, part, (keys[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), np.packbits(many[i:j]).tobytes()) for b, i,
        j in slices(bucket_of(keys, buckets))
    ]
    return rows_table(rows, GRAM_ASK)


def answer_grams(table: pa.Table) -> pa.Table:
    """A trigger is shared if one part says so, or two parts ask for it. (Half the hash is
    compared: a chance match only costs work, as windows are compared in full later.)"""
    asks = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
    many = np.concatenate(
        [np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)).astype(bool) for m, k in zip(table.column("many").to_pylist(), asks, strict=True)]
    )
    _, inverse, counts = np.unique(np.concatenate(asks), return_inverse=True, return_counts=True)
    shared = counts > 1
    shared[inverse[many]] = True
    said, rows, i = shared[inverse], [], 0
    for part, bucket, k in zip(table.column("part").to_pylist(), table.column("bucket").to_pylist(), asks, strict=True):
        rows.append((part, 1, bucket, np.packbits(said[i : i + len(k)]).tobytes()))
        i += len(k)
    release()
    return rows_table(rows, REPLY)


def read_bits(table: pa.Table, round_: int) -> dict[int, np.ndarray]:
    return {
        b: np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for r, b,
        x in zip(table.column("round").to_pylist(), table.column("bucket").to_pylist(), table.column("bits").to_pylist(), strict=True) if r == round_
    }


def shared_triggers(keys: np.ndarray, buckets: int, bits: dict[int, np.ndarray]) -> np.ndarray:
    out = np.zeros(len(keys), bool)
    for b, i, j in slices(bucket_of(keys, buckets)):
        out[i:j] = bits[b][: j - i]
    return out


# ---- round 2: windows of phrases around shared triggers ----------------------------------

PHRASE_ASK = "bucket int, part int, lens binary, least binary, owners binary, units binary"


class Phrases:
    """Distinct phrases of a part with the least document that holds each, by bucket. Equal
    windows are in phrases of the same ``owners`` (the trigger's hash, or another function of
    the windows), and a bucket holds all phrases of an owner."""

    def __init__(self, units: np.ndarray, lo: np.ndarray, hi: np.ndarray, dids: np.ndarray, owners: np.ndarray, buckets: int, window: int):
        raw, size = units.tobytes(), units.itemsize
        seen: dict[bytes, int] = {}
        number = seen.setdefault
        which = np.fromiter(
            [number(raw[i:j], len(seen)) for i, j in zip((lo * size).tolist(), ((hi + window) * size).tolist(), strict=True)], np.int64, len(lo)
        )
        first = np.zeros(len(seen), np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        bucket = bucket_of(owners[first], buckets)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(seen), np.int64)
        place[order] = np.arange(len(seen))
        self.which, self.bucket = place[which], bucket[order]
        self.least = np.full(len(seen), 2**63 - 1, np.int64)
        np.minimum.at(self.least, self.which, dids)
        self.owners = (owners[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order]
        found = list(seen)
        self.units = [found[i] for i in order.tolist()]
        self.lens = (hi - lo + window)[first][order]
        self.counts = self.lens - window + 1
        self.first = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)

    def ask(self, part: int) -> pa.Table:
        return rows_table(
            [
                (
                    b, part, self.lens[i:j].astype(np.uint32).tobytes(), self.least[i:j].tobytes(), self.owners[i:j].tobytes(),
                    b"".join(self.units[i:j])
                ) for b,
                i, j in slices(self.bucket)
            ],
            PHRASE_ASK
        )

    def earlier(self, bits: dict[int, np.ndarray]) -> np.ndarray:
        """For each window of each phrase: whether a document before the phrase's least one holds it."""
        out = np.zeros(int(self.first[-1]), bool)
        for b, i, j in slices(self.bucket):
            f, t = self.first[i], self.first[j]
            out[f:t] = bits[b][: t - f]
        return out


def answer_phrases(table: pa.Table, window: int, dtype) -> pa.Table:
    """Dictionary of distinct phrases, its suffixes in order down to ``window``, and over the
    occurrences the least document of each window. A phrase that is the only one of its owner
    shares no window with another, and needs no order."""
    size, seen, which, least, owner = np.dtype(dtype).itemsize, {}, [], [], []
    number = seen.setdefault
    for lens, mins, owners, units in zip(*(table.column(c).to_pylist() for c in ("lens", "least", "owners", "units")), strict=True):
        ends = (np.cumsum(np.frombuffer(lens, np.uint32).astype(np.int64)) * size).tolist()
        which.append(np.fromiter([number(units[i:j], len(seen)) for i, j in zip([0, *ends], ends, strict=False)], np.int64, len(ends)))
        least.append(np.frombuffer(mins, np.int64))
        owner.append(np.frombuffer(owners, np.uint32))
    every = np.concatenate(which)
    phrase_least = np.full(len(seen), 2**63 - 1, np.int64)
    np.minimum.at(phrase_least, every, np.concatenate(least))
    phrase_owner = np.zeros(len(seen), np.uint32)
    phrase_owner[every] = np.concatenate(owner)
    sizes = np.fromiter(map(len, seen), np.int64, len(seen)) // size
    counts = sizes - window + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    window_least = np.repeat(phrase_least, counts)
    _, of, alike = np.unique(phrase_owner, return_inverse=True, return_counts=True)
    several = alike[of] > 1
    if several.any():
        starts = np.concatenate([[0], np.cumsum(sizes[several])])
        values = np.frombuffer(b"".join(itertools.compress(seen, several.tolist())), dtype)
        place = suffix_ranks(values, window, ragged(starts[:-1], counts[several])).astype(np.int64)
        mine = ragged(first[:-1][several], counts[several])
        by_rank = np.full(int(place.max()) + 1, 2**63 - 1, np.int64)
        np.minimum.at(by_rank, place, window_least[mine])
        window_least[mine] = by_rank[place]
        del values, place, mine
    rows = []
    for part, bucket, w, m in zip(table.column("part").to_pylist(), table.column("bucket").to_pylist(), which, least, strict=True):
        n = counts[w]
        rows.append((part, 2, bucket, np.packbits(window_least[ragged(first[w], n)] < np.repeat(m, n)).tobytes()))
    del window_least, seen
    release()
    return rows_table(rows, REPLY)


def covered(n: int, removed_starts: np.ndarray, window: int) -> np.ndarray:
    """Units that a removed window covers."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, removed_starts, 1)
    np.add.at(step, removed_starts + window, -1)
    return np.cumsum(step[:-1]) > 0


def runs_of(mask: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of True."""
    step = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], axis=1)


_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}


def rows_table(rows: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, _TYPES[k]) for n, k, c in zip(names, kinds, cols, strict=True)})

"""Operator 12: runs of repeated words within a document.

A run is a stretch of words with smallest period q, as long as ``min_length`` words and
``min_repeats`` periods at least, that can't be made longer at either end. Each whole text is
searched on its own, so nothing is shuffled.

Every sequence of ``ANCHOR`` words inside such a run comes back within it; a text is therefore
cut to the stretches all of whose word sequences occur twice (hashes may only add some), and
only these get a suffix automaton. Its sets of end positions are merged up the suffix links,
small into large. Where two sets meet in a state of length L, two neighbouring ends at distance
d <= L are a square: the words before them agree over just L words (the ends come from different
branches), so the stretch starts there; it is a whole run if the words after them differ, and
pairs of ends that agree there are left to the pair that doesn't. Of several periods of one
stretch the least is kept. Memory is about 250 bytes a word of the longest such stretch.

Words are the longest runs of characters other than \\x20 and \\x09-\\x0D, unchanged. A null or
empty text has no words and no runs; texts of any length are read whole. A null doc_id stays
null. Each input row gives one output row, repeated rows too; equal exponents go to the smallest
start, then the smallest period; an empty table gives an empty result; columns other than doc_id
and text are not read.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._repeats import mix
from ._shared import WordHashes

MIN_LENGTH, MIN_REPEATS = 24, 3
ANCHOR = 8
SLICE = 512
RUN = "struct<start:bigint,length:bigint,period:bigint>"
OUT = f"doc_id bigint, n_words bigint, runs array<{RUN}>, best {RUN}, collapsed string"


class Automaton:
    """Suffix automaton of a list of small integers. A state's first transition lies in two arrays,
    further ones in a dictionary that only branching states have."""

    def __init__(self, ids: list[int]) -> None:
        self.link, self.length, self.end = array("i", [-1]), array("i", [0]), array("i", [-1])
        self.symbol, self.target, self.more = array("i", [-1]), array("i", [-1]), {}
        last = 0
        for i, c in enumerate(ids):
            last = self._extend(last, c, i)

    def _state(self, length: int, end: int) -> int:
        self.link.append(0)
        self.length.append(length)
        self.end.append(end)
        self.symbol.append(-1)
        self.target.append(-1)
        return len(self.link) - 1

    def _extend(self, last: int, c: int, i: int) -> int:
        link, length, symbol, target, more = self.link, self.length, self.symbol, self.target, self.more
        new, p, q = self._state(i + 1, i), last, -1
        while p >= 0:
            if symbol[p] == c:
                q = target[p]
                break
            if symbol[p] < 0:
                symbol[p], target[p] = c, new
            else:
                further = more.setdefault(p, {})
                q = further.get(c, -1)
                if q >= 0:
                    break
                further[c] = new
            p = link[p]
        if p < 0:
            return new
        if length[q] == length[p] + 1:
            link[new] = q
            return new
        copy = self._state(length[p] + 1, -1)
        link[copy], symbol[copy], target[copy] = link[q], symbol[q], target[q]
        if q in more:
            more[copy] = dict(more[q])
        while p >= 0:
            if symbol[p] == c and target[p] == q:
                target[p] = copy
            elif p in more and more[p].get(c) == q:
                more[p][c] = copy
            else:
                break
            p = link[p]
        link[q] = link[new] = copy
        return new


def runs_of(words: list, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a list, by start and period."""
    number: dict = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    sam, n = Automaton(ids), len(ids)
    link, length, more_than = sam.link, sam.length, min_repeats - 1
    # Ends are negated, so that the first of all ends, which states meet last, are appended.
    ends: dict[int, list[int]] = {v: [-e] for v, e in enumerate(sam.end) if e >= 0}
    found: dict[tuple[int, int], int] = {}

    def pair(i: int, d: int, agree: int) -> None:
        if d * more_than <= agree and agree + d >= min_length and (i + d == n - 1 or ids[i + 1] != ids[i + d + 1]):
            key = (i - agree + 1, agree + d)
            found[key] = min(d, found.get(key, d))

    for v in np.argsort(-np.frombuffer(length, np.int32), kind="stable").tolist():
        up, mine = link[v], ends.pop(v, None)
        if up <= 0 or mine is None or 3 * length[up] < 2 * min_length:  # too short for a run, as are all states above
            continue
        theirs = ends.get(up)
        if theirs is None:
            ends[up] = mine
            continue
        small, large = (mine, theirs) if len(mine) < len(theirs) else (theirs, mine)
        agree, m = length[up], len(large)
        for x in small:
            j = bisect_left(large, x)
            if j < m:
                pair(-large[j], large[j] - x, agree)
            if j:
                pair(-x, x - large[j - 1], agree)
        if len(small) * 64 > m:
            large += small
            large.sort()
        else:
            for x in small:
                insort(large, x)
        ends[up] = large
    return sorted((s, size, d) for (s, size), d in found.items())


def stretches(units: np.ndarray, doc: np.ndarray, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of the longest stretches, each within a document, all of whose
    sequences of ``anchor`` words (hashed) occur more than once in the document."""
    n = len(units) - anchor + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = mix(doc[:n].astype(np.uint64) + np.uint64(1))
    for j in range(anchor):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + units[j : n + j])
    whole = np.flatnonzero(doc[:n] == doc[anchor - 1 :])
    order = whole[np.argsort(h[whole])]
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(n + 2, bool)  # one word later, so that both ends are bare
    again[order[1:][same] + 1] = again[order[:-1][same] + 1] = True
    joined = again[2:] & again[1:-1]  # this start and the next one, of one document
    joined[:-1] &= doc[1:n] == doc[: n - 1]
    first = np.flatnonzero(again[1:-1] & ~np.append(False, joined[:-1]))
    last = np.flatnonzero(again[1:-1] & ~joined)
    return first, last + anchor - 1


def _search(min_length: int, min_repeats: int):
    def best_of(runs):
        """Greatest exact length / period, then least start, then least period."""
        top = None
        for r in runs:
            if top is None or r[1] * top[2] > top[1] * r[2]:
                top = r
        return top

    def row(words, cuts):
        runs = sorted((a + s, size, q) for a, b in cuts for s, size, q in runs_of(words[a : b + 1], min_length, min_repeats))
        kept = words
        if runs:
            keep = np.ones(len(words), bool)
            for s, size, q in runs:
                keep[s + q : s + size] = False
            kept = [words[i] for i in np.flatnonzero(keep).tolist()]
        return runs, best_of(runs), b" ".join(kept).decode()

    names = ("start", "length", "period")
    struct = pa.struct([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                words = [(t or b"").split() for t in part.column("text").cast(pa.large_binary()).to_pylist()]
                n = np.array([len(w) for w in words], np.int64)
                doc, base = np.repeat(np.arange(len(words)), n), np.concatenate([[0], np.cumsum(n)])
                units = np.concatenate([hashes.of(w) for w in words])
                cuts: list[list[tuple[int, int]]] = [[] for _ in words]
                first, last = stretches(units, doc)
                long = last - first + 1 >= min_length
                for x, y in zip(first[long].tolist(), last[long].tolist(), strict=True):
                    d = int(doc[x])
                    cuts[d].append((x - int(base[d]), y - int(base[d])))
                done = [row(w, c) for w, c in zip(words, cuts, strict=True)]
                as_struct = lambda r: dict(zip(names, r, strict=True)) if r else None
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"), "n_words": pa.array(n), "runs": pa.array([[as_struct(r) for r in x[0]] for x in done], pa.list_(struct)),
                        "best": pa.array([as_struct(x[1]) for x in done], struct), "collapsed": pa.array([x[2] for x in done], pa.string())
                    }
                )

    return run


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), best (the run of greatest
    exponent) and collapsed (the words outside of runs and the first period of each, joined by one
    space); for each row of ``docs``. ``min_length`` is three times ``ANCHOR`` at least and
    ``min_repeats`` three: shorter runs need not repeat their anchors."""
    if min_length < 3 * ANCHOR or min_repeats < 3:
        raise ValueError(f"min_length must be {3 * ANCHOR} at least and min_repeats 3")
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_search(min_length, min_repeats), OUT)


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one text in ten (by a checksum of its id) goes round in its last words:
    word i >= a becomes word a + (i - a) % p. Texts with a null id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary"))
    text, words = F.col("text").cast("string"), F.filter(F.split(F.col("text").cast("string"), "[ \\t-\\r]+"), lambda w: w != "")
    g = F.floor(h / 10).cast("bigint")

    def turned(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")
        head, loop = F.slice(w, F.lit(1), a.cast("int")), F.slice(w, (a + 1).cast("int"), p.cast("int"))
        times = F.ceil((n - a) / p).cast("int")
        return F.array_join(F.slice(F.concat(head, F.flatten(F.array_repeat(loop, times))), F.lit(1), n.cast("int")), " ")

    # An inner lambda gives the list of words a name, so that it is made once.
    made = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, turned(w)).otherwise(F.lit(""))), 1)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(h % 10 == 0, made).otherwise(text).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_runs(looped(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    best = F.col("best")
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(F.lit(1000) * best["length"] / best["period"]).cast("bigint").alias("exponent_milli"),
        sha(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256")
    )


#: Runs by another way: word sequences of 8, 16, 32, ... words that come back within their own length,
#: at the nearest distance, one after the other.
OP12_SQL = r"""
WITH RECURSIVE ids AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
sums AS (SELECT rid, doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x % 2))))) AS h FROM ids),
sized AS (SELECT *, len(w) AS n, h // 10 AS g FROM sums),
cut AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM sized),
turn AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
docs AS MATERIALIZED (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM turn),
lv AS (SELECT rid, 1::BIGINT AS size, list_transform(w, lambda x: hash(x)) AS h FROM docs WHERE n >= 24
  UNION ALL SELECT rid, 2 * size, list_transform(range(1, len(h) - size + 1), lambda i: hash([h[i], h[i + size]])) FROM lv WHERE len(h) > 2 * size),
grams AS (SELECT rid, size, unnest(h) AS h, unnest(range(len(h))) AS pos FROM lv WHERE size >= 8),
near AS (SELECT *, pos - lag(pos) OVER (PARTITION BY rid, size, h ORDER BY pos) AS d FROM grams),
isle AS (SELECT *, pos - row_number() OVER (PARTITION BY rid, size, d ORDER BY pos) AS k FROM near WHERE d <= size),
found AS (SELECT rid, min(pos) - d AS start, max(pos) + size - min(pos) + d AS length, d AS period FROM isle GROUP BY rid, size, d, k),
runs AS MATERIALIZED (SELECT DISTINCT rid, start, length, period FROM found WHERE length >= greatest(24, 3 * period)),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length / period DESC, start, period) = 1),
told AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY rid),
lost AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS pos FROM runs),
words AS (SELECT rid, unnest(w) AS word, unnest(range(n)) AS pos FROM docs WHERE rid IN (SELECT rid FROM runs)),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY pos) AS t FROM words ANTI JOIN lost USING (rid, pos) GROUP BY rid)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
  sha256(coalesce(told.t, '')) AS runs_sha256, sha256(coalesce(kept.t, array_to_string(d.w, ' '))) AS collapsed_sha256
FROM docs d LEFT JOIN told USING (rid) LEFT JOIN best b USING (rid) LEFT JOIN kept USING (rid)
"""

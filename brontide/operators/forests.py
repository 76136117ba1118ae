"""Random forests of all folds, grown together on counted rows.

A tree sees of a row only the bin (of 32 at most) of each column, and its label. So rows that agree in these are one
row with their number n, and a bootstrap that draws each row by Poisson(1) draws them by Poisson(n). Trees, draws,
column subsets, Gini gains, least rows of a node and the merging of leaves that predict alike are those of Spark's own
forests, whose time grows with rows times trees; here it grows with different rows times trees. A level of all trees
of all fits is one job, or some jobs where their sums would be large; sums are whole numbers, and draws depend on the
bins alone, so the order of rows doesn't matter.

Splits of a column lie where Spark's lie, halfway between neighbouring values: between all of them if there are 32 at most,
else so that the weighted rows are cut into even parts, by a quantile sketch of each item and class. What comes
back to the driver are these sketches, seven numbers for each node, and the trees.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import Folded, _matrix, array_sums
from .staging import stored

BINS = 32
SKETCH, FEW = 512, 64  # quantiles of an item, class and column; distinct values up to which these are asked for
TOGETHER = 8  # fits grown at a time
NUMBERS = 1 << 22  # a task's sums at a time, 32 MB
NODES, ROWS, KNOWN = 64, 1024, 1 << 16  # nodes that are one group, rows that are walked down at a time, scores that a task keeps


def binned(x: np.ndarray, median: np.ndarray, splits: list[np.ndarray]) -> np.ndarray:
    """How many splits of its column each value lies above; NaN is the median."""
    return np.stack([np.searchsorted(s, np.where(np.isnan(v), m, v)) for v, m, s in zip(x.T, median, splits, strict=True)], 1).astype(np.uint8)


def even_splits(values: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Splits that cut ascending values with their masses into about even parts, as Spark's trees set them."""
    step, out = mass.sum() / BINS, []
    upto, target = mass[0], step
    for i in range(1, len(values)):
        before, upto = upto, upto + mass[i]
        if abs(before - target) < abs(upto - target) and len(out) < BINS - 1:
            out.append(values[i - 1] / 2 + values[i] / 2)
            target += step
    return np.array(out)


def walked(bins: np.ndarray, left: np.ndarray, column: np.ndarray, at: np.ndarray, trees: int) -> np.ndarray:
    """The node of each row in each tree, as far down as it goes; the first nodes are the roots, a right child follows its left one."""
    now, row = np.tile(np.arange(trees), (len(bins), 1)), np.arange(len(bins))[:, None]
    while True:
        down = left[now]
        inner = down >= 0
        if not inner.any():
            return now
        now = np.where(inner, down + (bins[row, column[now]] > at[now]), now)


def best_splits(sums: np.ndarray, width: int, weight: np.ndarray, least: int) -> np.ndarray:
    """For each node its best gain, place of the column, bin, rows by class up to that bin, and all its rows by class."""
    h = sums.reshape(-1, width, BINS, 2).astype(np.float64)
    low, whole = h.cumsum(2)[:, :, :-1], h[:, :1].sum(2, keepdims=True)
    high = whole - low

    def weighed(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = n * weight
        total = w.sum(-1)
        return total, 1 - (w**2).sum(-1) / np.where(total > 0, total, 1) ** 2

    (all_, g), (a, g_low), (b, g_high) = weighed(whole), weighed(low), weighed(high)
    gain = g - (a * g_low + b * g_high) / np.where(all_ > 0, all_, 1)
    gain[(low.sum(-1) < least) | (high.sum(-1) < least)] = -1.0
    gain = gain.reshape(len(h), -1)
    i = gain.argmax(1)
    node, place, bin_ = np.arange(len(h)), i // (BINS - 1), i % (BINS - 1)
    return np.column_stack([gain[node, i], place, bin_, low[node, place, bin_], whole[:, 0, 0]])


class FoldedForest(Folded):
    """Forests of ``numTrees`` trees; a node of ``maxDepth``, one that has rows of one class, or one that no split into two of at least
    ``minInstancesPerNode`` rows makes purer is a leaf. A node chooses among ceil(sqrt(columns)) columns."""

    def __init__(
        self, frame: DataFrame, item: str, columns: list[str], items: list, available: str, seed: int, numTrees: int, maxDepth: int, minInstancesPerNode: int
    ):
        super().__init__(frame, item, columns, items, available)
        self.seed, self.trees, self.depth, self.least = seed, numTrees, maxDepth, max(1, minInstancesPerNode)
        self.width = math.ceil(math.sqrt(len(columns)))

    def _fitted(self, fits: list[frozenset]) -> list[tuple]:
        out = []
        for i in range(0, len(fits), TOGETHER):
            kept, classes, present, median = self._kept(fits[i : i + TOGETHER])
            weight = classes.sum(1)[:, None] / (2 * classes)
            splits = self._splits(kept, classes, present, median, weight)
            grown = self._grown(self._cells(kept, median, splits), weight)
            out += [(m, s, *g) for m, s, g in zip(median, splits, grown, strict=True)]
        return out

    @staticmethod
    def scorer(model: tuple) -> Callable[[np.ndarray], np.ndarray]:
        """Mean over the trees of the weighted share of class 1 in the row's leaf. Trees are walked once for rows of the same bins."""
        median, splits, trees, left, column, at, share = model
        known: dict[bytes, float] = {}

        def score(x: np.ndarray) -> np.ndarray:
            rows = np.ascontiguousarray(binned(x, median, splits))
            keys, of = np.unique(rows.view(f"S{rows.shape[1]}").reshape(-1), return_inverse=True)
            rows, keys = keys.view(np.uint8).reshape(len(keys), -1), keys.tolist()
            if len(known) + len(keys) > KNOWN:
                known.clear()
            new = [i for i, key in enumerate(keys) if key not in known]
            for i in range(0, len(new), ROWS):
                some = new[i : i + ROWS]
                leaves = share[walked(rows[some], left, column, at, trees)]
                known.update(zip((keys[j] for j in some), np.nanmean(leaves, 1).tolist(), strict=True))
            return np.array([known[key] for key in keys])[of]

        return score

    def _splits(self, kept: np.ndarray, classes: np.ndarray, present: np.ndarray, median: np.ndarray, weight: np.ndarray) -> list[list[np.ndarray]]:
        """By fit and column, ascending splits."""
        d = len(self.columns)
        x = [F.nanvl(F.col("_x")[c], F.lit(None).cast("double")) for c in range(d)]
        at = F.array(*[F.lit((i + 0.5) / SKETCH) for i in range(SKETCH)])
        each = [F.struct(F.count(v), F.percentile_approx(v, at, F.lit(10 * SKETCH)), F.approx_count_distinct(v)).alias(f"c{c}") for c, v in enumerate(x)]
        got = self.train.groupBy("_item", "_y").agg(F.count("*").alias("n"), *each).collect()
        few = [c for c in range(d) if all(r[f"c{c}"][2] <= FEW for r in got)]
        sets = self.train.groupBy("_item").agg(*[F.collect_set(x[c]).alias(f"c{c}") for c in few]).collect() if few else []
        out = []
        for f in range(len(kept)):
            mine, here = [r for r in got if kept[f, r._item]], []
            for c in range(d):
                middle = [median[f, c]] if present[f, c] < classes[f].sum() else []
                values = sorted({v for r in sets if kept[f, r._item] for v in r[f"c{c}"]} | set(middle)) if c in few else []
                if c not in few or len(values) > BINS:
                    points = [(v, r[f"c{c}"][0] / SKETCH * weight[f, int(r._y)]) for r in mine for v in r[f"c{c}"][1] or ()]
                    points += [(v, (r.n - r[f"c{c}"][0]) * weight[f, int(r._y)]) for r in mine for v in middle]
                    values, of = np.unique([v for v, _ in points], return_inverse=True)
                    here.append(even_splits(values, np.bincount(of, [m for _, m in points])))
                else:
                    here.append(np.array([a / 2 + b / 2 for a, b in zip(values, values[1:], strict=False)]))
            out.append(here)
        return out

    def _cells(self, kept: np.ndarray, median: np.ndarray, splits: list[list[np.ndarray]]) -> DataFrame:
        """f, the number of a fit; key, a byte for the bin of each column and one for the label; n, its training rows with these."""
        d = len(self.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                item, y, x = batch.column("_item").to_numpy(), batch.column("_y").to_numpy(), _matrix(batch, "_x", d)
                for f in range(len(kept)):
                    mine = kept[f][item] > 0
                    if not mine.any():
                        continue
                    rows = np.ascontiguousarray(np.column_stack([binned(x[mine], median[f], splits[f]), y[mine].astype(np.uint8)]))
                    keys, n = np.unique(rows.view(f"S{d + 1}").reshape(-1), return_counts=True)
                    ends = np.arange(0, len(keys) * (d + 1) + 1, d + 1, dtype=np.int32)
                    key = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(keys.tobytes())])
                    yield pa.record_batch([pa.array(np.full(len(keys), f, np.int32)), key, pa.array(n.astype(np.int64))], names=["f", "key", "n"])

        cells = self.train.mapInArrow(run, "f int, key binary, n bigint")
        return stored(cells.groupBy("f", "key").agg(F.sum("n").alias("n")), "cells")

    def _grown(self, cells: DataFrame, weight: np.ndarray) -> list[tuple]:
        """By fit: the trees' number, and for each node the left child (-1: a leaf), the column and last bin to the left, and class 1's weighted share."""
        n_fits, d, width = len(weight), len(self.columns), self.width
        left = [[-1] * self.trees for _ in range(n_fits)]
        column, at, rows = ([[0] * self.trees for _ in range(n_fits)] for _ in range(3))
        front = [(f, t) for f in range(n_fits) for t in range(self.trees)]
        draws = [np.random.default_rng(self.seed) for _ in range(n_fits)]  # one a fit: what others grow changes nothing
        for level in range(max(1, self.depth)):
            opened: list[tuple[int, int]] = []
            step = NUMBERS // (width * BINS * 2)
            open_ = np.bincount([f for f, _ in front], minlength=n_fits)
            order = np.concatenate([draws[f].permuted(np.tile(np.arange(d), (n, 1)), axis=1) for f, n in enumerate(open_)])
            subsets = np.sort(order[:, :width], 1)
            for i in range(0, len(front), step):
                some, subset = front[i : i + step], subsets[i : i + step]
                packed = [tuple(np.array(a[f], np.int32) for a in (left, column, at)) for f in range(n_fits)]
                found = self._found(cells, packed, some, subset, weight)
                for (f, node), columns, v in zip(some, subset, found, strict=True):
                    low, whole = v[3:5], v[5:7]
                    if level == 0:
                        rows[f][node] = whole
                    if v[0] <= 0 or self.depth == 0:
                        continue
                    left[f][node], column[f][node], at[f][node] = len(left[f]), int(columns[int(v[1])]), int(v[2])
                    for n in (low, whole - low):
                        if level + 1 < self.depth and n.all() and n.sum() >= 2 * self.least:
                            opened.append((f, len(left[f])))
                        left[f].append(-1)
                        column[f].append(0)
                        at[f].append(0)
                        rows[f].append(n)
            front = opened
            if not front:
                break
        return [(self.trees, *merged(np.array(left[f], np.int32), np.array(rows[f]) * weight[f], np.array(column[f], np.int32), np.array(at[f], np.int32))) for f in range(n_fits)]

    def _found(self, cells: DataFrame, packed: list[tuple], some: list[tuple[int, int]], subset: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """:func:`best_splits` of these nodes (fit, node), each among its columns."""
        trees, width, least, seed, d = self.trees, self.width, self.least, self.seed.to_bytes(8, "little", signed=True), len(self.columns)
        first = {f: [g for g, _ in some].index(f) for f in {f for f, _ in some}}  # a fit's nodes are together
        slot = {f: np.full(len(packed[f][0]), -1) for f in first}
        for i, (f, node) in enumerate(some):
            slot[f][node] = i - first[f]
        columns = {f: subset[first[f] : first[f] + int((slot[f] >= 0).sum())] for f in first}
        packed = {f: packed[f] for f in first}
        size = width * BINS * 2

        def partial(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            fit, n = batch.column("f").to_numpy(), batch.column("n").to_numpy()
            keys, out = batch.column("key").to_pylist(), {}
            for f in np.unique(fit):
                if f not in slot:
                    continue
                mine, sums = np.flatnonzero(fit == f), np.zeros(len(columns[f]) * size, np.int64)
                for i in range(0, len(mine), ROWS):
                    here = mine[i : i + ROWS]
                    key = np.frombuffer(b"".join(keys[j] for j in here), np.uint8).reshape(-1, d + 1)
                    bins, y = key[:, :-1], key[:, -1].astype(np.int64)
                    drawn = np.stack([_generator(seed, keys[j]).poisson(n[j], trees) for j in here])
                    s = slot[f][walked(bins, *packed[f], trees)]
                    row, tree = np.nonzero((s >= 0) & (drawn > 0))
                    s, drawn = s[row, tree], drawn[row, tree]
                    for k in range(width):
                        b = bins[row, columns[f][s, k]].astype(np.int64)
                        np.add.at(sums, ((s * width + k) * BINS + b) * 2 + y[row], drawn)
                for i in range(0, len(columns[f]), NODES):
                    part = sums[i * size : (i + NODES) * size]
                    if part.any():
                        out[f"{f}:{i}"] = part
            return out

        finish = lambda key, sums: best_splits(sums, width, weight[int(key.split(":")[0])], least).reshape(-1)
        got = array_sums(cells, partial, "int64", finish)
        out = np.zeros((len(some), 7))
        for key, v in got.items():
            f, i = map(int, key.split(":"))
            v = v.reshape(-1, 7)
            out[first[f] + i : first[f] + i + len(v)] = v
        return out


def _generator(seed: bytes, key: bytes) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(key, digest_size=16, key=seed).digest(), "little"))


def merged(left: np.ndarray, rows: np.ndarray, column: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Two leaves that predict the same class become one, from below; ``rows``: weighted, by class."""
    left, class_ = left.copy(), rows[:, 1] > rows[:, 0]
    for node in range(len(left) - 1, -1, -1):  # children come after their parents
        c = left[node]
        if c >= 0 and left[c] < 0 and left[c + 1] < 0 and class_[c] == class_[c + 1]:
            left[node] = -1
    total = rows.sum(1)
    return left, column, at, np.where(total > 0, rows[:, 1] / np.where(total > 0, total, 1), np.nan)

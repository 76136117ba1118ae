"""Models of all folds of a nested cross-validation, fitted together: what kinds of models share, and logistic ones.

A fold leaves out one item (outer) or two (inner: the held item and the one that is scored). Fits
differ in what they leave out, so sums by item serve them all: counts, medians, means and
spreads of a fit are those of all items less those of the items left out. Logistic models
themselves are found by Newton's method; a step is one job in which each task adds up
gradient, Hessian and loss of every fit over its rows, so the number of jobs is that of the
steps, however many folds there are. Medians are exact: eight jobs narrow the range of
values in which each one lies by a factor of 256.

What comes back to the driver are sums, at most 256 numbers an item and range of a column and
(columns + 1)**2 numbers a fit, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import stored

STEPS, TOLERANCE = 60, 1e-10


def array_sums(
    df: DataFrame, partial: Callable[[pa.RecordBatch], dict[str, np.ndarray]], dtype: str, finish: Callable[[str, np.ndarray], np.ndarray] | None = None
) -> dict[str, np.ndarray]:
    """The sums, by key, of the arrays that ``partial`` makes of each batch; each task adds up its own first.
    With ``finish``, the numbers that it makes of a key and its sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for k, v in partial(batch).items():
                    total[k] = total[k] + v if k in total else v
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array([np.ascontiguousarray(v, dtype).tobytes() for v in total.values()], pa.binary())], names=["key", "value"])

    def add(t: pa.Table) -> pa.Table:
        value, key = sum(np.frombuffer(v, dtype) for v in t.column("value").to_pylist()), t.column("key")[0].as_py()
        value = value if finish is None else np.ascontiguousarray(finish(key, value), "float64")
        return pa.table({"key": pa.array([key]), "value": pa.array([value.tobytes()], pa.binary())})

    parts = df.mapInArrow(run, "key string, value binary")
    rows = parts.groupBy("key").applyInArrow(add, "key string, value binary").collect()  # one a key
    return {r.key: np.frombuffer(bytes(r.value), "float64" if finish else dtype) for r in rows}


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """Null and NaN are missing, and both come as NaN."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the numbers."""
    bits = (x + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top, ~bits, bits | top)


def unordered(key: np.ndarray) -> np.ndarray:
    top = np.uint64(1 << 63)
    return np.where(key & top, key & ~top, ~key).view(np.float64)


class Folded:
    """``frame``: the item's column, label (0, 1), training_eligible, the column ``available``, and the
    numeric ``columns``. Weights balance the classes of each fit, and missing values become the fit's
    medians. A fit without both classes stops the job. A kind of models has ``_fitted``, the models of several
    fits, and ``scorer``, what gives one model's probabilities of class 1 for a matrix."""

    def __init__(self, frame: DataFrame, item: str, columns: list[str], items: list, available: str = "available"):
        self.item, self.columns, self.items, self.available = item, columns, sorted(items), available
        self.at = {v: i for i, v in enumerate(self.items)}
        if len(self.items) < 2:
            raise ValueError("Calibration-limited: fewer than two items")
        number = F.array_position(F.array(*map(F.lit, self.items)), F.col(item)) - 1
        self.frame = frame.withColumns({"_item": number.cast("int"), "_x": F.array(*[F.col(c).cast("double") for c in columns])})
        self.models: dict[frozenset, tuple[np.ndarray, ...]] = {}
        self._train: DataFrame | None = None

    @property
    def train(self) -> DataFrame:
        if self._train is None:
            usable = F.col("training_eligible") & F.col(self.available) & F.col("label").isin(0, 1) & (F.col("_item") >= 0)
            self._train = stored(self.frame.where(usable).select("_item", F.col("label").cast("double").alias("_y"), "_x"), "folds")
        return self._train

    def fit(self, excluded: list[frozenset]) -> None:
        """Models of the fits that leave out these sets of items, in one go."""
        fits = [e for e in dict.fromkeys(excluded) if e not in self.models]
        if not fits:
            return
        self.models |= zip(fits, self._fitted(fits), strict=True)

    def _kept(self, fits: list[frozenset]) -> tuple[np.ndarray, ...]:
        """By fit: the items it keeps, its rows by class, and for each column the values present and their median."""
        n_items, d = len(self.items), len(self.columns)
        kept = np.array([[v not in e for v in self.items] for e in fits], np.float64)  # fit x item
        sums = self._first_sums()
        classes = kept @ sums["n"].reshape(n_items, 2)
        if (classes == 0).any():
            bad = fits[int(np.argwhere(classes == 0)[0, 0])]
            raise ValueError(f"Calibration-limited: one class only without {sorted(bad)}")
        present = kept @ sums["present"].reshape(n_items, d)
        return kept, classes, present, self._medians(kept, present)

    def _first_sums(self) -> dict[str, np.ndarray]:
        n_items, d = len(self.items), len(self.columns)

        def partial(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            item, y, x = batch.column("_item").to_numpy(), batch.column("_y").to_numpy(), _matrix(batch, "_x", d)
            present = np.zeros((n_items, d), np.int64)
            np.add.at(present, item, ~np.isnan(x))
            return {"n": np.bincount(item * 2 + y.astype(np.int64), minlength=2 * n_items), "present": present.reshape(-1)}

        got = array_sums(self.train, partial, "int64")
        return {"n": np.zeros(2 * n_items), "present": np.zeros(n_items * d)} | got

    def _medians(self, kept: np.ndarray, present: np.ndarray) -> np.ndarray:
        """Exact medians by fit and column, 0 without any value."""
        n_items, d = len(self.items), len(self.columns)
        count = present.astype(np.int64)
        rank = np.stack([(count - 1) // 2, count // 2])  # the one or two values in the middle
        prefix = np.zeros(rank.shape, np.uint64)
        for step in range(8):
            shift = np.uint64(56 - 8 * step)
            active = [np.unique(prefix[:, :, c][:, count[:, c] > 0]).tolist() for c in range(d)]

            def partial(batch: pa.RecordBatch, shift=shift, active=active, step=step) -> dict[str, np.ndarray]:
                item, x = batch.column("_item").to_numpy().astype(np.int64), _matrix(batch, "_x", d)
                out = {}
                for c in range(d):
                    there = ~np.isnan(x[:, c])
                    key, of = ordered(x[there, c]) >> shift, item[there]
                    byte, high = (key & np.uint64(255)).astype(np.int64), key >> np.uint64(8)
                    for p in active[c]:
                        mine = high == np.uint64(p) if step else slice(None)
                        out[f"{c}:{p}"] = np.bincount(of[mine] * 256 + byte[mine], minlength=n_items * 256)
                return out

            got = array_sums(self.train, partial, "int64")
            for c in range(d):
                for p in active[c]:
                    here = (prefix[:, :, c] == np.uint64(p)) & (count[:, c] > 0)
                    upto = np.cumsum(kept @ got[f"{c}:{p}"].reshape(n_items, 256), 1)  # fit x byte
                    for side, f in np.argwhere(here):
                        b = int(np.searchsorted(upto[f], rank[side, f, c], side="right"))
                        rank[side, f, c] -= int(upto[f, b - 1]) if b else 0
                        prefix[side, f, c] = np.uint64(p << 8 | b)
        return np.where(count > 0, unordered(prefix[0]) / 2 + unordered(prefix[1]) / 2, 0.0)

    def _scored(self, fits_of: Callable[[int], list[frozenset | None]], name: str) -> DataFrame:
        """Rows of the items, one for each fit that scores them, with ``name`` (what the fit holds out) and score."""
        d, items, at, scorer = len(self.columns), self.items, self.available, self.scorer
        plans = [fits_of(i) for i in range(len(items))]
        models = {e: self.models[e] for p in plans for e in p if e is not None}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score = {e: scorer(m) for e, m in models.items()}
            for batch in batches:
                x, item = _matrix(batch, "_x", d), batch.column("_item").to_numpy(zero_copy_only=False)
                ok = np.array(batch.column(at).to_pylist(), object) == True  # noqa: E712
                out = np.full((len(x), len(items)), np.nan)
                for i, plan in enumerate(plans):
                    mine = np.flatnonzero((item == i) & ok)
                    for j, e in enumerate(plan):
                        if e is not None and len(mine):
                            out[mine, j] = score[e](x[mine])
                rest = [n for n in batch.schema.names if n not in ("_x",)]
                lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, len(items), dtype=np.int32), pa.array(out.reshape(-1), from_pandas=True))
                yield pa.record_batch([*[batch.column(n) for n in rest], lists], names=[*rest, "_scores"])

        rows = self.frame.where("_item >= 0")
        schema = T.StructType([*[f for f in rows.schema.fields if f.name != "_x"], T.StructField("_scores", T.ArrayType(T.DoubleType()))])
        out = rows.mapInArrow(run, schema).withColumn("_holds", F.array(*[F.array(*[F.lit(e is not None) for e in p]) for p in plans])[F.col("_item")])
        out = out.select(*[c for c in rows.columns if c not in ("_x", "_item")], F.posexplode(F.arrays_zip("_scores", "_holds")).alias("_j", "_s"))
        held = F.array(*map(F.lit, items))[F.col("_j")].alias(name)
        return out.where("_s._holds").select(*[c for c in out.columns if c not in ("_j", "_s")], F.col("_s._scores").alias("score"), held)

    def outer(self) -> DataFrame:
        """Each item's rows, scored by the model of all others; fold: the item."""
        self.fit([frozenset([v]) for v in self.items])
        return self._scored(lambda i: [frozenset([v]) if j == i else None for j, v in enumerate(self.items)], "fold")

    def inner(self, held: list | None = None) -> DataFrame:
        """Each item's rows, scored, for every other item that is held out (or those of ``held``), by the
        model of all but the two: what thresholds are chosen on before the held item is scored."""
        held = self.items if held is None else held
        if len(self.items) < 3:
            raise ValueError("Calibration-limited: fewer than two inner items")
        self.fit([frozenset(p) for p in combinations(self.items, 2) if set(p) & set(held)])
        return self._scored(lambda i: [frozenset([v, self.items[i]]) if j != i and v in held else None for j, v in enumerate(self.items)], "held")


class FoldedLogistic(Folded):
    """Logistic models: the penalty is half the squared coefficients, and columns are centred and scaled by the fit's spread."""

    def _fitted(self, fits: list[frozenset]) -> list[tuple]:
        kept, median, mean, spread, weight = self._scales(fits)
        return list(zip(median, mean, spread, self._newton(kept, median, mean, spread, weight), strict=True))

    @staticmethod
    def scorer(model: tuple) -> Callable[[np.ndarray], np.ndarray]:
        median, mean, spread, beta = model
        return lambda x: 0.5 * (1 + np.tanh((((np.where(np.isnan(x), median, x) - mean) / spread) @ beta[1:] + beta[0]) / 2))

    def _scales(self, fits: list[frozenset]) -> tuple[np.ndarray, ...]:
        """By fit: the items it keeps, and for each column the median, mean and spread; the weights of both classes."""
        kept, classes, present, median = self._kept(fits)
        n = classes.sum(1)
        base = np.nanmedian(median, 0)
        moments = self._moments(base)
        absent, off = n[:, None] - present, median - base
        s1 = kept @ moments[:, 0] + absent * off
        s2 = kept @ moments[:, 1] + absent * off**2
        mean = s1 / n[:, None]
        spread = np.sqrt(np.maximum(s2 / n[:, None] - mean**2, 0))
        spread[spread == 0] = 1.0
        return kept, median, mean + base, spread, n[:, None] / (2 * classes)

    def training_rows(self) -> DataFrame:
        """What the outer fits are fitted on: for each item that is held out the others' training rows, with
        ``held``, ``weight`` and ``z``, the columns imputed and standardised as that fit has them."""
        kept, median, mean, spread, weight = self._scales([frozenset([v]) for v in self.items])
        numbers = lambda a: F.array(*[F.lit(float(x)) for x in a])
        each = [
            F.struct(
                F.lit(v).alias("held"), F.lit(i).alias("at"), numbers(weight[i]).alias("w"), numbers(median[i]).alias("m"), numbers(mean[i]).alias("a"),
                numbers(spread[i]).alias("s")
            )
            for i, v in enumerate(self.items)
        ]
        usable = F.col("training_eligible") & F.col(self.available) & F.col("label").isin(0, 1) & (F.col("_item") >= 0)
        d = self.frame.where(usable).withColumn("_f", F.explode(F.filter(F.array(*each), lambda f: f["at"] != F.col("_item"))))
        one = lambda x, i: (F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.col("_f.m")[i]) - F.col("_f.a")[i]) / F.col("_f.s")[i]
        z = F.transform("_x", one)
        return d.select(*[c for c in self.frame.columns if c not in ("_item", "_x", "_f")], "_f.held", F.col("_f.w")[F.col("label").cast("int")].alias("weight"), z.alias("z"))

    def _moments(self, base: np.ndarray) -> np.ndarray:
        """Sums and squared sums about ``base`` of the values present, by item: item x 2 x column."""
        n_items, d = len(self.items), len(self.columns)

        def partial(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            x, out = np.nan_to_num(_matrix(batch, "_x", d) - base), np.zeros((n_items, 2, d))
            np.add.at(out, batch.column("_item").to_numpy(), np.stack([x, x * x], 1))
            return {"m": out.reshape(-1)}

        return array_sums(self.train, partial, "float64")["m"].reshape(n_items, 2, d)

    def _newton(self, kept, median, mean, spread, weight) -> np.ndarray:
        """fit x (intercept and coefficients)."""
        n_fits, d = median.shape
        takes = [np.flatnonzero(kept[:, i]) for i in range(kept.shape[1])]
        penalty = np.diag(np.append(0.0, np.ones(d)))

        def sums(beta: np.ndarray, open_: set) -> dict[str, np.ndarray]:
            def partial(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
                item, y, x = batch.column("_item").to_numpy(), batch.column("_y").to_numpy(), _matrix(batch, "_x", d)
                out: dict[str, np.ndarray] = {}
                for i in np.unique(item):
                    xi, yi = x[item == i], y[item == i]
                    gone, z = np.isnan(xi), np.ones((len(xi), d + 1))
                    for f in takes[i]:
                        if f not in open_:
                            continue
                        z[:, 1:] = (np.where(gone, median[f], xi) - mean[f]) / spread[f]
                        eta, w = z @ beta[f], np.where(yi == 1, weight[f, 1], weight[f, 0])
                        p = 0.5 * (1 + np.tanh(eta / 2))
                        loss = (w * (np.logaddexp(0, eta) - yi * eta)).sum()
                        v = np.concatenate([[loss], z.T @ (w * (p - yi)), ((z * (w * p * (1 - p))[:, None]).T @ z).reshape(-1)])
                        out[str(f)] = out[str(f)] + v if str(f) in out else v
                return out

            return array_sums(self.train, partial, "float64")

        beta, step = np.zeros((n_fits, d + 1)), np.zeros((n_fits, d + 1))
        loss, open_ = np.full(n_fits, np.inf), set(range(n_fits))
        for _ in range(STEPS):
            if not open_:
                return beta
            got = sums(beta, open_)
            for f in sorted(open_):
                v = got[str(f)]
                now = v[0] + 0.5 * (beta[f, 1:] ** 2).sum()
                if now > loss[f] + 1e-12 * abs(loss[f]):  # too far: half the way back
                    step[f] /= 2
                    beta[f] -= step[f]
                    continue
                loss[f] = now
                gradient = v[1 : d + 2] + penalty @ beta[f]
                step[f] = -np.linalg.solve(v[d + 2 :].reshape(d + 1, d + 1) + penalty, gradient)
                beta[f] += step[f]
                if np.abs(step[f]).max() <= TOLERANCE * (1 + np.abs(beta[f]).max()):
                    open_.discard(f)
        raise ValueError("the models don't converge")

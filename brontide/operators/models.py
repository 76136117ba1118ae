"""Imputation, scaling and group-held-out models. All folds are fitted together, logistic ones by :mod:`.folds` and
forests by :mod:`.forests`; single fits, and models with other parameters than these take, by pyspark.ml."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fusion as U
from .folds import Folded, FoldedLogistic
from .forests import FoldedForest
from .ranges import quantiles

PARALLEL = 4  # single fits at a time


def fit_scaler(train: DataFrame, columns: list[str], label: str = "label") -> tuple[dict[str, tuple[float, float, float]], dict[int, int]]:
    """(median (0 without any value), mean and population spread after imputation of each column; rows by
    class). Medians are exact and no task holds a column; a row a column comes back."""
    long = train.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    medians = {r.column: r.median for r in quantiles(long, ["column"], "value", {"median": 0.5}).collect()}
    first = {c: medians.get(c, 0.0) for c in columns}
    filled = [F.coalesce(F.col(c), F.lit(first[c])) for c in columns]
    s = train.agg(
        *[F.avg(x).alias(f"{c}__m") for c, x in zip(columns, filled, strict=True)],
        *[F.stddev_pop(x).alias(f"{c}__s") for c, x in zip(columns, filled, strict=True)], F.count_if(F.col(label) == 0).alias("_n0"),
        F.count_if(F.col(label) == 1).alias("_n1")
    ).first()
    return {c: (first[c], s[f"{c}__m"] or 0.0, s[f"{c}__s"] or 1.0) for c in columns}, {0: s["_n0"], 1: s["_n1"]}


def scaled(df: DataFrame, scaler: dict[str, tuple[float, float, float]]) -> DataFrame:
    cols = {c: (F.coalesce(F.col(c), F.lit(m)) - mean) / sd for c, (m, mean, sd) in scaler.items()}
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(df.withColumns(cols))


def balanced(train: DataFrame, n: dict[int, int], label: str = "label") -> DataFrame:
    """Adds weight n / (2 n_class). ``n``: rows by class."""
    if not n[0] or not n[1]:
        raise ValueError("Calibration-limited: one class only")
    total = n[0] + n[1]
    return train.withColumn("weight", F.when(F.col(label) == 1, total / (2 * n[1])).otherwise(total / (2 * n[0])))


#: The forests, and those of the older benchmarks, whose trees are not bounded (Spark's limit is 30 levels).
FORESTS = {
    "forest": {"numTrees": 300, "maxDepth": 6, "minInstancesPerNode": 5},
    "older_smoke": {"numTrees": 250, "maxDepth": 30, "minInstancesPerNode": 2},
    "older_patient": {"numTrees": 300, "maxDepth": 30, "minInstancesPerNode": 2},
}


def estimator(kind: str, total_weight: float, seed: int):
    if kind == "logistic":
        return LogisticRegression(
            regParam=1.0 / total_weight, elasticNetParam=0.0, standardization=False, weightCol="weight", labelCol="label", maxIter=200, tol=1e-9
        )
    if kind in FORESTS:
        return RandomForestClassifier(**FORESTS[kind], featureSubsetStrategy="sqrt", weightCol="weight", labelCol="label", seed=seed)
    raise ValueError(f"unknown model: {kind}")


class HeldOutModels:
    """Fits that never see the rows of held-out items; one fit for each set of training items."""

    def __init__(
        self, frame: DataFrame, item: str, columns: list[str], kind: str = "logistic", seed: int = 20260922, available: str = "available", **params
    ):
        self.frame, self.item, self.columns, self.kind, self.seed, self.available, self.params = frame, item, columns, kind, seed, available, params
        self.cache: dict[tuple, tuple] = {}

    def fit(self, train: list, forbidden: list):
        if not train or set(train) & set(forbidden):
            raise ValueError("no training items, or some that are held out")
        key = tuple(sorted(train))
        if key not in self.cache:
            rows = self.frame.where(F.col(self.item).isin(list(train)) & F.col("training_eligible") & F.col(self.available))
            scaler, n = fit_scaler(rows, self.columns)
            est = estimator(self.kind, float(n[0] + n[1]), self.seed)
            est = est.copy({est.getParam(k): v for k, v in self.params.items()})
            self.cache[key] = (scaler, est.fit(scaled(balanced(rows, n), scaler)))
        return self.cache[key]

    def score(self, train: list, test: list, forbidden: list = ()) -> DataFrame:
        """Rows of the test items with ``score``, the probability of class 1, null when unavailable."""
        scaler, model = self.fit(train, [*test, *forbidden])
        rows = self.frame.where(F.col(self.item).isin(list(test)))
        out = model.transform(scaled(rows, scaler)).withColumn("score", vector_to_array("probability")[1])
        return out.withColumn("score", F.when(F.col(self.available), F.col("score"))).drop("features", "rawPrediction", "probability", "prediction")

    def folded(self, items: list) -> Folded | None:
        """All folds of these items at once, where the models allow it."""
        key = ("folded", tuple(sorted(items)))
        if key not in self.cache:
            common = (self.frame, self.item, self.columns, items, self.available)
            if self.kind == "logistic" and not self.params:
                self.cache[key] = FoldedLogistic(*common)
            elif self.kind in FORESTS and self.params.keys() <= FORESTS[self.kind].keys():
                self.cache[key] = FoldedForest(*common, self.seed, **FORESTS[self.kind] | self.params)
        return self.cache.get(key)

    def _each(self, fits: list[tuple[list, list, list, str, object]]) -> DataFrame:
        """Scores of several fits (train, test, forbidden, name of a column, its value), fitted side by side."""
        with ThreadPoolExecutor(PARALLEL) as pool:
            parts = list(pool.map(lambda f: self.score(*f[:3]).withColumn(f[3], F.lit(f[4])), fits))
        return _stacked(parts)

    def inner(self, items: list, held=None) -> DataFrame:
        """Scores of each item but ``held`` from all items but it and ``held``: what thresholds are chosen
        on; of all items in turn without ``held``."""
        if len(items) < 3 and (held is None or held in items) or len(items) < 2:
            raise ValueError("Calibration-limited: fewer than two inner items")
        if folded := self.folded(items if held is None else [*{*items, held}]):
            return folded.inner(None if held is None else [held])
        return self._each(
            [([i for i in items if i not in (h, v)], [v], [h], "held", h) for h in (sorted(items) if held is None else [held]) for v in sorted(items) if v != h]
        )

    def nested(self, items: list) -> DataFrame:
        """Outer scores of each item from all others; :meth:`inner` gives what was to be known before."""
        if folded := self.folded(items):
            return folded.outer()
        return self._each([([i for i in items if i != held], [held], [], "fold", held) for held in sorted(items)])


def _stacked(parts) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


class FusionModels:
    """Three models on one timeline: of the first modality, the second, and both (with the second's columns
    null where it is unavailable). Their scores come side by side, one row a decision."""

    def __init__(self, frame: DataFrame, item: str, first: list[str], second: list[str], keys: list[str], kind: str = "forest", **params):
        self.keys, self.item = keys, item
        early = frame.withColumns({f"early__{c}": F.when(F.col("available2"), F.col(c)) for c in second})
        of = lambda cols, ok: HeldOutModels(early, item, cols, kind, available=ok, **params)
        self.models = {
            "score_e": of(first, "available"), "score_c": of(second, "available2"),
            "score_early": of([*first, *[f"early__{c}" for c in second]], "available")
        }

    def inner(self, items: list, held=None) -> DataFrame:
        """Inner scores of the fold that leaves ``held`` out, or of all folds, each named by ``held``."""
        return self._joined({n: m.inner(items, held) for n, m in self.models.items()}, ["held"])

    def outer(self, items: list) -> DataFrame:
        return self._joined({n: m.nested(items) for n, m in self.models.items()}, ["fold"])

    def _joined(self, scores: dict[str, DataFrame], more: list[str]) -> DataFrame:
        out = None
        for name, s in scores.items():
            s = s.select(*self.keys, self.item, *more, F.col("score").alias(name))
            out = s if out is None else U.align(out, s, [*self.keys, self.item, *more])
        return out


def negative_sample(df: DataFrame, group: list[str], key: str, seed: int, ratio: int) -> DataFrame:
    """All positives, and of each group's negatives ``ratio`` for each positive, by a seeded hash."""
    from pyspark.sql import Window as W

    n_pos = F.count_if(F.col("label") == 1).over(W.partitionBy(*group))
    draw = F.row_number().over(W.partitionBy(*group, "label").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key))
    return df.withColumns({"_p": n_pos, "_d": draw}).where((F.col("label") == 1) | (F.col("_d") <= ratio * F.col("_p"))).drop("_p", "_d")

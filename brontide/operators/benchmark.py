"""The older benchmarks: forests of each modality and of both, with every item held out in turn; the fixed mean of
the first two; and their measures by fold, pooled, and as means over the folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics as Q
from .models import HeldOutModels
from .staging import stored

#: The models' names, and the weight of the second modality in the last one.
FIRST, SECOND, EARLY, LATE = "EEG_only", "ECG_only", "Early_fusion", "Late_fusion_alpha_0.5"
ALPHA = 0.5
#: Names of the measures, by those of :mod:`.metrics`.
MEASURES = {
    "roc_auc": "roc_auc", "average_precision": "average_precision", "recall": "sensitivity_at_0_5", "precision": "precision_at_0_5",
    "f1": "f1_at_0_5", "balanced_accuracy": "balanced_accuracy_at_0_5"
}


def predictions(
    frame: DataFrame, item: str, first: list[str], second: list[str], keys: list[str], items: list, kind: str = "older_patient", seed: int = 20260921, **params
) -> DataFrame:
    """keys, item, label, model, probability: four rows a row of ``frame``, each scored by forests that never saw its item.
    Missing values take the training median (0 where a column has none); no row is left out for what
    it lacks. ``keys`` and ``item`` together name a row. An item whose others are all of one class stops the job."""
    whole = frame.withColumns({"training_eligible": F.lit(True), "available": F.lit(True)})
    of = lambda columns: HeldOutModels(whole, item, columns, kind, seed, **params)
    scores = {FIRST: of(first), SECOND: of(second), EARLY: of([*first, *second])}
    long = None
    for name, models in scores.items():
        s = models.nested(items).select(*keys, item, "label", F.lit(name).alias("model"), F.col("score").alias("probability"))
        long = s if long is None else long.unionByName(s)
    # One row of the frame has its three scores together; the fixed mean is the fourth.
    wide = long.groupBy(*keys, item, "label").pivot("model", list(scores)).agg(F.first("probability"))
    late = (1 - ALPHA) * F.col(FIRST) + ALPHA * F.col(SECOND)
    each = F.array(*[F.struct(F.lit(n).alias("model"), c.alias("probability")) for n, c in [*[(n, F.col(n)) for n in scores], (LATE, late)]])
    return wide.select(*keys, item, "label", F.inline(each))


def measures(scored: DataFrame, level: list[str]) -> DataFrame:
    """n_test, n_positive, n_negative and the six measures at a level; the first two measures are null unless both classes occur."""
    s = scored.withColumn("score", F.col("probability"))
    n = s.groupBy(*level).agg(
        F.count("*").alias("n_test"), F.count_if(F.col("label") == 1).alias("n_positive"), F.count_if(F.col("label") == 0).alias("n_negative")
    )
    out = n.join(Q.score_quality(s, level), level, "left").join(Q.confusion(s, level), level, "left")
    return out.select(*level, "n_test", "n_positive", "n_negative", *[F.col(c).alias(name) for c, name in MEASURES.items()])


def summary(scored: DataFrame, item: str) -> DataFrame:
    """level (fold, pooled, mean), the item of a fold, model, the numbers of rows, and the measures. Means are over the
    folds where a measure is defined."""
    folds = stored(measures(scored, [item, "model"]), "folds")
    none = F.lit(None).cast(folds.schema[item].dataType).alias(item)
    means = folds.groupBy("model").agg(
        *[F.sum(c).alias(c) for c in ("n_test", "n_positive", "n_negative")], *[F.avg(c).alias(c) for c in MEASURES.values()]
    )
    out = None
    for name, d in (("fold", folds), ("pooled", measures(scored, ["model"]).withColumn(item, none)), ("mean", means.withColumn(item, none))):
        d = d.withColumn("level", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out

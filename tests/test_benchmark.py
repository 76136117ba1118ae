"""The older benchmarks: the held-out rule, the fixed mean, and the measures against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from brontide.operators import benchmark as BM

KEYS = ["file", "anchor"]
SCHEMA = "item string, file string, anchor double, label int, eeg double, none double, ecg double"


def rows(shift=0.0):
    draw = random.Random(5)
    out = []
    for i in range(240):
        y = int(draw.random() < 0.3)
        eeg = None if draw.random() < 0.1 else y + draw.gauss(0, 0.7)
        ecg = None if draw.random() < 0.2 else 2 * y + draw.gauss(0, 0.7)
        out.append([f"i{i % 3}", f"f{i % 6}", float(i), y, eeg, None, ecg])
    return [[*r[:4], r[4] if r[0] != "i0" or r[4] is None else r[4] + shift, *r[5:]] for r in out]


def predict(spark, data):
    d = spark.createDataFrame(data, SCHEMA)
    return BM.predictions(d, "item", ["eeg", "none"], ["ecg"], KEYS, ["i0", "i1", "i2"], "older_smoke", numTrees=6)


@pytest.fixture(scope="module")
def scored(spark):
    return predict(spark, rows()).cache()


def plain(pairs):
    """Measures by their definitions, over all pairs of a positive and a negative row."""
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    ap = sum(sum(x >= p for x in pos) / sum(q >= p for _, q in pairs) for p in pos) / len(pos)
    tp, fp, fn, tn = (sum((p >= 0.5) == hit and y == is_pos for y, p in pairs) for hit, is_pos in ((1, 1), (1, 0), (0, 1), (0, 0)))
    div = lambda a, b: a / b if b else 0.0
    return auc, ap, div(tp, tp + fn), div(tp, tp + fp), div(2 * tp, 2 * tp + fp + fn), (div(tp, tp + fn) + div(tn, tn + fp)) / 2


def test_four_scores_a_row(scored):
    wide = scored.groupBy(*KEYS, "item", "label").pivot("model").agg(F.first("probability")).collect()
    assert len(wide) == 240 and scored.count() == 960
    for r in wide:
        assert r[BM.LATE] == pytest.approx((r[BM.FIRST] + r[BM.SECOND]) / 2)
        assert all(0 <= r[m] <= 1 for m in (BM.FIRST, BM.SECOND, BM.EARLY))


def test_measures_against_plain_versions(scored):
    out = {(r.level, r.item, r.model): r for r in BM.summary(scored, "item").collect()}
    assert len(out) == 12 + 4 + 4
    got = [(r.item, r.model, r.label, r.probability) for r in scored.collect()]
    for model in (BM.FIRST, BM.SECOND, BM.EARLY, BM.LATE):
        folds = []
        for item in ("i0", "i1", "i2", None):
            pairs = [(y, p) for i, m, y, p in got if m == model and item in (i, None)]
            r = out["pooled" if item is None else "fold", item, model]
            want = plain(pairs)
            assert [r[c] for c in BM.MEASURES.values()] == pytest.approx(want)
            assert (r.n_test, r.n_positive, r.n_negative) == (len(pairs), sum(y for y, _ in pairs), sum(1 - y for y, _ in pairs))
            folds.append(want)
        mean = out["mean", None, model]
        assert [mean[c] for c in BM.MEASURES.values()] == pytest.approx([sum(x) / 3 for x in zip(*folds[:3], strict=True)])
        assert mean.n_test == 240
    assert out["pooled", None, BM.SECOND].roc_auc > 0.9  # the classes lie two spreads apart there


def test_a_held_out_item_trains_nothing(spark, scored):
    """The item's own values move its own scores only through its rows; those of the forests are as before."""
    label = [[*r[:3], 1 - r[3] if r[0] == "i0" else r[3], *r[4:]] for r in rows()]
    of = lambda d: {tuple(r[k] for k in (*KEYS, "model")): r.probability for r in d.where("item = 'i0'").collect()}
    assert of(predict(spark, label)) == of(scored)


def test_one_class(spark):
    with pytest.raises(ValueError):
        predict(spark, [[*r[:3], int(r[0] == "i0"), *r[4:]] for r in rows()]).count()
    flat = spark.createDataFrame([("a", "m", 1, 0.7), ("a", "m", 1, 0.2)], "item string, model string, label int, probability double")
    r = BM.measures(flat, ["item", "model"]).first()
    assert (r.roc_auc, r.average_precision, r.sensitivity_at_0_5, r.n_negative) == (None, None, 0.5, 0)

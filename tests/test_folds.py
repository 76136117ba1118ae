"""Models of all folds at once against single fits, and against a plain Newton's method."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brontide.operators import folds as O
from brontide.operators import models as N

SCHEMA = "grp string, t int, a double, b double, c double, label int, available boolean, training_eligible boolean"


def rows(groups=5, n=60, seed=1):
    rng = random.Random(seed)
    maybe = lambda x: None if rng.random() < 0.1 else x
    out = []
    for g in range(groups):
        for t in range(n):
            y = int(rng.random() < 0.2 + 0.05 * g)
            out.append((f"g{g}", t, maybe(rng.gauss(y, 1)), maybe(1e4 + rng.gauss(0, 3) - y), 7.0, y, rng.random() < 0.9, rng.random() < 0.9))
    return out


def plain(data, test, out):
    """Scores of the rows of ``test`` by a model of all rows but those of ``out``."""
    use = [r for r in data if r[0] not in out and r[6] and r[7]]
    x, y = np.array([r[2:5] for r in use], float), np.array([r[5] for r in use], float)
    median = np.nanmedian(x, 0)
    x = np.where(np.isnan(x), median, x)
    mean, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1
    z, w = np.c_[np.ones(len(x)), (x - mean) / sd], np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    beta, pen = np.zeros(4), np.diag([0, 1, 1, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z.T * (w * p * (1 - p))) @ z + pen, z.T @ (w * (p - y)) + pen @ beta)
    v = np.array([r[2:5] for r in data if r[0] == test], float)
    v = (np.where(np.isnan(v), median, v) - mean) / sd
    return 1 / (1 + np.exp(-(v @ beta[1:] + beta[0])))


def test_all_folds_at_once(spark, monkeypatch):
    data, jobs = rows(), []
    d = spark.createDataFrame(data, SCHEMA).repartition(3)
    sums = O.array_sums
    monkeypatch.setattr(O, "array_sums", lambda *a: jobs.append(1) or sums(*a))
    m = N.HeldOutModels(d, "grp", ["a", "b", "c"])
    groups = [f"g{i}" for i in range(5)]
    outer = {(r.grp, r.t): r for r in m.nested(groups).collect()}
    assert len(outer) == len(data) and len(jobs) < 25
    for g in groups:
        want = plain(data, g, {g})
        mine = [r for r in data if r[0] == g]
        assert all(outer[g, r[1]].fold == g and (outer[g, r[1]].score is None) == (not r[6]) for r in mine)
        assert max(abs(outer[g, r[1]].score - s) for r, s in zip(mine, want, strict=True) if r[6]) < 1e-8
    jobs.clear()
    inner = m.inner(groups).collect()
    assert len(inner) == 4 * len(data) and len(jobs) < 25  # twenty pairs of groups
    got = {(r.held, r.grp, r.t): r.score for r in inner}
    for h, g in itertools.permutations(groups, 2):
        mine = [r for r in data if r[0] == g]
        assert max(abs(got[h, g, r[1]] - s) for r, s in zip(mine, plain(data, g, {g, h}), strict=True) if r[6]) < 1e-8
    assert {r.held for r in m.inner(["g0", "g1", "g2"], "g4").collect()} == {"g4"}


def test_single_fits_agree(spark):
    d = spark.createDataFrame(rows(4), SCHEMA)
    m = N.HeldOutModels(d, "grp", ["a", "b"])
    single = {(r.grp, r.t): r.score for g in ("g0", "g3") for r in m.score([x for x in ("g0", "g1", "g2", "g3") if x != g], [g]).collect()}
    many = {(r.grp, r.t): r.score for r in m.nested(["g0", "g1", "g2", "g3"]).collect()}
    assert all((many[k] is None) == (s is None) and (s is None or abs(many[k] - s) < 1e-6) for k, s in single.items())


def test_medians_are_exact(spark):
    rng = random.Random(8)
    odd = [0.0, -0.0, 1e300, -1e300, 5e-324, -3.5, 2.0, float("nan")]
    data = [(f"g{i % 4}", i, rng.choice(odd), rng.choice([rng.uniform(-9, 9), 1.0, None]), None, i % 2, True, True) for i in range(203)]
    f = O.FoldedLogistic(spark.createDataFrame(data, SCHEMA), "grp", ["a", "b", "c"], ["g0", "g1", "g2", "g3"])
    kept = np.array([[1, 1, 1, 1], [0, 1, 1, 1], [1, 0, 0, 1.0]])
    got = f._medians(kept, kept @ f._first_sums()["present"].reshape(4, 3))
    for i, row in enumerate(kept):
        use = np.array([r[2:4] for r in data if row[int(r[0][1])]], float)
        assert np.array_equal(got[i], np.append(np.nanmedian(use / 2, 0) * 2, 0.0))
    x = np.array([float(v) for v in odd[:-1]] + [-np.inf, np.inf])
    assert np.array_equal(O.unordered(O.ordered(x)), x) and (np.diff(O.ordered(np.sort(x)).astype(object)) >= 0).all()


def test_guards(spark):
    d = spark.createDataFrame([r for r in rows(3) if r[0] != "g1" or r[5] == 0], SCHEMA).withColumn("label", F.when(F.col("grp") == "g0", F.col("label")).otherwise(0))
    with pytest.raises(ValueError, match="one class"):
        N.HeldOutModels(d, "grp", ["a"]).nested(["g0", "g1", "g2"])
    with pytest.raises(ValueError):
        N.HeldOutModels(d, "grp", ["a"]).inner(["g0", "g1"])


def test_fusion_models_of_every_fold(spark):
    d = spark.createDataFrame(rows(4), SCHEMA).withColumn("available2", F.col("t") % 4 > 0)
    f = N.FusionModels(d, "grp", ["a"], ["b"], ["t"], kind="logistic")
    s = f.inner(["g0", "g1", "g2", "g3"])
    assert s.count() == 3 * d.count() and s.where("t % 4 = 0 AND score_c IS NOT NULL").isEmpty()
    one = {(r.grp, r.t): r.score_early for r in N.FusionModels(d, "grp", ["a"], ["b"], ["t"], kind="logistic").inner(["g0", "g1", "g2", "g3"], "g2").collect()}
    many = {(r.grp, r.t): r.score_early for r in s.where("held = 'g2'").collect()}
    assert one.keys() == many.keys() and all((one[k] is None) == (v is None) and (v is None or abs(one[k] - v) < 1e-12) for k, v in many.items())

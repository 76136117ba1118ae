"""Prefix sums and quantiles over ranges against plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brontide.operators import metrics as Q
from brontide.operators import ranges as G


@pytest.mark.parametrize("pieces", [2, 7, 64])
def test_running_sums(spark, pieces):
    rng = random.Random(pieces)
    rows = {(g, v): (rng.randrange(5), rng.randrange(9)) for g in (None, 1, 2) for v in {rng.gauss(0, 10**rng.randrange(4)) for _ in range(300)}}
    d = spark.createDataFrame([(g, v, a, b) for (g, v), (a, b) in rows.items()], "g int, v double, a long, b long").repartition(4)
    got = G.running(d, ["g"], "v", ["a", "b"], pieces).collect()
    assert len(got) == len(rows)
    for r in got:
        below = [x for (g, v), x in rows.items() if g == r.g and v < r.v]
        assert (r.a_before, r.b_before) == (sum(x[0] for x in below), sum(x[1] for x in below))
        assert r.a_total == sum(x[0] for (g, _), x in rows.items() if g == r.g)


def test_no_task_holds_a_group(spark):
    d = spark.range(20_000).select(F.lit(1).alias("g"), F.rand(3).alias("v"), F.lit(1).cast("bigint").alias("n")).cache()
    at = G.cuts(d, "v", 32)
    n = np.bincount(np.searchsorted(at, [r.v for r in d.collect()]))
    assert len(n) == 32 and n.max() < 1.5 * 20_000 / 32
    assert G.cuts(d.limit(0), "v") == [] and G.cuts(d.withColumn("v", F.lit(3.0)), "v") == [3.0]


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_quantiles_equal_percentile(spark, by):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2]), rng.randrange(2), rng.choice([None, 1, 2, 3, rng.randrange(1000)])) for _ in range(800)] + [(9, 0, 4), (8, 0, None)]
    d = spark.createDataFrame(rows, "g int, h int, v long")
    at = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {tuple(r[c] for c in by): tuple(r[n] for n in at) for r in G.quantiles(d, by, "v", at, 16).collect()}
    want = d.where("v IS NOT NULL").groupBy(*by).agg(*[F.percentile("v", q).alias(n) for n, q in at.items()]).collect()
    assert got == {tuple(r[c] for c in by): tuple(r[n] for n in at) for r in want}
    assert G.quantiles(d.limit(0), by, "v", at).count() == 0


def test_score_quality_by_hand(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(3), rng.choice([0.1, 0.5, round(rng.random(), 2)]), rng.choice([-1, 0, 0, 1])) for _ in range(500)] + [(7, 0.5, 1), (1, None, 1)]
    d = spark.createDataFrame(rows, "g int, score double, label int")
    for level in ([], ["g"]):
        for r in Q.score_quality(d, level).collect():
            use = [(s, y) for g, s, y in rows if y >= 0 and s is not None and (not level or g == r.g)]
            pos, neg = [s for s, y in use if y], [s for s, y in use if not y]
            if not pos or not neg:
                assert r.average_precision is None and r.roc_auc is None
                continue
            auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
            ap = sum(sum(p >= s for p in pos) / sum(x >= s for x, _ in use) for s in pos) / len(pos)
            assert abs(r.roc_auc - auc) < 1e-12 and abs(r.average_precision - ap) < 1e-12

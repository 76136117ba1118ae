"""Alarms of many thresholds at once against the machine that runs for each alone."""

import random

import pytest
from pyspark.sql import functions as F

from brontide.operators import alarms as A

AT = [0.2, 0.4, 0.6, 0.8, 1.01]


def decisions(spark, seed):
    rng = random.Random(seed)
    rows = []
    for rec in range(30):
        t, n = 0, rng.randrange(1, 60)
        until = 0
        times = []
        for _ in range(n):
            t += rng.choice([10, 10, 10, 10, 20, 35])
            times.append(t)
        barriers = sorted(rng.sample(range(5, t + 60), rng.randrange(0, 4)))
        spans = [(b, b + rng.randrange(1, 30)) for b in barriers]
        spans = [s for i, s in enumerate(spans) if i == 0 or spans[i - 1][1] <= s[0]]
        for x in times:
            until = max([e for s, e in spans if s <= x], default=None)
            nxt = min([s for s, e in spans if s > x], default=None)
            one = rng.choice([None, float("nan"), *[round(rng.random(), 1) for _ in range(12)]])
            two = rng.choice([None, *[rng.random() for _ in range(9)]])
            rows.append((rec, x, t + 7, until, nxt, rng.random() < 0.93, one, two, rng.random() < 0.5))
    return spark.createDataFrame(
        rows, "rec int, t bigint, duration bigint, barrier_until bigint, barrier_next bigint, available boolean, one double, two double, counts boolean"
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_equal_single_thresholds(spark, seed):
    d = decisions(spark, seed).cache()
    own = F.when(F.col("counts"), A.reached(F.col("two"), AT)).otherwise(F.when(F.col("two") >= 0.5, len(AT)).otherwise(0))
    got = A.alarm_levels(d, ["rec"], 10, AT, "name", {"one": (F.col("one"), A.reached(F.col("one"), AT)), "two": (F.col("two"), own)})
    got = sorted((r.name, r["at"], r.rec, r.declaration, r.end, r.reason) for r in got.collect())
    want = []
    for x in AT:
        by = {"one": (F.col("one"), F.lit(x)), "two": (F.col("two"), F.when(F.col("counts"), F.lit(x)).otherwise(0.5))}
        for name, (score, threshold) in by.items():
            rows = A.alarm_stream(d.withColumns({"score": score, "threshold": threshold}), ["rec"], 10).collect()
            want += [(name, x, r.rec, r.declaration, r.end, r.reason) for r in rows]
    assert len(want) > 200 and got == sorted(want)


def test_levels_are_guarded(spark):
    d = decisions(spark, 3).withColumn("one", F.when(F.col("rec") == 4, F.lit(1.5)).otherwise(F.col("one")))
    with pytest.raises(Exception, match="times of their own"):
        A.alarm_levels(d, ["rec"], 10, AT, "name", {"one": (F.col("one"), A.reached(F.col("one"), AT))}).collect()


def test_one_sort_serves_all_thresholds(spark):
    d = decisions(spark, 4)
    df = A.alarm_levels(d, ["rec"], 10, AT, "name", {n: (F.col(n), A.reached(F.col(n), AT)) for n in ("one", "two")})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1

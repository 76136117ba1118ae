"""Negative controls: what the second modality may not change, from one row a decision."""

import random

from brontide.operators import checks as V
from pyspark.sql import functions as F

ROW = "rec int, t bigint, duration bigint, barrier_until bigint, barrier_next bigint, available boolean, available2 boolean, score1 double, score2 double"


def decisions(spark):
    rng = random.Random(3)
    some = lambda p: rng.random() if rng.random() < p else None
    return spark.createDataFrame([(r, 10 * k, 405, None, None, rng.random() < 0.9, True, some(0.9), some(0.8)) for r in range(9) for k in range(40)], ROW)


def test_controls_pass_and_a_broken_fusion_is_found(spark, monkeypatch):
    d = decisions(spark)
    want = {"NC1_alpha_zero", "NC2_entire_outage", "NC2_max_alpha_outage"}
    got = {r.control: r for r in V.negative_controls(d, ["rec"], 10, 0.25, 0.45, 0.5).collect()}
    assert set(got) == want and all(r.passed and r.decisions == 360 and r.alarms > 20 for r in got.values())
    assert V.negative_controls(d.where("false"), ["rec"], 10, 0.25, 0.45, 0.5).isEmpty()
    late = V.U.late
    broken = lambda df, *a: late(df, *a).withColumn("score", F.when(F.col("rec") == 4, 1 - F.col("score1")).otherwise(F.col("score1")))
    monkeypatch.setattr(V.U, "late", broken)
    assert all(not r.passed and r.differing > 0 and r.differing_alarms > 0 for r in V.negative_controls(d, ["rec"], 10, 0.25, 0.45, 0.5).collect())


def test_controls_store_each_decision_once_and_sort_it_once(spark, monkeypatch):
    made, machine = [], V.A.alarm_stream
    levels = V.A.alarm_levels
    monkeypatch.setattr(V.A, "alarm_stream", lambda d, *a: made.append(d) or machine(d, *a))
    monkeypatch.setattr(V.A, "alarm_levels", lambda d, *a: made.append(d) or levels(d, *a))
    V.negative_controls(decisions(spark), ["rec"], 10, 0.25, 0.45, 0.5).collect()
    assert [d.count() for d in made] == [360]

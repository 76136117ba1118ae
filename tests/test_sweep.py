"""A sweep over a grid against the same measures of each of its points alone."""

import random

from brontide.operators import alarms as A
from brontide.operators import matching as M
from brontide.operators import metrics as Q
from brontide.operators import selection as S
from pyspark.sql import functions as F

AT = [0.3, 0.6, 0.9, 1.01]


def tables(spark):
    rng = random.Random(5)
    decisions = [(r, r % 3, 10 * k, 1000, None, None, rng.random() < 0.9, rng.random()) for r in range(12) for k in range(100) if r != 7]
    d = spark.createDataFrame(decisions, "rec int, grp int, t bigint, duration bigint, barrier_until bigint, barrier_next bigint, available boolean, score double")
    spans = [(r, r % 3, f"{r}-{k}", 100 * k + rng.randrange(40), 100 * k + 50 + rng.randrange(40)) for r in range(12) for k in range(10) if r % 5]
    e = spark.createDataFrame(spans, "rec int, grp int, event_id string, start bigint, end bigint")
    b = spark.createDataFrame([(r, r % 3, 1000, 0, 0, 0, 900) for r in range(12)], ["rec", "grp", *Q.TIMES])
    return d, e, b


def levels(d):
    return A.alarm_levels(d, ["rec", "grp"], 10, AT, "name", {"one": (F.col("score"), A.reached(F.col("score"), AT))}).drop("name")


def test_sweep_equals_each_point(spark):
    d, e, b = tables(spark)
    columns = ["grp", "events", "detected", "false_declarations", "evaluable", "delay_median", "sensitivity", "false_per_hour"]
    got, _ = S.sweep(levels(d), e, b, ["rec"], ["grp"], {"at": AT})
    got = {r["at"]: [] for r in got.select("at").distinct().collect()} | {x: sorted(map(tuple, got.where(F.col("at") == x).select(columns).collect())) for x in AT}
    for x in AT:
        one = A.alarm_stream(d.withColumn("threshold", F.lit(x)), ["rec", "grp"], 10)
        want = Q.summarize(M.judged(one, e, ["rec", "grp"]), b, ["grp"]).select(columns)
        assert got[x] == sorted(map(tuple, want.collect()))
    assert any(r[2] for r in got[0.9]) and not any(r[2] or r[3] for r in got[1.01])


def test_events_are_not_stored_once_a_point(spark):
    d, e, b = tables(spark)
    alarms = levels(d)
    assert S.sweep(alarms, e, b, ["rec"], ["grp"], {"at": AT})[1].count() <= alarms.count()
    assert S.sweep(alarms.where("false"), e, b, ["rec"], ["grp"], {"at": AT})[1].isEmpty()


def test_declarations_alone_are_those_with_ends(spark):
    d, _, _ = tables(spark)
    one = {"one": (F.col("score"), A.reached(F.col("score"), AT))}
    got = A.alarm_levels(d, ["rec", "grp"], 10, AT, "name", one, ends=False)
    want = levels(d).select("rec", "grp", "at", "declaration")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))

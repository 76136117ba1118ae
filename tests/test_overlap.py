"""Interval joins against all pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brontide.operators import overlap as O

SCHEMA = "rec int, id int, start bigint, end bigint"


def spans(rng, n, longest):
    return [(rng.randrange(3), i, s := rng.randrange(-5000, 5000), s + rng.choice([0, 1, 2, 3, 4, 5, rng.randrange(1, longest)])) for i in range(n)]


@pytest.mark.parametrize("la,lb", [(10, 3000), (5000, 5), (600, 600)])
def test_equal_to_all_pairs(spark, la, lb):
    rng = random.Random(la)
    a, b = spans(rng, 250, la), spans(rng, 250, lb)
    whole = (F.col("start"), F.col("end"))
    got = O.overlaps(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ["rec"], whole, whole)
    got = Counter((r.rec, r.a.id, r.b.id) for r in got.collect())
    assert got == Counter((x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and max(x[2], y[2]) < min(x[3], y[3])) and sum(got.values()) > 50


def test_points_and_extremes(spark):
    rng = random.Random(3)
    a, b = spans(rng, 300, 10), [*spans(rng, 50, 4000), (1, 99, -(2**60), 2**60)]
    got = O.overlaps(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ["rec"], O.point(F.col("start")), (F.col("start"), F.col("end")), ("p", "q"))
    assert Counter((r.rec, r.p.id, r.q.id) for r in got.collect()) == Counter((x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and y[2] <= x[2] < y[3])
    none = spark.createDataFrame([], SCHEMA)
    assert O.overlaps(none, none, ["rec"], O.point(F.col("start")), O.point(F.col("start"))).isEmpty()


def test_neighbours_only_are_compared(spark):
    """A long recording of many short spans: the join makes few rows beside those it returns."""
    d = spark.range(20_000).select(F.lit(1).alias("rec"), F.col("id"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 7).alias("end"))
    whole = (F.col("start"), F.col("end"))
    j = O.overlaps(d, d, ["rec"], whole, whole)
    assert j.count() == 20_000
    assert "CartesianProduct" not in j._jdf.queryExecution().executedPlan().toString() and "BroadcastNestedLoop" not in j._jdf.queryExecution().executedPlan().toString()

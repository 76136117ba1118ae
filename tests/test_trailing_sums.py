"""Trailing sums of an anchor grid against a plain version, and interval joins: neither lets a side be broadcast."""

import random

from brontide.operators import overlap as O
from brontide.operators import timeline as T
from brontide.plans import binding as B
from brontide.plans import features as P
from pyspark.sql import functions as F

FIRST, STRIDE, DURATION = 24, 4, 120


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trailing_sums_against_a_plain_version(spark):
    rng = random.Random(3)
    rows = [(r, rng.randrange(-30, 150), rng.choice([None, 0, -5, 7, 100])) for r in (1, 2, None) for _ in range(25)]
    rows += [(1, x, 1) for x in (0, 23, 24, 28, 119, 120)] + [(4, 24, 3), (9, 30, 5)]
    recordings = spark.createDataFrame([(1, DURATION), (2, DURATION), (3, DURATION), (4, 20), (None, DURATION)], "rec int, duration bigint")
    samples = spark.createDataFrame(rows, "rec int, x bigint, v bigint")
    for context in (24, 72, 3):
        got = {(r.rec, r.t): (r.v, r.v_n) for r in T.trailing_sums(recordings, samples, ["rec"], context, FIRST, STRIDE, "v").collect()}
        want = {}
        for rec in (1, 2, 3, None):
            for t in range(FIRST, DURATION, STRIDE):
                seen = [v for r, x, v in rows if r == rec and r is not None and v is not None and t - context <= x < t]
                want[rec, t] = (sum(seen) if seen else None, len(seen))
        assert got == want


def test_no_grid_is_joined_or_broadcast(spark):
    d = B.decisions(spark, "/root/testdata/sf0.001")
    assert "Join" not in _plan(d.where("available"))


def test_interval_joins_are_merged(spark):
    a = spark.range(50).select((F.col("id") % 5).alias("k"), F.col("id").alias("s"), (F.col("id") + 3).alias("e"))
    found = O.overlaps(a, a, ["k"], (F.col("s"), F.col("e")), O.point(F.col("s")))
    assert "SortMergeJoin" in _plan(found) and "BroadcastHashJoin" not in _plan(found)
    assert found.count() == 50


def test_the_rows_that_models_learn_from_are_merged(spark):
    for rows in (P._training, P._fusion_frame):
        plan = _plan(rows(spark, "/root/testdata/sf0.001").select("rec", "t", "label"))
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan

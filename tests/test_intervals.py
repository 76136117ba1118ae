"""Interval algebra against sets of points."""

import random

from brontide.operators import intervals as I


def points(rows):
    return {x for a, b in rows for x in range(a, b)}


def test_random_algebra(spark):
    rng = random.Random(5)
    make = lambda: [(a, a + rng.randrange(0, 7)) for a in (rng.randrange(0, 40) for _ in range(rng.randrange(0, 8)))]
    sets = [(make(), make()) for _ in range(150)]
    df = lambda k: spark.createDataFrame([(i, a, b) for i, s in enumerate(sets) for a, b in s[k]], "rec int, start bigint, end bigint")
    a, b = df(0), df(1)
    for op, want in ((I.subtract_intervals, set.__sub__), (I.intersect_intervals, set.__and__)):
        got = {}
        for r in op(a, b, ["rec"]).collect():
            got.setdefault(r.rec, []).append((r.start, r.end))
        for i, (x, y) in enumerate(sets):
            rows = sorted(got.get(i, []))
            assert points(rows) == want(points(x), points(y))
            assert all(p[1] < q[0] for p, q in zip(rows, rows[1:], strict=False))
    merged = {}
    for r in I.union_intervals(a, ["rec"]).collect():
        merged.setdefault(r.rec, []).append((r.start, r.end))
    assert all(points(merged.get(i, [])) == points(x) for i, (x, _) in enumerate(sets))


def test_json_pairs_and_clip(spark):
    d = spark.createDataFrame([(1, "[[0, 2.5], [2, 4]]"), (2, "[]")], "rec int, raw string")
    pairs = I.from_json_pairs(d, ["rec"], "raw", 10)
    assert [r.length for r in I.measure(pairs, ["rec"]).collect()] == [40]
    from pyspark.sql import functions as F

    assert [r.length for r in I.clipped_measure(pairs, ["rec"], F.lit(10), F.lit(30)).collect()] == [20]

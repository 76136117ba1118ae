"""The alarm machine against a pattern over cells, and matching against a look-up per event."""

import random
import re

import pytest
from pyspark.sql import functions as F

from brontide.operators import alarms as A
from brontide.operators import intervals as I
from brontide.operators import matching as M
from brontide.operators import timeline as T

S = 5


def by_cells(decisions, barriers, duration, threshold):
    """What alarms are, for times and barriers on the grid: each cell of a recording is a letter,
    H or L by its decision's score, or a break (g gap, m missing, u unavailable); alarms are
    found by a pattern over that text."""
    known, final = dict(decisions), max((t for t, _ in decisions), default=-1)
    out, text = [], ""
    starts = range(0, duration, S)
    for t in starts:
        if t > final or (t not in known and not any(a <= t < b for a, b in barriers)):
            text += "m"
        elif any(a <= t < b for a, b in barriers):
            text += "g"
        else:
            text += "u" if known[t] is None else "H" if known[t] >= threshold else "L"
    for m in re.finditer("H(?:L?H)*", text):
        after = text[m.end() :]
        i = m.end()
        if after.startswith("LL"):
            out.append((starts[m.start()], starts[i + 1], A.TWO_BELOW))
            continue
        i += after.startswith("L")
        if i == len(text):
            out.append((starts[m.start()], duration, A.END))
        else:
            out.append((starts[m.start()], starts[i], {"g": A.GAP, "m": A.MISSING, "u": A.UNAVAILABLE}[text[i]]))
    return out


def frame(spark, streams):
    rows = [(i, t, s, s is not None, 0.5, d) for i, (ts, _, d) in enumerate(streams) for t, s in ts]
    bars = [(i, a, b) for i, (_, bar, _) in enumerate(streams) for a, b in bar]
    d = spark.createDataFrame(rows, "rec int, t bigint, score double, available boolean, threshold double, duration bigint")
    return T.around(d, {"barrier": spark.createDataFrame(bars, "rec int, start bigint, end bigint")}, ["rec"])


def test_labels_of_overlapping_events(spark):
    """Against a look at every event and uncertain span for every anchor."""
    rng = random.Random(5)
    spans = lambda n, p: [
        (r, i, a, a + rng.randrange(1, 30)) for r in range(20) for i in range(n) if rng.random() < p for a in [rng.randrange(0, 150)]
    ]
    ev, un = spans(5, 0.7), spans(3, 0.4)
    anchors = spark.createDataFrame([(r, t) for r in range(21) for t in range(0, 160, 3)], "rec int, t bigint")
    table = lambda s: spark.createDataFrame([(r, i, a, b) for r, i, a, b in s], "rec int, number bigint, start bigint, end bigint")
    got = {(r.rec, r.t): r for r in T.label(anchors, table(ev), table(un), ["rec"], 7).collect()}
    assert len(got) == 21 * 54
    for (rec, t), r in got.items():
        inside = [str(i) for q, i, a, b in sorted(ev, key=lambda e: (e[2], e[3], e[1])) if q == rec and a <= t < b]
        near, unsure = any(q == rec and a - 7 <= t < b + 7 for q, _, a, b in ev), any(q == rec and a <= t < b for q, _, a, b in un)
        status = "annotation_uncertain" if unsure else "positive" if inside else "ignore" if near else "negative"
        label = {"positive": 1, "negative": 0}.get(status, -1)
        assert (r.status, r.label, r.event_numbers, r.evaluation_label, r.training_eligible) == (
            status, label, "|".join(inside) if status == "positive" else "", -1 if unsure else int(bool(inside)), label >= 0
        )


def test_random_streams_equal_the_pattern(spark):
    rng = random.Random(3)
    streams = []
    for _ in range(400):
        duration = S * rng.randrange(8, 26)
        ts = [(t, None if rng.random() < 0.1 else rng.choice([0.0, 0.5, 0.9])) for t in range(10, duration, S) if rng.random() > 0.12]
        bar, at = [], S * rng.randrange(0, 12)
        while at < duration and rng.random() < 0.6:
            end = at + S * rng.randrange(1, 4)
            bar.append((at, end))
            at = end + S * rng.randrange(1, 6)
        streams.append((ts, bar, duration))
    got = {(r.rec, r.declaration, r.end, r.reason) for r in A.alarm_stream(frame(spark, streams), ["rec"], S).collect()}
    want = {(i, *a) for i, (ts, bar, d) in enumerate(streams) for a in by_cells(ts, bar, d, 0.5)}
    assert got == want and {w[3] for w in want} == {A.GAP, A.MISSING, A.UNAVAILABLE, A.TWO_BELOW, A.END}


def test_barriers_between_decisions(spark):
    """A barrier that begins within a cell ends the alarm there; after the last decision too."""
    high = [(t, 0.9) for t in (10, 15, 20)]
    streams = [(high, [(17, 18)], 100), (high, [(22, 30)], 100), (high, [], 23), (high, [], 100), (high + [(40, 0.9)], [(31, 33)], 100)]
    got = sorted((r.rec, r.declaration, r.end, r.reason) for r in A.alarm_stream(frame(spark, streams), ["rec"], S).collect())
    assert got == [
        (0, 10, 17, A.GAP), (0, 20, 25, A.MISSING), (1, 10, 22, A.GAP), (2, 10, 23, A.END), (3, 10, 25, A.MISSING), (4, 10, 25, A.MISSING),
        (4, 40, 45, A.MISSING)
    ]


def test_bad_decisions_stop_the_job(spark):
    for ts in ([(10, 1.2)], [(10, -0.1)], [(10, 0.2), (10, 0.3)], [(-5, 0.2)], [(65, 0.2)]):
        with pytest.raises(Exception):
            A.alarm_stream(frame(spark, [(ts, [], 65)]), ["rec"], S).collect()


def test_matching_of_random_alarms(spark):
    """Each event takes its first declaration, found per event; touching is looked up per pair."""
    rng = random.Random(8)
    alarms, events = [], []
    for rec in range(60):
        cuts = sorted(rng.sample(range(0, 200), 2 * rng.randrange(0, 8)))
        alarms += [(rec, a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        cuts = sorted(rng.sample(range(0, 200), 2 * rng.randrange(0, 4)))
        events += [(rec, f"e{a}", a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
    a = spark.createDataFrame(alarms, "rec int, declaration bigint, end bigint")
    e = spark.createDataFrame(events, "rec int, event_id string, start bigint, end bigint")
    inside = {(r, i): sorted(d for q, d, _ in alarms if q == r and s <= d < t) for r, i, s, t in events}
    want = {(r, d): "matched" for (r, _), ds in inside.items() for d in ds[:1]} | {
        (r, d): "duplicate" for (r, _), ds in inside.items() for d in ds[1:]
    }
    judged = M.match_alarms(a, e, ["rec"])[0].collect()
    assert {(r.rec, r.declaration): r.status for r in judged} == {(r, d): want.get((r, d), "false") for r, d, _ in alarms}
    slow = M.match_overlapping(a, e, ["rec"]).collect()
    assert {(r.rec, r.declaration, r.status, r.event_id) for r in slow} == {(r.rec, r.declaration, r.status, r.event_id) for r in judged}
    got = {(r.rec, r.event_id): (r.detected, r.delay, r.overlap_detected) for r in M.event_matches(a, e, ["rec"]).collect()}
    assert got == {
        (r, i): (bool(inside[r, i]), inside[r, i][0] - s if inside[r, i] else None, any(q == r and d < t and x > s for q, d, x in alarms)) for r, i,
        s, t in events
    }


def test_uncertainty_cuts_and_exposure(spark):
    ts = [(t, 1.0 if t in (10, 15, 20) else 0.0) for t in range(10, 65, S)]
    d = frame(spark, [(ts, [(12, 13)], 65)])
    assert sorted((r.declaration, r.end) for r in A.alarm_stream(d, ["rec"], S).collect()) == [(10, 12), (15, 30)]
    unc = spark.createDataFrame([(0, 12, 13)], "rec int, start bigint, end bigint")
    got = sorted((r.start, r.end) for r in I.exposure(d, unc, None, ["rec"], S, F.col("duration")).collect())
    assert got == [(10, 12), (13, 65)]


def test_fates_take_the_closest_first(spark):
    a = spark.createDataFrame([(0, 10, 20), (0, 50, 60), (0, 100, 130), (0, 300, 310)], "rec int, declaration bigint, end bigint")
    b = spark.createDataFrame([(0, 10, 15), (0, 53, 60), (0, 120, 140), (0, 500, 510)], "rec int, declaration bigint, end bigint")
    got = {(r.declaration, r.other, r.fate) for r in M.alarm_fates(a, b, ["rec"], 5).collect()}
    assert got == {(10, 10, "preserved"), (50, 53, "shifted"), (100, 120, "replaced"), (300, None, "suppressed"), (None, 500, "added")}


def test_fates_of_random_alarms(spark):
    """Pairs are made one at a time: of all that still fit a stage the closest, then the earliest."""
    rng = random.Random(17)
    spans = lambda: [(r, a, a + rng.randrange(1, 25)) for r in range(40) for a in sorted(rng.sample(range(120), rng.randrange(0, 9)))]
    one, two = spans(), spans()
    fits = {"preserved": lambda x, y: x[0] == y[0], "shifted": lambda x, y: abs(x[0] - y[0]) <= 5, "replaced": lambda x, y: x[0] < y[1] and y[0] < x[1]}
    want = set()
    for rec in range(40):
        a, b = ([s[1:] for s in side if s[0] == rec] for side in (one, two))
        for fate, fit in fits.items():
            while pairs := [(abs(x[0] - y[0]), x, y) for x in a for y in b if fit(x, y)]:
                _, x, y = min(pairs)
                want.add((rec, x[0], y[0], fate))
                a.remove(x)
                b.remove(y)
        want |= {(rec, x[0], None, "suppressed") for x in a} | {(rec, None, y[0], "added") for y in b}
    table = lambda s: spark.createDataFrame(s, "rec int, declaration bigint, end bigint")
    got = [(r.rec, r.declaration, r.other, r.fate) for r in M.alarm_fates(table(one), table(two), ["rec"], 5).collect()]
    assert set(got) == want and len(got) == len(want)

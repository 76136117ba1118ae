"""Alarms against reference events: strict matching, overlap, and one-to-one alarm fates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import overlap as O
from .staging import stored

_CLOSE, _OPEN, _ALARM = 0, 1, 2  # order of what happens at one time


def judged(alarms: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """One row an alarm and one an event, for events of a recording (``keys``) that do not overlap.

    The first declaration inside an event matches it, later ones are duplicates, others false.
    Back: keys, kind (alarm, event), event_id, declaration, status (of alarms), alarm (the
    row of ``alarms`` without its keys), onset, offset, detected, delay and overlap_detected (of
    events: whether any alarm touches it). Bounds and declarations are one series in time
    order, so a single shuffle serves and no pairs are made."""
    span = F.struct("event_id", F.col("start").alias("onset"), F.col("end").alias("offset"))
    bound = lambda t, side: F.struct(F.col(t).alias("t"), F.lit(side).alias("side"))
    bounds = events.select(*keys, span.alias("event"), F.inline(F.array(bound("start", _OPEN), bound("end", _CLOSE))))
    rest = F.struct(*[F.col(c) for c in alarms.columns if c not in keys])
    series = bounds.unionByName(
        alarms.select(*keys, rest.alias("alarm"), F.col("declaration").alias("t"), F.lit(_ALARM).alias("side")), allowMissingColumns=True
    )
    so_far = W.partitionBy(*keys).orderBy("t", "side").rowsBetween(W.unboundedPreceding, 0)
    is_alarm = F.col("side") == _ALARM
    series = series.withColumns(
        {"_open": F.last(F.when(F.col("side") == _OPEN, F.col("event")), ignorenulls=True).over(so_far), "_reach": F.max("alarm.end").over(so_far)}
    ).where(F.col("side") != _OPEN)
    own = F.when(~is_alarm, F.col("event.event_id")).when(F.col("t") < F.col("_open.offset"), F.col("_open.event_id"))
    first = F.min(F.when(is_alarm, F.col("t"))).over(W.partitionBy(*keys, "event_id"))
    series = series.withColumn("event_id", own).withColumn("_first", first)
    status = F.when(F.col("event_id").isNull(), "false").when(F.col("_first") == F.col("t"), "matched").otherwise("duplicate")
    of_event = lambda c: F.when(~is_alarm, c)
    return series.select(
        *keys, F.when(is_alarm, "alarm").otherwise("event").alias("kind"), "event_id", F.when(is_alarm, F.col("t")).otherwise(F.col("_first")).alias("declaration"), F.when(is_alarm, status).alias("status"), "alarm", "event.onset", "event.offset",
        of_event(F.col("_first").isNotNull()).alias("detected"), of_event(F.col("_first") - F.col("event.onset")).alias("delay"), of_event(F.coalesce(F.col("_reach") > F.col("event.onset"), F.lit(False))).alias("overlap_detected"))


def declared_in(alarms: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Adds to each alarm (keys, declaration and more) the event of its recording that it is declared in, as event_id and
    onset; null outside. The alarms may be those of many thresholds: their recording's events, which do
    not overlap, stand in the series once."""
    rest = F.struct(*[F.col(c) for c in alarms.columns if c not in keys])
    span = F.struct("event_id", F.col("start").alias("onset"), F.col("end").alias("offset"))
    series = events.select(*keys, F.col("start").alias("_t"), span.alias("_event")).unionByName(
        alarms.select(*keys, F.col("declaration").alias("_t"), rest.alias("_alarm")), allowMissingColumns=True
    )
    is_alarm = F.col("_alarm").isNotNull()
    so_far = W.partitionBy(*keys).orderBy("_t", is_alarm).rowsBetween(W.unboundedPreceding, 0)
    out = series.withColumn("_open", F.last("_event", ignorenulls=True).over(so_far)).where(is_alarm)
    inside = F.col("_t") < F.col("_open.offset")
    return out.select(*keys, "_alarm.*", *[F.when(inside, F.col(f"_open.{c}")).alias(c) for c in ("event_id", "onset")])


def match_alarms(alarms: DataFrame, events: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Alarms with status (matched, duplicate, false) and event_id; events with detection: see :func:`judged`."""
    j = judged(alarms, events, keys)
    rows = j.where("kind = 'alarm'").select(*keys, "alarm.*", F.coalesce("event_id", F.lit("")).alias("event_id"), "status")
    return rows, j.where("kind = 'event' AND detected").select(*keys, "event_id", "declaration", "delay")


def event_matches(alarms: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """One row an event: detected, declaration, delay, and whether any alarm touches it."""
    return judged(alarms, events, keys).where("kind = 'event'").select(
        *keys, "event_id", "onset", "offset", "detected", "declaration", "delay", "overlap_detected"
    )


def match_overlapping(alarms: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`match_alarms` where events of a recording may overlap: each alarm in turn takes the
    first event, by onset and offset, that none has taken. One recording is one group; the
    alarms and events of a recording are few."""

    def run(a: pa.Table, e: pa.Table) -> pa.Table:
        e = sorted(zip(*(e.column(c).to_pylist() for c in ("start", "end", "event_id")), strict=True))
        a = a.sort_by("declaration")
        taken, status, ids = set(), [], []
        for d in a.column("declaration").to_pylist():
            inside = [i for start, end, i in e if start <= d < end]
            free = [i for i in inside if i not in taken]
            taken.update(free[:1])
            status.append("matched" if free else "duplicate" if inside else "false")
            ids.append((free or inside or [""])[0])
        return a.append_column("status", pa.array(status, pa.string())).append_column("event_id", pa.array(ids, pa.string()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in alarms.schema) + ", status string, event_id string"
    return alarms.groupBy(*keys).cogroup(events.groupBy(*keys)).applyInArrow(run, schema)


def _closest(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (a, b, dist) one to one, the closest first, then the earliest: in each round those that are
    the first choice of both sides, which the greedy order would take whatever else it takes, until
    no pair is left. A round settles the closest pair of every chain at least."""
    first = lambda side, other: F.row_number().over(W.partitionBy(*keys, side).orderBy("dist", other)) == 1
    left, taken = stored(pairs, "pairs"), None
    while not left.isEmpty():
        now = stored(left.withColumns({"_a": first("a", "b"), "_b": first("b", "a")}).where("_a AND _b").select(*keys, "a", "b"), "taken")
        taken = now if taken is None else taken.unionByName(now)
        left = stored(left.join(now.select(*keys, "a"), [*keys, "a"], "left_anti").join(now.select(*keys, "b"), [*keys, "b"], "left_anti"), "pairs")
    return left.select(*keys, "a", "b") if taken is None else taken


def alarm_fates(before: DataFrame, after: DataFrame, keys: list[str], near: int) -> DataFrame:
    """What becomes of the alarms of one stream in another, one to one: the same declaration
    (preserved), one at most ``near`` away (shifted), an overlapping alarm (replaced), or none
    (suppressed); alarms of the other stream left over are added. Each stage takes the closest
    pairs first. Candidates come from an index of cells (:mod:`.overlap`), so a recording of many
    alarms makes pairs of neighbours only."""

    def side(d: DataFrame, name: str) -> DataFrame:
        same = F.row_number().over(W.partitionBy(*keys, "declaration").orderBy("end"))
        d = d.select(*keys, F.col("declaration").cast("bigint"), F.col("end").cast("bigint")).withColumn("k", same)
        return stored(d.select(*keys, F.struct("declaration", "end", "k").alias(name)), "alarms")

    a, b = side(before, "a"), side(after, "b")
    rows = None
    for fate in ("preserved", "shifted", "replaced"):
        if fate == "preserved":
            same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys] + [F.col("a.declaration") == F.col("b.declaration"), F.col("a.k") == F.col("b.k")]
            found = a.alias("x").join(b.alias("y"), same).select("x.*", "b")
        else:
            x, y = (F.col("a.declaration"), F.col("a.end")), (F.col("b.declaration"), F.col("b.end"))
            if fate == "shifted":
                x, y = (x[0] - near, x[0] + near + 1), O.point(y[0])
            met = O.overlaps(a, b, keys, x, y, ("p", "q")).select(*keys, "p.a", "q.b")
            found = _closest(met.withColumn("dist", F.abs(F.col("a.declaration") - F.col("b.declaration"))), keys)
        found = stored(found, "found")
        a, b = (stored(d.join(found.select(*keys, c), [*keys, c], "left_anti"), "alarms") for d, c in ((a, "a"), (b, "b")))
        found = found.select(*keys, F.col("a.declaration").alias("declaration"), F.col("b.declaration").alias("other"), F.lit(fate).alias("fate"))
        rows = found if rows is None else rows.unionByName(found)
    none = F.lit(None).cast("bigint")
    return rows.unionByName(
        a.select(*keys, F.col("a.declaration").alias("declaration"), none.alias("other"), F.lit("suppressed").alias("fate"))
    ).unionByName(b.select(*keys, none.alias("declaration"), F.col("b.declaration").alias("other"), F.lit("added").alias("fate")))

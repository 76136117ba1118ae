"""The alarm state machine as window functions.

An alarm opens at the first score at or over its threshold, bridges one low decision, and
closes at the second of two lows, at a barrier, at a missing or unavailable decision, or at
the recording's end. Rows are cut into segments at every break; within a segment, highs at
most two decisions apart form one alarm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Reasons for which an alarm ends.
GAP, MISSING, UNAVAILABLE, TWO_BELOW, END = "annotation_or_acquisition_gap", "missing_decision", "unavailable", "two_below", "recording_end"


def alarm_stream(decisions: DataFrame, keys: list[str], stride: int) -> DataFrame:
    """``decisions``: keys, t, score, available, threshold, duration, and barrier_until and barrier_next
    as :func:`.timeline.around` finds them for disjoint barriers. Back: keys, declaration, end, reason; one row an alarm. Two
    decisions at one time, times outside [0, duration) and scores that count outside [0, 1] stop
    the job."""
    order = W.partitionBy(*keys).orderBy("t")
    ok = F.col("available") & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < F.lit(float("inf")))
    d = decisions.select(
        *keys, "t", "score", "threshold", "duration", F.coalesce(F.col("barrier_until") > F.col("t"), F.lit(False)).alias("held"), "barrier_next",
        ok.alias("ok")
    )
    bad = (F.col("t") < 0) | (F.col("t") >= F.col("duration")) | (F.col("ok") & ~F.col("score").between(0, 1)) | F.coalesce(
        F.lag("t").over(order) == F.col("t"), F.lit(False)
    )
    d = d.withColumn("_bad", bad).withColumn(
        "ok",
        F.when(
            F.col("_bad"), F.raise_error(F.lit("decisions must have times of their own in the recording and scores in [0, 1]")).cast("boolean")
        ).otherwise(F.col("ok"))
    ).drop("_bad")
    t, nxt, stop = F.col("t"), F.col("nt"), F.least(F.col("t") + stride, F.col("duration"))
    d = d.withColumns({"nt": F.lead("t").over(order), "next_ok": F.lead("ok").over(order), "live": F.col("ok") & ~F.col("held")})
    inside = F.when(F.col("barrier_next") < stop, F.col("barrier_next"))
    met = F.when(nxt.isNotNull(), F.when(F.col("held"), t).when(F.col("barrier_next") <= nxt, F.col("barrier_next")))
    cut = F.struct(F.col("_at").alias("at"), F.col("_why").alias("why"))
    d = d.withColumns({"_inside": inside, "_met": met, "_miss": F.when(nxt > t + stride, t + stride)})
    at_end = F.when(F.col("_inside").isNotNull(), F.col("_inside")).otherwise(stop)
    why_end = F.when(F.col("_inside").isNotNull(), GAP).when(stop == F.col("duration"), END).otherwise(MISSING)
    first = F.least("_met", "_miss")
    between = F.when(first.isNotNull(), F.greatest(t, first)).when(~F.col("next_ok"), nxt)
    why_between = F.when(
        F.col("_met").isNotNull() & (F.col("_met") == first), GAP
    ).when(first.isNotNull(), MISSING).when(~F.col("next_ok"), UNAVAILABLE)
    d = d.withColumns(
        {"_at": F.when(nxt.isNull(), at_end).otherwise(between), "_why": F.when(nxt.isNull(), why_end).otherwise(why_between)}
    ).withColumn("cut", cut)
    breaks = F.sum((F.col("_at").isNotNull() | ~F.col("live")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn("segment", F.coalesce(breaks, F.lit(0))).where("live")
    seg = W.partitionBy(*keys, "segment").orderBy("t")
    whole = W.partitionBy(*keys, "segment").orderBy("t").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d = d.withColumns({"k": F.row_number().over(seg), "low2": F.lead("t", 2).over(seg), "last_cut": F.last("cut").over(whole)})
    high = d.where("score >= threshold")
    new = F.coalesce((F.col("k") - F.lag("k").over(seg) > 2).cast("int"), F.lit(1))
    high = high.withColumn("_new", new).withColumn("island", F.sum("_new").over(seg.rowsBetween(W.unboundedPreceding, 0)))
    out = high.groupBy(*keys, "segment", "island").agg(F.min("t").alias("declaration"), F.max_by(F.struct("low2", "last_cut"), "t").alias("z"))
    closed = F.col("z.low2").isNotNull()
    return out.select(
        *keys, "declaration", F.when(closed, F.col("z.low2")).otherwise(F.col("z.last_cut.at")).alias("end"),
        F.when(closed, TWO_BELOW).otherwise(F.col("z.last_cut.why")).alias("reason")
    )


def reached(score: Column, thresholds: list[float]) -> Column:
    """How many of the thresholds, which ascend, a score reaches: it reaches the first so many."""
    return sum((F.when(score >= x, 1).otherwise(0) for x in thresholds), F.lit(0))


def alarm_levels(
    decisions: DataFrame, keys: list[str], stride: int, thresholds: list[float], name: str, families: dict[object, tuple[Column, Column]], at: str = "at",
    ends: bool = True
) -> DataFrame:
    """The alarms of every threshold and several scores at once: what :func:`alarm_stream` gives for each
    of them, from one sort of the decisions, a row each.

    ``families``: for each value of the column ``name`` the score, and how many ``thresholds`` (ascending)
    a decision is high at: always the first so many. A decision begins an alarm at those of its
    thresholds that neither of the two before it reaches, and ends one at those that neither of the two
    after it does, so both are ranges of thresholds, and only where an alarm begins or ends is there a
    row a threshold. ``decisions`` as in :func:`alarm_stream`, without score and threshold. Back: keys,
    ``name``, ``at`` (the threshold), declaration, end, reason; the last two only with ``ends``, without which nothing after a
    decision is looked at."""
    order = W.partitionBy(*keys).orderBy("t")
    numbered = list(enumerate(families.items()))
    d = decisions.select(
        *keys, "t", "duration", "barrier_next", F.coalesce(F.col("barrier_until") > F.col("t"), F.lit(False)).alias("held"), F.col("available").alias("_available"),
        *[c for i, (_, (score, level)) in numbered for c in (score.cast("double").alias(f"_score{i}"), F.coalesce(level, F.lit(0)).cast("int").alias(f"_high{i}"))],
    )
    usable = lambda s: F.col("_available") & s.isNotNull() & ~F.isnan(s) & (F.abs(s) < F.lit(float("inf")))
    d = d.withColumns({f"_ok{i}": F.coalesce(usable(F.col(f"_score{i}")), F.lit(False)) for i, _ in numbered})
    bad = (F.col("t") < 0) | (F.col("t") >= F.col("duration")) | F.coalesce(F.lag("t").over(order) == F.col("t"), F.lit(False))
    for i, _ in numbered:
        bad = bad | (F.col(f"_ok{i}") & ~F.col(f"_score{i}").between(0, 1))
    t, nxt, stop = F.col("t"), F.col("_nt"), F.least(F.col("t") + stride, F.col("duration"))
    d = d.withColumns({"_bad": bad, "_nt": F.lead("t").over(order)} | {f"_next{i}": F.lead(f"_ok{i}").over(order) for i, _ in numbered})
    wrong = F.raise_error(F.lit("decisions must have times of their own in the recording and scores in [0, 1]")).cast("boolean")
    d = d.withColumn("held", F.when(F.col("_bad"), wrong).otherwise(F.col("held")))
    inside = F.when(F.col("barrier_next") < stop, F.col("barrier_next"))
    met = F.when(nxt.isNotNull(), F.when(F.col("held"), t).when(F.col("barrier_next") <= nxt, F.col("barrier_next")))
    d = d.withColumns({"_inside": inside, "_met": met, "_first": F.least(met, F.when(nxt > t + stride, t + stride))})

    def cut(i: int) -> Column:
        """Where and why whatever is going on at a decision stops before the next one, if it does."""
        last_at = F.coalesce(F.col("_inside"), stop)
        last_why = F.when(F.col("_inside").isNotNull(), GAP).when(stop == F.col("duration"), END).otherwise(MISSING)
        by_next = ~F.col(f"_next{i}")
        here = F.when(F.col("_first").isNotNull(), F.greatest(t, F.col("_first"))).when(by_next, nxt)
        why = F.when(F.col("_met") == F.col("_first"), GAP).when(F.col("_first").isNotNull(), MISSING).when(by_next, UNAVAILABLE)
        return F.struct(F.when(nxt.isNull(), last_at).otherwise(here).alias("at"), F.when(nxt.isNull(), last_why).otherwise(why).alias("why"))

    d = d.withColumns({f"_cut{i}": cut(i) for i, _ in numbered} | {f"_live{i}": F.col(f"_ok{i}") & ~F.col("held") for i, _ in numbered})
    breaks = lambda i: (F.col(f"_cut{i}.at").isNotNull() | ~F.col(f"_live{i}")).cast("int")
    d = d.withColumns({f"_seg{i}": F.coalesce(F.sum(breaks(i)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) for i, _ in numbered})
    seg = lambda i: F.when(F.col(f"_live{i}"), F.col(f"_seg{i}"))
    lasting = {f"_in{i}": seg(i) for i, _ in numbered} | {f"_up{i}": F.when(F.col(f"_live{i}"), F.col(f"_high{i}")).otherwise(0) for i, _ in numbered}
    d = d.select(*keys, "t", *[f"_cut{i}" for i, _ in numbered if ends], *[c.alias(n) for n, c in lasting.items()])
    offsets = (-2, -1, 1, 2) if ends else (-2, -1)
    moved = lambda c, k: (F.lag(c, -k) if k < 0 else F.lead(c, k)).over(order)
    d = d.withColumns(
        {f"{n}_{k}": moved(n, k) for n in lasting for k in offsets} | ({f"_cut{i}_1": moved(f"_cut{i}", 1) for i, _ in numbered} | {"_t_2": moved("t", 2)} if ends else {})
    )

    def of(i: int, value: object) -> Column:
        near = lambda k: F.coalesce(F.col(f"_in{i}_{k}") == F.col(f"_in{i}"), F.lit(False))
        high = lambda k: F.when(near(k), F.col(f"_up{i}_{k}")).otherwise(0)
        mine = [F.lit(value).alias("name"), F.col(f"_up{i}").alias("high"), F.greatest(high(-1), high(-2)).alias("before")]
        if not ends:
            return F.struct(*mine)
        closed, final = near(2), F.when(near(1), F.col(f"_cut{i}_1")).otherwise(F.col(f"_cut{i}"))
        return F.struct(
            *mine, F.greatest(high(1), high(2)).alias("after"),
            F.struct(F.when(closed, F.col("_t_2")).otherwise(final["at"]).alias("end"), F.when(closed, TWO_BELOW).otherwise(final["why"]).alias("reason")).alias("stop")
        )

    d = d.select(*keys, "t", F.inline(F.array(*[of(i, value) for i, (value, _) in numbered])))
    threshold = F.array(*map(F.lit, thresholds))[F.col("_j") - 1].alias(at)
    if not ends:
        begun = d.where("high > before").withColumn("_j", F.explode(F.sequence(F.col("before") + 1, F.col("high"))))
        return begun.select(*keys, F.col("name").alias(name), threshold, F.col("t").alias("declaration"))
    d = d.where("high > least(before, after)").withColumn("_j", F.explode(F.sequence(F.least("before", "after") + 1, F.col("high"))))
    one = W.partitionBy(*keys, "name", "_j").orderBy("t")
    d = d.withColumn("stop", F.when(F.col("_j") > F.col("after"), F.col("stop")).otherwise(F.lead("stop").over(one))).where("_j > before")
    return d.select(*keys, F.col("name").alias(name), threshold, F.col("t").alias("declaration"), "stop.*")

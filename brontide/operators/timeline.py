"""Decision timelines: anchors on a fixed stride with trailing supports, and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import overlap as O

PIECES, PIECE_ROWS = 64, 256  # tasks for the folds of a group, and folds for which one is enough


def anchors(recordings: DataFrame, first: int, stride: int) -> DataFrame:
    """``recordings``: keys and duration. One row for each t = first, first + stride, ... < duration."""
    if stride <= 0 or first <= 0:
        raise ValueError("context and stride must be positive")
    grid = F.when(
        F.col("duration") > first, F.sequence(F.lit(first), F.col("duration") - 1, F.lit(stride))
    ).otherwise(F.array().cast("array<bigint>"))
    return recordings.withColumn("t", F.explode(grid))


def trailing(samples: DataFrame, keys: list[str], context: int, first: int, stride: int, duration: int, aggs: list[Column]) -> DataFrame:
    """Aggregates over the samples (at x) in [t - context, t) of each anchor t that has any. Each
    sample goes to the few anchors that see it, so no range join is needed."""
    low = F.greatest(F.lit(0), F.ceil((F.col("x") + 1 - first) / stride))
    high = F.least(F.lit((duration - 1 - first) // stride), F.floor((F.col("x") + context - first) / stride))
    seen = samples.withColumn("_k", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    return seen.withColumn("t", first + F.col("_k") * stride).groupBy(*keys, "t").agg(*aggs)


def trailing_sums(recordings: DataFrame, samples: DataFrame, keys: list[str], context: int, first: int, stride: int, value: str) -> DataFrame:
    """The anchors of ``recordings`` (as :func:`anchors` has them), each with the sum of ``value`` over the samples (at
    x) in [t - context, t), and <value>_n, of how many that aren't null. A sample joins the sum at the first anchor that
    sees it and leaves it after the last one; both are rows of one series with the anchors, so a running
    sum serves and nothing is joined: a planner takes an exploded grid for as small as its recordings
    and would broadcast it. Samples of a null key belong to no recording."""
    enters = F.greatest(F.lit(0), F.ceil((F.col("x") + 1 - first) / stride))
    leaves = F.floor((F.col("x") + context - first) / stride) + 1
    step = lambda k, sign: F.struct((first + k * stride).alias("t"), (sign * F.col(value)).alias("_sum"), F.lit(sign).alias("_n"))
    counts = samples.where(F.col(value).isNotNull() & (enters < leaves)).dropna(subset=keys)
    steps = counts.select(*keys, F.inline(F.array(step(enters, 1), step(leaves, -1))))
    series = anchors(recordings, first, stride).withColumn("_anchor", F.lit(True)).unionByName(steps, allowMissingColumns=True)
    seen = W.partitionBy(*keys).orderBy("t").rangeBetween(W.unboundedPreceding, W.currentRow)
    n, total = F.coalesce(F.sum("_n").over(seen), F.lit(0)), F.sum("_sum").over(seen)
    out = series.withColumns({f"{value}_n": n, value: F.when(n > 0, total)}).where("_anchor")
    return out.select(*recordings.columns, "t", value, f"{value}_n")


def around(points: DataFrame, spans: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Adds to each point (keys, t) what lies around it: for each name ``<name>_until``, the latest end of
    the spans that start at or before t, and ``<name>_next``, the earliest start after t. All are one
    series in time order, so a recording of many points and spans makes no pairs of them."""
    rest = [c for c in points.columns if c not in keys]
    series = points.select(*keys, F.col("t").alias("_t"), F.lit("").alias("_kind"), F.struct(*rest).alias("_row"))
    for name, s in spans.items():
        series = series.unionByName(
            s.select(*keys, F.col("start").alias("_t"), F.lit(name).alias("_kind"), F.col("end").alias("_end")), allowMissingColumns=True
        )
    point = F.col("_kind") == ""
    up = W.partitionBy(*keys).orderBy("_t", point)
    down = W.partitionBy(*keys).orderBy(F.desc("_t"), F.desc(point))
    found = {}
    for name in spans:
        mine = F.col("_kind") == name
        found |= {
            f"{name}_until": F.max(F.when(mine, F.col("_end"))).over(up.rowsBetween(W.unboundedPreceding, 0)),
            f"{name}_next": F.min(F.when(mine, F.col("_t"))).over(down.rowsBetween(W.unboundedPreceding, -1))
        }
    return series.withColumns(found).where(point).select(*keys, "_row.*", *found)


def label(timeline: DataFrame, events: DataFrame, uncertain: DataFrame, keys: list[str], exclusion: int) -> DataFrame:
    """Label of each anchor, by precedence: uncertain (-1), inside an event (1), within
    ``exclusion`` of one (-1), negative (0). ``events``: keys, number, start, end; they may overlap.
    The numbers of the events that hold an anchor are looked up for positive anchors only."""
    if exclusion < 0:
        raise ValueError("exclusion must not be negative")
    t = F.col("t")
    out = around(timeline, {"_ev": events, "_un": uncertain}, keys)
    holds = lambda c: F.coalesce(c, F.lit(False))
    hit, unsure = holds(F.col("_ev_until") > t), holds(F.col("_un_until") > t)
    near = holds(F.col("_ev_until") + exclusion > t) | holds(F.col("_ev_next") - exclusion <= t)
    status = F.when(unsure, "annotation_uncertain").when(hit, "positive").when(near, "ignore").otherwise("negative")
    out = out.withColumns(
        {"annotation_uncertain": unsure, "status": status, "evaluation_label": F.when(unsure, -1).otherwise(hit.cast("int"))}
    ).drop("_ev_until", "_ev_next", "_un_until", "_un_next")
    inside = O.overlaps(out.where("status = 'positive'").select(*keys, "t"), events, keys, O.point(t), (F.col("start"), F.col("end")), ("p", "e"))
    inside = inside.select(*keys, "p.t", "e.start", "e.end", "e.number")
    numbers = inside.groupBy(*keys, "t").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("start", "end", "number"))), lambda e: e["number"].cast("string")), "|"
        ).alias("event_numbers")
    )
    out = out.join(numbers.hint("merge"), [*keys, "t"], "left").fillna("", ["event_numbers"])
    return out.withColumns(
        {
            "label": F.when(F.col("status") == "positive", 1).when(F.col("status") == "negative", 0).otherwise(-1),
            "training_eligible": F.col("status").isin("positive", "negative")
        }
    )


def leave_one_out(recordings: DataFrame, group: str, item: str, separator: str | None = None) -> DataFrame:
    """Folds: each item of a group is the test item once, the others train; items in text order. ``train`` is an array, or, with
    a ``separator``, the others' text, null where there are none. Rows hold their whole group, so the result grows with its
    square; what is shuffled doesn't, as a group's list goes to ``PIECES`` tasks at most, which make its rows one by
    one. A text is cut out of the group's, not put together anew."""
    items, text, gap = recordings.select(group, item).distinct(), separator is not None, len((separator or "").encode())
    order, n = W.partitionBy(group).orderBy(F.col(item).asc_nulls_last()), F.size("_all")
    before = F.coalesce(F.sum(F.octet_length(item) + gap).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    d = items.withColumns({"fold": F.row_number().over(order) - 1, "_before": before})
    d = d.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("fold", "_before", F.col(item).alias("test")))).alias("_folds"))
    d = d.withColumn("_all", F.filter("_folds.test", lambda x: x.isNotNull()))
    d = d.withColumn("_each", F.ceil(F.greatest(F.size("_folds") / PIECES, F.lit(PIECE_ROWS))).cast("int"))
    d = d.select(
        group, n.alias("_n"), (F.array_join("_all", separator).cast("binary") if text else F.col("_all")).alias("_all"), "_folds", "_each",
        F.explode(F.sequence(F.lit(0), F.ceil(F.size("_folds") / F.col("_each")).cast("int") - 1)).alias("_piece")
    ).withColumn("_folds", F.slice("_folds", F.col("_piece") * F.col("_each") + 1, F.col("_each")))
    # As many tasks as named: these rows are few and short beside what is made of them.
    d = d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), group, "_piece").select(group, "_n", "_all", F.inline("_folds"))
    if text:
        head = F.col("_before") - F.when(F.col("fold") == F.col("_n") - 1, gap).otherwise(0)
        tail = F.substring("_all", F.col("_before") + F.octet_length("test") + gap + 1, F.octet_length("_all"))
        train = F.when(F.col("_n") > 1, F.concat(F.substring("_all", F.lit(1), head), tail).cast("string"))
    else:
        train = F.concat(F.slice("_all", F.lit(1), F.col("fold")), F.slice("_all", F.col("fold") + 2, F.col("_n")))
    return d.select(group, "fold", train.alias("train"), "test")


def cut_windows(segments: DataFrame, context_s: int, stride_s: int, first_s: int, chunk_s: int, halo_s: int) -> DataFrame:
    """The trailing windows [t - context, t) of chunks read with a halo: each anchor belongs to one chunk,
    whose halo holds its past, so windows are slices within a row and nothing is shuffled.
    ``segments``: path, channel_index, start_s, sampling_rate, samples. Anchors are first_s,
    first_s + stride_s, ... before the end of the recording."""
    if not context_s <= halo_s < chunk_s:
        raise ValueError("the halo must hold a context and be shorter than a chunk")
    start, fs = F.col("start_s"), F.col("sampling_rate")
    low = F.floor((start + halo_s) / chunk_s) * chunk_s
    stop = start + F.size("samples") / fs
    last = F.least(low + chunk_s, stop)
    begin = F.lit(first_s) + F.ceil((F.greatest(low, F.lit(max(first_s, context_s))) - first_s) / stride_s) * stride_s
    t = F.explode(F.filter(F.sequence(begin, F.greatest(begin, F.ceil(last)), F.lit(stride_s).cast("bigint")), lambda x: x < last)).alias("t")
    cut = segments.select("path", "channel_index", "start_s", "sampling_rate", "samples", t)
    at = F.round((F.col("t") - context_s - start) * fs).cast("int") + 1
    return cut.select("path", "channel_index", "t", "sampling_rate", F.slice("samples", at, F.round(context_s * fs).cast("int")).alias("samples"))

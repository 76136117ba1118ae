"""The result tables of a comparison of model variants, as lazily evaluated tables by name.

Every table follows from one judged series of alarms and events per recording and model; levels
(recording, group, pooled) are aggregated from it anew, so delays are never averages of averages.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import alarms as A
from . import checks as V
from . import intervals as I
from . import matching as M
from . import metrics as Q
from . import overlap as O
from . import reports as R
from . import timeline as T
from .selection import grid
from .staging import stored

#: Models, and the measures that are compared pair by pair.
MODELS = ["F0", "F1", "F2", "F3"]
PAIRED = ["detected", "missed", "false_declarations", "false_per_hour", "delay_median", "warning_fraction", "longest", "evaluable"]
LEVELS = {"parent": ["grp", "rec"], "patient": ["grp"], "pooled": []}


def level_metrics(judged: DataFrame, budget: DataFrame, counts: DataFrame, level: list[str]) -> DataFrame:
    """Detection, time and score quality of each model at a level. ``counts``: :func:`.metrics.score_counts` of
    level and model."""
    by, few = [*level, "model"], "rec" in level
    return Q.summarize(judged, budget, by, few=few).join(Q.counted_quality(counts, by, few), by, "left").fillna(0, ["window_n", "window_positive"])


def paired_comparison(metrics: dict[str, DataFrame], base: str = "F0", fused: str = "F2") -> DataFrame:
    """Each level's measures of two models side by side with their differences, stacked."""
    out = None
    for level, keys in LEVELS.items():
        m = metrics[level]
        side = lambda model, name: m.where(F.col("model") == model).select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in [*PAIRED, "raw"]])  # noqa: E731, B023
        a, b = side(base, "eeg"), side(fused, "fusion")
        j = a.join(b, keys) if keys else a.crossJoin(b)  # a row each
        far, far0 = F.col("fusion_false_per_hour"), F.col("eeg_false_per_hour")
        j = j.select(
            F.lit(level).alias("level"), *[F.col(k) if k in keys else F.lit(None).cast("bigint").alias(k) for k in ("grp", "rec")], *[x for c in PAIRED for x in (f"eeg_{c}", f"fusion_{c}", (F.col(f"fusion_{c}") - F.col(f"eeg_{c}")).alias(f"delta_{c}"))],
            F.when(far0 > 0, (far / far0 - 1) * 100).alias("far_change_pct"), ((F.col("fusion_evaluable") - F.col("eeg_evaluable")) / F.col("eeg_raw") * 100).alias("coverage_delta_pct"))
        out = j if out is None else out.unionByName(j)
    return out


def event_comparison(judged: DataFrame, stream: DataFrame, keys: list[str], stride: int) -> DataFrame:
    """What the fused model does to each event of the first, whether the second modality counted at
    the onset, and for which share of the event. ``stream``: the fused model's decisions."""
    of = lambda model, c: F.max(F.when(F.col("model") == model, F.col(c)))
    j = judged.where("kind = 'event'").groupBy(*keys, "event_id", "onset", "offset").agg(
        of("F0", "detected").alias("eeg_detected"), of("F2", "detected").alias("fusion_detected"), of("F0", "delay").alias("eeg_delay"),
        of("F2", "delay").alias("fusion_delay")
    )
    j = R.event_classes(j, F.col("eeg_delay"), F.col("fusion_delay")).withColumn("delay_delta", F.col("fusion_delay") - F.col("eeg_delay"))
    j = V.state_at(j, stream, keys, "onset", stride, "q").withColumn("ecg_available_at_onset", F.coalesce("q_at", F.lit(False))).drop("q_at")
    counted = I.cells(stream.where("q"), keys, stride, F.col("duration"))
    span = j.select(*keys, "event_id", F.col("onset").alias("start"), F.col("offset").alias("end"))
    both = O.overlaps(span, counted, keys, (F.col("start"), F.col("end")), (F.col("start"), F.col("end")), ("e", "c"))
    length = F.least("e.end", "c.end") - F.greatest("e.start", "c.start")
    inside = both.groupBy(*keys, F.col("e.event_id").alias("event_id")).agg(F.sum(length).alias("_q"))
    j = j.join(inside, [*keys, "event_id"], "left").fillna(0, ["_q"])
    return j.withColumn(
        "ecg_ictal_available_fraction", F.try_divide(F.col("_q").cast("double"), (F.col("offset") - F.col("onset")).cast("double"))
    ).drop("_q")


class Tables(Mapping):
    """Tables by name, each made when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self.makers = {name: cache(make) for name, make in makers.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self.makers[name]()

    def __iter__(self):
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


UNIT, KEYS = ["grp", "rec", "model"], ["grp", "rec"]


def build_tables(streams: DataFrame, events: DataFrame, uncertain: DataFrame, startup: int, stride: int) -> Tables:
    """``streams``: grp, rec, t, duration, model (of ``MODELS``), score, threshold, available, q, alpha, label;
    ``events``: rec, event_id, start, end; ``uncertain``: rec, start, end. A table runs what it needs,
    and what several need is stored once."""
    kept = cache(lambda: stored(streams, "streams"))
    recordings = cache(lambda: kept().select(*UNIT, "duration").distinct())
    spread = lambda d: recordings().drop("duration").join(d, "rec")
    return _tables(
        kept, lambda: spread(events), lambda: I.exposure(kept(), spread(uncertain), None, UNIT, stride, F.col("duration")),
        lambda: A.alarm_stream(T.around(kept(), {"barrier": uncertain}, ["rec"]), UNIT, stride),
        lambda: Q.time_budget(recordings(), kept(), spread(uncertain), UNIT, startup, stride), stride
    )


def aligned_tables(decisions: DataFrame, events: DataFrame, uncertain: DataFrame, startup: int, stride: int) -> Tables:
    """:func:`build_tables` where all models decide at the same times and are available together.
    ``decisions``: grp, rec, t, duration, available, q, label, and for each of ``MODELS`` a column of its
    name with score, threshold and alpha. A decision is stored as one row, the barriers around it are found
    once for all models, and exposure is measured once a recording."""
    kept = cache(lambda: stored(decisions, "decisions"))
    shared = [c for c in decisions.columns if c not in MODELS]
    stacked = lambda d, keep, *of: d.select(*keep, F.inline(F.array(*[F.struct(F.lit(m).alias("model"), *[f"{m}.{c}" for c in of]) for m in MODELS])))
    streams = cache(lambda: stacked(kept(), shared, "score", "threshold", "alpha"))
    recordings = cache(lambda: stored(kept().select(*KEYS, "duration").distinct(), "recordings"))
    spread = lambda d: recordings().drop("duration").join(d, "rec")
    each = lambda d: grid(d, "model", MODELS)
    seen = ["t", "duration", "available"]
    held = lambda: T.around(kept().select(*KEYS, *seen, *MODELS), {"barrier": uncertain}, ["rec"])
    return _tables(
        streams, lambda: each(spread(events)), lambda: each(I.exposure(kept(), spread(uncertain), None, KEYS, stride, F.col("duration"))),
        lambda: A.alarm_stream(stacked(held(), [*KEYS, *seen, "barrier_until", "barrier_next"], "score", "threshold"), UNIT, stride),
        lambda: each(Q.time_budget(recordings(), kept(), spread(uncertain), KEYS, startup, stride)), stride
    )


def _tables(
    kept: Callable[[], DataFrame], events: Callable[[], DataFrame], exposed: Callable[[], DataFrame], declared: Callable[[], DataFrame],
    timed: Callable[[], DataFrame], stride: int
) -> Tables:
    """The tables from the streams and, of each recording and model, its events, exposure, alarms and times."""
    unit, keys = UNIT, KEYS
    sums = [F.sum(c).alias(c) for c in ("evaluable", "q1", "q0", "active")]
    part = F.try_divide(F.col("q1").cast("double"), F.col("evaluable").cast("double"))
    fused = cache(lambda: kept().where("model = 'F2'"))
    alphas = cache(lambda: fused().groupBy(*keys).agg(F.first("alpha").alias("alpha")))
    exposure = cache(exposed)
    judged = cache(lambda: stored(M.judged(declared(), events(), unit), "judged"))
    budget = cache(lambda: stored(timed(), "budget"))
    scores = cache(lambda: Q.score_counts(kept().where("available"), unit))
    counts = lambda level: scores() if level == keys else Q.rolled_up(scores(), [*level, "model"])
    metrics = {
        name: cache(lambda name=name, level=level: stored(level_metrics(judged(), budget(), counts(level), level), name))
        for name, level in LEVELS.items()
    }
    alarms = cache(lambda: judged().where("kind = 'alarm'").select(*unit, "alarm.*", "status", F.coalesce("event_id", F.lit("")).alias("event_id")))
    wrong = lambda model: alarms().where((F.col("status") != "matched") & (F.col("model") == model)).drop("model")
    fates = cache(lambda: stored(M.alarm_fates(wrong("F0"), wrong("F2"), keys, stride), "fates"))

    @cache
    def shares() -> DataFrame:
        counted = I.cells(fused().where("q"), keys, stride, F.col("duration"))
        q1 = R.contribution(exposure().where("model = 'F2'").drop("model"), counted, keys)
        return q1.join(alphas(), keys).withColumn("active", F.when(F.col("alpha") > 0, F.col("q1")).otherwise(0))

    def fate_rows() -> DataFrame:
        at = fused().select(*keys, F.col("t").alias("declaration"), "q", "alpha", "score", "threshold")
        return fates().where("fate <> 'added'").join(at, [*keys, "declaration"], "left")

    return Tables({
        "fold_metrics": metrics["parent"], "patient_metrics": metrics["patient"], "pooled_metrics": metrics["pooled"], "alarms": alarms,
        "event_matches": lambda: judged().where("kind = 'event'").select(*unit, "event_id", "onset", "offset", "detected", "declaration", "delay", "overlap_detected"),
        "evaluation_exposure": exposure, "paired_comparison": lambda: paired_comparison({name: m() for name, m in metrics.items()}),
        "event_comparison": lambda: event_comparison(judged(), fused(), keys, stride).join(alphas(), keys), "false_alarm_fate": fate_rows,
        "added_false_alarms": lambda: wrong("F2").join(fates().where("fate = 'added'").select(*keys, F.col("other").alias("declaration")), [*keys, "declaration"]),
        "ecg_contribution_recordings": shares, "ecg_contribution_patients": lambda: shares().groupBy("grp").agg(*sums).withColumn("q1_fraction", part),
        "alpha_distribution": lambda: shares().groupBy("grp", "alpha").agg(F.count("*").alias("folds"), *sums),
    })


def fate_counts(fates: DataFrame, level: list[str]) -> DataFrame:
    return fates.groupBy(*level, "fate").agg(F.count("*").alias("n"))


def model_means(metrics: DataFrame, columns: list[str], pooled: DataFrame | None = None) -> DataFrame:
    """Mean over folds of each model's measures, beside the pooled ones where given."""
    means = metrics.groupBy("model").agg(*[F.avg(c).alias(f"fold_mean_{c}") for c in columns])
    return means if pooled is None else means.join(pooled.select("model", *[F.col(c).alias(f"pooled_{c}") for c in columns]), "model")

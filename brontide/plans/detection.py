"""Queries on timelines, alarms, matching, metrics and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alarms as A
from ..operators import fusion as U
from ..operators import intervals as I
from ..operators import matching as M
from ..operators import metrics as Q
from ..operators import proximity as P
from ..operators import reports as R
from ..operators import results as N
from ..operators import selection as S
from ..operators import timeline as T
from ..operators.staging import stored
from ..sources import replay as Y
from . import binding as B

SWEEP = S.THRESHOLDS
K = B.KEY
ALARM_AT = 0.5


def _alarms(spark, sf, threshold=ALARM_AT):
    return A.alarm_stream(B.ready(spark, sf).withColumn("threshold", F.lit(threshold)), K, B.STRIDE)


def _budget(spark, sf):
    return Q.time_budget(B.recordings(spark, sf), B.decisions(spark, sf), B.uncertain(spark, sf), K, B.SHORT, B.STRIDE)


def q01_alarm_eval(spark, sf):
    judged = M.judged(_alarms(spark, sf), B.events(spark, sf), K)
    out = Q.summarize(judged, _budget(spark, sf), K)
    return out.select(
        "rec", "events", "detected", "overlap_detected", "false_declarations", "duplicate_declarations", "total_declarations", "evaluable", "delay_n",
        "delay_median", "delay_q25", "sensitivity", "false_per_hour", "warning_fraction", "longest"
    )


def q02_alarm_intervals(spark, sf):
    return _alarms(spark, sf)


def q03_event_matches(spark, sf):
    return M.event_matches(_alarms(spark, sf), B.events(spark, sf), K)


def q04_exposure_intervals(spark, sf):
    d = B.decisions(spark, sf)
    return I.exposure(d, B.uncertain(spark, sf), None, K, B.STRIDE, F.col("duration"))


def q05_interval_union(spark, sf):
    return I.union_intervals(B.raw_events(spark, sf), K)


def q06_interval_difference_seconds(spark, sf):
    return I.measure(I.subtract_intervals(B.raw_events(spark, sf), B.uncertain(spark, sf), K), K, "micros")


def q07_interval_intersection(spark, sf):
    return I.intersect_intervals(B.raw_events(spark, sf), B.uncertain(spark, sf), K)


def q08_time_budget(spark, sf):
    return Q.time_budget(B.recordings(spark, sf), B.decisions(spark, sf), B.uncertain(spark, sf), K, B.SHORT, B.STRIDE)


def _labelled(spark, sf):
    ev = B.events(spark, sf).withColumn("number", F.floor(F.col("start") / B.HOUR))
    return T.label(B.decisions(spark, sf), ev, B.uncertain(spark, sf), K, 6 * B.HOUR)


def q09_timeline_labels(spark, sf):
    return _labelled(spark, sf).select("rec", "t", "label", "status", "evaluation_label", "training_eligible", "event_numbers")


def q10_label_contingency(spark, sf):
    kinds = ["annotation_uncertain", "positive", "ignore", "negative"]
    out = _labelled(spark, sf).groupBy("rec").pivot("status", kinds).count().fillna(0)
    return out.withColumn("usable", F.col("positive") + F.col("negative"))


def _group(d):
    return d.withColumn("grp", F.col("rec") % 5)


def _sweep(spark, sf, fold):
    """Metrics of every threshold in one job, from one sort of the decisions."""
    score, unit = F.col("score"), [*K, *fold]
    ready, events, budget = (_group(d).select(*[c for c in d.columns if c not in unit], *unit) for d in (B.ready(spark, sf), B.events(spark, sf), _budget(spark, sf)))
    alarms = A.alarm_levels(ready, unit, B.STRIDE, SWEEP, "family", {"one": (score, A.reached(score, SWEEP))}, at="thr", ends=False).drop("family")
    out = S.sweep(alarms, events, budget, K, fold, {"thr": SWEEP})[0].withColumnRenamed("thr", "threshold")
    return out.select(*fold, "threshold", "events", "evaluable", "false_declarations", "detected", "delay_median", "sensitivity", "false_per_hour")


def q11_threshold_sweep(spark, sf):
    return _sweep(spark, sf, [])


def q12_threshold_choice(spark, sf):
    return S.choose(_sweep(spark, sf, ["grp"]), ["grp"], limit=0.02)


def _aligned(spark, sf):
    one, two = (U.specific(d(spark, sf), n).select("rec", "t", "duration", f"available{n}", f"score{n}") for d, n in ((B.decisions, "1"), (B.decisions2, "2")))
    return U.align(one, two, ["rec", "t"], ["duration"])


def q13_fusion_scores(spark, sf):
    return U.late(_aligned(spark, sf), F.lit(0.25), F.lit(0.45), F.lit(0.5)).select("rec", "t", "q", "score", "threshold")


def _both(spark, sf):
    early = F.when(F.col("score1").isNotNull(), F.least(F.lit(1.0), F.col("score1") * 0.5 + F.coalesce("score2", F.lit(0.0)) * 0.5))
    return _aligned(spark, sf).withColumn("score_early", early)


def _stream(spark, sf):
    return U.variants(_both(spark, sf), 0.5, F.lit(0.25), F.lit(ALARM_AT))


def q15_model_variants(spark, sf):
    s = U.binarise(_stream(spark, sf))
    return s.groupBy("rec", "model").agg(
        F.count("*").alias("n"), F.count("score").alias("n_scored"), F.sum(F.col("high").cast("bigint")).alias("n_high")
    )


def _variant_alarms(spark, sf):
    """Alarms of F0 and F2; the barriers around a decision are found once for both."""
    d = _both(spark, sf).select("rec", "t", "duration", F.col("available1").alias("available"), "score1", "available2", "score2", "score_early")
    held = T.around(d, {"barrier": B.uncertain(spark, sf)}, K)
    return A.alarm_stream(U.variants(held, 0.5, F.lit(0.25), F.lit(ALARM_AT)).where("model IN ('F0', 'F2')"), ["rec", "model"], B.STRIDE)


def _variant_events(spark, sf):
    return S.grid(B.events(spark, sf), "model", ["F0", "F2"])


def q16_paired_levels(spark, sf):
    judged, _ = M.match_alarms(_variant_alarms(spark, sf), _variant_events(spark, sf), ["rec", "model"])
    n = judged.withColumn("grp", F.col("rec") % 5).groupingSets([["grp", "rec"], ["grp"], []], "grp", "rec").agg(
        *[F.count_if((F.col("model") == m) & (F.col("status") == "matched")).alias(f"{m.lower()}_detected") for m in ("F0", "F2")],
        *[F.count_if((F.col("model") == m) & (F.col("status") != "matched")).alias(f"{m.lower()}_false") for m in ("F0", "F2")],
        F.grouping_id().alias("gid"))
    level = F.when(F.col("gid") == 0, "parent").when(F.col("gid") == 1, "patient").otherwise("pooled")
    change = F.try_divide((F.col("f2_false") - F.col("f0_false")).cast("double"), F.col("f0_false").cast("double")) * 100
    return n.select(
        level.alias("level"), "grp", "rec", "f0_detected", "f2_detected", (F.col("f2_detected") - F.col("f0_detected")).alias("delta_detected"),
        (F.col("f2_false") - F.col("f0_false")).alias("delta_false"), change.alias("false_change_pct")
    )


def q17_event_fates(spark, sf):
    m = M.event_matches(_variant_alarms(spark, sf), _variant_events(spark, sf), ["rec", "model"])
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("delay")))
    j = m.groupBy("rec", "event_id").agg(of("F0").alias("delay0"), of("F2").alias("delay2"))
    return R.event_classes(j, F.col("delay0"), F.col("delay2"))


def q18_false_alarm_fate(spark, sf):
    judged, _ = M.match_alarms(_variant_alarms(spark, sf), _variant_events(spark, sf), ["rec", "model"])
    wrong = judged.where("status <> 'matched'")
    return M.alarm_fates(wrong.where("model = 'F0'"), wrong.where("model = 'F2'"), K, B.STRIDE)


def q67_replay(spark, sf):
    """Matches of events made anew against a copy in which some delays were altered and some events lost; stored, as both sides
    are read for fingerprints and again for rows."""
    made = stored(q03_event_matches(spark, sf).select("rec", "event_id", "onset", "detected", "delay", "overlap_detected"), "matches")
    kept = made.where("rec % 11 <> 3").withColumn("delay", F.when(F.col("rec") % 7 == 2, F.col("delay") + 1).otherwise(F.col("delay")))
    out = Y.differences(made, kept, ["rec", "event_id"])
    k = F.from_json("key", "rec bigint, event_id string")
    return out.select(k["rec"].alias("rec"), k["event_id"].alias("event_id"), F.col("column").alias("cell"), F.when(F.col("column") != Y.ROW, F.col("made")).alias("made"), "kept")


def q19_asof_state(spark, sf):
    d2 = B.decisions2(spark, sf).where("available").select("rec", "t", F.col("score").alias("state"))
    out = P.asof_backward(_alarms(spark, sf).select("rec", "declaration"), d2, K, "declaration", "t", ["state"], 8 * B.HOUR)
    kind = F.when(F.col("state").isNull(), "unavailable").when(F.col("state") < 0.25, "low").otherwise("larger")
    return out.withColumn("kind", kind)


def q20_band_coincidence(spark, sf):
    second = T.around(B.decisions2(spark, sf), {"barrier": B.uncertain(spark, sf)}, K).withColumn("threshold", F.lit(ALARM_AT))
    other = A.alarm_stream(second, K, B.STRIDE)
    return P.within_band(
        _alarms(spark, sf).select("rec", "declaration"), other.select("rec", F.col("declaration").alias("d2")), K, "declaration", "d2", B.STRIDE
    )


def _labels_scored(spark, sf):
    d, y = B.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), B.table(spark, sf, "labels")
    return d.join(y, "doc_id").select(
        "lang", F.least(F.lit(1.0), F.floor(F.col("n_chars") / 100) / 50).alias("score"), F.col("quality").alias("label")
    )


def q21_average_precision_auc(spark, sf):
    return Q.score_quality(_labels_scored(spark, sf), ["lang"])


def q22_confusion_metrics(spark, sf):
    return Q.confusion(_labels_scored(spark, sf), ["lang"])


def _selection(spark, sf):
    early = F.when(F.col("score1").isNotNull(), F.least(F.lit(1.0), F.col("score1") * 0.5 + F.coalesce("score2", F.lit(0.0)) * 0.5))
    d = _group(_aligned(spark, sf)).withColumns({"score_early": early, "available": F.col("available1")})
    d = T.around(d, {"barrier": B.uncertain(spark, sf)}, K)
    return S.select_fusion(
        d, stored(_group(B.events(spark, sf)), "events"), stored(_group(_budget(spark, sf)), "budget"), K, ["grp"], B.STRIDE, float(B.STRIDE),
        limit=0.02
    )


def q14_fusion_select_protected(spark, sf):
    """Thresholds and weights of all variants per group, F2 protected against the first modality alone."""
    return _selection(spark, sf)[0]


def q53_fusion_candidates(spark, sf):
    c = _selection(spark, sf)[1]
    return c.select(
        "grp", "alpha", "threshold", "events", "detected", "false_declarations", "evaluable", "sensitivity", "false_per_hour", "delay_median",
        "common_events", "common_delay_delta", "reason", "eligible", "feasible"
    )


def _tables(spark, sf):
    alpha = {"F0": 0.0, "F1": 0.5, "F2": 0.25, "F3": None}
    models = [
        F.struct(score.alias("score"), F.lit(ALARM_AT).alias("threshold"), F.lit(alpha[m]).cast("double").alias("alpha")).alias(m)
        for m, score in U.variant_scores(0.5, F.lit(0.25)).items()
    ]
    q = (F.col("available2") & F.col("score2").isNotNull()).alias("q")
    d = _group(_both(spark, sf)).select("grp", "rec", "t", "duration", F.col("available1").alias("available"), q, *models)
    d = d.join(_labelled(spark, sf).select("rec", "t", F.col("evaluation_label").alias("label")).hint("merge"), ["rec", "t"])
    return N.aligned_tables(d, B.events(spark, sf), B.uncertain(spark, sf), B.SHORT, B.STRIDE)


MEASURES = [
    "events", "detected", "overlap_detected", "false_declarations", "duplicate_declarations", "total_declarations", "active", "longest", "raw",
    "startup", "uncertain", "other_unavailable", "evaluable", "delay_n", "delay_median", "delay_q25", "delay_q75", "delay_min", "delay_max",
    "sensitivity", "overlap_sensitivity", "missed", "false_per_hour", "warning_fraction", "window_n", "window_positive", "average_precision",
    "roc_auc"
]
ROUNDED = ["average_precision", "roc_auc"]


def q54_result_metrics(spark, sf):
    """The tables of measures at the three levels, one below another."""
    t, out = _tables(spark, sf), None
    for level, name in (("parent", "fold_metrics"), ("patient", "patient_metrics"), ("pooled", "pooled_metrics")):
        keys = N.LEVELS[level]
        d = t[name].select(
            F.lit(level).alias("level"), *[F.col(k) if k in keys else F.lit(None).cast("bigint").alias(k) for k in ("grp", "rec")], "model",
            *[F.round(c, 9).alias(c) if c in ROUNDED else c for c in MEASURES]
        )
        out = d if out is None else out.unionByName(d)
    return out


def q55_paired_comparison(spark, sf):
    return _tables(spark, sf)["paired_comparison"]


def q56_event_comparison(spark, sf):
    return _tables(spark, sf)["event_comparison"].select(
        "rec", "event_id", "eeg_detected", "fusion_detected", "eeg_delay", "fusion_delay", "delay_delta", "classification", "changed_delay_only",
        "ecg_available_at_onset", "ecg_ictal_available_fraction", "alpha"
    )


def q57_fate_counts(spark, sf):
    """Fates of false alarms by group, those added among them."""
    t = _tables(spark, sf)
    rows = t["false_alarm_fate"].select("grp", "fate").unionByName(t["added_false_alarms"].select("grp", F.lit("added").alias("fate")))
    return N.fate_counts(rows, ["grp"])


def q58_contribution_patients(spark, sf):
    return _tables(spark, sf)["ecg_contribution_patients"]


def q59_model_means(spark, sf):
    t = _tables(spark, sf)
    out = N.model_means(t["fold_metrics"], ["sensitivity", "false_per_hour", "delay_median"], t["pooled_metrics"])
    return out.select("model", *[F.round(c, 9).alias(c) for c in out.columns if c != "model"])


_J = B.judged_sql("al")
_AL = f"al AS (SELECT * FROM {B.alarms_sql(f'(SELECT *, {ALARM_AT} AS thr FROM dec1)')}), jd AS (SELECT * FROM {_J})"
_EM = "em AS (SELECT r.rec, r.event_id, r.a, r.b, j.decl, j.decl - r.a AS delay, EXISTS (SELECT 1 FROM al x WHERE x.rec = r.rec AND x.decl < r.b AND x.fin > r.a) AS over FROM refs r LEFT JOIN (SELECT * FROM jd WHERE status = 'matched') j ON j.rec = r.rec AND j.event_id = r.event_id)"
_P = B.prelude()
_SWEPT = f"sw AS (SELECT * FROM {B.alarms_sql(f'(SELECT d.*, thr FROM dec1 d, (SELECT unnest({SWEEP}::DOUBLE[]) AS thr))', 'rec, thr')}), sj AS (SELECT *, rec % 5 AS grp FROM {B.judged_sql('sw', 'rec, thr')})"


def _sweep_sql(fold: str) -> str:
    g, on = (f"{fold}, ", f"USING ({fold}, thr)") if fold else ("", "USING (thr)")
    gr = lambda t: f"(SELECT *, rec % 5 AS grp FROM {t})"
    by = f"GROUP BY {fold}" if fold else ""
    join = f"JOIN (SELECT {g}sum(evaluable)::BIGINT AS evaluable FROM {gr('budget')} {by}) {f'USING ({fold})' if fold else 'ON true'}"
    return f"""sweep AS (SELECT {g}thr AS threshold, events, evaluable, coalesce(f, 0) AS false_declarations, coalesce(dt, 0) AS detected, delay_median,
  coalesce(dt, 0)::DOUBLE / events AS sensitivity, coalesce(f, 0)::DOUBLE * {B.HOUR} / evaluable AS false_per_hour
  FROM (SELECT {g}count(*) AS events FROM {gr('refs')} {by}) {join} CROSS JOIN (SELECT unnest({SWEEP}::DOUBLE[]) AS thr)
  LEFT JOIN (SELECT {g}thr, count(*) FILTER (WHERE status <> 'matched') AS f, count(*) FILTER (WHERE status = 'matched') AS dt,
  median(CASE WHEN status = 'matched' THEN decl - onset END) AS delay_median FROM sj GROUP BY {g}thr) {on})"""


_MIX = lambda a: f"CASE WHEN available2 AND score2 IS NOT NULL THEN (1 - {a}) * score1 + {a} * score2 ELSE score1 END"
_FU = f"""fu AS (SELECT d.rec, d.t, d.available AS available1, d.score AS score1, e.available AS available2, e.score AS score2 FROM dec1 d
  JOIN dec2 e USING (rec, t)),
va AS (SELECT rec, t, available1 AS available, 'F0' AS model, score1 AS score FROM fu UNION ALL SELECT rec, t, available1, 'F1', {_MIX(0.5)} FROM fu UNION ALL
  SELECT rec, t, available1, 'F2', {_MIX(0.25)} FROM fu
  UNION ALL SELECT rec, t, available1, 'F3', CASE WHEN score1 IS NOT NULL THEN least(1.0, score1 * 0.5 + coalesce(score2, 0.0) * 0.5) END FROM fu)"""
_VA = f"vm AS (SELECT * FROM {B.alarms_sql(f'''(SELECT *, {ALARM_AT} AS thr FROM va WHERE model IN ('F0', 'F2'))''', 'rec, model')}), vj AS (SELECT *, rec % 5 AS grp FROM {B.judged_sql('vm', 'rec, model')})"
_FATES = f"""{_VA}, w0 AS (SELECT rec, decl, fin FROM vj WHERE model = 'F0' AND status <> 'matched'),
w2 AS (SELECT rec, decl, fin FROM vj WHERE model = 'F2' AND status <> 'matched'),
near AS (SELECT a.rec, a.decl AS a, b.decl AS b, abs(a.decl - b.decl) AS dist, greatest(a.decl, b.decl) < least(a.fin, b.fin) AS meet FROM w0 a JOIN w2 b USING (rec)),
fits AS (SELECT *, 'preserved' AS fate, 1 AS st FROM near WHERE dist = 0 UNION ALL SELECT *, 'shifted', 2 FROM near WHERE dist <= {B.STRIDE}
  UNION ALL SELECT *, 'replaced', 3 FROM near WHERE meet),
lists AS (SELECT rec, list({{'a': a, 'b': b, 'fate': fate}} ORDER BY st, dist, a, b) AS p FROM fits GROUP BY rec),
picked AS (SELECT rec, unnest(list_reduce(list_transform(p, lambda x: [x]),
  lambda got, x: CASE WHEN len(list_filter(got, lambda q: q.a = x[1].a OR q.b = x[1].b)) = 0 THEN list_concat(got, x) ELSE got END)) AS z FROM lists),
fates AS (SELECT rec, z.a AS declaration, z.b AS other, z.fate AS fate FROM picked
  UNION ALL SELECT rec, decl, NULL, 'suppressed' FROM w0 WHERE NOT EXISTS (SELECT 1 FROM picked p WHERE p.rec = w0.rec AND p.z.a = w0.decl)
  UNION ALL SELECT rec, NULL, decl, 'added' FROM w2 WHERE NOT EXISTS (SELECT 1 FROM picked p WHERE p.rec = w2.rec AND p.z.b = w2.decl))"""
_LS = "ls AS (SELECT lang, least(1.0, floor(n_chars / 100) / 50) AS score, quality AS label FROM documents JOIN labels USING (doc_id))"
_PAIR = """count(*) FILTER (WHERE model = 'F0' AND status = 'matched') AS f0_detected, count(*) FILTER (WHERE model = 'F2' AND status = 'matched') AS f2_detected,
  f2_detected - f0_detected AS delta_detected,
  count(*) FILTER (WHERE model = 'F2' AND status <> 'matched') - count(*) FILTER (WHERE model = 'F0' AND status <> 'matched') AS delta_false,
  delta_false::DOUBLE / nullif(count(*) FILTER (WHERE model = 'F0' AND status <> 'matched'), 0) * 100 AS false_change_pct FROM vj"""

_EARLY = "CASE WHEN score1 IS NOT NULL THEN least(1.0, score1 * 0.5 + coalesce(score2, 0.0) * 0.5) END"
_MEASURED = f"coalesce(d, 0) AS detected, coalesce(f, 0) AS false_declarations, dm AS delay_median, coalesce(d, 0)::DOUBLE / events AS sensitivity, coalesce(f, 0)::DOUBLE * {B.HOUR} / evaluable AS false_per_hour"


def _counted(judged: str, by: str) -> str:
    return f"(SELECT {by}, count(*) FILTER (WHERE status = 'matched') AS d, count(*) FILTER (WHERE status <> 'matched') AS f, median(CASE WHEN status = 'matched' THEN decl - onset END) AS dm FROM {judged} GROUP BY {by})"


_SELECT = f"""fam AS (SELECT unnest(['base', 'early']) AS fam), thrs AS (SELECT unnest({S.THRESHOLDS}::DOUBLE[]) AS thr),
  als AS (SELECT unnest({S.ALPHAS[1:]}::DOUBLE[]) AS al),
s1 AS (SELECT rec, t, available1 AS available, fam, thr, CASE fam WHEN 'base' THEN score1 ELSE {_EARLY} END AS score FROM fu, fam, thrs),
x1 AS (SELECT * FROM {B.alarms_sql('s1', 'rec, fam, thr')}), j1 AS (SELECT *, rec % 5 AS grp FROM {B.judged_sql('x1', 'rec, fam, thr')}),
gr AS (SELECT grp, events, evaluable FROM (SELECT rec % 5 AS grp, count(*) AS events FROM refs GROUP BY 1)
  JOIN (SELECT rec % 5 AS grp, sum(evaluable)::BIGINT AS evaluable FROM budget GROUP BY 1) USING (grp)),
m1 AS (SELECT grp, fam, thr, events, evaluable, {_MEASURED} FROM gr CROSS JOIN fam CROSS JOIN thrs LEFT
  JOIN {_counted('j1', 'grp, fam, thr')} USING (grp, fam, thr)),
b1 AS (SELECT * FROM m1 WHERE false_per_hour <= 0.02 QUALIFY row_number() OVER (PARTITION BY grp, fam
  ORDER BY sensitivity DESC, false_per_hour, delay_median NULLS LAST, thr DESC) = 1),
s2 AS (SELECT fu.rec, t, available1 AS available, al, thrs.thr AS at_, {_MIX('al')} AS score,
  CASE WHEN available2 AND score2 IS NOT NULL THEN thrs.thr ELSE b.thr END AS thr FROM fu JOIN b1 b ON b.grp = fu.rec % 5 AND b.fam = 'base', als, thrs),
x2 AS (SELECT * FROM {B.alarms_sql('s2', 'rec, al, at_')}), j2 AS (SELECT *, rec % 5 AS grp FROM {B.judged_sql('x2', 'rec, al, at_')}),
d0 AS (SELECT j.grp, j.rec, j.event_id, decl - onset AS delay0 FROM j1 j JOIN b1 b ON b.grp = j.grp AND b.fam = j.fam AND b.thr = j.thr
  WHERE j.fam = 'base' AND status = 'matched'),
pd AS (SELECT j.grp, al, at_, count(*) AS common_events, median(decl - onset - delay0) AS common_delay_delta FROM j2 j JOIN d0 USING (grp, rec, event_id)
  WHERE status = 'matched' GROUP BY ALL),
m2 AS (SELECT grp, al, at_, events, evaluable, {_MEASURED} FROM gr JOIN (SELECT grp FROM b1 WHERE fam = 'base') USING (grp) CROSS JOIN als CROSS
  JOIN (SELECT thr AS at_ FROM thrs) LEFT JOIN {_counted('j2', 'grp, al, at_')} USING (grp, al, at_)),
c0 AS (SELECT m2.*, coalesce(common_events, 0) AS common_events, common_delay_delta, concat_ws(';',
  CASE WHEN m2.detected < b.detected THEN 'sensitivity_loss' END, CASE WHEN m2.false_per_hour > b.false_per_hour THEN 'FAR_increase' END,
  CASE WHEN m2.detected <= b.detected AND m2.false_per_hour >= b.false_per_hour THEN 'no_strict_improvement' END,
  CASE WHEN common_delay_delta > {B.STRIDE} THEN 'common_event_delay_penalty' END, CASE WHEN m2.evaluable <> b.evaluable THEN 'coverage_loss' END) AS against
  FROM m2 JOIN (SELECT * FROM b1 WHERE fam = 'base') b USING (grp) LEFT JOIN pd USING (grp, al, at_)),
cd AS (SELECT * EXCLUDE (against), CASE WHEN against = '' THEN 'protected_improvement' ELSE against END AS reason, against = '' AS eligible,
  false_per_hour <= 0.02 AS feasible FROM c0),
f2 AS (SELECT * FROM cd WHERE eligible AND feasible QUALIFY row_number() OVER (PARTITION BY grp
  ORDER BY sensitivity DESC, false_per_hour, delay_median NULLS LAST, al, at_ DESC) = 1),
f1 AS (SELECT * FROM cd WHERE al = 0.5 AND feasible QUALIFY row_number() OVER (PARTITION BY grp
  ORDER BY sensitivity DESC, false_per_hour, delay_median NULLS LAST, at_ DESC) = 1)"""

_ALL = f"""vm4 AS (SELECT * FROM {B.alarms_sql(f'(SELECT *, {ALARM_AT} AS thr FROM va)', 'rec, model')}), vj4 AS (SELECT *, rec % 5 AS grp
  FROM {B.judged_sql('vm4', 'rec, model')}),
ev4 AS (SELECT r.rec, r.rec % 5 AS grp, model, r.event_id, j.decl - r.a AS delay, EXISTS (SELECT 1 FROM vm4 x
  WHERE x.rec = r.rec AND x.model = m.model AND x.decl < r.b AND x.fin > r.a) AS over FROM refs r CROSS JOIN (SELECT DISTINCT model FROM va) m LEFT
  JOIN (SELECT * FROM vj4 WHERE status = 'matched') j USING (rec, model, event_id)),
lab AS (SELECT g.rec, g.t, EXISTS (SELECT 1 FROM unc u WHERE u.rec = g.rec AND u.a <= g.t AND g.t < u.b) AS un, EXISTS (SELECT 1 FROM refs r
  WHERE r.rec = g.rec AND r.a <= g.t AND g.t < r.b) AS hit FROM grid g),
sc4 AS (SELECT va.rec, va.rec % 5 AS grp, model, score, hit::INT AS label FROM va JOIN lab USING (rec, t) WHERE available AND score IS NOT NULL AND NOT un),
bu4 AS (SELECT budget.*, rec % 5 AS grp, model FROM budget, (SELECT DISTINCT model FROM va))"""


def _level_sql(name: str, level: str) -> str:
    g = f"{level}, " if level else ""
    on = f"USING ({g}model)"
    keys = ", ".join(f"CAST({k} AS BIGINT) AS {k}" if k in level.split(", ") else f"CAST(NULL AS BIGINT) AS {k}" for k in ("grp", "rec"))
    return f"""SELECT '{name}' AS level, {keys}, model, events, detected, overlap_detected, coalesce(false_declarations, 0) AS false_declarations,
  coalesce(duplicate_declarations, 0) AS duplicate_declarations, coalesce(total_declarations, 0) AS total_declarations, coalesce(active, 0) AS active,
  coalesce(longest, 0) AS longest,
  raw, startup, uncertain, other_unavailable, evaluable, delay_n, delay_median, delay_q25, delay_q75, delay_min, delay_max, detected::DOUBLE / nullif(events,
  0) AS sensitivity, overlap_detected::DOUBLE / nullif(events, 0) AS overlap_sensitivity, events - detected AS missed,
  coalesce(false_declarations, 0)::DOUBLE * {B.HOUR} / nullif(evaluable, 0) AS false_per_hour, coalesce(active, 0)::DOUBLE / nullif(evaluable,
  0) AS warning_fraction, coalesce(window_n, 0) AS window_n, coalesce(window_positive, 0) AS window_positive, round(average_precision, 9) AS average_precision,
  round(roc_auc, 9) AS roc_auc
FROM (SELECT {g}model, {', '.join(f'sum({c})::BIGINT AS {c}' for c in Q.TIMES)} FROM bu4 GROUP BY {g}model)
LEFT JOIN (SELECT {g}model, count(*) AS events, count(delay) AS detected, count(delay) AS delay_n, count(*) FILTER (WHERE over) AS overlap_detected,
  median(delay) AS delay_median, quantile_cont(delay, 0.25) AS delay_q25, quantile_cont(delay, 0.75) AS delay_q75, min(delay) AS delay_min,
  max(delay) AS delay_max FROM ev4 GROUP BY {g}model) {on}
LEFT JOIN (SELECT {g}model, count(*) FILTER (WHERE status <> 'matched') AS false_declarations,
  count(*) FILTER (WHERE status = 'duplicate') AS duplicate_declarations, count(*) AS total_declarations, sum(fin - decl)::BIGINT AS active,
  max(fin - decl) AS longest FROM vj4 GROUP BY {g}model) {on}
LEFT JOIN (SELECT {g}model, sum(n)::BIGINT AS window_n, sum(p)::BIGINT AS window_positive,
  CASE WHEN sum(p) > 0 AND sum(n) > sum(p) THEN sum(p * tp / seen::DOUBLE) / sum(p) END AS average_precision,
  CASE WHEN sum(p) > 0 AND sum(n) > sum(p) THEN (sum(p * (below + (n + 1) / 2.0)) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * (sum(n) - sum(p))) END::DOUBLE AS roc_auc
  FROM (SELECT *, sum(p) OVER (PARTITION BY {g}model ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY {g}model
  ORDER BY score DESC) AS seen, sum(n) OVER (PARTITION BY {g}model ORDER BY score) - n AS below
  FROM (SELECT {g}model, score, sum(label)::BIGINT AS p, count(*) AS n FROM sc4 GROUP BY {g}model, score)) GROUP BY {g}model) {on}"""


_LEVELS = " UNION ALL BY NAME ".join(f"({_level_sql(n, ', '.join(k))})" for n, k in N.LEVELS.items())

ORACLE = {
    "q14_fusion_select_protected": f"""{_P}, {_FU}, {_SELECT}
SELECT b.grp, b.thr AS eeg_threshold, coalesce(f2.al, 0.0)::DOUBLE AS alpha, coalesce(f2.at_, b.thr) AS threshold, f1.at_ AS f1_threshold,
  e.thr AS f3_threshold, CASE WHEN f2.grp IS NULL THEN 'no_eligible_nonzero_candidate' ELSE 'protected_improvement' END AS reason,
  b.detected AS inner_eeg_detected, b.events AS inner_eeg_events, b.false_per_hour AS inner_eeg_far, b.delay_median AS inner_eeg_delay, coalesce(f2.detected,
  b.detected) AS inner_fusion_detected, coalesce(f2.false_per_hour, b.false_per_hour) AS inner_fusion_far,
  CASE WHEN f2.grp IS NULL THEN b.delay_median ELSE f2.delay_median END AS inner_fusion_delay,
  CASE WHEN f2.grp IS NULL THEN b.detected ELSE f2.common_events END AS common_events,
  CASE WHEN f2.grp IS NULL THEN CASE WHEN b.detected > 0 THEN 0.0 END ELSE f2.common_delay_delta END::DOUBLE AS common_delay_delta
FROM b1 b LEFT JOIN b1 e ON e.grp = b.grp AND e.fam = 'early' LEFT JOIN f2 ON f2.grp = b.grp LEFT JOIN f1 ON f1.grp = b.grp WHERE b.fam = 'base'""",
    "q53_fusion_candidates": f"{_P}, {_FU}, {_SELECT} SELECT grp, al AS alpha, at_ AS threshold, events, detected, false_declarations, evaluable, sensitivity, false_per_hour, delay_median, common_events, common_delay_delta, reason, eligible, feasible FROM cd",
    "q54_result_metrics": f"{_P}, {_FU}, {_ALL} {_LEVELS}",
    "q55_paired_comparison": f"""{_P}, {_FU}, {_ALL}, lv AS ({_LEVELS})
SELECT a.level, a.grp, a.rec, {', '.join(f'a.{c} AS eeg_{c}, b.{c} AS fusion_{c}, b.{c} - a.{c} AS delta_{c}' for c in N.PAIRED)},
  CASE WHEN a.false_per_hour > 0 THEN (b.false_per_hour / a.false_per_hour - 1) * 100 END AS far_change_pct,
  (b.evaluable - a.evaluable) / a.raw::DOUBLE * 100 AS coverage_delta_pct
FROM lv a JOIN lv b ON a.level = b.level AND a.grp IS NOT DISTINCT FROM b.grp AND a.rec IS NOT DISTINCT FROM b.rec WHERE a.model = 'F0' AND b.model = 'F2'""",
    "q56_event_comparison": f"""{_P}, {_FU}, {_ALL}, w AS (SELECT r.rec, r.event_id, r.a, r.b, x.delay AS d0, y.delay AS d2,
  coalesce((SELECT bool_or(d.available AND d.score IS NOT NULL) FROM dec2 d WHERE d.rec = r.rec AND d.t <= r.a AND r.a < d.t + {B.STRIDE}), false) AS on_,
  coalesce((SELECT sum(greatest(0, least(r.b, d.t + {B.STRIDE}, {B.DURATION}) - greatest(r.a, d.t))) FROM dec2 d
  WHERE d.rec = r.rec AND d.available AND d.score IS NOT NULL), 0) AS covered FROM refs r
  JOIN ev4 x ON x.rec = r.rec AND x.event_id = r.event_id AND x.model = 'F0' JOIN ev4 y ON y.rec = r.rec AND y.event_id = r.event_id AND y.model = 'F2')
SELECT rec, event_id, d0 IS NOT NULL AS eeg_detected, d2 IS NOT NULL AS fusion_detected, d0 AS eeg_delay, d2 AS fusion_delay, d2 - d0 AS delay_delta,
  CASE WHEN d0 IS NOT NULL AND d2 IS NOT NULL THEN 'preserved' WHEN d2 IS NOT NULL THEN 'rescued' WHEN d0 IS NOT NULL THEN 'lost' ELSE 'still_missed' END AS classification,
  coalesce(d0 <> d2, false) AS changed_delay_only, on_ AS ecg_available_at_onset, covered::DOUBLE / (b - a) AS ecg_ictal_available_fraction,
  0.25::DOUBLE AS alpha FROM w""",
    "q58_contribution_patients": f"""{_P}, c2 AS (SELECT rec, t AS a, least(t + {B.STRIDE}, {B.DURATION}) AS b FROM dec2
  WHERE available AND score IS NOT NULL), q AS (SELECT rec, sum(b - a)::BIGINT AS q1 FROM {B.sweep_sql('expo', B.union_sql('c2'), B.BOTH)} GROUP BY rec)
SELECT rec % 5 AS grp, sum(evaluable)::BIGINT AS evaluable, sum(coalesce(q1, 0))::BIGINT AS q1, sum(evaluable - coalesce(q1, 0))::BIGINT AS q0, sum(coalesce(q1,
  0))::BIGINT AS active, sum(coalesce(q1, 0))::BIGINT::DOUBLE / sum(evaluable)::BIGINT AS q1_fraction FROM budget LEFT JOIN q USING (rec) WHERE evaluable > 0
  GROUP BY 1""",
    "q59_model_means": f"""{_P}, {_FU}, {_ALL}, lv AS ({_LEVELS})
SELECT f.model, {', '.join(f'round(avg(f.{c}), 9) AS fold_mean_{c}, round(any_value(p.{c}), 9) AS pooled_{c}' for c in ('sensitivity', 'false_per_hour', 'delay_median'))} FROM lv f JOIN lv p ON p.model = f.model AND p.level = 'pooled' WHERE f.level = 'parent' GROUP BY f.model""",
    "q01_alarm_eval": f"""{_P}, {_AL}, {_EM},
ja AS (SELECT rec, count(*) FILTER (WHERE status <> 'matched') AS f, count(*) FILTER (WHERE status = 'duplicate') AS dup, count(*) AS n,
  sum(fin - decl)::BIGINT AS act, max(fin - decl) AS longest FROM jd GROUP BY rec),
me AS (SELECT rec, count(*) AS events, count(decl) AS detected, count(*) FILTER (WHERE over) AS overd, median(delay) AS dm, quantile_cont(delay, 0.25) AS dq
  FROM em GROUP BY rec)
SELECT rec, coalesce(events, 0) AS events, coalesce(detected, 0) AS detected, coalesce(overd, 0) AS overlap_detected, coalesce(f, 0) AS false_declarations,
  coalesce(dup, 0) AS duplicate_declarations, coalesce(n, 0) AS total_declarations,
  evaluable, coalesce(detected, 0) AS delay_n, dm AS delay_median, dq AS delay_q25, detected::DOUBLE / events AS sensitivity, coalesce(f,
  0)::DOUBLE * {B.HOUR} / nullif(evaluable, 0) AS false_per_hour, coalesce(act, 0)::DOUBLE / nullif(evaluable, 0) AS warning_fraction, coalesce(longest,
  0) AS longest
FROM budget LEFT JOIN ja USING (rec) LEFT JOIN me USING (rec)""",
    "q02_alarm_intervals": f'{_P}, {_AL} SELECT rec, decl AS declaration, fin AS "end", reason FROM al',
    "q03_event_matches": f'{_P}, {_AL}, {_EM} SELECT rec, event_id, a AS onset, b AS "offset", decl IS NOT NULL AS detected, decl AS declaration, delay, over AS overlap_detected FROM em',
    "q04_exposure_intervals": f'{_P} SELECT rec, a AS start, b AS "end" FROM expo',
    "q05_interval_union": f'{_P} SELECT rec, a AS start, b AS "end" FROM refs',
    "q06_interval_difference_seconds": f"{_P} SELECT rec, sum(b - a)::BIGINT AS micros FROM {B.sweep_sql('refs0', 'unc', B.MINUS)} GROUP BY rec",
    "q07_interval_intersection": f"""{_P} SELECT rec, a AS start, b AS "end" FROM {B.sweep_sql('refs0', 'unc', B.BOTH)}""",
    "q08_time_budget": f"{_P} SELECT rec, raw, uncertain, startup, evaluable, other_unavailable::BIGINT AS other_unavailable FROM budget",
    "q09_timeline_labels": f"""{_P}, lb AS (SELECT g.rec, g.t, EXISTS (SELECT 1 FROM unc u
  WHERE u.rec = g.rec AND u.a <= g.t AND g.t < u.b) AS un, (SELECT string_agg(CAST(a // {B.HOUR} AS VARCHAR), '|' ORDER BY a) FROM refs r
  WHERE r.rec = g.rec AND r.a <= g.t AND g.t < r.b) AS nums,
  EXISTS (SELECT 1 FROM refs r WHERE r.rec = g.rec AND r.a - {6 * B.HOUR} <= g.t AND g.t < r.b + {6 * B.HOUR}) AS near FROM grid g),
ls AS (SELECT *, CASE WHEN un THEN 'annotation_uncertain' WHEN nums IS NOT NULL THEN 'positive' WHEN near THEN 'ignore' ELSE 'negative' END AS status FROM lb)
SELECT rec, t, CASE status WHEN 'positive' THEN 1 WHEN 'negative' THEN 0 ELSE -1 END AS label, status,
  CASE WHEN un THEN -1 WHEN nums IS NOT NULL THEN 1 ELSE 0 END AS evaluation_label, status IN ('positive', 'negative') AS training_eligible,
  CASE WHEN status = 'positive' THEN nums ELSE '' END AS event_numbers FROM ls""",
    "q11_threshold_sweep": f"{_P}, {_SWEPT}, {_sweep_sql('')} SELECT * FROM sweep",
    "q12_threshold_choice": f"{_P}, {_SWEPT}, {_sweep_sql('grp')} SELECT * FROM sweep WHERE false_per_hour <= 0.02 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY sensitivity DESC, false_per_hour, delay_median NULLS LAST, threshold DESC) = 1",
    "q13_fusion_scores": f"{_P}, {_FU} SELECT rec, t, available2 AND score2 IS NOT NULL AS q, {_MIX(0.25)} AS score, CASE WHEN available2 AND score2 IS NOT NULL THEN 0.45 ELSE 0.5 END::DOUBLE AS threshold FROM fu",
    "q15_model_variants": f"{_P}, {_FU} SELECT rec, model, count(*) AS n, count(score) AS n_scored, sum(CASE WHEN score >= {ALARM_AT} THEN 1 WHEN score IS NOT NULL THEN 0 END)::BIGINT AS n_high FROM va GROUP BY rec, model",
    "q16_paired_levels": f"{_P}, {_FU}, {_VA} SELECT 'parent' AS level, grp, rec, {_PAIR} GROUP BY grp, rec UNION ALL SELECT 'patient', grp, NULL, {_PAIR} GROUP BY grp UNION ALL SELECT 'pooled', NULL, NULL, {_PAIR}",
    "q67_replay": f"""{_P}, {_AL}, m AS (SELECT r.rec, r.event_id, x.decl - r.a AS delay FROM refs r
  LEFT JOIN (SELECT * FROM {_J} WHERE status = 'matched') x ON x.rec = r.rec AND x.event_id = r.event_id)
SELECT rec, event_id, 'delay' AS cell, delay::VARCHAR AS made, (delay + 1)::VARCHAR AS kept FROM m WHERE delay IS NOT NULL AND rec % 7 = 2 AND rec % 11 <> 3
UNION ALL SELECT rec, event_id, '(row)', NULL, NULL FROM m WHERE rec % 11 = 3""",
    "q18_false_alarm_fate": f"{_P}, {_FU}, {_FATES} SELECT rec, declaration, other, fate FROM fates",
    "q57_fate_counts": f"{_P}, {_FU}, {_FATES} SELECT rec % 5 AS grp, fate, count(*) AS n FROM fates GROUP BY ALL",
    "q17_event_fates": f"""{_P}, {_FU}, {_VA}, f AS (SELECT rec, event_id, model, decl - onset AS delay FROM vj WHERE status = 'matched')
SELECT r.rec, r.event_id, x.delay AS delay0, y.delay AS delay2,
  CASE WHEN x.delay IS NOT NULL AND y.delay IS NOT NULL THEN 'preserved' WHEN y.delay IS NOT NULL THEN 'rescued' WHEN x.delay IS NOT NULL THEN 'lost' ELSE 'still_missed' END AS classification, coalesce(x.delay <> y.delay, false) AS changed_delay_only
FROM refs r LEFT JOIN f x ON x.rec = r.rec AND x.event_id = r.event_id AND x.model = 'F0' LEFT
  JOIN f y ON y.rec = r.rec AND y.event_id = r.event_id AND y.model = 'F2'""",
    "q19_asof_state": f"""{_P}, {_AL}, s AS (SELECT al.rec, decl, max(d.t) AS seen FROM al LEFT
  JOIN dec2 d ON d.rec = al.rec AND d.available AND d.t <= decl AND d.t >= decl - {8 * B.HOUR} GROUP BY al.rec, decl)
SELECT s.rec, decl AS declaration, seen AS asof_t, d.score AS state,
  CASE WHEN d.score IS NULL THEN 'unavailable' WHEN d.score < 0.25 THEN 'low' ELSE 'larger' END AS kind FROM s LEFT
  JOIN dec2 d ON d.rec = s.rec AND d.t = s.seen""",
    "q20_band_coincidence": f"""{_P}, {_AL}, a2 AS (SELECT * FROM {B.alarms_sql(f'(SELECT *, {ALARM_AT} AS thr FROM dec2)')}) SELECT rec, decl AS declaration, EXISTS (SELECT 1 FROM a2 WHERE a2.rec = al.rec AND abs(a2.decl - al.decl) <= {B.STRIDE}) AS coincident FROM al""",
    "q21_average_precision_auc": f"""WITH {_LS}, g AS (SELECT lang, score, sum(label)::BIGINT AS p, count(*) AS n FROM ls GROUP BY ALL),
c AS (SELECT *, sum(p) OVER (PARTITION BY lang ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY lang
  ORDER BY score DESC) AS seen, sum(n) OVER (PARTITION BY lang ORDER BY score) - n AS below FROM g),
t AS (SELECT lang, sum(n)::BIGINT AS window_n, sum(p)::BIGINT AS window_positive, sum(p * tp / seen::DOUBLE) AS ap, sum(p * (below + (n + 1) / 2.0)) AS rk
  FROM c GROUP BY lang)
SELECT lang, window_n, window_positive, CASE WHEN window_positive > 0 AND window_n > window_positive THEN ap / window_positive END AS average_precision,
  CASE WHEN window_positive > 0 AND window_n > window_positive THEN (rk - window_positive * (window_positive + 1) / 2.0) / (window_positive * (window_n - window_positive)) END::DOUBLE AS roc_auc FROM t""",
    "q22_confusion_metrics": f"""WITH {_LS}, c AS (SELECT lang, count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp,
  count(*) FILTER (WHERE score >= 0.5 AND label <> 1) AS fp, count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn,
  count(*) FILTER (WHERE score < 0.5 AND label <> 1) AS tn FROM ls GROUP BY lang)
SELECT *, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision,
  coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1, (coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) + coalesce(tn::DOUBLE / nullif(tn + fp, 0),
  0)) / 2 AS balanced_accuracy FROM c""",
}
ORACLE["q10_label_contingency"] = ORACLE["q09_timeline_labels"].replace(
    "SELECT rec, t, CASE status",
    "SELECT rec, count(*) FILTER (WHERE status = 'annotation_uncertain') AS annotation_uncertain, count(*) FILTER (WHERE status = 'positive') AS positive, count(*) FILTER (WHERE status = 'ignore') AS ignore, count(*) FILTER (WHERE status = 'negative') AS negative, count(*) FILTER (WHERE status IN ('positive', 'negative')) AS usable FROM ls GROUP BY rec --"
).split("--")[0]
QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "q" and k[1:3].isdigit()}

"""How the test tables stand in for recordings: a user's events are a recording of 30 days.

Scores are trailing sums of values, available when the context holds an event; ``error``
starts a reference event of six hours, ``signup`` an uncertain hour. Decisions fall every
four hours; contexts are one day and, for the second modality, three.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import timeline as T

HOUR = 3_600_000_000
DURATION, STRIDE, SHORT, LONG = 720 * HOUR, 4 * HOUR, 24 * HOUR, 72 * HOUR
KEY = ["rec"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    x = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return e.select(
        F.col("user_id").alias("rec"), x.alias("x"), F.col("event_type").alias("kind"), F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        "event_id"
    )


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    return samples(spark, sf).select("rec").distinct().withColumn("duration", F.lit(DURATION))


def _scored(spark: SparkSession, sf: str, rows: DataFrame, context: int, full: int) -> DataFrame:
    out = T.trailing_sums(recordings(spark, sf), rows.select("rec", "x", "cents"), KEY, context, SHORT, STRIDE, "cents")
    return out.select(
        "rec", "t", "duration", F.col("cents").isNotNull().alias("available"),
        F.when(F.col("cents").isNotNull(), F.least(F.lit(1.0), F.col("cents") / full)).alias("score")
    )


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf, samples(spark, sf), SHORT, 20_000)


def decisions2(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf, samples(spark, sf).where("kind IN ('purchase', 'click')"), LONG, 40_000)


def _spans(spark: SparkSession, sf: str, kind: str, length: int) -> DataFrame:
    s = samples(spark, sf).where(F.col("kind") == kind)
    return s.select("rec", F.col("x").alias("start"), F.least(F.col("x") + length, F.lit(DURATION)).alias("end"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    merged = I.union_intervals(_spans(spark, sf, "error", 6 * HOUR), KEY)
    return merged.withColumn("event_id", F.concat_ws("-", F.col("rec").cast("string"), F.col("start").cast("string")))


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    return _spans(spark, sf, "error", 6 * HOUR)


def uncertain(spark: SparkSession, sf: str) -> DataFrame:
    return I.union_intervals(_spans(spark, sf, "signup", HOUR), KEY)


def ready(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions with the barriers around them, without a threshold."""
    return T.around(decisions(spark, sf), {"barrier": uncertain(spark, sf)}, KEY)


def union_sql(src: str, keys: str = "rec") -> str:
    return f"""(SELECT {keys}, min(a) AS a, max(b) AS b FROM (SELECT *, sum(nw) OVER (PARTITION BY {keys} ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isl FROM (
  SELECT *, CASE WHEN a > coalesce(max(b) OVER (PARTITION BY {keys} ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS nw
  FROM {src} WHERE b > a)) GROUP BY {keys}, isl)"""


def sweep_sql(a: str, b: str, keep: str, keys: str = "rec") -> str:
    steps = f"SELECT {keys}, a AS x, 1 AS da, 0 AS db FROM {a} UNION ALL SELECT {keys}, b, -1, 0 FROM {a} UNION ALL SELECT {keys}, a, 0, 1 FROM {b} UNION ALL SELECT {keys}, b, 0, -1 FROM {b}"
    pieces = f"(SELECT {keys}, x AS a, lead(x) OVER w AS b, sum(da) OVER w AS in_a, sum(db) OVER w AS in_b FROM (SELECT {keys}, x, sum(da) AS da, sum(db) AS db FROM ({steps}) GROUP BY {keys}, x) WINDOW w AS (PARTITION BY {keys} ORDER BY x))"
    return union_sql(f"(SELECT {keys}, a, b FROM {pieces} WHERE b IS NOT NULL AND {keep})", keys)


MINUS, BOTH = "in_a > 0 AND in_b = 0", "in_a > 0 AND in_b > 0"


def alarms_sql(src: str, keys: str = "rec") -> str:
    """``src``: keys, t, available, score, thr; barriers are those of unc."""
    w = f"(PARTITION BY {keys} ORDER BY t)"
    s = f"(PARTITION BY {keys}, seg ORDER BY t)"
    stop = f"least(t + {STRIDE}, {DURATION})"
    return f"""(WITH a0 AS (SELECT s.*, coalesce(bars, []) AS bars, available AND score IS NOT NULL AS ok FROM {src} s LEFT
  JOIN (SELECT rec, list({{'a': a, 'b': b}}) AS bars FROM unc GROUP BY rec) USING (rec)),
a1 AS (SELECT *, lead(t) OVER {w} AS nt, lead(ok) OVER {w} AS nok, ok AND len(list_filter(bars, lambda z: z.a <= t AND t < z.b)) = 0 AS live FROM a0),
a2 AS (SELECT *, list_min(list_transform(list_filter(bars, lambda z: z.a > t AND z.a < {stop}), lambda z: z.a)) AS ins,
  list_min(list_transform(list_filter(bars, lambda z: z.a <= nt AND z.b > t), lambda z: z.a)) AS met, CASE WHEN nt > t + {STRIDE} THEN t + {STRIDE} END AS mis
  FROM a1),
a3 AS (SELECT *, CASE WHEN nt IS NULL THEN coalesce(ins, {stop}) WHEN met IS NOT NULL OR mis IS NOT NULL THEN greatest(t, least(coalesce(met, mis),
  coalesce(mis, met))) WHEN NOT nok THEN nt END AS cut_at,
  CASE WHEN nt IS NULL THEN CASE WHEN ins IS NOT NULL THEN 'annotation_or_acquisition_gap' WHEN {stop} = {DURATION} THEN 'recording_end' ELSE 'missing_decision' END
    WHEN met IS NOT NULL AND met <= coalesce(mis,
  met) THEN 'annotation_or_acquisition_gap' WHEN mis IS NOT NULL THEN 'missing_decision' WHEN NOT nok THEN 'unavailable' END AS cut_why FROM a2),
a4 AS (SELECT *, coalesce(sum(CASE WHEN cut_at IS NOT NULL OR NOT live THEN 1 ELSE 0 END) OVER (PARTITION BY {keys}
  ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM a3),
a5 AS (SELECT *, row_number() OVER {s} AS k, lead(t, 2) OVER {s} AS low2, last_value(cut_at) OVER (PARTITION BY {keys}, seg
  ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l_at, last_value(cut_why) OVER (PARTITION BY {keys}, seg
  ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l_why FROM a4 WHERE live),
a6 AS (SELECT *, CASE WHEN k - lag(k) OVER {s} <= 2 THEN 0 ELSE 1 END AS nw FROM a5 WHERE score >= thr),
a7 AS (SELECT *, sum(nw) OVER (PARTITION BY {keys}, seg ORDER BY t ROWS UNBOUNDED PRECEDING) AS isl FROM a6),
a8 AS (SELECT {keys}, min(t) AS decl, arg_max({{'low2': low2, 'at': l_at, 'why': l_why}}, t) AS z FROM a7 GROUP BY {keys}, seg, isl)
SELECT {keys}, decl, coalesce(z.low2, z.at) AS fin, CASE WHEN z.low2 IS NOT NULL THEN 'two_below' ELSE z.why END AS reason FROM a8)"""


def judged_sql(alarms: str, keys: str = "rec") -> str:
    return f"""(SELECT *, CASE WHEN event_id = '' THEN 'false' WHEN row_number() OVER (PARTITION BY {keys}, event_id
  ORDER BY decl) = 1 THEN 'matched' ELSE 'duplicate' END AS status FROM (
  SELECT m.*, coalesce(r.event_id, '') AS event_id, r.a AS onset FROM {alarms} m LEFT JOIN refs r ON r.rec = m.rec AND r.a <= decl AND decl < r.b))"""


def prelude() -> str:
    def score(name, where, context, full):
        return f"{name} AS (SELECT g.rec, g.t, count(e.x) > 0 AS available, CASE WHEN count(e.x) > 0 THEN least(1.0, CAST(sum(cents) AS DOUBLE) / {full}) END AS score FROM grid g LEFT JOIN ev e ON e.rec = g.rec AND e.x >= g.t - {context} AND e.x < g.t {where} GROUP BY g.rec, g.t)"

    return f"""WITH ev AS (SELECT user_id AS rec, epoch_us(ts) - 1704067200000000 AS x, event_type AS kind, CAST(round(value * 100) AS BIGINT) AS cents,
  event_id FROM events),
recs AS (SELECT DISTINCT rec FROM ev),
grid AS (SELECT rec, unnest(range({SHORT}, {DURATION}, {STRIDE})) AS t FROM recs),
{score('dec1', '', SHORT, 20000)},
{score('dec2', "AND kind IN ('purchase', 'click')", LONG, 40000)},
refs0 AS (SELECT rec, x AS a, least(x + {6 * HOUR}, {DURATION}) AS b FROM ev WHERE kind = 'error'),
unc0 AS (SELECT rec, x AS a, least(x + {HOUR}, {DURATION}) AS b FROM ev WHERE kind = 'signup'),
refs AS (SELECT *, rec || '-' || a AS event_id FROM {union_sql('refs0')}),
unc AS (SELECT * FROM {union_sql('unc0')}),
cells AS (SELECT rec, t AS a, least(t + {STRIDE}, {DURATION}) AS b FROM dec1 WHERE available),
expo AS (SELECT * FROM {sweep_sql(union_sql('cells'), 'unc', MINUS)}),
whole AS (SELECT rec, 0 AS a, {DURATION} AS b FROM recs),
begin_ AS (SELECT rec, 0 AS a, {SHORT} AS b FROM recs),
budget AS (SELECT rec, CAST({DURATION} AS BIGINT) AS raw, coalesce(u, 0) AS uncertain, coalesce(s, 0) AS startup, coalesce(e, 0) AS evaluable,
  {DURATION} - coalesce(u, 0) - coalesce(s, 0) - coalesce(e, 0) AS other_unavailable
  FROM recs LEFT JOIN (SELECT rec, CAST(sum(b - a) AS BIGINT) AS u FROM {sweep_sql('whole', 'unc', BOTH)} GROUP BY rec) USING (rec)
  LEFT JOIN (SELECT rec, CAST(sum(b - a) AS BIGINT) AS s FROM {sweep_sql('begin_', 'unc', MINUS)} GROUP BY rec) USING (rec)
  LEFT JOIN (SELECT rec, CAST(sum(b - a) AS BIGINT) AS e FROM expo GROUP BY rec) USING (rec))"""

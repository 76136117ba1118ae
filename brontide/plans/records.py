"""Queries on what surrounds the signals: annotation texts, event tables, channel declarations, checksum lists, tables with
manifests, chunks with a halo, scalers.

Texts and files are made from the tables by Spark, row by row, and read back through the package's own readers; the SQL
twins start from the tables and know nothing of the texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import checks as V
from ..operators import intervals as I
from ..operators import rhythm as Y
from ..operators import timeline as T
from ..operators.folds import FoldedLogistic
from ..operators.staging import shared_dir, stored
from ..sources import annotations as S
from ..sources import sinks as K
from . import binding as B
from . import features as X

KEY = B.KEY
SECOND = 1_000_000


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _clock(seconds: Column, shape: str = "%02d.%02d.%02d") -> Column:
    s = F.pmod(seconds, F.lit(86_400))
    return F.format_string(shape, F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def _listed(spark, sf) -> DataFrame:
    """Errors as listed events: rec, event_id, number, start_s (of the recording), onset and offset (seconds from there)."""
    e = B.samples(spark, sf).where("kind = 'error'")
    e = e.withColumns({"start_s": (F.col("rec") * 7919 % 86_400).cast("int"), "onset": 100 + F.floor(F.col("x") / SECOND) % 50_000})
    number = F.row_number().over(W.partitionBy("rec").orderBy("x", "event_id"))
    return e.withColumns({"number": number, "offset": F.col("onset") + 60 + F.abs("cents") % 600})


def _texts(listed: DataFrame, name: Column, registration: Column, onset: Column, offset: Column) -> DataFrame:
    """One text a recording, with a block an event; ``registration``: its lines or null."""
    lines = F.concat_ws(
        "\n", F.concat(F.lit("Seizure n "), F.col("number").cast("string")), F.concat(F.lit("File name: "), name), registration,
        F.concat(F.lit("Seizure start time: "), onset), F.concat(F.lit("Seizure end time: "), offset), F.lit("")
    )
    blocks = F.sort_array(F.collect_list(F.struct("number", lines.alias("block"))))
    return listed.groupBy(F.col("rec").cast("string").alias("source")).agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n").alias("value"))


def q68_annotation_blocks(spark, sf):
    """Listed events through their texts: clocks of two spellings, several candidates, registrations to inherit."""
    d = _listed(spark, sf)
    at = lambda c: F.when(F.col("event_id") % 2 == 0, _clock(F.col("start_s") + c)).otherwise(_clock(F.col("start_s") + c, "%d:%02d:%d"))
    onset, offset = F.col("onset"), F.col("offset")
    two = F.concat(at(onset - 5), F.lit(" (Electric onset) ; "), at(onset), F.lit(" (clinical onset)"))
    ends = F.concat(at(offset), F.lit(" opure "), at(offset + 20))
    began = F.col("start_s") + F.col("rec") % 7 - 3
    given = F.concat(F.lit("Registration start time: "), _clock(began), F.lit("\nRegistration end time: "), _clock(began + 40_000))
    name = lambda typed: F.concat(F.when(F.col("rec") % 4 == 0, typed).otherwise("R"), F.lit("-"), F.col("rec").cast("string"), F.lit(".edf"))
    texts = _texts(
        d, name("PNO6"), F.when((F.col("number") == 1) | (F.col("event_id") % 3 == 0), given),
        F.when(F.col("event_id") % 4 == 0, two).otherwise(at(onset)), F.when(F.col("event_id") % 5 == 0, ends).otherwise(at(offset))
    )
    headers = d.select(
        F.col("rec").cast("string").alias("source"), name("PN06").alias("file_name"), "start_s", F.lit(86_400).alias("duration_s")
    ).distinct()
    out = S.parse_events(S.event_blocks(texts), headers)
    spans = F.array_join(F.transform("uncertain", lambda u: F.concat_ws("-", u[0].cast("string"), u[1].cast("string"))), ";")
    return out.select(
        F.col("source").cast("bigint").alias("rec"), "number", "file_name", "onset_s", "offset_s", "registration_inherited", "discrepancy_s",
        spans.alias("uncertain")
    )


def q69_lenient_blocks(spark, sf):
    """The forgiving reading: clocks inside other words, with blanks, missing or impossible."""
    d = _listed(spark, sf)
    clock = F.col("start_s") + F.col("onset")
    loose = F.concat(F.lit("about "), _clock(clock, "%d . %02d: %d"), F.lit(" h"))
    onset = F.element_at(F.array(F.lit("--"), loose, F.lit("25.00.00"), _clock(clock), _clock(clock), _clock(clock)), (F.col("event_id") % 6 + 1).cast("int"))
    name = F.concat(F.when(F.col("rec") % 2 == 0, "pnO6-").otherwise("R-"), F.col("rec").cast("string"))
    out = S.lenient_events(_texts(d, name, F.lit(None).cast("string"), onset, _clock(F.col("start_s") + F.col("offset"))))
    return out.select(
        F.col("source").cast("bigint").alias("rec"), "number", "file_name", "registration_start_clock_s", "start_clock_s", "end_clock_s"
    )


def _event_csv(spark, sf) -> str:
    """Listed events as a table of text in the shared folder."""
    d, path = _listed(spark, sf), _fresh(spark, "events")
    pairs = F.format_string("[[%d, %d], [%d, %d]]", "onset", F.col("onset") + 30, F.col("onset") + 20, F.col("onset") + F.col("number") * 20)
    d.select(
        F.concat(F.lit("P"), (F.col("rec") % 5).cast("string")).alias("patient"), F.concat(F.lit("R-"), F.col("rec").cast("string")).alias("canonical_file_name"),
        F.col("event_id").cast("string").alias("event_id"), F.col("number").alias("seizure_number"), F.col("onset").alias("onset_relative_s"),
        F.col("offset").alias("offset_relative_s_canonical"), pairs.alias("uncertain_intervals_json"), (F.col("event_id") % 17 != 0).alias("primary_eligible"),
        F.lit(86_400.0).alias("edf_duration_s")
    ).write.option("header", True).csv(path)
    return path


def q70_event_table(spark, sf):
    """The table of events under its declared types, with files that one ineligible event takes out."""
    out = S.quarantine(S.event_table(spark, _event_csv(spark, sf), include_quarantined=True))
    return out.select("patient", "canonical_file_name", "event_id", "seizure_number", "onset_relative_s", "primary_eligible", "file_eligible")


def q71_clipped_uncertain(spark, sf):
    """Uncertain seconds of eligible events between two clocks, from intervals kept as JSON."""
    events = S.event_table(spark, _event_csv(spark, sf))
    pairs = I.from_json_pairs(events, ["canonical_file_name"], "uncertain_intervals_json", 1)
    return I.clipped_measure(pairs, ["canonical_file_name"], F.lit(5_000), F.lit(30_000), "seconds")


def _montage(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(declared, signals): a recording is a file with the common channels, turned by its group, two leads, and a
    third one that nobody declared. Group 4 declares its fifth channel, O1, as 1."""
    r = B.recordings(spark, sf).select(F.col("rec").cast("string").alias("file"), (F.col("rec") % 5).cast("int").alias("grp"))
    names = F.array(*map(F.lit, S.COMMON_EEG))
    n = len(S.COMMON_EEG)
    c = r.select("file", "grp", F.explode(F.sequence(F.lit(0), F.lit(n + 2))).alias("index"))
    eeg = F.get(names, (F.col("index") + F.col("grp")) % n)
    lead = (F.col("index") - n + 1).cast("string")
    label = F.when(F.col("index") < n, F.concat(F.lit("EEG "), F.initcap(eeg))).when(F.col("index") < n + 2, lead).otherwise("ECG extra")
    said = F.when((F.col("grp") == 4) & (F.col("index") == 4), "1").when(F.col("index") < n, F.lower(eeg)).otherwise(F.concat(F.lit("EKG "), lead))
    c = c.select("file", "index", label.alias("label"), said.alias("said"))
    line = F.concat(F.lit("Channel "), (F.col("index") + 1).cast("string"), F.lit(": "), F.col("said"))
    lines = F.sort_array(F.collect_list(F.when(F.col("index") < n + 2, F.struct("index", line.alias("line")))))
    texts = c.groupBy(F.col("file").alias("source")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\r\n").alias("value"))
    return S.declared_channels(texts), c.select("file", F.col("file").alias("source"), F.lit(False).alias("large"), "index", "label")


def q72_channel_map(spark, sf):
    """Declared channels beside the signals they name."""
    return S.reconcile_channels(*_montage(spark, sf)).select(
        F.col("file").cast("bigint").alias("rec"), "channel_number_1based", "edf_index_0based", "official_name", "edf_raw_label", "modality",
        "canonical_name", "alias_note"
    )


def q73_channel_indices(spark, sf):
    """Indices by modality, and leads that stay out as nobody declared them."""
    declared, signals = _montage(spark, sf)
    out = S.channel_indices(S.reconcile_channels(declared, signals), signals)
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return out.select(
        F.col("file").cast("bigint").alias("rec"),
        *map(joined, ["eeg_indices", "eeg_names", "ecg_indices", "ecg_names", "extra_named_ecg_indices"])
    )


def q74_agreed_channels(spark, sf):
    """The channels that all recordings of a group have alike."""
    rows = stored(S.reconcile_channels(*_montage(spark, sf)).withColumn("grp", (F.col("file").cast("bigint") % 5).cast("string")), "channels")
    out = S.agreed_channels(rows, "grp", "EEG").unionByName(S.agreed_channels(rows, "grp", "ECG"))
    return out.select("grp", "channel_number_1based", "edf_raw_label", "modality", "canonical_name")


def q75_checksums(spark, sf):
    """A list of checksums of all documents against what their texts hash to."""
    d = B.table(spark, sf, "documents").select(
        F.col("doc_id"), F.concat(F.lit("text "), F.col("doc_id").cast("string")).alias("file_name"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")
    )
    path = _fresh(spark, "checksums")
    told = F.when(F.col("doc_id") % 7 == 0, F.sha2(F.col("sha256"), 256)).when(F.col("doc_id") % 5 == 0, F.upper("sha256")).otherwise(F.col("sha256"))
    d.select(F.concat_ws("  ", told, F.col("file_name")).alias("value")).write.text(path)
    out = S.verify_checksums(S.checksum_list(spark, path), d.where("doc_id % 11 <> 0").select("file_name", "sha256"))
    return out.select("file_name", "actual", "status")


def q76_resumed_table(spark, sf):
    """A partitioned table with its manifest, made once though asked for twice, and one made in two runs, the second of
    which does what the first has left; both read back."""
    rows = B.samples(spark, sf).select("rec", "event_id", "kind", "cents")
    one, two = _fresh(spark, "table"), _fresh(spark, "resumed")
    first, again = (K.write_table(rows, one, "table", {"by": "kind"}, {}, ("kind",)) for _ in range(2))
    files = K.frozen(spark, [one])
    doubled = lambda d: d.withColumn("doubled", F.col("cents") * 2)
    K.resume_into(rows.where("rec % 2 = 0"), two, ["event_id"], doubled)
    done = K.resume_into(rows, two, ["event_id"], doubled)
    counted = spark.read.schema(rows.schema).parquet(one).groupBy("kind").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    resumed = done.groupBy("kind").agg(F.count("*").alias("resumed"), F.sum("doubled").alias("doubled"))
    return counted.join(resumed, "kind").withColumn("same", F.lit(first == again and len(files) == len(first["files"])))


def q77_scaled_rows(spark, sf):
    """Training rows of each held-out group, imputed and standardised by what the other groups hold, with class weights."""
    frame = stored(X._training(spark, sf).select("rec", "grp", "t", "label", "available", "training_eligible", "eeg__one", "eeg__two"), "frame")
    out = FoldedLogistic(frame, "grp", ["eeg__one", "eeg__two"], list(range(5))).training_rows()
    return out.select("held", "rec", "t", "label", F.round("weight", 8).alias("weight"), *[F.round(F.col("z")[i], 6).alias(n) for i, n in enumerate(("one", "two"))])


def q78_group_audit(spark, sf):
    """Recordings, events and hours of groups, with all spellings of a text column."""
    group = (F.col("rec") % 5).alias("grp")
    r = B.recordings(spark, sf).select(
        group, (F.col("duration") / SECOND).alias("duration_s"), F.concat(F.lit("T"), (F.col("rec") % 3).cast("string")).alias("transducer"),
        F.when(F.col("rec") % 2 == 0, F.lit("")).otherwise("HP 0.1").alias("prefilter")
    )
    return V.group_audit(r, B.samples(spark, sf).where("kind = 'error'").select(group), "grp", ["transducer", "prefilter"])


def q79_older_rhythm(spark, sf):
    """The older nine features of a recording's events as beats, of which 20 hours are a second."""
    d = B.samples(spark, sf).groupBy("rec").agg(F.sort_array(F.collect_list("x")).alias("peaks"))
    return Y.with_older_rhythm(d, "peaks", float(20 * B.HOUR)).select("rec", *[F.round(c, 6).alias(c) for c in Y.OLDER])


CHUNK, HALO, CONTEXT, STEP = 40, 12, 12, 3


def q80_chunk_windows(spark, sf):
    """Trailing windows of a recording's scores, cut from chunks that are read with a halo."""
    cents = F.coalesce(F.round(F.col("score") * 20_000), F.lit(0.0))
    whole = B.decisions(spark, sf).groupBy("rec").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", cents.alias("v")))), lambda p: p["v"]).alias("all"))
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / CHUNK).cast("int"))).alias("chunk")
    start = F.greatest(F.lit(0), F.col("chunk") * CHUNK - HALO)
    segments = whole.select("rec", "all", chunk).select(
        F.col("rec").cast("string").alias("path"), F.lit(0).alias("channel_index"), start.alias("start_s"), F.lit(1.0).alias("sampling_rate"),
        F.slice("all", start + 1, (F.col("chunk") + 1) * CHUNK - start).alias("samples")
    )
    out = T.cut_windows(segments, CONTEXT, STEP, CONTEXT, CHUNK, HALO)
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)
    return out.select(F.col("path").cast("bigint").alias("rec"), "t", F.size("samples").alias("n"), total.alias("total"), F.get("samples", F.lit(0)).alias("first"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q") and n[1:3].isdigit()}

_P = B.prelude()
_L = f"""l0 AS (SELECT *, rec * 7919 % 86400 AS start_s, 100 + x // {SECOND} % 50000 AS onset, row_number() OVER (PARTITION BY rec ORDER BY x, event_id) AS number
  FROM ev WHERE kind = 'error'), li AS (SELECT *, onset + 60 + abs(cents) % 600 AS offset_ FROM l0)"""
_MONTAGE = f"""ch AS (SELECT rec, rec % 5 AS grp, i, CASE WHEN i < 19 THEN list_extract({S.COMMON_EEG}, CAST((i + rec % 5) % 19 + 1 AS INT)) ELSE 'ECG ' || (i - 18) END AS name
  FROM recs, range(21) r(i)),
cm AS (SELECT rec, grp, i + 1 AS channel_number_1based, i AS edf_index_0based,
  CASE WHEN grp = 4 AND i = 4 THEN '1' WHEN i < 19 THEN lower(name) ELSE replace(name, 'ECG', 'EKG') END AS official_name,
  CASE WHEN i < 19 THEN 'EEG ' || name[1] || lower(name[2:]) ELSE name[5:] END AS edf_raw_label,
  CASE WHEN i < 19 THEN 'EEG' ELSE 'ECG' END AS modality, name AS canonical_name,
  CASE WHEN grp = 4 AND i = 4 THEN 'official channel 5 ''1'' reconciled to EDF ''EEG O1''' ELSE '' END AS alias_note FROM ch)"""

ORACLE = {
    "q68_annotation_blocks": f"""{_P}, {_L} SELECT rec, CAST(number AS INT) AS number, CASE WHEN rec % 4 = 0 THEN 'PN06-' ELSE 'R-' END || rec || '.edf' AS file_name,
  onset AS onset_s, offset_ AS offset_s, NOT (number = 1 OR event_id % 3 = 0) AS registration_inherited, rec % 7 - 3 AS discrepancy_s,
  concat_ws(';', CASE WHEN event_id % 5 = 0 THEN offset_ || '-' || (offset_ + 20) END, CASE WHEN event_id % 4 = 0 THEN (onset - 5) || '-' || onset END) AS uncertain
FROM li""",
    "q69_lenient_blocks": f"""{_P}, {_L} SELECT rec, number, CASE WHEN rec % 2 = 0 THEN 'PN06-' ELSE 'R-' END || rec AS file_name,
  CAST(NULL AS INT) AS registration_start_clock_s, CASE WHEN event_id % 6 NOT IN (0, 2) THEN (start_s + onset) % 86400 END AS start_clock_s,
  (start_s + offset_) % 86400 AS end_clock_s FROM li""",
    "q70_event_table": f"""{_P}, {_L} SELECT 'P' || rec % 5 AS patient, 'R-' || rec AS canonical_file_name, CAST(event_id AS VARCHAR) AS event_id,
  number AS seizure_number, onset AS onset_relative_s, event_id % 17 <> 0 AS primary_eligible,
  bool_and(event_id % 17 <> 0) OVER (PARTITION BY rec) AS file_eligible FROM li""",
    "q71_clipped_uncertain": f"""{_P}, {_L}, j AS (SELECT 'R-' || rec AS rec, onset AS a, onset + 30 AS b FROM li WHERE event_id % 17 <> 0
  UNION ALL SELECT 'R-' || rec, onset + 20, onset + number * 20 FROM li WHERE event_id % 17 <> 0)
SELECT rec AS canonical_file_name, CAST(sum(greatest(0, least(b, 30000) - greatest(a, 5000))) AS BIGINT) AS seconds FROM {B.union_sql('j')} GROUP BY rec""",
    "q72_channel_map": f"{_P}, {_MONTAGE} SELECT * EXCLUDE (grp) FROM cm",
    "q73_channel_indices": f"""{_P}, {_MONTAGE} SELECT rec, string_agg(edf_index_0based, ',' ORDER BY edf_index_0based) FILTER (WHERE modality = 'EEG') AS eeg_indices,
  string_agg(canonical_name, ',' ORDER BY edf_index_0based) FILTER (WHERE modality = 'EEG') AS eeg_names, '19,20' AS ecg_indices, '1,2' AS ecg_names,
  '21' AS extra_named_ecg_indices FROM cm GROUP BY rec""",
    "q74_agreed_channels": f"""{_P}, {_MONTAGE} SELECT DISTINCT CAST(grp AS VARCHAR) AS grp, channel_number_1based, edf_raw_label, modality, canonical_name FROM cm""",
    "q75_checksums": """SELECT 'text ' || doc_id AS file_name, CASE WHEN doc_id % 11 <> 0 THEN sha256(coalesce(text, '')) END AS actual,
  CASE WHEN doc_id % 11 = 0 THEN 'MISSING' WHEN doc_id % 7 = 0 THEN 'FAIL' ELSE 'OK' END AS status FROM documents""",
    "q76_resumed_table": f"""{_P} SELECT kind, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS resumed, CAST(sum(2 * cents) AS BIGINT) AS doubled,
  true AS same FROM ev GROUP BY kind""",
    "q77_scaled_rows": f"""{_P}, {X._TR}, fr AS (SELECT tr.rec, tr.rec % 5 AS grp, tr.t, label, tr.score AS one, d2.score AS two FROM tr LEFT JOIN dec2 d2 ON d2.rec = tr.rec AND d2.t = tr.t),
f AS (SELECT h.held, fr.* FROM fr, range(5) h(held) WHERE fr.grp <> h.held),
md AS (SELECT held, coalesce(median(one), 0) AS m1, coalesce(median(two), 0) AS m2, count(*) AS n, count(*) FILTER (WHERE label = 1) AS n1 FROM f GROUP BY held),
im AS (SELECT f.held, rec, t, label, n, n1, coalesce(one, m1) AS one, coalesce(two, m2) AS two FROM f JOIN md USING (held)),
st AS (SELECT held, avg(one) AS a1, stddev_pop(one) AS s1, avg(two) AS a2, stddev_pop(two) AS s2 FROM im GROUP BY held)
SELECT CAST(held AS INT) AS held, rec, t, label, round(CASE WHEN label = 1 THEN CAST(n AS DOUBLE) / (2 * n1) ELSE CAST(n AS DOUBLE) / (2 * (n - n1)) END, 8) AS weight,
  round((one - a1) / s1, 6) AS one, round((two - a2) / s2, 6) AS two FROM im JOIN st USING (held)""",
    "q78_group_audit": f"""{_P} SELECT rec % 5 AS grp, count(*) AS recordings, round(sum(CAST({B.DURATION // SECOND} AS DOUBLE)) / 3600.0, 3) AS hours,
  string_agg(DISTINCT 'T' || rec % 3, ' ; ' ORDER BY 'T' || rec % 3) AS transducer, CASE WHEN count(*) FILTER (WHERE rec % 2 = 1) > 0 THEN 'HP 0.1' ELSE '' END AS prefilter,
  any_value(n) AS events FROM recs JOIN (SELECT rec % 5 AS grp, count(*) AS n FROM ev WHERE kind = 'error' GROUP BY 1) e ON e.grp = rec % 5 GROUP BY 1""",
    "q79_older_rhythm": f"""{_P}, b AS (SELECT rec, CAST(x AS DOUBLE) AS x, (x - lag(x) OVER (PARTITION BY rec ORDER BY x, event_id)) / CAST({20 * B.HOUR} AS DOUBLE) AS rr FROM ev),
v AS (SELECT rec, x, rr, sum(rr) OVER w - rr / 2 AS mid, abs(rr - lag(rr) OVER w) AS step FROM b WHERE rr BETWEEN 0.3 AND 2.0 WINDOW w AS (PARTITION BY rec ORDER BY x)),
a AS (SELECT rec, count(*) AS n, avg(60 / rr) AS hr, avg(rr) AS m, stddev_samp(rr) AS sd, sqrt(avg(step * step)) AS rm,
  CAST(count(*) FILTER (WHERE step > 0.05) AS DOUBLE) / nullif(count(step), 0) AS p, regr_slope(60 / rr, mid) * 60 AS tr FROM v GROUP BY rec)
SELECT r.rec, CAST(r.n AS DOUBLE) AS n_r_peaks, CAST(coalesce(a.n, 0) AS DOUBLE) AS valid_rr_count, CASE WHEN a.n > 1 THEN round(hr, 6) END AS mean_hr_bpm,
  CASE WHEN a.n > 1 THEN round(m, 6) END AS mean_rr_s, round(sd, 6) AS sdnn_s, round(rm, 6) AS rmssd_s, round(p, 6) AS pnn50, round(sd / m, 6) AS rr_cv,
  round(tr, 6) AS hr_trend_bpm_per_min FROM (SELECT rec, count(*) AS n FROM ev GROUP BY rec) r LEFT JOIN a USING (rec)""",
    "q80_chunk_windows": f"""{_P}, k AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY t) - 1 AS k, coalesce(round(score * 20000), 0.0) AS v FROM dec1)
SELECT a.rec, a.k AS t, count(*) AS n, sum(b.v) AS total, arg_min(b.v, b.k) AS first FROM k a JOIN k b ON b.rec = a.rec AND b.k >= a.k - {CONTEXT} AND b.k < a.k
WHERE a.k >= {CONTEXT} AND (a.k - {CONTEXT}) % {STEP} = 0 GROUP BY a.rec, a.k""",
}

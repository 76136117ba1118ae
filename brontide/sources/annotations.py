"""Annotation texts, channel declarations, checksum lists and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import clock as C
from . import files

EVENT_SCHEMA = "patient string, canonical_file_name string, event_id string, seizure_number int, onset_relative_s int, offset_relative_s_canonical int, uncertain_intervals_json string, primary_eligible boolean, edf_duration_s double"


def event_blocks(texts: DataFrame) -> DataFrame:
    """``texts``: source, value. One row for each numbered block, with its fields as text."""
    part = F.posexplode(F.split("value", r"(?im)^(?=\s*Seizure\s+n)", -1)).alias("_n", "block")
    b = texts.select("source", part).where(F.rlike("block", F.lit(r"(?i)Seizure\s+n\s*\d+")))
    number = F.regexp_extract("block", r"(?i)Seizure\s+n\s*(\d+)", 1).cast("int")
    fields = {
        "file_name": "File name", "registration_start": "Registration start time", "registration_end": "Registration end time",
        "onset_raw": "(?:Seizure )?Start time|Seizure start time", "offset_raw": "(?:Seizure )?End time|Seizure end time"
    }
    return b.select(
        "source", "_n", number.alias("number"), *[C.block_field(F.col("block"), f"(?:{p})" if "|" in p else p).alias(n) for n, p in fields.items()]
    )


def parse_events(blocks: DataFrame, headers: DataFrame) -> DataFrame:
    """Relative intervals of the blocks. ``headers``: source, file_name, start_s (of the day), duration_s.
    A missing registration start is taken from the last block of the same file that has one."""
    order = W.partitionBy("source", "file_name").orderBy("_n").rowsBetween(W.unboundedPreceding, 0)
    b = blocks.withColumn("file_name", F.replace("file_name", F.lit("PNO6"), F.lit("PN06")))
    b = b.withColumns(
        {
            "registration_inherited": F.col("registration_start").isNull(),
            "registration_start": F.last("registration_start", ignorenulls=True).over(order)
        }
    )
    j = b.join(headers, ["source", "file_name"]).withColumns({"onsets": C.candidates(F.col("onset_raw")), "offsets": C.candidates(F.col("offset_raw"))})
    rel = lambda c: C.relative_seconds(c, F.col("start_s"))
    onset = rel(C.primary_candidate(F.col("onsets"))["clock_s"])
    offset = F.array_min(F.transform("offsets", lambda x: rel(x["clock_s"])))
    spread = lambda c: F.transform(F.col(c), lambda x: rel(x["clock_s"]))
    span = lambda c: F.when(F.array_min(spread(c)) < F.array_max(spread(c)), F.array(F.array_min(spread(c)), F.array_max(spread(c))))
    out = j.withColumns(
        {
            "onset_s": onset, "offset_s": offset, "uncertain": F.array_compact(F.array(span("offsets"), span("onsets"))),
            "discrepancy_s": C.signed_difference(C.clock_seconds(F.col("registration_start")), F.col("start_s"))
        }
    )
    return out.where(C.check_interval(F.col("onset_s"), F.col("offset_s"), F.col("duration_s")))


def lenient_events(texts: DataFrame) -> DataFrame:
    """The older, forgiving reading of the same blocks: clocks that can't be read are null, nothing
    stops the job. Adds the clocks of registration and event, and the file name mended."""
    b = event_blocks(texts).withColumn("file_name", F.regexp_replace("file_name", "(?i)^PNO6", "PN06"))
    clocks = {
        "registration_start_clock_s": "registration_start", "registration_end_clock_s": "registration_end", "start_clock_s": "onset_raw",
        "end_clock_s": "offset_raw"
    }
    return b.withColumns({n: C.lenient_clock(F.col(c)) for n, c in clocks.items()})


def check_registrations(blocks: DataFrame, adjudicated: dict[tuple[str, int], int] | None = None) -> DataFrame:
    """``blocks``: source, file_name, number, registration_start, registration_end (text, null where
    none is given), start_s (of the file's header) and duration_s. Adds effective_start and
    effective_end (inherited from the last block of the file that has them), inherited and
    discrepancy_s. A number that comes twice, an inherited registration that nobody gave, two
    different ones for a file, and a start that differs from the header's by anything but what
    is ``adjudicated`` for (source, number) stop the job."""
    order = W.partitionBy("source", "file_name").orderBy("number")
    known = F.when(F.col("registration_start").isNotNull(), F.struct("registration_start", "registration_end"))
    lexical = F.struct(*[F.replace(c, F.lit(" "), F.lit("")).alias(c) for c in ("registration_start", "registration_end")])
    b = blocks.withColumns({
        "_times": F.count("*").over(W.partitionBy("source", "number")), "_known": F.last(known, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)),
        "_spellings": F.size(F.collect_set(F.when(F.col("registration_start").isNotNull(), lexical)).over(W.partitionBy("source", "file_name"))),
    })
    b = b.withColumns(
        {
            "effective_start": F.col("_known.registration_start"), "effective_end": F.col("_known.registration_end"),
            "inherited": F.col("registration_start").isNull()
        }
    )
    b = b.withColumn("discrepancy_s", C.signed_difference(F.col("start_s"), C.lenient_clock(F.col("effective_start"))))
    allowed = F.lit(0)
    for (source, number), seconds in (adjudicated or {}).items():
        allowed = F.when((F.col("source") == source) & (F.col("number") == number), seconds).otherwise(allowed)
    faults = [
        ("the same event twice", F.col("_times") > 1), ("no registration to inherit", F.col("effective_start").isNull()),
        ("conflicting registrations", F.col("_spellings") > 1),
        ("registration differs from the header", ~F.coalesce(F.col("discrepancy_s") == allowed, F.lit(False)))
    ]
    fault = F.coalesce(*[F.when(test, name) for name, test in faults])
    where = F.concat_ws(" ", fault, F.lit("in"), "source", F.col("number").cast("string"))
    return b.where(F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(where).cast("boolean"))).drop("_times", "_known", "_spellings")


def quarantine(events: DataFrame) -> DataFrame:
    """One ineligible event makes its whole file ineligible."""
    return events.withColumn("file_eligible", F.bool_and("primary_eligible").over(W.partitionBy("canonical_file_name")))


def declared_channels(texts: DataFrame) -> DataFrame:
    """``Channel n: name`` lines: source, number, name. Numbers that come twice, lines without a name,
    and a source without any such line stop the job."""
    line = F.explode_outer(F.regexp_extract_all("value", F.lit(r"(?im)^[ \t]*(Channel\s+\d[^\r\n]*)"), 1)).alias("line")
    c = texts.select("source", line)
    c = c.select(
        "source", F.regexp_extract("line", r"(?i)^Channel\s+(\d+)\s*:", 1).try_cast("int").alias("number"),
        F.nullif(F.trim(F.regexp_extract("line", r":\s*(.*)$", 1)), F.lit("")).alias("name")
    )
    c = c.withColumn("_n", F.count("*").over(W.partitionBy("source", "number")))
    fine = F.coalesce((F.col("_n") == 1) & F.col("number").isNotNull() & F.col("name").isNotNull(), F.lit(False))
    ok = F.when(fine, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("channels declared twice, in part, or not at all in "), F.col("source"))).cast("boolean")
    )
    return c.where(ok).drop("_n")


#: Channels of the common montage, those of the large one beside them, and the leads.
COMMON_EEG = "FP1 FP2 F3 F4 C3 C4 P3 P4 O1 O2 F7 F8 T3 T4 T5 T6 FZ CZ PZ".split()
FURTHER_EEG = "FC1 FC5 CP1 CP5 F9 FC2 FC6 CP2 CP6 F10".split()
LEADS = ["ECG 1", "ECG 2"]


def official_channels(declared: DataFrame, signals: DataFrame) -> DataFrame:
    """One row a declared channel (number from 1) beside the signal it names (index from 0), and
    ``fault``: what is wrong with it, or null. ``declared``: source, number, name; ``signals``:
    file, source, large (whether the large montage is expected), index, label. A lead is declared
    as EKG n and labelled n; channel 5 may be declared as 1, for O1."""
    j = declared.join(signals.withColumn("number", F.col("index") + 1), ["source", "number"], "inner")
    name = F.upper(F.trim("name"))
    is_lead = name.isin("EKG 1", "EKG 2")
    alias = (F.col("number") == 5) & (F.trim("name") == "1")
    canonical = F.when(is_lead, F.replace(name, F.lit("EKG"), F.lit("ECG"))).when(alias, "O1").otherwise(C.channel_label(F.col("name")))
    j = j.withColumns(
        {
            "modality": F.when(is_lead, "ECG").otherwise("EEG"), "canonical_name": canonical,
            "alias_note": F.when(alias, "official channel 5 '1' reconciled to EDF 'EEG O1'").otherwise("")
        }
    )
    twice = F.count("*").over(W.partitionBy("file", "modality", "canonical_name")) > 1
    fault = F.coalesce(
        F.when(is_lead & (F.col("label") != F.substring(F.col("name"), -1, 1)), "ecg_label_mismatch"),
        F.when(~is_lead & ~F.col("canonical_name").isin(COMMON_EEG + FURTHER_EEG), "unknown_identity"),
        F.when(~is_lead & (C.channel_label(F.col("label")) != F.col("canonical_name")), "eeg_label_mismatch"), F.when(twice, "duplicate_identity"))
    return j.select(
        "file", "source", F.col("number").alias("channel_number_1based"), F.col("index").alias("edf_index_0based"),
        F.col("name").alias("official_name"), F.col("label").alias("edf_raw_label"), "modality", "canonical_name", "alias_note", "large",
        fault.alias("fault")
    )


def channel_faults(declared: DataFrame, signals: DataFrame) -> DataFrame:
    """file and fault, one row each: those of :func:`official_channels`, channels declared beyond the
    file's signals, and leads or channels of the montage that nobody declared."""
    rows = official_channels(declared, signals)
    files = signals.groupBy("file", "source").agg(F.count("*").alias("n"), F.bool_or("large").alias("large"))
    outside = files.join(declared, "source").where(~F.col("number").between(1, F.col("n"))).select("file", F.lit("outside_header").alias("fault"))
    has = files.join(
        rows.groupBy("file").agg(F.collect_set("canonical_name").alias("names")), "file", "left"
    ).withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    wanted = F.when(F.col("large"), F.array(*map(F.lit, COMMON_EEG + FURTHER_EEG))).otherwise(F.array(*map(F.lit, COMMON_EEG)))
    lacks = lambda want: F.size(F.array_except(want, "names")) > 0
    missing = has.select(
        "file",
        F.explode(
            F.array_compact(F.array(F.when(lacks(F.array(*map(F.lit, LEADS))), "missing_lead"), F.when(lacks(wanted), "missing_common_eeg")))
        ).alias("fault")
    )
    return rows.where("fault IS NOT NULL").select("file", "fault").unionByName(outside).unionByName(missing)


def reconcile_channels(declared: DataFrame, signals: DataFrame) -> DataFrame:
    """:func:`official_channels`, without faults: any stops the job."""
    rows = official_channels(declared, signals)
    bad = channel_faults(declared, signals).groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("fault")), ", ").alias("_faults"))
    ok = F.when(F.col("_faults").isNull(), F.lit(True)).otherwise(
        F.raise_error(F.concat_ws(": ", F.lit("channels"), "file", "_faults")).cast("boolean")
    )
    return rows.join(bad, "file", "left").where(ok).drop("_faults", "fault", "large")


def agreed_channels(rows: DataFrame, group: str, modality: str) -> DataFrame:
    """The channels of one modality that all files of a group have alike, in their order; a group
    whose files differ stops the job. ``rows``: reconciled channels with ``group``."""
    line = F.struct("channel_number_1based", "edf_index_0based", "official_name", "edf_raw_label", "modality", "canonical_name", "alias_note")
    per_file = rows.groupBy(group, "file").agg(F.sort_array(F.collect_list(line)).alias("map"))
    one = per_file.groupBy(group).agg(F.count_distinct("map").alias("n"), F.first("map").alias("map"))
    ok = F.when(F.col("n") == 1, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("files differ in their channels: "), F.col(group))).cast("boolean")
    )
    return one.where(ok).select(group, F.inline("map")).where(F.col("modality") == modality)


def channel_indices(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """A row a file: indices and names by modality, and the signals called a lead that were not
    declared, which stay out."""
    ranked = lambda m, c: F.transform(
        F.sort_array(F.collect_list(F.when(F.col("modality") == m, F.struct("edf_index_0based", F.col(c).alias("v"))))), lambda x: x["v"]
    )
    named = rows.groupBy("file").agg(
        *[
            ranked(m, c).alias(f"{m.lower()}_{n}") for m, c,
            n in (
                ("EEG", "edf_index_0based", "indices"), ("EEG", "canonical_name", "names"), ("ECG", "edf_index_0based", "indices"),
                ("ECG", "edf_raw_label", "names")
            )
        ]
    )
    lead = F.rlike(F.upper("label"), F.lit("ECG|EKG"))
    extra = signals.groupBy("file").agg(F.sort_array(F.collect_list(F.when(lead, F.col("index")))).alias("_leads"))
    return named.join(extra, "file").withColumn("extra_named_ecg_indices", F.array_except("_leads", "ecg_indices")).drop("_leads")


def checksum_list(spark: SparkSession, path: str) -> DataFrame:
    """``digest  file`` lines."""
    part = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).where("trim(value) <> ''").select(part[0].alias("sha256"), part[1].alias("file_name"))


def verify_checksums(listed: DataFrame, found: DataFrame) -> DataFrame:
    """``listed`` and ``found``: file_name, sha256. A row a listed file: OK, FAIL or MISSING."""
    j = listed.join(found.withColumnRenamed("sha256", "actual"), "file_name", "left")
    status = F.when(F.col("actual").isNull(), "MISSING").when(F.lower("actual") == F.lower("sha256"), "OK").otherwise("FAIL")
    return j.select("file_name", "sha256", "actual", status.alias("status"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """file_name (its path below the folder) and sha256 of the files below a folder, hashed in blocks where they lie."""
    return files.below(spark, path).select(F.col("file").alias("file_name"), "sha256")


def event_table(spark: SparkSession, path: str, include_quarantined: bool = False) -> DataFrame:
    """The canonical event table; types are declared, never inferred."""
    t = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    cols = [x.split() for x in EVENT_SCHEMA.split(", ")]
    t = t.select(*[F.col(n).cast(k).alias(n) for n, k in cols])
    return t if include_quarantined else t.where("primary_eligible")

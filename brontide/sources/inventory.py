"""The inventory of a collection: events, recordings and channels, checked as a whole before any is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks as V
from ..operators.staging import stored
from . import annotations as N
from . import sinks as K


def build(texts: DataFrame, headers: DataFrame, signals: DataFrame, adjudicated: dict[tuple[str, int], int] | None = None) -> dict[str, DataFrame]:
    """The three tables, stored, so that every check on every row has run when they come back.

    ``texts``: source, value; ``headers``: source, file_name, start_s, duration_s; ``signals``: as
    :func:`.annotations.official_channels` takes them. Recordings that no annotation names, and
    annotations that name none, stop the job."""
    blocks = N.event_blocks(texts).withColumn("file_name", F.replace("file_name", F.lit("PNO6"), F.lit("PN06")))
    lost = blocks.select("source", "file_name").join(headers, ["source", "file_name"], "left_anti").withColumn("why", F.lit("unknown recording"))
    bare = headers.select("source", "file_name").join(
        blocks, ["source", "file_name"], "left_anti"
    ).withColumn("why", F.lit("recording without annotation"))
    odd = lost.unionByName(bare).limit(5).collect()  # to name some of them
    if odd:
        raise ValueError("; ".join(f"{r.why}: {r.source} {r.file_name}" for r in odd))
    registered = N.check_registrations(
        blocks.join(headers, ["source", "file_name"]), adjudicated
    ).select("source", "number", "discrepancy_s", "inherited")
    parsed = N.parse_events(blocks, headers).drop("discrepancy_s", "registration_inherited", "_n")
    events = stored(parsed.join(registered, ["source", "number"]).withColumn("uncertain_flag", F.size("uncertain") > 0), "events")
    channels = stored(N.reconcile_channels(N.declared_channels(texts), signals), "channels")
    counts = channels.groupBy("source", F.col("file").alias("file_name")).agg(
        F.count_if(F.col("modality") == "EEG").alias("n_eeg"), F.count_if(F.col("modality") == "ECG").alias("n_ecg")
    )
    per_file = events.groupBy("source", "file_name").agg(F.count("*").alias("event_count"))
    recordings = stored(headers.join(per_file, ["source", "file_name"]).join(counts, ["source", "file_name"], "left"), "recordings")
    return {"events": events, "recordings": recordings, "channels": channels}


def write(tables: dict[str, DataFrame], root: str, config: dict) -> str:
    """Write the tables and their manifest; the identity of the whole."""
    spark = tables["events"].sparkSession
    return K.write_metadata(spark, f"{root}/inventory.json", {f"{root}/{n}": d for n, d in tables.items()}, config)


def replay(made: dict[str, DataFrame], root: str) -> DataFrame:
    """Rows, with the table they are of, in which tables made anew differ from those written."""
    out = None
    for n, d in made.items():
        diff = V.differences(d, d.sparkSession.read.parquet(f"{root}/{n}").select(*d.columns)).select(
            F.lit(n).alias("table"), F.to_json(F.struct(*d.columns)).alias("row"), "surplus"
        )
        out = diff if out is None else out.unionByName(diff)
    return out

"""Leads of a beat signal: evidence, gates, agreement of a pair, and the older features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import dsp
from . import channels as H
from . import rhythm as Y

_MEASURES = "finite_fraction double, raw_std double, filtered_std double, rail_fraction double, contrast double, beats array<bigint>"
_QRS = "peaks array<bigint>, snr_proxy double"
NONE = "nonfinite"

#: The measure, its limit (a least value, or for rail_fraction a most), the reason given.
GATES = [
    ("raw_std", 1.0, "flat_or_low_variation"),
    ("filtered_std", 0.5, "low_qrs_variation"),
    ("rail_fraction", 0.01, "saturation"),
    ("valid_rr_count", 20, "few_beats"),
    ("valid_rr_fraction", 0.8, "invalid_rr"),
    ("rr_coverage", 0.75, "rr_gaps"),
    ("contrast", 3.0, "low_peak_contrast"),
]


def _table(rows: list[dict], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])


def measure_leads(df: DataFrame, samples: str, fs: float, low: str | None = None, high: str | None = None) -> DataFrame:
    """Adds the measures of each row's samples and what follows from its beats: intervals (the valid
    ones, 0.30 to 2 s, in seconds), their count, share and coverage of the window, and the median
    rate. Leads that are missing, shorter than a second or not finite have no beats."""

    @F.pandas_udf(_MEASURES)
    def run(arrays: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.DataFrame:
        rows = []
        for x, a, b in zip(arrays, lows, highs, strict=True):
            if x is None or len(x) < fs:
                rows.append({"finite_fraction": 0.0, "contrast": 0.0, "beats": []})
            else:
                rows.append(dsp.lead_measures(np.asarray(x, float), fs, None if pd.isna(a) else a, None if pd.isna(b) else b))
        return _table(rows, _MEASURES)

    rail = lambda c: F.col(c).cast("double") if c else F.lit(None).cast("double")
    out = df.withColumn("_m", run(F.col(samples), rail(low), rail(high))).select(*df.columns, "_m.*", (F.size(samples) / fs).alias("_s"))
    out = out.withColumn("intervals", F.when(F.size("beats") > 1, Y.compressed_rr(F.col("beats"), fs)).otherwise(F.array().cast("array<double>")))
    n = F.size("intervals")
    total = F.aggregate("intervals", F.lit(0.0), lambda s, x: s + x)
    out = out.withColumns(
        {
            "valid_rr_count": n, "valid_rr_fraction": F.coalesce(F.try_divide(n.cast("double"), (F.size("beats") - 1).cast("double")), F.lit(0.0)),
            "rr_coverage": F.coalesce(F.try_divide(total, F.col("_s")), F.lit(0.0))
        }
    )
    return out.withColumn("median_rate", Y.array_median(F.transform("intervals", lambda x: 60.0 / x))).drop("_s")


def quality_gates(df: DataFrame) -> DataFrame:
    """Adds good, and reason: the gates that failed, in their order, or ``good``."""
    fails = lambda c, limit: F.col(c) > limit if c == "rail_fraction" else F.col(c) < limit
    failed = F.array_join(F.array_compact(F.array(*[F.when(fails(c, limit), why) for c, limit, why in GATES])), "|")
    reason = F.when(F.col("finite_fraction") < 1, NONE).when(failed == "", "good").otherwise(failed)
    return df.withColumn("reason", reason).withColumn("good", F.col("reason") == "good")


def _agreement(fs: float, tolerance_s: float):
    @F.pandas_udf("double")
    def run(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series(
            [dsp.beat_agreement(np.asarray(a), np.asarray(b), tolerance_s * fs) for a, b in zip(first, second, strict=True)], dtype=float
        )

    return run


def arbitrate(leads: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """One row a window: the chosen lead (0 or 1, or null), why, and how far the two leads' beats agree.
    ``leads``: the output of :func:`quality_gates`, with keys and lead; a window has two."""
    both = W.partitionBy(*keys)
    first = lambda lead: F.max(F.when(F.col("lead") == lead, F.col("beats"))).over(both)
    x = leads.withColumns({"_a": first(0), "_b": first(1)}).withColumn("agreement", _agreement(fs, 0.10)(F.col("_a"), F.col("_b")))
    x = x.withColumns(
        {
            "rate": F.col("median_rate"), "valid_fraction": F.col("valid_rr_fraction"), "coverage": F.col("rr_coverage"),
            "agreement": F.when(~F.isnan("agreement"), F.col("agreement"))
        }
    )
    apart: Column = F.col("rate_high") - F.col("rate_low") > F.greatest(F.lit(10.0), 0.15 * F.col("rate_low"))
    chosen = Y.choose_lead(x, keys, "agreement", apart, 0.70)
    return chosen.join(x.groupBy(*keys).agg(F.first("agreement").alias("agreement")), keys)


def older_features(df: DataFrame, samples: str, fs: float) -> DataFrame:
    """The older nine features a lead, null for samples that are too few or not finite."""

    @F.pandas_udf("array<bigint>")
    def beats(arrays: pd.Series) -> pd.Series:
        usable = lambda x: x is not None and len(x) >= fs and np.isfinite(np.asarray(x, float)).all()
        return pd.Series([dsp.centred_beats(x, fs) if usable(x) else None for x in arrays], dtype=object)

    return Y.with_older_rhythm(df.withColumn("_beats", beats(F.col(samples))), "_beats", fs).drop("_beats")


def reduce_leads(features: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Median and range of each feature over the leads that have it."""
    return features.groupBy(*keys).agg(*[x for c in names for x in (F.median(c).alias(f"{c}_median"), (F.max(c) - F.min(c)).alias(f"{c}_range"))])


def qrs_quality(df: DataFrame, samples: str, fs: float) -> DataFrame:
    """Quality of a lead by prominent beats: their number, median rate, relative spread of the valid
    intervals (population) and strength over noise; null for samples that are too few."""

    @F.pandas_udf(_QRS)
    def run(arrays: pd.Series) -> pd.DataFrame:
        found = [dsp.prominent_beats(x, fs) if x is not None and len(x) >= fs else (None, None) for x in arrays]
        return _table([{"peaks": p, "snr_proxy": z} for p, z in found], _QRS)

    peaks = F.col("_q.peaks")
    rr = F.when(F.size(peaks) > 1, Y.compressed_rr(peaks, fs)).when(peaks.isNotNull(), F.array().cast("array<double>"))
    d = df.withColumn("_q", run(F.col(samples))).withColumn("_rr", rr).withColumn("_s", Y.walked(F.col("_rr")))
    s, n = F.col("_s"), F.size("_rr").cast("double")
    return d.withColumns(
        {
            "n_peaks": F.when(peaks.isNotNull(), F.size(peaks).cast("double")), "median_hr_bpm": Y.array_median(F.transform("_rr", lambda x: 60.0 / x)),
            "rr_cv": F.when(n > 1, F.try_divide(Y.spread(s, n, 0), F.try_divide(s["t"], n))), "snr_proxy": F.col("_q.snr_proxy")
        }
    ).drop("_q", "_rr", "_s")


def lead_correlation(df: DataFrame, keys: list[str], lead: str, samples: str, fs: float) -> DataFrame:
    """Mean absolute correlation of the band-passed leads of a window; null with fewer than two that
    are finite and not flat."""

    @F.pandas_udf("array<double>")
    def band(arrays: pd.Series) -> pd.Series:
        fits = lambda x: x is not None and len(x) >= fs and np.isfinite(np.asarray(x, float)).all()
        return pd.Series([dsp.centred_band(x, fs) if fits(x) else None for x in arrays], dtype=object)

    filtered = df.select(*keys, lead, band(F.col(samples)).alias("_band")).where("_band IS NOT NULL")
    return H.correlation_summary(filtered, keys, lead, "_band").select(*keys, F.col("mean_abs_channel_corr").alias("ecg_channel_agreement"))

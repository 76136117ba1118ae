"""Spectral features of sample arrays: numpy kernels on Arrow batches, a row a channel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsp
from . import channels as H
from . import leads as L
from . import rhythm as Y

NAMES = dsp.CHANNEL_FEATURES
BLOCK = 1 << 18  # samples of a matrix: spectra of all windows of a batch at once would be many times the batch


def feature_rows(arrays: pd.Series, fs: float, block: int = BLOCK) -> np.ndarray:
    """Twenty-two features a channel. The channels that are of one length are matrices of at most ``block`` samples."""
    out = np.full((len(arrays), len(NAMES)), np.nan)
    lengths = np.array([0 if a is None else len(a) for a in arrays])
    for n in np.unique(lengths[lengths >= fs]):
        of_length, rows = np.flatnonzero(lengths == n), max(1, block // int(n))
        for at in (of_length[i:i + rows] for i in range(0, len(of_length), rows)):
            x = np.stack([np.asarray(arrays.iloc[i], float) for i in at])
            whole = np.isfinite(x).all(axis=1)
            if fs >= 90 and whole.any():
                out[at[whole]] = dsp.feature_matrix(x[whole], fs)
    return out


def channel_features(df: DataFrame, samples: str, fs: float) -> DataFrame:
    """Twenty-two features a channel; null for channels that are too short, not finite, or slow (see :func:`feature_rows`)."""
    schema = ", ".join(f"{n} double" for n in NAMES)

    @F.pandas_udf(schema)
    def run(arrays: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(feature_rows(arrays, fs), columns=NAMES)

    features = df.withColumn("_f", run(F.col(samples)))
    return features.select(*df.columns, *[F.when(~F.isnan(f"_f.{n}"), F.col(f"_f.{n}")).alias(n) for n in NAMES])


def window_features(windows: DataFrame, keys: list[str], channel: str, samples: str, fs: float) -> DataFrame:
    """Forty-six features of a window: mean and population spread over its channels of each channel
    feature, and of the absolute correlations between channels that are not flat. A window with a
    sample that is not finite, or flat on all channels, has none, and says why. ``windows``: one
    row for each window (``keys``) and channel; both halves share one shuffle."""
    w = windows.repartition(*keys)
    f = channel_features(w, samples, fs)
    reason = F.when(F.bool_or(F.col("rms").isNull()) | (F.max("std") <= 0), "nonfinite_or_all_flat").otherwise("")
    out = H.reduce_channels(f, keys, NAMES, reason.alias("unavailable_reason"))
    corr = H.correlation_summary(w, keys, channel, samples).select(*keys, "mean_abs_channel_corr", "std_abs_channel_corr")
    out = out.join(corr, keys, "left")
    names = [c for c in out.columns if c not in keys and c != "unavailable_reason"]
    return out.select(*keys, "unavailable_reason", *[F.when(F.col("unavailable_reason") == "", F.col(c)).alias(c) for c in names])


def columns_by_prefix(columns: list[str], *prefixes: str) -> list[list[str]]:
    return [[c for c in columns if c.startswith(p)] for p in prefixes]




def anchor_rows(channels: DataFrame, leads: DataFrame, keys: list[str], channel: str, samples: str, fs: float, lead_fs: float) -> DataFrame:
    """One row an anchor (``keys``) with the features of both modalities under their prefixes: those of
    its channels, median and range over its leads, and how far the leads agree. Both must have
    one sampling rate."""
    if fs != lead_fs:
        raise ValueError(f"the modalities have different sampling rates: {fs} and {lead_fs}")
    eeg = window_features(channels, keys, channel, samples, fs).drop("unavailable_reason")
    beats = L.older_features(leads, samples, lead_fs)
    ecg = L.reduce_leads(beats, keys, Y.OLDER).join(L.lead_correlation(leads, keys, channel, samples, lead_fs), keys, "left")
    counts = channels.groupBy(*keys).agg(F.count("*").cast("double").alias("n_eeg_channels")).join(
        leads.groupBy(*keys).agg(F.count("*").cast("double").alias("n_ecg_channels")), keys
    )
    named = lambda d, prefix: d.select(*keys, *[F.col(c).alias(prefix + c) for c in d.columns if c not in keys])
    return counts.withColumn("sampling_rate_hz", F.lit(float(fs))).join(named(eeg, "eeg__"), keys).join(named(ecg, "ecg__"), keys)

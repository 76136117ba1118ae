"""Features of sample arrays by higher-order functions, and reductions across channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _mean(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a).cast("double"))


def _let(value: Column, f) -> Column:
    """f of a value worked out once: a column used inside a lambda would be worked out per element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _variance(a: Column) -> Column:
    return _let(_mean(a), lambda m: F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)), F.size(a).cast("double")))


def _diff(a: Column) -> Column:
    return F.zip_with(F.slice(a, 2, F.size(a)), F.slice(a, 1, F.size(a) - 1), lambda y, x: y - x)


def time_features(df: DataFrame, samples: str) -> DataFrame:
    """Of the samples less their mean: rms, std, line_length and the Hjorth measures activity, mobility
    and complexity, the latter two 0 if flat; null without samples."""
    a = df.withColumn("_a", F.transform(samples, lambda x: x.cast("double")))
    a = a.withColumn("_d", _diff(F.col("_a"))).withColumn("_dd", _diff(F.col("_d")))
    for c in ("_a", "_d", "_dd"):
        a = a.withColumn(f"{c}v", _variance(F.col(c)))
    line = F.try_divide(F.aggregate("_d", F.lit(0.0), lambda s, x: s + F.abs(x)), F.size("_d").cast("double"))
    ratio = lambda x, y: F.when(F.col(y) > 0, F.sqrt(F.col(x) / F.col(y))).when(F.size("_a") > 0, 0.0)
    mobility = ratio("_dv", "_av")
    out = a.withColumns(
        {"rms": F.sqrt("_av"), "std": F.sqrt("_av"), "line_length": line, "hjorth_activity": F.col("_av"), "hjorth_mobility": mobility}
    )
    out = out.withColumn(
        "hjorth_complexity", F.when(F.col("hjorth_mobility") > 0, ratio("_ddv", "_dv") / F.col("hjorth_mobility")).otherwise(F.col("hjorth_mobility"))
    )
    return out.drop(*[c for c in out.columns if c[0] == "_"])


def reduce_channels(features: DataFrame, keys: list[str], names: list[str], *more: Column) -> DataFrame:
    """Mean and population spread of each feature over the channels that have it, and ``more``."""
    return features.groupBy(*keys).agg(
        *more, *[f(c).alias(f"{c}_{n}") for c in names for f, n in ((F.avg, "mean"), (F.stddev_pop, "std_across_channels"))]
    )


def correlation_summary(channels: DataFrame, keys: list[str], channel: str, samples: str) -> DataFrame:
    """Mean and population spread of the absolute correlation over pairs of channels that are not
    flat; null with fewer than two. Channels of a window are few and come together as one
    array; pairs are made inside the row."""
    centred = lambda a: _let(_mean(a), lambda m: F.transform(a, lambda x: x - m))
    scaled = lambda c: _let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.when(n > 0, F.transform(c, lambda x: x / n)))
    whole = _let(F.transform(samples, lambda x: x.cast("double")), lambda a: _let(centred(a), scaled))
    unit = channels.select(*keys, channel, whole.alias("_u")).where("_u IS NOT NULL")
    sets = unit.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(channel).alias("c"), F.col("_u").alias("u")))).alias("_s"))
    dot = lambda x, y: F.abs(F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z))
    pairs = F.flatten(F.transform("_s", lambda x, i: F.transform(F.slice("_s", i + 2, F.size("_s")), lambda y: dot(x["u"], y["u"]))))
    out = sets.withColumn("_r", pairs).withColumn("n_channels", F.size("_s"))
    out = out.withColumn("mean_abs_channel_corr", _mean(F.col("_r"))).withColumn("std_abs_channel_corr", F.sqrt(_variance(F.col("_r"))))
    return out.select(*keys, "n_channels", "mean_abs_channel_corr", "std_abs_channel_corr")

"""Prefix sums and exact quantiles of groups of any size.

A group's values are cut into ranges at approximate quantiles of all rows (one small mergeable
sketch), so no task sees a whole group: within a range a window adds up, and what lies before
a range comes from the ranges' totals, of which a group has ``PIECES`` at most. Cuts only decide
how even the ranges are; sums and quantiles are exact whatever they are.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .staging import stored

PIECES = 256


def cuts(df: DataFrame, value: str, pieces: int = PIECES) -> list[float]:
    """At most ``pieces`` - 1 ascending values that cut the rows into ranges of about equal size."""
    at = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    found = df.agg(F.percentile_approx(F.col(value).cast("double"), at, F.lit(10 * pieces)).alias("c")).first().c
    return sorted({float(x) for x in found or () if x is not None and abs(x) < float("inf")})


def running(counted: DataFrame, by: list[str], value: str, sums: list[str], pieces: int = PIECES) -> DataFrame:
    """Adds, for each column of ``sums``, <column>_before, its sum over the rows of the group (``by``) with a
    lesser value, and <column>_total, that of the whole group. ``counted`` has one row a group and
    value, which is no NaN, and is read three times: it had better be stored."""
    number, piece = "_number", "_piece"
    at = cuts(counted, value, pieces)
    d = counted.withColumn(number, F.col(value).cast("double"))
    if at:
        d = Bucketizer(splits=[-float("inf"), *at, float("inf")], inputCol=number, outputCol=piece, handleInvalid="keep").transform(d)
    else:
        d = d.withColumn(piece, F.lit(0.0))
    ranges = d.groupBy(*by, piece).agg(*[F.sum(c).alias(f"_in_{c}") for c in sums])
    earlier, group = W.partitionBy(*by).orderBy(piece).rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by)
    ranges = ranges.withColumns(
        {f"_off_{c}": F.coalesce(F.sum(f"_in_{c}").over(earlier), F.lit(0)) for c in sums} | {f"{c}_total": F.sum(f"_in_{c}").over(group) for c in sums}
    ).select(*[F.col(c).alias(f"_r_{c}") for c in [*by, piece]], *[f"_off_{c}" for c in sums], *[f"{c}_total" for c in sums])
    within = W.partitionBy(*by, piece).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumns({f"_own_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums})
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in [*by, piece]]
    return d.join(ranges, same).select(
        *counted.columns, *[(F.col(f"_own_{c}") + F.col(f"_off_{c}")).alias(f"{c}_before") for c in sums], *[f"{c}_total" for c in sums]
    )


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float], pieces: int = PIECES) -> DataFrame:
    """Exact quantiles (between two values by their distances, as ``percentile`` has them) of each group
    that has a value, a column each; nulls and NaN don't count."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counted = stored(rows.groupBy(*by, value).agg(F.count("*").alias("n")), "values")
    r = running(counted, by, value, ["n"], pieces)
    place = {n: q * (F.col("n_total") - 1) for n, q in at.items()}
    holds = lambda k: (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
    v = F.col(value).cast("double")
    picked = [F.max(F.when(holds(f(p)), v)).alias(f"_{side}_{n}") for n, p in place.items() for side, f in (("lo", F.floor), ("hi", F.ceil))]
    r = r.groupBy(*by, "n_total").agg(*picked) if by else r.groupBy("n_total").agg(*picked)

    def between(n: str):
        lo, hi, p = F.col(f"_lo_{n}"), F.col(f"_hi_{n}"), place[n]
        return F.when(lo == hi, lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi)

    return r.select(*by, *[between(n).alias(n) for n in at])

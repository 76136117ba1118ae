"""Replay of result tables: what is made anew is compared with what was written, without moving what is equal.

Each table is cut into ``BUCKETS`` by the hash of its keys, and each bucket has a fingerprint that adds
up over rows: their number and two sums of row hashes. Fingerprints are made where the rows
lie, and a bucket's is one row a task, so a table that is as it was costs a scan. Only rows
of buckets that differ are matched by key, and then cell by cell; what comes back names the
table, the key, the column and both values.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..operators import results as R

BUCKETS = 1024
ROW = "(row)"

#: The tables of each result set, and their keys.
LEVEL_KEYS = {"fold_metrics": ["grp", "rec", "model"], "patient_metrics": ["grp", "model"], "pooled_metrics": ["model"]}
BASELINE = LEVEL_KEYS | {
    "alarms": ["grp", "rec", "model", "declaration"], "event_matches": ["grp", "rec", "model", "event_id"], "evaluation_exposure": ["grp", "rec", "model", "start"],
}
FUSION = BASELINE | {
    "paired_comparison": ["level", "grp", "rec"], "event_comparison": ["grp", "rec", "event_id"], "false_alarm_fate": ["grp", "rec", "declaration"],
    "added_false_alarms": ["grp", "rec", "declaration"], "ecg_contribution_recordings": ["grp", "rec"], "ecg_contribution_patients": ["grp"],
    "alpha_distribution": ["grp", "alpha"],
}


def _plain(field: T.StructField) -> Column:
    """A value that can be hashed: maps as their sorted entries."""
    c = F.col(f"`{field.name}`")
    return F.sort_array(F.map_entries(c)) if isinstance(field.dataType, T.MapType) else c


def fingerprints(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """_bucket (by the hash of the keys), rows and two additive hashes of a table's buckets."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    rows = df.select(_bucket(keys, buckets).alias("_bucket"), *[F.xxhash64(F.lit(seed), *map(_plain, fields)).cast("decimal(38,0)").alias(f"_h{seed}") for seed in (1, 2)])
    return rows.groupBy("_bucket").agg(F.count("*").alias("n"), F.sum("_h1").alias("h1"), F.sum("_h2").alias("h2"))


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), *[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


def changed_buckets(made: DataFrame, kept: DataFrame, keys: list[str], buckets: int = BUCKETS) -> list[int]:
    a, b = (fingerprints(d, keys, buckets) for d in (made, kept))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("n", "h1", "h2")]
    j = a.alias("a").join(b.alias("b"), F.col("a._bucket") == F.col("b._bucket"), "full_outer")
    return sorted(r[0] for r in j.where(~(same[0] & same[1] & same[2])).select(F.coalesce("a._bucket", "b._bucket")).collect())  # BUCKETS at most


def differences(made: DataFrame, kept: DataFrame, keys: list[str], tolerance: float = 0.0, buckets: int = BUCKETS) -> DataFrame:
    """key (JSON), column, made and kept (as text) of each cell that differs, by more than ``tolerance`` for
    numbers with fractions; a row that only one side has is one row of column ``(row)``. Rows of
    equal keys are matched in order of their columns. Tables of different columns stop the job."""
    if sorted(made.columns) != sorted(kept.columns) or dict(made.dtypes) != dict(kept.dtypes):
        raise ValueError("the tables have different columns")
    spark, rest = made.sparkSession, [f for f in made.schema.fields if f.name not in keys]
    found = changed_buckets(made, kept, keys, buckets)
    if not found:
        return spark.createDataFrame([], "key string, column string, made string, kept string")

    def side(d: DataFrame, name: str) -> DataFrame:
        d = d.where(_bucket(keys, buckets).isin(found))
        cells = F.struct(*[F.col(f"`{f.name}`") for f in rest], F.lit(True).alias("_there"))
        order = [_plain(f) for f in made.schema.fields]
        return d.select(*keys, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).alias("_copy"), cells.alias(name))

    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in [*keys, "_copy"]]
    j = side(made, "made").alias("x").join(side(kept, "kept").alias("y"), same, "full_outer")
    key = F.to_json(F.struct(*[F.coalesce(F.col(f"x.{k}"), F.col(f"y.{k}")).alias(k) for k in keys]))
    j = j.select(key.alias("key"), "made", "kept")

    def apart(f: T.StructField) -> Column:
        a, b = F.col(f"made.`{f.name}`"), F.col(f"kept.`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            near = F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
            return ~(a.eqNullSafe(b) | near)
        if isinstance(f.dataType, T.MapType):
            return ~F.sort_array(F.map_entries(a)).eqNullSafe(F.sort_array(F.map_entries(b)))
        return ~a.eqNullSafe(b)

    def text(f: T.StructField, side_name: str) -> Column:
        c = F.col(f"{side_name}.`{f.name}`")
        return F.to_json(c) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else c.cast("string")

    both = F.col("made._there").isNotNull() & F.col("kept._there").isNotNull()
    cells = [
        F.when(both & apart(f), F.struct(F.lit(f.name).alias("column"), text(f, "made").alias("made"), text(f, "kept").alias("kept")))
        for f in rest
    ]
    lone = F.when(~both, F.struct(F.lit(ROW).alias("column"), F.to_json("made").alias("made"), F.to_json("kept").alias("kept")))
    return j.select("key", F.inline(F.array_compact(F.array(lone, *cells))))


def verify(made: Mapping[str, DataFrame], kept: Mapping[str, DataFrame], keys: dict[str, list[str]], tolerance: float = 0.0) -> DataFrame:
    """Differences of several tables, each row with the name of its table. Both sides have all of them."""
    out = None
    for name, k in keys.items():
        d = differences(made[name], kept[name], k, tolerance).select(F.lit(name).alias("table"), "*")
        out = d if out is None else out.unionByName(d)
    return out


def replay(
    streams: DataFrame, events: DataFrame, uncertain: DataFrame, startup: int, stride: int, root: str, keys: dict[str, list[str]] = FUSION, tolerance: float = 1e-12
) -> DataFrame:
    """A result set's tables made again from its stored scores, thresholds and weights - nothing is fitted
    - against those below ``root``. ``keys``: ``FUSION``, or ``BASELINE`` for the sets of one modality."""
    spark: SparkSession = streams.sparkSession
    made = R.build_tables(streams, events, uncertain, startup, stride)
    return verify(made, {name: spark.read.parquet(f"{root}/{name}") for name in keys}, keys, tolerance)

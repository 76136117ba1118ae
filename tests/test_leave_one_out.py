"""Folds that leave one item out, as arrays and as texts."""

import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from brontide.operators import timeline as T
from brontide.plans import catalog

SCHEMA = "grp int, item string"


def plain(data):
    groups = defaultdict(set)
    for g, i in data:
        groups[g].add(i)
    return {(g, i): (k, [x for x in sorted(s) if x != i]) for g, s in groups.items() for k, i in enumerate(sorted(s))}


@pytest.mark.parametrize("separator", ["|", "é, ", ""])
def test_texts_and_arrays(spark, monkeypatch, separator):
    monkeypatch.setattr(T, "PIECE_ROWS", 7)
    rng = random.Random(2)
    data = [(rng.choice([0, 1, 2]), rng.choice(["a", "ü", "x|y", "日本"]) * rng.randrange(1, 4) + str(rng.randrange(40))) for _ in range(300)] + [(5, "alone")]
    d, want = spark.createDataFrame(data, SCHEMA), plain(data)
    arrays = {(r.grp, r.test): (r.fold, r.train) for r in T.leave_one_out(d, "grp", "item").collect()}
    texts = {(r.grp, r.test): (r.fold, r.train) for r in T.leave_one_out(d, "grp", "item", separator).collect()}
    assert arrays == want
    assert texts == {k: (n, separator.join(others) if others else None) for k, (n, others) in want.items()}


def test_a_group_has_many_tasks(spark):
    """One task made all rows of a group before."""
    d = spark.range(3000).select(F.lit(1).alias("grp"), F.col("id").cast("string").alias("item"))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        out = T.leave_one_out(d, "grp", "item", "|").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert sum(r["count"] for r in out) == 3000 and len(out) > 2 and max(r["count"] for r in out) < 2000


def test_lone_and_missing_recordings_as_in_sql(spark, tmp_path):
    """A group of one recording has no others, and a missing one stands alone: SQL has null for both."""
    con = duckdb.connect()
    con.execute(
        f"COPY (SELECT * REPLACE (CASE WHEN user_id IN (1, 2, 7) THEN user_id END AS user_id) FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet'"
    )
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    rel = con.sql(catalog.ORACLE["q36_folds_loro"])
    want = sorted((tuple(r) for r in rel.fetchall()), key=repr)
    got = catalog.QUERIES["q36_folds_loro"](spark, str(tmp_path)).select(*rel.columns)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and len(want) == 4

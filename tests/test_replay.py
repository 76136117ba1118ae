"""Replay of tables: one changed cell is found and named; equal tables are not shuffled."""

import json
import random

import pytest
from pyspark.sql import functions as F

from brontide.operators import fusion as U
from brontide.operators import results as R
from brontide.sources import replay as Y

SCHEMA = "rec int, id string, x double, tags array<int>, m map<string,int>, flag boolean"


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = [(i % 9, f"e{i}", rng.choice([None, float("nan"), rng.random()]), [i, i + 1] if i % 3 else None, {"b": i, "a": 1}, i % 2 == 0) for i in range(500)]
    return spark.createDataFrame(rows + [rows[0], (None, None, 1.0, [], {}, None)], SCHEMA).cache()


def diff(a, b, **k):
    return sorted((tuple(json.loads(r.key).values()), r.column, r.made, r.kept) for r in Y.differences(a, b, ["rec", "id"], **k).collect())


def test_equal_tables_cost_a_scan(spark, table, monkeypatch):
    again = table.repartition(7).sort(F.desc("id")).select("m", "flag", "tags", "x", "id", "rec")
    assert diff(table, again) == []
    plan = Y.fingerprints(table, ["rec", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("column,value", [("x", "0.5D"), ("tags", "array(7)"), ("m", "map('a', 2)"), ("flag", "cast(null as boolean)")])
def test_a_changed_cell_is_named(table, column, value):
    changed = table.withColumn(column, F.when(F.col("id") == "e77", F.expr(value)).otherwise(F.col(column)))
    got = diff(changed, table)
    assert [(k, c) for k, c, _, _ in got] == [((5, "e77"), column)]


def test_rows_of_one_side(table):
    assert [(k[1], c, made is None, kept is None) for k, c, made, kept in diff(table.where("id <> 'e9' OR id IS NULL"), table)] == [("e9", "(row)", True, False)]
    assert [c for _, c, _, _ in diff(table.dropDuplicates(["rec", "id"]), table)] == ["(row)"]  # e0 came twice
    assert [c for _, c, _, _ in diff(table, table.where("id IS NOT NULL"))] == ["(row)"]
    near = table.withColumn("x", F.col("x") + 1e-13)
    assert diff(near, table, tolerance=1e-12) == [] and len(diff(near, table)) > 100
    with pytest.raises(ValueError):
        diff(table.drop("x"), table)


def test_result_sets_are_replayed(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for rec in range(6):
        for i in range(40):
            one, two = rng.random(), rng.choice([None, rng.random()])
            for m, a in zip(R.MODELS, (0.0, 0.5, 0.25, None), strict=True):
                s = one if two is None or not a else (1 - a) * one + a * two
                rows.append((rec % 2, rec, 10 * i + 10, 420, m, s, 0.7, True, two is not None, a, int(i % 9 == 4)))
    streams = spark.createDataFrame(
        rows, "grp bigint, rec bigint, t bigint, duration bigint, model string, score double, threshold double, available boolean, q boolean, alpha double, label int"
    )
    events = spark.createDataFrame([(r, f"{r}-{s}", s, s + 25) for r in range(6) for s in (50, 200, 330)], "rec bigint, event_id string, start bigint, end bigint")
    unsure = spark.createDataFrame([(1, 100, 120)], "rec bigint, start bigint, end bigint")
    made = R.build_tables(streams, events, unsure, 10, 10)
    assert set(made) == set(Y.FUSION)
    for name in made:
        made[name].write.parquet(str(tmp_path / name))
    assert Y.replay(streams, events, unsure, 10, 10, str(tmp_path)).isEmpty()
    bad = spark.read.parquet(str(tmp_path / "pooled_metrics")).withColumn("missed", F.when(F.col("model") == "F2", 99).otherwise(F.col("missed")).cast("bigint"))
    bad.write.parquet(str(tmp_path / "bad" / "pooled_metrics"))
    for name in Y.BASELINE:
        if name != "pooled_metrics":
            made[name].write.parquet(str(tmp_path / "bad" / name))
    got = Y.replay(streams, events, unsure, 10, 10, str(tmp_path / "bad"), Y.BASELINE).collect()
    assert [(r.table, json.loads(r.key), r.column, r.kept) for r in got] == [("pooled_metrics", {"model": "F2"}, "missed", "99")]


def test_models_on_one_timeline(spark, monkeypatch):
    """Tables from one row a decision are those from one row a decision and model, and store no row a model."""
    rng = random.Random(8)
    rows, wide = [], []
    for rec in range(6):
        for i in range(40):
            if rng.random() < 0.05:
                continue
            one, two, seen = rng.choice([None, rng.random(), rng.random()]), rng.choice([None, rng.random()]), rng.random() < 0.9
            same = (rec % 2, rec, 10 * i + 10, 420, seen, two is not None, int(i % 9 == 4))
            each = [(one if one is None or two is None or not a else (1 - a) * one + a * two, 0.6 + 0.1 * k, a) for k, a in enumerate((0.0, 0.5, 0.25, None))]
            rows += [(*same, m, *x) for m, x in zip(R.MODELS, each, strict=True)]
            wide.append((*same, *each))
    shared = "grp bigint, rec bigint, t bigint, duration bigint, available boolean, q boolean, label int"
    streams = spark.createDataFrame(rows, f"{shared}, model string, score double, threshold double, alpha double")
    decisions = spark.createDataFrame(wide, f"{shared}, " + ", ".join(f"{m} struct<score: double, threshold: double, alpha: double>" for m in R.MODELS))
    events = spark.createDataFrame([(r, f"{r}-{s}", s, s + 25) for r in range(6) for s in (50, 200, 330)], "rec bigint, event_id string, start bigint, end bigint")
    unsure = spark.createDataFrame([(1, 100, 120), (4, 45, 60)], "rec bigint, start bigint, end bigint")
    names = ("alarms", "event_matches", "evaluation_exposure", "fold_metrics", "pooled_metrics", "ecg_contribution_patients")
    canon = lambda d: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r.asDict().values()]) for r in d.select(sorted(d.columns)).collect())
    made = R.build_tables(streams, events, unsure, 10, 10)
    want, kept, plain = {name: canon(made[name]) for name in names}, {}, R.stored

    def spy(df, name):
        kept[name] = plain(df, name)
        return kept[name]

    monkeypatch.setattr(R, "stored", spy)
    got = R.aligned_tables(decisions, events, unsure, 10, 10)
    assert set(got) == set(made)
    for name in names:
        assert canon(got[name]) == want[name], name
    assert want["alarms"] and kept["decisions"].count() == len(wide) and "streams" not in kept


def test_availability_by_modality(spark):
    d = spark.createDataFrame([(1, True, 0.5)], "t int, available boolean, score double")
    two = U.specific(d, "2")
    assert two.columns == ["t", "available2", "score2"] and U.generic(two.withColumn("score", F.lit(0)), "2").columns == d.columns
    with pytest.raises(ValueError):
        U.generic(d, "2")

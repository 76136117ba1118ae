"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from brontide.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize(
    "name",
    [
        "q01_alarm_eval", "q08_time_budget", "q09_timeline_labels", "q11_threshold_sweep", "q12_threshold_choice", "q14_fusion_select_protected",
        "q17_event_fates", "q27_channel_time_features", "q34_clock_parse", "q34b_clock_candidates", "q53_fusion_candidates", "q54_result_metrics",
        "q55_paired_comparison", "q56_event_comparison", "q58_contribution_patients", "q59_model_means", "q41_detection_groups",
        "q60_false_alarm_state", "q61_patient_summary", "q62_sanity_sample", "q66_distinct_values", "q16_paired_levels", "q19_asof_state",
        "q21_average_precision_auc", "q24_rhythm_features", "q25_relative_reference", "q26_lead_choice", "q29_channel_correlation", "q32_coverage",
        "q36_folds_loro", "q39_anti_missing", "q43_negative_controls", "q44_onset_state", "q45_reconcile_scores", "q46_table_differences",
        "q47_interval_reference", "q51_inventory", "q52_annotation_flags", "q68_annotation_blocks", "q69_lenient_blocks", "q70_event_table",
        "q71_clipped_uncertain", "q72_channel_map", "q73_channel_indices", "q74_agreed_channels", "q75_checksums", "q76_resumed_table",
        "q77_scaled_rows", "q78_group_audit", "q79_older_rhythm", "q80_chunk_windows"
    ]
)
def test_equal_to_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rel = con.sql(catalog.ORACLE[name])
    assert sorted(rel.columns) == names
    want = sorted((tuple(canon(r[rel.columns.index(n)]) for n in names) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(canon(r[n]) for n in names) for r in df.collect()), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_held_out_rows_do_not_matter(spark):
    """Changing the held-out group changes neither scaler nor model."""
    from pyspark.sql import functions as F

    from brontide.operators import models as N

    rows = [(g, float(i % 7 + 3 * (i % 2)), i % 2, True, True) for g in range(3) for i in range(40)]
    d = spark.createDataFrame(rows, "grp int, eeg__one double, label int, available boolean, training_eligible boolean")
    a = N.HeldOutModels(d, "grp", ["eeg__one"]).fit([1, 2], [0])
    b = N.HeldOutModels(
        d.withColumn("eeg__one", F.when(F.col("grp") == 0, F.lit(1e6)).otherwise(F.col("eeg__one"))), "grp", ["eeg__one"]
    ).fit([1, 2], [0])
    assert a[0] == b[0] and a[1].coefficients == b[1].coefficients
    with pytest.raises(ValueError):
        N.HeldOutModels(d, "grp", ["eeg__one"]).fit([0, 1], [0])
    inner = N.HeldOutModels(d, "grp", ["eeg__one"]).inner([0, 1, 2], 0)
    assert {(r.grp, r.held) for r in inner.select("grp", "held").distinct().collect()} == {(1, 0), (2, 0)}
    with pytest.raises(ValueError):
        N.HeldOutModels(d, "grp", ["eeg__one"]).inner([0, 1], 0)


def test_three_models_side_by_side(spark):
    """A forest tells the classes apart by the column that holds the class, and not by the other."""
    from pyspark.sql import functions as F

    from brontide.operators import metrics as Q
    from brontide.operators import models as N

    rows = [(g, i, float(i % 5), float(3 * (i % 2) + i % 3 / 10), i % 2, True, i % 10 > 0, True) for g in range(3) for i in range(60)]
    d = spark.createDataFrame(rows, "grp int, t int, a double, b double, label int, available boolean, available2 boolean, training_eligible boolean")
    s = N.FusionModels(d, "grp", ["a"], ["b"], ["t"], numTrees=20).outer([0, 1, 2]).join(
        d.select("grp", "t", "label", "available2"), ["grp", "t"]
    ).cache()
    auc = {c: Q.score_quality(s.withColumn("score", F.col(c)), []).first().roc_auc for c in ("score_e", "score_c", "score_early")}
    assert s.count() == 180 and s.where("NOT available2 AND score_c IS NOT NULL").isEmpty()
    assert auc["score_c"] == 1.0 and auc["score_early"] > 0.95 and abs(auc["score_e"] - 0.5) < 0.2


def test_fusion_choice_tries_every_threshold(spark, monkeypatch):
    from brontide.operators import selection as S

    tried = []
    choose = S.choose
    monkeypatch.setattr(
        S, "choose", lambda c, *a, **k: tried.append({r.threshold for r in c.select("threshold").distinct().collect()}) or choose(c, *a, **k)
    )
    catalog.QUERIES["q14_fusion_select_protected"](spark, SF)
    assert tried[0] == set(S.THRESHOLDS)

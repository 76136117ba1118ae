"""Size tiers against a plain version that rewrites one pair of neighbours at a time, and the shards that come of it."""

import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from brontide.llm import sharding


def tier(size, fan):
    k = 0
    while fan ** (k + 1) <= max(size, 1):
        k += 1
    return k


def plain_plan(sizes, target, fan):
    """Places of the files, in groups."""
    done, left = [], []
    total = lambda g: sum(sizes[i] for i in g)
    for i, size in enumerate(sizes):
        if size >= sharding.FULL * target:
            done, left = [*done, *left, [i]], []
            continue
        left = [*left, [i]]
        while pairs := [p for p in range(len(left) - 1) if tier(total(left[p]), fan) <= tier(total(left[p + 1]), fan)]:
            p = pairs[-1]
            one = left[p] + left[p + 1]
            full = [n for n in range(1, len(one) + 1) if total(one[:n]) >= target]
            if full:
                done, left = [*done, *left[:p], one[: full[0]]], [g for g in (one[full[0] :], *left[p + 2 :]) if g]
            else:
                left = [*left[:p], one, *left[p + 2 :]]
    return done + left


def test_tiers_equal_the_plain_version():
    rng = random.Random(5)
    for case in range(400):
        target, fan = rng.choice([50, 1000, 128 << 20]), rng.choice([2, 3, 4, 8])
        kinds = [lambda: rng.randrange(0, target // 20 + 2), lambda: rng.randrange(0, 2 * target), lambda: fan ** rng.randrange(1, 5), lambda: target // 3]
        sizes = [rng.choice(kinds)() if case % 3 else kinds[case % 4]() for _ in range(rng.randrange(0, 60))]
        got = sharding.plan_merges([{"path": i, "bytes": s} for i, s in enumerate(sizes)], target, fan)
        assert [[f["path"] for f in g] for g in got] == plain_plan(sizes, target, fan), (sizes, target, fan)
        assert [f["path"] for g in got for f in g] == list(range(len(sizes)))
        assert all(len(g) == 1 or all(sizes[f["path"]] < sharding.FULL * target for f in g) for g in got)
        assert all(sum(f["bytes"] for f in g[:-1]) < target for g in got)


def test_rows_lie_where_the_plain_version_puts_them(spark, tmp_path):
    """Three arrivals: each row's shard and place in it follow from the files that there are before each compaction."""
    root, known = str(tmp_path), []
    for arrival in range(3):
        d = spark.range(arrival * 1000, arrival * 1000 + 230 + 170 * arrival).select(
            F.col("id").alias("doc_id"), F.expr("repeat(sha2(string(id), 256), int(1 + id % 7))").alias("text")
        )
        run = sharding.append_run(d.repartition(3 + arrival), root, run_rows=20)
        new = sharding.list_files(spark, run, d.schema)
        # Files that are there keep what they hold, whatever is merged.
        files = known + [(f["bytes"], pq.read_table(f"{root}/{f['path']}").column("doc_id").to_pylist()) for f in new]
        plan = plain_plan([b for b, _ in files], 40_000, 4)
        want = {doc: (n, i) for n, g in enumerate(plan) for i, doc in enumerate(x for k in g for x in files[k][1])}
        entry = sharding.compact(spark, run, root, d.schema, target_bytes=40_000, fan=4)
        out = sharding.read(spark, root, entry)
        assert {r.doc_id: (r[2], r[3]) for r in out.collect()} == want and out.count() == len(want)
        known = [(f["bytes"], pq.ParquetFile(f"{root}/{f['path']}").read(columns=["doc_id"]).column("doc_id").to_pylist()) for f in entry["files"]]
        assert 1 < len(known) < len(files)


def test_more_files_than_are_broadcast(spark, tmp_path, monkeypatch):
    """Where the plan is too long to be broadcast, the rows lie as they do otherwise."""
    d = spark.range(500).select(F.col("id").alias("doc_id"), F.expr("repeat(sha2(string(id), 256), int(1 + id % 7))").alias("text")).repartition(4)
    run = sharding.append_run(d, str(tmp_path / "a"), run_rows=20)
    files = sharding.plan_merges(sharding.list_files(spark, run, d.schema), 40_000, 4)
    assert any(len(g) > 1 for g in files)

    def placed():
        entry = sharding.commit(
            spark, str(tmp_path / "a"),
            {"files": sharding.merge(spark, files, str(tmp_path / "a"), d.schema), "schema": d.schema.jsonValue(), "n_shards": len(files), "target_bytes": 40_000}
        )
        out = sharding.read(spark, str(tmp_path / "a"), entry)
        plan = out._jdf.queryExecution().toString()
        return sorted((r.doc_id, r[2], r[3]) for r in out.collect()), plan

    few, plan = placed()
    assert "strategy=broadcast" in plan
    monkeypatch.setattr(sharding, "BROADCAST_FILES", 1)
    many, plan = placed()
    assert "strategy=broadcast" not in plan and many == few and len(few) == 500

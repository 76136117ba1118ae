"""Every operator and stage on awkward tables: nulls, empty and very long texts, ties, repeated
rows, no rows, and further columns named as the operators' own."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brontide.llm import (
    decontaminate, license_scan, line_dedup, minhash_dedup, mixing, periodic_runs, quality_rules, secret_scan, sharding, substring_dedup, suffix_dedup,
)

CLASHES = """did version _did _version _copy copy one doc _doc payload slot block in_block part range at key n h h1 h2 pos line set_id bands small node root
keep lines spans words windows start template license dice fp ws gs item kind bucket _row _shard_no _run_name _run_row _path _q _words _marks kept base_failed n_words""".split()

#: Functions of a table, and the columns of their results that tell rows apart.
OPERATORS = {
    "op1": lambda d: suffix_dedup.remove_repeated_bytes(d).select("doc_id", "n_bytes", F.sha2("kept", 256).alias("kept")),
    "op2": lambda d: secret_scan.scan_secrets(d).select("doc_id", F.size("spans").alias("n")),
    "op4": lambda d: mixing.schedule(d).select("did", "version", "source"),
    "op5": lambda d: minhash_dedup.near_duplicates(d).select("did", "version", "n_shingles", "component"),
    "op6": lambda d: sharding.shard(d)[0].select("doc_id", "text"),
    "op7": lambda d: line_dedup.dedup_lines(d).select("doc_id", "n_lines", "n_dropped"),
    "op8": lambda d: substring_dedup.remove_repeated_words(d).select("doc_id", "n_words", F.sha2(F.col("kept").cast("binary"), 256).alias("kept")),
    "op9": lambda d: license_scan.scan_licenses(d).select("doc_id", F.size("hits").alias("n")),
    "op12": lambda d: periodic_runs.find_runs(d).select("doc_id", "n_words", F.size("runs").alias("n"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("kept")),
    "op10": lambda d: quality_rules.judge(d).select("doc_id", "n_words", "n_dup_lines", "base_failed", "kept"),
}
PASSAGE = " ".join(f"asked{i}" for i in range(60))


@pytest.fixture(scope="module")
def plain(spark):
    long = " ".join(f"w{i * 7919 % 50021}" for i in range(60_000))  # 400 kB in one line
    notice = "Released under the MIT License"
    same = "\n".join(f"the same line of text number {i} stands here, in five documents" for i in range(3))
    rows = [
        (None, None, None, None), (None, "", "en", "a"), (1, " \n\t\n", "en", None), (2, long, "en", "a"), (2, long, "en", "a"),
        (3, long + " and more", "xx", "b"), (4, notice + "\n" + PASSAGE, "de", "b"), (5, "password = hunter2hunter", "en", "a")
    ]
    rows += [(10 + i, same, "fr", "c") for i in range(6)] + [(10, same, "fr", "d"), (10, same + " tail", "fr", "d")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


def rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(plain, clashing, name):
    of = OPERATORS[name]
    got = rows(of(plain))
    assert sum(got.values()) == plain.count()
    assert rows(of(clashing)) == got
    assert of(plain.limit(0)).count() == 0


def test_decontamination(spark, plain, clashing):
    bench = spark.createDataFrame(
        [(0, PASSAGE), (0, PASSAGE), (1, None), (2, ""), (None, "asked1 asked2 asked3 asked4 asked5 asked6 asked7")], "item_id bigint, text string"
    )
    got = rows(decontaminate.find_passages(plain, bench).select("did", "item_id", "similarity"))
    assert got == {(4, 0, 1.0): 1, (4, None, 1.0): 1} and rows(
        decontaminate.find_passages(clashing, bench.withColumn("did", F.lit(1))).select("did", "item_id", "similarity")
    ) == got
    assert decontaminate.find_passages(plain.limit(0), bench).count() == decontaminate.find_passages(plain, bench.limit(0)).count() == 0


def test_known_answers(plain):
    n = {r.doc_id: r.n for r in OPERATORS["op9"](plain).collect()}
    assert n[4] == 1 and n[2] == 0
    assert [r.n for r in OPERATORS["op2"](plain).where("doc_id = 5").collect()] == [1]
    dropped = {(r.doc_id, r.n_lines): r.n_dropped for r in OPERATORS["op7"](plain).collect()}
    assert dropped[15, 3] == 0 and dropped[11, 3] == 3
    assert {r.doc_id: r.n_words for r in OPERATORS["op10"](plain).collect()}[2] == 60_000


def test_licence_behind_many_words(spark):
    d = spark.createDataFrame([(1, "word " * 600_000 + "Released under the MIT License")], "doc_id bigint, text string")
    assert [(r.start, len(r.license) > 0) for r in license_scan.find_notices(d).collect()] == [(600_000, True)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns(spark, plain, clashing, tmp_path, name, stage):
    spark.createDataFrame([(0, PASSAGE)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = stage(spark, clashing, str(tmp_path))
    assert out.columns == clashing.columns and not rows(out) - rows(clashing)
    assert rows(out.select("doc_id", "text")) == rows(stage(spark, plain, str(tmp_path)).select("doc_id", "text"))
    assert stage(spark, clashing.limit(0), str(tmp_path)).count() == 0


def test_last_stage(spark, clashing, tmp_path):
    clashing.write.parquet(str(tmp_path / "d"))
    out = corpus_pipeline.shards(spark, spark.read.parquet(str(tmp_path / "d")), "")
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in clashing.collect()) and out.columns == ["doc_id", "shard", "row_in_shard"]

"""The whole pipeline against a plain version: SQL and loops, stage by stage."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brontide.llm import decontaminate, minhash_dedup, mixing, quality_rules

LOW = minhash_dedup.NO_ID


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(900)]
    words = lambda n: [
        rng.choice(vocab) if rng.random() < 0.7 else rng.choice("the of and to a in is that it for was on with as be".split()) for _ in range(n)
    ]
    items = [words(rng.randrange(20, 60)) for _ in range(12)]
    rows = [(None, None, "en", None), (None, " ".join(words(90)), "en", "src0"), (1, "", "en", "src1"), (2, "$#% " * 200, "en", "src1")]
    for i in range(10, 170):
        w = words(rng.randrange(30, 200))
        if i % 9 == 0:
            w[5:5] = items[i % 12]
        if i % 10 == 0:
            w[9:9] = items[i % 11][:-2]
        rows.append((i, " ".join(w), rng.choice(["en", "de", None]), f"src{i % 6}"))
        if i % 7 == 0:
            near = list(w)
            near[len(w) // 2] = "changed"
            rows.append((i + 1000, " ".join(near), "en", "src2"))
            rows += [(i + 2000, " ".join(w), "en", "src3")] * 2
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(
        [(d, t, g, s, len(t or "")) for d, t, g, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint"
    ).repartition(4).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(
        [(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string"
    ).write.parquet(str(path / "benchmark.parquet"))
    return path


def key(row):
    return (LOW if row[0] is None else row[0], row[1] or "", row[3])


def plain(folder):
    """The documents that each of the first three stages keeps."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{folder}/benchmark.parquet/*.parquet'")
    docs = con.sql(f"SELECT doc_id, text, lang, source FROM '{folder}/documents.parquet/*.parquet'").fetchall()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, g) for i, (_, t, g, _) in enumerate(docs)])
    kept = {i for i, ok in con.sql(f"SELECT doc_id, kept FROM ({quality_rules.op10_sql()})").fetchall() if ok}
    quality = [d for i, d in enumerate(docs) if i in kept]

    def shingles(text):
        w = re.findall("[^ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(d[1]) for d in quality]
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    by_group = {}
    for g, d in zip(group, quality, strict=True):
        by_group.setdefault(g, []).append(d)
    near = [min(ds, key=lambda d: key(d)[0]) for ds in by_group.values()]  # no group of this table has two texts with its least id

    clean = []
    items = [re.findall(r"\w+", t.lower()) for (t,) in con.sql("SELECT text FROM benchmark").fetchall()]
    for d in near:
        w = re.findall(r"\w+", (d[1] or "").lower())
        if not any(similar(item, w[s : s + len(item)]) >= 0.8 for item in items for s in range(max(1, len(w) - len(item) + 1))):
            clean.append(d)
    return [Counter(map(key, x)) for x in (quality, near, clean)]


def similar(a, b, k=5):
    x, y = (Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (a, b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_run_equals_a_plain_version(spark, folder):
    want = plain(folder)
    docs, got = spark.read.parquet(str(folder / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.store(stage(spark, docs, str(folder)), f"test-{name}")
        got.append(Counter(key(tuple(r)) for r in docs.select("doc_id", "text", "lang", "source").collect()))
    assert got == want and sum(want[0].values()) > sum(want[1].values()) > sum(want[2].values()) > 50
    out = corpus_pipeline.run(spark, str(folder)).orderBy("shard", "row_in_shard").collect()
    assert Counter(
        LOW if r.doc_id is None else r.doc_id for r in out
    ) == Counter({k[0]: 0 for k in want[2]}) + Counter(k[0] for k in want[2].elements())
    # The shards follow the schedule of what was left.
    slots = mixing.schedule(docs, mixing.TARGETS, mixing.DEFAULT)
    order = [None if r.did == LOW else r.did for r in slots.orderBy("slot", "source", "in_block").collect()]
    assert [r.doc_id for r in out] == order


def test_contaminated_rows_are_those_found(spark, folder):
    docs, bench = (spark.read.parquet(str(folder / f"{t}.parquet")) for t in ("documents", "benchmark"))
    left = corpus_pipeline.decontamination(spark, docs, str(folder))
    found = decontaminate.contaminated(docs, bench)
    assert left.count() + docs.join(found.select(F.col("did").alias("doc_id")).distinct(), "doc_id").count() == docs.count()

"""Operators 11 to 13: brute force, DuckDB twins of awkward rows, and held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brontide.llm import periodic_runs, toxicity, vector_codes


def slow_runs(w, least=24, times=3):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i - q, j - i + q), q)
            i = max(i + 1, j)
    return sorted((s, n, q) for (s, n), q in out.items())


def repetitive(rng, letters, most):
    w = []
    while len(w) < rng.randrange(1, most):
        w += [rng.randrange(letters) for _ in range(rng.randrange(1, 40))] * rng.choice([1, 1, 3, 4, 5])
        if w and rng.random() < 0.3:
            w += w[-rng.randrange(1, len(w) + 1) :] * rng.choice([1, 2, 3])
    return w[: 2 * most]


def test_runs_of_lists():
    rng = random.Random(3)
    for _ in range(400):
        w = repetitive(rng, rng.choice([1, 2, 3, 12]), 250)
        assert periodic_runs.runs_of(w) == slow_runs(w)
    assert periodic_runs.runs_of([]) == [] and periodic_runs.runs_of([1] * 23) == []
    assert periodic_runs.runs_of(list("ab") * 30_000) == [(0, 60_000, 2)]


def test_stretches_hold_every_run():
    rng = random.Random(4)
    docs = [repetitive(rng, 6, 200) for _ in range(40)] + [[], [1], list(range(100))]
    units = np.array([x * 2654435761 % 2**64 for d in docs for x in d], np.uint64)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    base = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    first, last = periodic_runs.stretches(units, doc)
    assert (doc[first] == doc[last]).all()
    for i, d in enumerate(docs):
        for s, n, _ in slow_runs(d):
            assert any(a <= base[i] + s and base[i] + s + n - 1 <= b for a, b in zip(first, last, strict=True))


def digest(doc_id, text):
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if x]
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = slow_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        sha(" ".join(x for i, x in enumerate(w) if i not in gone))
    )


def test_periodic_runs(spark, tmp_path):
    rng = random.Random(9)
    rows = [(None, None), (None, "a " * 50), (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "é b  " * 40), (5, "é b  " * 40), (6, "x y\x0bz\r\n" * 9)]
    rows += [(i, " ".join(map(str, repetitive(rng, rng.choice([2, 5, 500]), 300)))) for i in range(100, 220)]
    rows.append((38, " ".join(str(i * i % 7919) for i in range(40_000))))
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("runs", F.lit(1))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(map(tuple, periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()))
    assert got == Counter(digest(*r) for r in rows if r[0] != 38) + Counter([r for r in got if r[0] == 38])
    with pytest.raises(ValueError):
        periodic_runs.find_runs(d, min_length=10)


def test_looped_long_text(spark):
    """A long text that goes round: 40,000 words, checked from its own definition."""
    n = 40_000
    i = next(i for i in range(10_000) if zlib.crc32(str(i).encode()) % 10 == 0 and zlib.crc32(str(i).encode()) // 10 % n < n // 2)
    g = zlib.crc32(str(i).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    d = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(n)))], "doc_id bigint, text string")
    r = periodic_runs.find_runs(periodic_runs.looped(d)).first()
    assert r.n_words == n and [tuple(x) for x in r.runs] == ([(a, n - a, p)] if n - a >= 3 * p else [])


def slow_codes(rows, parts=16, entries=64, rounds=2):
    """Every entry tried for every part, in Python's own integers."""
    kept = sorted(
        (i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)
    )
    w = len(kept[0][1]) // parts
    cut = lambda v: [v[p * w : p * w + w] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        codes = [[near(p, x)[1] for p, x in enumerate(cut(v))] for _, v, _ in kept]
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [cut(v)[p] for (_, v, _), c in zip(kept, codes, strict=True) if c[p] == j]
                if mine:
                    books[p] = [*books[p][:j], [sum(x) // len(mine) for x in zip(*mine, strict=True)], *books[p][j + 1 :]]
    out = []
    for i, v, label in kept:
        best = [near(p, x) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), label))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("n", [150, 10])
def test_vector_codes(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(1000 - i, [float(np.float32(rng.choice([0.0, 0.5, rng.gauss(0, 1)]))) for _ in range(32)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(2000 + i, rows[3][1], 1) for i in range(20)]
    bad = [(1, None, 1), (2, [None] * 32, 1), (3, [float("nan")] * 32, 1), (4, [1.0] * 31 + [float("-inf")], None), (5, [1.0] * 7, 1), (6, [], 1), (7, [9e9] * 32, 1)]
    spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, label int").withColumn("codes", F.lit(1)).repartition(3).write.parquet(
        str(tmp_path / "embeddings.parquet")
    )
    want, books = slow_codes(rows)
    total = Counter()
    for _, _, e, label in want:
        total[label] += e
    got = vector_codes.op13_vector_codes(spark, str(tmp_path)).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == Counter((i, c, e, total[y], books) for i, c, e, y in want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet' WHERE len(embedding) = 32 AND vec_id > 7")
    assert Counter(con.execute(vector_codes.OP13_SQL).fetchall()) == Counter(map(tuple, got))


def test_search_reads_fewer_entries_than_there_are():
    rng = np.random.default_rng(2)
    books, x = rng.integers(-200, 200, (4, 64, 4)), rng.integers(-200, 200, (500, 16))
    search = vector_codes.Search(books)
    codes, least = search(x, np.zeros((500, 4), np.uint8))
    d = ((x.reshape(500, 4, 1, 4) - books[None]) ** 2).sum(3)
    assert (codes == d.argmin(2)).all() and (least == d.min(2)).all()
    again = search(x, codes)
    assert (again[0] == codes).all()
    row = np.arange(4) * 64 + codes
    assert (search.apart[row] <= 4 * least[:, :, None]).sum(2).mean() < 32


def test_no_vectors(spark, tmp_path):
    spark.createDataFrame([(1, None, 1)], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = vector_codes.op13_vector_codes(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    rude = ["blargh", "zorkish", "quembling"]
    rows = []
    for i in range(900):
        w = [rng.choice(vocab) for _ in range(rng.randrange(20, 200))]
        y = int(i % 8 == 0)
        for _ in range(3 * y + y * rng.randrange(5)):
            w[rng.randrange(len(w))] = rng.choice(rude) + rng.choice(["", "ed", "!"])
        rows.append((i, " ".join(w), y))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")


def test_toxicity(spark, labelled, tmp_path):
    extra = [(None, None), (None, "blargh you"), (5000, ""), (5001, " \n"), (5002, "bl@rgh z0rkish quembling you b.l.a.r.g.h " * 4), (5003, "word " * 60_000), (7, "x"), (7, "x")]
    labels = labelled.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (3, None), (4, 7), (99999, 1)], "doc_id bigint, toxic int"))
    labels.withColumn("quality", F.lit(1)).write.parquet(str(tmp_path / "labels.parquet"))
    docs = labelled.drop("toxic").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    docs.withColumns({"score": F.lit("s"), "fold": F.lit(9), "label": F.lit(2), "features": F.lit(1)}).write.parquet(str(tmp_path / "documents.parquet"))
    out = toxicity.op11_toxicity(spark, str(tmp_path)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    truth = {r.doc_id: r.toxic for r in labelled.collect()}
    score = {r.doc_id: r.score for r in out}
    held = [(score[i], y) for i, y in truth.items() if zlib.crc32(str(i).encode()) % 5 == 0 and i != 7]
    assert min(s for s, y in held if y) > max(s for s, y in held if not y)
    assert score[5002] >= 0.5 and max(score[5000], score[5001], score[5003]) < 0.5


def test_labels_of_held_out_rows_are_not_read(spark, labelled):
    docs, turned = labelled.drop("toxic"), labelled.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    rows = lambda t: sorted(map(tuple, toxicity.sample_rows(docs, t.select("doc_id", "toxic")).collect()))
    assert rows(labelled) == rows(turned) and len(rows(labelled)) < 900
    assert toxicity.sample_rows(docs, labelled, size=50).count() == 50


def test_too_few_labels(spark, labelled):
    few = labelled.where("toxic = 0").limit(30).select("text", "toxic", F.lit(0).alias("fold"))
    model = toxicity.train(few)
    assert [r.score for r in model.scored(labelled.select("doc_id", "text").limit(3)).collect()] == [0.0] * 3
    assert toxicity.train(few.limit(0)).share == 0.0


def test_words_in_disguise():
    assert [toxicity.plain(w) for w in ("idiot", "$$idiot!!", "1d10t", "i.d.i.o.t", "2024", "...", "it's")] == [
        ("idiot", False), ("idiot", False), ("idiot", True), ("idiot", True), ("2024", False), ("", False), ("its", True)
    ]

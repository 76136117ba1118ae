"""Operator 8: removal of long word sequences that an earlier document holds.

De Bruijn graph over token k-mers, sparse: of the k-mers of each window the one of least
hash stands for it, so that equal windows always have a k-mer in common. Successive k-mers
of a document are joined by an edge. k-mers that two documents hold are nodes; where a node
has one successor and that has one predecessor the path does not branch, and pointer
doubling through joins compacts such paths. Each document's passage along a path is one
record of source coordinates; the records of a path meet in one bucket, where all windows in
them are compared word by word (by 64-bit word hash), which verifies the repeated spans and
tells the least document of each.

Words are the longest runs of characters other than \\x20 and \\x09-\\x0D, unchanged. A null
or empty text has no words; texts of any length are read whole. Rows with the same doc_id
(null counts as an id before all others), repeated rows among them, do not remove each
other's words. Each input row gives one output row; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _repeats as R
from ._shared import WordHashes, store

EDGES = "u bigint, v bigint, part int, least bigint, most bigint"
OUT = "doc_id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, kept string"


def _tokens(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    hashes = WordHashes()
    words = [t.split() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    units = np.concatenate([hashes.of(w) for w in words]) if words else np.zeros(0, np.uint64)
    return words, bounds, units


def _edges(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.large_binary())
            for a in range(0, batch.num_rows, 512):
                did = np.array([R.NO_ID if x is None else x for x in batch.column("doc_id").slice(a, 512).to_pylist()], np.int64)
                part = np.array(batch.column("part").slice(a, 512).to_pylist(), np.int64)
                _, bounds, units = _tokens([x or b"" for x in text.slice(a, 512).to_pylist()])
                _, _, doc, u = R.owned_runs(units, bounds, window, k)
                if not len(u):
                    continue
                v = np.zeros(len(u), np.uint64)
                v[:-1] = np.where(doc[1:] == doc[:-1], u[1:], np.uint64(0))
                order = np.lexsort((did[doc], part[doc], v, u))
                u, v, p, d = u[order], v[order], part[doc][order], did[doc][order]
                new = np.ones(len(u), bool)
                new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (p[1:] != p[:-1])
                at = np.flatnonzero(new)
                last = np.append(at[1:] - 1, len(u) - 1)
                yield pa.record_batch(
                    {
                        "u": pa.array(u[at].view(np.int64)), "v": pa.array(v[at].view(np.int64)), "part": pa.array(p[at].astype(np.int32)),
                        "least": pa.array(d[at]), "most": pa.array(d[last])
                    }
                )

    return run


def compact_paths(nodes: DataFrame) -> DataFrame:
    """``nodes``: node, pred (itself at the head of a path). Back: node, path (the head). Nodes on
    a ring, which has no head, stay paths of their own."""
    p = store(nodes.select("node", F.col("pred").alias("path")), "paths")
    open_before = -1
    while True:
        up = p.select(F.col("node").alias("path"), F.col("path").alias("next"))
        p = store(p.join(up, "path").select("node", F.col("next").alias("path"), (F.col("next") != F.col("path")).alias("open")), "paths")
        still = p.where("open").count()
        if still in (0, open_before):
            return p.select("node", F.when(F.col("open"), F.col("node")).otherwise(F.col("path")).alias("path"))
        open_before = still
        p = p.drop("open")


def repeated_paths(edges: DataFrame) -> DataFrame:
    """(node, path) of all k-mers that more than one document holds."""
    out = edges.groupBy("u").agg(
        F.min("least").alias("lo"), F.max("most").alias("hi"), F.min("v").alias("v1"), F.max("v").alias("v2")
    ).where("lo <> hi")
    into = edges.where("v <> 0").groupBy("v").agg(F.min("u").alias("u1"), F.max("u").alias("u2")).where("u1 = u2")
    nodes = store(
        out.select(
            F.col("u").alias("node"),
            F.when((F.col("v1") == F.col("v2")) & (F.col("v1") != 0) & (F.col("v1") != F.col("u")), F.col("v1")).alias("next")
        ),
        "nodes"
    )
    single = nodes.where("next IS NOT NULL").join(into.select(F.col("v").alias("next"), F.col("u1").alias("node")), ["next", "node"])
    preds = single.select(F.col("next").alias("node"), F.col("node").alias("pred"))
    return compact_paths(nodes.select("node").join(preds, "node", "left").select("node", F.coalesce("pred", "node").alias("pred")))


def remove_repeated_words(docs: DataFrame, window: int = 50, k: int = 26, part_bytes: int = 3 << 20, bucket_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, removed spans (word numbers, end exclusive), kept words joined by one blank; for each row of ``docs``."""
    d, n, total = R.deal(docs, part_bytes)
    buckets = max(1, total // 2 // bucket_bytes)
    scanned = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = scanned.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    edges = store(scanned.mapInArrow(_edges(window, k), EDGES), "kmers")
    replies = edges.select(F.col("u").alias("node"), "part").distinct().join(repeated_paths(edges), "node").repartition(n, "part")

    def records(table, paths):
        did, texts, ids = R.read_part(table)
        words, bounds, units = _tokens(texts)
        lo, hi, doc, key = R.owned_runs(units, bounds, window, k)
        node = np.asarray(paths.column("node").to_numpy()).view(np.uint64)
        path = np.asarray(paths.column("path").to_numpy()).view(np.uint64)
        order = np.argsort(node)
        node, path = node[order], path[order]
        at = np.minimum(np.searchsorted(node, key), max(0, len(node) - 1))
        use = node[at] == key if len(node) else np.zeros(len(key), bool)
        lo, hi, doc, path = lo[use], hi[use], doc[use], path[at[use]] if len(node) else key[use]
        first = np.ones(len(lo), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (path[1:] != path[:-1]) | (lo[1:] != hi[:-1] + 1)
        begin = np.flatnonzero(first)
        last = np.append(begin[1:] - 1, len(lo) - 1)[: len(begin)]
        lo, hi, dids = lo[begin], hi[last], did[doc[begin]]
        return ids, words, bounds, units, lo, hi, dids, R.Phrases(units, lo, hi, dids, R.mix(path[begin]), buckets, window)

    def ask(key, left, right):
        return records(left, right)[-1].ask(key[0].as_py())

    def resolve(key, left, right):
        paths = right.filter(pa.compute.equal(right.column("round"), 0))
        ids, words, bounds, units, lo, hi, dids, p = records(left, paths)
        earlier = p.earlier(R.read_bits(right, 2))
        n_windows = hi - lo + 1
        gone = earlier[R.ragged(p.first[p.which], n_windows)] | np.repeat(dids > p.least[p.which], n_windows)
        mask = R.covered(len(units), R.ragged(lo, n_windows)[gone], window)
        spans, kept = [], []
        for w, i, j in zip(words, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            runs = R.runs_of(mask[i:j]).tolist()
            spans.append([{"start": a, "end": b} for a, b in runs])
            stay, at = [], 0
            for a, b in runs:
                stay += w[at:a]
                at = b
            kept.append(b" ".join(stay + w[at:] if runs else w))
        R.release()
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(np.diff(bounds), pa.int64()), "spans": pa.array(spans, span),
                "kept": pa.array(kept, pa.binary()).cast(pa.string())
            }
        )

    asked = d.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(ask, R.PHRASE_ASK)
    answers = asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: R.answer_phrases(t, window, np.uint64), R.REPLY)
    told = replies.select(
        "part", F.lit(0).alias("round"), "node", "path", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("bits")
    )
    told = told.unionByName(
        answers.select("part", "round", F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("bigint").alias("path"), "bucket", "bits")
    ).repartition(n, "part")
    return d.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(resolve, OUT)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda x: md5(array_to_string(w[x:x + 49], ' ')))) AS g FROM d WHERE len(w) > 49),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM s) WHERE m < doc_id),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
p AS (SELECT t.doc_id, t.i, t.word, coalesce(t.i - max(r.i) OVER (PARTITION BY t.doc_id ORDER BY t.i) < 50, false) AS gone FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND r.i = t.i)
SELECT d.doc_id, count(p.i) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id
"""

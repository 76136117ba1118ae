"""Operator 1: removal of long byte strings that an earlier document holds.

Prefix-free parsing. Rolling-hash triggers cut the texts into phrases; phrases whose
trigger occurs in more than one document form the dictionary; its suffixes are put in
lexicographic order (prefix doubling, as deep as the threshold), and combined with the
parse - which documents hold which phrase - this orders the repeated part of the corpus:
equal ranks are equal strings, and the least document of each is known. A trigger is here
the least hash of a window, not a hash below a bound, so that every 50-byte string holds
one; and order is computed per bucket of triggers, as equal strings share their trigger.

In place of one suffix array of all phrases there is one a bucket, cut at the threshold's
depth; and as phrases overlap by a window, the order of the parse beyond a phrase decides
nothing and is not made.

Null and empty texts have no bytes; texts of any length are read whole. Rows with the same
doc_id (null counts as an id before all others), repeated rows among them, do not remove
each other's bytes. Every input row gives one output row; an empty table gives an empty
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _repeats as R

OUT = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def _buckets(total: int, share: float, bucket_bytes: int) -> int:
    return max(1, int(total * share) // bucket_bytes)


def remove_repeated_bytes(docs: DataFrame, window: int = 50, gram: int = 24, part_bytes: int = 3 << 20, bucket_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, removed spans (byte offsets, end exclusive), kept bytes; for each row of ``docs``."""
    d, n, total = R.deal(docs, part_bytes)
    b1, b2 = _buckets(total, 0.3, bucket_bytes), _buckets(total, 1.4, bucket_bytes)

    def parsed(table):
        did, texts, ids = R.read_part(table)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        units = np.frombuffer(b"".join(texts), np.uint8)
        lo, hi, doc, key = R.owned_runs(units, bounds, window, gram)
        return did, ids, bounds, units, lo, hi, did[doc], key

    def ask_triggers(key, table):
        did, _, _, _, _, _, dids, keys = parsed(table)
        return R.gram_ask_rows(key[0].as_py(), *R.gram_question(keys, dids), b1)

    def phrases(table, replies):
        did, ids, bounds, units, lo, hi, dids, keys = parsed(table)
        asked, _ = R.gram_question(keys, dids)
        shared = R.shared_triggers(asked, b1, R.read_bits(replies, 1))
        use = shared[np.searchsorted(asked, keys)] if len(asked) else np.zeros(0, bool)
        lo, hi, dids, keys = lo[use], hi[use], dids[use], keys[use]
        return ids, bounds, units, lo, hi, dids, R.Phrases(units, lo, hi, dids, keys, b2, window)

    def ask_phrases(key, left, right):
        return phrases(left, right)[-1].ask(key[0].as_py())

    def resolve(key, left, right):
        ids, bounds, units, lo, hi, dids, p = phrases(left, right)
        earlier = p.earlier(R.read_bits(right, 2))
        n_windows = hi - lo + 1
        gone = earlier[R.ragged(p.first[p.which], n_windows)] | np.repeat(dids > p.least[p.which], n_windows)
        mask = R.covered(len(units), R.ragged(lo, n_windows)[gone], window)
        raw = units.tobytes()
        spans, kept = [], []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            m = mask[i:j]
            if m.any():
                spans.append([{"start": a, "end": b} for a, b in R.runs_of(m).tolist()])
                kept.append(units[i:j][~m].tobytes())
            else:
                spans.append([])
                kept.append(raw[i:j])
        R.release()
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(np.diff(bounds), pa.int64()), "spans": pa.array(spans, span),
                "kept": pa.array(kept, pa.binary())
            }
        )

    a1 = d.groupBy("part").applyInArrow(ask_triggers, R.GRAM_ASK).repartition(b1, "bucket").groupBy("bucket").applyInArrow(R.answer_grams, R.REPLY)
    r2 = d.groupBy("part").cogroup(a1.repartition(n, "part").groupBy("part")).applyInArrow(ask_phrases, R.PHRASE_ASK)
    a2 = r2.repartition(b2, "bucket").groupBy("bucket").applyInArrow(lambda t: R.answer_phrases(t, window, np.uint8), R.REPLY)
    replies = a1.unionByName(a2).repartition(n, "part")
    return d.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(resolve, OUT)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )

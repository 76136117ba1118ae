"""Operator 4: interleaving sources by target weights, as a Pfair schedule.

The documents of a source are put in a fixed random order and cut into blocks. The j-th
block of a source with weight w (of a total of D) is released at slot floor((j - 1) D / w)
and due at slot ceil(j D / w); of the released blocks the one due first is served. As the
weights add up to D, every deadline is met, so after any number of slots each source is less
than one block from its share. Weights are taken as they are, as exact fractions, and each
source has its own; the schedule does not repeat. A source that runs dry no
longer takes part, and the others keep their pace, so slots may stay empty; no document is
dropped or repeated.

Whole rows travel with their places: they are range-partitioned by source and key, numbered
where they lie, and dealt to slots, so that no row is looked up again and equal rows can't be
confused. The schedule is a stream of one small row a block, made by one task; the driver
sees one number a source and a range.

A null source is a source of its own (its weight is that of the key None), told apart from
sources that happen to bear the names by which results call it and the rest. Sources for which the given weights have none (or none
above zero) have no share, unless ``default`` gives them one: they are taken as one and
follow after the last slot of the others. Rows with the same doc_id, repeated ones too, are
placed separately; null texts count as empty ones, and texts of any length are one row each.
An empty table gives an empty schedule. Further columns, whatever their names, stay as they
are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import store
from .line_dedup import NO_ID

POOLED = "(other)"
NONE = "(none)"
_NAMED, _NULL, _REST = "s:", "null", "rest"
BROADCAST_ROWS = 500_000  # of up to 40 bytes: at most 20 MB; beyond, the join shuffles
#: Target weights of the registered query: some sources are wanted more than others.
TARGETS, DEFAULT = {"src0": 4.0, "src1": 3.0, "src2": 2.5, "src3": 2.0, "src4": 1.5}, 1.0


def pfair(weights: dict[str, float]) -> Iterator[tuple[str, int]]:
    """For each slot, without end, the source that it serves and the number of its block (from 0)."""
    exact = {s: Fraction(w) for s, w in sorted(weights.items())}
    scale = lcm(*(w.denominator for w in exact.values()))
    names, parts = list(exact), [int(w * scale) for w in exact.values()]
    total = sum(parts)
    future = [(0, -(-total // w), i, 0) for i, w in enumerate(parts)]
    heapq.heapify(future)
    ready: list[tuple[int, int, int]] = []
    slot = 0
    while True:
        while future and future[0][0] <= slot:
            _, due, i, j = heapq.heappop(future)
            heapq.heappush(ready, (due, i, j))
        due, i, j = heapq.heappop(ready)
        if due <= slot:
            raise ValueError("a block misses its deadline")
        yield names[i], j
        heapq.heappush(future, ((j + 1) * total // parts[i], -(-(j + 2) * total // parts[i]), i, j + 1))
        slot += 1


def places(weights: dict[str, float], blocks: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """source, block and slot of every block there is; ``blocks``: their number by source. As :func:`pfair`,
    but sources that have run dry no longer take part: each block keeps its release and deadline, and
    slots for which nothing is released are skipped, not walked over. The work is that of the blocks."""
    exact = {s: Fraction(w) for s, w in sorted(weights.items())}
    scale = lcm(*(w.denominator for w in exact.values()))
    parts = {s: int(w * scale) for s, w in exact.items()}
    total, slot = sum(parts.values()), 0
    future = [(0, -(-total // w), s, 0) for s, w in parts.items() if blocks.get(s, 0)]
    heapq.heapify(future)
    ready: list[tuple[int, str, int]] = []
    while future or ready:
        if not ready:
            slot = max(slot, future[0][0])
        while future and future[0][0] <= slot:
            _, due, s, j = heapq.heappop(future)
            heapq.heappush(ready, (due, s, j))
        due, s, j = heapq.heappop(ready)
        if due <= slot:
            raise ValueError("a block misses its deadline")
        yield s, j, slot
        if j + 1 < blocks[s]:
            heapq.heappush(future, ((j + 1) * total // parts[s], -(-(j + 2) * total // parts[s]), s, j + 1))
        slot += 1
    for s in sorted(blocks.keys() - weights.keys()):  # without a weight
        for j in range(blocks[s]):
            yield s, j, slot + j
        slot += blocks[s]


def _stream(weights: dict[str, float], blocks: dict[str, int], batch_rows: int = 1 << 16):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            rows: list[tuple] = []
            for place in places(weights, blocks):
                rows.append(place)
                if len(rows) == batch_rows:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        source, block, slot = zip(*rows, strict=True)
        return pa.record_batch({"source": pa.array(source, pa.string()), "block": pa.array(block, pa.int64()), "slot": pa.array(slot, pa.int64())})

    return run


def natural_weights(counts: dict[str, int], power: float) -> dict[str, float]:
    """Shares of the sources' numbers of documents to a power below one, which lifts small ones."""
    return {s: n**power for s, n in counts.items()}


def _placed(docs: DataFrame, payload, weights: dict[str, float] | None, default: float | None, block_rows: int, power: float, seed: int) -> DataFrame:
    """payload, source, block, in_block, slot; a row for each row of ``docs``."""
    # A source is known by a key that no name can clash with.
    weights = weights if weights is None else {_NULL if s is None else f"{_NAMED}{s}": w for s, w in weights.items()}
    given = {s: w for s, w in (weights or {}).items() if w > 0}
    source = F.coalesce(F.concat(F.lit(_NAMED), F.col("source").cast("string")), F.lit(_NULL))
    if weights is not None:
        has_share = source.isin(list(given)) if default is None else ~source.isin([s for s, w in weights.items() if w <= 0])
        source = F.when(has_share, source).otherwise(_REST)
    did, version = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    d = docs.select(
        payload.alias("payload"), source.alias("source"), did.alias("did"), version.alias("version")
    ).withColumn("key", F.xxhash64(F.lit(seed), "did", "version"))
    order = ["source", "key", "did", "version"]
    # Numbers within a source, though one task never sees all of it: rows are numbered where
    # they lie, and the counts of each range, of which there are few, give where it begins.
    lying = d.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    lying = store(
        lying.withColumns({"range": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(2**33 - 1)}).drop("key", "did", "version"), "ranges"
    )
    spans = sorted(tuple(r) for r in lying.groupBy("source", "range").agg(F.min("at").alias("first"), F.count("*").alias("n")).collect())
    counts: dict[str, int] = {}
    begins = []
    for s, part, first, n in spans:  # one a source and range: sources lie in successive ranges
        begins.append((s, part, counts.get(s, 0) - first))
        counts[s] = counts.get(s, 0) + n
    shares = natural_weights(counts, power) if weights is None else given if default is None else dict.fromkeys(counts.keys() - {_REST}, default) | given
    spark = docs.sparkSession
    shift = spark.createDataFrame(begins, "source string, range bigint, shift bigint")
    small = lambda t, n: F.broadcast(t) if n <= BROADCAST_ROWS else t
    n = F.col("at") + F.col("shift")
    numbered = lying.join(small(shift, len(begins)), ["source", "range"]).select(
        "payload", "source", F.floor(n / block_rows).alias("block"), (n % block_rows).alias("in_block")
    )
    blocks = {s: -(-k // block_rows) for s, k in counts.items()}
    at = spark.range(1).coalesce(1).mapInArrow(_stream(shares, blocks), "source string, block bigint, slot bigint")
    name = F.when(F.col("source") == _REST, POOLED).when(F.col("source") == _NULL, NONE).otherwise(F.expr(f"substr(source, {len(_NAMED) + 1})"))
    return numbered.join(small(at, sum(blocks.values())), ["source", "block"]).select(
        "payload", name.alias("source"), "block", "in_block", "slot", F.col("source").alias("lane")
    )


def schedule(
    docs: DataFrame, weights: dict[str, float] | None = None, default: float | None = None, block_rows: int = 64, power: float = 0.7, seed: int = 17
) -> DataFrame:
    """did, version (of the text), source, block, in_block, slot; a row for each row of ``docs``.
    Without weights, sources have their number of documents to ``power``."""
    keys = F.struct(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("did"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("version")
    )
    return _placed(docs, keys, weights, default, block_rows, power, seed).select("payload.*", "source", "block", "in_block", "slot")


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, default: float | None = None, block_rows: int = 64, power: float = 0.7, seed: int = 17
) -> DataFrame:
    """The rows of ``docs``, with the columns they have, in the order of the schedule: range
    partitions, and so written files, follow one another as the slots do."""
    if not docs.columns:
        return docs
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = _placed(docs, whole, weights, default, block_rows, power, seed)
    at = ["slot", "lane", "in_block"]
    return out.repartitionByRange(*at).sortWithinPartitions(*at).select(*[F.col(f"payload.`{c}`").alias(c) for c in docs.columns])


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = schedule(spark.read.parquet(f"{sf_dir}/documents.parquet"), TARGETS, DEFAULT)
    return out.select(F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), "source", "block", "in_block", "slot")

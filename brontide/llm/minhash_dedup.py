"""Operator 5: near-duplicate documents by SuperMinHash.

Per element one random permutation of the slots is drawn lazily, and its ranks, not
independent hashes, compete for the slots; drawing stops once no slot can improve, which
for all but tiny documents is after a few of the slots. Documents with equal shingle sets
form a class; one signature stands for each class. Signatures are cut into bands; in a
bucket every class is verified against one pivot. Then, in buckets that still hold classes of
different components, blocks of classes meet the others of the bucket, and a sketch of the
signatures rules out nearly all pairs before texts are compared, so no link is lost. Links are confirmed on full
shingle sets, and groups are joined by alternating large-star and small-star steps.

A document without words has an empty set and is linked with nothing. Null texts have no
words; texts of any length are read whole. A null doc_id counts as an id before all others.
Rows with the same doc_id, repeated rows among them, are separate documents here, and each
input row gives one output row. An empty table gives an empty result; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._repeats import NO_ID, mix, ragged
from ._shared import WordHashes, shingle_set, store

SLOTS, ROWS = 160, 5  # a pair at 0.85 is missed once in 10**8, one at 0.8 once in 3 * 10**5
PIVOTS = 512  # classes of a bucket in a block
_G1, _G2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures (a row a set) of non-empty sets of 64-bit hashes."""
    elem = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    sig = np.full(len(sets) * slots, np.inf)
    perm = None
    for j in range(slots):
        r = (mix(elem + np.uint64(_G1 * (2 * j + 1) % 2**64)) >> np.uint64(11)) * 2.0**-53
        k = j + (mix(elem ^ np.uint64(_G2 * (2 * j + 1) % 2**64)) >> np.uint64(33)).astype(np.int64) % (slots - j)
        if perm is None:
            slot = k
        else:
            rows = np.arange(len(elem))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(sig, owner * slots + slot, r + j)
        open_ = sig.reshape(-1, slots).max(axis=1) > j + 1
        stay = open_[owner]
        if not stay.any():
            break
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.uint8), (int(stay.sum()), 1))
            perm[np.arange(len(perm)), k[stay]] = 0
            elem, owner = elem[stay], owner[stay]
        elif stay.mean() < 0.7:
            elem, owner, perm = elem[stay], owner[stay], perm[stay]
    return sig.reshape(-1, slots)


def band_hashes(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), -1, rows)
    h = np.broadcast_to(np.arange(bits.shape[1], dtype=np.uint64), bits.shape[:2])
    for i in range(rows):
        h = mix(h * np.uint64(_G1) + bits[:, :, i])
    return h.view(np.int64)


def nibbles(sig: np.ndarray) -> np.ndarray:
    """Four bits of each slot, sixteen slots a word."""
    bits = (mix(sig.view(np.uint64)) >> np.uint64(60)).reshape(len(sig), -1, 16)
    return (bits << (4 * np.arange(16, dtype=np.uint64))).sum(axis=2, dtype=np.uint64).view(np.int64)


def _alike(a: str, b: str, slots: int, percent: int):
    """Whether two sketches agree in as many slots as sets at the threshold do, less six standard
    deviations: rules pairs out, at one miss in 10**9, before any text moves."""
    p = percent / 100 + (1 - percent / 100) / 16
    differ = None
    for i in range(slots // 16):
        x = F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        differ = F.bit_count(x) if differ is None else differ + F.bit_count(x)
    return differ <= slots * (1 - p) + 6 * (slots * p * (1 - p)) ** 0.5


def _sketch(k: int, slots: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            text = batch.column("text").cast(pa.large_binary())
            for a in range(0, batch.num_rows, 128):
                part = text.slice(a, 128).to_pylist()
                sets = [shingle_set(hashes.of((t or b"").lower().split()), k) for t in part]
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                small: list = [None] * len(sets)
                at = 0
                while at < len(full):  # bounded numbers of elements at once
                    n, to = 0, at
                    while to < len(full) and (to == at or n + len(sets[full[to]]) <= 1 << 16):
                        n += len(sets[full[to]])
                        to += 1
                    sig = superminhash([sets[i] for i in full[at:to]], slots)
                    for i, b, c in zip(full[at:to], band_hashes(sig, rows), nibbles(sig), strict=True):
                        bands[i], small[i] = b, c
                    at = to
                yield pa.record_batch({
                    "did": batch.column("did").slice(a, 128), "version": batch.column("version").slice(a, 128), "n": pa.array([len(s) for s in sets], pa.int64()),
                    "set_id": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())), "small": pa.array(small, pa.list_(pa.int64())),
                })

    return run


def _compare(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, group, pivots = WordHashes(), None, {}
        for batch in batches:
            x, ps, at, role = (batch.column(c).to_pylist() for c in ("x", "ps", "at", "role"))
            text, out = batch.column("text").cast(pa.large_binary()), []
            for i in range(batch.num_rows):
                if at[i] != group:
                    group, pivots = at[i], {}
                s = shingle_set(hashes.of(text[i].as_py().lower().split()), k)
                if role[i] == 0:
                    pivots[x[i]] = s
                    continue
                for p in ps[i]:
                    t = pivots[p]
                    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                        continue
                    small, large = (s, t) if len(s) < len(t) else (t, s)
                    common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                    if 100 * common >= percent * (len(s) + len(t) - common):
                        out.append((x[i], p))
            cols = list(zip(*out, strict=True)) if out else [[], []]
            yield pa.record_batch({"x": pa.array(cols[0], pa.binary()), "p": pa.array(cols[1], pa.binary())})

    return run


def _linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (x, p) of set ids those whose sets are alike enough. Pivots are dealt into
    blocks of some hundred; a text goes to each block in which it has a partner, once, and
    large blocks are dealt again by partner, with their pivots' texts beside each share."""
    blocks = max(1, pairs.select("p").distinct().count() // 200)
    ask = pairs.withColumn("block", F.pmod(F.xxhash64("p"), F.lit(blocks)).cast("int")).groupBy("block", "x").agg(F.collect_set("p").alias("ps"))
    shares = ask.groupBy("block").agg(F.ceil(F.count("*") / 1000).cast("int").alias("shares"))
    at = lambda share: F.struct("block", share.alias("share")).alias("at")
    members = ask.join(shares, "block").select("x", "ps", at(F.pmod(F.xxhash64("x"), F.col("shares")).cast("int")), F.lit(1).alias("role"))
    heads = ask.select("block", F.explode("ps").alias("x")).distinct().join(shares, "block").withColumn(
        "share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    )
    heads = heads.select("x", F.lit(None).cast("array<binary>").alias("ps"), at(F.col("share")), F.lit(0).alias("role"))
    dealt = members.unionByName(heads).join(texts.withColumnRenamed("set_id", "x"), "x").repartition("at").sortWithinPartitions("at", "role")
    return dealt.select("x", "ps", "at", "role", "text").mapInArrow(_compare(k, percent), "x binary, p binary").distinct()


_BLOCK_IN = ["at", "role", "turn", "did", "set_id", "n", "small", "root", "text"]
_EDGE = "a_did bigint, a_set binary, b_did bigint, b_set binary"


def _blocks(k: int, percent: int, slots: int):
    """Links between classes of a bucket that no link joins yet, block of pivots by block. Sizes and
    sketches rule pairs out before a text is cut; the rest are counted against the block's
    inverted index. Of the links of a block only those that join something come out."""
    p_slot = percent / 100 + (1 - percent / 100) / 16
    most = slots * (1 - p_slot) + 6 * (slots * p_slot * (1 - p_slot)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, group = WordHashes(), None
        for batch in batches:
            c = {x: batch.column(x).to_pylist() for x in _BLOCK_IN[:-1]}
            text, out = batch.column("text").cast(pa.large_binary()), []
            for i in range(batch.num_rows):
                if c["at"][i] != group:
                    group, heads, index, merged = c["at"][i], [], None, {}
                cut = lambda i=i: shingle_set(hashes.of(text[i].as_py().lower().split()), k)
                if c["role"][i] == 0:
                    heads.append((c["turn"][i], c["did"][i], c["set_id"][i], c["n"][i], c["small"][i], c["root"][i], cut()))
                    continue
                if index is None:
                    turns, sizes, comp = (np.array([h[j] for h in heads], np.int64) for j in (0, 3, 5))
                    small = np.array([h[4] for h in heads], np.int64)
                    values, owner = np.concatenate([h[6] for h in heads]), np.repeat(np.arange(len(heads)), sizes)
                    index = np.argsort(values)
                    values, owner = values[index], owner[index]
                mine = c["root"][i]
                while mine in merged:
                    mine = merged[mine]
                n = c["n"][i]
                may = (turns < c["turn"][i]) & (comp != mine) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
                if may.any():
                    x = (small[may] ^ np.array(c["small"][i], np.int64)).view(np.uint64)
                    x |= x >> np.uint64(1)
                    x = (x | (x >> np.uint64(2))) & np.uint64(0x1111111111111111)
                    may[may] = np.bitwise_count(x).sum(axis=1) <= most
                if not may.any():
                    continue
                s = cut()
                lo = np.searchsorted(values, s, "left")
                common = np.bincount(owner[ragged(lo, np.searchsorted(values, s, "right") - lo)], minlength=len(heads))
                for j in np.flatnonzero(may & (100 * common >= percent * (n + sizes - common))):
                    if comp[j] != mine:
                        out.append((c["did"][i], c["set_id"][i], heads[j][1], heads[j][2]))
                        merged[int(comp[j])] = mine
                        comp[comp == comp[j]] = mine
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.record_batch(
                [pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.binary()) * 2, strict=True)], names=["a_did", "a_set", "b_did", "b_set"]
            )

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, by alternating stars. ``edges``: a, b."""

    def stars(e):
        """Every node has one neighbour, and none of those has another."""
        n, nodes = e.agg(F.count("*"), F.count_distinct("a")).first()
        return n == nodes and e.join(e.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()

    def least(e, by):
        return e.join(e.groupBy(by).agg(F.min("v").alias("m")), by)

    e = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    while not stars(e):
        s = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = least(s, "u").where("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("v")).where("a != v").distinct()
        small = least(large, "a")
        small = small.select(
            F.col("v").alias("a"), F.col("m").alias("b")
        ).unionByName(small.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        e = store(small, "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, slots: int = SLOTS, rows: int = ROWS) -> DataFrame:
    """did (doc_id, or the least long for null), version, n_shingles, set_id, component (least did
    reachable), component_set (its set); a row for each row of ``docs``. Linked: 100 * intersection >= percent * union."""
    d = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("did"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    d = d.withColumn("version", F.xxhash64("text"))
    sketched = store(
        d.mapInArrow(_sketch(k, slots, rows), "did bigint, version bigint, n bigint, set_id binary, bands array<bigint>, small array<bigint>"),
        "sketches"
    )
    classes = store(
        sketched.where("n > 0").groupBy("set_id").agg(
            F.min(F.struct("did", "version")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("small").alias("small")
        ).select("set_id", F.col("rep.did").alias("did"), F.col("rep.version").alias("version"), "n", "bands", "small"),
        "classes"
    )
    node = F.struct("did", "set_id").alias("node")
    # Signatures aren't dealt by band: of a band only who has it, and only of bands that classes share.
    banded = classes.select(node, F.explode("bands").alias("h"))
    common = banded.groupBy("h").agg(F.count("*").alias("members")).where("members > 1").select("h")
    shared = store(banded.join(common, "h", "left_semi"), "shared")
    buckets = store(shared.join(shared.groupBy("h").agg(F.min("node").alias("pivot")), "h"), "buckets")
    signed = classes.select("set_id", F.struct(node, "n", "small").alias("_signed"))
    sign = lambda d, c: d.join(signed, F.col(f"{c}.set_id") == F.col("set_id")).drop("set_id", c).withColumnRenamed("_signed", c)
    wanted = buckets.select(F.col("node.set_id").alias("set_id")).distinct()
    wanted = classes.join(wanted, "set_id").select("set_id", "did", "version")
    texts = store(d.join(wanted, ["did", "version"]).select("set_id", "text"), "texts")

    def verify(pairs):
        """pairs: x and p (node, n, small); back come linked nodes (a, b)."""
        ids = store(pairs.select(F.col("x.node").alias("a"), F.col("p.node").alias("b")), "pairs")
        links = _linked(ids.select(F.col("a.set_id").alias("x"), F.col("b.set_id").alias("p")), texts, k, percent)
        return ids.join(links, (F.col("a.set_id") == F.col("x")) & (F.col("b.set_id") == F.col("p"))).select("a", "b")

    # Sizes and sketches rule most pairs out.
    close = (100 * F.least("x.n", "p.n") >= percent * F.greatest("x.n", "p.n")) & _alike("x.small", "p.small", slots, percent)
    met = buckets.where("node != pivot").select(F.col("node").alias("x"), F.col("pivot").alias("p")).distinct()
    links = store(verify(sign(sign(met, "x"), "p").where(close)), "links")
    roots = components(links)
    rest = buckets.where("node != pivot").join(roots, "node", "left").select("h", "node", F.coalesce("root", "node").alias("root"))
    mixed = rest.groupBy("h").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select("h")
    rest = rest.join(mixed, "h").withColumn("turn", F.row_number().over(W.partitionBy("h").orderBy("root", "node")) - 1)
    rest = rest.withColumn("block", F.floor(F.col("turn") / PIVOTS).cast("int")).withColumn("root", F.xxhash64("root"))
    rest = store(sign(rest, "node").select("h", "node.*", "turn", "block", "root"), "rest")
    if not rest.isEmpty():
        to = F.explode(F.sequence(F.lit(0), F.col("block")))
        x = rest.withColumn("to", to).withColumn("role", F.lit(1)).unionByName(rest.withColumn("to", F.col("block")).withColumn("role", F.lit(0)))
        x = x.select(
            F.struct("h", "to").alias("at"), "role", "turn", "node.did", "node.set_id", "n", "small", "root"
        ).join(texts, "set_id").select(*_BLOCK_IN)
        new = x.repartition("at").sortWithinPartitions("at", "role", "turn").mapInArrow(_blocks(k, percent, slots), _EDGE)
        new = new.select(
            F.struct(F.col("a_did").alias("did"), F.col("a_set").alias("set_id")).alias("a"),
            F.struct(F.col("b_did").alias("did"), F.col("b_set").alias("set_id")).alias("b")
        )
        roots = components(links.unionByName(new))
    labels = classes.select("set_id", node).join(roots, "node", "left").select("set_id", F.coalesce("root", "node").alias("_root")).select(
        "set_id", F.col("_root.did").alias("component"), F.col("_root.set_id").alias("component_set")
    )
    out = sketched.select("did", "version", F.col("n").alias("n_shingles"), "set_id").join(labels, "set_id", "left")
    return out.withColumn("component", F.coalesce("component", "did"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)
    id_of = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(
        id_of("did").alias("doc_id"), "n_shingles", id_of("component").alias("component_id"), (F.col("did") == F.col("component")).alias("kept")
    )


OP5_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingles FROM d),
n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(shingles) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_have >= 85 * (a.n + b.n - both_have)),
u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS root, doc_id AS node FROM d UNION SELECT r.root, u.y FROM r JOIN u ON u.x = r.node WHERE u.y > r.root)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id, n.doc_id = min(r.root) AS kept
FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""

"""Operator 3: benchmark passages inside documents. DataFrame functions only.

Windows of a document are as long as a benchmark item, and lie where the document holds one
of the item's anchors: shingles evenly spaced over the item, so many that an item can't lose
them all and stay similar. Anchors place windows and decide nothing. Each window gets a
128-bit SimHash of its shingles, as each item has; an index of eight 16-bit blocks, probed
with every key at most radius / 8 bits away (the items' side flips all but one of the bits,
the windows' side the last), finds for a window all items of its size whose fingerprints are
within the radius, whichever item's anchor placed it; the exact similarity of the shingles,
weighted by how often they occur, decides.

Text is lower-cased and cut into runs of letters and digits. Null texts have no words; items
and documents of fewer than ``k`` words have no shingles and match nothing; null item ids
stay, as an id. A document shorter than an item has one window, the whole of it; texts of
any length are read whole. Rows with equal doc_id and text are searched as one and each
counts in the result once, and so do repeated items; of equally good windows the first
counts. Empty tables give an empty result; further columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import store
from .line_dedup import NO_ID

BLOCKS, BLOCK_BITS = 8, 16
BROADCAST_ROWS = 500_000  # of 16 to 40 bytes: at most 20 MB; beyond, the join shuffles


def _words(text: str | Column) -> Column:
    clean = F.btrim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " ", -1))


def _shingles(words: Column, k: int) -> Column:
    """The words are bound as a variable: a predicate that the optimiser pushes below may
    otherwise compute them once for each shingle."""
    each = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.flatten(F.transform(F.array(words), lambda w: F.when(F.size(w) >= k, each(w)).otherwise(F.array().cast("array<bigint>"))))


def simhash(shingles: str) -> Column:
    """128 bits as (lo, hi). Each bit by the majority of the shingles, repeated ones counting as
    often as they occur; the upper half takes its votes from the hash of the hash."""

    def half(votes: Column) -> Column:
        bit = lambda b: F.aggregate(votes, F.lit(0), lambda a, h: a + F.getbit(h, b).cast("int") * 2 - 1) > 0
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"),
            lambda a, b: a.bitwiseOR(F.when(bit(b), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
        )

    return F.struct(half(F.col(shingles)).alias("lo"), half(F.transform(shingles, lambda h: F.xxhash64(h))).alias("hi"))


def _block(fp: Column, b: Column | int) -> Column:
    """Block b (from 0) of a fingerprint: four are in each half."""
    b = F.lit(b) if isinstance(b, int) else b
    half = F.when(b < 4, fp["lo"]).otherwise(fp["hi"])
    return F.call_function("shiftrightunsigned", half, (b % 4 * BLOCK_BITS).cast("int")).bitwiseAND(F.lit(2**BLOCK_BITS - 1)).cast("int")


def _flips(most: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(most + 1) for bits in combinations(range(BLOCK_BITS), r)]


def anchors(n: Column, k: int) -> Column:
    """Evenly spaced places, the first and the last among them, of n shingles. Similar at 0.8, a window
    lacks at most a ninth of them; to lack an inner anchor it has to lack k, and so not all."""
    many = F.greatest(F.lit(8), 3 + F.floor(n / (8 * k)))
    return F.array_distinct(F.transform(F.sequence(F.lit(0).cast("bigint"), many - 1), lambda t: F.floor(t * (n - 1) / (many - 1))))


def _common(a: str, b: str) -> Column:
    """Size of the intersection of two multisets."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    slow = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(slow)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("did"), text.alias("text")
    ).withColumn("version", F.xxhash64("text"))


def place_windows(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """did, version, n, start, ws: the windows that anchors place, with their shingles. ``items``: n (words), gs (shingles)."""
    places = items.select("n", "gs", F.explode(anchors(F.size("gs"), k)).alias("j")).select(
        "n", F.get("gs", F.col("j").cast("int")).alias("h"), F.col("j").cast("int").alias("j")
    ).distinct()
    if places.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    cut = docs.select("did", "version", _words("text").alias("w")).select(
        "did", "version", F.size("w").alias("doc_n"), _shingles(F.col("w"), k).alias("gs")
    )
    hits = cut.select("did", "version", "doc_n", F.posexplode("gs").alias("i", "h")).join(places, "h")
    last = F.greatest(F.lit(0), F.col("doc_n") - F.col("n"))
    spots = hits.select("did", "version", "n", F.least(last, F.greatest(F.lit(0), F.col("i") - F.col("j"))).alias("start"))
    spots = spots.groupBy("did", "version").agg(F.collect_set(F.struct("n", "start")).alias("windows"))
    texts = docs.join(spots, ["did", "version"]).dropDuplicates(["did", "version"]).select(
        "did", "version", "windows", _shingles(_words("text"), k).alias("gs")
    )
    each = F.inline(
        F.transform(
            "windows", lambda w: F.struct(w["n"].alias("n"), w["start"].alias("start"), F.slice("gs", w["start"] + 1, w["n"] - k + 1).alias("ws"))
        )
    )
    return texts.select("did", "version", each)


def near_fingerprints(windows: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """The rows of ``windows`` (n, fp and others) beside ``item``, for all items (n, fp, item) of that size
    whose fingerprints are within ``radius`` bits; each pair once."""
    reach = radius // BLOCKS
    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")
    probed = lambda d, flips, name: d.select("*", blocks).select("*", F.explode(F.array(*map(F.lit, flips))).alias(name)).withColumn(
        "key", _block(F.col("fp"), F.col("block")).bitwiseXOR(F.col(name))
    )
    index = probed(items.select("n", "fp", "item"), _flips(max(0, reach - 1)), "item_flip").withColumnRenamed("fp", "item_fp")
    # Without the hint a small table of items would be sent everywhere with all of its keys.
    pairs = probed(windows, _flips(1 if reach else 0), "flip").join(index.hint("merge"), ["n", "block", "key"])
    # A difference is split in one way: the windows' side flips none, or the highest of ``reach`` bits.
    once = (F.col("flip") == 0) | ((F.bit_count("item_flip") == reach - 1) & (F.col("flip") > F.col("item_flip")))
    differs = F.struct(F.col("fp.lo").bitwiseXOR(F.col("item_fp.lo")).alias("lo"), F.col("fp.hi").bitwiseXOR(F.col("item_fp.hi")).alias("hi"))
    pairs = pairs.where(once).withColumn("differs", differs).where(F.bit_count("differs.lo") + F.bit_count("differs.hi") <= radius)
    before = F.lit(False)  # a pair that several blocks find counts for the first of them
    for b in range(BLOCKS - 1):
        before = before | ((F.col("block") > b) & (F.bit_count(_block(F.col("differs"), b)) <= reach))
    return pairs.where(~before).select(*windows.columns, "item")


def find_passages(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 38) -> DataFrame:
    """did, version, item_id, similarity, start, n_words: the best window of each document and
    item (the first, if several are as good)."""
    items = benchmark.select(
        "item_id", _words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w")
    ).withColumn("gs", _shingles(F.col("w"), k)).where(F.size("gs") > 0)
    items = items.select("item_id", F.xxhash64("item_id", "gs").alias("item"), F.size("w").alias("n"), "gs").dropDuplicates(["item_id", "item"])
    windows = store(place_windows(keyed(docs), items, k).withColumn("fp", simhash("ws")), "windows")
    place = ["did", "version", "n", "start"]
    near = near_fingerprints(windows.select(*place, "fp"), items.withColumn("fp", simhash("gs")), radius)
    near = near.drop("fp").join(windows.drop("fp"), place).join(items.select("item", "item_id", "gs"), "item")
    common = _common("ws", "gs")
    scored = near.withColumn("similarity", common / (F.size("ws") + F.size("gs") - common)).where(F.col("similarity") >= threshold)
    best = F.max_by(F.struct("similarity", "start", "n"), F.struct("similarity", (-F.col("start")).alias("s")))
    return scored.groupBy("did", "version", "item_id", "item").agg(best.alias("b")).select(
        "did", "version", "item_id", "b.similarity", "b.start", F.col("b.n").alias("n_words")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The distinct (did, version) of documents that hold a benchmark passage."""
    return find_passages(docs, benchmark, **how).select("did", "version").distinct()


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), "item_id", "similarity", F.col("start").cast("bigint").alias("start_word"),
        F.col("n_words").cast("bigint").alias("n_words")
    )


OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) AS doc_n, unnest(range(len(w) - 4)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda x: array_to_string(w[x:x + 4], ' '))) AS g FROM d WHERE len(w) > 4),
bs AS (SELECT item_id, len(w) AS n, len(w) - 4 AS size_, unnest(range(len(w) - 4)) AS j, unnest(list_transform(range(1, len(w) - 3), lambda x: array_to_string(w[x:x + 4], ' '))) AS g FROM b WHERE len(w) > 4),
an AS (SELECT *, greatest(8, 3 + size_ // 40) AS many FROM bs),
ak AS (SELECT * FROM an WHERE list_contains(list_transform(range(many), lambda t: t * (size_ - 1) // (many - 1)), j)),
s AS (SELECT DISTINCT doc_id, ak.n, doc_n, least(greatest(doc_n - ak.n, 0), greatest(i - j, 0)) AS start FROM ds JOIN ak USING (g)),
si AS (SELECT DISTINCT s.doc_id, b2.item_id, s.n, s.start FROM s JOIN bs b2 ON b2.n = s.n JOIN ds ON ds.doc_id = s.doc_id AND ds.g = b2.g AND ds.i >= s.start AND ds.i <= s.start + s.n - 5),
wc AS (SELECT s.doc_id, s.item_id, s.n, s.start, ds.g, count(*) AS c FROM si s JOIN ds ON ds.doc_id = s.doc_id AND ds.i >= s.start AND ds.i <= s.start + s.n - 5 GROUP BY ALL),
bc AS (SELECT item_id, g, count(*) AS c FROM bs GROUP BY ALL),
m AS (SELECT wc.doc_id, wc.item_id, wc.n, wc.start, sum(least(wc.c, coalesce(bc.c, 0))) AS common, sum(wc.c) AS size FROM wc LEFT JOIN bc ON bc.item_id = wc.item_id AND bc.g = wc.g GROUP BY ALL),
v AS (SELECT *, CAST(common AS DOUBLE) / CAST(size + n - 4 - common AS DOUBLE) AS similarity FROM m)
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_min(start, (-similarity, start)) AS BIGINT) AS start_word, CAST(any_value(n) AS BIGINT) AS n_words
FROM v WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""

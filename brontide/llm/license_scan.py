"""Operator 9: licence notices. DataFrame functions only.

Texts are normalised to lower-case words. Each template - the usual notices, short licences
in full, the openings of long ones - is compared with windows of its own length by the Dice
coefficient over distinct word bigrams. Which windows: an inverted index holds the more
telling half of each template's bigrams (those with the fewest stop words), and where a text
has one, it puts the template at one place. A window of a bigrams can reach the threshold t
against a template of b only if a / b lies between t / (2 - t) and its inverse; others are
not compared. As such a window has more than half of the template's bigrams, it has some of
the index. Of a template's windows that overlap the best stays, and of templates that
overlap the one with the most bigrams in common, so that each place has one licence.

Null and empty texts match nothing; texts of any length are read whole, and lines make no
difference. Every input row gives one output row; repeated rows are scanned once. Ties go to
the larger coefficient, then the first by name, then the first place. An empty table gives
an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .decontaminate import BROADCAST_ROWS, keyed
from .license_texts import TEMPLATES
from .line_dedup import NO_ID

#: Words that tell little; bigrams without them go into the index first.
STOP_WORDS = "a all an and any are as at be but by for from in is it may must no not of on or shall that the this to with you".split()
SCALE = 4096


def words_of(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def index_of(templates: dict[str, str]) -> list[tuple[str, int, int, str, str, int]]:
    """(template, words, distinct bigrams, first word, second word, place of the bigram) of the half
    of each template's distinct bigrams with the fewest stop words, and of those the first."""
    rows = []
    for name, text in templates.items():
        words = words_of(text)
        first: dict[tuple[str, str], int] = {}
        for i, pair in enumerate(zip(words, words[1:], strict=False)):
            first.setdefault(pair, i)
        best = sorted(first, key=lambda p: (sum(w in STOP_WORDS for w in p), first[p]))
        rows += [(name, len(words), len(first), *p, first[p]) for p in best[: -(-len(first) // 2)]]
    return rows


def _bigrams(text: Column) -> Column:
    """Hashes of successive words; the words are bound as a variable, so as to be cut once."""
    words = F.split(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ", -1)
    pairs = lambda w: F.when(
        F.size(w) >= 2, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))
    ).otherwise(F.array().cast("array<bigint>"))
    return F.flatten(F.transform(F.array(words), pairs))


def find_notices(docs: DataFrame, threshold: float = 0.8, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """did, version (of the text), license, template, start, n_words, dice: the licences stated, one a place."""
    spark = docs.sparkSession
    index = index_of(templates)
    small = lambda t, n: F.broadcast(t) if n <= BROADCAST_ROWS else t
    lookup = spark.createDataFrame(
        index, "template string, n int, b int, w1 string, w2 string, place int"
    ).select(F.xxhash64("w1", "w2").alias("h"), "template", "n", "place")
    sets = spark.createDataFrame(
        [(k, v) for k, v in templates.items()], "template string, text string"
    ).select("template", F.array_distinct(_bigrams(F.col("text"))).alias("bigrams"))
    d = keyed(docs)
    cut = d.select("did", "version", F.posexplode(_bigrams(F.col("text"))).alias("at", "h"))
    starts = cut.join(small(lookup, len(index)), "h").select(
        "did", "version", "template", "n", F.greatest(F.lit(0), F.col("at") - F.col("place")).alias("start")
    )
    starts = starts.groupBy("did", "version").agg(F.collect_set(F.struct("template", "n", "start")).alias("windows"))

    texts = d.join(starts, ["did", "version"]).dropDuplicates(["did", "version"]).select(
        "did", "version", "windows", _bigrams(F.col("text")).alias("all")
    )
    each = texts.select(
        "did", "version",
        F.inline(
            F.transform(
                "windows",
                lambda w: F.struct(
                    w["template"].alias("template"), w["n"].alias("n_words"), w["start"].alias("start"),
                    F.array_distinct(F.slice("all", w["start"] + 1, w["n"] - 1)).alias("window")
                )
            )
        )
    )
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    a, b = F.size("window"), F.size("bigrams")
    fits = each.join(small(sets, len(templates)), "template").where((a >= b * low) & (a <= b * high))
    found = fits.withColumn("common", F.size(F.array_intersect("window", "bigrams")))
    found = found.select(
        "did", "version", "template", "start", "n_words", "common", ((2 * F.col("common")).cast("double") / (a + b).cast("double")).alias("dice")
    ).where(F.col("dice") >= threshold)

    place = F.floor(F.col("start").cast("bigint") * SCALE / F.col("n_words"))  # windows of a template overlap if closer than SCALE
    near = W.partitionBy("did", "version", "template").orderBy("place").rangeBetween(1 - SCALE, SCALE - 1)
    rank = F.struct("dice", (-F.col("start")).alias("s"))
    peaks = found.withColumn("place", place).withColumn("best", F.max(rank).over(near)).where(F.col("best") == rank)
    order = W.partitionBy("did", "version").orderBy("start", "template")
    reach = F.max(F.col("start") + F.col("n_words")).over(order.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.coalesce((F.col("start") >= F.col("reach")).cast("int"), F.lit(1))).over(order.rowsBetween(W.unboundedPreceding, 0))
    marked = peaks.withColumn("reach", reach).withColumn("island", island)
    top = F.min_by(
        F.struct("template", "start", "n_words", "dice"), F.struct((-F.col("common")).alias("c"), (-F.col("dice")).alias("d"), "template", "start")
    )
    return marked.groupBy("did", "version", "island").agg(top.alias("t")).select(
        "did", "version", F.substring_index("t.template", "#", 1).alias("license"), "t.*"
    )


def scan_licenses(docs: DataFrame, threshold: float = 0.8, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id and hits: array of (dice, license, start, n_words), one for each place that states a
    licence; for each row of ``docs``."""
    found = find_notices(docs, threshold, templates).groupBy("did", "version").agg(
        F.sort_array(F.collect_list(F.struct("dice", "license", "start", "n_words"))).alias("hits")
    )
    out = keyed(docs).select("did", "version").join(found, ["did", "version"], "left")
    none = F.array().cast("array<struct<dice:double,license:string,start:int,n_words:int>>")
    return out.select(F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), F.coalesce("hits", none).alias("hits"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["license"]))), ",")
    return out.select(
        "doc_id", F.size("hits").cast("bigint").alias("n_hits"), names.alias("licenses"),
        F.coalesce(F.array_max(F.transform("hits", lambda x: x["dice"])), F.lit(0.0)).alias("best_dice")
    )


def op9_sql(threshold: float = 0.8) -> str:
    index = ", ".join(f"('{name}', {n}, '{x} {y}', {place})" for name, n, _, x, y, place in index_of(TEMPLATES))
    sets = ", ".join(
        f"('{name}', {sorted({f'{x} {y}' for x, y in zip(w, w[1:], strict=False)})})" for name, text in TEMPLATES.items() for w in [words_of(text)]
    )
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    return f"""
WITH ix(template, n, gram, place) AS (VALUES {index}), st(template, b) AS (VALUES {sets}),
d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
g AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS a FROM d WHERE len(w) > 1),
p AS (SELECT doc_id, unnest(a) AS gram, unnest(range(len(a))) AS i FROM g),
s AS (SELECT DISTINCT doc_id, template, n, greatest(0, i - place) AS start FROM p JOIN ix USING (gram)),
v AS (SELECT s.*, list_distinct(a[start + 1:start + n - 1]) AS win FROM s JOIN g USING (doc_id)),
f AS (SELECT doc_id, template, n, start, len(list_intersect(win, b)) AS common, 2.0::DOUBLE * common / (len(win) + len(b)) AS dice FROM v
  JOIN st USING (template) WHERE len(win) >= len(b) * {low!r} AND len(win) <= len(b) * {high!r}),
q AS (SELECT *, start * {SCALE} // n AS pl FROM f WHERE dice >= {threshold}),
k AS (SELECT a.* FROM q a WHERE NOT EXISTS (SELECT 1 FROM q c
  WHERE c.doc_id = a.doc_id AND c.template = a.template AND abs(c.pl - a.pl) < {SCALE} AND (c.dice > a.dice OR (c.dice = a.dice AND c.start < a.start)))),
r AS (SELECT *, max(start + n) OVER (PARTITION BY doc_id ORDER BY start, template ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k),
z AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id
  ORDER BY start, template ROWS UNBOUNDED PRECEDING) AS island FROM r),
m AS (SELECT doc_id, dice, string_split(template, '#')[1] AS license FROM z QUALIFY row_number() OVER (PARTITION BY doc_id, island
  ORDER BY common DESC, dice DESC, template, start) = 1)
SELECT d.doc_id, count(m.dice) AS n_hits, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses, coalesce(max(dice), 0.0) AS best_dice
FROM d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id
"""

"""Operator 10: quality rules by distribution divergence. DataFrame functions only.

A document's character-class histogram and its histogram of common words are compared with
those of its language by Jensen-Shannon distance (base 2, so between 0 and 1). Guards:
neither verdict falls on a text too short for its histogram to settle, and the word verdict
falls only on languages that have a reference; others have the mean of the references'
character classes. References are fixed values, or fitted on a bounded sample of documents
(:func:`fit_references`). One pass over the texts, no shuffle.

A null or empty text has no words and fails the base rules. A null or unknown language has no
word verdict. Each input row gives one output row, repeated rows too; texts of any length are
read whole; an empty table gives an empty result. Nothing but doc_id, text and lang is read,
and lang may be missing; other columns stay as they are, but for those that :func:`measure`
adds, which replace columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .line_dedup import BLANKS

WORD_BREAK = "[ \\t-\\r]+"
#: Symbols; the most common words of each language, most common first.
SYMBOLS = "#*$%&|<>"
#: Shares are of running words, rounded, as word counts of the languages have them.
COMMON_WORDS = {
    "en": {"the": 0.061, "of": 0.033, "and": 0.028, "to": 0.026, "a": 0.022, "in": 0.02, "is": 0.011, "that": 0.011, "it": 0.01, "for": 0.009, "was": 0.009, "on": 0.007, "with": 0.007, "as": 0.007, "be": 0.006},
    "de": {"der": 0.036, "die": 0.033, "und": 0.028, "in": 0.019, "den": 0.012, "von": 0.011, "zu": 0.011, "das": 0.011, "mit": 0.009, "sich": 0.008, "des": 0.008, "auf": 0.008, "ist": 0.008, "im": 0.008, "für": 0.007},
    "fr": {"de": 0.054, "la": 0.033, "le": 0.026, "et": 0.024, "les": 0.02, "des": 0.017, "en": 0.014, "un": 0.012, "du": 0.012, "une": 0.01, "que": 0.01, "est": 0.01, "pour": 0.009, "dans": 0.009, "par": 0.007},
    "es": {"de": 0.064, "la": 0.039, "que": 0.031, "el": 0.029, "en": 0.027, "y": 0.024, "los": 0.017, "se": 0.013, "del": 0.012, "las": 0.012, "un": 0.011, "por": 0.01, "con": 0.01, "no": 0.009, "una": 0.008},
}
#: Shares of characters by class: letters and others, blanks, digits, symbols, other punctuation.
CLASS_SHARES = {
    "en": [0.795, 0.17, 0.008, 0.001, 0.026], "de": [0.82, 0.145, 0.008, 0.001, 0.026], "fr": [0.8, 0.165, 0.006, 0.001, 0.028],
    "es": [0.805, 0.165, 0.006, 0.001, 0.023]
}
Reference = dict[str, tuple[dict[str, float], list[float]]]
REFERENCES: Reference = {k: (COMMON_WORDS[k], CLASS_SHARES[k]) for k in COMMON_WORDS}


def mean_classes(references: Reference) -> list[float]:
    return [sum(c) / len(references) for c in zip(*(r[1] for r in references.values()), strict=True)]


def word_shares(words: dict[str, float]) -> list[float]:
    """The shares of the common words and of all others."""
    return [*words.values(), 1 - sum(words.values())]


def words_of(text: Column) -> Column:
    body = F.btrim(text, F.lit(BLANKS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WORD_BREAK, -1))


def js_distance(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms (arrays that sum to 1; the second without zeros)."""
    def term(p: Column, q: Column) -> Column:
        mean = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / mean)).otherwise(F.lit(0.0)) + q * F.log2(q / mean)

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(shares, reference, term), F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _per_language(lang: Column, values: dict[str, Column], otherwise: Column | None = None) -> Column:
    out = F.coalesce(*[F.when(lang == k, v) for k, v in values.items()])
    return out if otherwise is None else F.coalesce(out, otherwise)


FEW = 64


def _covered(places: Column) -> Column:
    """How many words lie in the 3-word windows that start at these places, which rise."""
    start = F.struct(F.lit(-3).alias("prev"), F.lit(0).alias("n"))
    return F.aggregate(
        places, start, lambda a, p: F.struct(p.alias("prev"), (a["n"] + F.least(F.lit(3), p - a["prev"])).alias("n")), lambda a: a["n"]
    )


def _repeat_words(grams: str, twice: str) -> Column:
    """Words inside 3-word windows found twice or more. ``twice``: the hashes that are. Of few
    such hashes each window is looked up among them; of many, windows are sorted by hash and
    those equal to a neighbour put back in text order, in n log n. Either way counts the same."""
    few = F.array_compact(F.transform(grams, lambda h, i: F.when(F.array_contains(twice, h), i)))
    s = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    forward = F.zip_with(
        s, F.concat(F.slice(s, 2, F.size(s)), none), lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), (a["h"] == b["h"]).alias("next"))
    )
    marked = F.zip_with(
        forward, F.concat(none, F.slice(s, 1, F.size(s) - 1)),
        lambda a, b: F.struct(a["i"].alias("i"), (F.coalesce(a["next"], F.lit(False)) | F.coalesce(a["h"] == b["h"], F.lit(False))).alias("dup"))
    )
    many = F.sort_array(F.transform(F.filter(marked, lambda x: x["dup"]), lambda x: x["i"]))
    n = F.size(twice)
    return F.when(n == 0, 0).when(n <= FEW, _covered(few)).otherwise(_covered(many))


def measure(docs: DataFrame, references: Reference = REFERENCES) -> DataFrame:
    """The columns of ``docs`` and: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_text_chars, js_chars, js_words."""
    blank = F.lit(BLANKS)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    d = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        lang.alias("lang")
    )
    d = d.withColumn("words", words_of(F.col("text")))
    marks = F.array_join(F.regexp_extract_all("text", F.lit("([!-@\\[-`{-~]+)"), 1), "")
    known = sorted({x for words, _ in references.values() for w in words for x in (w, w.capitalize())})
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, blank) != "")
    grams = F.when(
        F.size("words") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))
    # Common words in a row, each between two blanks of its own, so that they are counted by what taking one out shortens it.
    common = F.concat(F.lit(" "), F.lower(F.array_join(F.filter("words", lambda w: w.isin(known)), "  ")), F.lit(" "))
    d = d.withColumns({"marks": marks, "grams": grams, "common": common, "lines": lines}).withColumn("sorted", F.sort_array("grams"))
    d = d.withColumn("twice", F.array_distinct(F.filter("sorted", lambda h, i: h == F.get("sorted", i + 1))))
    dup = F.size("lines") - F.size(F.array_distinct("lines"))
    cut = lambda chars: F.char_length("marks") - F.char_length(F.translate("marks", chars, ""))
    count = lambda w: F.floor((F.octet_length("common") - F.octet_length(F.replace("common", F.lit(f" {w} "), F.lit("")))) / len(f" {w} ".encode()))
    d = d.withColumns({
        "n_words": F.size("words").cast("bigint"), "word_chars": F.char_length(F.array_join("words", "")).cast("bigint"), "n_symbols": cut(SYMBOLS).cast("bigint"), "digits": cut("0123456789"),
        "n_dup_lines": dup.cast("bigint"), "n_repeat_words": _repeat_words("grams", "twice").cast("bigint"),
        "counts": _per_language(F.col("lang"), {k: F.array(*map(count, words)) for k, (words, _) in references.items()}), "n_text_chars": F.char_length("text").cast("bigint"),
    })
    n, w = F.col("n_text_chars").cast("double"), F.col("n_words").cast("double")
    marked = F.char_length("marks")
    classes = F.array(
        *[
            F.try_divide(c.cast("double"), n) for c in (
                F.col("word_chars") - marked, F.col("n_text_chars") - F.col("word_chars"), F.col("digits"), F.col("n_symbols"),
                marked - F.col("n_symbols") - F.col("digits")
            )
        ]
    )
    rest = F.col("n_words") - F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    shares = F.transform(F.concat("counts", F.array(rest)), lambda c: F.try_divide(c.cast("double"), w))
    fixed = lambda values: F.array(*map(F.lit, values))
    class_reference = _per_language(F.col("lang"), {k: fixed(c) for k, (_, c) in references.items()}, fixed(mean_classes(references)))
    word_reference = _per_language(F.col("lang"), {k: fixed(word_shares(words)) for k, (words, _) in references.items()})
    d = d.withColumns(
        {
            "js_chars": F.when(n > 0, js_distance(classes, class_reference)),
            "js_words": F.when((w > 0) & F.col("counts").isNotNull(), js_distance(shares, word_reference))
        }
    )
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_chars", "js_chars", "js_words"]
    return d.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added], *added)


def fit_references(docs: DataFrame, sample_docs: int = 2000, top: int = 15, least: float = 1e-4) -> Reference:
    """References from a bounded sample: of each language the ``sample_docs`` documents with the least
    hashes of their texts, or all there are; their ``top`` most common words, and character
    classes. No share is below ``least``, as the distance needs some mass everywhere. What comes
    to the driver is ``top`` + 1 rows a language."""
    order = W.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    d = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text").withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample_docs).drop("at")
    words = d.select(
        "lang", F.explode(F.transform(words_of(F.col("text")), lambda w: F.lower(w))).alias("word")
    ).groupBy("lang", "word").agg(F.count("*").alias("n"))
    whole = W.partitionBy("lang")
    words = words.withColumns(
        {"share": F.col("n") / F.sum("n").over(whole), "place": F.row_number().over(whole.orderBy(F.desc("n"), "word"))}
    ).where(F.col("place") <= top)
    count = lambda rx: F.sum(F.char_length("text") - F.char_length(F.regexp_replace("text", rx, "")))
    rx = {"blanks": "[ \\t-\\r]", "digits": "[0-9]", "symbols": "[#*$%&|<>]", "marks": "[!-@\\[-`{-~]"}
    chars = d.groupBy("lang").agg(F.sum(F.char_length("text")).alias("n"), *[count(p).alias(k) for k, p in rx.items()])
    out: Reference = {}
    for r in chars.collect():
        parts = [r.n - r.blanks - r.marks, r.blanks, r.digits, r.symbols, r.marks - r.digits - r.symbols]
        out[r.lang] = ({}, [max(least, p / r.n) for p in parts])
    for r in words.orderBy("lang", "place").collect():
        out[r.lang][0][r.word] = max(least, r.share)
    return out


def judge(
    docs: DataFrame, max_js_chars: float = 0.35, max_js_words: float = 0.28, min_chars: int = 200, min_words: int = 200,
    references: Reference = REFERENCES
) -> DataFrame:
    """:func:`measure`, and base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    odd_chars = (F.col("n_text_chars") >= min_chars) & (F.col("js_chars") > max_js_chars)
    odd_words = (F.col("n_words") >= min_words) & F.coalesce(F.col("js_words") > max_js_words, F.lit(False))
    return measure(docs, references).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~odd_chars & ~odd_words)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _js_sql(shares: str, reference: str) -> str:
    p, q = f"{shares}[i]", f"{reference}[i]"
    return f"sqrt(greatest(list_sum(list_transform(range(1, len({shares}) + 1), lambda i: CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + {q} * log2({q} / (({p} + {q}) / 2)))) / 2, 0.0))"


def op10_sql() -> str:
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    lists = " ".join(f"WHEN '{k}' THEN {list(ws)}" for k, ws in COMMON_WORDS.items())
    word_refs = " ".join(f"WHEN '{k}' THEN {word_shares(ws)}::DOUBLE[]" for k, ws in COMMON_WORDS.items())
    class_refs = " ".join(f"WHEN '{k}' THEN {c}::DOUBLE[]" for k, c in CLASS_SHARES.items())
    both = sorted({x for ws in COMMON_WORDS.values() for w in ws for x in (w, w.capitalize())})
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {blanks}) <> '') AS lines,
    array_to_string(regexp_extract_all(coalesce(text, ''), '[!-@\\[-`{{-~]+'), '') AS marks FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM d),
h AS (SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS gram FROM g),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM h) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT w) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS w FROM r) GROUP BY doc_id),
m AS (SELECT doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(marks, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, length(regexp_replace(marks, '[^0-9]', '', 'g')) AS n_digits,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(text) AS n_chars,
  length(marks) AS n_marks,
    list_transform(CASE lang {lists} END, lambda w: len(list_filter(words, lambda x: x IN {tuple(both)} AND lower(x) = w))) AS ranked
  FROM d LEFT JOIN p USING (doc_id)),
a AS (SELECT *, list_transform([word_chars - n_marks, n_chars - word_chars, n_digits, n_symbols, n_marks - n_symbols - n_digits],
  lambda x: x / n_chars) AS classes, CASE lang {class_refs} ELSE {mean_classes(REFERENCES)}::DOUBLE[] END AS class_ref,
    list_transform(list_append(ranked, n_words - list_sum(ranked)), lambda x: x / n_words) AS shares, CASE lang {word_refs} END AS word_ref FROM m),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_chars > 0 THEN {_js_sql('classes', 'class_ref')} END AS js_chars,
    CASE WHEN n_words > 0 AND ranked IS NOT NULL THEN {_js_sql('shares', 'word_ref')} END AS js_words FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_chars >= 200 AND js_chars > 0.35) AND NOT (n_words >= 200 AND coalesce(js_words > 0.28, false)) AS kept
FROM j
"""

"""Operator 11: toxicity of documents by boosted trees over dense features.

A classifier is fitted on at most ``SAMPLE`` labelled rows, those with the least hash of their id;
everything else reads every document. Its lexicon - words and word beginnings that toxic documents
hold and others don't, with log odds - is counted on that sample, in four folds, so that a training
document is measured with a lexicon made without its fold. The features are densities of lexicon words
by strength, the strongest of them, lexicon words beside a second person, capitals, punctuation and
words with signs or digits among their letters (which are read as the letters they stand for). Three
folds train the trees, the fourth their isotonic calibration. Where calibrated scores tie, the trees'
own probability tells them apart (by ``TILT`` at most).

doc_id, lang, source and the labels of the document itself are no inputs of a score. Labels other
than 0 and 1 are not used; of several for one id the highest counts. With fewer than ``LEAST`` rows of
either class nothing can be learned, and every score is the share of toxic rows (0 without labels).
A null or empty text has no words and is scored all the same; texts of any length are read whole. A
null doc_id is hashed as an empty text and has no label. Each input row gives one output row,
repeated rows too; an empty table gives an empty result; columns other than doc_id, text and
(of the labels) toxic are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import store

SAMPLE = 20_000
FOLDS = 4
LEAST = 8
#: Terms: whole words, and word beginnings of these lengths. At most CANDIDATES terms, the commonest of
#: toxic documents, are counted in the others, and at most TERMS, the strongest, are kept.
SHORTEST, LONGEST = 3, 8
CANDIDATES, TERMS = 200_000, 50_000
#: Log odds from which a word is weak, middling or strong evidence.
WEAK, MIDDLING, STRONG = 2.0, 3.0, 4.0
NEAR = 3
TILT = 0.001
MEMO = 300_000

#: Second persons of four languages, and signs that stand for letters.
SECOND_PERSON = frozenset(
    """you your yours yourself u ur ya du dich dir dein deine deinen deiner euch euer ihr tu te toi ton ta tes vous votre vos
    tú ti tus usted ustedes vos os vosotros""".split()
)
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = "#*$%&@^~|<>"

FEATURES = [
    "strong_log", "strong_density", "strong_distinct", "middling_density", "weak_density", "first", "second", "third", "evidence", "near_second_person",
    "second_person_density", "capitals", "exclamations", "questions", "signs", "commas_stops", "disguised", "words_log",
]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("bigint").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def plain(token: str) -> tuple[str, bool]:
    """The word of a lower-case token, and whether it was written in disguise."""
    if token.isalpha():
        return token, False
    start, end = 0, len(token)
    while start < end and not token[start].isalnum():
        start += 1
    while end > start and not token[end - 1].isalnum():
        end -= 1
    core = token[start:end]
    if core.isalpha() or core.isdigit() or not core:
        return core, False
    word = "".join(c for c in core.translate(STANDS_FOR) if c.isalpha())
    return word, len(word) > 2


def terms_of(word: str) -> list[str]:
    return [word[:i] for i in range(SHORTEST, min(LONGEST, len(word)) + 1)] + ([word + "$"] if word else [])


def _counted(known: frozenset | None):
    """Rows (term, fold, n): documents of each fold that hold a term (one of ``known``, if given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flushed():
            keys = list(counts)
            out = pa.record_batch({"term": [k[0] for k in keys], "fold": pa.array([k[1] for k in keys], pa.int32()), "n": pa.array([counts[k] for k in keys], pa.int64())})
            counts.clear()
            return out

        for batch in batches:
            for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                found = {t for token in set((text or "").lower().split()) for t in terms_of(plain(token)[0])}
                counts.update((t, fold) for t in (found if known is None else found & known))
                if len(counts) > MEMO:
                    yield flushed()
        if counts:
            yield flushed()

    return run


def learn_lexicon(rows: DataFrame) -> dict[str, tuple[float, ...]]:
    """term -> log odds without fold 0, ..., without the last fold, and with all folds. ``rows``: text, toxic, fold."""
    count = lambda d, known: d.select("text", "fold").mapInArrow(_counted(known), "term string, fold int, n bigint").groupBy("term").pivot(
        "fold", list(range(FOLDS))
    ).agg(F.sum("n")).na.fill(0)
    folds = [str(f) for f in range(FOLDS)]
    total = sum((F.col(f) for f in folds), F.lit(0))
    toxic = count(rows.where("toxic = 1"), None).where(total >= 3).orderBy(total.desc(), "term").limit(CANDIDATES).collect()
    with_ = {r.term: [r[f] for f in folds] for r in toxic}
    without = {r.term: [r[f] for f in folds] for r in count(rows.where("toxic = 0"), frozenset(with_)).collect()}
    n = {(r.toxic, r.fold): r["count"] for r in rows.groupBy("toxic", "fold").count().collect()}
    size = {y: [n.get((y, f), 0) for f in range(FOLDS)] for y in (0, 1)}
    share = [(sum(size[0]) - size[0][f] + 1) / (sum(size[1]) - size[1][f] + 1) for f in range(FOLDS)] + [(sum(size[0]) + 1) / (sum(size[1]) + 1)]

    def odds(term: str) -> tuple[float, ...]:
        a, b = with_[term], without.get(term, [0] * FOLDS)
        left = [(sum(a) - a[f], sum(b) - b[f]) for f in range(FOLDS)] + [(sum(a), sum(b))]
        return tuple(math.log((p + 0.5) / (q + 1.5) * s) for (p, q), s in zip(left, share, strict=True))

    scored = ((t, odds(t)) for t in with_)
    return dict(sorted((x for x in scored if max(x[1]) >= WEAK), key=lambda x: (-max(x[1]), x[0]))[:TERMS])


class Measure:
    """Features of texts by one version of a lexicon."""

    def __init__(self, lexicon: dict[str, tuple[float, ...]], version: int) -> None:
        self.odds = {t: w[version] for t, w in lexicon.items() if w[version] >= WEAK}
        self.memo: dict[str, tuple[float, bool]] = {}

    def token(self, token: str) -> tuple[float, bool]:
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            word, disguised = plain(token)
            got = self.memo[token] = (max((self.odds.get(t, 0.0) for t in terms_of(word)), default=0.0), disguised)
        return got

    def __call__(self, text: str) -> list[float]:
        tokens = text.lower().split()
        counts, n = Counter(tokens), max(1, len(tokens))
        strong, middling, weak, disguised, second, evidence = 0, 0, 0, 0, 0, 0.0
        best: list[float] = []
        hits = set()
        for t, c in counts.items():
            w, odd = self.token(t)
            disguised += c * odd
            if t in SECOND_PERSON:
                second += c
            if w >= WEAK:
                best.append(w)
                evidence += w
                if w >= STRONG:
                    strong += c
                    hits.add(t)
                elif w >= MIDDLING:
                    middling += c
                else:
                    weak += c
        near = 0
        if hits and second:
            you = [i for i, t in enumerate(tokens) if t in SECOND_PERSON]
            beside = {i + j for i in you for j in range(-NEAR, NEAR + 1)}
            near = sum(t in hits and i in beside for i, t in enumerate(tokens))
        best = sorted(best, reverse=True)[:3] + [0.0] * 3
        raw, size = text.encode(), max(1, len(text))
        return [
            math.log1p(strong), strong / n, float(len(hits)), middling / n, weak / n, best[0], best[1], best[2], evidence / math.sqrt(n), near / max(1, strong),
            second / n, (len(raw) - len(raw.translate(None, CAPITALS))) / size, text.count("!") / n, text.count("?") / n, sum(map(text.count, SIGNS)) / n,
            (text.count(",") + text.count(".")) / n, disguised / n, math.log1p(len(tokens)),
        ]


def _measured(lexicon, by_fold: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures: dict[int, Measure] = {}
        for batch in batches:
            version = batch.column("fold").to_pylist() if by_fold else [FOLDS] * batch.num_rows
            for v in set(version) - set(measures):
                measures[v] = Measure(lexicon.value, v)
            got = [measures[v](t or "") for t, v in zip(batch.column("text").to_pylist(), version, strict=True)]
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.record_batch([*[batch.column(c) for c in rest], pa.array(got, pa.list_(pa.float64()))], names=[*rest, "measures"])

    return run


@dataclass
class Classifier:
    lexicon: dict[str, tuple[float, ...]]
    trees: GBTClassificationModel | None
    levels: IsotonicRegressionModel | None
    share: float

    def measured(self, d: DataFrame, by_fold: bool = False) -> DataFrame:
        """``d`` (text and other columns) with features in place of the text."""
        rest = ", ".join(f"`{c}` {kind}" for c, kind in d.dtypes if c != "text")
        shared = d.sparkSession.sparkContext.broadcast(self.lexicon)  # TERMS entries at most
        out = d.mapInArrow(_measured(shared, by_fold), f"{rest}, measures array<double>")
        return out.withColumn("features", array_to_vector("measures")).drop("measures")

    def chance(self, measured: DataFrame) -> DataFrame:
        out = self.trees.transform(measured)
        return out.withColumn("chance", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")

    def scored(self, d: DataFrame) -> DataFrame:
        """``d`` (text and other columns) with ``score`` in place of the text."""
        if self.trees is None:
            return d.drop("text").withColumn("score", F.lit(float(self.share)))
        out = self.chance(self.measured(d))
        score = F.col("chance")
        if self.levels is not None:
            out = self.levels.transform(out)
            score = (1 - TILT) * F.col("level") + TILT * F.col("chance")
        return out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).select(*[c for c in d.columns if c != "text"], "score")


def sample_rows(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """text, toxic, fold of at most ``size`` labelled rows that aren't held out."""
    ids = labels.where(F.col("toxic").cast("int").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").cast("bigint").alias("doc_id")
    ).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return store(d.join(F.broadcast(ids), "doc_id").select("text", "toxic", "fold"), "toxic-sample")


def train(rows: DataFrame) -> Classifier:
    """``rows``: text, toxic, fold."""
    counts = rows.groupBy("toxic", "fold").count().collect()
    n = {y: sum(r["count"] for r in counts if r.toxic == y) for y in (0, 1)}
    if min(n.values()) < LEAST:
        return Classifier({}, None, None, n[1] / max(1, n[0] + n[1]))
    out = Classifier(learn_lexicon(rows), None, None, n[1] / (n[0] + n[1]))
    table = store(out.measured(rows, by_fold=True).select("toxic", "fold", vector_to_array("features").alias("x")), "toxic-features")
    table = table.coalesce(4).select(F.col("toxic").cast("double").alias("label"), "fold", array_to_vector("x").alias("features"))
    classes = lambda of: {r.toxic for r in counts if of(r.fold)}
    apart = len(classes(lambda f: f == 0)) == len(classes(lambda f: f > 0)) == 2
    trees = GBTClassifier(maxIter=30, maxDepth=4, stepSize=0.2, maxBins=64, minInstancesPerNode=4, subsamplingRate=0.8, seed=11)
    out.trees = trees.fit(table.where("fold > 0") if apart else table)
    if apart:
        judged = out.chance(table.where("fold = 0"))
        out.levels = IsotonicRegression(featuresCol="chance", labelCol="label", predictionCol="level").fit(judged)
    return out


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(sample_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return model.scored(docs).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )

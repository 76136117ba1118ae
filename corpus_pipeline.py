"""The training-data pipeline: quality, near-duplicates, decontamination, mixing, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brontide.llm import decontaminate, minhash_dedup, mixing, quality_rules, sharding
from brontide.llm._shared import store


def _whole(docs: DataFrame) -> DataFrame:
    """Each row as one column, doc, beside its keys: columns of any name pass through."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(minhash_dedup.NO_ID)).alias("did"), F.xxhash64(text).alias("version")
    )


def _columns(d: DataFrame, docs: DataFrame) -> DataFrame:
    return d.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null or empty text has no words and goes; texts of any length
    are judged whole; repeated rows are judged alike, so there are no ties; a null lang has the
    references of all languages. No rows give none; columns of any name pass through."""
    read = ["text", *[c for c in docs.columns if c == "lang"]]
    judged = quality_rules.judge(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *read))
    # Out of a generator, the verdict can't be pushed below and computed piecemeal.
    return _columns(judged.select("doc", F.inline_outer(F.array(F.struct("kept")))).where("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least doc_id (of rows that share
    it, that with the least hash of its text, and one of equal ones). Documents without words
    belong to no group and all stay, null texts among them; a null doc_id comes before all others. Texts
    of any length are compared whole. No rows give none; columns of any name pass through."""
    marked = minhash_dedup.near_duplicates(docs, k=5, percent=80)
    first = marked.where("n_shingles > 0 AND did = component").groupBy("component", "component_set").agg(F.min("version").alias("version"))
    stay = first.select(F.col("component").alias("did"), "version", F.lit(True).alias("one")).unionByName(
        marked.where("n_shingles = 0").select("did", "version", F.lit(False).alias("one")).distinct()
    )
    kept = _whole(docs).join(stay, ["did", "version"])
    # One of the copies that share id and text, by an aggregate that starts where the rows lie.
    single = kept.where("one").groupBy("did", "version").agg(F.first("doc").alias("doc"))
    return _columns(single.select("doc").unionByName(kept.where("NOT one").select("doc")), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Null and empty texts, and items without words, hold none;
    texts of any length are searched whole; rows that share id and text go or stay together, whatever
    else they hold. No rows give none; columns of any name pass through."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _columns(_whole(docs).join(found, ["did", "version"], "left_anti"), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the schedule, which the shards of the last stage keep. A null source
    is one of its own; null, empty and long texts are rows like others; repeated rows have places of
    their own; ties in the random order go by id and text. No rows give none; columns of any name
    pass through."""
    return mixing.mix(docs, mixing.TARGETS, mixing.DEFAULT)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The committed shards: which one holds a document, and where. By shard and row they follow
    the order in which the stage before was written. Every row has a place, whatever is null, empty, long
    or repeated in it; no rows make no shard; other columns stay in the files."""
    out, _ = sharding.shard(docs, order=sharding.file_order(docs))
    return out.select("doc_id", F.col(out.columns[-2]).alias("shard"), F.col(out.columns[-1]).alias("row_in_shard"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]

#: SQL expresses neither the schedule nor the files' order; tests hold the operators and the order of the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

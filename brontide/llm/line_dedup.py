"""Operator 7: lines that many documents share. DataFrame functions only.

Line hashes are range-partitioned and sorted by document and position, so that the rows of
even a line found everywhere spread over as many partitions as they need. The rows are
written with the number of their range; an aggregate passes over them, and only one row per
line and document goes on to the count of documents. The rows of a line lie in successive
ranges, from the first one to the last: the lines found meet the rows again by hash and
range, so that a line has as many tasks as its rows take ranges, however many there are. What
comes back to a document is its keep bitmap, compressed to the runs of kept lines, not text.

A null or empty text is one empty line; texts and lines of any length are read whole. Rows
with the same doc_id are one document when documents are counted; a null doc_id counts as
one document before all others. Each input row gives one output row, repeated rows too; an
empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import store

#: The blank characters \x20 and \x09 to \x0D, and the letters that are folded.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(2**63)


def fold_ascii(c: Column) -> Column:
    """A-Z to lower case, other letters as they are; the fast path serves pure ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("did"), text.alias("text")
    ).withColumn("version", F.xxhash64("text"))


def line_keep_runs(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """did, version (of the text), n_lines, n_dropped, keep: runs (start, length) of kept lines;
    only for documents that lose lines."""
    lines = _keyed(docs).select("did", "version", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = F.btrim("line", F.lit(BLANKS))
    lines = lines.select("did", "version", "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
    lines = lines.withColumn("key", fold_ascii(F.col("key"))).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "did", "version", "pos"
    )
    order = ["h1", "h2", "did", "version", "pos"]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    # Written, as where a range begins may differ from one evaluation to the next.
    dealt = store(dealt.withColumn("range", F.spark_partition_id()), "lines")
    by_doc = dealt.groupBy("h1", "h2", "did").agg(F.min("range").alias("first"), F.max("range").alias("last"))
    found = by_doc.groupBy("h1", "h2").agg(
        F.count("*").alias("n_docs"), F.max("did").alias("keeper"), F.min("first").alias("first"), F.max("last").alias("last")
    ).where(F.col("n_docs") >= min_docs)
    found = found.select("h1", "h2", "keeper", F.explode(F.sequence("first", "last")).alias("range"))
    lost = dealt.join(found, ["h1", "h2", "range"]).where(F.col("did") != F.col("keeper"))
    return lost.groupBy("did", "version").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def keep_runs(n_lines: Column, dropped: Column) -> Column:
    """The keep bitmap as runs (start, length) of kept lines."""
    before = F.concat(F.array(F.lit(-1)), dropped)
    after = F.concat(dropped, F.array(n_lines.cast("int")))
    runs = F.zip_with(before, after, lambda b, a: F.struct((b + 1).alias("start"), (a - b - 1).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep (runs of kept lines), lines; for each row of ``docs``."""
    d = _keyed(docs).withColumn("doc_id", F.when(F.col("did") != NO_ID, F.col("did")))
    out = d.join(line_keep_runs(docs, min_chars, min_docs), ["did", "version"], "left").withColumn("lines", F.split("text", "\n", -1))
    n = F.size("lines")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return out.select(
        "doc_id", n.cast("bigint").alias("n_lines"), F.size(dropped).cast("bigint").alias("n_dropped"), keep_runs(n, dropped).alias("keep"), "lines",
        "text"
    )


def kept_text() -> Column:
    whole = F.size("keep") == 1
    pieces = F.flatten(F.transform("keep", lambda r: F.slice("lines", r["start"] + 1, r["length"])))
    return F.when(whole & (F.col("n_dropped") == 0), F.col("text")).otherwise(F.array_join(pieces, "\n"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text().cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.keeper AS lost FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

"""Operator 13: codes of vectors by product quantisation, found by exponion search.

Vectors become integers, floor(``SCALE`` * x), and are cut into equal parts; each part position has
a codebook that starts as that part of the vectors of the least ids. A round gives every part the
nearest entry (squared distance, ties to the lower index) and moves each entry to the floor of the
mean of its parts. A search starts at the part's entry of the round before, c, at distance u: an entry
nearer than c lies within 2u of c, so the list of entries sorted by their distance from c is read up
to there, and no further. All distances are squared integers, so nothing is lost by rounding.

Spark deals the vectors; what a task needs beside them is the codebooks (64 vectors), and what it
returns for a round is one sum a component of each entry. Each round is written to the shared folder
with the codes that the next one starts from.

A vector that is null or holds null or non-finite components is dropped; so is one with a component
beyond 2**24 (65,536 times the usual range), whose error would not fit into a long, and one whose
length isn't that of the least kept id or not a multiple of the number of parts. Ids may be null
(after all others) or repeat (the lesser vector first); repeated rows each give a row. Fewer vectors
than entries make a smaller codebook. Null labels are one label; a sum of errors beyond a long is
null. An empty table gives an empty result; columns other than the id, the vector and the label are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import store

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
LIMIT = 2**24
#: Labels whose sums are sent to every executor, some 40 bytes each; more of them are joined by a shuffle.
BROADCAST_LABELS = 100_000
CODED = "vec_id bigint, label int, v array<int>, codes binary, error bigint"


def whole_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, label, v (integers): the vectors that are kept, whatever their length."""
    sound = ~F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) > LIMIT / SCALE))
    v = F.transform(column, lambda x: F.floor(x.cast("double") * SCALE).try_cast("int"))  # filters may run in any order
    return vectors.where(F.col(column).isNotNull() & sound).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"), v.alias("v")
    )


def first_books(kept: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Codebooks (part, entry, component) of the least ids; None without vectors."""
    order = (F.col("vec_id").asc_nulls_last(), F.col("v"))
    able = kept.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    least = [r.v for r in able.select("vec_id", "v").orderBy(*order).limit(entries).collect()]
    if len({len(v) for v in least}) > 1:
        least = [r.v for r in able.where(F.size("v") == len(least[0])).select("vec_id", "v").orderBy(*order).limit(entries).collect()]
    if not least:
        return None
    return np.array(least, np.int64).reshape(len(least), parts, -1).transpose(1, 0, 2).copy()


class Search:
    """Nearest entries of each part position's codebook, from a starting entry."""

    def __init__(self, books: np.ndarray) -> None:
        self.parts, self.entries, self.width = books.shape
        self.flat = books.reshape(-1, self.width)
        between = ((books[:, :, None] - books[:, None]) ** 2).sum(3)
        order = np.argsort(between, axis=2, kind="stable")
        self.near = order.reshape(-1, self.entries)
        self.apart = np.take_along_axis(between, order, 2).reshape(-1, self.entries)

    def __call__(self, vectors: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances), a column a part, of (n, dimension) integers."""
        x = vectors.reshape(-1, self.width)
        book = np.tile(np.arange(self.parts) * self.entries, len(vectors))
        code = start.reshape(-1).astype(np.int64)
        row = book + code
        least = ((x - self.flat[row]) ** 2).sum(1)
        radius, open_ = 4 * least, np.arange(len(x))
        for k in range(self.entries):
            open_ = open_[self.apart[row[open_], k] <= radius[open_]]
            if not len(open_):
                break
            j = self.near[row[open_], k]
            d = ((x[open_] - self.flat[book[open_] + j]) ** 2).sum(1)
            better = (d < least[open_]) | ((d == least[open_]) & (j < code[open_]))
            at = open_[better]
            least[at], code[at] = d[better], j[better]
        return code.reshape(-1, self.parts), least.reshape(-1, self.parts)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _old_codes(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts)


def assign(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """Codes and errors of every vector; ``codes`` of an earlier round, if any, are where the search starts."""
    parts, _, width = books.shape
    coded = "codes" in kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(books)
        for batch in batches:
            if batch.num_rows:
                start = _old_codes(batch, parts) if coded else np.zeros((batch.num_rows, parts), np.uint8)
                codes, least = search(_matrix(batch.column("v"), parts * width), start)
                packed = [c.tobytes() for c in codes.astype(np.uint8)]
                yield pa.record_batch(
                    [batch.column("vec_id"), batch.column("label"), batch.column("v"), pa.array(packed, pa.binary()), pa.array(least.sum(1))],
                    names=["vec_id", "label", "v", "codes", "error"],
                )

    return kept.where(F.size("v") == parts * width).mapInArrow(run, CODED)


def moved(coded: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry at the floor of the mean of its parts; unused ones where they are."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if batch.num_rows:
                row = (_old_codes(batch, parts) + np.arange(parts) * entries).reshape(-1)
                np.add.at(total, row, _matrix(batch.column("v"), parts * width).reshape(-1, width))
                n += np.bincount(row, minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.record_batch([pa.array(used), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["row", "n", "total"])

    sums = coded.select("v", "codes").mapInArrow(run, "row bigint, n bigint, total array<bigint>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = sums.select("row", "n", F.posexplode("total").alias("at", "x")).groupBy("row", "at").agg(F.sum("n").alias("n"), exact("x"))
    out = books.reshape(-1, width).copy()
    for r in sums.collect():  # at most a row a component of the codebooks
        out[r.row, r["at"]] = int(r.x) // r.n
    return out.reshape(books.shape)


def compress(vectors: DataFrame, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, v, codes (a byte a part) and error of every kept vector; the codebooks). ``entries``
    is 256 at most."""
    kept = whole_vectors(vectors, column)
    books = first_books(kept, parts, entries)
    if books is None:
        return vectors.sparkSession.createDataFrame([], CODED), None
    for _ in range(rounds):
        kept = store(assign(kept, books), "codes")
        books = moved(kept, books)
    return store(assign(kept, books), "codes"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    text = ",".join(map(str, books.reshape(-1).tolist())) if books is not None else ""
    total = F.try_sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(total.alias("total"))
    few = sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", F.expr("try_cast(total AS bigint)").alias("label_error"),
        F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256")
    )


def _op13_sql() -> str:
    assigned = lambda c: f"""SELECT v.rid, v.part, min(CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 64 + c.entry) AS k
      FROM v JOIN {c} c USING (part) GROUP BY v.rid, v.part"""  # noqa: E731
    means = lambda a, c: f"""SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM {c} c LEFT JOIN (
      SELECT part, entry, list(m ORDER BY i) AS x FROM (SELECT part, k % 64 AS entry, i, CAST(floor(sum(y) / count(*)) AS BIGINT) AS m
        FROM (SELECT part, k, unnest(x) AS y, unnest(range(len(x))) AS i FROM {a} JOIN v USING (rid, part)) GROUP BY ALL) GROUP BY ALL) m USING (part, entry)"""  # noqa: E731
    return f"""
WITH w AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT rid, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS x FROM w, range(16) r(part)),
c0 AS MATERIALIZED (SELECT part, rid AS entry, x FROM v WHERE rid < 64),
a0 AS MATERIALIZED ({assigned("c0")}), c1 AS MATERIALIZED ({means("a0", "c0")}),
a1 AS MATERIALIZED ({assigned("c1")}), c2 AS MATERIALIZED ({means("a1", "c1")}), a2 AS MATERIALIZED ({assigned("c2")}),
coded AS (SELECT rid, string_agg(printf('%02x', k % 64), '' ORDER BY part) AS code, CAST(sum(k // 64) AS BIGINT) AS error FROM a2 GROUP BY rid),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS s FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM coded JOIN w USING (rid), books
"""


OP13_SQL = _op13_sql()

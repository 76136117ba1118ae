"""Files of any file system that Spark reaches: names, small documents, and hashes taken in blocks where the files lie.

The driver holds names and documents, never data. A file is hashed by one task in blocks of
``BLOCK`` bytes, so that a recording of any length takes as little memory as a short one; on
file systems that Arrow doesn't know Spark itself reads the files, whole (up to 2 GB each).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 4 << 20
#: Schemes of file systems that Arrow opens, as it names them.
STREAMED = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def hadoop(spark: SparkSession, path: str):
    """Spark's file system for a path, and the path in its own form."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop(spark, path)
    return fs.exists(p)


def qualified(spark: SparkSession, path: str) -> str:
    return hadoop(spark, path)[1].toString()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    fs, p = hadoop(spark, path)
    out = fs.create(p, overwrite)
    out.write(bytearray(text.encode()))
    out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    """A JSON document as it is: manifests, side files, configurations."""
    fs, p = hadoop(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)))
    finally:
        stream.close()


def move(spark: SparkSession, source: str, target: str) -> None:
    """One rename, which commits all that ``source`` holds; never onto something that exists."""
    fs, a = hadoop(spark, source)
    _, b = hadoop(spark, target)
    fs.mkdirs(b.getParent())
    if fs.exists(b) or not fs.rename(a, b):
        raise FileExistsError(f"{target} can't be made: something else is there")


def _hashed(header: int | None):
    def digest(uri: str) -> str:
        scheme, _, rest = uri.partition(":")
        if STREAMED[scheme] == "file":
            fs, at = pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
        else:
            fs, at = pyarrow.fs.FileSystem.from_uri(f"{STREAMED[scheme]}:{quote(rest, safe='/:@')}")
        h, left = hashlib.sha256(), header
        with fs.open_input_stream(at, compression=None) as stream:
            while block := stream.read(BLOCK if left is None else min(BLOCK, left)):
                h.update(block)
                if left is not None:
                    left -= len(block)
        return h.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, uri in enumerate(batch.column("path").to_pylist()):
                yield pa.record_batch([*batch.slice(i, 1).columns, pa.array([digest(uri)])], names=[*batch.schema.names, "sha256"])

    return run


def hashes(spark: SparkSession, paths: str | list[str], header: int | None = None) -> DataFrame:
    """path, bytes and sha256 (of the first ``header`` bytes, if given) of files, or of all below folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    paths = [paths] if isinstance(paths, str) else paths
    if {hadoop(spark, p)[0].getUri().getScheme() for p in paths} <= set(STREAMED):
        return found.select("path", F.col("length").alias("bytes")).mapInArrow(_hashed(header), "path string, bytes bigint, sha256 string")
    content = F.col("content") if header is None else F.substring("content", 1, header)
    return found.select("path", F.col("length").alias("bytes"), F.sha2(content, 256).alias("sha256"))


def below(spark: SparkSession, root: str) -> DataFrame:
    """file (its path below ``root``), bytes and sha256 of each data file; names that begin with _ or . are not data."""
    start = len(hadoop(spark, root)[1].toUri().getPath().rstrip("/")) + 2
    plain = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return hashes(spark, root).withColumn("_plain", plain).select(F.expr(f"substr(_plain, {start})").alias("file"), "bytes", "sha256")

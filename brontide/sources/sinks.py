"""Sinks: tables with a manifest of file hashes, resumable and write-once outputs, failure records.

Data is written by Spark; file systems are reached through Spark's own interface, so paths may
be of any kind that it reads. What the driver writes is small: a manifest, a record.

A table and its manifest become visible by one rename: both are made in a staging folder beside
the target, which a later run of the same table takes over if an earlier one died. At no time is
there a table without a manifest, or half a table.
"""

from __future__ import annotations

import json
import traceback
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import below as file_hashes
from .files import exists, hadoop, move, read_json, write_text
from .provenance import identity

MANIFEST = "_manifest.json"


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Many JSON documents, a row each, under a declared schema; what is not JSON stops the job."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_rows(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Rows that the driver has, as CSV under the names of the first one's keys; never over a folder that exists."""
    if not rows or any(set(r) != set(rows[0]) for r in rows):
        raise ValueError("rows must have one set of names")
    names = list(rows[0])
    text = [tuple(None if r[n] is None else str(r[n]) for n in names) for r in rows]
    spark.createDataFrame(text, ", ".join(f"`{n}` string" for n in names)).coalesce(1).write.option("header", True).mode("errorifexists").csv(path)


def manifest_of(spark: SparkSession, path: str) -> dict:
    return read_json(spark, f"{path}/{MANIFEST}")


def write_table(df: DataFrame, path: str, kind: str, config: dict, dependencies: dict[str, str], partition_by: tuple[str, ...] = ()) -> dict:
    """Parquet, losslessly, with a manifest of its identity and file hashes. A table that is there
    under another identity is refused, as is a folder without a manifest; under the same identity
    the table stays as it is."""
    spark, path = df.sparkSession, path.rstrip("/")
    who = identity(kind, config, dependencies)
    if exists(spark, path):
        if not exists(spark, f"{path}/{MANIFEST}"):
            raise ValueError(f"{path} is no table of this sink")
        known = manifest_of(spark, path)
        if known["identity"] != who:
            raise ValueError(f"{path} was made under another configuration")
        return known
    staged = f"{path}.staged-{who[:12]}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(staged)
    files = [r.asDict() for r in file_hashes(spark, staged).orderBy("file").collect()]  # one a file
    spec = {"identity": who, "kind": kind, "config": config, "dependencies": dependencies, "files": files}
    write_text(spark, f"{staged}/{MANIFEST}", json.dumps(spec, indent=1, sort_keys=True))
    move(spark, staged, path)
    return spec


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that the manifest of ``path`` lists otherwise than they are, or that only one side has."""
    listed = manifest_of(spark, path)["files"]
    a = spark.createDataFrame([(f["file"], f["sha256"]) for f in listed], "file string, listed string")
    b = file_hashes(spark, path).select("file", F.col("sha256").alias("found"))
    return a.join(b, "file", "full_outer").where(~F.col("listed").eqNullSafe(F.col("found")))


def resume_into(todo: DataFrame, path: str, keys: list[str], make) -> DataFrame:
    """Append ``make(rows)`` for the rows of ``todo`` whose keys the table at ``path`` lacks; back comes
    the whole table. Each run's rows are a folder of their own below ``path``, made aside and moved
    there by one rename: what is there is done, and what a run that died has left does not count.
    ``make`` must not depend on the rows there are: it is called on none to learn the columns."""
    spark, path = todo.sparkSession, path.rstrip("/")
    made = make(todo.limit(0)).schema
    fs, p = hadoop(spark, path)
    fs.mkdirs(p)

    def table() -> DataFrame:
        runs = [f"{path}/{s.getPath().getName()}" for s in fs.listStatus(p) if s.getPath().getName().startswith("run-")]
        return spark.read.schema(made).parquet(*runs) if runs else spark.createDataFrame([], made)

    left = todo.join(table().select(*keys).distinct(), keys, "left_anti")
    if not left.isEmpty():
        name = uuid.uuid4().hex
        make(left).write.parquet(f"{path}/_making-{name}")
        move(spark, f"{path}/_making-{name}", f"{path}/run-{name}")
    return table()


def recorded(spark: SparkSession, path: str, name: str, work):
    """``work()``; if it fails, a record of that is written before the error goes on."""
    try:
        return work()
    except Exception as e:
        record = {"name": name, "error": type(e).__name__, "message": str(e)[:2000], "trace": traceback.format_exc()[-4000:]}
        write_text(spark, f"{path}/{name}.failure.json", json.dumps(record, indent=1), overwrite=True)
        raise


def frozen(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Hashes of every file of earlier tables, all of which must be as their manifests say."""
    out = {}
    for p in paths:
        if not changed_files(spark, p).isEmpty():
            raise ValueError(f"{p} is not as its manifest says")
        out |= {f"{p}/{f['file']}": f["sha256"] for f in manifest_of(spark, p)["files"]}
    return out


def metadata_identity(spark: SparkSession, manifest: str) -> str:
    """The identity of a set of tables, after all of it has been hashed again. ``manifest``: a document
    with tables (name to path and sha of the table's manifest) and the identity of the rest."""
    spec = read_json(spark, manifest)
    body = {k: v for k, v in spec.items() if k != "metadata_identity"}
    if identity("metadata", body, {}) != spec["metadata_identity"]:
        raise ValueError("the manifest is not what its identity stands for")
    for path, who in body["tables"].items():
        if manifest_of(spark, path)["identity"] != who or not changed_files(spark, path).isEmpty():
            raise ValueError(f"{path} has changed")
    return spec["metadata_identity"]


def write_metadata(spark: SparkSession, manifest: str, tables: dict[str, DataFrame], config: dict) -> str:
    """All tables, then a manifest over them; the tables' own checks must have passed before."""
    made = {path: write_table(df, path, "table", config, {})["identity"] for path, df in tables.items()}
    body = {"tables": made, "config": config}
    who = identity("metadata", body, {})
    write_text(spark, manifest, json.dumps(body | {"metadata_identity": who}, indent=1, sort_keys=True))
    return who

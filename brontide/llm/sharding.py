"""Operator 6: shards of target size by size-tiered compaction.

Arrivals are appended as small immutable runs, each with the rows of one task in their
order. A compaction starts from the files of the last committed version, in their order,
with the new runs behind them. Files sort into tiers by the logarithm of their size. A file
below the target is merged with its successor once that is of its tier or a larger one, which
may make a pair of the next tier, and so on; what has about the target size stays as it is.
So below it each file that is left is of a higher tier than the next one, a row is
rewritten about once a tier and at most once a compaction, and only successive files are
merged, so that rows keep the order of their runs. Files are written under a name of their
own, each by one task, and a version of the manifest that lists them all, with sizes, is
committed by one rename onto a name that must be free; if another writer has committed meanwhile, the merges are planned anew from that
version. Readers see the old version or the new one.

Plans are made on the driver, on one entry a file. Rows are kept whole, with all their
columns, null or not, repeated or not; columns that an arrival lacks are null there. Texts
of any length are one row. Columns may have any names; where they are those of the two
that readers get beside them, readers' have further underscores. An empty table commits a
manifest without new files.
"""

from __future__ import annotations

import json
import math
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import shared_dir

SHARD, ROW = "_shard_no", "_row"
FULL = 0.75  # of the target: files from here on stay, as merged rows often take less room than their runs
BROADCAST_FILES = 100_000  # entries of some 150 bytes: at most 15 MB; beyond, the join shuffles
#: A file's path below the root.
WITHIN = "((?:runs|shards)/[0-9a-f]{32}/.*)$"


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many further underscores as it takes to be none of ``taken``."""
    low = {t.lower() for t in taken}
    out = []
    for n in names:
        while n.lower() in low:
            n += "_"
        out.append(n)
    return out


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def file_order(docs: DataFrame) -> list[Column]:
    """The order in which the rows of a stored table were written, which a scan does not keep:
    it reads large files first and packs small ones together."""
    meta = docs.metadataColumn("_metadata")
    name = meta["file_name"]
    return [F.length(F.regexp_extract(name, "^part-(\\d+)", 1)), name, meta["row_index"]]


def _small(table: DataFrame, n: int) -> DataFrame:
    """A table of ``n`` files, broadcast if it is within the bound."""
    return F.broadcast(table) if n <= BROADCAST_FILES else table


def append_run(docs: DataFrame, root: str, run_rows: int = 20_000, order: list[Column] | None = None) -> str:
    """Write arrivals as small runs, in ``order`` or else without a shuffle; the folder that holds them."""
    path = f"{root}/runs/{uuid.uuid4().hex}"
    if order:
        names = free_names(docs.columns, *[f"_order_{i}" for i in range(len(order))])
        docs = docs.select(
            "*", *[c.alias(n) for c, n in zip(order, names, strict=True)]
        ).repartitionByRange(*names).sortWithinPartitions(*names).drop(*names)
    docs.write.option("maxRecordsPerFile", run_rows).option("compression", "zstd").parquet(path)
    return path


def list_files(spark: SparkSession, path: str, schema: StructType) -> list[dict]:
    """path (below the root) and bytes of the files of a folder that have rows, in the order of their writing."""
    rows = spark.read.schema(schema).parquet(path)
    meta = rows.metadataColumn("_metadata")
    files = rows.select(
        F.regexp_extract(meta["file_path"], WITHIN, 1).alias("path"), meta["file_size"].alias("bytes")
    ).groupBy("path").agg(F.max("bytes").alias("bytes")).collect()
    number = lambda f: [int(x) for x in re.search(r"/part-(\d+)-.*?(?:[.-]c(\d+))?\.[^/-]*$", f["path"]).groups("0")]
    return sorted(({"path": r.path, "bytes": r.bytes} for r in files), key=number)


def plan_merges(files: list[dict], target_bytes: int, fan: int) -> list[list[dict]]:
    """The files, in their order, in groups: those of several are to be merged, single ones stay."""
    size = lambda g: sum(f["bytes"] for f in g)
    tier = lambda g: int(math.log(max(size(g), 1), fan) + 1e-9)
    done: list[list[dict]] = []
    open_: list[list[dict]] = []  # below the target, tiers falling

    def push(group):
        while open_ and tier(open_[-1]) <= tier(group):
            group = open_.pop() + group
            n = 0
            for i, f in enumerate(group):
                n += f["bytes"]
                if n >= target_bytes:  # complete; what is behind it goes on
                    done.extend([*open_, group[: i + 1]])
                    open_.clear()
                    group = group[i + 1 :]
                    break
            if not group:
                return
        open_.append(group)

    for f in files:
        if f["bytes"] >= FULL * target_bytes:
            done.extend([*open_, [f]])
            open_.clear()
        else:
            push([f])
    return done + open_


def merge(spark: SparkSession, groups: list[list[dict]], root: str, schema: StructType) -> list[dict]:
    """The files of the groups, those of several merged into one."""
    many = [(k, g) for k, g in enumerate(groups) if len(g) > 1]
    if not many:
        return [f for g in groups for f in g]
    rows = spark.read.schema(schema).parquet(*[f"{root}/{f['path']}" for _, g in many for f in g])
    meta = rows.metadataColumn("_metadata")
    path_, shard_, run_, row_ = free_names(schema.names, "_path", SHARD, "_run", ROW)
    plan = spark.createDataFrame(
        [(f["path"], n, i) for n, (_, g) in enumerate(many) for i, f in enumerate(g)], f"`{path_}` string, `{shard_}` int, `{run_}` int"
    )
    rows = rows.select("*", F.regexp_extract(meta["file_path"], WITHIN, 1).alias(path_), meta["row_index"].alias(row_)).join(
        _small(plan, sum(len(g) for _, g in many)), path_
    )
    path = f"{root}/shards/{uuid.uuid4().hex}"
    dealt = rows.repartitionById(len(many), F.col(shard_)).sortWithinPartitions(shard_, run_, row_)  # a task a shard
    dealt.drop(path_, run_, row_).write.partitionBy(shard_).option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(path)
    merged = {many[int(f["path"].split("/")[2].split("=")[1])][0]: f for f in list_files(spark, path, schema)}
    return [merged[k] if len(g) > 1 else g[0] for k, g in enumerate(groups)]


def last_version(spark: SparkSession, root: str) -> dict:
    fs, folder = _fs(spark, f"{root}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    newest = max((n for n in names if n.startswith("v")), key=lambda n: int(n[1:-5]), default=None)
    if newest is None:
        return {"version": 0}
    text = spark.read.text(f"{root}/manifest/{newest}", wholetext=True).first()
    return json.loads(text.value)


def both(a: StructType, b: StructType) -> StructType:
    """The columns of two arrivals; a name may not have two types."""
    types = {f.name: f.dataType for f in a.fields}
    for f in b.fields:
        if types.get(f.name, f.dataType) != f.dataType:
            raise ValueError(f"column {f.name} has another type than in the committed shards")
    return StructType([*a.fields, *[f for f in b.fields if f.name not in types]])


def compact(spark: SparkSession, run_dir: str, root: str, schema: StructType, target_bytes: int = 128 << 20, fan: int = 4) -> dict:
    """Merge the last version's files and the runs of a folder, and commit the next version of
    the manifest; the version committed."""
    runs = list_files(spark, run_dir, schema)
    while True:
        last = last_version(spark, root)
        known = both(StructType.fromJson(last["schema"]), schema) if "schema" in last else schema
        files = merge(spark, plan_merges(last.get("files", []) + runs, target_bytes, fan), root, known)
        entry = commit(
            spark, root, {"files": files, "n_shards": len(files), "schema": known.jsonValue(), "target_bytes": target_bytes}, last["version"]
        )
        if entry:
            return entry


def commit(spark: SparkSession, root: str, entry: dict, base: int | None = None) -> dict | None:
    """Publish ``entry`` as the next version, by a rename onto a name that must be free; with
    ``base``, only as the version after that one, else nothing comes back."""
    fs, folder = _fs(spark, f"{root}/manifest")
    fs.mkdirs(folder)
    while True:
        taken = [int(s.getPath().getName()[1:-5]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("v")]
        if base is not None and max(taken, default=0) != base:
            return None
        entry = entry | {"version": max(taken, default=0) + 1}
        tmp, final = (spark._jvm.org.apache.hadoop.fs.Path(folder, x) for x in (f"tmp-{uuid.uuid4().hex}", f"v{entry['version']:08d}.json"))
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        out.close()
        if _rename_to_free(spark, fs, tmp, final):
            return entry
        fs.delete(tmp, False)


def _rename_to_free(spark: SparkSession, fs, tmp, final) -> bool:
    """Rename, unless the target exists. Where the file system has the newer interface its rename
    itself refuses; else the target is looked up before."""
    jvm = spark._jvm
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(tmp).toUri(), spark._jsc.hadoopConfiguration())
    except Py4JJavaError:  # no such interface
        return not fs.exists(final) and fs.rename(tmp, final)
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.NONE
    try:
        context.rename(fs.makeQualified(tmp), fs.makeQualified(final), how)
    except Py4JJavaError as e:
        if fs.exists(tmp) and fs.exists(final):
            return False
        raise e
    return True


def read(spark: SparkSession, root: str, entry: dict) -> DataFrame:
    """The rows of a version, with ``_shard_no`` (the file's place in the manifest) and ``_row`` (the
    place in the file) as the last two columns, under :func:`free_names`."""
    schema = StructType.fromJson(entry["schema"])
    path_, shard_, row_ = free_names(schema.names, "_path", SHARD, ROW)
    if not entry["files"]:
        return spark.createDataFrame([], schema).withColumns({shard_: F.lit(0).cast("bigint"), row_: F.lit(0).cast("bigint")})
    rows = spark.read.schema(schema).parquet(*[f"{root}/{f['path']}" for f in entry["files"]])
    meta = rows.metadataColumn("_metadata")
    numbers = spark.createDataFrame([(f["path"], n) for n, f in enumerate(entry["files"])], f"`{path_}` string, `{shard_}` bigint")
    rows = rows.select(
        "*", F.regexp_extract(meta["file_path"], WITHIN, 1).alias(path_), meta["row_index"].alias(row_)
    ).join(_small(numbers, len(entry["files"])), path_)
    return rows.select(*[F.col(f"`{c}`") for c in schema.names], shard_, row_)


def shard(
    docs: DataFrame, root: str | None = None, target_bytes: int = 128 << 20, fan: int = 4, run_rows: int = 20_000, order: list[Column] | None = None
) -> tuple[DataFrame, dict]:
    """``docs`` as an arrival at ``root``: all rows of the version committed, earlier arrivals
    included, as ``read`` gives them, and the manifest's entry."""
    spark = docs.sparkSession
    root = root or f"{shared_dir(spark)}/sharded-{uuid.uuid4().hex}"
    entry = compact(spark, append_run(docs, root, run_rows, order), root, docs.schema, target_bytes, fan)
    return read(spark, root, entry), entry


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, entry = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", F.col(out.columns[-2]).alias("shard"), F.col(out.columns[-1]).alias("row_in_shard"),
        F.lit(entry["version"]).cast("bigint").alias("manifest_version")
    )

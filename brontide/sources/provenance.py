"""Content-addressed artifacts: identity, staleness, write-once and cached tables.

An artifact's side file names what it was made from and the hashes of all of it, so that side
files form a graph. Its state is found in two steps: the graph is read (documents of a few
hundred bytes), then all files in it are hashed in one job, each once, however many paths
lead to it; what is left is a walk over the graph in which no file is opened.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from . import files as X

SIDE = ".provenance.json"


def sha256(spark: SparkSession, path: str, header_bytes: int | None = None) -> str:
    """Hash of one file, or of its first bytes, taken in blocks where it lies."""
    return X.hashes(spark, [str(path)], header_bytes).first().sha256


def identity(kind: str, config: dict, dependencies: dict[str, str]) -> str:
    """Hash of everything an artifact follows from."""
    return hashlib.sha256(json.dumps([kind, config, dependencies], sort_keys=True).encode()).hexdigest()


def _hash_all(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Hashes of distinct files, in one job."""
    return {r.path: r.sha256 for r in X.hashes(spark, paths).select("path", "sha256").collect()} if paths else {}  # one a file


def stamp(spark: SparkSession, artifact: str, kind: str, config: dict, dependencies: list[str]) -> dict:
    """Write the side file: the artifact's hash and those of what it was made from."""
    me, *rest = (X.qualified(spark, str(p)) for p in (artifact, *dependencies))
    if lost := [p for p in (me, *rest) if not X.exists(spark, p)]:
        raise FileNotFoundError(", ".join(lost))
    found = _hash_all(spark, sorted({me, *rest}))
    hashes = {d: found[d] for d in rest}
    spec = {"kind": kind, "config": config, "dependencies": hashes, "identity": identity(kind, config, hashes), "sha256": found[me]}
    X.write_text(spark, f"{me}{SIDE}", json.dumps(spec, indent=1, sort_keys=True), overwrite=True)
    return spec


def statuses(spark: SparkSession, artifacts: list[str]) -> dict[str, str]:
    """current, stale, missing or unstamped, for each artifact; staleness of a dependency is inherited.
    Artifacts that depend on each other are an error."""
    roots = {a: X.qualified(spark, str(a)) for a in artifacts}
    sides: dict[str, dict | None] = {}
    there: set[str] = set()
    todo = list(roots.values())
    while todo:
        path = todo.pop()
        if path in sides:
            continue
        if X.exists(spark, path):
            there.add(path)
        sides[path] = X.read_json(spark, path + SIDE) if path in there and X.exists(spark, path + SIDE) else None
        todo += (sides[path] or {}).get("dependencies", {})
    found = _hash_all(spark, sorted(there))

    state: dict[str, str] = {}
    entered: set[str] = set()
    for root in roots.values():
        walk = [root]
        while walk:
            path = walk[-1]
            below = (sides[path] or {}).get("dependencies", {})
            if path in state:
                walk.pop()
            elif path not in entered:
                entered.add(path)
                for d in below:
                    if d in entered and d not in state:
                        raise ValueError(f"artifacts depend on each other: {d}")
                walk += [d for d in below if d not in state]
            else:
                walk.pop()
                state[path] = _state(path, sides[path], there, found, state)
    return {a: state[p] for a, p in roots.items()}


def _state(path: str, side: dict | None, there: set[str], found: dict[str, str], state: dict[str, str]) -> str:
    if path not in there:
        return "missing"
    if side is None:
        return "unstamped"
    as_made = found[path] == side["sha256"] and side["identity"] == identity(side["kind"], side["config"], side["dependencies"])
    fed = all(found.get(d) == h and state[d] in ("current", "unstamped") for d, h in side["dependencies"].items())
    return "current" if as_made and fed else "stale"


def status(spark: SparkSession, artifact: str) -> str:
    return statuses(spark, [artifact])[artifact]


def require_current(spark: SparkSession, artifact: str) -> None:
    if (s := status(spark, artifact)) != "current":
        raise ValueError(f"{artifact} is {s}")


def write_once(df: DataFrame, path: str) -> None:
    """A folder that exists is an error."""
    df.write.mode("errorifexists").parquet(path)


def cached(spark: SparkSession, df_of, root: str, kind: str, config: dict, dependencies: dict[str, str]) -> DataFrame:
    """The table made by ``df_of()``, kept under a name that follows from what it is made from."""
    path = f"{root}/{kind}-{identity(kind, config, dependencies)[:12]}"
    if not X.exists(spark, f"{path}/_SUCCESS"):
        df_of().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not done yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")

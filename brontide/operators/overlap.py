"""Joins of intervals with intervals, or with points, by an index of cells.

An interval of length n lies in cells of the least width 2**level >= n, of which it meets two at
most. Two intervals are compared at the higher of their levels, where either meets two cells at
most, so the join has an equality in key, level and cell, and what it compares are neighbours
whatever the lengths of the recordings; no join is on the key alone. Of the cells that two
intervals share, that in which the overlap begins reports the pair, so each comes once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stored

Span = tuple[Column, Column]


def point(t: Column) -> Span:
    return t, t + 1


def _leveled(df: DataFrame, keys: list[str], span: Span, name: str) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys])
    d = df.select(*keys, row.alias(name), span[0].cast("bigint").alias("_s"), span[1].cast("bigint").alias("_e")).where("_e > _s")
    return d.withColumn("_level", F.when(F.col("_e") - F.col("_s") == 1, 0).otherwise(F.length(F.bin(F.col("_e") - F.col("_s") - 1))))


def _in_cells(df: DataFrame, levels: list[int], name: str) -> DataFrame:
    """A row for each cell, at the interval's own level and the other side's higher ones."""
    higher = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x > F.col("_level"))
    d = df.withColumn("_l", F.explode(F.concat(F.array(F.col("_level")), higher)))
    d = d.withColumn("_cell", F.explode(F.expr("sequence(shiftright(_s, _l), shiftright(_e - 1, _l))")))
    return d.select(*[c for c in df.columns if c not in ("_s", "_e", "_level")], "_l", "_cell", *[F.col(c).alias(f"{c}_{name}") for c in ("_s", "_e", "_level")])


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], a_span: Span, b_span: Span, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Pairs of rows of equal keys whose intervals [start, end) overlap: keys and the other columns of
    each side as a struct. Empty intervals overlap nothing. Both sides are read twice, and stored."""
    sides = [stored(_leveled(d, keys, span, n), "spans") for d, span, n in ((a, a_span, names[0]), (b, b_span, names[1]))]
    levels = [sorted(r[0] for r in d.select("_level").distinct().collect()) for d in sides]  # at most 64
    x, y = _in_cells(sides[0], levels[1], "x"), _in_cells(sides[1], levels[0], "y")
    start = F.greatest("_s_x", "_s_y")
    # Merged, as the files' compressed size would let either side, exploded, pass for one to broadcast.
    j = x.join(y.hint("merge"), [*keys, "_l", "_cell"]).where(
        (F.col("_l") == F.greatest("_level_x", "_level_y")) & (start < F.least("_e_x", "_e_y")) & (F.col("_cell") == F.call_function("shiftright", start, F.col("_l")))
    )
    return j.select(*keys, *names)

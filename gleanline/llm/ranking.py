"""Exact ranks of rows inside groups of any size.

A *hot-cold split*: exact row counts per group send groups above ``heavy_rows`` to a
salted range sort and all others to an ordinary window; the results are unioned.

The range sort orders all rows of the heavy groups by (group, order, id). The range
partition is the salt: it splits a group wherever its sorted rows cross a partition
border, so that a group of millions of rows, also one whose rows tie in every order
column, is spread over many tasks. A row's rank is its place in its partition plus the
rows of its group in the partitions before it, which come from one count per (group,
partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, match

HEAVY_ROWS = 10_000
RANK = "__rank"


def sort_keys(order: list[tuple[str, str]], id_col: str) -> list[Column]:
    keys = [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in order]
    return [*keys, F.col(id_col).asc_nulls_last()]


def one_row_per_id(df: DataFrame, groups: list[str], order: list[tuple[str, str]], id_col: str) -> DataFrame:
    """Group, order and id columns only, rows of one id in a group counted once.

    Of copies that disagree in order columns one counts, the one with the greatest values
    (by the first column that differs). The result is read several times, so it is written.
    """
    columns = [c for c, _ in order]
    best = df.groupBy(*groups, id_col).agg(F.max(F.struct(*columns)).alias("__best"))
    return cut(best.select(*groups, id_col, *[F.col("__best")[c].alias(c) for c in columns]))


def rank_in_groups(rows: DataFrame, groups: list[str], order: list[tuple[str, str]], id_col: str, heavy_rows: int = HEAVY_ROWS, top: int | None = None) -> DataFrame:
    """``rows`` (one per id and group) with the exact rank from 1 in ``__rank``.

    ``order`` lists (column, "asc" | "desc"); nulls come last; ties are settled by
    ``id_col`` ascending. With ``top`` only ranks up to it are returned. Null group values
    form a group of their own. An empty input gives an empty result.
    """
    keys = sort_keys(order, id_col)
    counts = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
    heavy = cut(counts.filter(F.col("__n") > heavy_rows).select(*groups))

    light_rows = match(rows, heavy, groups, "left_anti")
    light = light_rows.withColumn(RANK, F.row_number().over(Window.partitionBy(*groups).orderBy(*keys)).cast("long"))
    if top is not None:
        light = light.filter(F.col(RANK) <= top)
    if heavy.isEmpty():
        return light

    by_group = [F.col(g).asc_nulls_last() for g in groups]
    hot = match(rows, heavy, groups, "left_semi")
    placed = cut(hot.repartitionByRange(*by_group, *keys).sortWithinPartitions(*by_group, *keys).withColumn("__pos", F.monotonically_increasing_id()).withColumn("__salt", F.shiftright("__pos", 33)))
    pieces = placed.groupBy(*groups, "__salt").agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if top is not None:
        pieces = pieces.filter(F.col("__before") < top)
    ranked = match(placed, pieces, [*groups, "__salt"]).select(*rows.columns, (F.col("__pos") - F.col("__first") + F.col("__before") + 1).alias(RANK))
    if top is not None:
        ranked = ranked.filter(F.col(RANK) <= top)
    return light.unionByName(ranked)

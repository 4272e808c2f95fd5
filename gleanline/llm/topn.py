"""Problem 1: the top N items of every group, however large the group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import HEAVY_ROWS, RANK, one_row_per_id, rank_in_groups


def top_n_per_group(df: DataFrame, groups: list[str], order: list[tuple[str, str]], id_col: str, n: int, heavy_rows: int = HEAVY_ROWS, rank_col: str = "rank") -> DataFrame:
    """The first ``n`` ids of each group with their rank: columns ``groups``, ``id_col``, ``rank_col``.

    Method: exact group counts split groups into hot ones (more than ``heavy_rows`` rows,
    salted range sort) and cold ones (ordinary window); results are unioned.

    Defined cases: null group values form one group; null order values come last; ties are
    settled by the id ascending, so the result doesn't depend on row order; rows repeated
    with the same id count once; a group with fewer than ``n`` ids gives all; an empty table
    gives no rows; ``n`` below 1 gives no rows. Other columns of ``df`` are never read, so
    their names can't clash.
    """
    rows = one_row_per_id(df, groups, order, id_col)
    best = rank_in_groups(rows, groups, order, id_col, heavy_rows, top=max(n, 0))
    return best.select(*groups, id_col, F.col(RANK).alias(rank_col))

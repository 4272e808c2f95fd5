"""Problem 2: cap the records of dominant contributors, by count and by share of the output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, match
from .ranking import HEAVY_ROWS, RANK, one_row_per_id, rank_in_groups


def water_levels(counts: DataFrame, scopes: list[str], max_share: float, max_count: int | None, min_keep: int = 1, count_col: str = "n", level_col: str = "level") -> DataFrame:
    """The number of records each contributor of a scope may keep: columns ``scopes``, ``level_col``.

    ``counts`` has ``scopes`` and ``count_col``, one row per contributor. Water-filling: with
    counts (already cut to ``max_count``) sorted ascending, the output at level L is
    sum(min(n, L)), and L is consistent if L <= max_share * that sum. The sum is concave in L,
    so the consistent levels are those up to one root. It lies in the piece between two
    neighbouring distinct counts, in which the sum is (records of contributors below) +
    L * (contributors above), and comes from one pass over the sorted histogram of counts.
    Where no level above zero is consistent (fewer than 1 / max_share contributors),
    ``min_keep`` records stay.
    """
    n = F.least(F.col(count_col), F.lit(max_count)) if max_count is not None else F.col(count_col)
    hist = counts.select(*scopes, n.alias("__c")).groupBy(*scopes, "__c").agg(F.count(F.lit(1)).alias("__m"))
    every = Window.partitionBy(*scopes)
    below = every.orderBy("__c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.select(
        *scopes,
        "__c",
        F.sum(F.col("__c") * F.col("__m")).over(below).alias("__kept"),
        (F.sum("__m").over(every) - F.sum("__m").over(below)).alias("__above"),
        F.max("__c").over(every).alias("__most"),
    )
    share, c, kept, above = F.lit(float(max_share)), F.col("__c"), F.col("__kept"), F.col("__above")
    # tiny slack: share * total of whole numbers must not fail by rounding
    fits = c <= share * (kept + above * c) + 1e-9
    root = F.floor(share * kept / (1 - share * above) + 1e-9)
    # of the counts that are consistent levels the greatest begins the piece with the root
    level = F.when((c == F.col("__most")) | (share * above >= 1), c).otherwise(F.greatest(c, root))
    found = hist.filter(fits).groupBy(*scopes).agg(F.max(F.struct("__c", level.alias("level")))["level"].alias("__level"))
    # below the smallest count the sum is L * contributors: consistent for every L or for none
    level = F.greatest(F.coalesce("__level", F.lit(0)), F.lit(min_keep)).cast("long")
    return match(hist.select(*scopes).distinct(), found, scopes, "left").select(*scopes, level.alias(level_col))


def over_cap(df: DataFrame, scopes: list[str], contributor: str, order: list[tuple[str, str]], id_col: str, max_count: int | None = None, max_share: float = 1.0, min_keep: int = 1, heavy_rows: int = HEAVY_ROWS, rank_col: str = "rank") -> DataFrame:
    """The records that go so that no contributor exceeds its cap: ``scopes``, ``contributor``, ``id_col``, ``rank_col``.

    Method: count the records per contributor and scope, solve the cap of each scope by
    water-filling, then rank only contributors above their cap, best ``order`` first, and
    return the ranks beyond the cap. Groups above ``heavy_rows`` are ranked by the salted
    range sort of ``ranking``.

    Defined cases: a null contributor is none and loses nothing; a null scope is a scope of
    its own; rows repeated with one id count once; null order values come last; ties are
    settled by the id; a single contributor, which no share limit below one can fit, keeps
    ``min_keep``; an empty table gives no rows. Other columns of ``df`` are never read.
    """
    groups = [*scopes, contributor]
    rows = one_row_per_id(df.filter(F.col(contributor).isNotNull()), groups, order, id_col)
    counts = cut(rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("__records")))
    levels = water_levels(counts, scopes, max_share, max_count, min_keep, "__records", "__level")
    over = cut(match(counts, levels, scopes).filter(F.col("__records") > F.col("__level")).select(*groups, "__level"))
    ranked = rank_in_groups(match(rows, over, groups, "left_semi"), groups, order, id_col, heavy_rows)
    return match(ranked, over, groups).filter(F.col(RANK) > F.col("__level")).select(*groups, id_col, F.col(RANK).alias(rank_col))


def capped(df: DataFrame, scopes: list[str], contributor: str, order: list[tuple[str, str]], id_col: str, **caps) -> DataFrame:
    """``df`` without the records that ``over_cap`` names; all of its columns and copies stay."""
    gone = over_cap(df, scopes, contributor, order, id_col, rank_col="__cap_rank", **caps)
    return match(df, gone.drop("__cap_rank"), [*scopes, contributor, id_col], "left_anti")

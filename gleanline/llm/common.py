"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_folder, shared_base, shared_folder, write_apart

__all__ = ["account_key", "community_key", "cut", "drop_folder", "item_key", "match", "row_pairs", "shared_base", "shared_path", "unused", "write_apart"]

shared_path = shared_folder

#: Classes of more rows than this are paired block by block.
LARGE_CLASS = 2000


def row_pairs(members: DataFrame, links: DataFrame, carry: list[str], alike: bool = True, large: int = LARGE_CLASS) -> DataFrame:
    """Rows of linked classes paired: ``carry``, ``id_a``, ``id_b``, the smaller id first.

    ``members`` (``carry``, doc, id) has every row once, ``links`` (a, b) every pair of classes
    once; with ``alike`` the rows of one class are pairs as well. Where classes have more than
    ``large`` rows, these are cut into blocks by their ids, and every two blocks meet by
    themselves, so that no task holds a whole class.
    """
    members = members.select(*carry, "doc", "id")
    sizes = members.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    big = cut(sizes.filter(F.col("n") > large).select("doc", F.ceil(F.col("n") / large).cast("int").alias("blocks")))
    links = links.select("a", "b", F.lit(0).alias("i"), F.lit(0).alias("j"))
    own = members.withColumn("block", F.lit(0))
    if alike:
        several = sizes.filter("n > 1").select(F.col("doc").alias("a"), F.col("doc").alias("b"), F.lit(0).alias("i"), F.lit(0).alias("j"))
        links = links.unionByName(several)
    if not big.isEmpty():
        own = members.join(big, "doc", "left").select(*carry, "doc", "id", F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.lit(0)).alias("block"))
        blocks = lambda c, n: big.select(F.col("doc").alias(c), F.col("blocks").alias(n))
        counted = links.select("a", "b").join(blocks("a", "p"), "a", "left").join(blocks("b", "q"), "b", "left")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
        links = counted.withColumn("i", each("p")).withColumn("j", each("q")).filter((F.col("a") != F.col("b")) | (F.col("i") <= F.col("j"))).select("a", "b", "i", "j")
    left = own.select(*carry, F.col("doc").alias("a"), F.col("block").alias("i"), F.col("id").alias("x"))
    right = own.select(F.col("doc").alias("b"), F.col("block").alias("j"), F.col("id").alias("y"))
    both = links.join(left, ["a", "i"]).join(right, ["b", "j"])
    # rows of one class and block meet twice, in either order
    once = (F.col("a") != F.col("b")) | (F.col("i") != F.col("j")) | (F.col("x") < F.col("y"))
    return both.filter(once & (F.col("x") != F.col("y"))).select(*carry, F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on null-safe equality of ``keys``: the columns of ``left``, then the others of ``right``."""
    renamed = right.select(*[F.col(c).alias(f"__right_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for c in keys:
        condition = condition & F.col(c).eqNullSafe(F.col(f"__right_{c}"))
    return left.join(renamed, condition, how).drop(*[f"__right_{c}" for c in keys])


def account_key(author: Column) -> Column:
    """One spelling per account: trimmed, lower-cased, without a leading ``u/`` or ``/u/``.

    Null, blank and ``[deleted]`` give null (no account).
    """
    key = F.regexp_replace(F.lower(F.trim(author)), r"^/?u/", "")
    return F.when((key != "") & (key != "[deleted]"), key)


def community_key(subreddit: Column) -> Column:
    """One spelling per community: trimmed, lower-cased, without ``r/`` or ``/r/``."""
    key = F.regexp_replace(F.lower(F.trim(subreddit)), r"^/?r/", "")
    return F.when(key != "", key)


def item_key(item_type: Column, item_id: Column) -> Column:
    """One spelling per item: its kind and bare base-36 id, from full names, bare ids and links."""
    bare = F.lower(F.trim(item_id))
    bare = F.regexp_replace(bare, r"[?#].*$", "")
    bare = F.regexp_replace(bare, r"/+$", "")
    bare = F.regexp_replace(bare, r"^.*/", "")
    bare = F.regexp_replace(bare, r"^t[0-9]_", "")
    return F.when(bare != "", F.concat_ws(":", F.lower(F.trim(item_type)), bare))


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (letter case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

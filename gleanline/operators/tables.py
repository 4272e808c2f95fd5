"""Mutations as pure functions: the table in, the table after the change out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def stamp(changed: Column, now: Column, column: str = "updated_at") -> Column:
    """The value of an update-time column: ``now`` where a row changed."""
    return F.when(changed, now).otherwise(F.col(column)).alias(column)


def insert_or_ignore(table: DataFrame, new: DataFrame, keys: list[str], arrival: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(table with the new rows, rejected new rows): known keys are ignored, of new ones with one key the first is taken."""
    w = Window.partitionBy(*keys).orderBy(*arrival)
    known = table.select(*keys, F.lit(True).alias("__known")).distinct()
    numbered = new.withColumn("__n", F.row_number().over(w)).join(known, keys, "left")
    fresh = F.col("__known").isNull() & (F.col("__n") == 1)
    taken = numbered.filter(fresh).select(*new.columns)
    return table.unionByName(taken, allowMissingColumns=True), numbered.filter(~fresh).select(*new.columns)


def valid_rows(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine with the names of failed ``checks``); a null check fails."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    marked = rows.withColumn("failed_checks", failed)
    return marked.filter(F.size("failed_checks") == 0).drop("failed_checks"), marked.filter(F.size("failed_checks") > 0)


def upsert(table: DataFrame, new: DataFrame, keys: list[str], preserve: dict[str, object]) -> DataFrame:
    """New values win per row; columns in ``preserve`` keep the table's value, or get their default in new rows.

    ``new`` has one row per key. Columns that ``new`` lacks keep the table's value.
    """
    old = table.select(*[F.col(c).alias(f"__old_{c}") for c in table.columns])
    incoming = new.withColumn("__new", F.lit(True))
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__old_{k}") for k in keys])
    both = old.join(incoming, on, "full_outer")

    def value(c: str) -> Column:
        if c in preserve:
            return F.when(F.col(f"__old_{keys[0]}").isNull(), F.lit(preserve[c])).otherwise(F.col(f"__old_{c}"))
        if c in new.columns:
            return F.when(F.col("__new").isNotNull(), F.col(c)).otherwise(F.col(f"__old_{c}"))
        return F.col(f"__old_{c}")

    return both.select(*[value(c).cast(table.schema[c].dataType).alias(c) for c in table.columns])


def update_where(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Rows for which ``where`` is true get ``values``; null counts as not true."""
    hit = F.coalesce(where, F.lit(False))
    return table.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def delete_where(table: DataFrame, where: Column) -> DataFrame:
    return table.filter(~F.coalesce(where, F.lit(False)))


def affected(table: DataFrame, where: Column, name: str = "affected") -> DataFrame:
    return table.agg(F.count_if(F.coalesce(where, F.lit(False))).alias(name))


def derived_rows(source: DataFrame, table: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """``table`` with a row, made of ``columns``, for every key of ``source`` that it lacks."""
    new = source.select(*[c.alias(n) for n, c in columns.items()])
    missing = new.filter(F.col(key).isNotNull()).dropDuplicates([key]).join(table.select(key).distinct(), key, "left_anti")
    return table.unionByName(missing, allowMissingColumns=True)

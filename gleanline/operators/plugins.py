"""Functions of the user's own over rows: matchers, scorers and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class InvalidResult(ValueError):
    """A scorer returned something that its checks refuse."""


def apply_batches(rows: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str, visible: list[str] | None = None) -> DataFrame:
    """``function`` over Arrow batches; it sees the ``visible`` columns only."""
    source = rows.select(*visible) if visible else rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield function(batch)

    return source.mapInPandas(run, schema)


def score_missing(rows: DataFrame, result: str, visible: list[str], scorer: Callable[[pd.DataFrame], pd.Series], check: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """``rows`` with ``result`` filled where it is null; rows that have one are never scored again.

    The scorer sees the ``visible`` columns only. A value that ``check`` refuses ends the
    job, unless it is null: null means that the scorer gave no result.
    """
    kind = rows.schema[result].dataType
    known = rows.filter(F.col(result).isNotNull())
    missing = rows.filter(F.col(result).isNull())

    @F.pandas_udf(kind)
    def scored(*columns: pd.Series) -> pd.Series:
        values = scorer(pd.DataFrame(dict(zip(visible, columns))))
        if check is not None and not check(values.dropna()).all():
            raise InvalidResult(f"{result}: a value is out of range")
        return values

    return known.unionByName(missing.withColumn(result, scored(*[F.col(c) for c in visible])))


def analyzed(rows: DataFrame, key: str, visible: list[str], analyzer: Callable[[pd.DataFrame], pd.DataFrame], schema: str, check: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """``key`` and the columns of ``schema`` that the analyzer gives for each row; it sees the ``visible`` columns only.

    A row that ``check`` refuses ends the job.
    """

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        found = analyzer(batch[visible].reset_index(drop=True))
        if len(found) != len(batch) or not check(found).all():
            raise InvalidResult("an analysis breaks its schema")
        return pd.concat([batch[[key]].reset_index(drop=True), found], axis=1)

    return apply_batches(rows, run, f"{key} {rows.schema[key].dataType.simpleString()}, {schema}", [key, *visible])


def in_range(low: int, high: int) -> Callable[[pd.Series], pd.Series]:
    return lambda values: values.between(low, high)


def prompt(parts: list[Column], separator: str = "\n\n") -> Column:
    """Non-empty parts joined; nulls and empty strings are left out."""
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(kept, separator)


def lines(parts: list[Column | str]) -> Column:
    """A template line by line; a null part shows as ``null``, an empty one as an empty line."""
    shown = [F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("null")) for p in parts]
    return F.concat_ws("\n", *shown)

"""Search terms of projects: long form, priority order, deduplication, batches, queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Term arrays of a project in order of priority.
CATEGORIES = ["keywords", "intent_phrases", "pain_phrases", "competitors", "hidden_keywords"]


def trimmed(text: Column) -> Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(text, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def clean_list(items: Column) -> Column:
    """Trimmed, blanks dropped, repetitions kept."""
    return F.filter(F.transform(items, trimmed), lambda x: x != "")


def distinct_list(items: Column) -> Column:
    """Trimmed, blanks dropped, the first of terms that differ only in case kept."""
    cleaned = clean_list(items)
    lowered = F.transform(cleaned, F.lower)
    return F.filter(cleaned, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def capped_list(items: Column, n: int) -> Column:
    """The first ``n`` of ``distinct_list``."""
    return F.slice(distinct_list(items), 1, n)


def long_terms(projects: DataFrame) -> DataFrame:
    """One row per term of each project: project_id, category, category_rank, ordinal, term (as written)."""

    def labelled(rank: int, category: str) -> Column:
        items = F.coalesce(F.col(category), F.array().cast("array<string>"))
        return F.transform(items, lambda x, i: F.struct(F.lit(category).alias("category"), F.lit(rank).alias("category_rank"), i.cast("int").alias("ordinal"), x.alias("term")))

    parts = [labelled(r, c) for r, c in enumerate(CATEGORIES)]
    return projects.select(F.col("id").alias("project_id"), F.explode(F.concat(*parts)).alias("t")).select("project_id", "t.*")


def search_terms(projects: DataFrame) -> DataFrame:
    """The terms a scan searches for, once each: project_id, position (from 0), term, category.

    All five lists in order of priority; trimmed, blanks dropped; of terms that differ only in
    case the first stays, in its own casing.
    """
    terms = long_terms(projects).withColumn("term", trimmed(F.col("term"))).filter("term <> ''")
    order = [F.col("category_rank"), F.col("ordinal")]
    first = Window.partitionBy("project_id", F.lower("term")).orderBy(*order)
    kept = terms.withColumn("n", F.row_number().over(first)).filter("n = 1")
    position = F.row_number().over(Window.partitionBy("project_id").orderBy(*order)) - 1
    return kept.select("project_id", position.alias("position"), "term", "category")


def term_batches(terms: DataFrame, size: int = 5) -> DataFrame:
    """``search_terms`` with the number of each term's batch."""
    return terms.withColumn("batch", F.floor(F.col("position") / size).cast("int"))


def search_query(term: Column) -> Column:
    """A term with a space is put in quotes."""
    return F.when(term.contains(" "), F.concat(F.lit('"'), term, F.lit('"'))).otherwise(term)


def request_grid(projects: DataFrame, terms: DataFrame) -> DataFrame:
    """Every community of a project with every query of it: an equi-join by project, no cross product."""
    communities = projects.select(F.col("id").alias("project_id"), F.explode("subreddits").alias("subreddit"))
    return communities.join(terms.select("project_id", "position", search_query(F.col("term")).alias("query")), "project_id")

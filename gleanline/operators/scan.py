"""Collection of items: listings to typed rows, search, caps, windows, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.display import absolute_link
from ..functions.text import token_text, tokens

WINDOW_DAYS, POSTS_PER_QUERY, POSTS_PER_COMMUNITY, COMMENTS_PER_POST = 7, 25, 50, 50


def typed_posts(raw: DataFrame, base: str) -> DataFrame:
    """Raw post listings to rows: missing texts empty, missing authors ``[deleted]``, missing counts 0, epoch seconds to time."""
    c = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    return raw.select(
        F.col("name").alias("id"), F.lit("post").alias("type"), "subreddit", c("title", "").alias("title"), c("selftext", "").alias("body"), c("author", "[deleted]").alias("author"), F.col("author_fullname").alias("author_id"),
        c("url", "").alias("url"), absolute_link(F.col("permalink"), base).alias("permalink"), c("score", 0).alias("score"), c("num_comments", 0).alias("num_comments"), F.timestamp_seconds("created_utc").alias("created_at"),
    )


def typed_comments(raw: DataFrame, base: str) -> DataFrame:
    """Raw comment listings to rows, as ``typed_posts``; the parent's full name becomes ``post_id``."""
    c = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    return raw.select(
        F.col("name").alias("id"), F.lit("comment").alias("type"), "subreddit", F.col("link_id").alias("post_id"), c("body", "").alias("body"), c("author", "[deleted]").alias("author"), F.col("author_fullname").alias("author_id"),
        absolute_link(F.col("permalink"), base).alias("permalink"), c("score", 0).alias("score"), F.timestamp_seconds("created_utc").alias("created_at"),
    )


def of_kind(listing: DataFrame, kind: str, column: str = "kind") -> DataFrame:
    return listing.filter(F.col(column) == kind)


def recent(items: DataFrame, now: Column | str, days: int = WINDOW_DAYS, column: str = "created_at") -> DataFrame:
    """Items of the last ``days`` days before ``now``, the bound included."""
    at = F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now
    return items.filter(F.col(column) >= at - F.make_dt_interval(F.lit(days)))


def first_per(items: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key; order columns have to make it unique."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return items.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def search(posts: DataFrame, grid: DataFrame, phrase: str = "term", limit: int = POSTS_PER_QUERY) -> DataFrame:
    """The newest posts per community and term that hold the term as a phrase, at most ``limit`` (1 to 100).

    A phrase is the term's words one after the other, letter case and signs between them
    ignored; a term without letters and digits is looked for as it is. The rows of ``grid``
    come with the id and time of each post; posts delivered more than once count once.

    Projects that look for the same term in the same community get the same posts, so every
    distinct (community, term) is searched once: posts meet terms by an equi-join on the
    community and the first word, which spreads a large community by its words, and only
    posts that hold the first word of a longer term are tested for the rest of it.
    """
    limit = min(max(limit, 1), 100)
    low = F.lower(F.trim(phrase)).alias("__low")
    wanted = grid.select("subreddit", low).distinct().withColumn("__words", tokens(F.col("__low")))
    text = F.lower(F.concat_ws(" ", "title", "body"))
    texts = posts.select("subreddit", "id", "created_at", text.alias("__text"))
    first = wanted.filter(F.size("__words") > 0).select("subreddit", F.element_at("__words", 1).alias("__word"), "__low", F.size("__words").alias("__n"), F.concat(F.lit(" "), F.array_join("__words", " "), F.lit(" ")).alias("__phrase"))
    words = texts.select("subreddit", "id", "created_at", F.explode(F.array_distinct(tokens(F.col("__text")))).alias("__word"))
    met = words.join(first, ["subreddit", "__word"])
    found = ["subreddit", "__low", "id", "created_at"]
    longer = met.filter("__n > 1").select(*found, "__phrase").distinct().join(texts.select("id", token_text(F.col("__text")).alias("__padded")), "id").filter(F.contains("__padded", F.col("__phrase")))
    literal = texts.join(wanted.filter((F.size("__words") == 0) & (F.col("__low") != "")).select("subreddit", "__low"), "subreddit").filter(F.contains("__text", F.col("__low")))
    hits = met.filter("__n = 1").select(*found).unionByName(longer.select(*found)).unionByName(literal.select(*found)).distinct()
    newest = first_per(hits, ["subreddit", "__low"], [F.col("created_at").desc(), F.col("id")], limit)
    return grid.withColumn("__low", low).join(newest, ["subreddit", "__low"]).drop("__low")


def kept_posts(found: DataFrame, arrival: list[Column], limit: int = POSTS_PER_COMMUNITY, scope: list[str] | None = None) -> DataFrame:
    """First ``limit`` results per community in order of arrival, then one row per post.

    The cap comes before the deduplication: a post found by several terms uses it up several times.
    """
    keys = [*(scope or []), "subreddit"]
    capped = first_per(found, keys, arrival, limit)
    return first_per(capped, [*(scope or []), "id"], arrival)


def comments_of(comments: DataFrame, posts: DataFrame, order: list[Column], limit: int = COMMENTS_PER_POST) -> DataFrame:
    """The first comments of each kept post (a semi-join), at most ``limit``, before any window filter."""
    return first_per(comments.join(posts.select(F.col("id").alias("post_id")).distinct(), "post_id", "left_semi"), ["post_id"], order, limit)

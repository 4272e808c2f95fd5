"""What the rules of communities say about promotion, and its join to rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases looked for in the lower-case text of a rule.
PROMOTION = ["self-promotion", "self promotion", "selfpromo", "self-promo", "promotion", "promote", "promoting", "advertising", "advertisement", "advertise", "spam", "marketing"]
CONDITIONAL = ["allowed with", "allowed if", "allowed on", "with mod", "with moderator", "mod approval", "moderator approval", "with permission", "flair required", "requires flair", "certain days", "specific day", "9:1", "90/10", "90-10", "ratio", "limited to", "once a", "once per", "no more than"]
BANNED = ["no self-promotion", "no self promotion", "no selfpromo", "no promotion", "no promoting", "no advertising", "no advertisement", "not allowed", "is not permitted", "prohibited", "will be banned", "will result in a ban", "strictly forbidden", "not permitted"]


def contains_any(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


# What a user reads about the rules of a community.
NO_RULES, NO_MENTION = "This subreddit has no posted rules.", "This subreddit's rules do not mention promotion, self-promotion, or advertising."
DECIDED = ["explicitly bans promotion", "allows promotion only under certain conditions", "mentions promotion"]


def rule_findings(rules: DataFrame) -> DataFrame:
    """Per community the badge, the first rule (by ordinal) that decides it and what is said about it."""
    text = F.lower(F.concat(F.coalesce("short_name", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    kind = F.when(~contains_any(text, PROMOTION), 9).when(contains_any(text, BANNED), 0).when(contains_any(text, CONDITIONAL), 1).otherwise(2)
    marked = rules.select("subreddit", F.struct(kind.alias("kind"), "ordinal", "short_name", "description").alias("r"))
    first = marked.groupBy("subreddit").agg(F.min("r").alias("r"))
    badge = F.when(F.col("r.kind") == 9, "without_rules").when(F.col("r.kind") == 0, "promo_not_safe").otherwise("promo_conditional")
    says = F.element_at(F.array(*map(F.lit, DECIDED)), F.least(F.col("r.kind"), F.lit(2)) + 1)
    told = F.concat(F.lit('Rule "'), F.coalesce("r.short_name", F.lit("")), F.lit('" '), says, F.lit(": "), F.coalesce("r.description", F.lit("")))
    explanation = F.when(F.col("r.kind") == 9, NO_MENTION).otherwise(told)
    return first.select("subreddit", badge.alias("badge"), F.when(F.col("r.kind") < 9, F.col("r.short_name")).alias("deciding_rule"), explanation.alias("explanation"))


def with_badge(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with the badge of their community and its explanation; communities without rules are ``without_rules``."""
    found = rule_findings(rules).select("subreddit", "badge", "explanation")
    return rows.join(found, "subreddit", "left").withColumns({"badge": F.coalesce("badge", F.lit("without_rules")), "explanation": F.coalesce("explanation", F.lit(NO_RULES))})

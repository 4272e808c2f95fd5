"""Readers of the stored tables with explicit columns, so that scans stay narrow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns a reader of each table sees unless it asks for others.
COLUMNS = {
    "projects": ["id", "user_id", "name", "website_url", "description", "keywords", "intent_phrases", "pain_phrases", "competitors", "hidden_keywords", "subreddits", "is_active", "created_at", "updated_at"],
    "sync_logs": ["id", "project_id", "user_id", "status", "leads_found", "error_message", "started_at", "completed_at", "created_at", "updated_at"],
    "subreddit_rules": ["subreddit", "ordinal", "short_name", "description"],
}


def read(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wanted = columns or COLUMNS.get(name)
    return df.select(*wanted) if wanted else df

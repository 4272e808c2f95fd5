"""A work queue as a table: every transition takes the table and gives the table after it.

The clock is a parameter. Updates that name rows bring them as a table of ids and values, so
that any number of rows changes in one join; a worker that ran twice over one batch finds
nothing left to do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .serving import oldest
from .tables import affected, stamp, update_where, upsert

RESULT = ["ai_qualified", "ai_score", "ai_match_type", "ai_lead_summary", "ai_match_reason", "ai_possible_competitor", "ai_possible_competitor_reason", "ai_provider", "ai_model"]
VISIBLE_MINUTES = 15
# Fixed value: the message of a row whose scorer may have been called before a crash.
UNCLEAR = "The scorer may have been called for this candidate before the worker crashed. Manual verification is required before any retry."


def in_scope(project_id: str | None) -> Column:
    return F.lit(True) if project_id is None else F.col("project_id") == project_id


def with_values(queue: DataFrame, values: DataFrame, now: Column) -> DataFrame:
    """Rows named by ``id`` in ``values`` (one row each) get its columns, null included, and a new ``updated_at``."""
    new = values.select("id", *[F.col(c).alias(f"__new_{c}") for c in values.columns if c != "id"], F.lit(True).alias("__hit"))
    both = queue.join(new, "id", "left")
    hit = F.col("__hit").isNotNull()
    changed = {c: F.when(hit, F.col(f"__new_{c}")).otherwise(F.col(c)).cast(queue.schema[c].dataType).alias(c) for c in values.columns if c != "id"}
    if "updated_at" in queue.columns:
        changed["updated_at"] = stamp(hit, now)
    return both.select(*[changed.get(c, F.col(c)) for c in queue.columns])


def claim(queue: DataFrame, now: Column, limit: int, project_id: str | None = None, per: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(queue, claimed rows): the ``limit`` oldest pending rows, per ``per`` if given, are being processed and count one attempt more."""
    waiting = queue.filter((F.col("status") == "pending") & in_scope(project_id))
    claimed = oldest(waiting, limit, per).withColumns({"status": F.lit("processing"), "processing_started_at": now, "attempt_count": F.col("attempt_count") + 1})
    after = with_values(queue, claimed.select("id", "status", "processing_started_at", "attempt_count"), now)
    return after, claimed


def mark_attempted(queue: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Stamped before the scorer is called, so that a crash after it can be told from one before it."""
    return with_values(queue, ids.select("id", now.alias("gemini_call_attempted_at")), now)


def record_results(queue: DataFrame, results: DataFrame, now: Column, complete: bool = False) -> DataFrame:
    """Result columns written; with ``complete`` the rows end in the same update and lose their error."""
    ended = [F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error_message")] if complete else []
    return with_values(queue, results.select("id", *[c for c in RESULT if c in results.columns], *ended), now)


def mark_completed(queue: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    return with_values(queue, ids.select("id", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error_message")), now)


def mark_failed(queue: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Rows of ``failures`` (id, error_message) fail and stay; nothing takes them up again."""
    return with_values(queue, failures.select("id", F.lit("failed").alias("status"), "error_message"), now)


def stale(now: Column, project_id: str | None = None, minutes: int = VISIBLE_MINUTES) -> tuple[Column, Column]:
    """(unclear, resettable): processed for longer than ``minutes`` with a call but no result, and all others."""
    late = (F.col("status") == "processing") & (F.col("processing_started_at") < now - F.make_dt_interval(mins=F.lit(minutes))) & in_scope(project_id)
    unclear = late & F.col("gemini_call_attempted_at").isNotNull() & F.col("ai_score").isNull()
    return unclear, late & ~unclear


def recover_stale(queue: DataFrame, now: Column, project_id: str | None = None, minutes: int = VISIBLE_MINUTES) -> tuple[DataFrame, DataFrame]:
    """(queue, number of rows reset): unclear rows fail, all other stale ones wait again; attempts stay as counted."""
    unclear, again = stale(now, project_id, minutes)
    values = {
        "status": F.when(unclear, "failed").otherwise("pending"),
        "error_message": F.when(unclear, UNCLEAR).otherwise(F.col("error_message")),
        "processing_started_at": F.when(unclear, F.col("processing_started_at")),
        "updated_at": now,
    }
    return update_where(queue, unclear | again, {c: v for c, v in values.items() if c in queue.columns}), affected(queue, again, "reset")


def with_project(candidates: DataFrame, projects: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(candidates with ``columns`` of their project, failures): a candidate whose user has no such project fails."""
    own = projects.select(F.col("id").alias("project_id"), "user_id", F.struct(*columns).alias("project"))
    both = candidates.join(own, ["project_id", "user_id"], "left")
    missing = F.concat(F.lit("Project "), F.col("project_id"), F.lit(" not found.")).alias("error_message")
    return both.filter("project is not null"), both.filter("project is null").select("id", missing)


def finish(queue: DataFrame, leads: DataFrame, results: DataFrame, failures: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(queue, leads) after a batch, in the order of the writes: results, leads of the qualified, completion, failures.

    ``results`` has the claimed rows with their result columns, one row per id. A lead that
    is there keeps its status.
    """
    recorded = record_results(queue, results, now)
    shared = [c for c in leads.columns if c in results.columns and c not in ("id", "status")]
    qualified = results.filter("ai_qualified").select(*shared)
    leads = upsert(leads, qualified, ["project_id", "reddit_item_id"], {"status": "new", "id": None})
    return mark_failed(mark_completed(recorded, results, now), failures, now), leads


def summary(results: DataFrame, failures: DataFrame) -> DataFrame:
    """processed, qualified, failed of a run."""
    rows = results.select(F.lit(1).alias("p"), F.coalesce(F.col("ai_qualified").cast("int"), F.lit(0)).alias("q"), F.lit(0).alias("f")).unionByName(failures.select(F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(1).alias("f")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(total("p").alias("processed"), total("q").alias("qualified"), total("f").alias("failed"))

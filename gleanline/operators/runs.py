"""The log of runs: start, end, what blocks a start, what may be said about an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .queue import with_values
from .serving import latest, stale
from .tables import update_where

# What a user may read about a failed run.
NOT_SET_UP, SOURCE_FAILED, NO_PROJECT, RUN_FAILED, TIMED_OUT = "Scanning is not configured.", "The source could not be read. Please try again.", "Project not found.", "The scan failed. Please try again.", "The scan timed out."


def safe_message(kind: Column, message: Column) -> Column:
    """A message without secrets for an error of a ``kind`` (``source`` for the connector's own errors)."""
    from_source = F.when(message.rlike("(?i)missing (?:[a-z]+ )?api credentials"), NOT_SET_UP).otherwise(SOURCE_FAILED)
    return F.when(kind == "source", from_source).when(message == "Project not found.", NO_PROJECT).otherwise(RUN_FAILED)


def fail_stale(runs: DataFrame, now: Column) -> DataFrame:
    """Runs that never ended fail once they are stale."""
    late = stale(F.col("status"), F.col("started_at"), now)
    return update_where(runs, late, {"status": F.lit("failed"), "error_message": F.lit(TIMED_OUT), "completed_at": now, "updated_at": now})


def blocking(runs: DataFrame) -> DataFrame:
    """The newest running row per project, stale ones failed before: what keeps a project from starting another run."""
    return latest(runs.filter("status = 'running'"))


def start_runs(runs: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(runs, refused requests) for ``requests`` (id, project_id, user_id): a project runs once at a time.

    Stale runs fail first. Of two requests for one project the one with the lower id starts.
    """
    runs = fail_stale(runs, now)
    busy = blocking(runs).select("project_id", F.lit(True).alias("busy"))
    first = requests.groupBy("project_id").agg(F.min("id").alias("first"))
    asked = requests.join(busy, "project_id", "left").join(first, "project_id")
    free = F.col("busy").isNull() & (F.col("id") == F.col("first"))
    started = asked.filter(free).select("id", "project_id", "user_id", F.lit("running").alias("status"), F.lit(0).alias("leads_found"), now.alias("started_at"), now.alias("created_at"), now.alias("updated_at"))
    return runs.unionByName(started, allowMissingColumns=True), asked.filter(~free).select(*requests.columns)


def end_runs(runs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Runs named in ``outcomes`` (id, leads_found, error_message) end: without an error as a success, else failed with their count as it was."""
    known = outcomes.join(runs.select("id", F.col("leads_found").alias("__before")), "id")
    failed = F.col("error_message").isNotNull()
    ended = known.select("id", F.when(failed, "failed").otherwise("success").alias("status"), F.when(failed, F.col("__before")).otherwise(F.col("leads_found")).alias("leads_found"), "error_message", now.alias("completed_at"))
    return with_values(runs, ended, now)


def run_project(scan: Callable[[], None], work: Callable[[], None], count: Callable[[], int]) -> tuple[int, str | None]:
    """(leads found, error message) of one run: scan, then work, then the count; any error becomes a safe message."""
    from ..sources.forum import FetchError

    try:
        scan()
        work()
        return count(), None
    except FetchError as e:
        return 0, NOT_SET_UP if "api credentials" in str(e).lower() else SOURCE_FAILED
    except Exception as e:  # whatever a step raised, its text may hold secrets
        return 0, NO_PROJECT if str(e) == NO_PROJECT else RUN_FAILED

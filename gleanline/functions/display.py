"""Scalar functions over columns: scores, community names, addresses, scan stages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def score_text(score: Column) -> Column:
    """One decimal; a full score of 10 gets a star."""
    shown = F.format_string("%.1f", score.cast("double"))
    return F.when(score == 10, F.concat(F.lit("\U0001f31f "), shown)).otherwise(F.when(score.isNotNull(), shown))


def community_text(name: Column) -> Column:
    """Trimmed, with ``r/`` in front unless it is there; blank stays blank."""
    trimmed = F.trim(name)
    return F.when(trimmed == "", "").when(trimmed.startswith("r/"), trimmed).otherwise(F.concat(F.lit("r/"), trimmed))


def time_text(at: Column, pattern: str = "MMM d, yyyy, h:mm a") -> Column:
    """A medium date with a short time; null gives the empty string."""
    return F.coalesce(F.date_format(at, pattern), F.lit(""))


def day_bounds(at: Column) -> tuple[Column, Column]:
    """First and last millisecond of the day of ``at``."""
    start = F.date_trunc("day", at)
    return start, start + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MILLISECOND")


def with_scheme(url: Column) -> Column:
    trimmed = F.trim(url)
    return F.when(trimmed.rlike("(?i)^https?://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))


def normal_url(url: Column) -> Column:
    """Scheme added, scheme and host in lower case, at least ``/`` as path; null if blank or without a dotted host."""
    full = with_scheme(url)
    scheme = F.lower(F.regexp_extract(full, r"^([a-zA-Z]+)://", 1))
    host = F.lower(F.regexp_extract(full, r"^[a-zA-Z]+://([^/?#]*)", 1))
    host = F.when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(F.regexp_replace(host, r":80$", ""))
    rest = F.regexp_extract(full, r"^[a-zA-Z]+://[^/?#]*(.*)$", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    fine = (F.trim(url) != "") & host.contains(".") & ~host.rlike(r"[\s<>^|%\\]")
    return F.when(fine, F.concat(scheme, F.lit("://"), host, rest))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]*)", 1))


def name_from_url(url: Column) -> Column:
    """The first label of the host, split at dashes and underscores, each part capitalised."""
    bare = F.regexp_replace(host_of(url), r"^www\.", "")
    parts = F.filter(F.split(F.split(bare, r"\.").getItem(0), "[-_]+"), lambda p: p != "")
    words = F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000)))
    return F.when(host_of(url) == "", url).when(F.size(words) > 0, F.array_join(words, " ")).otherwise(bare)


def looks_like_site(value: Column) -> Column:
    return F.trim(value).rlike(r"(?i)^(https?://)?([a-z0-9-]+\.)+[a-z]{2,}(/\S*)?$")


def icon_url(url: Column, service: str = "https://icons.example/?domain=") -> Column:
    return F.concat(F.lit(service), host_of(url))


def list_text(items: Column, none: str = "(none provided)") -> Column:
    return F.when(F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0, F.array_join(items, ", ")).otherwise(none)


def scan_stage(status: Column, rows_since: Column) -> Column:
    """not_started without a run; completed, failed; else scoring once rows arrived, scanning before."""
    return F.when(status.isNull(), "not_started").when(status == "success", "completed").when(status == "failed", "failed").when(rows_since > 0, "scoring").otherwise("scanning")


# What a user reads about each stage, and the path of a project's page.
def stage_text(stage: Column) -> Column:
    return F.when(stage == "scoring", "Scoring leads").when(stage == "completed", "Scan complete").when(stage == "failed", "Scan failed").otherwise("Finding your leads")


def dashboard_path(project_id: Column) -> Column:
    return F.concat(F.lit("/projects/"), project_id, F.lit("/dashboard"))


def redirect(project_id: Column, stage: Column) -> Column:
    """The dashboard's path once a scan is completed, else null."""
    return F.when(stage == "completed", dashboard_path(project_id))


def absolute_link(permalink: Column, base: str) -> Column:
    """Blank stays blank, links stay, paths get ``base`` in front."""
    link = F.coalesce(permalink, F.lit(""))
    return F.when(link == "", "").when(link.startswith("http"), link).otherwise(F.concat(F.lit(base), link))


def lead_marks(status: Column) -> Column:
    """The mark a lead shows beside its status: New, Contacted or none."""
    return F.when(status == "new", "New").when(status == "contacted", "Contacted")


def bare_post_id(full_name: Column) -> Column:
    return F.regexp_replace(full_name, "^t3_", "")

"""Tenant-scoped reads: lists, filters, sorts, counts, latest runs, range joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut

# Statuses and badges with their reading of unknown values.
LEAD_STATUSES = ["new", "reviewed", "contacted", "ignored"]
RUN_STATUSES = ["running", "success", "failed"]
BADGES = ["without_rules", "promo_conditional", "promo_not_safe"]
SORTS = ["newest", "oldest", "highest_score", "lowest_score"]


def scoped(df: DataFrame, user_id: str, project_id: str | None = None) -> DataFrame:
    """Rows of one user, and of one project if given: the filter of every reader."""
    own = df.filter(F.col("user_id") == user_id)
    return own if project_id is None else own.filter(F.col("project_id") == project_id)


def secured(tables: dict[str, DataFrame], user_id: str) -> dict[str, DataFrame]:
    """All tables as one user may see them: own rows only (of ``profiles`` the own row); a null user id is nobody's."""
    own = {name: "id" if name == "profiles" else "user_id" for name in tables}
    return {name: df.filter(F.col(own[name]) == F.lit(user_id)) for name, df in tables.items()}


def write_allowed(rows: DataFrame, user_id: str, column: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """(rows a user may write, refused ones): the check of row-level security on inserts and updates."""
    mine = F.coalesce(F.col(column) == F.lit(user_id), F.lit(False))
    return rows.filter(mine), rows.filter(~mine)


def without_hidden(projects: DataFrame, hidden: tuple[str, ...] = ("hidden_keywords", "subreddits")) -> DataFrame:
    return projects.drop(*hidden)


def coded(value: Column, known: list[str], default: str) -> Column:
    return F.when(value.isin(*known), value).otherwise(default)


def clean_leads(leads: DataFrame) -> DataFrame:
    """Nulls and unknown codes as readers see them: texts empty, authors ``[deleted]``, scores 0, badge without_rules, status new."""
    blank = {c: F.coalesce(F.col(c), F.lit("")) for c in ("subreddit", "content", "permalink", "ai_match_type", "ai_lead_summary", "ai_match_reason") if c in leads.columns}
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("score", "ai_score") if c in leads.columns}
    codes = {"status": coded(F.col("status"), LEAD_STATUSES, "new"), "safety_badge": coded(F.col("safety_badge"), BADGES, "without_rules"), "author": F.coalesce(F.col("author"), F.lit("[deleted]"))}
    return leads.withColumns({**blank, **zero, **{c: v for c, v in codes.items() if c in leads.columns}})


def clean_runs(runs: DataFrame) -> DataFrame:
    return runs.withColumns({"status": coded(F.col("status"), RUN_STATUSES, "failed"), "leads_found": F.coalesce("leads_found", F.lit(0))})


def clean_projects(projects: DataFrame) -> DataFrame:
    lists = {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("keywords", "intent_phrases", "pain_phrases", "competitors", "hidden_keywords", "subreddits") if c in projects.columns}
    return projects.withColumns({"description": F.coalesce("description", F.lit("")), **lists})


@dataclass(frozen=True)
class ListOptions:
    """What a list of leads shows. Unknown sorts read as newest, unknown bands are dropped."""

    sort: str = "newest"
    bands: tuple[str, ...] = ()
    since: str | None = None
    until: str | None = None
    limit: int | None = None


def in_bands(score: Column, bands: tuple[str, ...]) -> Column:
    """strong: 8 and more; partial: 6 and 7; none given: all."""
    wanted = {b for b in bands if b in ("strong", "partial")}
    if wanted == {"strong"}:
        return score >= 8
    if wanted == {"partial"}:
        return score.between(6, 7)
    return score >= 6 if wanted else F.lit(True)


def lead_order(sort: str) -> list[Column]:
    newest = [F.col("item_created_at").desc_nulls_last(), F.col("id")]
    return {"oldest": [F.col("item_created_at").asc_nulls_last(), F.col("id")], "highest_score": [F.col("ai_score").desc_nulls_last(), *newest], "lowest_score": [F.col("ai_score").asc_nulls_last(), *newest]}.get(sort, newest)


def placed(rows: DataFrame, order: list[Column], per: str, name: str = "place") -> DataFrame:
    """Rows with their place in ``order`` within ``per``, from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(per).orderBy(*order)).cast("long"))


def list_leads(leads: DataFrame, options: ListOptions) -> DataFrame:
    """Filtered, sorted and limited; a limit becomes a distributed top-k."""
    rows = leads.filter(in_bands(F.col("ai_score"), options.bands))
    if options.since is not None:
        rows = rows.filter(F.col("item_created_at") >= F.lit(options.since).cast("timestamp_ntz"))
    if options.until is not None:
        rows = rows.filter(F.col("item_created_at") <= F.lit(options.until).cast("timestamp_ntz"))
    rows = rows.orderBy(*lead_order(options.sort))
    return rows if options.limit is None else rows.limit(options.limit)


def numbered(rows: DataFrame, name: str = "place") -> DataFrame:
    """Sorted rows with their place from 1, for any number of rows.

    A global sort numbers its partitions in order: a row's place is its place in its partition
    plus the rows of the partitions before it, which come from one count per partition.
    """
    # read twice: another run of the sort might cut its partitions elsewhere
    at = cut(rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    sizes = at.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before") + 1
    return at.join(before, "__part").select(*rows.columns, place.alias(name))


def lead_stats(leads: DataFrame, by: list[str]) -> DataFrame:
    """Total, new, contacted, strong and partial leads per ``by``; nulls and unknown codes as ``clean_leads`` reads them."""
    c = clean_leads(leads)
    return c.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "new").alias("new_leads"), F.count_if(F.col("status") == "contacted").alias("contacted"), F.count_if(F.col("ai_score") >= 8).alias("strong"), F.count_if(F.col("ai_score").between(6, 7)).alias("partial"))


def latest(runs: DataFrame, key: str = "project_id", at: str = "started_at") -> DataFrame:
    """The newest run per key."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), F.col("id"))
    return runs.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def oldest(rows: DataFrame, n: int, key: str | None = None) -> DataFrame:
    """The first ``n`` rows by creation, per ``key`` if given: what a worker takes next."""
    order = [F.col("created_at").asc_nulls_last(), F.col("id")]
    if key is None:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def count_since(runs: DataFrame, rows: DataFrame, out: str) -> DataFrame:
    """Per run (id, project_id, started_at) the rows of its project created since it started.

    A range join would pair every run with every later row. Instead whole hours after the
    start are summed from counts per project and hour, which combine before the shuffle, and
    only the rows of the starting hour are compared one by one.
    """
    hour = lambda c: F.date_trunc("hour", c)
    marks = runs.filter(F.col("started_at").isNotNull()).select("id", "project_id", "started_at", hour("started_at").alias("hour"))
    dated = rows.filter(F.col("created_at").isNotNull()).select("project_id", "created_at", hour("created_at").alias("hour"))
    hourly = dated.groupBy("project_id", "hour").agg(F.count(F.lit(1)).alias("n"))
    later = Window.partitionBy("project_id").orderBy(F.col("hour").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = hourly.select("project_id", "hour", "n", F.lit(None).cast("string").alias("id")).unionByName(marks.select("project_id", "hour", F.lit(0).cast("long").alias("n"), "id"))
    # the sum up to the start's own hour, less that hour
    own = hourly.select("project_id", "hour", F.col("n").alias("own"))
    whole = both.withColumn("sum", F.sum("n").over(later)).filter(F.col("id").isNotNull()).join(own, ["project_id", "hour"], "left")
    part = marks.join(dated, ["project_id", "hour"]).filter(F.col("created_at") >= F.col("started_at")).groupBy("id").agg(F.count(F.lit(1)).alias("part"))
    total = F.col("sum") - F.coalesce("own", F.lit(0)) + F.coalesce("part", F.lit(0))
    return whole.join(part, "id", "left").select("id", "project_id", total.alias(out))


def stale(status: Column, started: Column, now: Column, minutes: int = 15) -> Column:
    """Running for longer than ``minutes``."""
    return (status == "running") & (started < now - F.make_dt_interval(mins=F.lit(minutes)))

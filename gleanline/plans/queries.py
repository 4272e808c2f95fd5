"""Registered queries over the reference's own operators. Their SQL oracles are in ``oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display, text
from ..operators import matching, plugins, queue, rules, runs, scan, serving, tables, terms
from ..sources.pages import page_content
from ..sources.tables import read
from ..session import shared_folder
from ..streaming import intake
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

#: The clock of all queries: what the reference takes from the system is a parameter here.
NOW = "2026-08-31 23:59:59"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def queue_items(spark: SparkSession, d: str) -> DataFrame:
    """Queue items with their text: project_id, item_id, text.

    Repeated deliveries stay in: results are narrow and drop them later, while dropping them
    here would shuffle all texts.
    """
    q = read(spark, d, "gemini_qualification_queue", ["id", "project_id", "item_type", "title", "body"])
    return q.select("project_id", F.col("id").alias("item_id"), matching.item_text(F.col("item_type"), F.col("title"), F.col("body")).alias("text"))


def normalized_items(spark: SparkSession, d: str) -> DataFrame:
    return text.with_normalized(queue_items(spark, d), "text", "normalized").select("project_id", "item_id", "normalized")


def normalize_text(spark, d):
    return normalized_items(spark, d).select("item_id", "normalized").dropDuplicates(["item_id"])


def tokenize_counts(spark, d):
    t = text.tokens(F.col("normalized"))
    return normalized_items(spark, d).select("item_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct")).distinct()


def _plain_terms(spark, d):
    return matching.prepared_terms(read(spark, d, "projects"))


def _technique(flag, general=True):
    """Matches of one technique alone: item_id, category, term."""

    def query(spark, d):
        t = _plain_terms(spark, d).filter("category <> 'competitors'" if general else "category = 'competitors'")
        return matching.one_technique(normalized_items(spark, d), t, flag)

    return query


def fuzzy_vocab(spark, d):
    words = matching.vocabulary(normalized_items(spark, d))
    term_words = _plain_terms(spark, d).filter("category <> 'competitors'").select(F.explode(text.tokens(F.col("normalized"))).alias("term_word")).distinct()
    return matching.fuzzy_neighbours(term_words, words)


def stem_lemma_vocab(spark, d):
    forms = text.stem_and_lemma(F.col("word"))
    return matching.vocabulary(normalized_items(spark, d)).select("word", forms.alias("f")).select("word", "f.stem", "f.lemma")


def match_engine(spark, d):
    return matching.matching_engine(queue_items(spark, d), read(spark, d, "projects"))


def match_priority(spark, d):
    """The engine without word forms: flexible, fuzzy and similar phrases, and exact competitors."""
    return matching.matching_engine(queue_items(spark, d), read(spark, d, "projects"), ["fuzzy"])


def match_counts(spark, d):
    items = queue_items(spark, d)
    return matching.match_counts(items, matching.matching_engine(items, read(spark, d, "projects")))


def qualified_candidates(spark, d):
    """The flagship: items with a match in any category, richest first."""
    items = queue_items(spark, d)
    counts = matching.match_counts(items, matching.matching_engine(items, read(spark, d, "projects")))
    return counts.filter("n_categories > 0").orderBy(F.col("n_categories").desc(), "item_id", "project_id").limit(20)


def search_terms(spark, d):
    return terms.search_terms(read(spark, d, "projects")).select("project_id", F.col("position").cast("long").alias("position"), "term", "category")


def term_batches(spark, d):
    t = terms.term_batches(terms.search_terms(read(spark, d, "projects")))
    return t.groupBy("project_id", "batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "term"))), lambda x: x["term"]), "|").alias("terms")).select("project_id", F.col("batch").cast("long").alias("batch"), "terms")


def search_queries(spark, d):
    return terms.search_terms(read(spark, d, "projects")).select("project_id", terms.search_query(F.col("term")).alias("query"))


def clean_term_lists(spark, d):
    p = read(spark, d, "projects")
    return p.select("id", F.array_join(terms.distinct_list(F.col("keywords")), "|").alias("keywords"), F.array_join(terms.clean_list(F.col("keywords")), "|").alias("sanitized"), F.array_join(terms.capped_list(F.col("competitors"), 5), "|").alias("competitors"))


def request_grid(spark, d):
    p = read(spark, d, "projects")
    return terms.request_grid(p, terms.search_terms(p)).groupBy("project_id").agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("subreddit").alias("communities"))


def posts(spark, d):
    q = read(spark, d, "gemini_qualification_queue", ["reddit_item_id", "item_type", "subreddit", "title", "body", "author", "reddit_score", "num_comments", "item_created_at", "id"])
    return q.filter("item_type = 'post'").select(F.col("reddit_item_id").alias("post_id"), "id", "subreddit", "title", "body", "author", F.coalesce("reddit_score", F.lit(0)).alias("score"), F.coalesce("num_comments", F.lit(0)).alias("num_comments"), F.col("item_created_at").alias("created_at"))


def scan_window(spark, d):
    return scan.recent(posts(spark, d), NOW).select("id", "post_id", "created_at").distinct()


def search_posts(spark, d):
    """The newest 25 posts per community and search term of each project."""
    p = read(spark, d, "projects")
    communities = p.select(F.col("id").alias("project_id"), F.explode("subreddits").alias("subreddit")).distinct()
    grid = communities.join(terms.search_terms(p).select("project_id", "term"), "project_id")
    return scan.search(posts(spark, d), grid).select("project_id", "subreddit", "term", "id")


def deliveries(spark, d):
    """Posts as they were delivered, repeated deliveries included, with their order of arrival."""
    q = read(spark, d, "gemini_qualification_queue", ["id", "reddit_item_id", "item_type", "subreddit", "item_created_at", "updated_at", "attempt_count"]).filter("item_type = 'post'")
    arrival = F.struct("item_created_at", "id", "updated_at", "attempt_count")
    return q.select(F.col("reddit_item_id").alias("id"), F.col("id").alias("delivery"), "subreddit", arrival.alias("arrival"))


def post_cap_per_community(spark, d):
    """The first 50 deliveries per community, then one row per post: a repeated delivery uses the cap up."""
    return scan.kept_posts(deliveries(spark, d), [F.col("arrival")]).select("subreddit", F.col("id").alias("post_id"), F.col("delivery").alias("id"))


def dedupe_items(spark, d):
    """One row per queue id: the one updated last."""
    q = read(spark, d, "gemini_qualification_queue", ["id", "updated_at", "attempt_count", "status"])
    return scan.first_per(q, ["id"], [F.col("updated_at").desc_nulls_last(), F.col("attempt_count").desc_nulls_last()]).select("id", "updated_at", F.col("attempt_count").cast("long").alias("attempt_count"))


def comments_of_kept_posts(spark, d):
    """The first two comments of every post that was talked about in the last 30 days, as far as they fall into these."""
    q = read(spark, d, "gemini_qualification_queue", ["id", "item_type", "parent_post_id", "item_created_at"])
    comments = q.filter("item_type = 'comment'").select("id", F.col("parent_post_id").alias("post_id"), F.col("item_created_at").alias("created_at")).distinct()
    kept = scan.recent(comments, NOW, 30).select(F.col("post_id").alias("id"))
    return scan.recent(scan.comments_of(comments, kept, [F.col("created_at"), F.col("id")], 2), NOW, 30).select("post_id", "id")


def enqueue_new(spark, d):
    """Leads offered to the queue: those whose item the project has not queued are taken."""
    q = read(spark, d, "gemini_qualification_queue", ["project_id", "reddit_item_id", "id"])
    new = read(spark, d, "reddit_leads", ["project_id", "reddit_item_id", "id"])
    merged, _ = tables.insert_or_ignore(q, new, ["project_id", "reddit_item_id"], [F.col("id")])
    return merged.distinct().groupBy("project_id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("reddit_item_id").alias("items"))


def quarantine(spark, d):
    """Leads that break a constraint, with the names of the broken ones."""
    leads = read(spark, d, "reddit_leads", ["id", "item_type", "parent_post_id", "title", "status", "safety_badge"])
    shape = (F.col("item_type") == "post") & F.col("parent_post_id").isNull() & F.col("title").isNotNull() | (F.col("item_type") == "comment") & F.col("parent_post_id").isNotNull() & F.col("title").isNull()
    checks = {"shape": shape, "status": F.col("status").isin(*serving.LEAD_STATUSES), "badge": F.col("safety_badge").isNull() | F.col("safety_badge").isin(*serving.BADGES)}
    _, bad = tables.valid_rows(leads, checks)
    return bad.select("id", F.array_join("failed_checks", ",").alias("failed_checks")).distinct()


def upsert_leads(spark, d):
    """Qualified queue rows written over the leads of the same item; a lead's status stays."""
    leads = read(spark, d, "reddit_leads", ["id", "project_id", "reddit_item_id", "ai_score", "status"])
    leads = scan.first_per(leads, ["project_id", "reddit_item_id"], [F.col("id"), F.col("status").asc_nulls_last(), F.col("ai_score").asc_nulls_last()])
    q = read(spark, d, "gemini_qualification_queue", ["id", "project_id", "reddit_item_id", "ai_score", "ai_qualified"]).filter("ai_qualified").drop("ai_qualified")
    new = scan.first_per(q, ["project_id", "reddit_item_id"], [F.col("id"), F.col("ai_score").asc_nulls_last()]).select("project_id", "reddit_item_id", "ai_score", "id")
    return tables.upsert(leads, new.drop("id"), ["project_id", "reddit_item_id"], {"status": "new"}).select("project_id", "reddit_item_id", F.col("ai_score").cast("long").alias("ai_score"), "status")


def update_status(spark, d):
    """Strong new leads become contacted; counts per status after it."""
    leads = read(spark, d, "reddit_leads", ["id", "ai_score", "status", "updated_at"])
    hit = (F.col("status") == "new") & (F.col("ai_score") >= 9)
    after = tables.update_where(leads, hit, {"status": F.lit("contacted"), "updated_at": now()})
    return after.groupBy("status").agg(F.count(F.lit(1)).alias("rows"), F.max("updated_at").alias("last_update"))


def delete_leads(spark, d):
    leads = read(spark, d, "reddit_leads", ["id", "project_id", "status"])
    return tables.delete_where(leads, F.col("status") == "ignored").groupBy("project_id").agg(F.count(F.lit(1)).alias("rows"))


def fail_stale_runs(spark, d):
    return runs.fail_stale(read(spark, d, "sync_logs"), now()).select("id", "status", "error_message", "completed_at", "updated_at")


def stale_runs_count(spark, d):
    return tables.affected(read(spark, d, "sync_logs"), serving.stale(F.col("status"), F.col("started_at"), now()))


#: A moment at which some runs are under way and some are stale.
MOMENT = "2026-08-25 22:10:00"


def blocking_runs(spark, d):
    """What keeps each project from starting a run."""
    log = runs.fail_stale(read(spark, d, "sync_logs"), F.lit(MOMENT).cast("timestamp_ntz"))
    return runs.blocking(log).select("project_id", "id", "started_at")


def start_runs(spark, d):
    """Every project asks for a run; those with a running one are refused."""
    asked = read(spark, d, "projects", ["id", "user_id"]).select(F.concat(F.lit("run-"), F.col("id")).alias("id"), F.col("id").alias("project_id"), "user_id")
    log, refused = runs.start_runs(read(spark, d, "sync_logs"), asked, F.lit(MOMENT).cast("timestamp_ntz"))
    started = log.filter(F.col("id").startswith("run-")).select("id", "project_id", "user_id", "status", F.col("leads_found").cast("long").alias("leads_found"), "started_at")
    return started.unionByName(refused.select("id", "project_id", "user_id", F.lit("refused").alias("status")), allowMissingColumns=True)


def end_runs(spark, d):
    """Running rows end with the leads found since their start; those of no lead as failures."""
    log = read(spark, d, "sync_logs")
    rows = read(spark, d, "reddit_leads", ["id", "project_id", "created_at"]).distinct()
    found = serving.count_since(log.filter("status = 'running'").select("id", "project_id", "started_at"), rows, "leads")
    message = F.when(F.col("leads") == 0, runs.safe_message(F.lit("source"), F.lit("Missing API credentials")))
    after = runs.end_runs(log, found.select("id", F.col("leads").alias("leads_found"), message.alias("error_message")), now())
    return after.select("id", "status", F.col("leads_found").cast("long").alias("leads_found"), "error_message", "completed_at", "updated_at")


def safe_errors(spark, d):
    """Stored errors as users may read them; those about tokens and rates are the source's."""
    log = read(spark, d, "sync_logs", ["id", "error_message"]).filter("error_message is not null")
    kind = F.when(F.col("error_message").rlike("(?i)token|rate"), "source").otherwise("other")
    return log.select("id", runs.safe_message(kind, F.col("error_message")).alias("shown"))


def _queue(spark, d):
    """One row per queue id, the one updated last."""
    q = read(spark, d, "gemini_qualification_queue", ["id", "project_id", "user_id", "reddit_item_id", "item_type", "subreddit", "title", "matched_text", "permalink", "reddit_score", "item_created_at", "status", "processing_started_at", "attempt_count", "error_message", "gemini_call_attempted_at", *queue.RESULT, "created_at", "updated_at"])
    return scan.first_per(q, ["id"], [F.col("updated_at").desc_nulls_last(), F.col("attempt_count").desc_nulls_last()])


def _queue_columns(q):
    return q.select("id", "status", "processing_started_at", F.col("attempt_count").cast("long").alias("attempt_count"), "error_message", "gemini_call_attempted_at", F.col("ai_score").cast("long").alias("ai_score"), "updated_at")


def queue_claim(spark, d):
    """Five rows of each project are taken up, the oldest first."""
    return _queue_columns(queue.claim(_queue(spark, d), now(), 5, per="project_id")[0])


def queue_recovery(spark, d):
    """Rows left over by a crashed worker: back to pending, or failed if the scorer may have been called."""
    return _queue_columns(queue.recover_stale(_queue(spark, d), now())[0])


def queue_recovered(spark, d):
    return queue.recover_stale(_queue(spark, d), now())[1]


def _worker(spark, d):
    """A worker's run over three rows of each project with a stand-in scorer; projects without a description are missing."""
    q, claimed = queue.claim(_queue(spark, d), now(), 3, per="project_id")
    q = queue.mark_attempted(q, claimed.filter("ai_score is null"), now())
    projects = serving.clean_projects(read(spark, d, "projects").filter("description is not null"))
    found, failures = queue.with_project(claimed, projects, ["description", "keywords"])
    scored = plugins.score_missing(found.drop("project"), "ai_score", ["matched_text"], lambda x: x["matched_text"].fillna("").str.len() % 11, plugins.in_range(0, 10))
    results = scored.withColumn("ai_qualified", F.col("ai_score") > 5)
    leads = read(spark, d, "reddit_leads", ["id", "project_id", "user_id", "reddit_item_id", "item_type", "subreddit", "ai_score", "status", "updated_at"])
    leads = scan.first_per(leads, ["project_id", "reddit_item_id"], [F.col("id"), F.col("updated_at").desc_nulls_last(), F.col("status").asc_nulls_last()])
    return q, leads, results, failures


def worker_queue(spark, d):
    q, leads, results, failures = _worker(spark, d)
    return _queue_columns(queue.finish(q, leads, results, failures, now())[0])


def worker_leads(spark, d):
    q, leads, results, failures = _worker(spark, d)
    after = queue.finish(q, leads, results, failures, now())[1]
    return after.groupBy("project_id", "status").agg(F.count(F.lit(1)).alias("leads"), F.sum("ai_score").alias("score"))


def worker_summary(spark, d):
    *_, results, failures = _worker(spark, d)
    return queue.summary(results, failures)


def candidate_prompts(spark, d):
    """The prompt of every pending row whose project is there, made of the allowed fields only."""
    waiting = _queue(spark, d).filter("status = 'pending'").select("id", "project_id", "user_id", "item_type", "subreddit", "title", "matched_text", "permalink", "reddit_score", "item_created_at")
    projects = serving.without_hidden(serving.clean_projects(read(spark, d, "projects")))
    found, _ = queue.with_project(waiting, projects, ["description", "keywords", "intent_phrases", "pain_phrases", "competitors"])
    listed = lambda label, c: F.concat(F.lit(label), display.list_text(F.col(f"project.{c}")))
    told = lambda label, c, none="": F.concat(F.lit(label), F.coalesce(F.col(c).cast("string"), F.lit(none)))
    parts = [
        "PROJECT CONTEXT", "", told("Business description: ", "project.description"), "", listed("Keywords the business associates with its space: ", "keywords"), "", listed("Phrases that signal someone is looking for a solution like this: ", "intent_phrases"), "",
        listed("Phrases that signal someone is frustrated with the problem this business solves: ", "pain_phrases"), "", listed("Known competitors in this space: ", "competitors"), "", "CANDIDATE CONTENT", "", told("Type: ", "item_type"), told("Subreddit: r/", "subreddit"), told("Title: ", "title", "(none - this is a comment)"), "Content:", F.col("matched_text"), "",
        told("Score: ", "reddit_score", "null"), F.concat(F.lit("Posted at: "), F.date_format("item_created_at", "yyyy-MM-dd HH:mm:ss")), told("Permalink: ", "permalink"),
    ]
    return found.select("id", plugins.lines(parts).alias("prompt"))


def insert_projects(spark, d):
    """Projects with an address of a length divisible by three offered again, half of them under another page: known ones are refused."""
    p = read(spark, d, "projects", ["id", "user_id", "website_url"])
    n = F.length("website_url")
    offered = p.filter(n % 3 == 0).select(F.concat(F.lit("new-"), F.col("id")).alias("id"), "user_id", F.when(n % 2 == 0, F.concat("website_url", F.lit("/2"))).otherwise(F.col("website_url")).alias("website_url"))
    after, refused = tables.insert_or_ignore(p, offered, ["user_id", "website_url"], [F.col("id")])
    return after.withColumn("outcome", F.lit("stored")).unionByName(refused.withColumn("outcome", F.lit("refused")))


def update_projects(spark, d):
    """The first user edits their projects: only editable columns and the time of change move."""
    p = read(spark, d, "projects")
    mine = F.col("user_id") == F.lit(p.agg(F.min("user_id")).first()[0])
    changed = {"description": F.lit("edited"), "keywords": terms.clean_list(F.col("keywords")), "updated_at": tables.stamp(mine, now())}
    after = tables.update_where(p, mine, changed)
    return after.select("id", "name", "description", F.array_join("keywords", "|").alias("keywords"), F.size("hidden_keywords").cast("long").alias("n_hidden"), "updated_at")


def profiles(spark, d):
    """A profile for every user who has none; users with several projects get one."""
    users = read(spark, d, "projects", ["user_id"])
    known = read(spark, d, "sync_logs", ["user_id", "created_at"]).filter("created_at < timestamp_ntz'2026-06-01 00:00:00'").groupBy(F.col("user_id").alias("id")).agg(F.min("created_at").alias("created_at"))
    return tables.derived_rows(users, known, "id", {"id": F.col("user_id"), "created_at": now()})


def secured_counts(spark, d):
    """What one user sees of each table, and how many leads they may not write."""
    names = ["projects", "gemini_qualification_queue", "reddit_leads", "sync_logs"]
    user = read(spark, d, "projects", ["user_id"]).agg(F.max("user_id")).first()[0]
    seen = serving.secured({n: read(spark, d, n, ["id", "user_id"]) for n in names}, user)
    _, refused = serving.write_allowed(read(spark, d, "reddit_leads", ["user_id"]), user)
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("tbl"), "rows") for n, df in {**seen, "refused": refused}.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def tenant_leads(spark, d):
    """The first user's leads of their first project, best first."""
    first = read(spark, d, "projects", ["id", "user_id"]).orderBy("user_id", "id").first()
    rows = serving.scoped(_leads(spark, d), first["user_id"], first["id"]).select("id", "ai_score", "item_created_at").distinct()
    return serving.numbered(serving.list_leads(rows, serving.ListOptions(sort="highest_score"))).select("id", F.col("ai_score").cast("long").alias("ai_score"), "place")


def remaining_terms(spark, d):
    """How many searches each project still has after its first batch."""
    t = terms.term_batches(terms.search_terms(read(spark, d, "projects")))
    return t.filter("batch > 0").groupBy("project_id").agg(F.count(F.lit(1)).alias("remaining"))


def normalized_copies(spark, d):
    """Titles and bodies of posts with their normal forms beside them."""
    p = posts(spark, d).select("id", "title", "body")
    return matching.normalized_copies(p, ["title", "body"]).select("id", "normalized_title", "normalized_body").dropDuplicates(["id"])


def listing_rows(spark, d):
    """Queue rows as raw listings, read back as typed posts and comments, missing fields filled."""
    q = read(spark, d, "gemini_qualification_queue", ["id", "item_type", "parent_post_id", "subreddit", "title", "body", "author", "author_id", "permalink", "reddit_score", "num_comments", "item_created_at"])
    raw = q.select(
        F.when(F.col("item_type") == "post", "t3").otherwise("t1").alias("kind"), F.col("id").alias("name"), "subreddit", "title", F.col("body").alias("selftext"), "body", F.nullif("author", F.lit("[deleted]")).alias("author"), F.col("author_id").alias("author_fullname"), F.lit(None).cast("string").alias("url"),
        F.regexp_replace("permalink", "^https?://[^/]*", "").alias("permalink"), F.col("reddit_score").alias("score"), "num_comments", F.col("parent_post_id").alias("link_id"), F.unix_seconds(F.col("item_created_at").cast("timestamp")).alias("created_utc"),
    )
    base = "https://forum.example"
    both = scan.typed_posts(scan.of_kind(raw, "t3"), base).unionByName(scan.typed_comments(scan.of_kind(raw, "t1"), base), allowMissingColumns=True)
    return both.select("id", "type", "author", "permalink", F.col("score").cast("long").alias("score"), display.bare_post_id(F.col("post_id")).alias("bare_post_id"), F.col("created_at").cast("timestamp_ntz").alias("created_at")).distinct()


def plug_in_words(spark, d):
    """A matcher of the user's own over batches of texts, which sees nothing else: words per lead."""
    leads = read(spark, d, "reddit_leads", ["id", "content", "author"])
    return plugins.apply_batches(leads, lambda x: x[["id"]].assign(words=x["content"].fillna("").str.split(" ").str.len()), "id string, words long", ["id", "content"]).distinct()


def _leads(spark, d):
    columns = ["id", "project_id", "user_id", "subreddit", "author", "content", "permalink", "score", "ai_score", "ai_match_type", "ai_lead_summary", "ai_match_reason", "safety_badge", "status", "item_created_at", "created_at"]
    return read(spark, d, "reddit_leads", columns)


def _list(options):
    def query(spark, d):
        rows = _leads(spark, d).select("id", "ai_score", "item_created_at").distinct()
        return serving.numbered(serving.list_leads(rows, options)).select("id", F.col("ai_score").cast("long").alias("ai_score"), "item_created_at", "place")

    return query


def lead_stats(spark, d):
    return serving.lead_stats(_leads(spark, d), ["user_id", "project_id"])


def clean_leads(spark, d):
    c = serving.clean_leads(_leads(spark, d))
    return c.select("id", "subreddit", "author", F.col("score").cast("long").alias("score"), F.col("ai_score").cast("long").alias("ai_score"), "safety_badge", "status")


def clean_runs(spark, d):
    return serving.clean_runs(read(spark, d, "sync_logs")).select("id", "status", F.col("leads_found").cast("long").alias("leads_found"))


def tenant_projects(spark, d):
    """Every tenant's projects without hidden columns, newest first."""
    p = serving.without_hidden(serving.clean_projects(read(spark, d, "projects")))
    rows = p.select("user_id", "id", "name", "description", F.size("keywords").cast("long").alias("n_keywords"), "created_at")
    return serving.placed(rows, [F.col("created_at").desc(), F.col("id")], "user_id")


def latest_scan(spark, d):
    return serving.latest(serving.clean_runs(read(spark, d, "sync_logs"))).select("project_id", "id", "status", "started_at")


def queue_since_scan(spark, d):
    rows = read(spark, d, "gemini_qualification_queue", ["id", "project_id", "created_at"]).distinct()
    return serving.count_since(read(spark, d, "sync_logs", ["id", "project_id", "started_at"]), rows, "queued")


def leads_since_scan(spark, d):
    rows = read(spark, d, "reddit_leads", ["id", "project_id", "created_at"]).distinct()
    return serving.count_since(read(spark, d, "sync_logs", ["id", "project_id", "started_at"]), rows, "leads")


def scan_stages(spark, d):
    """The stage, its text and redirect of every project's latest scan."""
    p = read(spark, d, "projects", ["id"]).select(F.col("id").alias("project_id"))
    last = latest_scan(spark, d)
    rows = read(spark, d, "gemini_qualification_queue", ["id", "project_id", "created_at"]).distinct()
    counted = serving.count_since(last.select("id", "project_id", "started_at"), rows, "queued").select("project_id", "queued")
    both = p.join(last.select("project_id", "status"), "project_id", "left").join(counted, "project_id", "left")
    stage = display.scan_stage(F.col("status"), F.coalesce("queued", F.lit(0)))
    return both.withColumn("stage", stage).select("project_id", "stage", display.stage_text(F.col("stage")).alias("label"), display.redirect(F.col("project_id"), F.col("stage")).alias("redirect"))


def oldest_pending(spark, d):
    """The ten rows of each project that have waited longest."""
    q = read(spark, d, "gemini_qualification_queue", ["id", "project_id", "status", "created_at"]).filter("status = 'pending'").drop("status").distinct()
    return serving.oldest(q, 10, "project_id").select("project_id", "id", "created_at")


def community_rules(spark, d):
    return rules.rule_findings(read(spark, d, "subreddit_rules"))


def leads_with_badge(spark, d):
    leads = read(spark, d, "reddit_leads", ["id", "subreddit"]).distinct()
    return rules.with_badge(leads, read(spark, d, "subreddit_rules")).groupBy("badge").agg(F.count(F.lit(1)).alias("leads"))


def format_leads(spark, d):
    rows = _leads(spark, d).select("id", "ai_score", "subreddit", "item_created_at").distinct()
    start, end = display.day_bounds(F.col("item_created_at"))
    return rows.select("id", display.score_text(F.col("ai_score")).alias("score_text"), display.community_text(F.col("subreddit")).alias("community"), display.time_text(F.col("item_created_at"), "yyyy-MM-dd HH:mm").alias("posted"), start.cast("timestamp_ntz").alias("day_start"), end.cast("timestamp_ntz").alias("day_end"))


def project_urls(spark, d):
    p = read(spark, d, "projects", ["id", "website_url"])
    url = display.normal_url(F.col("website_url"))
    return p.select("id", url.alias("url"), display.name_from_url(url).alias("name"), display.looks_like_site(F.col("website_url")).alias("looks_fine"), display.icon_url(url).alias("icon"))


def page_extract(spark, d):
    """Pages made of the projects' own fields, read back."""
    p = read(spark, d, "projects", ["id", "name", "description", "keywords"])
    html = F.concat(F.lit("<html><head><title> "), F.col("name"), F.lit('</title><meta name="description" content="'), F.coalesce("description", F.lit("")), F.lit('"><style>p{}</style></head><body><h1>'), F.col("name"), F.lit("</h1><script>var x = '<h2>no</h2>';</script><h2> </h2><p>"), F.array_join("keywords", "</p>\n<p>"), F.lit("</p></body></html>"))
    c = page_content(p.select("id", html.alias("html")), ["id"])
    return c.select("id", "title", "meta_description", F.array_join("headings", "|").alias("headings"), "body_text")


def matched_terms_json(spark, d):
    """The stored match struct as JSON and back: matches per category over the table."""
    q = read(spark, d, "gemini_qualification_queue", ["id", "matched_terms"])
    kind = q.schema["matched_terms"].dataType
    back = q.select("id", F.from_json(F.to_json("matched_terms"), kind).alias("m"))
    size = lambda c: F.sum(F.greatest(F.size(f"m.{c}"), F.lit(0))).alias(c)
    return back.agg(size("keywords"), size("intent_phrases"), size("pain_phrases"), size("competitors"))


def score_missing(spark, d):
    """Leads without a score get one from a stand-in scorer that sees the content only; others keep theirs."""
    leads = read(spark, d, "reddit_leads", ["id", "content", "ai_score"])
    scored = plugins.score_missing(leads, "ai_score", ["content"], lambda x: x["content"].fillna("").str.len() % 11, plugins.in_range(0, 10))
    return scored.select("id", F.col("ai_score").cast("long").alias("ai_score"))


def project_prompts(spark, d):
    """The text a page analysis would be asked with, made of the parts that are there."""
    p = read(spark, d, "projects", ["id", "website_url", "name", "description", "keywords", "competitors"])
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    parts = [part("Website URL: ", F.col("website_url")), part("Page title: ", F.col("name")), part("Meta description: ", F.col("description")), F.concat(F.lit("Keywords: "), display.list_text(F.col("keywords"))), F.concat(F.lit("Competitors: "), display.list_text(F.col("competitors")))]
    return p.select("id", plugins.prompt(parts).alias("prompt"))


def stream_intake(spark, d):
    """The queue read as a stream: first delivery of every id, counted per project."""
    path = shared_folder(spark, "stream-intake")
    kind = read(spark, d, "gemini_qualification_queue", ["id", "project_id", "created_at"]).schema
    stream = spark.readStream.schema(kind).parquet(f"{d}/gemini_qualification_queue.parquet*").withColumn("at", F.col("created_at").cast("timestamp"))
    once = intake.first_deliveries(stream, ["id"], "at", "365 days")
    intake.drain_to(once, lambda batch, n: batch.select("id", "project_id").write.mode("overwrite").parquet(f"{path}/batch={n}"), f"{path}-state").awaitTermination()
    return spark.read.schema("id string, project_id string").parquet(f"{path}/batch=*").groupBy("project_id").agg(F.count(F.lit(1)).alias("items"))


def stream_daily(spark, d):
    """The queue read as a stream: rows per day of arrival and project."""
    path = shared_folder(spark, "stream-daily")
    kind = read(spark, d, "gemini_qualification_queue", ["id", "project_id", "created_at"]).schema
    stream = spark.readStream.schema(kind).parquet(f"{d}/gemini_qualification_queue.parquet*").withColumn("at", F.col("created_at").cast("timestamp"))
    counts = intake.counts_per_window(stream, "at", "1 day", "project_id", "365 days")
    intake.drain_to(counts, lambda batch, n: batch.select("project_id", "window.start", "rows").write.mode("overwrite").parquet(path), f"{path}-state", "complete").awaitTermination()
    return spark.read.parquet(path).select("project_id", F.col("start").cast("timestamp_ntz").alias("day"), "rows")


def page_analysis(spark, d):
    """What a stand-in analyzer makes of the projects' pages: a summary and its number of words."""
    p = read(spark, d, "projects", ["id", "name", "description"])
    summary = lambda x: (x["name"].fillna("") + ": " + x["description"].fillna("")).str.strip()
    analyzer = lambda x: summary(x).to_frame("summary").assign(words=summary(x).str.split(" ").str.len())
    return plugins.analyzed(p, "id", ["name", "description"], analyzer, "summary string, words long", lambda x: x["words"] > 0)


QUERIES = {
    "qualified_candidates": qualified_candidates,
    "normalize_text": normalize_text,
    "tokenize_counts": tokenize_counts,
    "flexible_phrase": _technique("flexible"),
    "exact_competitor": _technique("flexible", general=False),
    "fuzzy_match": _technique("fuzzy"),
    "phrase_similarity": _technique("similar"),
    "match_priority": match_priority,
    "fuzzy_vocab": fuzzy_vocab,
    "stem_lemma_vocab": stem_lemma_vocab,
    "match_engine": match_engine,
    "match_counts": match_counts,
    "search_terms": search_terms,
    "term_batches": term_batches,
    "search_queries": search_queries,
    "clean_term_lists": clean_term_lists,
    "request_grid": request_grid,
    "scan_window": scan_window,
    "search_posts": search_posts,
    "post_cap_per_community": post_cap_per_community,
    "dedupe_items": dedupe_items,
    "comments_of_kept_posts": comments_of_kept_posts,
    "enqueue_new": enqueue_new,
    "quarantine": quarantine,
    "blocking_runs": blocking_runs,
    "start_runs": start_runs,
    "end_runs": end_runs,
    "safe_errors": safe_errors,
    "queue_claim": queue_claim,
    "queue_recovery": queue_recovery,
    "queue_recovered": queue_recovered,
    "worker_queue": worker_queue,
    "worker_leads": worker_leads,
    "worker_summary": worker_summary,
    "candidate_prompts": candidate_prompts,
    "insert_projects": insert_projects,
    "update_projects": update_projects,
    "profiles": profiles,
    "secured_counts": secured_counts,
    "tenant_leads": tenant_leads,
    "remaining_terms": remaining_terms,
    "normalized_copies": normalized_copies,
    "listing_rows": listing_rows,
    "plug_in_words": plug_in_words,
    "upsert_leads": upsert_leads,
    "update_status": update_status,
    "delete_leads": delete_leads,
    "fail_stale_runs": fail_stale_runs,
    "stale_runs_count": stale_runs_count,
    "list_leads_newest": _list(serving.ListOptions(since="2026-06-01 00:00:00", until="2026-07-31 23:59:59")),
    "list_leads_oldest": _list(serving.ListOptions(sort="oldest", bands=("partial",))),
    "list_leads_highest": _list(serving.ListOptions(sort="highest_score", bands=("strong", "partial"))),
    "list_leads_lowest": _list(serving.ListOptions(sort="lowest_score", bands=("strong",))),
    "list_leads_top4": _list(serving.ListOptions(sort="highest_score", limit=4)),
    "lead_stats": lead_stats,
    "clean_leads": clean_leads,
    "clean_runs": clean_runs,
    "tenant_projects": tenant_projects,
    "latest_scan": latest_scan,
    "queue_since_scan": queue_since_scan,
    "leads_since_scan": leads_since_scan,
    "scan_stages": scan_stages,
    "oldest_pending": oldest_pending,
    "community_rules": community_rules,
    "leads_with_badge": leads_with_badge,
    "format_leads": format_leads,
    "project_urls": project_urls,
    "page_extract": page_extract,
    "matched_terms_json": matched_terms_json,
    "score_missing": score_missing,
    "project_prompts": project_prompts,
    "stream_intake": stream_intake,
    "stream_daily": stream_daily,
    "page_analysis": page_analysis,
}

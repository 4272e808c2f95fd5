"""Queue and run transitions, secured reads, plug-ins, connector parts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleanline import session as sessions
from gleanline.operators import plugins, queue, runs, serving, tables, terms
from gleanline.sources import forum, pages

T = dt.datetime
NOW = T(2026, 1, 2, 12)
QUEUE = "id string, project_id string, user_id string, status string, processing_started_at timestamp_ntz, attempt_count int, error_message string, gemini_call_attempted_at timestamp_ntz, ai_score int, ai_qualified boolean, created_at timestamp_ntz, updated_at timestamp_ntz"
OLD, FRESH, EDGE = T(2026, 1, 2, 11), T(2026, 1, 2, 11, 50), T(2026, 1, 2, 11, 45)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def row(id, status="pending", started=None, attempts=0, called=None, score=None, created=OLD, project="p"):
    return (id, project, "u", status, started, attempts, None, called, score, None, created, OLD)


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_claim_takes_the_oldest_and_counts_an_attempt(spark):
    q = spark.createDataFrame([row("a", created=T(2026, 1, 2)), row("b", created=T(2026, 1, 1)), row("c", created=None), row("d", "failed"), row("e", project="x", created=T(2025, 1, 1))], QUEUE)
    after, claimed = queue.claim(q, now(), 1, project_id="p")
    got = by_id(after)
    assert [r["id"] for r in claimed.collect()] == ["b"]
    assert (got["b"]["status"], got["b"]["attempt_count"], got["b"]["processing_started_at"], got["b"]["updated_at"]) == ("processing", 1, NOW, NOW)
    assert got["a"]["status"] == "pending" and got["a"]["updated_at"] == OLD and got["e"]["status"] == "pending"
    assert queue.claim(q.limit(0), now(), 3)[1].count() == 0
    assert {r["id"] for r in queue.claim(q, now(), 1, per="project_id")[1].collect()} == {"b", "e"}


def test_stale_rows_wait_again_unless_the_call_is_unclear(spark):
    rows = [row("never", "processing", OLD, 1), row("unclear", "processing", OLD, 2, OLD), row("answered", "processing", OLD, 1, OLD, 7), row("edge", "processing", EDGE, 1), row("fresh", "processing", FRESH, 1, FRESH), row("null", "processing", None), row("pending")]
    after, count = queue.recover_stale(spark.createDataFrame(rows, QUEUE), now())
    got = by_id(after)
    assert {i: r["status"] for i, r in got.items()} == {"never": "pending", "unclear": "failed", "answered": "pending", "edge": "processing", "fresh": "processing", "null": "processing", "pending": "pending"}
    assert got["unclear"]["error_message"] == queue.UNCLEAR and got["unclear"]["processing_started_at"] == OLD
    assert got["answered"]["processing_started_at"] is None and got["answered"]["attempt_count"] == 1
    assert count.first()["reset"] == 2
    scoped, other = queue.recover_stale(spark.createDataFrame(rows, QUEUE), now(), project_id="x")
    assert other.first()["reset"] == 0 and by_id(scoped)["never"]["status"] == "processing"


def test_results_are_recorded_then_rows_end(spark):
    q = spark.createDataFrame([row("a", "processing"), row("b", "processing"), row("c")], QUEUE)
    results = spark.createDataFrame([("a", 9, True), ("b", None, None)], "id string, ai_score int, ai_qualified boolean")
    recorded = by_id(queue.record_results(q, results, now()))
    assert recorded["a"]["ai_score"] == 9 and recorded["a"]["status"] == "processing" and recorded["c"]["updated_at"] == OLD
    ended = by_id(queue.record_results(q, results, now(), complete=True))
    assert ended["a"]["status"] == ended["b"]["status"] == "completed"
    failed = by_id(queue.mark_failed(q, spark.createDataFrame([("b", "no")], "id string, error_message string"), now()))
    assert (failed["b"]["status"], failed["b"]["error_message"]) == ("failed", "no")
    assert by_id(queue.mark_attempted(q, results.limit(1), now()))["a"]["gemini_call_attempted_at"] == NOW


def test_a_candidate_without_project_fails_and_a_lead_keeps_its_status(spark):
    claimed = spark.createDataFrame([("a", "p", "u", "i1", 8, True), ("b", "gone", "u", "i2", None, None), ("c", "p", "other", "i3", None, None)], "id string, project_id string, user_id string, reddit_item_id string, ai_score int, ai_qualified boolean")
    projects = spark.createDataFrame([("p", "u", "about")], "id string, user_id string, description string")
    found, failures = queue.with_project(claimed, projects, ["description"])
    assert [r["id"] for r in found.collect()] == ["a"] and by_id(failures)["b"]["error_message"] == "Project gone not found."
    leads = spark.createDataFrame([("l", "p", "i1", 3, "contacted")], "id string, project_id string, reddit_item_id string, ai_score int, status string")
    q = spark.createDataFrame([row("a", "processing"), row("b", "processing"), row("c", "processing")], QUEUE)
    after, after_leads = queue.finish(q, leads, found.drop("project"), failures, now())
    assert {i: r["status"] for i, r in by_id(after).items()} == {"a": "completed", "b": "failed", "c": "failed"}
    assert [(r["id"], r["ai_score"], r["status"]) for r in after_leads.collect()] == [("l", 8, "contacted")]
    assert tuple(queue.summary(found, failures).first()) == (1, 1, 2)
    assert tuple(queue.summary(found.limit(0), failures.limit(0)).first()) == (0, 0, 0)


RUNS = "id string, project_id string, user_id string, status string, leads_found int, error_message string, started_at timestamp_ntz, completed_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"


def test_a_project_runs_once_at_a_time(spark):
    log = spark.createDataFrame([("r1", "p", "u", "running", 0, None, FRESH, None, OLD, OLD), ("r2", "q", "u", "running", 0, None, OLD, None, OLD, OLD)], RUNS)
    asked = spark.createDataFrame([("n1", "p", "u"), ("n2", "q", "u"), ("n3", "q", "u"), ("n4", "z", "u")], "id string, project_id string, user_id string")
    after, refused = runs.start_runs(log, asked, now())
    got = by_id(after)
    assert {i: r["status"] for i, r in got.items()} == {"r1": "running", "r2": "failed", "n2": "running", "n4": "running"}
    assert got["r2"]["error_message"] == runs.TIMED_OUT and got["n2"]["leads_found"] == 0 and got["n2"]["started_at"] == NOW
    assert {r["id"] for r in refused.collect()} == {"n1", "n3"}
    ended = by_id(runs.end_runs(after, spark.createDataFrame([("n2", 5, None), ("n4", None, "bad")], "id string, leads_found int, error_message string"), now()))
    assert (ended["n2"]["status"], ended["n2"]["leads_found"]) == ("success", 5) and (ended["n4"]["status"], ended["n4"]["error_message"]) == ("failed", "bad")


def test_errors_of_a_run_become_safe_messages(spark):
    def fails(error):
        def step():
            raise error

        return runs.run_project(step, lambda: None, lambda: 3)[1]

    assert runs.run_project(lambda: None, lambda: None, lambda: 3) == (3, None)
    assert fails(forum.FetchError("missing api credentials")) == runs.NOT_SET_UP
    assert fails(forum.FetchError("secret token abc", 500)) == runs.SOURCE_FAILED
    assert fails(ValueError("Project not found.")) == runs.NO_PROJECT and fails(ValueError("password=x")) == runs.RUN_FAILED
    rows = spark.createDataFrame([("source", "Missing Reddit API credentials"), ("source", "429"), ("other", "Project not found."), (None, None)], "k string, m string")
    assert [r[0] for r in rows.select(runs.safe_message(F.col("k"), F.col("m"))).collect()] == [runs.NOT_SET_UP, runs.SOURCE_FAILED, runs.NO_PROJECT, runs.RUN_FAILED]


def test_reads_and_writes_are_secured(spark):
    rows = spark.createDataFrame([("1", "me"), ("2", "you"), ("3", None)], "id string, user_id string")
    profiles = spark.createDataFrame([("me",), ("you",)], "id string")
    seen = serving.secured({"leads": rows, "profiles": profiles}, "me")
    assert [r["id"] for r in seen["leads"].collect()] == ["1"] and [r["id"] for r in seen["profiles"].collect()] == ["me"]
    allowed, refused = serving.write_allowed(rows, "me")
    assert allowed.count() == 1 and {r["id"] for r in refused.collect()} == {"2", "3"}
    assert serving.secured({"leads": rows}, None)["leads"].count() == 0


def test_places_of_a_sorted_list(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 101) for i in range(101)], "id int, at int").repartition(7)
    got = serving.numbered(rows.orderBy("at", "id")).collect()
    assert all(r["place"] == r["at"] + 1 for r in got) and len(got) == 101


def test_derived_rows_and_trimmed_lists(spark):
    users = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "user_id string, x int")
    known = spark.createDataFrame([("b", 9)], "id string, x int")
    made = tables.derived_rows(users, known, "id", {"id": F.col("user_id"), "x": F.col("x")})
    assert sorted(map(tuple, made.collect())) == [("a", 1), ("b", 9)]
    lists = spark.createDataFrame([(["  a ", "﻿", "A", "b\t"],)], "l array<string>")
    assert lists.select(terms.distinct_list(F.col("l"))).first()[0] == ["a", "b"] and lists.select(terms.clean_list(F.col("l"))).first()[0] == ["a", "A", "b"]


def test_plug_ins_see_their_columns_only(spark):
    rows = spark.createDataFrame([("1", "x y", "secret")], "id string, t string, s string")
    seen = []

    def analyzer(x):
        assert list(x.columns) == ["t"]
        return x.assign(n=x["t"].str.split(" ").str.len())[["n"]]

    assert [tuple(r) for r in plugins.analyzed(rows, "id", ["t"], analyzer, "n long", lambda x: x["n"] > 0).collect()] == [("1", 2)]
    with pytest.raises(Exception, match="breaks its schema"):
        plugins.analyzed(rows, "id", ["t"], analyzer, "n long", lambda x: x["n"] > 5).collect()
    assert seen == []


def test_tokens_are_kept_and_renewed():
    given, clock = iter(["a", "b", "c"]), [0.0]
    tokens = forum.Tokens(lambda: (next(given), 100.0), lambda: clock[0])
    assert tokens.get() == tokens.get() == "a"
    clock[0] = 41.0  # less than a minute before its end
    assert tokens.get() == "b"

    def get(token):
        if token == "b":
            raise forum.FetchError("refused", 401)
        return {"token": token}

    assert forum.authorized(get, tokens) == {"token": "c"}
    with pytest.raises(forum.FetchError, match="credentials"):
        forum.client_token("http://nowhere.invalid", "", "")


def test_pages_are_fetched_and_probed(spark):
    def fetch(url):
        if "slow" in url:
            raise TimeoutError
        return (404, "") if "gone" in url else (200, "<title>t</title>")

    urls = spark.createDataFrame([("http://a",), ("http://a",), ("http://gone",), ("http://slow",), (None,)], "url string")
    got = {r["url"]: (r["html"], r["error"]) for r in pages.fetched_pages(urls, "url", fetch).collect()}
    assert got == {"http://a": ("<title>t</title>", None), "http://gone": (None, "status 404"), "http://slow": (None, "TimeoutError")}
    asked = []

    def ask(url, method, timeout):
        asked.append(method)
        if method == "HEAD" and url == "refuses":
            return 405, ""
        if url == "down":
            raise OSError
        return (500, "") if url == "broken" else (200, "")

    assert pages.reachable("fine", ask) and pages.reachable("refuses", ask) and not pages.reachable("down", ask) and not pages.reachable("broken", ask)
    assert asked == ["HEAD", "HEAD", "GET", "HEAD", "GET", "HEAD"]


def test_page_caps():
    html = "<body>" + "".join(f"<h2>h{i}</h2>" for i in range(30)) + "x " * 9000 + "</body>"
    found = pages.extract(html)
    assert len(found["headings"]) == 20 and found["headings"][-1] == "h19" and len(found["body_text"]) == 8000


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(lambda: type("C", (), {"get": lambda self, k, d: d})())
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isEmpty": lambda self: True})()})()})()

    with pytest.raises(sessions.NoSharedFolder):
        sessions.shared_base(type("Spark", (), {"sparkContext": Context()})())

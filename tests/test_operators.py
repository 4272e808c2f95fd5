import datetime as dt

from pyspark.sql import functions as F

from gleanline.operators import rules, scan, serving, tables
from gleanline.sources import forum
from gleanline.sources.pages import extract
from gleanline.streaming import intake

T = dt.datetime


def test_cap_comes_before_deduplication(spark):
    found = spark.createDataFrame([("s", "x", 1), ("s", "x", 2), ("s", "y", 3), ("s", "z", 4)], "subreddit string, id string, arrival int")
    kept = scan.kept_posts(found, [F.col("arrival")], 3)
    assert sorted((r["id"], r["arrival"]) for r in kept.collect()) == [("x", 1), ("y", 3)]


def test_window_includes_its_bound(spark):
    rows = spark.createDataFrame([(1, T(2026, 1, 1)), (2, T(2026, 1, 2)), (3, T(2025, 12, 31, 23)), (4, None)], "id int, created_at timestamp_ntz")
    assert {r["id"] for r in scan.recent(rows, "2026-01-08 00:00:00").collect()} == {1, 2}


def test_typed_rows(spark):
    raw = spark.createDataFrame([("t3_a", "s", None, None, None, None, None, "/r/s/a", None, None, 0.0)], "name string, subreddit string, title string, selftext string, author string, author_fullname string, url string, permalink string, score int, num_comments int, created_utc double")
    r = scan.typed_posts(raw, "https://forum.example").first()
    assert (r["title"], r["author"], r["score"], r["permalink"]) == ("", "[deleted]", 0, "https://forum.example/r/s/a")


def test_insert_or_ignore(spark):
    old = spark.createDataFrame([("p", "a", 1)], "k string, i string, v int")
    new = spark.createDataFrame([("p", "a", 2), ("p", "b", 4), ("p", "b", 3)], "k string, i string, v int")
    merged, rejected = tables.insert_or_ignore(old, new, ["k", "i"], [F.col("v")])
    assert sorted(map(tuple, merged.collect())) == [("p", "a", 1), ("p", "b", 3)]
    assert sorted(r["v"] for r in rejected.collect()) == [2, 4]


def test_upsert_preserves_status(spark):
    old = spark.createDataFrame([("a", 5, "contacted"), ("b", 1, "new")], "k string, score int, status string")
    new = spark.createDataFrame([("a", None), ("c", 7)], "k string, score int")
    rows = {r["k"]: (r["score"], r["status"]) for r in tables.upsert(old, new, ["k"], {"status": "new"}).collect()}
    assert rows == {"a": (None, "contacted"), "b": (1, "new"), "c": (7, "new")}


def test_updates_treat_null_as_no(spark):
    t = spark.createDataFrame([(1, "x"), (2, None)], "id int, s string")
    assert tables.delete_where(t, F.col("s") == "x").count() == 1
    assert tables.affected(t, F.col("s") == "x").first()["affected"] == 1
    good, bad = tables.valid_rows(t, {"s": F.col("s") == "x"})
    assert [r["id"] for r in good.collect()] == [1] and bad.first()["failed_checks"] == ["s"]


def test_lead_stats(spark):
    rows = [("u", "p", s, a, None, None) for s, a in (("new", 9), ("new", 10), ("contacted", 6), ("contacted", 7))]
    leads = spark.createDataFrame(rows, "user_id string, project_id string, status string, ai_score int, safety_badge string, author string")
    r = serving.lead_stats(leads, ["project_id"]).first()
    assert (r["total"], r["new_leads"], r["contacted"], r["strong"], r["partial"]) == (4, 2, 2, 2, 2)
    odd = spark.createDataFrame([("u", "p", "??", None, "x", None)], leads.schema)
    c = serving.clean_leads(odd).first()
    assert (c["status"], c["ai_score"], c["safety_badge"], c["author"]) == ("new", 0, "without_rules", "[deleted]")


def test_count_since(spark):
    runs = spark.createDataFrame([("r1", "p", T(2026, 1, 2)), ("r2", "p", T(2026, 1, 3)), ("r3", "q", T(2026, 1, 1)), ("r4", "p", None)], "id string, project_id string, started_at timestamp_ntz")
    rows = spark.createDataFrame([("a", "p", T(2026, 1, 2)), ("b", "p", T(2026, 1, 3)), ("c", "p", T(2026, 1, 1)), ("d", "p", None)], "id string, project_id string, created_at timestamp_ntz")
    assert {r["id"]: r["n"] for r in serving.count_since(runs, rows, "n").collect()} == {"r1": 2, "r2": 1, "r3": 0}


def test_community_rules(spark):
    rows = [("none", 0, "Be nice", None), ("ban", 0, "Promotion", "allowed if asked"), ("ban", 1, "No spam", "Self-promotion is not allowed"), ("cond", 0, "Marketing", "with permission"), ("mention", 0, "Advertising", "see wiki"), ("nulls", 0, None, None)]
    found = {r["subreddit"]: (r["badge"], r["deciding_rule"]) for r in rules.rule_findings(spark.createDataFrame(rows, "subreddit string, ordinal int, short_name string, description string")).collect()}
    assert found == {"none": ("without_rules", None), "ban": ("promo_not_safe", "No spam"), "cond": ("promo_conditional", "Marketing"), "mention": ("promo_conditional", "Advertising"), "nulls": ("without_rules", None)}


def test_page_extraction():
    html = "<html><head><title>A &amp;  B</title><meta property='og:description' content='d'></head><body><script>no</script><h1> One </h1><h2></h2><svg><title>x</title></svg><p>text\n more</p></body>"
    assert extract(html) == {"title": "A & B", "meta_description": "d", "headings": ["One"], "body_text": "One text more"}
    assert extract(None) is None and extract("<html></html>") is None
    assert len(extract("<body>" + "ab " * 9000 + "</body>")["body_text"]) == 8000


def fetch(path, parameters):
    if path.endswith("rules"):
        return {"rules": [{"short_name": "r", "description": None}]} if "none" not in path else {}
    if "comments" in path:
        return [{}, {"data": {"children": [{"kind": "t1", "data": {"name": "t1_x", "link_id": "t3_1"}}, {"kind": "more", "data": {}}]}}]
    return {"data": {"children": [{"kind": "t3", "data": {"name": "t3_1", "title": parameters["q"], "created_utc": 1.0}}, {"kind": "t5", "data": {}}]}}


def test_forum_source(spark):
    spark.dataSource.register(forum.ForumSource)
    import sys

    sys.modules.setdefault("forum_fixture", sys.modules[__name__])

    def rows(kind, requests):
        reader = forum.ForumReader({"kind": kind, "requests": requests, "limit": "500", "fetch": f"{__name__}:fetch"})
        parts = reader.partitions()
        assert all(p.limit == 100 for p in parts)
        return [r for p in parts for r in reader.read(p)]

    assert [r[:4] for r in rows("posts", '[{"subreddit": "s", "value": "q1"}]')] == [("t3", "t3_1", None, "q1")]
    assert [r[1] for r in rows("comments", '[{"subreddit": "s", "value": "t3_1"}]')] == ["t1_x"]
    assert rows("rules", '[{"subreddit": "a b"}, {"subreddit": "none"}]') == [("a b", 0, "r", None)]


def test_retry_and_drain():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise forum.FetchError("slow", 429, 7.0 if len(calls) == 1 else None)
        return {}

    assert forum.with_retry(flaky, waits.append) == {} and waits == [7.0, 2.0]
    limited = {"b": 2}

    def term(t):
        if limited.get(t, 0):
            limited[t] -= 1
            raise forum.FetchError("slow", 429)
        return [t]

    assert forum.drain(["a", "b", "c"], term, lambda s: None) == (["a", "c", "b"], [])

    def never(t):
        raise forum.FetchError("slow", 429)

    assert forum.drain(["a"], never, lambda s: None) == ([], ["a"])


def test_streaming_intake(spark, tmp_path):
    rows = [("a", T(2026, 1, 1)), ("a", T(2026, 1, 1)), ("b", T(2026, 1, 2))]
    spark.createDataFrame(rows, "k string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, at timestamp").parquet(str(tmp_path / "in"))
    got = []
    query = intake.drain_to(intake.first_deliveries(stream, ["k"], "at"), lambda df, n: got.extend(r["k"] for r in df.collect()), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert sorted(got) == ["a", "b"]


def test_search_finds_phrases_of_whole_words(spark):
    posts = spark.createDataFrame(
        [("c", "1", "Need a CRM-tool", "now", T(2026, 1, 1)), ("c", "2", "crm", "tool", T(2026, 1, 3)), ("c", "2", "crm", "tool", T(2026, 1, 3)), ("c", "3", "scrm tools", None, T(2026, 1, 2)), ("d", "4", "crm tool", "", T(2026, 1, 1)), ("c", "5", "日本語の道具", "", T(2026, 1, 1)), ("c", "6", "crm for a tool", "", T(2026, 1, 5))],
        "subreddit string, id string, title string, body string, created_at timestamp_ntz",
    )
    grid = spark.createDataFrame([("p", "c", "CRM tool"), ("p", "c", "crm"), ("q", "c", "crm Tool"), ("p", "c", "日本"), ("p", "c", " ")], "project_id string, subreddit string, term string")
    got = {}
    for r in scan.search(posts, grid, limit=2).collect():
        got.setdefault((r["project_id"], r["term"]), []).append(r["id"])
    assert {k: sorted(v) for k, v in got.items()} == {("p", "CRM tool"): ["1", "2"], ("q", "crm Tool"): ["1", "2"], ("p", "crm"): ["2", "6"], ("p", "日本"): ["5"]}

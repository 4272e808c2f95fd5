import random
import re

from gleanline.functions.text import FILLER_WORDS, lemma, porter_stem
from gleanline.operators import matching, terms

PROJECTS = "id string, keywords array<string>, intent_phrases array<string>, pain_phrases array<string>, competitors array<string>, hidden_keywords array<string>, subreddits array<string>"


def project(spark, rows):
    full = [(i, *[t.get(c, []) for c in ("keywords", "intent_phrases", "pain_phrases", "competitors", "hidden_keywords")], ["a", "b"]) for i, t in rows]
    return spark.createDataFrame(full, PROJECTS)


def engine(spark, texts, **lists):
    items = spark.createDataFrame([("p", str(i), t) for i, t in enumerate(texts)], "project_id string, item_id string, text string")
    found = matching.matching_engine(items, project(spark, [("p", lists)])).collect()
    return {(int(r["item_id"]), r["category"], r["term"]): r["technique"] for r in found}


def test_flexible_phrases(spark):
    texts = ["a pdf-to-video b", "pdf / to / video", "PDF: to video", "brand247", "superbrand24", "brand24!", "c++ rocks", "c rocks"]
    found = engine(spark, texts, keywords=["pdf to video", "brand24", "c++"])
    assert {k[0] for k in found if k[2] == "pdf to video"} == {0, 1, 2}
    assert {k[0] for k in found if k[2] == "brand24"} == {5}
    assert found[(6, "keywords", "c++")] == "Flexible Phrase Matching" and found[(7, "keywords", "c++")] == "Rule-Based Phrase Similarity"


def test_competitors_match_exactly(spark):
    found = engine(spark, ["google analytics", "google-analytics", "apollos myapolloapp", "try Apollo.", "apolo"], competitors=["google analytics", "Apollo"])
    assert set(found) == {(0, "competitors", "google analytics"), (3, "competitors", "Apollo")}
    assert set(found.values()) == {"Exact Competitor Matching"}


def test_fuzzy(spark):
    cases = [("monitor", "moniter", True), ("analytics", "analyticcs", True), ("notification", "notifcation", True), ("qualification", "qualificaiton", True), ("gather", "gathher", True), ("leadfinder", "leadfnder", True), ("monitor", "moneytor", False), ("video", "audio", False), ("brand24", "brand42", False)]
    found = engine(spark, [f"my {typo} here" for _, typo, _ in cases], keywords=[f"my {w}" for w, *_ in cases])
    for i, (word, _, hit) in enumerate(cases):
        assert (found.get((i, "keywords", f"my {word}")) == "Fuzzy Matching") is hit, word


def test_stems_lemmas_and_similarity(spark):
    found = engine(spark, ["we went home", "she was runing and runs daily", "a notification for the settings page", "notification about email settings", "an alternative"], keywords=["go home", "run daily"], intent_phrases=["notification settings", "alternative to", "for the"])
    assert found[(0, "keywords", "go home")] == "Lemmatization"
    assert found[(1, "keywords", "run daily")] == "Stemming"
    assert found[(2, "intent_phrases", "notification settings")] == "Rule-Based Phrase Similarity"
    assert (3, "intent_phrases", "notification settings") not in found
    assert (4, "intent_phrases", "alternative to") in found
    assert not [k for k in found if k[2] == "for the" and k[0] != 2]


def test_a_further_spelling_shows_up_through_another_technique_only(spark):
    found = engine(spark, ["apollo apollo", "apollo apolo", "apolo", "apollo apolo apollos"], keywords=["Apollo", "apollo", "apollo", "APOLLO", "  "])
    assert found == {
        (0, "keywords", "Apollo"): "Flexible Phrase Matching",
        (1, "keywords", "Apollo"): "Flexible Phrase Matching", (1, "keywords", "apollo"): "Fuzzy Matching",
        (2, "keywords", "Apollo"): "Fuzzy Matching",
        (3, "keywords", "Apollo"): "Flexible Phrase Matching", (3, "keywords", "apollo"): "Fuzzy Matching", (3, "keywords", "APOLLO"): "Stemming",
    }
    assert engine(spark, ["settings of the page"], keywords=["settings page", "Settings Page"]) == {(0, "keywords", "settings page"): "Rule-Based Phrase Similarity"}
    assert set(engine(spark, ["an apollo"], competitors=["APOLLO", "apollo"])) == {(0, "competitors", "APOLLO")}


def test_long_runs_of_fillers_break_a_phrase(spark):
    found = engine(spark, ["settings of the my page", "settings of the my a page", "the of settings", "a " * 50_000 + "settings the page"], keywords=["settings page"])
    assert {i for i, *_ in found} == {0, 3}


def model(text, term):
    """A plain model of the ranked techniques for one term."""
    n, t = " ".join(text.lower().split()), " ".join(term.lower().split())
    toks, tt = re.findall("[a-z0-9]+", n), re.findall("[a-z0-9]+", t)
    if re.search(r"(?<![a-z0-9])" + "[^a-z0-9]+".join(map(re.escape, t.split(" "))) + r"(?![a-z0-9])", n):
        return matching.TECHNIQUES[0]

    def osa1(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            d = [i for i in range(len(a)) if a[i] != b[i]]
            return len(d) == 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
        s, l = sorted((a, b), key=len)
        return any(l[:i] + l[i + 1 :] == s for i in range(len(l)))

    eligible = lambda w: len(w) >= 4 and not re.search(r"\d", w)
    pairs = {
        matching.TECHNIQUES[1]: lambda a, b: eligible(a) and eligible(b) and osa1(a, b),
        matching.TECHNIQUES[2]: lambda a, b: len(a) >= 2 and len(b) >= 2 and a != b and porter_stem(a) == porter_stem(b),
        matching.TECHNIQUES[3]: lambda a, b: len(a) >= 2 and len(b) >= 2 and a != b and lemma(a) == lemma(b),
    }
    for name, near in pairs.items():
        for i in range(len(toks) - len(tt) + 1) if tt else ():
            window = list(zip(tt, toks[i : i + len(tt)]))
            if all(a == b or near(a, b) for a, b in window) and any(near(a, b) for a, b in window):
                return name
    words = [w for w in tt if w not in FILLER_WORDS]
    gap = f"(?: (?:{'|'.join(FILLER_WORDS)})){{0,3}} "
    if words and re.search(r"(?<![^ ])" + gap.join(words) + r"(?![^ ])", " ".join(toks)):
        return matching.TECHNIQUES[4]
    return None


def test_engine_agrees_with_plain_model(spark):
    rng = random.Random(4)
    vocab = "monitor moniter montior run runs running the a to of lead leads leader better good box boxes brand24 api pricing price priced c++ x-ray went go".split()
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, 9))) for _ in range(120)]
    wanted = sorted({" ".join(rng.choices(vocab, k=rng.randint(1, 3))) for _ in range(40)})
    found = engine(spark, texts, keywords=wanted)
    expected = {(i, "keywords", t): m for i, x in enumerate(texts) for t in wanted if (m := model(x, t))}
    assert found == expected


def test_counts_keep_items_without_matches(spark):
    items = spark.createDataFrame([("p", "0", "alpha beta"), ("p", "1", None), ("q", "2", "alpha")], "project_id string, item_id string, text string")
    found = matching.matching_engine(items, project(spark, [("p", {"keywords": ["alpha", "beta"], "competitors": ["beta"]})]))
    counts = {r["item_id"]: (r["n_keywords"], r["n_competitors"], r["n_categories"]) for r in matching.match_counts(items, found).collect()}
    assert counts == {"0": (2, 1, 2), "1": (0, 0, 0), "2": (0, 0, 0)}


def test_search_terms(spark):
    p = project(spark, [("p", {"keywords": [" CRM ", "crm", "", "lead finder"], "intent_phrases": ["Lead Finder", "need a tool"], "hidden_keywords": ["x"]})])
    rows = terms.term_batches(terms.search_terms(p), 2).orderBy("position").collect()
    assert [(r["position"], r["term"], r["batch"]) for r in rows] == [(0, "CRM", 0), (1, "lead finder", 0), (2, "need a tool", 1), (3, "x", 1)]
    assert terms.request_grid(p, terms.search_terms(p)).count() == 8

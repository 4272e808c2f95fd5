"""SQL equivalents of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

NOW = "TIMESTAMP '2026-08-31 23:59:59'"
FULL = "".join(chr(0xFF01 + i) for i in range(94))
HALF = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
ROMAN, LETTERS = "ⅰⅴⅹⅼⅽⅾⅿ", "ivxlcdm"
SPACES = "".join(map(chr, [0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0xFEFF, 0x2028, 0x2029, 9, 10, 11, 12, 13]))
BLANKS = " " * len(SPACES)


def normal(column: str) -> str:
    """Compatibility normal form over the characters these tables hold, lower case, single spaces."""
    x = f"nfc_normalize(coalesce({column}, ''))"
    x = f"translate({x}, '{FULL}{ROMAN}', '{HALF}{LETTERS}')"
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("…", "..."), ("™", "TM"), ("²", "2"), ("³", "3"), ("½", "1⁄2")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim(regexp_replace(lower(translate({x}, '{SPACES}', '{BLANKS}')), ' +', ' ', 'g'))"


FILLERS = "'a','an','the','to','for','of','is','are','my','your','our','and','or','in','on','at'"
ITEMS = f"""
  items AS (SELECT DISTINCT id AS item_id, project_id, {normal("CASE WHEN item_type = 'post' THEN CASE WHEN coalesce(body, '') <> '' THEN coalesce(title, '') || chr(10) || chr(10) || body ELSE coalesce(title, '') END ELSE coalesce(body, '') END")} AS n FROM gemini_qualification_queue),
  padded AS (SELECT *, ' ' || trim(regexp_replace(n, '[^a-z0-9]+', ' ', 'g')) || ' ' AS toks FROM items)"""
LISTS = [("keywords", 0), ("intent_phrases", 1), ("pain_phrases", 2), ("competitors", 3), ("hidden_keywords", 4)]
LONG = "long_terms AS (" + " UNION ALL ".join(f"SELECT id AS project_id, '{c}' AS category, {r} AS category_rank, unnest(range(len({c}))) AS ordinal, unnest({c}) AS term FROM projects" for c, r in LISTS) + ")"
TERMS = f"{LONG}, terms AS (SELECT * FROM (SELECT project_id, category, category_rank, ordinal, term, {normal('term')} AS t FROM long_terms) WHERE t <> '')"
WORDS = "list_filter(string_split_regex(t, '[^a-z0-9]+'), lambda x: x <> '')"
ESCAPED = r"regexp_replace(w, '([^a-z0-9])', '\\\1', 'g')"

SPELLED = f"{TERMS}, spelled AS (SELECT *, row_number() OVER (PARTITION BY project_id, category, t ORDER BY ordinal) AS spelling FROM (SELECT project_id, category, t, term, min(ordinal) AS ordinal FROM terms GROUP BY ALL)), firsts AS (SELECT project_id, category, t, term FROM spelled WHERE spelling = 1)"
#: Techniques one by one: (item_id, project_id, category, t) of general terms, or of competitors.
FLEXIBLE = f"""flexible AS (SELECT DISTINCT item_id, project_id, category, t FROM items JOIN (SELECT DISTINCT project_id, category, t, '(^|[^a-z0-9])' || array_to_string(list_transform(list_filter(string_split(t, ' '), lambda x: x <> ''), lambda w: {ESCAPED}), '[^a-z0-9]+') || '($|[^a-z0-9])' AS p FROM terms WHERE category <> 'competitors') USING (project_id) WHERE regexp_matches(n, p))"""
RIVALS = f"""rivals AS (SELECT DISTINCT item_id, project_id, category, t FROM items JOIN (SELECT DISTINCT project_id, category, t, '(^|[^a-z0-9])' || {ESCAPED.replace('(w,', '(t,')} || '($|[^a-z0-9])' AS p FROM terms WHERE category = 'competitors') USING (project_id) WHERE regexp_matches(n, p))"""
SIMILAR = f"""bearing AS (SELECT DISTINCT project_id, category, t, list_filter({WORDS}, lambda x: x NOT IN ({FILLERS})) AS ws FROM terms WHERE category <> 'competitors'),
  alike AS (SELECT DISTINCT item_id, project_id, category, t FROM padded JOIN (SELECT project_id, category, t, ' ' || array_to_string(ws, '(?: (?:a|an|the|to|for|of|is|are|my|your|our|and|or|in|on|at)){{0,3}} ') || ' ' AS p FROM bearing WHERE len(ws) > 0) USING (project_id) WHERE regexp_matches(toks, p))"""
PLACES = f"""text_words AS (SELECT item_id, project_id, w, pos FROM (SELECT item_id, project_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (SELECT item_id, project_id, string_split(trim(toks), ' ') AS ws FROM padded)) WHERE w <> ''),
  term_words AS (SELECT project_id, category, t, n, unnest(ws) AS tw, unnest(range(n)) AS place FROM (SELECT DISTINCT project_id, category, t, {WORDS} AS ws, len({WORDS}) AS n FROM terms WHERE category <> 'competitors'))"""


def windows(name: str, near: str) -> str:
    """Terms that stand in a text word by word, each word alike or a pair of ``near`` (tw, w), at least one the latter."""
    return f"""{name} AS (SELECT DISTINCT item_id, project_id, category, t FROM (
      SELECT item_id, project_id, category, t, n, pos - place AS start, count(DISTINCT place) AS covered, bool_or(inexact) AS inexact FROM (
        SELECT x.item_id, x.project_id, category, t, n, pos, place, false AS inexact FROM text_words x JOIN term_words y ON x.project_id = y.project_id AND x.w = y.tw
        UNION ALL SELECT x.item_id, x.project_id, category, t, n, pos, place, true FROM term_words y JOIN {near} z ON z.tw = y.tw JOIN text_words x ON x.project_id = y.project_id AND x.w = z.w) GROUP BY ALL)
      WHERE covered = n AND inexact)"""


CLOSE = """vocabulary AS (SELECT DISTINCT w FROM text_words), close AS (SELECT tw, w FROM (SELECT DISTINCT tw FROM term_words) JOIN vocabulary ON abs(length(tw) - length(w)) <= 1 AND tw <> w
  WHERE length(tw) >= 4 AND length(w) >= 4 AND NOT regexp_matches(tw, '[0-9]') AND NOT regexp_matches(w, '[0-9]') AND damerau_levenshtein(tw, w) <= 1)"""


def ranked(stemmed: str, lemmatised: str) -> str:
    """The techniques in their order: the first spelling by the first one, a further one by a later one."""
    return f"""tried AS (SELECT item_id, project_id, category, t, bool_or(k = 'f') AS f, bool_or(k = 'z') AS z, bool_or(k = 's') AS s, bool_or(k = 'l') AS l, bool_or(k = 'p') AS p, bool_or(k = 'e') AS e FROM (
      SELECT *, 'f' AS k FROM flexible UNION ALL SELECT *, 'z' FROM fuzzy UNION ALL SELECT *, 's' FROM {stemmed} UNION ALL SELECT *, 'l' FROM {lemmatised} UNION ALL SELECT *, 'p' FROM alike UNION ALL SELECT *, 'e' FROM rivals) GROUP BY ALL),
    told AS (SELECT item_id, project_id, category, term, CASE
        WHEN e THEN CASE WHEN spelling = 1 THEN 'Exact Competitor Matching' END
        WHEN f AND spelling = 1 THEN 'Flexible Phrase Matching'
        WHEN z AND spelling = CASE WHEN f THEN 2 ELSE 1 END THEN 'Fuzzy Matching'
        WHEN (s OR l) AND spelling = 1 + f::INT + z::INT THEN CASE WHEN s THEN 'Stemming' ELSE 'Lemmatization' END
        WHEN p AND spelling = 1 THEN 'Rule-Based Phrase Similarity' END AS technique FROM tried JOIN spelled USING (project_id, category, t)),
    matches AS (SELECT DISTINCT * FROM told WHERE technique IS NOT NULL)"""


def consonants(x: str) -> str:
    """A word as c and v, letter by letter; y is a vowel after a consonant."""
    return f"list_reduce(list_prepend('', string_split({x}, '')), lambda a, c: a || CASE WHEN c IN ('a', 'e', 'i', 'o', 'u') THEN 'v' WHEN c = 'y' AND right(a, 1) = 'c' THEN 'v' ELSE 'c' END)"


def measure(x: str) -> str:
    return f"len(regexp_extract_all({consonants(x)}, 'vc'))"


def double_end(x: str) -> str:
    return f"(length({x}) > 1 AND right({x}, 1) = left(right({x}, 2), 1) AND right({consonants(x)}, 1) = 'c')"


def short_end(x: str) -> str:
    return f"(length({x}) > 2 AND right({consonants(x)}, 3) = 'cvc' AND right({x}, 1) NOT IN ('w', 'x', 'y'))"


def longest(endings: list[tuple[str, str]], least: int, more: str = "") -> str:
    """The longest of the endings that a word has, replaced if what is before it measures more than ``least``."""
    whens = " ".join(f"WHEN w LIKE '%{end}' THEN CASE WHEN {measure(f'left(w, length(w) - {len(end)})')} > {least}{more if end == 'ion' else ''} THEN left(w, length(w) - {len(end)}) || '{new}' ELSE w END" for end, new in sorted(endings, key=lambda x: -len(x[0])))
    return f"CASE WHEN length(o) < 3 THEN w {whens} ELSE w END"


def word_forms(words: str) -> str:
    """stems (o, stem) and lemmas (o, lemma) of the distinct words ``words`` (o): the published stemmer of 1980 step by step, and irregular forms with regular endings."""
    from ..functions.text import ADJECTIVES, NOUNS, STEP_2, STEP_3, STEP_4, VERBS

    cut_by = lambda n: f"left(w, length(w) - {n})"
    vowel = lambda x: f"contains({consonants(x)}, 'v')"
    steps = ["SELECT o, o AS w FROM " + words]
    steps.append(f"SELECT o, CASE WHEN length(o) < 3 THEN w WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {cut_by(2)} WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN {cut_by(1)} ELSE w END AS w FROM s0")
    steps.append(f"SELECT o, w AS before, CASE WHEN length(o) < 3 THEN w WHEN w LIKE '%eed' THEN CASE WHEN {measure(cut_by(3))} > 0 THEN {cut_by(1)} ELSE w END WHEN w LIKE '%ed' AND {vowel(cut_by(2))} THEN {cut_by(2)} WHEN w LIKE '%ing' AND {vowel(cut_by(3))} THEN {cut_by(3)} ELSE w END AS w FROM s1")
    steps.append(f"SELECT o, CASE WHEN length(o) < 3 OR w = before OR before LIKE '%eed' THEN w WHEN w LIKE '%at' OR w LIKE '%bl' OR w LIKE '%iz' THEN w || 'e' WHEN {double_end('w')} AND right(w, 1) NOT IN ('l', 's', 'z') THEN {cut_by(1)} WHEN {measure('w')} = 1 AND {short_end('w')} THEN w || 'e' ELSE w END AS w FROM s2")
    steps.append(f"SELECT o, CASE WHEN length(o) >= 3 AND w LIKE '%y' AND {vowel(cut_by(1))} THEN {cut_by(1)} || 'i' ELSE w END AS w FROM s3")
    steps.append(f"SELECT o, {longest(STEP_2, 0)} AS w FROM s4")
    steps.append(f"SELECT o, {longest(STEP_3, 0)} AS w FROM s5")
    ion = f" AND right({cut_by(3)}, 1) IN ('s', 't')"
    steps.append(f"SELECT o, {longest([(e, '') for e in STEP_4], 1, ion)} AS w FROM s6")
    steps.append(f"SELECT o, CASE WHEN length(o) >= 3 AND w LIKE '%e' AND ({measure(cut_by(1))} > 1 OR ({measure(cut_by(1))} = 1 AND NOT {short_end(cut_by(1))})) THEN {cut_by(1)} ELSE w END AS w FROM s7")
    chain = ", ".join(f"s{i} AS MATERIALIZED ({x})" for i, x in enumerate(steps))
    table = lambda d: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in d.items()) + "}"
    noun = " ".join(f"WHEN o LIKE '%{e}' AND length(o) > {len(e) + 1} THEN left(o, length(o) - {len(e)}) || '{n}'" for e, n in (("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("zes", "z"), ("ies", "y")))
    stem = lambda n: f"left(o, length(o) - {n})"
    verb = " ".join(f"WHEN o LIKE '%{e}' AND length(o) > {len(e) + 2} AND {vowel(stem(len(e)))} THEN CASE WHEN {double_end(stem(len(e)))} AND right({stem(len(e))}, 1) NOT IN ('l', 's', 'z') THEN {stem(len(e) + 1)} WHEN regexp_matches({stem(len(e))}, '(at|iz|v|c|g|s)$') OR ({measure(stem(len(e)))} = 1 AND {short_end(stem(len(e)))}) THEN {stem(len(e))} || 'e' ELSE {stem(len(e))} END" for e in ("ing", "ed"))
    adjective = " ".join(f"WHEN o LIKE '%{e}' THEN {stem(len(e))} || 'y'" for e in ("iest", "ier")) + " " + " ".join(f"WHEN o LIKE '%{e}' AND length(o) > {len(e) + 2} AND {double_end(stem(len(e)))} AND right({stem(len(e))}, 1) NOT IN ('l', 's', 'z') THEN {stem(len(e) + 1)}" for e in ("est", "er"))
    lemmas = f"""SELECT o, CASE WHEN noun <> o THEN noun WHEN verb <> o THEN verb ELSE adjective END AS lemma FROM (SELECT o,
      coalesce(element_at({table(NOUNS)}, o)[1], CASE {noun} WHEN o LIKE '%s' AND NOT regexp_matches(o, '(ss|us|is)$') AND length(o) > 3 THEN {stem(1)} ELSE o END) AS noun,
      coalesce(element_at({table(VERBS)}, o)[1], CASE {verb} ELSE o END) AS verb, coalesce(element_at({table(ADJECTIVES)}, o)[1], CASE {adjective} ELSE o END) AS adjective FROM {words})"""
    return f"{chain}, stems AS (SELECT o, CASE WHEN length(o) >= 3 AND w LIKE '%ll' AND {measure(cut_by(1))} > 1 THEN {cut_by(1)} ELSE w END AS stem FROM s8), lemmas AS MATERIALIZED ({lemmas})"


NONE = "(SELECT * FROM flexible WHERE false)"
PRIORITY = f"{ITEMS}, {SPELLED}, {FLEXIBLE}, {RIVALS}, {SIMILAR}, {PLACES}, {CLOSE}, {windows('fuzzy', 'close')}, {ranked(NONE, NONE)}"
SAME_FORMS = "all_words AS (SELECT w AS o FROM vocabulary UNION SELECT tw FROM term_words), {forms}, " + ", ".join(f"same_{k} AS (SELECT DISTINCT tw, w FROM (SELECT DISTINCT tw, {k} AS x FROM term_words JOIN {k}s ON o = tw) JOIN (SELECT w, {k} AS x FROM vocabulary JOIN {k}s ON o = w) USING (x) WHERE tw <> w AND length(tw) >= 2 AND length(w) >= 2)" for k in ("stem", "lemma"))


def engine() -> str:
    forms = SAME_FORMS.format(forms=word_forms("all_words"))
    return f"{ITEMS}, {SPELLED}, {FLEXIBLE}, {RIVALS}, {SIMILAR}, {PLACES}, {CLOSE}, {forms}, {windows('fuzzy', 'close')}, {windows('stemmed', 'same_stem')}, {windows('lemmatised', 'same_lemma')}, {ranked('stemmed', 'lemmatised')}"


def counted() -> str:
    each = ", ".join(f"count(*) FILTER (category = '{c}') AS n_{c}" for c, _ in LISTS)
    return f"{engine()}, counts AS (SELECT item_id, project_id, {each}, count(DISTINCT category) FILTER (category IN ('keywords', 'competitors', 'hidden_keywords')) AS n_categories FROM matches GROUP BY ALL), counted AS (SELECT item_id, project_id, " + ", ".join(f"coalesce(n_{c}, 0) AS n_{c}" for c, _ in LISTS) + ", coalesce(n_categories, 0) AS n_categories FROM items LEFT JOIN counts USING (item_id, project_id))"


MOMENT = "TIMESTAMP '2026-08-25 22:10:00'"
QUEUE = "queue AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, attempt_count DESC NULLS LAST) AS n FROM gemini_qualification_queue) WHERE n = 1)"
QUEUE_COLUMNS = "id, status, processing_started_at, CAST(attempt_count AS BIGINT) AS attempt_count, error_message, gemini_call_attempted_at, CAST(ai_score AS BIGINT) AS ai_score, updated_at"
STALE_ROWS = f"(status = 'processing' AND processing_started_at < {NOW} - INTERVAL 15 MINUTE)"
UNCLEAR = "The scorer may have been called for this candidate before the worker crashed. Manual verification is required before any retry."
LOG = f"log AS (SELECT * REPLACE (CASE WHEN status = 'running' AND started_at < {MOMENT} - INTERVAL 15 MINUTE THEN 'failed' ELSE status END AS status) FROM sync_logs), busy AS (SELECT project_id, id, started_at FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC NULLS LAST, id) AS n FROM log WHERE status = 'running') WHERE n = 1)"
WORKER = f"""{QUEUE}, taken AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at NULLS LAST, id) AS place FROM queue WHERE status = 'pending') WHERE place <= 3),
  worked AS (SELECT t.id, t.project_id, t.reddit_item_id, t.ai_score IS NULL AS called, p.id IS NOT NULL AS found, coalesce(t.ai_score, length(coalesce(matched_text, '')) % 11) AS score FROM taken t LEFT JOIN projects p ON p.id = t.project_id AND p.user_id = t.user_id AND p.description IS NOT NULL)"""


def listed(where: str, order: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM ({LEADS}) WHERE {where}"


UNIQUE_TERMS = f"""
  {LONG},
  cleaned AS (SELECT project_id, category, category_rank, ordinal, trim(term) AS term FROM long_terms WHERE trim(term) <> ''),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY project_id, lower(term) ORDER BY category_rank, ordinal) AS n FROM cleaned),
  search AS (SELECT project_id, category, term, row_number() OVER (PARTITION BY project_id ORDER BY category_rank, ordinal) - 1 AS position FROM firsts WHERE n = 1)"""
POSTS = "posts AS (SELECT reddit_item_id AS post_id, id, subreddit, title, body, item_created_at AS created_at FROM gemini_qualification_queue WHERE item_type = 'post')"
LEADS = "SELECT DISTINCT id, CAST(ai_score AS BIGINT) AS ai_score, item_created_at FROM reddit_leads"
CLEAN = """
  SELECT id, project_id, user_id, coalesce(subreddit, '') AS subreddit, coalesce(author, '[deleted]') AS author, CAST(coalesce(score, 0) AS BIGINT) AS score, CAST(coalesce(ai_score, 0) AS BIGINT) AS ai_score,
    CASE WHEN safety_badge IN ('without_rules', 'promo_conditional', 'promo_not_safe') THEN safety_badge ELSE 'without_rules' END AS safety_badge,
    CASE WHEN status IN ('new', 'reviewed', 'contacted', 'ignored') THEN status ELSE 'new' END AS status FROM reddit_leads"""
RUNS = "SELECT id, project_id, started_at, CASE WHEN status IN ('running', 'success', 'failed') THEN status ELSE 'failed' END AS status, CAST(coalesce(leads_found, 0) AS BIGINT) AS leads_found FROM sync_logs"
LATEST = f"latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC NULLS LAST, id) AS n FROM ({RUNS})) WHERE n = 1)"


def any_of(text: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


def rule_kinds() -> str:
    from ..operators.rules import BANNED, CONDITIONAL, PROMOTION

    text = "lower(coalesce(short_name, '') || ' ' || coalesce(description, ''))"
    kind = f"CASE WHEN NOT {any_of(text, PROMOTION)} THEN 9 WHEN {any_of(text, BANNED)} THEN 0 WHEN {any_of(text, CONDITIONAL)} THEN 1 ELSE 2 END"
    return f"kinds AS (SELECT subreddit, short_name, description, ordinal, {kind} AS kind FROM subreddit_rules), found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY kind, ordinal) AS n FROM kinds) WHERE n = 1)"


BADGE = "CASE WHEN kind = 9 THEN 'without_rules' WHEN kind = 0 THEN 'promo_not_safe' ELSE 'promo_conditional' END"


def since(table: str, out: str) -> str:
    return f"SELECT r.id, r.project_id, CAST(count(q.id) AS BIGINT) AS {out} FROM sync_logs r LEFT JOIN (SELECT DISTINCT id, project_id, created_at FROM {table}) q ON q.project_id = r.project_id AND q.created_at >= r.started_at WHERE r.started_at IS NOT NULL GROUP BY r.id, r.project_id"


ORACLES = {
    "normalize_text": f"WITH {ITEMS} SELECT item_id, n AS normalized FROM items",
    "tokenize_counts": f"WITH {ITEMS} SELECT item_id, CAST(CASE WHEN trim(toks) = '' THEN 0 ELSE len(string_split(trim(toks), ' ')) END AS BIGINT) AS n_tokens, CAST(CASE WHEN trim(toks) = '' THEN 0 ELSE len(list_distinct(string_split(trim(toks), ' '))) END AS BIGINT) AS n_distinct FROM padded",
    "flexible_phrase": f"WITH {ITEMS}, {SPELLED}, {FLEXIBLE} SELECT DISTINCT item_id, category, term FROM flexible JOIN firsts USING (project_id, category, t)",
    "exact_competitor": f"WITH {ITEMS}, {SPELLED}, {RIVALS} SELECT DISTINCT item_id, category, term FROM rivals JOIN firsts USING (project_id, category, t)",
    "phrase_similarity": f"WITH {ITEMS}, {SPELLED}, {SIMILAR} SELECT DISTINCT item_id, category, term FROM alike JOIN firsts USING (project_id, category, t)",
    "fuzzy_match": f"WITH {ITEMS}, {SPELLED}, {PLACES}, {CLOSE}, {windows('fuzzy', 'close')} SELECT DISTINCT item_id, category, term FROM fuzzy JOIN firsts USING (project_id, category, t)",
    "match_priority": f"WITH {PRIORITY} SELECT * FROM matches",
    "match_engine": f"WITH {engine()} SELECT * FROM matches",
    "match_counts": f"WITH {counted()} SELECT * FROM counted",
    "qualified_candidates": f"WITH {counted()} SELECT * FROM counted WHERE n_categories > 0 ORDER BY n_categories DESC, item_id, project_id LIMIT 20",
    "stem_lemma_vocab": f"WITH {ITEMS}, v AS (SELECT DISTINCT unnest(string_split(trim(toks), ' ')) AS o FROM padded), vw AS (SELECT o FROM v WHERE o <> ''), {word_forms('vw')} SELECT o AS word, stem, lemma FROM stems JOIN lemmas USING (o)",
    "clean_term_lists": """WITH cleaned AS (SELECT id, list_filter(list_transform(keywords, lambda x: trim(x)), lambda x: x <> '') AS k, list_filter(list_transform(competitors, lambda x: trim(x)), lambda x: x <> '') AS c FROM projects),
        once AS (SELECT id, k, list_filter(k, lambda x, i: list_position(list_transform(k, lambda y: lower(y)), lower(x)) = i) AS ku, list_filter(c, lambda x, i: list_position(list_transform(c, lambda y: lower(y)), lower(x)) = i) AS cu FROM cleaned)
        SELECT id, array_to_string(ku, '|') AS keywords, array_to_string(k, '|') AS sanitized, array_to_string(cu[1:5], '|') AS competitors FROM once""",
    "fuzzy_vocab": f"""WITH {ITEMS}, {TERMS}, tw AS (SELECT DISTINCT unnest({WORDS}) AS term_word FROM terms WHERE category <> 'competitors'), vw AS (SELECT DISTINCT unnest(string_split(trim(toks), ' ')) AS word FROM padded)
        SELECT term_word, word FROM tw JOIN vw ON abs(length(term_word) - length(word)) <= 1 AND term_word <> word WHERE length(term_word) >= 4 AND length(word) >= 4 AND NOT regexp_matches(term_word, '[0-9]') AND NOT regexp_matches(word, '[0-9]') AND damerau_levenshtein(term_word, word) <= 1""",
    "search_terms": f"WITH {UNIQUE_TERMS} SELECT project_id, position, term, category FROM search",
    "term_batches": f"WITH {UNIQUE_TERMS} SELECT project_id, CAST(floor(position / 5) AS BIGINT) AS batch, string_agg(term, '|' ORDER BY position) AS terms FROM search GROUP BY ALL",
    "search_queries": f"""WITH {UNIQUE_TERMS} SELECT project_id, CASE WHEN contains(term, ' ') THEN '"' || term || '"' ELSE term END AS query FROM search""",
    "request_grid": f"WITH {UNIQUE_TERMS}, c AS (SELECT id AS project_id, unnest(subreddits) AS subreddit FROM projects) SELECT project_id, count(*) AS requests, count(DISTINCT subreddit) AS communities FROM c JOIN search USING (project_id) GROUP BY project_id",
    "scan_window": f"WITH {POSTS} SELECT DISTINCT id, post_id, created_at FROM posts WHERE created_at >= {NOW} - INTERVAL 7 DAY",
    "search_posts": f"""WITH {POSTS}, {UNIQUE_TERMS}, grid AS (SELECT DISTINCT project_id, subreddit, term FROM (SELECT id AS project_id, unnest(subreddits) AS subreddit FROM projects) JOIN search USING (project_id)),
        hits AS (SELECT DISTINCT project_id, g.subreddit, term, p.id, created_at FROM grid g JOIN (SELECT DISTINCT id, subreddit, created_at, lower(concat_ws(' ', title, body)) AS x FROM posts) p ON p.subreddit = g.subreddit AND CASE WHEN regexp_matches(lower(term), '[a-z0-9]') THEN contains(' ' || trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(lower(term), '[^a-z0-9]+', ' ', 'g')) || ' ') ELSE contains(x, lower(term)) END)
        SELECT project_id, subreddit, term, id FROM (SELECT *, row_number() OVER (PARTITION BY project_id, subreddit, term ORDER BY created_at DESC, id) AS n FROM hits) WHERE n <= 25""",
    "post_cap_per_community": "WITH capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY item_created_at, id, updated_at, attempt_count) AS n FROM gemini_qualification_queue WHERE item_type = 'post') WHERE n <= 50) SELECT subreddit, reddit_item_id AS post_id, id FROM (SELECT *, row_number() OVER (PARTITION BY reddit_item_id ORDER BY item_created_at, id, updated_at, attempt_count) AS k FROM capped) WHERE k = 1",
    "dedupe_items": "SELECT id, updated_at, CAST(attempt_count AS BIGINT) AS attempt_count FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, attempt_count DESC NULLS LAST) AS n FROM gemini_qualification_queue) WHERE n = 1",
    "comments_of_kept_posts": f"WITH c AS (SELECT DISTINCT id, parent_post_id AS post_id, item_created_at AS moment FROM gemini_qualification_queue WHERE item_type = 'comment'), firsts AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY moment, id) AS n FROM c WHERE post_id IN (SELECT post_id FROM c WHERE moment >= {NOW} - INTERVAL 30 DAY)) SELECT post_id, id FROM firsts WHERE n <= 2 AND moment >= {NOW} - INTERVAL 30 DAY",
    "enqueue_new": """WITH q AS (SELECT DISTINCT project_id, reddit_item_id, id FROM gemini_qualification_queue),
        fresh AS (SELECT project_id, reddit_item_id, min(id) AS id FROM reddit_leads l WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.project_id = l.project_id AND q.reddit_item_id = l.reddit_item_id) GROUP BY ALL)
        SELECT project_id, count(*) AS rows, count(DISTINCT reddit_item_id) AS items FROM (SELECT * FROM q UNION SELECT * FROM fresh) GROUP BY project_id""",
    "quarantine": """WITH c AS (SELECT id, list_filter([
          CASE WHEN NOT coalesce((item_type = 'post' AND parent_post_id IS NULL AND title IS NOT NULL) OR (item_type = 'comment' AND parent_post_id IS NOT NULL AND title IS NULL), false) THEN 'shape' END,
          CASE WHEN NOT coalesce(status IN ('new', 'reviewed', 'contacted', 'ignored'), false) THEN 'status' END,
          CASE WHEN safety_badge NOT IN ('without_rules', 'promo_conditional', 'promo_not_safe') THEN 'badge' END], lambda x: x IS NOT NULL) AS f FROM reddit_leads)
        SELECT DISTINCT id, array_to_string(f, ',') AS failed_checks FROM c WHERE len(f) > 0""",
    "blocking_runs": f"WITH {LOG} SELECT * FROM busy",
    "start_runs": f"WITH {LOG} SELECT 'run-' || p.id AS id, p.id AS project_id, user_id, CASE WHEN b.id IS NULL THEN 'running' ELSE 'refused' END AS status, CASE WHEN b.id IS NULL THEN 0::BIGINT END AS leads_found, CASE WHEN b.id IS NULL THEN {MOMENT} END AS started_at FROM projects p LEFT JOIN busy b ON b.project_id = p.id",
    "end_runs": f"""WITH l AS (SELECT DISTINCT id, project_id, created_at FROM reddit_leads), ended AS (SELECT r.id, count(l.id) AS n FROM sync_logs r LEFT JOIN l ON l.project_id = r.project_id AND l.created_at >= r.started_at WHERE r.status = 'running' GROUP BY r.id)
        SELECT r.id, CASE WHEN n = 0 THEN 'failed' WHEN n > 0 THEN 'success' ELSE status END AS status, CAST(CASE WHEN n > 0 THEN n ELSE leads_found END AS BIGINT) AS leads_found, CASE WHEN n = 0 THEN 'Scanning is not configured.' WHEN n IS NULL THEN error_message END AS error_message,
          CASE WHEN n IS NULL THEN completed_at ELSE {NOW} END AS completed_at, CASE WHEN n IS NULL THEN updated_at ELSE {NOW} END AS updated_at FROM sync_logs r LEFT JOIN ended e ON e.id = r.id""",
    "safe_errors": "SELECT id, CASE WHEN regexp_matches(error_message, '(?i)token|rate') THEN 'The source could not be read. Please try again.' ELSE 'The scan failed. Please try again.' END AS shown FROM sync_logs WHERE error_message IS NOT NULL",
    "queue_claim": f"WITH {QUEUE}, taken AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY project_id ORDER BY created_at NULLS LAST, id) AS place FROM queue WHERE status = 'pending') WHERE place <= 5) SELECT {QUEUE_COLUMNS} FROM (SELECT * REPLACE (CASE WHEN hit THEN 'processing' ELSE status END AS status, CASE WHEN hit THEN {NOW} ELSE processing_started_at END AS processing_started_at, attempt_count + hit::INT AS attempt_count, CASE WHEN hit THEN {NOW} ELSE updated_at END AS updated_at) FROM (SELECT *, id IN (SELECT id FROM taken) AS hit FROM queue))",
    "queue_recovery": f"WITH {QUEUE}, marked AS (SELECT *, coalesce({STALE_ROWS}, false) AS late, gemini_call_attempted_at IS NOT NULL AND ai_score IS NULL AS unclear FROM queue) SELECT {QUEUE_COLUMNS} FROM (SELECT * REPLACE (CASE WHEN late AND unclear THEN 'failed' WHEN late THEN 'pending' ELSE status END AS status, CASE WHEN late AND unclear THEN '{UNCLEAR}' ELSE error_message END AS error_message, CASE WHEN late AND NOT unclear THEN NULL ELSE processing_started_at END AS processing_started_at, CASE WHEN late THEN {NOW} ELSE updated_at END AS updated_at) FROM marked)",
    "queue_recovered": f"WITH {QUEUE} SELECT count(*) AS reset FROM queue WHERE {STALE_ROWS} AND NOT (gemini_call_attempted_at IS NOT NULL AND ai_score IS NULL)",
    "worker_queue": f"WITH {WORKER} SELECT {QUEUE_COLUMNS} FROM (SELECT q.* REPLACE (CASE WHEN w.id IS NULL THEN status WHEN found THEN 'completed' ELSE 'failed' END AS status, CASE WHEN w.id IS NULL THEN processing_started_at ELSE {NOW} END AS processing_started_at, attempt_count + (w.id IS NOT NULL)::INT AS attempt_count, CASE WHEN w.id IS NULL THEN error_message WHEN NOT found THEN 'Project ' || q.project_id || ' not found.' END AS error_message, CASE WHEN called THEN {NOW} ELSE gemini_call_attempted_at END AS gemini_call_attempted_at, CASE WHEN found THEN score ELSE ai_score END AS ai_score, CASE WHEN w.id IS NULL THEN updated_at ELSE {NOW} END AS updated_at) FROM queue q LEFT JOIN worked w ON w.id = q.id)",
    "worker_leads": f"""WITH {WORKER}, l AS (SELECT * FROM (SELECT project_id, reddit_item_id, ai_score, status, row_number() OVER (PARTITION BY project_id, reddit_item_id ORDER BY id, updated_at DESC NULLS LAST, status NULLS LAST) AS n FROM reddit_leads) WHERE n = 1), w AS (SELECT * FROM worked WHERE found AND score > 5)
        SELECT coalesce(l.project_id, w.project_id) AS project_id, CASE WHEN l.project_id IS NULL THEN 'new' ELSE status END AS status, count(*) AS leads, CAST(sum(CASE WHEN w.id IS NULL THEN ai_score ELSE score END) AS BIGINT) AS score FROM l FULL JOIN w ON l.project_id = w.project_id AND l.reddit_item_id = w.reddit_item_id GROUP BY 1, 2""",
    "worker_summary": f"WITH {WORKER} SELECT count(*) FILTER (found) AS processed, count(*) FILTER (found AND score > 5) AS qualified, count(*) FILTER (NOT found) AS failed FROM worked",
    "candidate_prompts": f"""WITH {QUEUE} SELECT q.id, array_to_string(['PROJECT CONTEXT', '', 'Business description: ' || coalesce(description, ''), '', 'Keywords the business associates with its space: ' || {{keywords}}, '', 'Phrases that signal someone is looking for a solution like this: ' || {{intent_phrases}}, '', 'Phrases that signal someone is frustrated with the problem this business solves: ' || {{pain_phrases}}, '', 'Known competitors in this space: ' || {{competitors}}, '', 'CANDIDATE CONTENT', '',
          'Type: ' || item_type, 'Subreddit: r/' || coalesce(subreddit, ''), 'Title: ' || coalesce(title, '(none - this is a comment)'), 'Content:', coalesce(matched_text, 'null'), '', 'Score: ' || coalesce(CAST(reddit_score AS VARCHAR), 'null'), 'Posted at: ' || coalesce(strftime(item_created_at, '%Y-%m-%d %H:%M:%S'), 'null'), 'Permalink: ' || coalesce(permalink, '')], chr(10)) AS prompt
        FROM queue q JOIN projects p ON p.id = q.project_id AND p.user_id = q.user_id WHERE q.status = 'pending'""".format(**{c: f"CASE WHEN coalesce(len(p.{c}), 0) > 0 THEN array_to_string(p.{c}, ', ') ELSE '(none provided)' END" for c in ("keywords", "intent_phrases", "pain_phrases", "competitors")}),
    "insert_projects": """WITH offered AS (SELECT 'new-' || id AS id, user_id, CASE WHEN length(website_url) % 2 = 0 THEN website_url || '/2' ELSE website_url END AS website_url FROM projects WHERE length(website_url) % 3 = 0)
        SELECT id, user_id, website_url, 'stored' AS outcome FROM projects UNION ALL SELECT id, user_id, website_url, CASE WHEN EXISTS (SELECT 1 FROM projects p WHERE p.user_id = o.user_id AND p.website_url = o.website_url) THEN 'refused' ELSE 'stored' END FROM offered o""",
    "update_projects": f"SELECT id, name, CASE WHEN mine THEN 'edited' ELSE description END AS description, array_to_string(CASE WHEN mine THEN list_filter(list_transform(keywords, lambda x: trim(x)), lambda x: x <> '') ELSE keywords END, '|') AS keywords, CAST(len(hidden_keywords) AS BIGINT) AS n_hidden, CASE WHEN mine THEN {NOW} ELSE updated_at END AS updated_at FROM (SELECT *, user_id = (SELECT min(user_id) FROM projects) AS mine FROM projects)",
    "profiles": f"WITH known AS (SELECT user_id AS id, min(created_at) AS created_at FROM sync_logs WHERE created_at < TIMESTAMP '2026-06-01 00:00:00' GROUP BY 1) SELECT * FROM known UNION ALL SELECT DISTINCT user_id, {NOW} FROM projects WHERE user_id NOT IN (SELECT id FROM known)",
    "secured_counts": "WITH u AS (SELECT max(user_id) AS me FROM projects) " + " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS rows FROM {t}, u WHERE user_id = me" for t in ("projects", "gemini_qualification_queue", "reddit_leads", "sync_logs")) + " UNION ALL SELECT 'refused', count(*) FROM reddit_leads, u WHERE user_id <> me",
    "tenant_leads": "WITH f AS (SELECT id AS pid, user_id AS uid FROM projects ORDER BY user_id, id LIMIT 1) SELECT id, ai_score, row_number() OVER (ORDER BY ai_score DESC NULLS LAST, item_created_at DESC NULLS LAST, id) AS place FROM (SELECT DISTINCT id, CAST(ai_score AS BIGINT) AS ai_score, item_created_at FROM reddit_leads, f WHERE user_id = uid AND project_id = pid)",
    "remaining_terms": f"WITH {UNIQUE_TERMS} SELECT project_id, count(*) AS remaining FROM search WHERE position >= 5 GROUP BY project_id",
    "normalized_copies": f"SELECT DISTINCT id, {normal('title')} AS normalized_title, {normal('body')} AS normalized_body FROM gemini_qualification_queue WHERE item_type = 'post'",
    "listing_rows": r"SELECT DISTINCT id, item_type AS type, coalesce(author, '[deleted]') AS author, CASE WHEN coalesce(regexp_replace(permalink, '^https?://[^/]*', ''), '') = '' THEN '' ELSE 'https://forum.example' || regexp_replace(permalink, '^https?://[^/]*', '') END AS permalink, CAST(coalesce(reddit_score, 0) AS BIGINT) AS score, CASE WHEN item_type = 'comment' THEN regexp_replace(parent_post_id, '^t3_', '') END AS bare_post_id, date_trunc('second', item_created_at) AS created_at FROM gemini_qualification_queue",
    "plug_in_words": "SELECT DISTINCT id, CAST(len(string_split(coalesce(content, ''), ' ')) AS BIGINT) AS words FROM reddit_leads",
    "upsert_leads": """WITH l AS (SELECT * FROM (SELECT project_id, reddit_item_id, ai_score, status, row_number() OVER (PARTITION BY project_id, reddit_item_id ORDER BY id, status NULLS LAST, ai_score NULLS LAST) AS n FROM reddit_leads) WHERE n = 1),
        q AS (SELECT * FROM (SELECT project_id, reddit_item_id, ai_score, row_number() OVER (PARTITION BY project_id, reddit_item_id ORDER BY id, ai_score NULLS LAST) AS n FROM gemini_qualification_queue WHERE ai_qualified) WHERE n = 1)
        SELECT coalesce(l.project_id, q.project_id) AS project_id, coalesce(l.reddit_item_id, q.reddit_item_id) AS reddit_item_id, CAST(CASE WHEN q.project_id IS NOT NULL THEN q.ai_score ELSE l.ai_score END AS BIGINT) AS ai_score, CASE WHEN l.project_id IS NULL THEN 'new' ELSE l.status END AS status
        FROM l FULL OUTER JOIN q ON l.project_id = q.project_id AND l.reddit_item_id = q.reddit_item_id""",
    "update_status": f"SELECT CASE WHEN hit THEN 'contacted' ELSE status END AS status, count(*) AS rows, max(CASE WHEN hit THEN {NOW} ELSE updated_at END) AS last_update FROM (SELECT *, coalesce(status = 'new' AND ai_score >= 9, false) AS hit FROM reddit_leads) GROUP BY 1",
    "delete_leads": "SELECT project_id, count(*) AS rows FROM reddit_leads WHERE NOT coalesce(status = 'ignored', false) GROUP BY project_id",
    "fail_stale_runs": f"SELECT id, CASE WHEN s THEN 'failed' ELSE status END AS status, CASE WHEN s THEN 'The scan timed out.' ELSE error_message END AS error_message, CASE WHEN s THEN {NOW} ELSE completed_at END AS completed_at, CASE WHEN s THEN {NOW} ELSE updated_at END AS updated_at FROM (SELECT *, coalesce(status = 'running' AND started_at < {NOW} - INTERVAL 15 MINUTE, false) AS s FROM sync_logs)",
    "stale_runs_count": f"SELECT count(*) AS affected FROM sync_logs WHERE status = 'running' AND started_at < {NOW} - INTERVAL 15 MINUTE",
    "list_leads_newest": listed("item_created_at BETWEEN TIMESTAMP '2026-06-01 00:00:00' AND TIMESTAMP '2026-07-31 23:59:59'", "item_created_at DESC NULLS LAST, id"),
    "list_leads_oldest": listed("ai_score BETWEEN 6 AND 7", "item_created_at NULLS LAST, id"),
    "list_leads_highest": listed("ai_score >= 6", "ai_score DESC NULLS LAST, item_created_at DESC NULLS LAST, id"),
    "list_leads_lowest": listed("ai_score >= 8", "ai_score NULLS LAST, item_created_at DESC NULLS LAST, id"),
    "list_leads_top4": f"SELECT * FROM ({listed('true', 'ai_score DESC NULLS LAST, item_created_at DESC NULLS LAST, id')}) WHERE place <= 4",
    "lead_stats": f"SELECT user_id, project_id, count(*) AS total, count(*) FILTER (status = 'new') AS new_leads, count(*) FILTER (status = 'contacted') AS contacted, count(*) FILTER (ai_score >= 8) AS strong, count(*) FILTER (ai_score BETWEEN 6 AND 7) AS partial FROM ({CLEAN}) GROUP BY ALL",
    "clean_leads": f"SELECT id, subreddit, author, score, ai_score, safety_badge, status FROM ({CLEAN})",
    "clean_runs": f"SELECT id, status, leads_found FROM ({RUNS})",
    "tenant_projects": "SELECT user_id, id, name, coalesce(description, '') AS description, CAST(coalesce(len(keywords), 0) AS BIGINT) AS n_keywords, created_at, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS place FROM projects",
    "latest_scan": f"WITH {LATEST} SELECT project_id, id, status, started_at FROM latest",
    "queue_since_scan": since("gemini_qualification_queue", "queued"),
    "leads_since_scan": since("reddit_leads", "leads"),
    "scan_stages": f"""WITH {LATEST}, q AS (SELECT DISTINCT id, project_id, created_at FROM gemini_qualification_queue), s AS (
        SELECT p.id AS project_id, CASE WHEN l.status IS NULL THEN 'not_started' WHEN l.status = 'success' THEN 'completed' WHEN l.status = 'failed' THEN 'failed' WHEN EXISTS (SELECT 1 FROM q WHERE q.project_id = p.id AND q.created_at >= l.started_at) THEN 'scoring' ELSE 'scanning' END AS stage FROM projects p LEFT JOIN latest l ON l.project_id = p.id)
        SELECT project_id, stage, CASE stage WHEN 'scoring' THEN 'Scoring leads' WHEN 'completed' THEN 'Scan complete' WHEN 'failed' THEN 'Scan failed' ELSE 'Finding your leads' END AS label, CASE WHEN stage = 'completed' THEN '/projects/' || project_id || '/dashboard' END AS redirect FROM s""",
    "oldest_pending": "SELECT project_id, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at NULLS LAST, id) AS n FROM (SELECT DISTINCT id, project_id, created_at FROM gemini_qualification_queue WHERE status = 'pending')) WHERE n <= 10",
    "community_rules": f"""WITH {rule_kinds()} SELECT subreddit, {BADGE} AS badge, CASE WHEN kind < 9 THEN short_name END AS deciding_rule, CASE WHEN kind = 9 THEN 'This subreddit''s rules do not mention promotion, self-promotion, or advertising.' ELSE 'Rule "' || coalesce(short_name, '') || '" ' || CASE kind WHEN 0 THEN 'explicitly bans promotion' WHEN 1 THEN 'allows promotion only under certain conditions' ELSE 'mentions promotion' END || ': ' || coalesce(description, '') END AS explanation FROM found""",
    "leads_with_badge": f"WITH {rule_kinds()} SELECT coalesce({BADGE}, 'without_rules') AS badge, count(*) AS leads FROM (SELECT DISTINCT id, subreddit FROM reddit_leads) l LEFT JOIN (SELECT subreddit, kind FROM found) f USING (subreddit) GROUP BY 1".replace("coalesce(CASE WHEN kind = 9", "coalesce(CASE WHEN kind IS NULL THEN 'without_rules' WHEN kind = 9"),
    "format_leads": """SELECT id, CASE WHEN ai_score = 10 THEN '🌟 ' || printf('%.1f', CAST(ai_score AS DOUBLE)) ELSE printf('%.1f', CAST(ai_score AS DOUBLE)) END AS score_text, CASE WHEN trim(subreddit) = '' THEN '' WHEN starts_with(trim(subreddit), 'r/') THEN trim(subreddit) ELSE 'r/' || trim(subreddit) END AS community,
        coalesce(strftime(item_created_at, '%Y-%m-%d %H:%M'), '') AS posted, date_trunc('day', item_created_at) AS day_start, date_trunc('day', item_created_at) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND AS day_end FROM (SELECT DISTINCT id, ai_score, subreddit, item_created_at FROM reddit_leads)""",
    "project_urls": r"""WITH h AS (SELECT id, website_url, lower(regexp_extract(trim(website_url), '^(?:https?://)?([^/?#]*)', 1)) AS host FROM projects)
        SELECT id, 'https://' || host || '/' AS url, array_to_string(list_transform(list_filter(string_split_regex(string_split(regexp_replace(host, '^www\.', ''), '.')[1], '[-_]+'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), ' ') AS name, regexp_matches(trim(website_url), '(?i)^(https?://)?([a-z0-9-]+\.)+[a-z]{2,}(/\S*)?$') AS looks_fine, 'https://icons.example/?domain=' || host AS icon FROM h""",
    "page_extract": r"""SELECT id, trim(name) AS title, trim(regexp_replace(coalesce(description, ''), '\s+', ' ', 'g')) AS meta_description, trim(name) AS headings, trim(regexp_replace(name || ' ' || array_to_string(keywords, chr(10)), '\s+', ' ', 'g')) AS body_text FROM projects""",
    "matched_terms_json": "SELECT CAST(sum(len(matched_terms.keywords)) AS BIGINT) AS keywords, CAST(sum(len(matched_terms.intent_phrases)) AS BIGINT) AS intent_phrases, CAST(sum(len(matched_terms.pain_phrases)) AS BIGINT) AS pain_phrases, CAST(sum(len(matched_terms.competitors)) AS BIGINT) AS competitors FROM gemini_qualification_queue",
    "score_missing": "SELECT id, CAST(coalesce(ai_score, length(coalesce(content, '')) % 11) AS BIGINT) AS ai_score FROM reddit_leads",
    "project_prompts": """SELECT id, array_to_string(list_filter([CASE WHEN coalesce(website_url, '') <> '' THEN 'Website URL: ' || website_url END, CASE WHEN coalesce(name, '') <> '' THEN 'Page title: ' || name END, CASE WHEN coalesce(description, '') <> '' THEN 'Meta description: ' || description END,
        'Keywords: ' || CASE WHEN coalesce(len(keywords), 0) > 0 THEN array_to_string(keywords, ', ') ELSE '(none provided)' END, 'Competitors: ' || CASE WHEN coalesce(len(competitors), 0) > 0 THEN array_to_string(competitors, ', ') ELSE '(none provided)' END], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS prompt FROM projects""",
    "stream_daily": "SELECT project_id, date_trunc('day', created_at)::TIMESTAMP AS day, count(*) AS rows FROM gemini_qualification_queue GROUP BY ALL",
    "page_analysis": "SELECT id, trim(coalesce(name, '') || ': ' || coalesce(description, '')) AS summary, CAST(len(string_split(trim(coalesce(name, '') || ': ' || coalesce(description, '')), ' ')) AS BIGINT) AS words FROM projects",
    "stream_intake": "SELECT project_id, count(DISTINCT id) AS items FROM gemini_qualification_queue GROUP BY project_id",
}

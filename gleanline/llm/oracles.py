"""SQL equivalents of the training-data queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

# The look-alike letters that these tables can hold, in the order of what they look like.
DRAWN = "асԁеһіјӏорԛѕѵԝхуАВСЕНІЈКМОРЅТХҮοανρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧօսհցոյՏՕԼ"
READ = "acdehijlopqsvwxyABCEHIJKMOPSTXYoavpuABEZHIKMNOPTYXouhgnjSOL"
WORDS = r"list_distinct(regexp_extract_all(lower(t), '[\p{L}\p{N}]+'))"
FULL = "".join(chr(0xFF01 + i) for i in range(94)) + "ⅰⅴⅹⅼⅽⅾⅿ" + "".join(map(chr, [0x09, 0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
HALF = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''") + "ivxlcdm" + " " * 16
ITEM = "lower(trim(item_type)) || ':' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(reddit_item_id)), '[?#].*$', ''), '/+$', ''), '^.*/', ''), '^t[0-9]_', '')"


def look(text: str) -> str:
    """What a reader sees, over the characters these tables hold; joiners between parts of an emoji stay."""
    x = rf"regexp_replace({text}, '\x{{200D}}([♀♂❤\x{{1F300}}-\x{{1FAFF}}])', '" + chr(0xE000) + r"\1', 'g')"
    x = rf"regexp_replace({x}, '[\x{{AD}}\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}\x{{FE00}}-\x{{FE0F}}]', '', 'g')"
    x = f"translate(nfc_normalize(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))), '{FULL}', '{HALF}')"
    x = f"replace(replace({x}, 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    return f"trim(nfc_normalize(translate({x}, '{DRAWN}', '{READ}')), ' ' || chr(10))"


ORACLES = {
    "p1_found": """
        SELECT project_id, id AS lead_id FROM (
          SELECT project_id, id, row_number() OVER (
            PARTITION BY project_id ORDER BY ai_score DESC NULLS LAST, item_created_at DESC NULLS LAST, id) AS rn
          FROM (SELECT DISTINCT project_id, id, ai_score, item_created_at FROM reddit_leads))
        WHERE rn <= 3""",
    "p2_found": r"""
        SELECT id AS lead_id FROM (
          SELECT id, account, row_number() OVER (
            PARTITION BY community, account ORDER BY ai_score DESC NULLS LAST, item_created_at DESC NULLS LAST, id) AS rn
          FROM (SELECT DISTINCT id, ai_score, item_created_at,
                  regexp_replace(lower(trim(subreddit)), '^/?r/', '') AS community,
                  regexp_replace(lower(trim(author)), '^/?u/', '') AS account
                FROM reddit_leads)
          WHERE account <> '' AND account <> '[deleted]')
        WHERE rn > 5""",
    "p2_share": r"""
        WITH rows AS (SELECT id, any_value(community) AS community, any_value(account) AS account, max(ai_score) AS ai_score, max(item_created_at) AS item_created_at FROM (
            SELECT id, ai_score, item_created_at, regexp_replace(lower(trim(subreddit)), '^/?r/', '') AS community, regexp_replace(lower(trim(author)), '^/?u/', '') AS account FROM reddit_leads)
          WHERE account <> '' AND account <> '[deleted]' GROUP BY id),
        counts AS (SELECT community, account, count(*) AS n FROM rows GROUP BY ALL),
        tried AS (SELECT community, level, sum(least(n, level)) AS kept FROM counts JOIN (SELECT community, unnest(range(1, 1 + max(n))) AS level FROM counts GROUP BY community) USING (community) GROUP BY ALL),
        levels AS (SELECT community, greatest(1, coalesce(max(level) FILTER (level <= 0.2 * kept + 1e-9), 0)) AS level FROM tried GROUP BY community),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY community, account ORDER BY ai_score DESC NULLS LAST, item_created_at DESC NULLS LAST, id) AS rn FROM rows)
        SELECT community, account, id AS lead_id FROM ranked JOIN levels USING (community) WHERE rn > level""",
    "p3_found": f"""
        WITH texts AS (
          SELECT DISTINCT 'gemini_qualification_queue' AS tbl, id, concat_ws(chr(10), title, body) AS t FROM gemini_qualification_queue
          UNION ALL SELECT DISTINCT 'reddit_leads', id, content FROM reddit_leads),
        words AS (SELECT tbl, id, len(w) AS n, unnest(w) AS word FROM (SELECT tbl, id, {WORDS} AS w FROM texts) WHERE len(w) >= 24),
        codes AS (SELECT tbl, word, row_number() OVER (ORDER BY count(*), tbl, word) AS code FROM words GROUP BY tbl, word),
        coded AS (SELECT tbl, id, n, code, row_number() OVER (PARTITION BY tbl, id ORDER BY code) AS place FROM words JOIN codes USING (tbl, word)),
        rare AS (SELECT * FROM coded WHERE place <= n - ceil(0.6 * n) + 1),
        candidates AS (SELECT DISTINCT a.tbl, a.id AS id_a, b.id AS id_b FROM rare a JOIN rare b ON a.code = b.code AND a.id < b.id AND b.n >= 0.6 * a.n AND a.n >= 0.6 * b.n),
        lists AS (SELECT tbl, id, n, list(code) AS l FROM coded GROUP BY tbl, id, n)
        SELECT c.tbl, id_a, id_b FROM candidates c JOIN lists x ON x.tbl = c.tbl AND x.id = id_a JOIN lists y ON y.tbl = c.tbl AND y.id = id_b
        WHERE len(list_intersect(x.l, y.l)) >= 0.6 * (x.n + y.n - len(list_intersect(x.l, y.l)))""",
    "p4_found": f"""
        WITH forms AS (
          SELECT field, id, t, {look('t')} AS look FROM (
            SELECT DISTINCT 'body' AS field, id, body AS t FROM gemini_qualification_queue WHERE body IS NOT NULL
            UNION ALL SELECT DISTINCT 'matched_text', id, matched_text FROM gemini_qualification_queue WHERE matched_text IS NOT NULL))
        SELECT a.field, a.id AS id_a, b.id AS id_b FROM forms a JOIN forms b ON a.field = b.field AND a.look = b.look AND a.t <> b.t AND a.id < b.id""",
    "p6_found": f"""
        WITH h AS (
          SELECT item, {WORDS} AS w, day, asked, id FROM (
            SELECT id, {ITEM} AS item, content AS t, DATE '1900-01-01' AS day, false AS asked FROM reddit_leads
            UNION ALL SELECT id, {ITEM}, body, CAST(created_at AS DATE), true FROM gemini_qualification_queue WHERE status = 'pending'))
        SELECT DISTINCT q.id AS queue_id FROM h q JOIN h e ON q.asked AND e.day < q.day
        WHERE q.item = e.item OR (len(q.w) >= 24 AND len(e.w) >= 24 AND len(list_intersect(q.w, e.w)) >= 0.6 * (len(q.w) + len(e.w) - len(list_intersect(q.w, e.w))))""",
}

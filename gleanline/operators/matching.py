"""Matching of item texts against the terms of their project, by ranked techniques.

A positional join. Every term becomes a few rows of an index, (project, word, place in the
term), before any text is read; words that are near a term's word (typos, stems, lemmas) are
looked up between the distinct words of terms and of all texts and stand in the index beside
it. The tokens of an item meet the index of its project in one equi-join on (project, word),
so that only terms that share a word with a text cost anything, and a term matches where all
of its places are covered by neighbouring tokens. Only terms with signs other than letters
and digits are tested as patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import FILLER_WORDS, MAX_FILLERS, stem_and_lemma, token_text, tokens, with_normalized, within_one_edit
from ..session import cut
from .terms import long_terms

TECHNIQUES = ["Flexible Phrase Matching", "Fuzzy Matching", "Stemming", "Lemmatization", "Rule-Based Phrase Similarity"]
EXACT = "Exact Competitor Matching"
LEFT, RIGHT = r"(?<![a-z0-9])", r"(?![a-z0-9])"
#: Categories whose matches count for the number of categories with any.
COUNTED = ["keywords", "competitors", "hidden_keywords"]


def quoted(text: Column) -> Column:
    """A regular expression for exactly this text."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def flexible_pattern(normalized: Column) -> Column:
    """The words of a term with anything but letters and digits between them, bounded by the same."""
    words = F.filter(F.split(normalized, " "), lambda w: w != "")
    return F.when(F.size(words) > 0, F.concat(F.lit(LEFT), F.array_join(F.transform(words, quoted), "[^a-z0-9]+"), F.lit(RIGHT)))


def exact_pattern(normalized: Column) -> Column:
    """The whole term literally, bounded."""
    return F.when(normalized != "", F.concat(F.lit(LEFT), quoted(normalized), F.lit(RIGHT)))


def meaning_words(normalized: Column) -> Column:
    return F.filter(tokens(normalized), lambda w: ~w.isin(*FILLER_WORDS))


def prepared_terms(projects: DataFrame) -> DataFrame:
    """Long terms with their normal form; blank ones are dropped."""
    terms = long_terms(projects)
    return with_normalized(terms, "term", "normalized").filter("normalized <> ''")


def spellings(terms: DataFrame) -> DataFrame:
    """The spellings of every normal form in a project's category, numbered by first appearance: spelling, from 1."""
    once = terms.groupBy("project_id", "category", "normalized", "term").agg(F.min("ordinal").alias("ordinal"))
    return once.withColumn("spelling", F.row_number().over(Window.partitionBy("project_id", "category", "normalized").orderBy("ordinal")))


def vocabulary(items: DataFrame) -> DataFrame:
    """The distinct tokens of normalized texts."""
    return items.select(F.explode(tokens(F.col("normalized"))).alias("word")).distinct()


def deletion_keys(word: Column) -> Column:
    """The word and the word less one letter: words within one edit or swap share a key."""
    shorter = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), shorter))


def fuzzy_neighbours(term_words: DataFrame, words: DataFrame) -> DataFrame:
    """(term_word, word) within one edit, both of four letters or more and without digits: an equi-join on deletion keys.

    Words whose length no term word comes near get no keys: a run of a hundred thousand
    letters would else make as many keys of its own length.
    """
    fit = lambda c: (F.length(c) >= 4) & ~F.col(c).rlike("[0-9]")
    lengths = term_words.filter(fit("term_word")).select(F.explode(F.array(*[F.length("term_word") + d for d in (-1, 0, 1)])).alias("length")).distinct()
    words = words.join(lengths, F.length("word") == F.col("length"), "left_semi")
    left = term_words.filter(fit("term_word")).select("term_word", F.explode(deletion_keys(F.col("term_word"))).alias("key"))
    right = words.filter(fit("word")).select("word", F.explode(deletion_keys(F.col("word"))).alias("key"))
    close = left.join(right, "key").filter("term_word <> word").select("term_word", "word").distinct()
    return close.filter(within_one_edit(F.col("term_word"), F.col("word")))


def form_neighbours(term_words: DataFrame, words: DataFrame) -> DataFrame:
    """(kind, term_word, word): different words of two letters or more with the same stem or the same lemma."""

    def forms(df: DataFrame, c: str) -> DataFrame:
        both = df.filter(F.length(c) >= 2).select(c, stem_and_lemma(F.col(c)).alias("f"))
        kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"f.{k}").alias("form")) for k in ("stem", "lemma")]))
        return both.select(c, kinds.alias("k")).select(c, "k.kind", "k.form")

    return forms(term_words, "term_word").join(forms(words, "word"), ["kind", "form"]).filter("term_word <> word").select("kind", "term_word", "word").distinct()


KINDS = ["fuzzy", "stem", "lemma"]


def term_neighbours(terms: DataFrame, words: DataFrame, kinds: list[str]) -> DataFrame:
    """(kind, term_word, word) of the given kinds between the words of general terms and ``words``."""
    term_words = terms.filter("category <> 'competitors'").select(F.explode(tokens(F.col("normalized"))).alias("term_word")).distinct()
    found = []
    if "fuzzy" in kinds:
        found.append(fuzzy_neighbours(term_words, words).select(F.lit("fuzzy").alias("kind"), "term_word", "word"))
    if "stem" in kinds or "lemma" in kinds:
        found.append(form_neighbours(term_words, words).filter(F.col("kind").isin(*kinds)))
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    return both


def term_index(terms: DataFrame, neighbours: DataFrame | None = None) -> DataFrame:
    """(project_id, stream, word, normalized, place, places, same, fuzzy, stem, lemma) of every term.

    In the stream ``all`` the places are those of all tokens of a term, in ``meaning`` those of
    its words without fillers. ``same`` and the others tell how the word stands for the place.
    """
    forms = terms.select("project_id", "normalized").distinct()
    rows = []
    for stream, words in (("all", tokens(F.col("normalized"))), ("meaning", meaning_words(F.col("normalized")))):
        rows.append(forms.select("project_id", "normalized", F.lit(stream).alias("stream"), F.size(words).alias("places"), F.posexplode(words).alias("place", "word")))
    places = rows[0].unionByName(rows[1])
    own = places.select("project_id", "stream", "word", "normalized", "place", "places", F.lit(True).alias("same"), *[F.lit(False).alias(k) for k in KINDS])
    if neighbours is None:
        return own
    near = neighbours.groupBy("term_word", "word").agg(*[F.max(F.col("kind") == k).alias(k) for k in KINDS])
    others = places.filter("stream = 'all'").withColumnRenamed("word", "term_word").join(near, "term_word")
    return own.unionByName(others.select("project_id", "stream", "word", "normalized", "place", "places", F.lit(False).alias("same"), *KINDS))


#: Up to so many fillers in a row as may stand between two words, with the token after them. A longer run makes a
#: filler a token of its own, which keeps the words around it from being neighbours.
CHUNK = rf"(?:(?:{'|'.join(FILLER_WORDS)}) ){{0,{MAX_FILLERS}}}[a-z0-9]+"


def token_rows(items: DataFrame) -> DataFrame:
    """(item_id, project_id, delivery, stream, at, word): every token at its place, and every word at its place among those that bear meaning.

    Repeated deliveries of an item are told apart by ``delivery``.
    """
    items = items.withColumn("delivery", F.monotonically_increasing_id())
    every = items.select("item_id", "project_id", "delivery", F.lit("all").alias("stream"), F.posexplode(tokens(F.col("normalized"))).alias("at", "word"))
    chunks = F.regexp_extract_all(F.trim(token_text(F.col("normalized"))), F.lit(CHUNK), F.lit(0))
    bearing = items.select("item_id", "project_id", "delivery", F.posexplode(chunks).alias("at", "chunk"))
    return every.unionByName(bearing.select("item_id", "project_id", "delivery", F.lit("meaning").alias("stream"), "at", F.substring_index("chunk", " ", -1).alias("word")))


#: An index of up to so many rows (some 20 MB) goes to every executor; of a larger one its distinct words, if they are as few.
SMALL_ROWS = 250_000


def index_hits(items: DataFrame, index: DataFrame) -> DataFrame:
    """The tokens of items with the index rows of their project and word.

    A large index meets the tokens by a shuffle of both, in which the tokens of a project
    are spread by word; only tokens that some project's terms have take part.
    """
    rows, keys = token_rows(items), ["project_id", "stream", "word"]
    if index.count() <= SMALL_ROWS:
        return rows.join(F.broadcast(index), keys)
    words = cut(index.select("stream", "word").distinct())
    few = F.broadcast(words) if words.count() <= SMALL_ROWS else words
    return rows.join(few, ["stream", "word"], "left_semi").join(index, keys)


def covered(items: DataFrame, index: DataFrame) -> DataFrame:
    """(item_id, project_id, normalized, flexible, fuzzy, stem, lemma, similar): terms all of whose places are covered by tokens in a row."""
    hits = index_hits(items, index)
    # one exchange of the few hits; the two steps below then need none
    hits = hits.withColumn("start", F.col("at") - F.col("place")).repartition("item_id")

    def whole(kind: str) -> Column:
        return (F.count_if(F.col("same") | F.col(kind)) == F.col("places")) & F.max(kind)

    # a start and a place name one token of a delivery, so that no place counts twice
    window = hits.groupBy("item_id", "project_id", "delivery", "normalized", "stream", "places", "start").agg((F.count_if("same") == F.col("places")).alias("same"), *[whole(k).alias(k) for k in KINDS])
    everywhere = F.col("stream") == "all"
    found = window.groupBy("item_id", "project_id", "normalized").agg(F.max(everywhere & F.col("same")).alias("flexible"), *[F.max(everywhere & F.col(k)).alias(k) for k in KINDS], F.max(~everywhere & F.col("same")).alias("similar"))
    return found.filter("flexible or fuzzy or stem or lemma or similar")


def patterned(items: DataFrame, terms: DataFrame) -> DataFrame:
    """(item_id, project_id, category, normalized): matches of terms that have to be tested as patterns.

    These are general terms with signs other than letters and digits, and competitors of
    more than one plain word. A text that doesn't hold a literal piece of the term isn't tried.
    """
    competitor = F.col("category") == "competitors"
    literal = F.when(competitor, F.col("normalized")).otherwise(F.split("normalized", " ")[0])
    pattern = F.when(competitor, exact_pattern(F.col("normalized"))).otherwise(flexible_pattern(F.col("normalized")))
    tried = terms.filter(F.when(competitor, ~plain_word(F.col("normalized"))).otherwise(~plain_words(F.col("normalized"))))
    per_project = tried.groupBy("project_id").agg(F.collect_set(F.struct("category", "normalized", literal.alias("literal"), pattern.alias("pattern"))).alias("tried"))
    text = F.col("n")
    found = F.filter("tried", lambda t: F.contains(text, t["literal"]) & F.rlike(text, t["pattern"]))
    joined = items.select("item_id", "project_id", F.col("normalized").alias("n")).join(per_project, "project_id")
    return joined.select("item_id", "project_id", F.explode(found).alias("m")).select("item_id", "project_id", "m.category", "m.normalized").distinct()


def plain_word(normalized: Column) -> Column:
    return normalized.rlike("^[a-z0-9]+$")


def plain_words(normalized: Column) -> Column:
    return normalized.rlike("^[a-z0-9]+( [a-z0-9]+)*$")


def techniques(items: DataFrame, terms: DataFrame, kinds: list[str], words: DataFrame | None = None) -> DataFrame:
    """What matches where, spelling aside: item_id, project_id, category, normalized and a flag per technique (flexible is the exact match of a competitor)."""
    general = terms.filter("category <> 'competitors'")
    neighbours = term_neighbours(general, words, kinds) if kinds else None
    plain_competitors = terms.filter((F.col("category") == "competitors") & plain_word(F.col("normalized")))
    index = term_index(general, neighbours).unionByName(term_index(plain_competitors).filter("stream = 'all'"))
    # a competitor's word may be a general term's too: one row stands for both
    index = index.groupBy(*[c for c in index.columns if c not in ("same", *KINDS)]).agg(*[F.max(c).alias(c) for c in ("same", *KINDS)])
    by_place = covered(items, cut(index))
    forms = terms.select("project_id", "category", "normalized").distinct()
    by_place = by_place.join(forms, ["project_id", "normalized"])
    competitor = F.col("category") == "competitors"
    flexible = F.when(competitor, plain_word(F.col("normalized"))).otherwise(plain_words(F.col("normalized"))) & F.col("flexible")
    by_place = by_place.select("item_id", "project_id", "category", "normalized", flexible.alias("flexible"), *[(~competitor & F.col(k)).alias(k) for k in (*KINDS, "similar")])
    by_pattern = patterned(items, terms).select("item_id", "project_id", "category", "normalized", F.lit(True).alias("flexible"), *[F.lit(False).alias(k) for k in (*KINDS, "similar")])
    both = by_place.unionByName(by_pattern).groupBy("item_id", "project_id", "category", "normalized").agg(*[F.max(k).alias(k) for k in ("flexible", *KINDS, "similar")])
    return both.filter("flexible or fuzzy or stem or lemma or similar")


def match_items(items: DataFrame, terms: DataFrame, kinds: list[str] = KINDS, words: DataFrame | None = None) -> DataFrame:
    """Matches of items (project_id, item_id, normalized): item_id, project_id, category, term, technique.

    Per category each technique reports a normal form once, by its first spelling: flexible
    phrase, fuzzy, stem or lemma, phrase similarity, in this order. Fuzzy and stem or lemma
    pass over spellings reported before them, so a further spelling of a term shows up only
    through another technique; phrase similarity doesn't pass over, and is silent if the
    first spelling was reported. Competitors know the exact match only.
    """
    found = techniques(items, terms, kinds, words).join(spellings(terms), ["project_id", "category", "normalized"])
    before_fuzzy = F.col("flexible").cast("int")
    before_forms = before_fuzzy + F.col("fuzzy").cast("int")
    at = F.col("spelling")
    technique = (
        F.when(F.col("flexible") & (at == 1), F.when(F.col("category") == "competitors", EXACT).otherwise(TECHNIQUES[0]))
        .when(F.col("fuzzy") & (at == before_fuzzy + 1), TECHNIQUES[1])
        .when((F.col("stem") | F.col("lemma")) & (at == before_forms + 1), F.when(F.col("stem"), TECHNIQUES[2]).otherwise(TECHNIQUES[3]))
        .when(F.col("similar") & (at == 1), TECHNIQUES[4])
    )
    return found.select("item_id", "project_id", "category", "term", technique.alias("technique")).filter("technique is not null")


def one_technique(items: DataFrame, terms: DataFrame, flag: str) -> DataFrame:
    """Matches of one technique by itself, each normal form by its first spelling: item_id, category, term."""
    kinds = [k for k in KINDS if k == flag]
    items, terms = cut(items), cut(terms)
    found = techniques(items, terms, kinds, vocabulary(items) if kinds else None).filter(flag)
    return found.join(spellings(terms).filter("spelling = 1"), ["project_id", "category", "normalized"]).select("item_id", "category", "term").distinct()


def matching_engine(items: DataFrame, projects: DataFrame, kinds: list[str] = KINDS) -> DataFrame:
    """Items (project_id, item_id, text) against all terms of their project, by all techniques (of the inexact ones those in ``kinds``)."""
    normalized = cut(with_normalized(items, "text", "normalized").select("project_id", "item_id", "normalized"))
    return match_items(normalized, cut(prepared_terms(projects)), kinds, cut(vocabulary(normalized)) if kinds else None)


def match_counts(items: DataFrame, matches: DataFrame) -> DataFrame:
    """Per item the matches of each category and how many of keywords, competitors and hidden keywords have any; items without matches count zero."""
    counted = F.countDistinct(F.when(F.col("category").isin(*COUNTED), F.col("category")))
    counts = matches.groupBy("item_id", "project_id").agg(*[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in ("keywords", "intent_phrases", "pain_phrases", "competitors", "hidden_keywords")], counted.alias("n_categories"))
    zero = {c: 0 for c in counts.columns if c.startswith("n_")}
    return items.select("item_id", "project_id").distinct().join(counts, ["item_id", "project_id"], "left").fillna(zero)


def normalized_copies(items: DataFrame, columns: list[str]) -> DataFrame:
    """Items with the normal form of each of ``columns`` beside it (``normalized_`` before its name)."""
    for c in columns:
        items = with_normalized(items, c, f"normalized_{c}")
    return items


def item_text(item_type: Column, title: Column, body: Column) -> Column:
    """Title, blank line and body of a post (the title alone without a body); the body of a comment."""
    full = F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), body)).otherwise(F.coalesce(title, F.lit("")))
    return F.when(item_type == "post", full).otherwise(F.coalesce(body, F.lit("")))

"""Text functions: normal form, tokens, stems and lemmas."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Words skipped between the words of a phrase, and how many of them in a row.
FILLER_WORDS = ["a", "an", "the", "to", "for", "of", "is", "are", "my", "your", "our", "and", "or", "in", "on", "at"]
MAX_FILLERS = 3


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def squeezed(text: Column) -> Column:
    """Lower case, white-space runs as one space, trimmed; null as the empty string."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\s\x{FEFF}]+", " "))


def with_normalized(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the normal form of ``column``: compatibility composed, lower case, single spaces.

    Only rows with characters beyond ASCII pass through Python.
    """
    plain = F.coalesce(~F.col(column).rlike(r"[^\x00-\x7F]"), F.lit(True))
    ascii_rows = df.filter(plain).withColumn(out, squeezed(F.col(column)))
    other_rows = df.filter(~plain).withColumn(out, squeezed(_nfkc(F.col(column))))
    return ascii_rows.unionByName(other_rows)


def tokens(normalized: Column) -> Column:
    """Runs of ASCII letters and digits."""
    return F.filter(F.split(normalized, "[^a-z0-9]+"), lambda t: t != "")


def token_text(normalized: Column) -> Column:
    """All tokens with a space before and after each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(normalized, "[^a-z0-9]+", " ")), F.lit(" "))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two words differ by at most one insertion, deletion, substitution or swap of neighbours."""
    near = F.levenshtein(a, b) <= 1
    place = F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    i = F.element_at(place, 1)
    swapped = (F.length(a) == F.length(b)) & (F.size(place) == 2) & (F.element_at(place, 2) == i + 1)
    crossed = (F.substring(a, i, F.lit(1)) == F.substring(b, i + 1, F.lit(1))) & (F.substring(a, i + 1, F.lit(1)) == F.substring(b, i, F.lit(1)))
    return F.coalesce(near | (swapped & F.when(swapped, crossed)), F.lit(False))


# ---- stems (the published algorithm of 1980) ----

VOWELS = "aeiou"


def _consonant(word: str, i: int) -> bool:
    c = word[i]
    return c not in VOWELS and (c != "y" or i == 0 or not _consonant(word, i - 1))


def _measure(stem: str) -> int:
    kinds = [_consonant(stem, i) for i in range(len(stem))]
    return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonant(word, len(word) - 1)


def _short_end(word: str) -> bool:
    n = len(word)
    return n > 2 and _consonant(word, n - 3) and not _consonant(word, n - 2) and _consonant(word, n - 1) and word[-1] not in "wxy"


STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def porter_stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    w = word
    if len(w) < 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        for end, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            w = stem
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


# ---- lemmas: irregular forms and the regular endings of nouns, verbs and adjectives ----

# Irregular forms of common words.
NOUNS = dict(x.split("=") for x in "men=man women=woman children=child people=person feet=foot teeth=tooth geese=goose mice=mouse lives=life wives=wife leaves=leaf knives=knife analyses=analysis criteria=criterion indices=index".split())
VERBS = dict(x.split("=") for x in "went=go gone=go was=be were=be been=be am=be is=be are=be had=have has=have did=do done=do said=say made=make took=take taken=take came=come saw=see seen=see got=get gave=give given=give found=find thought=think told=tell became=become left=leave felt=feel put=put brought=bring began=begin begun=begin kept=keep held=hold wrote=write written=write stood=stand heard=hear meant=mean met=meet ran=run paid=pay sat=sit spoke=speak spoken=speak led=lead grew=grow grown=grow lost=lose fell=fall sent=send built=build understood=understand drew=draw broke=break broken=break spent=spend bought=buy sold=sell chose=choose chosen=choose knew=know known=know drove=drive driven=drive ate=eat eaten=eat taught=teach caught=catch fought=fight won=win".split())
ADJECTIVES = dict(x.split("=") for x in "better=good best=good worse=bad worst=bad further=far farther=far less=little least=little more=much most=much".split())


def _noun(w: str) -> str:
    if w in NOUNS:
        return NOUNS[w]
    for end, new in (("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("zes", "z"), ("ies", "y")):
        if w.endswith(end) and len(w) > len(end) + 1:
            return w[: -len(end)] + new
    return w[:-1] if w.endswith("s") and not w.endswith(("ss", "us", "is")) and len(w) > 3 else w


def _verb(w: str) -> str:
    if w in VERBS:
        return VERBS[w]
    for end in ("ing", "ed"):
        stem = w[: -len(end)]
        if w.endswith(end) and len(stem) > 2 and _has_vowel(stem):
            if _double(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if stem.endswith(("at", "iz", "v", "c", "g", "s")) or _measure(stem) == 1 and _short_end(stem) else stem
    return w


def _adjective(w: str) -> str:
    if w in ADJECTIVES:
        return ADJECTIVES[w]
    for end in ("iest", "ier"):
        if w.endswith(end):
            return w[: -len(end)] + "y"
    for end in ("est", "er"):
        stem = w[: -len(end)]
        if w.endswith(end) and len(stem) > 2 and _double(stem) and stem[-1] not in "lsz":
            return stem[:-1]
    return w


def lemma(word: str) -> str:
    """The first of noun, verb and adjective form that differs from the word, else the word."""
    return next((f for f in (_noun(word), _verb(word), _adjective(word)) if f != word), word)


@F.pandas_udf(StructType([StructField("stem", StringType()), StructField("lemma", StringType())]))
def stem_and_lemma(words: pd.Series) -> pd.DataFrame:
    """Meant for distinct words: a vocabulary, not running text."""
    return pd.DataFrame({"stem": words.map(porter_stem, na_action="ignore"), "lemma": words.map(lemma, na_action="ignore")})

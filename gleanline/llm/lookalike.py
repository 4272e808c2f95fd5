"""Problem 4: one consistent form for text that looks the same but is made of other characters."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import cut, row_pairs

# Letters of other scripts that are drawn like a Latin letter in common fonts. Letters that a dot, a
# stroke or a curl tells apart (ı, ι, κ, σ, к, т) aren't among them.
LOOK_ALIKES = {
    # Cyrillic, small
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    # Cyrillic, capital
    "А": "A", "В": "B", "С": "C", "Ԁ": "D", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "Ү": "Y",
    # Greek
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Latin of phonetic alphabets
    "ɑ": "a", "ɡ": "g",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "ո": "n", "յ": "j", "Տ": "S", "Օ": "O", "Լ": "L",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Coptic
    "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "Ⲍ": "Z",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}

#: Compatibility forms that a reader sees as another character (x² is not x2).
VISIBLE_FORMS = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>")
# The published ranges of default-ignorable code points.
IGNORABLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
JOINERS = "\u200c\u200d"
#: Flags of regions are a black flag with invisible tags that choose what is shown.
TAGGED_FLAG = re.compile("\U0001f3f4[\U000e0020-\U000e007e]+\U000e007f")
TAGS = re.compile("[\U000e0020-\U000e007f]")


def ignorable(ch: str) -> bool:
    """Whether a character is default-ignorable; joiners and the tags of flags are treated by what is around them."""
    code = ord(ch)
    return ch not in JOINERS and not TAGS.match(ch) and any(a <= code <= b for a, b in IGNORABLE)


class FormTable(dict):
    """str.translate table, filled as characters are met."""

    def __init__(self, look_alikes: bool = True, visible_forms: bool = False):
        super().__init__()
        self.look_alikes, self.visible_forms = look_alikes, visible_forms

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        if ch == "\n":
            out = "\n"
        elif ch in "\u2028\u2029\x85":
            out = "\n"
        elif ch.isspace():
            out = " "
        elif ignorable(ch):
            out = ""
        else:
            kind = unicodedata.decomposition(ch).split(" ")[0]
            out = ch if kind in VISIBLE_FORMS and not self.visible_forms else unicodedata.normalize("NFKC", ch)
            if self.look_alikes:
                out = "".join(LOOK_ALIKES.get(c, c) for c in out)
        self[code] = out
        return out


def joiner_matters(before: str, after: str) -> bool:
    """A joiner shows between parts of an emoji and in scripts that join their letters."""

    def shaped(c: str) -> bool:
        code = ord(c)
        return 0x0590 <= code <= 0x0E7F or 0x1000 <= code <= 0x109F or 0x1780 <= code <= 0x18AF

    def picture(c: str) -> bool:
        return unicodedata.category(c) in ("So", "Sk", "Mn", "Me") or 0x1F000 <= ord(c) <= 0x1FAFF or 0xFE00 <= ord(c) <= 0xFE0F

    return bool(before and after) and (shaped(before) and shaped(after) or picture(before) and picture(after))


LOOK, COMPAT = FormTable(), FormTable(look_alikes=False, visible_forms=True)


def line_feeds(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def drop_joiners(text: str) -> str:
    """``text`` without joiners that don't show and without tags outside of flags."""
    if TAGS.search(text):
        flags = TAGGED_FLAG.findall(text)
        pieces = [TAGS.sub("", piece) for piece in TAGGED_FLAG.split(text)]
        text = "".join(a + b for a, b in zip(pieces, [*flags, ""]))
    if JOINERS[0] not in text and JOINERS[1] not in text:
        return text
    out = [c for i, c in enumerate(text) if c not in JOINERS or joiner_matters(text[i - 1 : i], text[i + 1 : i + 2])]
    return "".join(out)


def look_forms(texts: list[str]) -> list[str]:
    """``look_form`` of many texts: they are mapped as one buffer."""
    # accents first join their letter: a look-alike letter with an accent is another letter
    buffer = SEPARATOR.join([drop_joiners(line_feeds(t)) for t in texts])
    out = unicodedata.normalize("NFC", unicodedata.normalize("NFC", buffer).translate(LOOK)).split(SEPARATOR)
    # a text that holds the separator itself is mapped alone
    return [t.strip(" \n") for t in out] if len(out) == len(texts) else [look_form(t) for t in texts]


def canonical_forms(texts: list[str]) -> list[str]:
    """``canonical_form`` of many texts."""
    # look-alikes first: a capital of another script may fold to a letter that looks like none
    folded = SEPARATOR.join(look_forms(texts)).translate(COMPAT)
    out = unicodedata.normalize("NFKC", folded).casefold().split(SEPARATOR)
    if len(out) != len(texts):
        return [canonical_form(t) for t in texts]
    # case folding can open new compatibility forms, hence the second pass
    return unicodedata.normalize("NFKC", SEPARATOR.join(look_forms(out))).split(SEPARATOR)


#: Between the texts of a buffer: nothing joins or folds across it.
SEPARATOR = "\x00"


def look_form(text: str) -> str:
    """What a reader sees: compatibility forms and look-alike letters mapped, spaces alike, invisible characters gone; case, accents and line breaks kept."""
    text = drop_joiners(line_feeds(text))
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(LOOK)).strip(" \n")


def canonical_form(text: str) -> str:
    """The form for comparisons: compatibility composed, full case folding, look-alikes and white space mapped, ignorable characters gone."""
    folded = unicodedata.normalize("NFKC", look_form(text).translate(COMPAT)).casefold()
    return unicodedata.normalize("NFKC", look_form(folded))


@F.pandas_udf(StringType())
def _canonical_udf(texts: pd.Series) -> pd.Series:
    codes, values = pd.factorize(texts)
    forms = canonical_forms(list(values))
    return pd.Series([forms[i] if i >= 0 else None for i in codes], index=texts.index, dtype=object)


def plain(text: Column) -> Column:
    """True for texts of printable ASCII and line feeds only; they need no Unicode tables."""
    return ~text.rlike(r"[^\x0A\x20-\x7E]")


def normalise_text(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the canonical form of ``column`` as ``out``.

    Method: compatibility normalisation to composed form, full case folding, mapped white
    space, removal of default-ignorable characters and look-alike letters, once per distinct
    value of a batch. Texts of plain ASCII are folded without Python.

    Defined cases: null stays null, empty and blank texts become empty; a joiner stays where
    it shows (emoji, Arabic and Indic scripts); line breaks stay, of any kind as line feeds.
    Any length is processed whole. Applying it twice changes nothing more.
    """
    text = F.col(column)
    by_unicode = df.filter(~plain(text)).withColumn(out, _canonical_udf(text))
    by_ascii = df.filter(F.coalesce(plain(text), F.lit(True))).withColumn(out, F.lower(F.trim(text, F.lit(" \n"))))
    return by_ascii.unionByName(by_unicode)


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    digest = lambda s: hashlib.md5(s.encode("utf-8", "surrogatepass")).digest()
    for pdf in batches:
        codes, values = pd.factorize(pdf["text"])
        values = list(values)
        raw, canonical, look = ([digest(v) for v in forms] for forms in (values, canonical_forms(values), look_forms(values)))
        yield pd.DataFrame({"field": pdf["field"], "id": pdf["id"], "raw": [raw[i] for i in codes], "form": [canonical[i] for i in codes], "look": [look[i] for i in codes]})


def look_alike_pairs(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Pairs of rows whose ``field`` looks the same but is another string: ``field``, ``id_a``, ``id_b``.

    Strings meet by the canonical form of their text (128-bit digest); the look form, which
    keeps case and visible accents, is the exact check. Copies of a string are one class:
    only classes meet, and those that look like another one are expanded to rows, large ones
    block by block.

    Defined cases: null texts are in no pair; rows repeated with one id count once; the
    smaller id comes first; an empty table gives no pairs.
    """
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
    texts = df.select(F.col(id_col).cast("string").alias("id"), stacked.alias("t")).select("id", "t.field", "t.text").filter(F.col("text").isNotNull())
    simple = plain(F.col("text"))
    trimmed = F.trim(F.col("text"), F.lit(" \n"))
    digest = lambda c: F.unhex(F.md5(c))
    by_ascii = texts.filter(simple).select("field", "id", digest(F.col("text")).alias("raw"), digest(F.lower(trimmed)).alias("form"), digest(trimmed).alias("look"))
    by_unicode = texts.filter(~simple).select("field", "id", "text").mapInPandas(_marks, "field string, id string, raw binary, form binary, look binary")
    marks = cut(by_ascii.unionByName(by_unicode))
    strings = marks.groupBy("field", "form", "look", "raw").agg(F.count(F.lit(1)).alias("n")).drop("n")
    several = marks.groupBy("field", "form").agg(F.min("raw").alias("least"), F.max("raw").alias("most")).filter("least <> most").select("field", "form")
    strings = strings.join(several, ["field", "form"], "left_semi").withColumn("doc", F.concat(F.md5(F.col("field")).cast("binary"), F.col("raw")))
    other = strings.select("field", "form", "look", F.col("doc").alias("b"))
    links = cut(strings.withColumnRenamed("doc", "a").join(other, ["field", "form", "look"]).filter("a < b").select("a", "b"))
    linked = links.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    members = marks.select("field", "id", F.concat(F.md5(F.col("field")).cast("binary"), F.col("raw")).alias("doc")).join(linked, "doc", "left_semi").distinct()
    return row_pairs(cut(members), links, ["field"], alike=False).distinct()

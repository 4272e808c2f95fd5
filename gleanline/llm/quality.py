"""Problem 10: per-document text quality statistics, and prose told from lists, tables and junk."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, shared_path

CHUNK = 16_384
#: A chunk comes with so many characters before it. Only a word that a border cuts, which takes more than a chunk of
#: letters without a blank, is told from others by no more than its last characters.
BEFORE = 24
# Frequent function words of English, German, French and Spanish.
COMMON = frozenset("""
    the a an and or of to in for with on at by from as is are was were be been it its this that which our we my i you they not no but if so than then there has have had do does did will would can could
    der die das den dem des ein eine einen einem einer und oder mit von zu im in auf für aus bei nach vor über wir ich hat haben ist war nicht unser unsere als wie auch nur
    le la les un une des du de et ou avec pour par sur dans en au aux ce cette nous notre a ont est pas que qui plus sans son ses
    el los las una unos con por para del al y o en se su sus mi nuestro nuestra es no que más sin lo
""".split())  # fmt: skip
WORD = re.compile(r"[^\W_]+")
MARKER = r"^\s*(?:[-*•–—+‣◦]|\d{1,4}\s*[.)\-:]|\[[ xX]?\]|\|)\s*"
URL = r"^\s*https?://"
MARKED, LINKED = re.compile(MARKER), re.compile(URL)
DELIMITING = ["\t", "|", ",", ";", "=", "  "]
DELIMITER = re.compile(r"[\t|,;=]|(?<=(?<! ) ) ")
HASHTAG = re.compile(r"(?<=#)(?<!\S#)[^\W_]")
BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")
#: Characters of an unbroken run beyond so many count as part of a long word.
LONG_RUN = 24
LONG = re.compile(rf"\S{{{LONG_RUN + 1},}}")
VOWELS = "aeiouyäöüàâáãåæéèêëíìîïóòôõøœúùûAEIOUYÄÖÜÉÈÓÍÁÚ"
SENTENCE_END = ".!?…。！？؟।"
CLOSERS = "\"'”’»)*_ "
PREFIX = 64
#: Counts that add up over the pieces of a document.
SUMS = ["chars", "words", "word_chars", "vowels", "latin", "digits", "spaces", "common", "hashtags", "long_chars"]
#: What whole lines add up to.
LINES = ["lines", "ended_lines", "item_lines", "item_words", "record_lines", "record_words"]
NO_LINE, ENDED_LINE = (0,) * len(LINES), (1, 1, 0, 0, 0, 0)

_LETTERS = bytes(c for c in range(128) if chr(c).isalpha())
_VOWELS = bytes(ord(c) for c in VOWELS if ord(c) < 128)
_DIGITS, _SPACES = b"0123456789", bytes(c for c in range(128) if chr(c).isspace())


def character_counts(text: str) -> tuple[int, int, int, int]:
    """Vowels, Latin letters, digits and white space of a text."""
    raw = text.encode("ascii", "ignore")
    counts = [len(raw) - len(raw.translate(None, kind)) for kind in (_VOWELS, _LETTERS, _DIGITS, _SPACES)]
    if len(raw) < len(text):
        rest = "".join(BEYOND_ASCII.findall(text))
        more = sum(map(VOWELS.__contains__, rest)), sum(c.isalpha() and c < "\u0250" for c in rest), sum(map(str.isdigit, rest)), sum(map(str.isspace, rest))
        counts = [a + b for a, b in zip(counts, more)]
    return tuple(counts)


def line_sums(words: int, black: int, digits: int, delimiters: int, prefix: str, last: str) -> tuple[int, ...]:
    """What a whole line adds to ``LINES``.

    An item is a short line without the end of a sentence; a record has several fields (delimiters)
    and many digits, or is a link, or a row of a ruled table.
    """
    if black == 0:
        return NO_LINE
    prefix = prefix.lstrip()
    ended = last != "" and last in SENTENCE_END
    record = bool(LINKED.match(prefix)) or (not ended and delimiters >= 2 and (digits >= 0.15 * black or delimiters >= max(0.5 * words, 0.1 * black)))
    item = not record and not ended and words <= (12 if MARKED.match(prefix) else 8)
    return 1, int(ended), int(item), words * item, int(record), words * record


def delimiters(before: str, text: str) -> int:
    return matches_after(DELIMITER, before, text) if any(map(text.__contains__, DELIMITING)) or before else 0


def piece(text: str, before: str) -> tuple:
    """The part of a line that lies in one chunk, after the characters ``before`` of the same line, as in ``PIECE``."""
    _, _, digits, spaces = character_counts(text)
    # blanks before a marker don't matter: they count as one
    prefix = (" " if text[:1].isspace() else "") + text.lstrip()[:PREFIX]
    return len(WORD.findall(text)) - continues(before, text), len(text) - spaces, digits, delimiters(before, text), prefix, text.rstrip().rstrip(CLOSERS)[-1:]


def whole_line(line: str) -> tuple[int, ...]:
    """``line_sums`` of a line that no border cuts; most lines of prose are known by their last character."""
    inner = line.strip()
    if not inner:
        return NO_LINE
    last = inner.rstrip(CLOSERS)[-1:]
    if last and last in SENTENCE_END and not LINKED.match(inner):
        return ENDED_LINE
    return line_sums(*piece(line, ""))


def continues(before: str, text: str) -> bool:
    return bool(before and text) and before[-1].isalnum() and text[0].isalnum()


def matches_after(pattern: re.Pattern, before: str, text: str) -> int:
    """Matches of a one-character pattern in ``text`` that may look at the characters before it."""
    return sum(m.start() >= len(before) for m in pattern.finditer(before + text)) if before else len(pattern.findall(text))


class Marks(dict):
    """The bit that a word marks of 256, kept between texts; started anew when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        bit = self[word] = 1 << (zlib.crc32(word.encode("utf-8", "surrogatepass")) & 255)
        return bit


MARKS = Marks()


def chunk_state(text: str, before: str, after: str, first: bool, last: bool, offset: int) -> tuple:
    """Associative partial counts of one chunk as in ``COUNTS``, given the state of its borders, and its cut lines, ``head`` and ``tail``.

    ``before`` has the characters in front of the chunk, ``after`` the one behind it. A word
    counts where it begins; what it is counts where it ends. Lines cut by a border are not
    classed here but given as their pieces.
    """
    found = WORD.findall(text)
    goes_on, joined = continues(text, after), continues(before, text)
    ending = found[: len(found) - goes_on] if goes_on else found
    if joined and ending:
        ending = [(WORD.findall(before)[-1] + ending[0])[-BEFORE:], *ending[1:]]
    lower = " ".join(ending).lower().split(" ") if ending else []
    bits = 0
    for w in set(lower):
        bits |= MARKS[w]
    vowels, latin, digits, spaces = character_counts(text)
    inner = text.strip()
    begin = offset + len(text) - len(text.lstrip()) if inner else None
    lines = text.split("\n")
    breaks = len(lines) - 1
    head = tail = None
    if not first:
        head, lines = piece(lines[0], before.rsplit("\n", 1)[-1]), lines[1:]
    if not last and lines:
        tail, lines = piece(lines[-1], ""), lines[:-1]
    sums = [0] * len(LINES)
    for line in lines:
        for k, v in enumerate(whole_line(line)):
            sums[k] += v
    hashtags = matches_after(HASHTAG, before, text) if "#" in text or before[-1:] == "#" else 0
    long_chars = sum(max(0, m.end() - max(m.start() + LONG_RUN, len(before))) for m in LONG.finditer(before + text))
    totals = (len(text), len(found) - joined, sum(map(len, found)), vowels, latin, digits, spaces, sum(map(COMMON.__contains__, lower)), hashtags, long_chars)
    signed = [((bits >> (64 * k)) & 0xFFFFFFFFFFFFFFFF) - (1 << 64 if bits >> (64 * k + 63) & 1 else 0) for k in range(4)]
    return (*totals, *sums, *signed, breaks, begin, begin + len(inner) if inner else None, head, tail)


BITS = [f"bits{k}" for k in range(4)]
#: Counts of a chunk, its line breaks, and where its first and after its last visible character lie in the document.
COUNTS = [*SUMS, *LINES, *BITS, "breaks", "begin", "end"]
PIECE = "struct<words:bigint,black:bigint,digits:bigint,delimiters:bigint,prefix:string,last:string>"
STATE = "doc bigint, pos int, " + ", ".join(f"{c} bigint" for c in COUNTS) + f", head {PIECE}, tail {PIECE}"
PARTS = ["words", "black", "digits", "delimiters", "prefix", "last"]
_PART = pa.struct([*[(c, pa.int64()) for c in PARTS[:4]], ("prefix", pa.string()), ("last", pa.string())])


def state_columns(states: list[tuple]) -> list[pa.Array]:
    """Columns of the results of ``chunk_state``."""
    columns = list(zip(*states)) if states else [()] * (len(COUNTS) + 2)
    named = lambda ps: pa.array([dict(zip(PARTS, p)) if p else None for p in ps], _PART)
    return [*[pa.array(c, pa.int64()) for c in columns[:-2]], named(columns[-2]), named(columns[-1])]


def cuts(text: str, chunk: int) -> list[int]:
    """Where a text is cut: after the last blank within each ``chunk`` characters, anywhere in a run without one."""
    out, at = [0], 0
    while len(text) - at > chunk:
        blank = max(text.rfind(c, at, at + chunk) for c in " \n\t")
        at = blank + 1 if blank >= at else at + chunk
        out.append(at)
    return out


PIECES = STATE + ", parts int, offset bigint, chunk string, before string, after string"


def read_chunks(docs: DataFrame, chunk: int) -> DataFrame:
    """Documents (doc, text) as rows of ``PIECES``: a short one with its counts, each chunk of a longer one with its text.

    One pass over a text, whatever its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in STATE.replace(PIECE, "struct").split(", ")] + ["parts", "offset", "chunk", "before", "after"]

        def out(keys: list[tuple], states: list[tuple], texts: list[tuple]) -> pa.RecordBatch:
            doc, pos, parts, offset = (list(c) for c in zip(*keys)) if keys else ([], [], [], [])
            chunks, before, after = (list(c) for c in zip(*texts)) if texts else ([], [], [])
            columns = [pa.array(doc, pa.int64()), pa.array(pos, pa.int32()), *state_columns(states), pa.array(parts, pa.int32()), pa.array(offset, pa.int64()), *[pa.array(c, pa.string()) for c in (chunks, before, after)]]
            return pa.RecordBatch.from_arrays(columns, names=names)

        none = (None,) * (len(COUNTS) + 2)
        for batch in batches:
            keys, states, texts, held = [], [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
                if len(text) <= chunk:
                    keys.append((doc, 0, 1, 0))
                    states.append(chunk_state(text, "", "", True, True, 0))
                    texts.append((None, None, None))
                else:
                    starts = cuts(text, chunk)
                    for pos, (a, b) in enumerate(zip(starts, [*starts[1:], len(text)])):
                        keys.append((doc, pos, len(starts), a))
                        states.append(none)
                        texts.append((text[a:b], text[max(0, a - BEFORE) : a], text[b : b + 1]))
                        held += b - a
                        if held > 4_000_000:
                            yield out(keys, states, texts)
                            keys, states, texts, held = [], [], [], 0
            yield out(keys, states, texts)

    return docs.select("doc", "text").mapInArrow(run, PIECES)


def chunk_states(chunks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                pos, rows = part.column(1).to_pylist(), zip(*[part.column(i).to_pylist() for i in range(1, 7)])
                states = [chunk_state(text, before, after, p == 0, p == n - 1, offset) for p, n, offset, text, before, after in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pos, pa.int32()), *state_columns(states)], names=["doc", "pos", *COUNTS, "head", "tail"])

    return chunks.select("doc", "pos", "parts", "offset", "chunk", "before", "after").mapInArrow(run, STATE)


def merged(pieces: DataFrame) -> DataFrame:
    """Chunk states added up per document; lines cut by borders are put together by their numbers and classed."""
    totals, ends = [*SUMS, *LINES], ["begin", "end"]
    single = pieces.filter("parts = 1").select("doc", *totals, *BITS, *ends).dropDuplicates(["doc"])
    # the chunks of a long document spread over all tasks; read more than once below, as one small row each
    states = cut(chunk_states(pieces.filter("parts > 1").repartition("doc", "pos")).dropDuplicates(["doc", "pos"]))
    order = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = states.withColumn("line", F.coalesce(F.sum("breaks").over(order), F.lit(0)))
    counted = placed.groupBy("doc").agg(*[F.sum(c).alias(c) for c in totals], *[F.bit_or(c).alias(c) for c in BITS], F.min("begin").alias("begin"), F.max("end").alias("end"))

    both = F.explode(F.array(F.struct("line", F.col("head").alias("p")), F.struct((F.col("line") + F.col("breaks")).alias("line"), F.col("tail").alias("p")))).alias("x")
    cut_lines = placed.select("doc", "pos", both).select("doc", "pos", "x.line", "x.p.*").filter(F.col("words").isNotNull())
    whole = cut_lines.groupBy("doc", "line").agg(
        *[F.sum(c).alias(c) for c in PARTS[:4]],
        # of a line in thousands of chunks only the first visible ones matter
        F.min_by("prefix", F.when(F.trim("prefix") != "", F.col("pos"))).alias("prefix"),
        F.coalesce(F.max_by("last", F.when(F.col("last") != "", F.col("pos"))), F.lit("")).alias("last"),
    )
    ended = F.col("last").isin(*SENTENCE_END)
    record = F.col("prefix").rlike(URL) | (~ended & (F.col("delimiters") >= 2) & ((F.col("digits") >= 0.15 * F.col("black")) | (F.col("delimiters") >= F.greatest(0.5 * F.col("words"), 0.1 * F.col("black")))))
    item = ~record & ~ended & (F.col("words") <= F.when(F.col("prefix").rlike(MARKER), 12).otherwise(8))
    one = lambda c: ((F.col("black") > 0) & c).cast("long")
    classed = whole.groupBy("doc").agg(F.sum(one(F.lit(True))), F.sum(one(ended)), F.sum(one(item)), F.sum(one(item) * F.col("words")), F.sum(one(record)), F.sum(one(record) * F.col("words"))).toDF("doc", *[f"cut_{c}" for c in LINES])
    large = counted.join(classed, "doc", "left").select("doc", *SUMS, *[(F.col(c) + F.coalesce(f"cut_{c}", F.lit(0))).alias(c) for c in LINES], *BITS, *ends)
    return single.unionByName(large)


def share(a: str, b: Column | str) -> Column:
    total = F.col(b) if isinstance(b, str) else b
    return F.when(total > 0, F.col(a) / total).otherwise(F.lit(0.0))


def text_quality(df: DataFrame, id_col: str, text_col: str, chunk: int = CHUNK, least_chars: int = 20) -> DataFrame:
    """Statistics and a label (prose, list, table, junk, none) of every document.

    Columns: ``id_col``, ``n_chars``, ``n_words``, ``mean_word_length``, ``symbol_ratio``,
    ``digit_ratio``, ``vowel_ratio`` (of Latin letters), ``common_word_share``, ``n_lines``,
    ``ended_line_share`` (lines ending in punctuation), ``item_word_share``,
    ``record_line_share``, ``word_variety`` (marked bits of 256, which tell a handful of
    distinct words from more), ``label``.

    Method: texts are split into chunks of ``chunk`` characters, between words, and the chunks
    of long texts are spread over all tasks; each chunk gives partial counts that add up, corrected by the state of its borders (a word or a line that goes
    on); Spark's partial aggregation merges them as a tree, and cut lines are put together
    by their numbers. A document of a gigabyte is many small rows, and the result doesn't
    depend on ``chunk``.

    Defined cases: null, empty and blank texts and those under ``least_chars`` characters
    (blanks around them not counted) are labelled ``none`` and keep their counts (zero for
    null); ``\\r\\n`` and ``\\r`` are line ends; repeated ids count once if their text is the
    same; null ids are left out; an empty table gives no rows.
    """
    docs = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    # one pass over the texts; what comes out is narrow but for the chunks of long documents
    path = shared_path(df.sparkSession, "text-chunks")
    read_chunks(docs, chunk).write.option("compression", "zstd").parquet(path)
    pieces = df.sparkSession.read.parquet(path)
    total = merged(pieces).withColumn("symbols", F.col("chars") - F.col("word_chars") - F.col("spaces"))
    black = F.col("chars") - F.col("spaces")
    stats = total.select(
        F.col("doc").alias(id_col),
        F.col("chars").alias("n_chars"),
        F.col("words").alias("n_words"),
        share("word_chars", "words").alias("mean_word_length"),
        share("symbols", black).alias("symbol_ratio"),
        share("digits", black).alias("digit_ratio"),
        share("vowels", "latin").alias("vowel_ratio"),
        F.coalesce(F.col("end") - F.col("begin"), F.lit(0)).alias("n_inner"),
        F.col("latin").alias("n_latin"),
        black.alias("n_black"),
        share("common", "words").alias("common_word_share"),
        F.col("lines").alias("n_lines"),
        share("ended_lines", "lines").alias("ended_line_share"),
        share("item_words", "words").alias("item_word_share"),
        share("record_lines", "lines").alias("record_line_share"),
        share("hashtags", "words").alias("hashtag_share"),
        share("long_chars", black).alias("long_word_share"),
        sum((F.bit_count(c) for c in BITS), F.lit(0)).alias("word_variety"),
    )
    return stats.withColumn("label", rules(least_chars)).drop("n_inner", "n_latin", "n_black", "hashtag_share", "long_word_share")


def rules(least_chars: int) -> Column:
    """The rule outcomes, most certain first."""
    c = F.col
    return (
        F.when(c("n_inner") < least_chars, "none")
        .when(c("n_black") == 0, "none")
        .when((c("symbol_ratio") > 0.22) & (c("record_line_share") < 0.6), "junk")
        .when(c("long_word_share") > 0.4, F.when(c("record_line_share") >= 0.6, "table").otherwise("junk"))
        .when((c("n_latin") >= 20) & (c("n_latin") >= 0.6 * c("n_black")) & (c("vowel_ratio") < 0.27), "junk")
        .when(c("hashtag_share") > 0.3, "junk")
        .when((c("n_words") >= 12) & (c("word_variety") <= 14) & (c("word_variety") < 0.4 * c("n_words")) & (c("ended_line_share") < 0.5), "junk")
        .when(c("record_line_share") >= 0.6, "table")
        .when((c("n_lines") >= 3) & (c("item_word_share") >= 0.5), "list")
        .otherwise("prose")
    )

"""Word sets of texts and their fast similarity sketches, as Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a maximal run of letters and digits, lower-cased.
WORD = re.compile(r"[^\W_]+")
CELLS = ["size", "p0", "p1", "p2", "p3"]
SETS = "tbl string, id string, doc bigint, words array<int>, size int, p0 bigint, p1 bigint, p2 bigint, p3 bigint"
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Codes(dict):
    """32-bit codes of words or shingles, kept between texts; started anew when large."""

    def __missing__(self, key: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        code = self[key] = xxhash.xxh32_intdigest(key)
        return code


def elements(text: str, shingle: int) -> set[str]:
    words = WORD.findall(text.lower())
    if shingle == 1:
        return set(words)
    return {" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)}


def word_sets(texts: DataFrame, min_words: int, shingle: int = 1, apart: bool = True) -> DataFrame:
    """Rows (tbl, id, text) -> ``SETS`` for texts of at least ``min_words`` elements.

    ``words`` has the sorted 32-bit codes of the distinct elements, ``size`` their number and
    ``p0`` to ``p3`` the parity of the words in each of 256 hashed cells; ``doc`` is a 64-bit
    key of set and table (of the set alone if not ``apart``), so rows with the same set share
    it (of ten billion different sets some three pairs are expected to). Null texts have no
    set. A task gives the words of a set once and null for its later copies, so that a set
    copied over a third of all rows leaves one row per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, seen = Codes(), set()
        for batch in batches:
            if len(seen) > 1_000_000:
                seen.clear()
            tbls, ids, out_t, out_i, docs, flat, offsets, again = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], [], [], [], [0], []
            for tbl, key, text in zip(tbls, ids, batch.column(2).to_pylist()):
                if not text:
                    continue
                found = elements(text, shingle)
                if len(found) < min_words:
                    continue
                words = np.unique(np.fromiter(map(codes.__getitem__, found), np.uint32, len(found)))
                out_t.append(tbl)
                out_i.append(key)
                doc = xxhash.xxh64_intdigest(words.tobytes(), seed=xxhash.xxh32_intdigest(tbl) if apart else 0)
                docs.append(doc)
                again.append(doc in seen)
                if doc not in seen:
                    seen.add(doc)
                    flat.append(words)
                offsets.append(offsets[-1] + (0 if again[-1] else len(words)))
            values = np.concatenate(flat) if flat else np.empty(0, np.uint32)
            missing = np.array(again, bool)
            size, cells = parities(values, np.array(offsets, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out_t, pa.string()), pa.array(out_i, pa.string()), pa.array(np.array(docs, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int32)), mask=pa.array(again, pa.bool_())),
                    pa.array(size, mask=missing), *[pa.array(c, mask=missing) for c in cells],
                ],
                names=["tbl", "id", "doc", "words", *CELLS],
            )

    return texts.select("tbl", F.col("id").cast("string").alias("id"), "text").mapInArrow(run, SETS)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fast_similarity_sketch(values: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """Sketches of many sets at once: an array (sets, bins).

    Round i places every element of a set in a hashed bin with the value i + a hashed
    fraction; a bin keeps its least value. After ``bins`` rounds, round bins + j places all
    elements in bin j, so that every bin is filled after 2 * bins rounds at the latest. A
    set leaves as soon as all its bins are filled; for a set of n elements that takes about
    bins * ln(bins) / n rounds. Coordinates of two sets agree with the probability of their
    Jaccard similarity, concentrated as with independent hash functions.
    """
    n = len(offsets) - 1
    sketch = np.full((n, bins), EMPTY, np.uint64)
    sizes = np.diff(offsets)
    owner, word = np.repeat(np.arange(n), sizes), mix(values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    flat = sketch.reshape(-1)
    for i in range(2 * bins):
        if not len(word):
            break
        h = mix(word ^ np.uint64((i + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        at = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32) if i < bins else np.full(len(h), i - bins, np.uint64)
        np.minimum.at(flat, owner * bins + at.astype(np.int64), np.uint64(i << 32) | (h & np.uint64(0xFFFFFFFF)))
        if i % 4 == 3 or i >= bins:
            open_sets = (sketch == EMPTY).any(axis=1)
            keep = open_sets[owner]
            owner, word = owner[keep], word[keep]
    return sketch


def parities(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of many sets their sizes and, as four words of 64 bits, the parity of their elements in each of 256 hashed cells."""
    cell = mix(values.astype(np.int32).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(56)
    bit, quarter, full = np.uint64(1) << (cell & np.uint64(63)), cell >> np.uint64(6), np.flatnonzero(np.diff(offsets))
    out = np.zeros((4, len(offsets) - 1), np.uint64)
    if len(full):
        for q in range(4):
            out[q, full] = np.bitwise_xor.reduceat(np.where(quarter == q, bit, np.uint64(0)), offsets[full])
    return np.diff(offsets).astype(np.int32), out.view(np.int64)


def can_be_similar(pairs: DataFrame, a: str, b: str, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``pairs`` whose sets ``a`` and ``b`` may reach ``threshold``, by the sizes and parities of both sides (doc, ``CELLS``).

    No similar pair goes: sets differ in at least as many words as their parities differ in
    cells, and sets of similarity t differ in at most (1 - t) / (1 + t) of their sizes' sum.
    """
    named = lambda df, key, side: df.select(F.col("doc").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in CELLS])
    both = pairs.join(named(left, a, "l"), a).join(named(right, b, "r"), b)
    apart = sum(F.bit_count(F.col(f"l_p{q}").bitwiseXOR(F.col(f"r_p{q}"))) for q in range(4))
    return both.filter(apart <= (F.col("l_size") + F.col("r_size")) * ((1 - threshold) / (1 + threshold)) + 1e-6).select(*pairs.columns)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets from 0 of a list column."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy()[offsets[0] : offsets[-1]]
    return values, offsets - offsets[0]


def jaccard(a: Column, b: Column) -> Column:
    """Exact similarity of two columns of distinct codes."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)

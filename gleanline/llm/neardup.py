"""Problem 3: near-duplicate records in collections too large for pairwise comparison."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_pairs, shared_path, write_apart
from .sketch import CELLS, fast_similarity_sketch, jaccard, lists, mix, word_sets

#: A pair of similarity 0.60 shares a band with 0.957, of 0.65 with 0.994, of 0.70 with 0.9997.
BANDS, ROWS = 66, 6
#: So many bands are exchanged at once; their rows, most of what is stored, go before the next ones come.
BANDS_AT_ONCE = 11
#: Bits of a band row that hold the bucket (with its band) and the one-bit coordinates of the set.
BUCKET_BITS, AGREE_BITS = 30, 34
#: Of pairs at the threshold at most this share is lost by the one-bit coordinates.
AGREE_LOSS = 0.005
#: A bucket of more sets than this is given out in blocks of so many, which other tasks pair. (A set is
#: given out once for every block; smaller blocks would be more data than the input.)
BLOCK = 8000
#: Pairs that are looked at together.
AT_ONCE = 500_000


@cache
def least_agreement(threshold: float) -> int:
    """How many one-bit coordinates sets of this similarity agree in, but for ``AGREE_LOSS`` of them.

    One bit of a coordinate agrees with (1 + similarity) / 2: for sets of 0.60 in 27 of 34
    on average, for unrelated ones in about 19.
    """
    p, below = (1 + threshold) / 2, 0.0
    for k in range(AGREE_BITS + 1):
        below += comb(AGREE_BITS, k) * p**k * (1 - p) ** (AGREE_BITS - k)
        if below > AGREE_LOSS:
            return k
    return AGREE_BITS


def band_rows(sets: DataFrame, bands: int, rows: int, seed: int = 0) -> DataFrame:
    """(bucket, doc, ``CELLS``) of every band of every distinct set: band and hash of its coordinates in the highest bits of ``bucket``, one-bit coordinates of the whole set in the lowest.

    Hashes of so few bits merge fewer unrelated sets than share a band by chance. Another
    ``seed`` gives other, independent bands.
    """
    hash_bits = BUCKET_BITS - (bands - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = np.arange(bands, dtype=np.uint64)[None, :]
        single = np.linspace(0, bands * rows - 1, AGREE_BITS).astype(np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                doc = part.column(0).to_numpy()
                salt = np.array([xxhash.xxh32_intdigest(t) for t in part.column(1).to_pylist()], np.uint64)
                values, offsets = lists(part.column(2))
                flat = fast_similarity_sketch(values.view(np.uint32).astype(np.uint64) | np.uint64(seed << 32), offsets, bands * rows)
                bits = ((mix(flat[:, single]) & np.uint64(1)) << np.arange(AGREE_BITS, dtype=np.uint64)[None, :]).sum(1, dtype=np.uint64)
                sketch = flat.reshape(len(doc), bands, rows)
                bucket = mix(band + np.uint64(1) + salt[:, None] * np.uint64(1000))
                for k in range(rows):
                    bucket = mix(bucket ^ sketch[:, :, k])
                bucket = band << np.uint64(hash_bits) | bucket >> np.uint64(64 - hash_bits)
                row = bucket << np.uint64(AGREE_BITS) | bits[:, None]
                carried = [np.repeat(part.column(k).to_numpy(), bands) for k in (0, *range(3, 8))]
                yield pa.RecordBatch.from_arrays([pa.array(row.reshape(-1).view(np.int64)), *map(pa.array, carried)], names=["bucket", "doc", *CELLS])

    return sets.select("doc", "tbl", "words", *CELLS).mapInArrow(run, "bucket bigint, doc bigint, size int, p0 bigint, p1 bigint, p2 bigint, p3 bigint")


class Signs:
    """What rows of ``band_rows`` tell of their sets: ``row``, ``doc``, ``size`` and ``cells``, row by row."""

    def __init__(self, row: np.ndarray, doc: np.ndarray, size: np.ndarray, cells: np.ndarray) -> None:
        self.row, self.doc, self.size, self.cells = row, doc, size, cells

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Signs:
        row, doc, size, *cells = (c.to_numpy() for c in batch.columns)
        return cls(row, doc, size.astype(np.int64), np.stack(cells, 1).view(np.uint64))

    @classmethod
    def together(cls, parts: list[Signs]) -> Signs:
        return cls(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("row", "doc", "size", "cells")))

    def cut(self, begin: int, end: int | None = None) -> Signs:
        return Signs(self.row[begin:end], self.doc[begin:end], self.size[begin:end], self.cells[begin:end])

    def flat(self) -> np.ndarray:
        return np.concatenate([self.row[:, None], self.size[:, None], self.cells.view(np.int64)], 1).reshape(-1)

    @classmethod
    def unflat(cls, doc: np.ndarray, flat: np.ndarray) -> Signs:
        table = flat.reshape(len(doc), 6)
        return cls(table[:, 0], doc, table[:, 1], np.ascontiguousarray(table[:, 2:]).view(np.uint64))

    def alike(self, x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of rows (``x``, ``y``) whose sets differ and may reach ``threshold``: by one-bit coordinates, then by the exact bound of ``can_be_similar``."""
        mask = np.int64((1 << AGREE_BITS) - 1)
        keep = (AGREE_BITS - np.bitwise_count((self.row[x] ^ self.row[y]) & mask) >= least_agreement(threshold)) & (self.doc[x] != self.doc[y])
        x, y = x[keep], y[keep]
        apart = np.bitwise_count(self.cells[x] ^ self.cells[y]).sum(1, dtype=np.int64)
        keep = apart <= (self.size[x] + self.size[y]) * ((1 - threshold) / (1 + threshold)) + 1e-6
        return x[keep], y[keep]


def index_pairs(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs x < y of ``n`` rows, some ``AT_ONCE`` at a time."""
    step = max(1, AT_ONCE // n)
    for begin in range(0, n - 1, step):
        part, others = np.arange(begin, min(begin + step, n)), np.arange(begin + 1, n)
        x, y = np.repeat(part, len(others)), np.tile(others, len(part))
        yield x[x < y], y[x < y]


SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("left", "right", "left_signs", "right_signs")]])
CANDIDATES = "a bigint, b bigint, left array<bigint>, right array<bigint>, left_signs array<bigint>, right_signs array<bigint>"


def pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs, the smaller first, as rows of ``CANDIDATES``."""
    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.empty((2, 0), np.int64)
    none = pa.nulls(pair.shape[1], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), *[none] * 4], schema=SCHEMA)


def bucket_pairs(bands: DataFrame, threshold: float, block_size: int = BLOCK) -> DataFrame:
    """Candidate pairs (a < b) of the sets that share a bucket and may be similar, as rows of ``CANDIDATES``.

    Unrelated sets that meet over words all have grow with the square of the input. They
    are told apart here, where they meet, and never stored. Rows come sorted by bucket; a
    task keeps 56 bytes per set of the bucket at hand. A bucket of more than ``block_size``
    sets is not paired here: its blocks come out two by two, ``left`` and ``right``, with
    what ``block_pairs`` needs to tell the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, waiting = [], [], 0

        def pairs_of(signs: Signs) -> Iterator[pa.RecordBatch]:
            nonlocal first, second, waiting
            if not len(signs.row):
                return
            key = signs.row >> AGREE_BITS
            starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            for size in np.unique(sizes[sizes > 1]):
                at = starts[sizes == size]
                if size > block_size:
                    for begin in at:
                        blocks = [signs.cut(c, min(c + block_size, begin + size)) for c in range(begin, begin + size, block_size)]
                        for i, left in enumerate(blocks):
                            for right in blocks[i:]:
                                cells = [[left.doc], [right.doc], [left.flat()], [right.flat()]]
                                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 2 + [pa.array(c, pa.list_(pa.int64())) for c in cells], schema=SCHEMA)
                    continue
                for i, j in index_pairs(size):
                    step = max(1, AT_ONCE // len(i))
                    for k in range(0, len(at), step):
                        block = at[k : k + step, None]
                        x, y = signs.alike((block + i).reshape(-1), (block + j).reshape(-1), threshold)
                        first.append(signs.doc[x])
                        second.append(signs.doc[y])
                        waiting += len(x)
                        if waiting > 1_000_000:
                            yield pair_batch(np.concatenate(first), np.concatenate(second))
                            first, second, waiting = [], [], 0

        parts: list[Signs] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append(Signs.of(batch))
            last = parts[-1].row[-1] >> AGREE_BITS
            if last == parts[0].row[0] >> AGREE_BITS:  # the whole batch belongs to the bucket at hand
                continue
            signs = Signs.together(parts)
            rest = np.searchsorted(signs.row >> AGREE_BITS, last)
            yield from pairs_of(signs.cut(0, rest))
            parts = [signs.cut(rest)]
        if parts:
            yield from pairs_of(Signs.together(parts))
        if waiting:
            yield pair_batch(np.concatenate(first), np.concatenate(second))

    return bands.repartition(F.shiftright("bucket", AGREE_BITS)).sortWithinPartitions("bucket").mapInArrow(run, CANDIDATES)


def block_pairs(blocks: DataFrame, threshold: float | None = None) -> DataFrame:
    """The pairs (a < b) of blocks: every set of ``left`` with every one of ``right``, without ``threshold`` whether they may be similar or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                left, right, left_signs, right_signs = (c[row].values.to_numpy() for c in batch.columns)
                signs = Signs.unflat(np.concatenate([left, right]), np.concatenate([left_signs, right_signs]))
                step = max(1, AT_ONCE // len(right))
                for begin in range(0, len(left), step):
                    part = np.arange(begin, min(begin + step, len(left)))
                    x, y = np.repeat(part, len(right)), np.tile(np.arange(len(left), len(left) + len(right)), len(part))
                    if threshold is not None:
                        x, y = signs.alike(x, y, threshold)
                    a, b = signs.doc[x], signs.doc[y]
                    yield pair_batch(a[a != b], b[a != b]).select(["a", "b"])

    return blocks.select("left", "right", "left_signs", "right_signs").mapInArrow(run, "a bigint, b bigint")


def similar_sets(stored: DataFrame, threshold: float, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Pairs of distinct sets of one table of at least ``threshold`` similarity: ``a``, ``b``, ``similarity``.

    ``stored`` is a written table of ``SETS``, which may repeat a set a few times.
    """
    spark = stored.sparkSession
    path = shared_path(spark, "distinct-sets")
    write_apart(stored.filter(F.col("words").isNotNull()).select("tbl", "doc", "words", *CELLS).dropDuplicates(["doc"]), path)
    known = spark.read.parquet(path)
    path = shared_path(spark, "band-pairs")
    parts = [f"{path}/{seed}" for seed in range(-(-bands // BANDS_AT_ONCE))]
    for seed, part in enumerate(parts):
        own = band_rows(known, min(BANDS_AT_ONCE, bands - seed * BANDS_AT_ONCE), rows, seed)
        write_apart(bucket_pairs(own, threshold), part)
    found = spark.read.parquet(*parts)
    pairs = found.filter("left is null").select("a", "b")
    if not (large := found.filter("left is not null")).isEmpty():
        pairs = pairs.unionByName(block_pairs(large.repartition(F.xxhash64("left", "right")), threshold))
    pairs = pairs.repartition("a").distinct()
    side = lambda key: known.select(F.col("doc").alias(key), F.col("words").alias(f"words_{key}"), F.col("tbl").alias(f"tbl_{key}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter("tbl_a = tbl_b")
    return both.select("a", "b", jaccard(F.col("words_a"), F.col("words_b")).alias("similarity")).filter(F.col("similarity") >= threshold)


def near_duplicates(texts: DataFrame, threshold: float = 0.8, min_words: int = 1, shingle: int = 5, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates among rows (tbl, id, text): membership (tbl, id, doc) and links (a, b, similarity).

    Rows with the same element set are one class, ``doc``; links join different classes of
    one table whose exact Jaccard similarity reaches ``threshold``. Elements are runs of
    ``shingle`` words (1: single words). Nobody needs all pairs of a large group of copies
    to know it; ``pairs`` expands them where rows are wanted.

    Method: fast similarity sketching of each distinct set, banding, exact verification. The
    whole sets are signed, whatever share of all sets has a word; sets that meet only over
    words that all texts have go in the bucket, by one-bit coordinates and an exact bound,
    before anything is stored of them.

    Defined cases: null texts and texts of fewer than ``min_words`` elements are in no class;
    very long texts are taken whole; rows repeated with one id are one member; an empty
    table gives empty results. Words are compared by 32-bit codes: two of the words of a
    pair share a code once in some 400,000 pairs, which shifts its similarity by one word.
    """
    spark = texts.sparkSession
    path = shared_path(spark, "word-sets")
    word_sets(texts, min_words, shingle).write.option("compression", "zstd").parquet(path)
    stored = spark.read.parquet(path)
    links = similar_sets(stored, threshold, bands, rows)
    return stored.select("tbl", "id", "doc").distinct(), links


def pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Membership and links expanded to pairs of rows: ``tbl``, ``id_a``, ``id_b``, the smaller id first."""
    return row_pairs(members, links, ["tbl"])

"""Problem 8: encode a corpus with a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the published pattern that splits text before the merges of byte_bpe_50k.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_WORDS, KEPT_PAIRS = 300_000, 1_000_000
UNKNOWN, NEVER, BEYOND = -1, -2, 1 << 40


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in the .json vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids from a ``.tiktoken`` rank file or a ``.json`` byte-level vocabulary."""
    if path.endswith(".json"):
        model = json.load(open(path, encoding="utf-8"))
        added = {t["content"] for t in model.get("added_tokens", [])}
        byte_of = byte_alphabet()
        return {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Byte-level BPE by *speculate and verify*.

    A word is first cut greedily into the longest tokens. That guess is the encoding exactly
    if every pair of neighbouring tokens is *compatible*: encoding the bytes of the two
    gives the two again. The pairs of all new words are tested together, as arrays; only
    words with an incompatible pair are merged step by step.
    """

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.longest = max(map(len, self.ranks))
        self.token = {i: t for t, i in self.ranks.items()}
        self.words: dict[str, tuple[int, ...]] = {}
        size = max(self.token) + 1
        # the two tokens that the last merge of a token joins, worked out when first needed; bytes are their own halves
        self.left, self.right = np.full(size, UNKNOWN, np.int64), np.full(size, UNKNOWN, np.int64)
        for i, t in self.token.items():
            if len(t) == 1:
                self.left[i] = self.right[i] = i
        self.joined: dict[int, int] = {}

    def merge(self, data: bytes, below: int | None = None) -> tuple[int, ...]:
        """Exact merging: the neighbouring parts with the lowest rank join first, the leftmost of equals; only ranks ``below`` one, if given."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        if len(parts) > 512 and below is None:
            return self.merge_long(data)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best) and (below is None or rank < below):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def merge_long(self, data: bytes) -> tuple[int, ...]:
        """The same for very long words, with a heap over linked parts."""
        import heapq

        n, ranks = len(data), self.ranks
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n:
                j = end[i]
                rank = ranks.get(data[i : end[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop or not alive[end[i]]:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
            offer(i)
            offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def greedy(self, data: bytes) -> tuple[int, ...]:
        ranks, longest, out, i = self.ranks, self.longest, [], 0
        while i < len(data):
            for stop in range(min(len(data), i + longest), i, -1):
                rank = ranks.get(data[i:stop])
                if rank is not None:
                    out.append(rank)
                    i = stop
                    break
            else:
                raise ValueError(f"byte {data[i]} is not in the vocabulary")
        return tuple(out)

    def learn(self, words: list[str]) -> None:
        """Encode new words: guess all, test all their pairs at once, merge where a pair fails."""
        guesses = [self.greedy(w.encode("utf-8", "surrogatepass")) for w in words]
        lengths = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(guesses)), lengths)
        inner = np.flatnonzero(owner[:-1] == owner[1:]) if len(flat) > 1 else np.empty(0, np.int64)
        pair, back = np.unique((flat[inner] << 32) | flat[inner + 1], return_inverse=True)
        compatible = self.compatible(pair)
        failing = set(owner[inner[~compatible[back]]].tolist())
        for k, (word, guess) in enumerate(zip(words, guesses)):
            self.words[word] = self.merge(word.encode("utf-8", "surrogatepass")) if k in failing else guess

    def halves(self, tokens: np.ndarray) -> None:
        """Work out the halves of ``tokens`` that aren't known yet."""
        for t in np.unique(tokens[self.left[tokens] == UNKNOWN]).tolist():
            parts = self.merge(self.token[t], below=t)
            # a token that no merge reaches has none, and goes with no neighbour
            self.left[t], self.right[t] = parts if len(parts) == 2 else (NEVER, NEVER)

    def joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that neighbours ``a`` and ``b`` join to, or a number beyond all."""
        codes, back = np.unique(a << 32 | b, return_inverse=True)
        if len(self.joined) > KEPT_PAIRS:
            self.joined.clear()
        joined, token, ranks = self.joined, self.token, self.ranks
        for c in codes.tolist():
            if c not in joined:
                joined[c] = ranks.get(token[c >> 32] + token[c & 0xFFFFFFFF], BEYOND)
        return np.fromiter(map(joined.__getitem__, codes.tolist()), np.int64, len(codes))[back]

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Which pairs of tokens (first << 32 | second) stay apart when their bytes are merged.

        The merges of both are undone from the last one back, for all pairs at once. At each
        step the tokens that touch across the border must not join to one that comes before
        the merge undone last, or it would have been chosen.
        """
        fine, open_pairs = np.ones(len(pairs), bool), np.arange(len(pairs))
        a, b, limit = pairs >> 32, pairs & 0xFFFFFFFF, np.full(len(pairs), BEYOND)
        self.halves(a), self.halves(b)
        fine[(self.left[a] == NEVER) | (self.left[b] == NEVER)] = False
        while len(open_pairs := open_pairs[fine[open_pairs]]):
            x, y = a[open_pairs], b[open_pairs]
            refused = self.joins(x, y) < limit[open_pairs]
            fine[open_pairs[refused]] = False
            open_pairs, x, y = open_pairs[~refused], x[~refused], y[~refused]
            whole_x, whole_y = self.right[x] == x, self.left[y] == y
            # the later merge is undone first; a byte has none, so it is the other's turn
            first = np.where(whole_x, False, np.where(whole_y, True, x > y))
            limit[open_pairs] = np.where(first, x, y + 1)
            self.halves(x), self.halves(y)
            a[open_pairs], b[open_pairs] = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
            self.halves(a[open_pairs]), self.halves(b[open_pairs])
            open_pairs = open_pairs[~(whole_x & whole_y)]
        return fine

    def encode_batch(self, texts: list[str | None], split: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and their offsets."""
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        cut = [split.findall(t) if t else [] for t in texts]
        known = self.words
        new = {w for words in cut for w in words if w not in known}
        if new:
            self.learn(list(new))
        flat: list[int] = []
        offsets = [0]
        for words in cut:
            for w in words:
                flat.extend(known[w])
            offsets.append(len(flat))
        return np.array(flat, np.int32), np.array(offsets, np.int64)


_encoders: dict[str, tuple[Encoder, regex.Pattern]] = {}


def encoder(path: str, pattern: str = SPLIT) -> tuple[Encoder, regex.Pattern]:
    """The encoder of a vocabulary, loaded once per Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path), regex.compile(pattern)
    return _encoders[path]


def encode(df: DataFrame, text_col: str, keep: list[str], vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS, ids_col: str = "ids", count_only: bool = False) -> DataFrame:
    """``keep`` columns and the token ids of ``text_col`` (their number if ``count_only``).

    Method: speculate and verify (see ``Encoder``); distinct words are encoded once per
    worker, so that repeated words cost one look-up.

    Defined cases: null and empty texts give an empty list (0); strings of special tokens
    inside a text are ordinary text; white space, control characters and texts of any length
    are encoded whole. ``vocabulary`` is a byte-level file below ``folder``, read on each
    worker. Other columns are not read.
    """
    path = os.path.join(folder, vocabulary)
    fields = [df.schema[c] for c in keep]
    schema = StructType([*fields, StructField(ids_col, IntegerType() if count_only else ArrayType(IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, split = encoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                flat, offsets = enc.encode_batch(part.column(len(keep)).to_pylist(), split)
                ids = pa.array(np.diff(offsets).astype(np.int32)) if count_only else pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], ids], names=[*keep, ids_col])

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)

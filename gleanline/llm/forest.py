"""Problem 6: deduplicate new batches against all history with a prefix-tree hash forest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_folder, shared_path
from .sketch import CELLS, can_be_similar, fast_similarity_sketch, jaccard, lists, mix, word_sets

TREES, LEVELS, BITS = 48, 8, 8
#: Trees of whole histories: at 0.60 and a recall of 0.95 they allow a prefix of 6 levels (48 trees: 5), which fewer unrelated sets share.
HISTORY_TREES = 80
#: More runs than this are merged when the next one is accepted.
RUN_LIMIT = 32
#: When history was accepted: before every date.
HISTORY = -(2**62)


def search_depth(similarity: float, recall: float, trees: int = TREES, levels: int = LEVELS) -> int:
    """The longest prefix whose expected recall at ``similarity`` reaches ``recall``.

    Starts at the whole key and widens (shortens the prefix) level by level; a pair of this
    similarity shares a prefix of d levels in one of the trees with 1 - (1 - s^d)^trees.
    """
    for depth in range(levels, 0, -1):
        if 1 - (1 - similarity**depth) ** trees >= recall:
            return depth
    raise ValueError("no prefix reaches this recall; plant more trees")


def tree_keys(sets: DataFrame, trees: int = TREES, levels: int = LEVELS) -> DataFrame:
    """(tree, key, doc) of each set (doc, words): ``levels`` sketch coordinates of 8 bits, the first one highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                doc = part.column(0).to_numpy()
                sketch = mix(fast_similarity_sketch(*lists(part.column(1)), trees * levels)).reshape(len(doc), trees, levels)
                key = np.zeros((len(doc), trees), np.uint64)
                for level in range(levels):
                    key = (key << np.uint64(BITS)) | (sketch[:, :, level] & np.uint64(0xFF))
                tree = np.tile(np.arange(trees, dtype=np.int32), len(doc))
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(doc, trees))], names=["tree", "key", "doc"])

    return sets.select("doc", "words").mapInArrow(run, "tree int, key bigint, doc bigint")


class HashForest:
    """A persisted forest of prefix trees over the sets accepted so far.

    Below ``path`` lie the runs, one per accepted batch, and numbered manifests, of which the
    last one names the runs that count and the shape of the trees. A run has ``sets`` (doc,
    words, first: when the set was first accepted, and its size and parities) and ``keys``
    (tree, key, doc), sorted by tree and key, so that a prefix is a range of them. A run is
    signed and written once and only read for later batches, also by later applications:
    a forest opens at an existing path with all it has. ``merge_runs`` rewrites many runs as
    one. Whole sets are signed, so that the recall of a prefix holds whatever words many
    sets share.
    """

    def __init__(self, spark: SparkSession, path: str, trees: int = TREES, levels: int = LEVELS):
        self.spark, self.path, self.trees, self.levels = spark, path.rstrip("/"), trees, levels
        self.runs: list[str] = []
        self.version = 0
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(folder):
            names = [f.getPath().getName() for f in fs.listStatus(folder)]
            self.version = max((int(n.split("-")[1].split(".")[0]) for n in names if n.startswith("manifest-")), default=0)
        if self.version:
            last = json.loads("".join(r["value"] for r in spark.read.text(self._manifest(self.version), wholetext=True).collect()))
            self.runs, self.trees, self.levels = [f"{self.path}/{r}" for r in last["runs"]], last["trees"], last["levels"]

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest-{version}.json"

    def _publish(self, runs: list[str]) -> None:
        """The next manifest: runs count from now on, or no longer."""
        self.runs, self.version = runs, self.version + 1
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self._manifest(self.version))
        out = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(target, False)
        text = json.dumps({"runs": [r.rsplit("/", 1)[1] for r in runs], "trees": self.trees, "levels": self.levels})
        out.write(bytearray(text.encode()))
        out.close()

    def accept(self, sets: DataFrame) -> str:
        """Append distinct sets (doc, words, first, ``CELLS``) as a run and give its path."""
        if len(self.runs) >= RUN_LIMIT:
            self.merge_runs()
        run = f"{self.path}/run-{uuid.uuid4().hex[:12]}"
        sets.select("doc", "words", "first", *CELLS).write.option("compression", "zstd").parquet(f"{run}/sets")
        stored = self.spark.read.parquet(f"{run}/sets")
        # each task writes a sorted piece of its own: appending needs no shuffle
        tree_keys(stored, self.trees, self.levels).sortWithinPartitions("tree", "key").write.option("compression", "zstd").parquet(f"{run}/keys")
        self._publish([*self.runs, run])
        return run

    def merge_runs(self) -> str:
        """All runs as one, range-sorted by tree and key; the old ones are deleted."""
        old, run = self.runs, f"{self.path}/run-{uuid.uuid4().hex[:12]}"
        self.keys(old).repartitionByRange("tree", "key").sortWithinPartitions("tree", "key").write.option("compression", "zstd").parquet(f"{run}/keys")
        first = [F.first(c).alias(c) for c in ("words", *CELLS)]
        self.sets(old).groupBy("doc").agg(*first, F.min("first").alias("first")).write.option("compression", "zstd").parquet(f"{run}/sets")
        self._publish([run])
        for gone in old:
            drop_folder(self.spark, gone)
        return run

    def sets(self, runs: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{r}/sets" for r in runs])

    def keys(self, runs: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{r}/keys" for r in runs])

    def _search(self, asked: DataFrame, known: DataFrame, depth: int, threshold: float) -> DataFrame:
        """Of sets ``known``, by their keys ``asked``, those with a similar set accepted before them: ``doc``, ``near``.

        The entries of a prefix are one range of the sorted keys; asked keys and entries meet
        in a merge of both in that order.
        """
        prefix = F.shiftright("key", 64 - BITS * depth).alias("prefix")
        entries = self.keys(self.runs).select("tree", prefix, F.col("doc").alias("entry"))
        candidates = asked.select("tree", prefix, "doc").join(entries, ["tree", "prefix"]).filter("doc <> entry").select("doc", "entry").distinct()
        everything = self.sets(self.runs).select("doc", *CELLS).dropDuplicates(["doc"])
        candidates = can_be_similar(candidates, "doc", "entry", known, everything, threshold)
        accepted = self.sets(self.runs).select(F.col("doc").alias("entry"), F.col("words").alias("entry_words"), F.col("first").alias("accepted"))
        both = candidates.join(known.select("doc", "words", "first"), "doc").join(accepted, "entry")
        similar = both.filter((F.col("accepted") < F.col("first")) & (jaccard(F.col("words"), F.col("entry_words")) >= threshold))
        return similar.groupBy("doc").agg(F.min("accepted").alias("near"))

    def similar(self, run: str, threshold: float, recall: float) -> DataFrame:
        """The sets of ``run`` that have a similar set accepted before them: ``doc``, ``near`` (a time at which one was).

        A set is first looked for by its whole keys, which only very similar sets share; for
        those without a verified entry the prefixes are widened to the length whose expected
        recall at ``threshold`` reaches ``recall``.
        """
        asked, known = self.keys([run]), self.sets([run])
        # whole keys: their expected recall at 0.95 is above 0.99
        path = shared_path(self.spark, "forest-found")
        self._search(asked, known, self.levels, threshold).write.parquet(path)
        close = self.spark.read.parquet(path)
        depth = search_depth(threshold, recall, self.trees, self.levels)
        if depth == self.levels:
            return close
        open_sets = close.select("doc")
        wide = self._search(asked.join(open_sets, "doc", "left_anti"), known.join(open_sets, "doc", "left_anti"), depth, threshold)
        return close.unionByName(wide)


def distinct_sets(rows: DataFrame) -> DataFrame:
    """Rows of ``SETS`` with ``first``, one per set: when it was first seen."""
    kept = [F.first(c, ignorenulls=True).alias(c) for c in ("words", *CELLS)]
    return rows.groupBy("doc").agg(*kept, F.min("first").alias("first"))


def sets_of(rows: DataFrame, min_words: int, shingle: int) -> DataFrame:
    """Rows (id, text, first) -> ``SETS`` with ``first``; a set is one whatever batch it comes in."""
    # the batch travels in the place of the table's name
    return word_sets(rows.select(F.col("first").cast("string").alias("tbl"), "id", "text"), min_words, shingle, apart=False).withColumn("first", F.col("tbl").cast("long")).drop("tbl")


def already_accepted(history: DataFrame | None, batches: DataFrame, threshold: float = 0.8, min_words: int = 1, shingle: int = 5, recall: float = 0.95, path: str | None = None) -> DataFrame:
    """Ids of ``batches`` that repeat an item or say nearly the same as something accepted before.

    ``history`` (id, item, text) was accepted before all batches; ``batches`` (id, item,
    text, batch) come in the order of the date ``batch``, and a row is held against the
    history and all earlier batches, never its own. ``item`` is a key made comparable
    beforehand.

    Method: a forest of sorted signature permutations. The history is signed and stored once
    as a run, the batches as further runs; entries are located by prefix ranges, widened
    until the expected recall at ``threshold`` reaches ``recall``, and verified on the exact
    sets. Entries know when they were accepted, so that one pass over the runs answers all
    batches as if they had come one after the other.

    With ``path`` the forest and the items seen stay there: a later call with the same path
    and ``history`` None signs its batches only and holds them against all that was accepted
    before, the history and the batches of earlier calls. Without it a folder of its own is
    used.

    Defined cases: null items and texts match nothing; texts of fewer than ``min_words``
    elements are compared by item only; a row repeated with one id is asked once per batch
    it came in; exact copies of a text share one entry; very long texts are taken whole;
    without history a batch is held against the earlier ones only; an empty batch table
    gives no rows.
    """
    spark = batches.sparkSession
    path = path or shared_path(spark, "forest")
    forest = HashForest(spark, f"{path}/runs", HISTORY_TREES)
    new = batches.select(F.col("id").cast("string").alias("id"), "item", "text", F.unix_date(F.to_date("batch")).cast("long").alias("first"))
    seen_before = f"{path}/items"

    def see(rows: DataFrame) -> None:
        rows.filter(F.col("item").isNotNull()).groupBy("item").agg(F.min("first").alias("first")).write.mode("append").parquet(seen_before)

    if history is not None:
        old = history.select(F.col("id").cast("string").alias("id"), "item", "text", F.lit(HISTORY).cast("long").alias("first"))
        see(old)
        forest.accept(distinct_sets(sets_of(old, min_words, shingle)))
    see(new)
    items = spark.read.parquet(seen_before).groupBy("item").agg(F.min("first").alias("seen"))
    again = new.select("id", "item", "first").join(items, "item").filter("seen < first").select("id")

    members = shared_path(spark, "forest-batches")
    sets_of(new, min_words, shingle).write.option("compression", "zstd").parquet(members)
    asked = spark.read.parquet(members)
    run = forest.accept(distinct_sets(asked))
    own = forest.sets(forest.runs).groupBy("doc").agg(F.min("first").alias("own"))
    near = forest.similar(run, threshold, recall)
    rows = asked.select("id", "doc", "first").join(own, "doc").join(near, "doc", "left")
    close = rows.filter("own < first or near < first").select("id")
    return again.unionByName(close).distinct()

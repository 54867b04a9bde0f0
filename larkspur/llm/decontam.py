"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are partitioned by their number of shingles; within a partition no item is more than
``GROWTH`` times as large as another. A document is looked at through windows twice as
long as the partition's largest item, at half their length apart, so that a passage of
that size lies whole within one. An item of which a share ``threshold`` lies in a window
then has a Jaccard similarity with it of at least about 0.3, whatever the document's
length, and the chance that none of ``PERMUTATIONS`` MinHash values agrees is below 1e-8.
An agreeing value names a shingle that the document must hold, so documents without any
of the items' MinHash shingles are passed over before windows are formed; this skips
nothing that could agree. Candidates are verified by the exact share of the item's
shingles that occur in the whole document.

The benchmark goes to the tasks in blocks of bounded size, with one pass over the
documents for each block; documents are never shuffled.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import rest_worker
from larkspur.llm.shingles import forget_words, mix, plain_words, shingle_set, shingles

WORDS, THRESHOLD = 5, 0.8
PERMUTATIONS, GROWTH = 64, 1.25

#: Most items and most bytes of item text in a block.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20

_SEEDS = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TABLE_BITS = 20

#: Tells the permutations apart where values of all of them stand in one sorted array.
_NAMES = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per permutation the smallest permuted hash, and the shingle that has it."""
    permuted = mix(hashes[None, :] ^ _SEEDS[:, None])
    at = permuted.argmin(axis=1)
    return permuted[np.arange(PERMUTATIONS), at], hashes[at]


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array that isn't empty."""
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


@dataclass
class Partition:
    """Items of about the same size: windows in shingles, the shingles that MinHash values name, and the sorted codes of (permutation, value) with the item of each."""

    window: int
    named: np.ndarray
    codes: np.ndarray
    items: np.ndarray

    def holders(self, values: np.ndarray) -> np.ndarray:
        """Items that have one of a window's MinHash values under the same permutation."""
        asked = values ^ _NAMES
        first, last = (np.searchsorted(self.codes, asked, side=side) for side in ("left", "right"))
        some = np.flatnonzero(last > first)
        return np.concatenate([np.zeros(0, np.int32), *(self.items[first[k] : last[k]] for k in some)])


class ItemIndex:
    """The items of a block, searched with ``matches``."""

    def __init__(self, items: list[tuple[int | None, str | None]], words: int = WORDS, threshold: float = THRESHOLD):
        self.words, self.threshold = words, threshold
        self.ids, self.sets, sized = [], [], defaultdict(list)
        for item_id, text in dict.fromkeys(items):
            found = shingle_set(plain_words(text or ""), words)
            if len(found):
                sized[math.ceil(math.log(len(found), GROWTH) - 1e-9)].append(len(self.ids))
                self.ids.append(item_id)
                self.sets.append(found)
        self.partitions = []
        for size in sorted(sized):
            codes, named = [], []
            for k in sized[size]:
                values, holders = signature(self.sets[k])
                named.append(holders)
                codes.append(values ^ _NAMES)
            codes, items = np.concatenate(codes), np.repeat(np.array(sized[size], np.int32), PERMUTATIONS)
            order = np.argsort(codes, kind="stable")
            largest = max(len(self.sets[k]) for k in sized[size])
            self.partitions.append(Partition(2 * largest, np.unique(np.concatenate(named)), codes[order], items[order]))
        self.named = np.unique(np.concatenate([np.zeros(0, np.uint64), *(p.named for p in self.partitions)]))
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.named >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def matches(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item id, item shingles in the text, item shingles) of every item that the text holds."""
        hashes = shingles(plain_words(text), self.words) if text and len(self.named) else np.zeros(0, np.uint64)
        if not len(hashes):
            return []
        hits = np.flatnonzero(self.table[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        if len(hits):
            hits = hits[among(hashes[hits], self.named)]
        if not len(hits):
            return []
        candidates: set[int] = set()
        for part in self.partitions:
            step = max(1, part.window // 2)
            # windows start at multiples of step; a hit lies in the window that starts at its step and in the one before
            own = hits[among(hashes[hits], part.named)] // step
            starts = np.unique(np.concatenate([own, np.maximum(own - 1, 0)])) * step
            for start in starts.tolist():
                values, _ = signature(hashes[start : start + part.window])
                candidates.update(part.holders(values).tolist())
        if not candidates:
            return []
        own = np.unique(hashes)
        out = []
        for k in sorted(candidates):
            item = self.sets[k]
            shared = int(among(item, own).sum())
            if shared >= self.threshold * len(item) - 1e-9:
                out.append((self.ids[k], shared, len(item)))
        return out


def item_blocks(benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD):
    """Indexes over blocks of the distinct items; each is bounded by BLOCK_ITEMS and BLOCK_BYTES in expectation."""
    rows = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct()
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(1, math.ceil(total["n"] / BLOCK_ITEMS), math.ceil(total["b"] / BLOCK_BYTES))
    for block in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield ItemIndex([(r["item_id"], r["text"]) for r in part.collect()], words, threshold)


def find_leaks(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, n_shared, n_item, containment.

    Words are runs of letters, digits and underscores in lower case. A text of fewer than
    ``words`` words is one shingle, the whole sequence. Null and empty texts and items
    hold nothing and lie in nothing; repeated documents repeat their rows, repeated items
    do not; a clashing or further column is not read.
    """
    spark, out = docs.sparkSession, None
    kind = docs.schema["doc_id"].dataType.simpleString()
    for index in item_blocks(benchmark, words, threshold):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0), batch.column(1), strict=True) for m in shared.value.matches(t.as_py())]
                if rows:
                    names, items, n, of = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in names], batch.column(0).type), pa.array(items, pa.int64()), pa.array(n, pa.int64()), pa.array(of, pa.int64())], ["doc_id", "item_id", "n_shared", "n_item"])
            forget_words()
            rest_worker()

        found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id long, n_shared long, n_item long")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay, whatever their names.

    Null and empty texts and items hold nothing; repeated rows are judged alike; without items all rows stay.
    """
    spark = docs.sparkSession
    for index in item_blocks(benchmark, words, threshold):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                at = batch.schema.get_field_index("text")
                clean = pa.array([not shared.value.matches(t.as_py()) for t in batch.column(at)], pa.bool_())
                yield batch.filter(clean)
            forget_words()
            rest_worker()

        docs = docs.mapInArrow(run, docs.schema)
    return docs

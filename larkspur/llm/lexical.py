"""Ranked lexical search: a blocked sparse matrix product of items by terms and terms by documents.

The documents become a sparse matrix, a row per document with the terms that some item
asks for, the number of occurrences and the document's length; it is written once.
After the corpus' statistics are summed up, a task takes its rows in blocks: occurrences turn
into int64 impacts, the block is transposed to a row per term, and each item's row of the product is
found by Gustavson's method, adding up the rows of its terms (a document occurs once in each, so
numpy adds whole rows). Of each block an item's best documents are merged with the best so far,
so that a task emits no more than that many for an item, and a last reduction ranks them.

Items go to the tasks in blocks of bounded size, with a pass over the documents for each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import discard, rest_worker, written

#: Fixed values of the ranking: runs of letters, digits and characters beyond ASCII, for Java and over UTF-8.
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = re.compile(PATTERN.encode())
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Most pairs of item and term in a block of items; documents and cells in a block of the matrix.
BLOCK_TERMS, BLOCK_DOCS, BLOCK_CELLS = 1_000_000, 8192, 2_000_000


@dataclass(frozen=True)
class Asked:
    """A block of items: their ids, the terms' numbers, and the numbers of each item's terms in sparse rows."""

    items: list
    numbers: dict[bytes, int]
    first: np.ndarray
    terms: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Asked:
        by_item: dict = {}
        for item, term in rows:
            by_item.setdefault(item, []).append(term.encode())
        numbers = {t: i for i, t in enumerate(sorted({t for of in by_item.values() for t in of}))}
        own = [sorted(numbers[t] for t in of) for of in by_item.values()]
        return cls(list(by_item), numbers, np.cumsum([0, *map(len, own)]), np.concatenate([np.zeros(0, np.int64), *map(np.array, own)]).astype(np.int64))


def asked_blocks(items: DataFrame) -> Iterator[Asked]:
    """The distinct terms of the items, in blocks of about BLOCK_TERMS pairs; an item's terms lie in one block."""
    lowered = F.translate(F.col("text"), CAPITALS, SMALL)
    rows = items.where("text IS NOT NULL").select(F.col("item_id").cast("long"), F.explode(F.regexp_extract_all(lowered, F.lit(PATTERN), F.lit(0))).alias("term")).distinct()
    rows = written(rows, "asked")
    blocks = max(1, math.ceil(rows.count() / BLOCK_TERMS))
    for block in range(blocks):
        yield Asked.of([tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()])
    discard(rows)


def occurrences(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """A sparse row for each document with a term: doc_id, its length n, the numbers of asked terms and how often each occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches):
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, sizes, terms, times = [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()), strict=True):
                    words = TERM.findall(text.as_py().lower())  # of bytes: A to Z only
                    if words:
                        counts = Counter(words)
                        own = sorted((known[w], counts[w]) for w in counts.keys() & known.keys())
                        ids.append(doc_id)
                        sizes.append(len(words))
                        terms.append([t for t, _ in own])
                        times.append([n for _, n in own])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "times"])
        rest_worker()

    return docs.select(F.col("doc_id").cast("long"), "text").where("text IS NOT NULL").mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>")


def weight(n_docs: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * docs + 1)))


def impacts(weights: np.ndarray, times: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence count gives in a document of a size, as int64."""
    m = 10 + 90 * sizes * n_docs // n_terms
    return weights * (1_000_000_000 * times // (1000 * times + 8 * m))


@dataclass
class Best:
    """The best documents of an item so far: scores, whether the id is missing, ids; in ranked order."""

    scores: np.ndarray
    missing: np.ndarray
    ids: np.ndarray

    def merged(self, scores: np.ndarray, missing: np.ndarray, ids: np.ndarray, k: int) -> Best:
        scores, missing, ids = (np.concatenate(x) for x in ((self.scores, scores), (self.missing, missing), (self.ids, ids)))
        order = np.lexsort((ids, missing, -scores))[:k]
        return Best(scores[order], missing[order], ids[order])


def add_block(best: list[Best], asked: Asked, rows: pa.Table, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> None:
    """Multiply the items with one block of documents and keep the best k of either."""
    ids, sizes = rows.column("doc_id").combine_chunks(), rows.column("n").to_numpy()
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy()
    lists = rows.column("terms").combine_chunks()
    document = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
    term, times = lists.flatten().to_numpy(), rows.column("times").combine_chunks().flatten().to_numpy()
    value = impacts(weights[term], times, sizes[document], n_docs, n_terms)
    order = np.argsort(term, kind="stable")
    document, value = document[order], value[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(weights)))])
    for i, held in enumerate(best):
        total = np.zeros(len(ids), np.int64)
        for t in asked.terms[asked.first[i] : asked.first[i + 1]].tolist():
            own = slice(start[t], start[t + 1])
            total[document[own]] += value[own]
        least = max(1, int(held.scores[-1]) if len(held.scores) == k else 1)
        some = np.flatnonzero(total >= least)
        if len(some) > k:  # all that reach the k-th highest score, ties included
            some = some[total[some] >= np.partition(total[some], len(some) - k)[len(some) - k]]
        if len(some):
            best[i] = held.merged(total[some], missing[some], ids[some], k)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k highest-scoring documents of each item: item_id, rank, doc_id, score.

    Equal scores go by doc_id, rows without one last; items without a positive score anywhere
    have no rows. Null and empty texts have no terms and are no documents; very long texts count whole. Repeated
    documents are documents each; rows of items with the same item_id are one item with the terms
    of all, so repeated items change nothing. An empty table gives no rows; further
    columns, whatever their names, are not read.
    """
    spark, out = docs.sparkSession, None
    for asked in asked_blocks(items):
        matrix = written(occurrences(docs, asked.numbers), "matrix")
        size = matrix.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
        weights = np.zeros(len(asked.numbers), np.int64)
        for r in matrix.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most a row for each term of the block
            weights[r["term"]] = weight(size["n_docs"], r["count"])
        shared = spark.sparkContext.broadcast((asked, weights))

        def multiply(batches, shared=shared, n_docs=size["n_docs"], n_terms=size["n_terms"]):
            asked, weights = shared.value
            nothing = np.zeros(0, np.int64)
            best, held, cells = [Best(nothing, nothing.astype(bool), nothing) for _ in asked.items], [], 0
            for batch in batches:
                at = 0
                ends = batch.column(2).offsets.to_numpy()
                while at < batch.num_rows:
                    room = int(np.searchsorted(ends, ends[at] + BLOCK_CELLS - cells))
                    to = min(max(at + 1, room), at + BLOCK_DOCS - sum(x.num_rows for x in held), batch.num_rows)
                    held.append(batch.slice(at, to - at))
                    cells += int(ends[to] - ends[at])
                    at = to
                    if cells >= BLOCK_CELLS or sum(x.num_rows for x in held) >= BLOCK_DOCS:
                        add_block(best, asked, pa.Table.from_batches(held), weights, n_docs, n_terms, k)
                        held, cells = [], 0
            if held:
                add_block(best, asked, pa.Table.from_batches(held), weights, n_docs, n_terms, k)
            for item, of in zip(asked.items, best, strict=True):
                if len(of.ids):
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(of.ids), pa.int64()), pa.array(of.ids, mask=of.missing), pa.array(of.scores)], ["item_id", "doc_id", "score"])
            rest_worker()

        found = matrix.mapInArrow(multiply, "item_id long, doc_id long, score long")
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

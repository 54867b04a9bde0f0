"""Source divergence audit: how far each source's use of words lies from the other sources and from its language.

Terms are counted inside the tasks, in tables of bounded size, so that a shuffle gets
one row per table, group and term, however often a term or a source occurs. Each kept
term then has a sparse vector of its counts by source. Terms with the same vector add the
same amount to the distance of every pair of sources, so a distinct vector is
evaluated once for every pair and its amounts are multiplied by the number of its terms.
Vectors lie anywhere; a task adds what its vectors give in square tiles of sources and
emits sums, which are added up by pair.

Shares are parts of a thousand million, found by long division in three steps of three
digits, so 64-bit integers hold every step exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import rest_worker, written

#: A language keeps the terms of at least so many of its documents; added to every count; term ranks that are reported.
LEAST_DOCUMENTS, SMOOTHING, TERM_RANKS = 30, 5, 50

#: Runs of ASCII letters and of characters beyond ASCII, over UTF-8.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")

#: Terms that a task's tables hold before they are emitted; rows looked at between two looks at their size.
HELD_TERMS, SLICE_ROWS = 500_000, 64

#: Sources along a tile, tiles that a task keeps, vectors that are evaluated at once.
TILE, KEPT_TILES, VECTORS = 1024, 16, 2048

#: (lang, source) groups up to which their totals are sent to every task: about 30 MB. Beyond it the pairs alone would be 10**10 rows.
MOST_GROUPS = 200_000


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term), summed up over as many rows as a bounded table holds."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def emit():
        for (lang, source), (n, docs) in held.items():
            words = list(n)
            same = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(len(words), np.int32)))
            yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[w] for w in words], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()), strict=True):
                words = TERM.findall(text.as_py().lower())  # of bytes: A to Z only
                if words:
                    n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                    n.update(words)
                    docs.update(set(words))
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from emit()
    yield from emit()
    rest_worker()


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * count / total), for count <= total."""
    found, rest = np.divmod(count, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        found = found * 1000 + digits
    return found + 1


def share_column(count: Column, total: Column) -> Column:
    """``share`` as a column expression."""
    found, rest = F.call_function("div", count, total), count % total
    for _ in range(3):
        found, rest = found * 1000 + F.call_function("div", rest * 1000, total), rest * 1000 % total
    return found + 1


class PairSums:
    """Sums of |p - q| over vectors for the pairs of sources of one language, in tiles."""

    def __init__(self, groups: dict[str, tuple[list[str], np.ndarray]]):
        self.groups, self.tiles = groups, {}

    def add(self, lang: str, vectors: pa.ListArray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        sources, totals = self.groups[lang]
        cells, lengths = vectors.flatten(), np.diff(vectors.offsets.to_numpy())
        row = np.repeat(np.arange(len(lengths)), lengths)
        column = pc.index_in(cells.field("source"), pa.array(sources, pa.string())).to_numpy()
        counts = np.zeros((len(lengths), len(sources)), np.int64)
        counts[row, column] = cells.field("n").to_numpy()
        shares = share(counts + SMOOTHING, totals[None, :])
        blocks = range(0, len(sources), TILE)
        for a in blocks:
            for b in (b for b in blocks if b >= a):
                if (lang, a, b) not in self.tiles:
                    if len(self.tiles) == KEPT_TILES:
                        yield from self.emit(next(iter(self.tiles)))
                    self.tiles[lang, a, b] = np.zeros((len(sources[a : a + TILE]), len(sources[b : b + TILE])), np.int64)
                tile, right = self.tiles[lang, a, b], shares[:, b : b + TILE]
                for i in range(len(tile)):
                    tile[i] += times @ np.abs(right - shares[:, a + i : a + i + 1])

    def emit(self, key: tuple) -> Iterator[pa.RecordBatch]:
        lang, a, b = key
        tile, names = self.tiles.pop(key), pa.array(self.groups[lang][0], pa.string())
        for i in range(len(tile)):
            others = np.arange(max(b, a + i + 1), b + tile.shape[1])
            if len(others):
                same = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(len(others), np.int32)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(lang), same(self.groups[lang][0][a + i]), names.take(pa.array(others)), pa.array(tile[i, others - b])], ["lang", "source", "item", "value"])


def kept_vectors(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Per kept term: lang, term, and its vector of (source, n) in the order of sources, zeros left out."""
    counted = docs.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    by_source = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return found.where(F.col("docs") >= least).select("lang", "term", "vector")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS) -> DataFrame:
    """Per group of lang and source: its distance to every other source of the lang, and the terms it uses more than the lang.

    Columns lang, source, part, item, value, rank: part ``pair`` has an item for each other
    source, part ``term`` the ``ranks`` terms that lie furthest above the language's share.
    Null text, lang and source count as ''. Repeated rows count as often as they occur; very
    long texts count whole. A group without terms and a language that keeps none have their
    pairs (value 0 in the latter) and no terms; ties go by the item's bytes. No rows give no
    rows; further columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = written(kept_vectors(plain, least), "vectors")
    sums = kept.select("lang", F.explode("vector").alias("v")).groupBy("lang", "v.source").agg(F.sum("v.n").alias("total"))
    groups = plain.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left")
    groups = written(groups.na.fill(0, ["total", "terms"]), "groups")
    rows = groups.limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups of lang and source: join sources to larger ones first, all pairs of them are asked for")
    by_lang: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["source"].encode())):
        by_lang.setdefault(r["lang"], []).append(r)
    shared = spark.sparkContext.broadcast({lang: ([r["source"] for r in of], np.array([r["total"] + SMOOTHING * r["terms"] for r in of], np.int64)) for lang, of in by_lang.items()})

    def evaluate(batches):
        found = PairSums(shared.value)
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            for code, lang in enumerate(codes.dictionary.to_pylist()):
                of = pa.RecordBatch.from_arrays(batch.columns, schema=batch.schema).filter(pc.equal(codes.indices, code))
                for at in range(0, of.num_rows, VECTORS):
                    part = of.take(pa.array(np.arange(at, min(at + VECTORS, of.num_rows))))
                    yield from found.add(lang, part.column(1), part.column(2).to_numpy())
        for key in list(found.tiles):
            yield from found.emit(key)
        rest_worker()

    distinct = kept.groupBy("lang", "vector").agg(F.count("*").alias("times"))
    half = distinct.mapInArrow(evaluate, "lang string, source string, item string, value long")
    named = groups.select("lang", "source")
    every = named.join(named.withColumnRenamed("source", "item"), "lang").where(F.col("source") < F.col("item")).select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    half = half.union(every).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = half.union(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))

    own = F.broadcast(groups.select("lang", "source", (F.col("total") + SMOOTHING * F.col("terms")).alias("of_source")))
    whole = F.broadcast(groups.groupBy("lang").agg((F.sum("total") + SMOOTHING * F.first("terms")).alias("of_lang")))
    counts = kept.select("lang", F.col("term").alias("item"), F.aggregate("vector", F.lit(0).cast("long"), lambda t, v: t + v["n"]).alias("n_lang"), F.explode("vector").alias("v"))
    counts = counts.select("lang", "item", "n_lang", "v.source", "v.n").join(own, ["lang", "source"]).join(whole, "lang")
    value = share_column(F.col("n") + SMOOTHING, F.col("of_source")) - share_column(F.col("n_lang") + SMOOTHING, F.col("of_lang"))
    terms = counts.select("lang", "source", "item", value.alias("value")).where("value > 0")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).union(terms.select(columns))

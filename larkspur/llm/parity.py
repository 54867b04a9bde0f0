"""N-gram Jaccard join by parity sketches.

A document's set of word shingles is XOR-hashed: each shingle picks a segment of a bit
sketch by its hash and flips one bit there. Shingles that two sets share flip the same
bits, so the sketches' Hamming distance is at most the size of the symmetric difference,
and so is the number of segments that differ. Sets with |A & B| / |A | B| >= p/q differ in at
most (q - p) (|A| + |B|) / (q + p) shingles. Sets are put in size bands; a band cuts
sketches in k segments, k above its largest difference d, so linked sets agree in at least
k - d whole segments (pigeonhole). Segments have 2**64 positions, held as the XOR of a
64-bit code per odd position, so unlike segments hardly ever agree by chance. A set enters
the band of its size and those in which a linked larger set can lie.

Of the k codes a set emits only the first d' + 1 in one order of all codes, d' being the
largest difference that a set of its size can have from a linked one of that band: sets of k
codes that agree in k - d' of them agree in one of the first d' + 1 of either. Codes of empty
segments come last in that order, so that sets of unlike texts do not meet in them.

Sets that are equal are one class before the join. A bucket of equal segments first holds
its members against two leads, the member of most buckets and a drawn one; links with the
nearest leads (by sketch) are verified and components formed. Pairs of a bucket that
are in different components after that are then looked at one by one, and only those whose
sketches allow a link leave the join. Two members of a component need no check, so no link
between components is lost.

Pairs pass a folded sketch of 512 bits first, in the join, and then, each pair once, a wide one of
two to four bits a shingle: either's Hamming distance bounds the difference, too. What is
left is verified by the exact sizes of intersection and union of both shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import discard, free_shuffles, fresh_names, rest_worker, written
from larkspur.llm.graph import components
from larkspur.llm.shingles import ascii_words, forget_words, mix, shingle_set

#: Ratio of the bounds of a size band, and segments of a band for each shingle that linked sets of it may differ in.
BAND_GROWTH, SEGMENTS = 2.0, 1.25

#: 64-bit words of the folded sketch.
FOLD = 8

#: Most ids of documents that are broadcast, 16 MB of them.
BROADCAST_IDS = 1_000_000

#: Rounds of leads (a second one was measured to link next to nothing more), and the nearest leads that a member is held against in each.
LEAD_ROUNDS, NEAREST = 1, 2


@dataclass(frozen=True)
class Band:
    """Sets of up to ``most`` shingles, cut in ``segments``."""

    most: int
    segments: int


@dataclass(frozen=True)
class Join:
    """Shingle length in words and the threshold p/q."""

    words: int = 5
    p: int = 4
    q: int = 5

    @cached_property
    def starts(self) -> list[int]:
        out = [1]
        while out[-1] < 1 << 40:
            out.append(max(out[-1] + 1, math.floor(out[-1] * BAND_GROWTH)))
        return out

    def apart(self, n: int, m: int) -> int:
        """Most shingles in which linked sets of these sizes can differ."""
        return (self.q - self.p) * (n + m) // (self.q + self.p)

    @cached_property
    def bands(self) -> list[Band]:
        mosts = [start - 1 for start in self.starts[1:]]
        return [Band(most, math.ceil(SEGMENTS * (self.apart(most, most) + 1))) for most in mosts]

    def bands_of(self, size: int) -> range:
        """The band of a set's size, and those up to the one of the largest set that can be linked."""
        own, last = (int(np.searchsorted(self.starts, x, side="right")) - 1 for x in (size, self.q * size // self.p))
        return range(own, last + 1)

    def keys(self, found: np.ndarray) -> np.ndarray:
        """Codes of the segments that a sorted set emits; none where linked sets are equal sets."""
        out, n = [np.zeros(0, np.uint64)], len(found)
        codes = mix(found ^ np.uint64(0x5851F42D4C957F2D))
        for i in self.bands_of(n) if n else ():
            band = self.bands[i]
            apart = self.apart(n, min(band.most, self.q * n // self.p))
            if not apart:
                continue
            place = ((found >> np.uint64(32)) * np.uint64(band.segments)) >> np.uint64(32)  # ascending, as the set is
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            name = lambda own, i=i: mix(own + np.uint64(i << 40))
            own = place[first]
            emitted = np.sort(mix(np.bitwise_xor.reduceat(codes, first) ^ name(own)))[: apart + 1]
            if len(emitted) <= apart:
                none = np.sort(mix(name(np.setdiff1d(np.arange(band.segments, dtype=np.uint64), own))))
                emitted = np.concatenate([emitted, none[: apart + 1 - len(emitted)]])
            out.append(emitted)
        return np.concatenate(out)

    def far(self, n: Column, m: Column) -> Column:
        """``apart`` of two columns."""
        return F.floor((n + m) * (self.q - self.p) / (self.q + self.p))


def fold(found: np.ndarray) -> np.ndarray:
    """A parity sketch of 64 * FOLD bits."""
    bits = np.bincount((found % np.uint64(64 * FOLD)).astype(np.int64), minlength=64 * FOLD) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def wide(found: np.ndarray) -> np.ndarray:
    """A parity sketch of two to four bits a shingle, 64 * FOLD at least; a power of two, so that a longer one can be folded to a shorter one."""
    size = max(64 * FOLD, 1 << (2 * len(found) - 1).bit_length()) if len(found) else 64 * FOLD
    bits = np.bincount((found % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def hamming(a: np.ndarray, b: np.ndarray) -> int:
    """Distance of two wide sketches, the longer one folded to the length of the other."""
    short = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, short), axis=0) for x in (a, b))
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())


def _sketches(docs: DataFrame, join: Join) -> DataFrame:
    """Of each row with a doc_id: doc_id, row (a number of its own), n, two keys of its set, folded and wide sketch and segment codes."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, pairs, folds, wides, keys = [], [], [], [], []
                for text in part.column(2):
                    found = shingle_set(ascii_words(text.as_py() or ""), join.words)
                    sizes.append(len(found))
                    pairs.append(_keys_of(found))
                    folds.append(fold(found))
                    wides.append(wide(found))
                    keys.append(join.keys(found).view(np.int64))
                two = np.array(pairs, np.int64)
                listed = lambda parts: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(k) for k in parts])]).astype(np.int32)), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]),
                        *map(listed, (folds, wides, keys)),
                    ],
                    ["doc_id", "row", "n", "k1", "k2", "fold", "wide", "keys"],
                )
        forget_words()
        rest_worker()

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").where("doc_id IS NOT NULL")
    return numbered.mapInArrow(run, f"doc_id {kind}, row long, n long, k1 long, k2 long, fold array<long>, wide array<long>, keys array<long>")


def _may_link(join: Join) -> Column:
    """Whether sizes and folded sketches of a row's two sides allow a link."""
    sizes = F.least("a_n", "b_n") * join.q >= F.greatest("a_n", "b_n") * join.p
    return sizes & (_apart() <= join.far(F.col("a_n"), F.col("b_n")))


def _apart() -> Column:
    """Hamming distance of the folded sketches of a row's two sides."""
    return sum((F.bit_count(F.get("a_fold", F.lit(i)).bitwiseXOR(F.get("b_fold", F.lit(i)))) for i in range(FOLD)), F.lit(0))


def _close(pairs: DataFrame, held: DataFrame, join: Join) -> DataFrame:
    """Pairs (a, b) of nodes whose wide sketches allow a link, with their distance d."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            flat = [c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns[4:]]
            ends = [np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))]) for c in batch.columns[4:]]
            a, b, n, m = (c.to_numpy() for c in batch.columns[:4])
            for i in range(batch.num_rows):
                d = hamming(*(x[e[i] : e[i + 1]] for x, e in zip(flat, ends, strict=True)))
                if d <= join.apart(int(n[i]), int(m[i])):
                    kept.append((a[i], b[i], d))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept, strict=True)], ["a", "b", "d"])
        rest_worker()

    side = lambda x: held.select(F.col("node").alias(f"_{x}"), F.col("n").alias(f"{x}_n"), F.col("wide").alias(f"{x}_wide"))
    both = pairs.select("a", "b").distinct().join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    return both.select("a", "b", "a_n", "b_n", "a_wide", "b_wide").mapInArrow(run, "a long, b long, d long")


def _sets(docs: DataFrame, join: Join) -> DataFrame:
    """doc_id, two keys and the shingle set of each row."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(ascii_words(text.as_py() or ""), join.words) for text in part.column(1)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                keys = np.array([_keys_of(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))],
                    ["doc_id", "k1", "k2", "set"],
                )
        forget_words()
        rest_worker()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, set array<long>")


def _keys_of(found: np.ndarray) -> tuple[int, int]:
    """Two keys of a set, 128 bits; sets that agree in them and in size are taken as equal."""
    if not len(found):
        return 0, 0
    return int(np.array(mix(found).sum(dtype=np.uint64)).view(np.int64)), int(np.array(np.bitwise_xor.reduce(found)).view(np.int64))


def _verified(pairs: DataFrame, held: DataFrame, docs: DataFrame, join: Join) -> DataFrame:
    """Links (a, b) between doc_ids among pairs (a, b) of nodes, by the exact shingle sets; written."""
    pairs = written(pairs, "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("_node")).distinct()
    asked = written(held.join(asked, F.col("node") == F.col("_node"), "left_semi").select("node", "doc_id", "k1", "k2"), "asked")
    ids = asked.select(F.col("doc_id").alias("_id")).distinct()
    ids = F.broadcast(ids) if asked.count() <= BROADCAST_IDS else ids
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id"), "left_semi")
    found = _sets(texts, join).select(F.col("doc_id").alias("_id"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "set")
    same = (F.col("doc_id") == F.col("_id")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
    sets = written(asked.join(found, same).select("node", "doc_id", "set").dropDuplicates(["node"]), "sets")
    side = lambda x: sets.select(F.col("node").alias(f"_{x}"), F.col("doc_id").alias(f"{x}_doc"), F.col("set").alias(f"{x}_set"))
    both = pairs.join(side("b"), F.col("b") == F.col("_b")).join(side("a"), F.col("a") == F.col("_a"))
    shared = F.size(F.array_intersect("a_set", "b_set"))
    linked = shared * join.q >= (F.size("a_set") + F.size("b_set") - shared) * join.p
    links = written(both.where(linked).select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b")), "links")
    discard(pairs, asked, sets)
    return links


def _members(nodes: DataFrame) -> DataFrame:
    """key and node of every bucket of several nodes, buckets with the same nodes once; written."""
    # codes are shuffled once: the counts and the join with the chosen keys read the same exchange, if both see the same rows
    pieces = nodes.select("node", F.explode("keys").alias("key")).where("key IS NOT NULL").repartition("key")
    counts = pieces.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x")).where("c > 1")
    chosen = counts.groupBy("lo", "hi", "c", "x").agg(F.min("key").alias("_key")).select("_key")
    return written(pieces.join(chosen, F.col("key") == F.col("_key")).select("key", "node"), "members")


def _open(rest: DataFrame, links: DataFrame | None) -> DataFrame:
    """``rest`` with component, without buckets all of whose members are in one component; written."""
    if links is None:
        labelled = rest.withColumn("component", F.col("doc_id"))
    else:
        labels = written(components(links).withColumnRenamed("node", "_doc"), "labels")
        labelled = rest.join(labels, F.col("doc_id") == F.col("_doc"), "left").withColumn("component", F.coalesce("component", "doc_id")).drop("_doc")
    several = labelled.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select(F.col("key").alias("_key"))
    return written(labelled.join(several, F.col("key") == F.col("_key")).drop("_key"), "open")


def _linked(nodes: DataFrame, docs: DataFrame, join: Join, spent: DataFrame) -> DataFrame:
    """Links (a, b) between the doc_ids of classes that join the same classes as all links do; ``spent`` is discarded once ``nodes`` has been read."""
    members = _members(nodes)
    degrees = members.groupBy(F.col("node").alias("_node")).agg(F.count("*").alias("degree"))
    held = written(nodes.select("node", "doc_id", "n", "k1", "k2", "fold", "wide").join(degrees, F.col("node") == F.col("_node")).drop("_node"), "nodes")
    rest = written(members.join(held.select(F.col("node").alias("_node"), "doc_id", "n", "fold", "degree"), F.col("node") == F.col("_node")).drop("_node"), "rest")
    discard(members, spent)
    free_shuffles(nodes.sparkSession)
    links = None
    for turn in range(LEAD_ROUNDS):
        rest, old = _open(rest, links), rest
        discard(old)
        draw = F.xxhash64("node", F.lit(turn))
        busiest = F.shiftleft("degree", 40) + F.shiftrightunsigned(draw, 24)
        leads = rest.groupBy("key").agg(F.max_by("node", busiest).alias("l1"), F.min_by("node", draw).alias("l2")).select(F.col("key").alias("a_key"), F.explode(F.array_distinct(F.array("l1", "l2"))).alias("a"))
        leads = written(leads.join(rest.select(F.col("key").alias("_key"), F.col("node").alias("_node"), *[F.col(c).alias(f"a_{c}") for c in ("component", "n", "fold")]), (F.col("a") == F.col("_node")) & (F.col("a_key") == F.col("_key"))).drop("_key", "_node"), "leads")
        side = rest.select(F.col("node").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("key", "component", "n", "fold")])
        met = side.join(leads, (F.col("a_key") == F.col("b_key")) & (F.col("a_component") != F.col("b_component")) & _may_link(join))
        near = _close(met, held, join).withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("d", "a"))).where(F.col("r") <= NEAREST).select("a", "b")
        more = _verified(near, held, docs, join)
        links = more if links is None else links.unionByName(more)
        rest, old = rest.drop("component"), rest
        rest.scratch_path = old.scratch_path
        discard(leads)
    rest, old = _open(rest, links), rest
    discard(old)
    left, right = (rest.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("key", "component", "n", "fold")]) for x in "ab")
    across = (F.col("a_key") == F.col("b_key")) & (F.col("a") < F.col("b")) & (F.col("a_component") != F.col("b_component"))
    last = _verified(_close(left.join(right, across & _may_link(join)), held, join).select("a", "b"), held, docs, join)
    discard(rest, held)
    return last if links is None else links.unionByName(last)


def near_duplicates(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row.

    Words are what stands between ASCII white space, A-Z in lower case; fewer words than a
    shingle are one shingle. Null and empty texts have no set and link with nothing, and
    a row without a doc_id has a null component. Rows with the same doc_id are one
    document with several sets. Other columns are not read.
    """
    sketches = written(_sketches(docs, join), "sketches")
    sizes = written(sketches.select("doc_id", "row", "n", "k1", "k2"), "sizes")
    some = sizes.where("n > 0")
    classes = written(some.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "row")).alias("lead")).select("k1", "k2", "n", F.col("lead.doc_id").alias("rep"), F.col("lead.row").alias("lead")), "classes")
    own = sketches.where(F.size("keys") > 0)
    leads = classes.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "lead")
    # every row but one of its class, repeats of the representative too, so that a node is one row; they are few, or else the join is by shuffle
    behind = written(some.select("row", "k1", "k2").join(leads, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))).where("row != lead").select(F.col("row").alias("_row")), "behind")
    nodes = own.join(behind, F.col("row") == F.col("_row"), "left_anti")
    nodes = nodes.withColumnRenamed("row", "node")
    links = written(_linked(nodes, docs, join, sketches), "all-links")
    rows = some.select("doc_id", "n", "k1", "k2").join(classes.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "rep"), (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))
    several = rows.where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # a doc_id with several sets ties their classes together; with one set it only follows its class
    twice = rows.groupBy("doc_id").agg(F.min("rep").alias("r0"), F.max("rep").alias("r1")).where("r0 < r1").select(F.col("doc_id").alias("_twice"))
    ties = several.join(twice, F.col("a") == F.col("_twice"), "left_semi")
    labels = components(links.unionByName(ties)).withColumnRenamed("node", "_node")
    joined = rows.join(labels, F.col("rep") == F.col("_node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    none = sizes.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(none).unionByName(_without_id(docs, join))


def _without_id(docs: DataFrame, join: Join) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(shingle_set(ascii_words(t.as_py() or ""), join.words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), batch.column(0)], ["doc_id", "n_shingles", "component_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").where("doc_id IS NULL").mapInArrow(run, f"doc_id {kind}, n_shingles long, component_id {kind}")


def keep_one_each(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """``docs`` with one document of each group of linked ones: that with the smallest doc_id; all columns stay.

    Rows without a doc_id and rows whose text is null or has no words stay; rows with the same
    doc_id stay or go together. Columns may have any names; an empty table gives an empty one.
    """
    (gone,) = fresh_names(docs, "gone")
    go = near_duplicates(docs.where("doc_id IS NOT NULL"), join).where("doc_id != component_id").select(F.col("doc_id").alias(gone))
    return docs.join(go, F.col("doc_id") == F.col(gone), "left_anti")

"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors of cosine >= t have a squared distance of at most 2 - 2t. Vectors are rotated to the
principal axes of a bounded sample, and the axes dealt round-robin to blocks, so that
each block has one of the leading axes. A block's budget is its share of the sample's
variance times 2 - 2t; since the budgets add up to the whole, every linked pair is within
budget in at least one block. Each block is range-joined on all of its axes; pairs within
budget in some block are verified by the exact cosine of the original numbers.

A label is cut into tiles of bounded size by a hash; a task range-joins all blocks of two
tiles, so a pair is looked at once however many blocks it is near in, and a label of any
share spreads over tasks. (Dealing vectors into strips or cells along a block's axes was
measured to be worse: a radius is about as large as the spread of an axis, so that cells of a block's
radius and their neighbours hold most of a label, once for each block.) A task sends back a
number of links per vector and one local root per linked vector, never pairs. Equal vectors
are one class with a multiplicity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import rest_worker, written
from larkspur.llm.graph import components

#: Axes of a block, rows of the sample that the rotation is fitted on, and numbers in a tile (8,192 vectors of 64).
BLOCK_AXES, SAMPLE_ROWS, TILE_NUMBERS = 8, 4_000, 1 << 19

#: Rows of a tile whose distances are held at once, and candidates whose vectors are.
STEP, CHECKED = 256, 1 << 15

#: Room for the rounding of block distances (single precision) and of budgets.
ROUNDING, SLACK = 1e-5, 1e-9


@dataclass(frozen=True)
class Rotation:
    """Axes of each block as columns, and each block's budget of squared distance."""

    axes: np.ndarray
    blocks: list[slice]
    budgets: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, threshold: float) -> Rotation:
        """From a sample of unit vectors (rows), which may be empty; equal shares where it shows no variance."""
        size = sample.shape[1]
        if not len(sample):
            sample = np.eye(size)
        values, vectors = np.linalg.eigh(sample.T @ sample / max(1, len(sample)) - np.outer(sample.mean(0), sample.mean(0)))
        order = np.argsort(-values, kind="stable")
        count = max(1, -(-size // BLOCK_AXES))
        dealt = np.concatenate([order[b::count] for b in range(count)])
        ends = np.cumsum([0, *(len(order[b::count]) for b in range(count))])
        blocks = [slice(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        spread = np.maximum(values[dealt], 0) + max(values.max(), 0) * 1e-3 + 1e-12
        shares = np.array([spread[b].sum() for b in blocks])
        return cls(vectors[:, dealt], blocks, shares / shares.sum() * (2 - 2 * threshold + SLACK))


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def rotations(classes: DataFrame, threshold: float) -> dict[int, Rotation]:
    """Rotations by vector length, from about SAMPLE_ROWS rows of all lengths, chosen by a hash of the vector; a length may have none."""
    share = min(1.0, SAMPLE_ROWS / max(1, classes.count()))
    drawn = F.shiftrightunsigned(F.xxhash64("embedding", F.lit(5)), 11).cast("double") / float(1 << 53)
    held: dict[int, list] = {}
    for row in classes.where(drawn < share).select("size", "embedding").orderBy("size", "rep").toLocalIterator():
        held.setdefault(row["size"], []).append(row["embedding"])
    return {size: Rotation.fit(_units(np.array(rows, np.float64)), threshold) for size, rows in held.items()}


def _candidates(x: np.ndarray, y: np.ndarray, squares: list[np.ndarray], rotation: Rotation) -> np.ndarray:
    """Which pairs of rows of x and y are within budget in some block."""
    out = np.zeros((len(x), len(y)), bool)
    for block, budget, square in zip(rotation.blocks, rotation.budgets, squares, strict=True):
        a = x[:, block]
        out |= (a @ y[:, block].T) * np.float32(2) >= (a * a).sum(1)[:, None] + (square - np.float32(budget + ROUNDING))
    return out


def _roots(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The smallest of 0 to size - 1 that each of them reaches by the edges (a, b)."""
    root = np.arange(size)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _tile_links(tiles: list[pa.Table], rotation: Rotation, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, links found here, local root) of the vectors with links within one tile, or between two."""
    ids = [t.column("rep").to_numpy() for t in tiles]
    weights = [t.column("m").to_numpy() for t in tiles]
    raw = [_matrix(t.column("embedding").combine_chunks()) if t.num_rows else np.zeros((0, len(rotation.axes))) for t in tiles]
    norms = [np.linalg.norm(x, axis=1) for x in raw]
    turned = [((x / n[:, None]) @ rotation.axes).astype(np.float32) for x, n in zip(raw, norms, strict=True)]
    last, shift = len(tiles) - 1, len(ids[0]) if len(tiles) > 1 else 0
    names = np.concatenate(ids)
    links, edges = np.zeros(len(names), np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))
    squares = [(turned[last][:, b] ** 2).sum(1) for b in rotation.blocks]
    for at in range(0, len(ids[0]), STEP):
        i, j = np.nonzero(_candidates(turned[0][at : at + STEP], turned[last], squares, rotation))
        i += at
        if not last:  # within one tile each pair once
            i, j = i[i < j], j[i < j]
        found = []
        for k in range(0, len(i), CHECKED):
            s, t = i[k : k + CHECKED], j[k : k + CHECKED]
            linked = (raw[0][s] * raw[last][t]).sum(1) / (norms[0][s] * norms[last][t]) >= threshold
            linked &= ids[0][s] != ids[last][t]  # several vectors of one id are no link
            found.append((s[linked], t[linked] + shift))
        if found:
            a, b = map(np.concatenate, zip(*found, strict=True))
            np.add.at(links, a, weights[last][b - shift])
            np.add.at(links, b, weights[0][a])
            root = _roots(np.concatenate([edges[0], a]), np.concatenate([edges[1], b]), len(names))
            edges = np.flatnonzero(root != np.arange(len(root))), root[root != np.arange(len(root))]
    root = _roots(*edges, len(names))
    some = np.flatnonzero(links)
    return names[some], links[some], names[root[some]]


def link_counts(classes: DataFrame, threshold: float) -> DataFrame:
    """rep, links and root rows of all pairs of tiles; ``classes`` has rep, m, label, size, embedding."""
    spark = classes.sparkSession
    fitted = spark.sparkContext.broadcast(rotations(classes, threshold))
    key = ["label", "size"]
    counts = classes.groupBy(*key).agg(F.count("*").alias("n")).select(F.col("label").alias("_label"), F.col("size").alias("_size"), F.ceil(F.col("n") * F.col("size") / TILE_NUMBERS).cast("int").alias("tiles"))
    counts = written(counts, "tile-counts")
    placed = classes.join(counts, (F.col("label") == F.col("_label")) & (F.col("size") == F.col("_size"))).withColumn("tile", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("tiles")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = met.select(*key, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "rep", "m", "embedding")

    def join(group: pa.Table) -> pa.Table:
        i, j, size = (group.column(c)[0].as_py() for c in ("i", "j", "size"))
        tiles = [group.filter(pa.compute.equal(group.column("tile"), t)) for t in ([i] if i == j else [i, j])]
        rotation = fitted.value.get(size) or Rotation.fit(np.zeros((0, size)), threshold)
        names, links, roots = _tile_links(tiles, rotation, threshold)
        del group, tiles
        rest_worker()
        return pa.table({"rep": pa.array(names, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array(roots, pa.int64())})

    return rows.groupBy(*key, "i", "j").applyInArrow(join, "rep long, links long, root long")


def near_vectors(embeddings: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vec_id, embedding and label.

    Only vectors of the same label and length are compared. Null labels, null, empty or zero
    vectors and vectors with null, NaN or infinite components link with nothing. Repeated
    rows count as vectors of their own, which link; rows with the same vec_id share links and
    component. A row without a vec_id links with nothing and is kept.
    """
    rows = embeddings.select("vec_id", "embedding", "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    valid = rows.where(good)
    classes = written(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")).withColumn("size", F.size("embedding")), "vector-classes")
    found = written(link_counts(classes, threshold), "tile-links")
    own = valid.join(classes.select(F.col("label").alias("_l"), F.col("embedding").alias("_e"), "rep", "m"), (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e"))).select("vec_id", "rep", "m")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "_rep")
    per_id = own.join(sums, F.col("rep") == F.col("_rep"), "left").select("vec_id", "rep", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"))
    twice = per_id.groupBy("vec_id").agg(F.min("rep").alias("r0"), F.max("rep").alias("r1")).where("r0 < r1")
    ties = twice.select(F.col("r0").alias("a"), F.col("r1").alias("b"))
    labels = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(ties)).withColumnRenamed("node", "_node")
    done = per_id.join(labels, F.col("rep") == F.col("_node"), "left").select("vec_id", F.col("links").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rest = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

"""An inverted-file index over stored vectors: cells around centroids, laid out by borough, scope and cell.

Centroids are fitted by k-means (cosine) on a bounded sample; every vector is then stored under the cell of
its nearest centroid, so that a search reads the folders of its borough, its scope and the cells nearest to it, and no
others. Cells lie inside a (borough, scope): a scope with few rows is never crowded out by another.
How many cells a search reads by default is calibrated when the index is built: the fewest that find the wanted share
of nearest neighbours among a bounded sample. Reading all cells is the exact search.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.vector import similarity
from larkspur.operators import tiles
from larkspur.operators.errors import MissingScope
from larkspur.operators.ranking import _queries

#: Vectors that centroids are fitted on: at most so many for each cell. Most cells; vectors that a cell should hold; rounds of k-means.
SAMPLE_PER_CELL, MOST_CELLS, CELL_ROWS, ROUNDS = 256, 4096, 64, 8

#: Vectors that the number of cells to read is calibrated on, how many of them ask, for how many neighbours, and the share to be found.
CALIBRATION, ASKING, NEIGHBOURS, TARGET = 4096, 256, 10, 0.95


@dataclass(frozen=True)
class VectorIndex:
    """Where an index lies, its centroids (at most MOST_CELLS rows), and the cells that a search reads unless told otherwise."""

    path: str
    centroids: np.ndarray
    probes: int

    @property
    def cells(self) -> int:
        return len(self.centroids)


def usable(vector: Column, size: int) -> Column:
    """Vectors of the index's size, finite in all components and not zero."""
    return (F.size(F.coalesce(vector, F.array().cast("array<double>"))) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)


def nearest_cells(vector: Column, centroids: np.ndarray, count: int) -> Column:
    """The numbers of the cells whose centroids have the highest cosine with a vector, nearest first, equal ones by number."""
    table = centroids / np.linalg.norm(centroids, axis=1, keepdims=True)

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        scores = np.stack(vectors.to_numpy()).astype(float) @ table.T
        if count == 1:
            return pd.Series(list(np.argmax(scores, axis=1).astype(np.int32)[:, None]))
        return pd.Series(list(np.argsort(-scores, axis=1, kind="stable")[:, :count].astype(np.int32)))

    return nearest(vector)


def fitted_centroids(docs: DataFrame, size: int, cells: int | None = None, seed: int = 7) -> np.ndarray:
    """Centroids of the active documents' vectors.

    The sample is chosen by a hash of the id and holds about SAMPLE_PER_CELL vectors for each cell, whatever
    the table's size; without a number of cells there is one for CELL_ROWS vectors, MOST_CELLS at most.
    """
    live = docs.where(F.col("is_active") & usable(F.col("embedding"), size))
    total = live.count()
    if not total:
        return np.zeros((0, size))
    cells = min(cells or -(-total // CELL_ROWS), MOST_CELLS)
    share = min(1.0, cells * SAMPLE_PER_CELL / total)
    sample = live.where(F.pmod(F.xxhash64("document_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select(array_to_vector("embedding").alias("features"))
    model = KMeans(k=max(2, cells), seed=seed, maxIter=ROUNDS, distanceMeasure="cosine").fit(sample.cache()) if total > 1 else None
    sample.unpersist()
    return np.stack(model.clusterCenters()) if model else np.ones((1, size))


def calibrated_probes(docs: DataFrame, centroids: np.ndarray) -> int:
    """The fewest nearest cells that hold the share TARGET of the nearest neighbours of vectors of a sample.

    The sample's neighbours lie farther apart than those of the whole table, so the number is rather too large than too small.
    """
    live = docs.where(F.col("is_active") & usable(F.col("embedding"), centroids.shape[1]))
    rows = live.select("embedding", F.xxhash64("document_id").alias("h")).orderBy("h").limit(CALIBRATION).collect()
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    vectors, table = unit(np.array([r["embedding"] for r in rows])), unit(centroids)
    order = np.argsort(-(vectors @ table.T), axis=1, kind="stable")
    cell = order[:, 0]
    asking = np.arange(min(ASKING, len(vectors)))
    near = np.argsort(-(vectors[asking] @ vectors.T), axis=1, kind="stable")[:, :NEIGHBOURS]
    place = np.argsort(order[asking], axis=1, kind="stable")  # of each cell in the order of the one that asks
    needed = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return int(needed[max(0, int(np.ceil(TARGET * len(needed))) - 1)]) + 1


def build_index(docs: DataFrame, path: str, size: int, cells: int | None = None) -> VectorIndex:
    """Store the active documents' usable vectors under path by borough, scope and cell; one shuffle, in which a cell's rows meet in few files.

    Documents have document_id, restaurant_id, borough, scope, doc_type, topic, is_active and embedding. Those without a
    borough or scope are found by searches that ask for none.
    """
    spark = docs.sparkSession
    centroids = fitted_centroids(docs, size, cells)
    probes = calibrated_probes(docs, centroids) if len(centroids) else 0
    rows = [(i, probes, c.tolist()) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "cell int, probes int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    live = docs.where(F.col("is_active") & usable(F.col("embedding"), size))
    placed = live.withColumn("cell", F.element_at(nearest_cells(F.col("embedding"), centroids, 1), 1)) if len(centroids) else live.withColumn("cell", F.lit(0))
    # a cell may hold a third of all rows: REBALANCE lets AQE split it, where a hash would send it to one task
    placed.hint("rebalance", "borough", "scope", "cell").write.mode("overwrite").partitionBy("borough", "scope", "cell").parquet(f"{path}/vectors")
    return VectorIndex(path, centroids, probes)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    return VectorIndex(path, np.array([r["centroid"] for r in rows]), rows[0]["probes"] if rows else 0)


def stored(spark: SparkSession, index: VectorIndex) -> DataFrame:
    """All vectors of an index; borough, scope and cell are folders, so filters on them read no other files."""
    return spark.read.parquet(f"{index.path}/vectors")


def nearest_in_index(spark: SparkSession, index: VectorIndex, scope: str, vector: Sequence[float], limit: int, borough: str = "", probes: int | None = None, exact: bool = False) -> DataFrame:
    """The nearest documents to one vector in its ``probes`` nearest cells (None: as calibrated), or exactly: document_id, score.

    Cells are named in the filter itself, so that the scan lists only their folders.
    """
    if not scope:
        raise MissingScope("a vector search needs a scope")
    found = stored(spark, index).where(F.col("scope") == scope)
    if borough:
        found = found.where(F.col("borough") == borough)
    if not exact and (probes or index.probes) < index.cells:
        table = index.centroids / np.linalg.norm(index.centroids, axis=1, keepdims=True)
        found = found.where(F.col("cell").isin(np.argsort(-(table @ np.asarray(vector, float)), kind="stable")[: probes or index.probes].tolist()))
    asked = F.array(*[F.lit(float(x)) for x in vector])
    return found.select("document_id", similarity(F.col("embedding"), asked).alias("score")).orderBy(F.desc("score"), "document_id").limit(limit)


def index_hits(spark: SparkSession, index: VectorIndex, requests: DataFrame, limit: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """The nearest documents of each request: query_id, document_id, score, rank.

    Requests have query_id, scope, embedding and borough (null or empty: any). Each is sent to its ``probes``
    nearest cells (None: as calibrated; ``exact``: to all) and meets only their rows, in tiles that hold cells whole;
    folders of cells that no request is sent to are not read. Of each tile a request keeps ``limit`` rows
    before they meet. Requests without a scope or a usable vector have no rows.
    """
    if not index.cells:
        return requests.select("query_id", F.lit(0).cast("long").alias("document_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    count = index.cells if exact else min(probes or index.probes, index.cells)
    asked = requests.where((F.coalesce("scope", F.lit("")) != "") & usable(F.col("embedding"), index.centroids.shape[1]))
    asked = asked.select("query_id", "scope", F.nullif(F.col("borough"), F.lit("")).alias("_borough"), F.col("embedding").alias("_q"))
    held = stored(spark, index).select("document_id", "borough", "scope", "cell", "embedding")
    if count < index.cells:
        sent = asked.withColumn("_cells", nearest_cells(F.col("_q"), index.centroids, count))
        # only the folders of cells that some request is sent to
        held = held.join(_queries(sent.select("scope", F.explode("_cells").alias("cell")).distinct()), ["scope", "cell"], "left_semi")
    else:
        sent = asked.withColumn("_cells", F.lit(None).cast("array<int>"))

    def fits(found: pa.Table, row: dict) -> np.ndarray:
        out = np.ones(found.num_rows, bool)
        if row["_cells"] is not None:
            named = np.zeros(index_cells, bool)
            named[row["_cells"]] = True
            out &= named[found.column("cell").to_numpy()]
        if row["_borough"] is not None:
            out &= tiles.among(found.column("borough"), [row["_borough"]])
        return out

    index_cells = index.cells
    scored = tiles.nearest(held, sent, ["scope"], limit, fits=fits, by="cell" if count < index.cells else None, keep=("document_id",))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id"))).where(F.col("rank") <= limit)


def recall_against(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per request the share of the exact hits that were found: query_id, n_exact, n_found, recall."""
    both = exact.select("query_id", "document_id").join(found.select("query_id", "document_id", F.lit(1).alias("_hit")), ["query_id", "document_id"], "left")
    return both.groupBy("query_id").agg(F.count("*").alias("n_exact"), F.count("_hit").alias("n_found")).withColumn("recall", F.col("n_found") / F.col("n_exact"))

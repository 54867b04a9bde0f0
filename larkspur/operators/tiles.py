"""Exact similarity of each query to all documents under its key, in pairs of tiles of bounded size.

The documents of a key are dealt into tiles by a hash, its queries likewise, and each pair of tiles is one group: two
matrices that are multiplied. What can be among a query's best is scored again in the order of
``functions.vector.similarity``, to the last bit, so that ties fall as they do there; only the best leave a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.session import ship

#: Documents and queries of a tile, and pairs that are scored at once.
DOCS, QUERIES, PAIRS = 4096, 2048, 1 << 18

#: How far a product of matrices may lie from the sum taken in order.
SLACK = 1e-9

#: Norms within which that holds; pairs with another are scored in order, whatever their product.
PLAIN = 1e-100, 1e100

#: Whether each document of a tile may be a hit of one query: (columns of the documents, row of the query) -> booleans.
Fits = Callable[[pa.Table, dict], np.ndarray]


def among(values: pa.ChunkedArray, given: Sequence) -> np.ndarray:
    """Whether each value is a given one; null is none."""
    return np.asarray(pc.is_in(values, value_set=pa.array(given, values.type)).to_numpy(), bool)


class _Vectors:
    """Vectors of a column by their length, as matrices; null ones, empty ones and those that hold a null are left out."""

    def __init__(self, column: pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten()  # without what stands behind nulls
        starts = np.cumsum(length) - length
        if flat.null_count:
            held = np.zeros(len(flat) + 1, np.int64)
            np.cumsum(flat.is_null().to_numpy(zero_copy_only=False), out=held[1:])
            bad = held[starts + length] > held[starts]
        else:
            bad = np.zeros(len(length), bool)
        values = flat.to_numpy(zero_copy_only=False).astype(float)
        self.count, self.by_length = len(length), {}
        for size in np.unique(length[(length > 0) & ~bad]).tolist():
            rows = np.flatnonzero((length == size) & ~bad)
            matrix = values[starts[rows][:, None] + np.arange(size)]
            self.by_length[size] = rows, np.ascontiguousarray(matrix.T), matrix


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products of columns, term by term in order."""
    out = np.zeros(a.shape[1])
    for x, y in zip(a, b, strict=True):
        out = out + x * y
    return out


def _held(cosines: np.ndarray) -> np.ndarray:
    """Between 0 and 1; what is no number counts as more than 1, as Spark orders it."""
    return np.where(np.isnan(cosines) | (cosines > 1), 1.0, np.where(cosines < 0, 0.0, cosines))


def _scores(docs: np.ndarray, queries: np.ndarray, norms: np.ndarray, q_norms: np.ndarray, at: np.ndarray, q_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, whether there is one) of pairs of columns."""
    score, some = np.zeros(len(at)), np.zeros(len(at), bool)
    for i in range(0, len(at), PAIRS):
        a, b = at[i : i + PAIRS], q_at[i : i + PAIRS]
        total = np.zeros(len(a))
        for x, y in zip(docs, queries, strict=True):
            total = total + x[a] * y[b]
        both = norms[a] * q_norms[b]
        some[i : i + PAIRS] = both != 0
        score[i : i + PAIRS] = _held(total / np.where(both == 0, 1.0, both))
    return score, some


def _best(docs: pa.Table, queries: pa.Table, ids: str, limit: int, floor: float | None, group: str | None, fits: Fits | None, blur: float = 0.0) -> tuple[np.ndarray, ...]:
    """(rows of documents, rows of queries, scores, whether there is one): the best ``limit`` documents of each query, or of each query and group."""
    order = np.empty(docs.num_rows, np.int64)
    order[pc.sort_indices(docs.column(ids)).to_numpy()] = np.arange(docs.num_rows)
    groups = np.zeros(docs.num_rows, np.int64)
    if group:
        encoded = docs.column(group).combine_chunks().dictionary_encode()
        encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
        groups = pc.fill_null(encoded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    by_group = np.argsort(groups, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(groups[by_group]) != 0]) if group else None
    left, right = _Vectors(docs.column("embedding")), _Vectors(queries.column("_q"))
    asked = queries.drop_columns(["_q"]).to_pylist() if fits else None
    allowed = [fits(docs, row) for row in asked] if fits else None
    found: list[tuple[np.ndarray, ...]] = []
    silent = np.ones((queries.num_rows, docs.num_rows), bool)  # pairs without a score
    with np.errstate(all="ignore"):
        for size, (q_rows, q_columns, q_matrix) in right.by_length.items():
            if size not in left.by_length:
                continue
            rows, columns, matrix = left.by_length[size]
            norms, q_norms = np.sqrt(_dots(columns, columns)), np.sqrt(_dots(q_columns, q_columns))
            near = _held((q_matrix / np.where(q_norms == 0, 1.0, q_norms)[:, None]) @ (matrix / np.where(norms == 0, 1.0, norms)[:, None]).T)
            scored = (q_norms[:, None] * norms[None, :]) != 0
            silent[np.ix_(q_rows, rows)] = ~scored
            near[~scored] = -1.0
            plain = lambda x: (x >= PLAIN[0]) & (x <= PLAIN[1])
            odd, q_odd = ~plain(norms), ~plain(q_norms)
            for k, q in enumerate(q_rows):
                line = near[k]
                if allowed is not None:
                    line = np.where(allowed[q][rows], line, -1.0)
                always = scored[k] & (line >= 0) & (odd | q_odd[k])
                if always.any():
                    line = np.where(always, -1.0, line)
                least = 0.0 if floor is None else floor
                if group:
                    whole = np.full(docs.num_rows, -1.0)
                    whole[rows] = line
                    tops = np.maximum.reduceat(whole[by_group], edges)
                    bar = np.empty(docs.num_rows)
                    bar[by_group] = np.repeat(tops, np.diff(np.r_[edges, docs.num_rows]))
                    chosen = np.flatnonzero(always | ((line >= bar[rows] - SLACK) & (line >= max(0.0, least - SLACK))))
                else:
                    if limit < len(line):
                        least = max(least, np.partition(line, len(line) - limit)[len(line) - limit])
                    chosen = np.flatnonzero(always | ((line >= least - SLACK - blur) & (line >= 0)))
                score, some = _scores(columns, q_columns, norms, q_norms, chosen, np.full(len(chosen), k))
                if floor is not None:
                    some &= score >= floor
                at = rows[chosen[some]]
                score = score[some]
                ranked = np.lexsort((order[at], -score, groups[at])) if group else np.lexsort((order[at], -score))
                if group:
                    g = groups[at][ranked]
                    ranked = ranked[np.r_[True, g[1:] != g[:-1]]] if len(ranked) else ranked
                else:
                    first = ranked[:limit]
                    if blur and len(ranked) > limit:
                        s = score[ranked]
                        run = np.arange(len(s)) - np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], np.arange(len(s)), 0))  # place among equal ones
                        first = ranked[(np.arange(len(s)) < limit) | ((s >= s[limit - 1] - blur) & (run < limit))]
                    ranked = first
                found.append((at[ranked], np.full(len(ranked), q), score[ranked], np.ones(len(ranked), bool)))
    if floor is None and silent.any():
        # pairs without a score stand last, by id
        with_score: dict[int, np.ndarray] = {int(f[1][0]): f[0] for f in found if len(f[1])}
        for q in np.flatnonzero(silent.any(axis=1)):
            known = with_score.get(int(q), np.zeros(0, np.int64))
            rows = np.flatnonzero(silent[q] & (allowed[q] if allowed is not None else True))
            rows = rows[np.argsort(order[rows])]
            if group:
                rows = rows[~np.isin(groups[rows], groups[known])]
                rows = rows[np.unique(groups[rows], return_index=True)[1]]
            else:
                rows = rows[: max(0, limit - len(known))]
            found.append((rows, np.full(len(rows), q), np.zeros(len(rows)), np.zeros(len(rows), bool)))
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _dealt(table: DataFrame, on: Sequence[str], by: Column, own: str, other: str, sizes: DataFrame) -> DataFrame:
    """Rows with the number of their own tile, once for each tile of the other side."""
    placed = table.join(sizes, list(on)).withColumn(f"_{own}_tile", F.pmod(F.xxhash64(by), F.col(f"_{own}_tiles")).cast("int"))
    dealt = placed.withColumn(f"_{other}_tile", F.explode(F.sequence(F.lit(0), (F.col(f"_{other}_tiles") - 1).cast("int")))).drop("_doc_tiles", "_query_tiles")
    return dealt.select(*[F.col(c).alias(c) for c in dealt.columns])  # columns of its own, where documents ask themselves


def nearest(docs: DataFrame, queries: DataFrame, on: Sequence[str], limit: int = 1, floor: float | None = None, group: str | None = None, fits: Fits | None = None, by: str | None = None, blur: float = 0.0, keep: Sequence[str] = ("document_id", "restaurant_id")) -> DataFrame:
    """Candidates for the best documents of each query under its key: query_id, what ``keep`` names of the document, score.

    ``docs`` have document_id and embedding, ``queries`` query_id and _q, both the key. Of each tile the ``limit`` best of
    each query come, by similarity, then id (``group``: the best of each query and group), so the best of all are among them.
    Similarities below ``floor`` are left out; without one, documents without a similarity stand last. ``by``: what
    decides a document's tile, if not its id. ``blur``: documents so little below the last of the ``limit`` come too, for
    an order by rounded similarities.
    """
    ship(docs.sparkSession)
    count = lambda df, size, name: df.groupBy(*on).agg(F.ceil(F.count("*") / size).alias(name))
    sizes = count(docs, DOCS, "_doc_tiles").join(count(queries, QUERIES, "_query_tiles"), list(on))
    left = _dealt(docs, on, F.col(by or "document_id"), "doc", "query", sizes)
    right = _dealt(queries, on, F.col("query_id"), "query", "doc", sizes)
    tiles = [*on, "_doc_tile", "_query_tile"]
    fields = {f"_k{i}": c for i, c in enumerate(keep)}
    schema = ", ".join([f"query_id {queries.schema['query_id'].dataType.simpleString()}", *[f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in fields.items()], "score double"])

    def run(mine: pa.Table, asking: pa.Table) -> pa.Table:
        if not mine.num_rows or not asking.num_rows:
            at, q, score, some = _best_of_none
        else:
            at, q, score, some = _best(mine, asking, "document_id", limit, floor, group, fits, blur)
        scores = pa.array(score, pa.float64(), mask=~some)
        return pa.Table.from_arrays([asking.column("query_id").take(pa.array(q)), *[mine.column(c).take(pa.array(at)) for c in fields.values()], scores], ["query_id", *fields, "score"])

    _best_of_none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
    # tiles are small and costly, so AQE must not put many into one task: a stated number of partitions stays
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 4 * spark.sparkContext.defaultParallelism)
    met = left.repartition(tasks, *tiles).groupBy(*tiles).cogroup(right.repartition(tasks, *tiles).groupBy(*tiles)).applyInArrow(run, schema)
    return met.select("query_id", *[F.col(k).alias(c) for k, c in fields.items()], "score")

"""The inverted-file index: recall against the exact way, folders that are read, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import vector_index as V
from larkspur.operators.errors import MissingScope
from larkspur.plans import recall as P

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_recall_of_every_twentieth_vector(spark, tmp_path):
    docs = P.knowledge(spark, SF)
    asked = P.requests(spark, SF).select("query_id", "scope", "borough", F.col("vector").alias("embedding")).cache()
    index = V.build_index(docs, str(tmp_path), 64)
    assert index.cells == 8 and V.open_index(spark, str(tmp_path)).probes == index.probes
    assert V.stored(spark, index).count() == docs.where("is_active").count()
    exact = V.index_hits(spark, index, asked, 10, exact=True)
    rows = V.recall_against(V.index_hits(spark, index, asked, 10), exact).collect()
    assert len(rows) == asked.count() and sum(r["recall"] for r in rows) / len(rows) >= 0.9
    few = V.recall_against(V.index_hits(spark, index, asked, 10, probes=1), exact).agg(F.avg("recall")).first()[0]
    assert 0 < few < 1


def clustered(spark, n=1200):
    draw = np.random.default_rng(1)
    middles = draw.normal(size=(12, 8)) * 5
    rows = [(i, i % 7, f"b{i % 2}", ("x", "y")[i % 5 == 0], "k", None, True, [float(v) for v in middles[i % 12] + draw.normal(size=8)]) for i in range(n)]
    rows += [(n, 1, "b0", "x", "k", None, False, rows[0][-1]), (n + 1, 1, "b0", "x", "k", None, True, [0.0] * 8), (n + 2, 1, "b0", "x", "k", None, True, None), (n + 3, 1, "b0", "x", "k", None, True, [1.0])]
    return spark.createDataFrame(rows, "document_id long, restaurant_id long, borough string, scope string, doc_type string, topic string, is_active boolean, embedding array<double>")


def test_clusters_are_found_in_few_cells(spark, tmp_path):
    docs = clustered(spark)
    index = V.build_index(docs, str(tmp_path), 8, cells=12)
    assert index.probes <= 4 and V.stored(spark, index).count() == 1200
    asked = docs.where("document_id % 20 = 0 AND is_active").where("document_id < 1200").select(F.col("document_id").alias("query_id"), "scope", F.when(F.col("document_id") % 40 == 0, F.col("borough")).alias("borough"), "embedding")
    exact = V.index_hits(spark, index, asked, 10, exact=True)
    assert V.recall_against(V.index_hits(spark, index, asked, 10), exact).agg(F.avg("recall")).first()[0] >= 0.9
    some = {r["document_id"]: r["borough"] for r in docs.collect()}
    assert all(r["query_id"] % 40 or some[r["document_id"]] == some[r["query_id"]] for r in exact.collect())


def test_one_search_reads_its_folders_only(spark, tmp_path):
    docs = clustered(spark)
    index = V.build_index(docs, str(tmp_path), 8, cells=6)
    vector = docs.where("document_id = 3").first()["embedding"]
    found = V.nearest_in_index(spark, index, "x", vector, 5, borough="b1", probes=2)
    text = plan(found)
    filters = text.split("PartitionFilters: [")[1].split("]")[0]
    assert "scope" in filters and "borough" in filters and "cell" in filters
    assert found.first()["document_id"] == 3
    best = [r["document_id"] for r in V.nearest_in_index(spark, index, "x", vector, 5, exact=True).collect()]
    live = {r["document_id"]: np.array(r["embedding"]) for r in docs.where("scope = 'x' AND is_active").collect() if r["embedding"] and any(r["embedding"]) and len(r["embedding"]) == 8}
    cosine = {d: float(v @ vector / np.linalg.norm(v) / np.linalg.norm(vector)) for d, v in live.items()}
    assert best == sorted(cosine, key=lambda d: (-cosine[d], d))[:5]
    with pytest.raises(MissingScope):
        V.nearest_in_index(spark, index, "", vector, 5)


def test_batch_search_prunes_by_its_requests(spark, tmp_path):
    docs = clustered(spark)
    index = V.build_index(docs, str(tmp_path), 8, cells=6)
    asked = docs.where("document_id = 4").select(F.col("document_id").alias("query_id"), "scope", F.lit(None).cast("string").alias("borough"), "embedding")
    assert "dynamicpruning" in plan(V.index_hits(spark, index, asked, 5, probes=1))


def test_nothing_to_index_and_bad_requests(spark, tmp_path):
    docs = clustered(spark)
    empty = V.build_index(docs.limit(0), str(tmp_path / "e"), 8)
    asked = docs.limit(3).select(F.col("document_id").alias("query_id"), "scope", "borough", "embedding")
    assert empty.cells == 0 and V.index_hits(spark, empty, asked, 5).count() == 0
    index = V.build_index(docs, str(tmp_path / "f"), 8, cells=4)
    bad = docs.where("document_id >= 1201").select(F.col("document_id").alias("query_id"), "scope", "borough", "embedding").unionByName(asked.withColumn("scope", F.lit("")))
    assert V.index_hits(spark, index, bad, 5).count() == 0

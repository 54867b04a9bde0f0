"""Similarity in tiles against the column expression, row by row."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions.vector import similarity
from larkspur.operators import ranking, tiles

NAN = float("nan")
ODD = [[1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [-1.0, 0.0], [0.0, 0.0], None, [1.0], [1.0, None], [NAN, 1.0], [0.0, -1.0], [0.3, 0.7], [3e-200, 0.0], [1e200, 1e200]]


@pytest.fixture
def odd(spark):
    rows = [(i, i % 3, "a" if i % 4 else "b", ODD[i % len(ODD)]) for i in range(60)]
    docs = spark.createDataFrame(rows, "document_id long, restaurant_id long, scope string, embedding array<double>")
    return docs, docs.where("document_id % 4 < 2").select(F.col("document_id").alias("query_id"), "scope", "embedding")


def _plain(docs, queries):
    met = docs.join(queries.select("query_id", "scope", F.col("embedding").alias("_q")), "scope")
    return met.select("query_id", "document_id", "restaurant_id", similarity(F.col("embedding"), F.col("_q")).alias("score"))


@pytest.mark.parametrize("floor", [None, 0.3])
def test_hits_are_those_of_the_expression(odd, monkeypatch, floor):
    """Duplicates, opposite, zero, null and broken vectors; ties fall by id, whatever the tiles."""
    monkeypatch.setattr(tiles, "DOCS", 7)
    monkeypatch.setattr(tiles, "QUERIES", 5)
    want = _plain(*odd)
    want = want if floor is None else want.where(F.col("score") >= floor)
    ranked = want.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id"))).where("rank <= 9")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["document_id"], r["score"]) for r in df.collect())
    assert rows(ranking.vector_hits(*odd, ["scope"], 9, floor=floor)) == rows(ranked)


def test_best_of_each_place_of_a_pool(odd, monkeypatch):
    monkeypatch.setattr(tiles, "DOCS", 7)
    monkeypatch.setattr(ranking, "POOL_PIECE", 1)
    docs, queries = odd
    pool = queries.select("query_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("restaurant_id"))
    want = {}
    for r in _plain(docs, queries).where("restaurant_id <> 1").collect():
        key, at = (r["query_id"], r["restaurant_id"]), (-math.inf if r["score"] is None else r["score"], -r["document_id"])
        want[key] = max(want.get(key, (-math.inf, -math.inf)), at)
    got = {(r["query_id"], r["restaurant_id"]): (-math.inf if r["score"] is None else r["score"], -r["document_id"]) for r in ranking.pool_scores(docs, queries, pool, ["scope"]).collect()}
    assert got == want


def test_pairs_never_leave_the_tiles(odd):
    """No vectors are joined to vectors: before, each pair of a scope was a row with both."""
    plan = ranking.vector_hits(*odd, ["scope"], 9)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("method", ["weighted", "rrf"])
def test_shared_channel_ranks_as_if_dealt_out(spark, method):
    """Hits that all queries of an area share are not dealt out to them; totals and ranks are those of the whole pool."""
    place = spark.range(400).select(F.col("id").alias("restaurant_id"), (F.col("id") % 3).alias("area"), (F.pmod(F.xxhash64("id"), F.lit(23)) / 7.0).alias("prior"))
    asking = spark.range(9).select(F.col("id").alias("query_id"), (F.col("id") % 4).alias("area"))
    drawn = lambda seed, n: F.pmod(F.xxhash64("query_id", "n", F.lit(seed)), F.lit(n))
    hits = asking.crossJoin(spark.range(25).withColumnRenamed("id", "n")).select("query_id", F.when(drawn(1, 2) == 0, "keyword").otherwise("vector").alias("channel"), drawn(2, 430).alias("restaurant_id"), (drawn(3, 100) / 99.0).alias("score"))
    shared = ranking.Shared("structured", "area", 1.0, place.select("area", "restaurant_id", "prior"), asking)
    pool = lambda found: found.select("query_id", "restaurant_id").distinct().join(place.select("restaurant_id", "prior"), "restaurant_id")
    whole = hits.unionByName(shared.hits().drop("prior"))
    rows = lambda df: sorted(map(tuple, df.select("query_id", "rank", "restaurant_id", "total").collect()))
    assert rows(ranking.fuse(hits, pool(hits), method, top=7, shared=shared)) == rows(ranking.fuse(whole, pool(whole), method, top=7))
    both = {(r[0], r[1]) for r in hits.join(shared.hits().select("query_id", "restaurant_id"), ["query_id", "restaurant_id"]).select("query_id", "restaurant_id").collect()}
    alone = {tuple(r) for r in shared.alone(pool(hits)).select("query_id", "restaurant_id").collect()}
    assert both and alone == {tuple(r) for r in shared.hits().select("query_id", "restaurant_id").collect()} - both


def test_recall_without_pairs(spark):
    from larkspur.operators import rollups

    members = spark.range(40).select("id", (F.col("id") % 3).alias("g"))
    asked = spark.range(4).select(F.col("id").alias("query_id"), F.col("id").alias("g"))
    results = asked.crossJoin(members.drop("g")).select("query_id", "id", F.pmod(F.xxhash64("query_id", "id"), F.lit(30)).alias("rank"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = rollups.recall_of_groups(results, members, asked, "g", 12)
    assert len(got.collect()) == 3 and rows(got) == rows(rollups.recall_at_k(results, members.join(asked, "g").select("query_id", "id"), 12))


def test_equal_names_are_looked_up_once(spark, tmp_path):
    from larkspur.operators import name_index

    items = spark.range(50).select("id", F.concat(F.lit("fox "), (F.col("id") % 5).cast("string")).alias("name"), F.lit(None).cast("string").alias("address"))
    index = name_index.build_name_index(items, str(tmp_path))
    asked = spark.range(60).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, "FOX").otherwise("x 3").alias("text"))
    found = name_index.name_hits(spark, index, asked, 3)
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in found.collect()) == sorted((q, i, n + 1) for q in range(60) for n, i in enumerate([0, 1, 2] if q % 2 == 0 else [3, 8, 13]))


def test_backfill_counts_without_pairs(spark):
    from larkspur.operators import recall

    members = spark.range(90).select((F.col("id") % 4).alias("g"), F.when(F.col("id") % 7 != 0, F.col("id") % 11).alias("restaurant_id"))
    asked = spark.range(6).select(F.col("id").alias("query_id"), (F.col("id") % 5).alias("g"))
    details = spark.range(8).select(F.col("id").alias("restaurant_id"), F.when(F.col("id") % 3 != 0, F.col("id") / 2.0).alias("rating"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = recall.backfill_counts(members, asked, ["g"], details, F.col("rating") >= 2.0)
    assert rows(got) == rows(recall.backfill(members.join(asked, "g").select("query_id", "restaurant_id"), details, F.col("rating") >= 2.0)[1])


def test_digest_answers_are_parsed_once(spark):
    from larkspur.operators import records

    text = "a" * 200
    rows = [(f' {{"content": " {text} ", "source_review_ids": [3, 1, 3]}} ',), ("[1]",), (None,), (f'{{"content": "{text}", "source_review_ids": [9]}}',), ("{} {}",)]
    raw = spark.createDataFrame(rows, "raw string")
    done = raw.select(records.digest_answer(F.col("raw"), F.array(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("a"))
    assert [(r["a"]["problem"], r["a"]["ids"]) for r in done.collect()] == [(None, [1, 3]), ("not_an_object", None), ("not_an_object", None), ("id_not_offered", None), ("not_one_object", None)]
    assert done._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 2

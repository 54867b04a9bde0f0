import datetime

import pytest
from pyspark.sql import functions as F

from larkspur.operators import lifecycle, memory, plans, ranking, recall, state
from larkspur.operators.errors import MissingScope
from larkspur.plans import importing
from larkspur.sources import raw


def documents(spark):
    rows = [(i, i % 4, f"area{i % 2}", "evidence" if i % 3 else "profile", "restaurant_review_summary" if i % 5 == 0 else "other", "food" if i % 2 else "wait", i % 7 != 0, [float(i % 9), 1.0]) for i in range(1, 60)]
    return spark.createDataFrame(rows, "document_id long, restaurant_id long, borough string, scope string, doc_type string, topic string, is_active boolean, embedding array<double>")


def test_stored_documents_are_pruned(spark, tmp_path):
    path = str(tmp_path / "docs")
    recall.write_documents(documents(spark), path)
    stored = recall.read_documents(spark, path)
    found = recall.search_documents(stored, "evidence", [3.0, 1.0], 5, borough="area1", places=[1, 3])
    plan = found._jdf.queryExecution().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]", 1)[0]
    assert "borough" in filters and "scope" in filters
    got = [r["document_id"] for r in found.collect()]
    want = [r for r in documents(spark).collect() if r["is_active"] and r["scope"] == "evidence" and r["borough"] == "area1" and r["restaurant_id"] in (1, 3)]
    cosine = lambda v: (3 * v[0] + v[1]) / ((10 * (v[0] ** 2 + v[1] ** 2)) ** 0.5)
    assert got == [r["document_id"] for r in sorted(want, key=lambda r: (-round(cosine(r["embedding"]), 12), r["document_id"]))][:5]
    with pytest.raises(MissingScope):
        recall.search_documents(stored, "", [1.0, 1.0], 5)


def test_evidence_without_a_vector(spark):
    asked = spark.createDataFrame([(1, [2], None, None, None), (2, [2, 3], ["other"], None, None), (3, [], None, None, None), (4, [1], None, "food", None)], "query_id long, places array<long>, kinds array<string>, topic string, embedding array<double>")
    rows = [r for r in documents(spark).collect() if r["is_active"] and r["scope"] == "evidence"]
    got = {}
    for r in recall.evidence_recall(documents(spark), asked, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["document_id"])
    order = lambda r: (r["restaurant_id"], r["doc_type"], r["document_id"])
    assert got[1] == [r["document_id"] for r in sorted(rows, key=order) if r["restaurant_id"] == 2] and len(got[1]) > 3
    assert got[2] == [r["document_id"] for r in sorted(rows, key=order) if r["restaurant_id"] in (2, 3) and r["doc_type"] == "other"][:3]
    assert got.get(4, []) == [r["document_id"] for r in sorted(rows, key=order) if r["restaurant_id"] == 1 and r["doc_type"] == recall.SUMMARY and r["topic"] == "food"]
    assert 3 not in got and [tuple(r) for r in recall.refused(asked).collect()] == [(3, "no_scope")]


def test_text_hits_have_no_nested_loop(spark):
    items = spark.createDataFrame([(1, "Red Widget", None), (2, "ring", "Red street"), (3, "aged", "x"), (4, None, "r")], "id long, name string, address string")
    asked = spark.createDataFrame([(1, "red"), (2, "RED w"), (3, "r"), (4, " "), (5, "zz")], "query_id int, text string")
    hits = ranking.text_hits(items, asked, 10)
    plan = hits._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = {(r["query_id"], r["id"]) for r in hits.collect()}
    assert found == {(1, 1), (1, 2), (2, 1), (3, 1), (3, 2)} | {(3, 4)}


def test_every_date_has_slots(spark):
    dates = spark.range(800).select(F.expr("date_add(DATE '2024-01-01', CAST(id AS INT))").alias("slot_date"))
    got = state.availability(spark.createDataFrame([(7,)], "restaurant_id long"), dates, spark.createDataFrame([("r7-2024-01-05-1800", 8)], "slot_id string, booked long"), 8, 2)
    assert got.count() == 800 * 5 - 1


def test_new_memories_have_ids_of_their_own(spark):
    at = datetime.datetime(2024, 1, 1)
    current = spark.createDataFrame([(5, 1, "fact", "a", 0.8, at, at, at)], "memory_id long, user_id long, type string, content string, confidence double, created_at timestamp, updated_at timestamp, deleted_at timestamp")
    incoming = spark.range(5000).select(F.lit(1).cast("long").alias("user_id"), F.lit("fact").alias("type"), F.concat(F.lit("c"), "id").alias("content"), F.lit(at).alias("at")).unionByName(spark.createDataFrame([(1, "fact", "a", at)], "user_id long, type string, content string, at timestamp"))
    got = lifecycle.save_memories(current, incoming).collect()
    assert sorted(r["memory_id"] for r in got) == [5, *range(6, 5006)]
    assert next(r for r in got if r["content"] == "a")["deleted_at"] is None


def test_labels(spark):
    row = spark.range(1).select(
        plans.compact_label(F.lit(3784.0)), plans.compact_label(F.lit(7500.0)), plans.compact_label(F.lit(-1.0)), plans.size_label(F.lit(1536)), plans.size_label(F.lit(3 << 40)), plans.count_label(F.lit(-1234567)),
        plans.hash_label(F.lit("0123456789abc")), plans.hash_label(F.lit("0123456789ab")), plans.elapsed_label(F.lit(125400)), plans.elapsed_label(F.lit(999)),
    ).first()
    assert list(row) == ["1h03m", "2h05m", "?", "1.5KiB", "3.0TiB", "-1,234,567", "0123456789ab…", "0123456789ab", "2m 5s", "999ms"]


def test_soft_texts(spark):
    soft = F.array(*[F.struct(F.lit(w).alias("words"), F.lit(t).alias("topic")) for w, t in (("安静", "ambience"), (" Quiet ", "ambience"), ("quiet", "ambience"), ("", "wait"), ("cheap", None))])
    row = spark.range(1).select(recall.embedding_text(F.lit(" where to eat "), soft), recall.soft_reason(soft), recall.soft_reason(F.lit(None).cast("array<struct<words:string,topic:string>>")), recall.parsed_vector(F.lit("[1.5,x]")), recall.parsed_vector(F.lit(" [1.5, -2] "))).first()
    assert row[0] == "where to eat 安静 ambience Quiet wait cheap"
    assert row[1] == "评论推断：安静（ambience）、Quiet（ambience）、wait、cheap" and row[2] == ""
    assert row[3] is None and row[4] == [1.5, -2.0]


def test_terms(spark):
    assert spark.range(1).select(memory.terms(F.lit("The the  a THE bc bcd"))).first()[0] == ["the", "bcd"]


def test_places_by_boundaries_and_whole_scores(spark):
    square = ("inside", [[[(-74.0, 40.6), (-73.9, 40.6), (-73.9, 40.7), (-74.0, 40.7), (-74.0, 40.6)]]])
    fields = {f.name: None for f in raw.PLACE.fields}
    rows = [
        fields | {"gmap_id": "a", "name": "A", "category": ["Cafe"], "latitude": 40.65, "longitude": -73.95, "description": " nice ", "MISC": '{"Popular for": ["Lunch"]}', "hours": [["Monday", "9AM-5PM"]]},
        fields | {"gmap_id": "b", "name": "B", "category": ["Cafe"], "latitude": 40.75, "longitude": -73.95},
    ]
    places = raw.curate_places(spark.createDataFrame(rows, raw.PLACE), [square])
    got = {r["gmap_id"]: r for r in importing.scored(places.withColumn("text_count", F.lit(0))).collect()}
    assert got["a"]["borough"] == "inside" and got["b"]["borough"] is None
    assert got["a"]["popular_for_tags"] == ["lunch"] and got["a"]["hours"][0]["open"] == 540
    assert got["a"]["knowledge_score"] - got["b"]["knowledge_score"] == 2.0  # description and what it is popular for

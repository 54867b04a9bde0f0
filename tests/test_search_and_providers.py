"""The hybrid search, the stored name index and provider calls on small cases written out by hand."""

import threading

import pytest
from pyspark.sql import functions as F

from larkspur.operators import name_index, providers, search
from larkspur.operators.errors import ModelConflict
from larkspur.plans import publishing

PLACES = [(1, "Red Fox", "1 Main street", "queens", 4.5, 100, 9.0, True), (2, "Red Hen", "2 Side road", "queens", 3.0, 10, 8.0, True), (3, "Blue Fox", "3 Main street", "bronx", 5.0, 5, 7.0, True), (4, "Shut", "4 Main street", "queens", 4.9, 50, 6.0, False), (5, "No rating", None, "queens", None, 0, 5.0, True)]
DOCS = [(10, 1, "s", search.PROFILE, True, [1.0, 0.0]), (11, 2, "s", search.DIGEST, True, [1.0, 0.2]), (12, 3, "s", search.DIGEST, True, [0.0, 1.0]), (13, 77, "s", search.PROFILE, True, [1.0, 0.1]), (14, 4, "s", search.PROFILE, True, [1.0, 0.0]), (15, 1, "t", search.PROFILE, True, [1.0, 0.0]), (16, 1, "s", search.PROFILE, False, [1.0, 0.0]), (17, 5, "s", search.PROFILE, True, [0.0, 0.0])]
ASKED = "query_id long, text string, borough string, min_rating double, scope string, embedding array<double>, soft array<struct<words:string,topic:string>>"


@pytest.fixture
def tables(spark):
    places = spark.createDataFrame(PLACES, "restaurant_id long, name string, address string, borough string, rating double, rating_count long, score double, is_active boolean")
    return places, spark.createDataFrame(DOCS, "document_id long, restaurant_id long, scope string, doc_type string, is_active boolean, embedding array<double>")


def test_hybrid_search(spark, tables):
    asked = [(1, "red", "queens", 4.0, "s", [1.0, 0.0], [("安静", "ambience")]), (2, None, None, None, None, None, None), (3, " main STREET ", "", 4.6, "s", None, None), (4, "zzz", None, None, "s", [1.0, 0.0], None)]
    got = {r["query_id"]: r for r in search.hybrid_search(spark.createDataFrame(asked, ASKED), *tables).collect()}
    trace = {q: {t["channel"]: tuple(t)[1:] for t in r["trace"]} for q, r in got.items()}
    assert [t["channel"] for t in got[1]["trace"]] == ["structured", "keyword", "vector", "review"]
    # the second red place is rated too low, 77 is no place, 4 is shut; of the digests one is too far away
    assert trace[1] == {"structured": (True, 1, 0, 0, 0), "keyword": (True, 2, 0, 0, 1), "vector": (True, 3, 0, 1, 1), "review": (True, 2, 1, 0, 1)}
    (only,) = got[1]["candidates"]
    assert only["restaurant_id"] == 1 and only["rank"] == 1
    assert only["reasons"] == ["满足全部硬条件（评分>=4.0、行政区=queens）（权重 1.00，贡献 0.500）", "名称/地址匹配“red”（相似度 0.500）（权重 0.50，贡献 0.250）", "评论推断：安静（ambience）；语义匹配“red”（相似度 1.000）（权重 1.00，贡献 1.000）"]
    assert got[1]["warnings"] == [search.SOFT_NOTE, "vector：1 家餐厅未知"]
    assert got[2]["candidates"] == [] and got[2]["warnings"] == [f"structured：{search.NO_CONDITIONS}", f"keyword：{search.NO_TEXT}", f"vector：{search.NO_VECTOR}", f"review：{search.NO_VECTOR}"]
    assert trace[2] == dict.fromkeys(trace[2], (False, 0, 0, 0, 0))
    # without a borough the rating alone is a condition; a shut place satisfies none
    assert trace[3]["structured"] == (True, 1, 0, 0, 0) and trace[3]["keyword"] == (True, 3, 0, 0, 2) and [c["restaurant_id"] for c in got[3]["candidates"]] == [3]
    assert [c["restaurant_id"] for c in got[4]["candidates"]] == [1, 2] and trace[4]["keyword"] == (True, 0, 0, 0, 0) and trace[4]["vector"] == (True, 3, 0, 1, 1)


def test_hybrid_search_of_nothing(spark, tables):
    places, docs = tables
    asked = spark.createDataFrame([(1, "red", "queens", 4.0, "s", [1.0, 0.0], None)], ASKED)
    assert search.hybrid_search(asked.limit(0), places, docs).count() == 0
    (row,) = search.hybrid_search(asked, places.limit(0), docs.limit(0)).collect()
    assert row["candidates"] == [] and all(t["recalled"] == 0 for t in row["trace"])


def test_names_and_hints(spark, tables, tmp_path):
    items = tables[0].select(F.col("restaurant_id").alias("id"), "name", "address", "borough")
    index = name_index.build_name_index(items, str(tmp_path))
    asked = spark.createDataFrame([(1, "fox"), (2, "MAIN st"), (3, "o"), (4, " "), (5, None), (6, "nope"), (7, "re"), (8, "x\u00001")], "query_id long, text string")
    got = {}
    for r in name_index.name_hits(spark, index, asked, 10).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    assert got == {1: {1, 3}, 2: {1, 3, 4}, 3: {1, 2, 3, 5}, 7: {1, 2, 3, 4}}  # what crosses from the name to the address is in neither
    named = spark.createDataFrame([(1, "fox", None, None), (2, "fox", " QUEENS ", ""), (3, "fox", None, "3 MAIN"), (4, "fox", "bronx", "side"), (5, "red fox", None, None)], "query_id long, text string, borough_hint string, address_hint string")
    found = {r["query_id"]: (r["status"], r["id"]) for r in name_index.resolve_in_index(spark, index, named, least=0.4).collect()}
    assert found == {1: ("ambiguous", 1), 2: ("resolved", 1), 3: ("resolved", 3), 4: ("not_found", None), 5: ("resolved", 1)}
    plan = name_index.name_hits(spark, index, asked.limit(1), 3)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_a_provider_loses_only_the_rows_it_fails_for(spark):
    def provider(texts):
        if any("bad" in t for t in texts):
            raise ValueError("secret request")
        return [[float(len(t)), 1.0] if "short" not in t else [1.0] for t in texts]

    rows = [(i, "bad" if i % 17 == 0 else "short" if i % 13 == 5 else f"text {i}") for i in range(100)] + [(100, None), (101, "  ")]
    table = spark.createDataFrame(rows, "id long, t string").withColumn("_made", F.lit(1))
    got = {r["id"]: r for r in providers.embed_guarded(table, "t", 2, provider, batch=8, at_once=3).collect()}
    assert len(got) == 102 and got[0]["_made"] == 1
    for i, text in rows:
        want = "blank" if not (text or "").strip() else "ValueError" if text == "bad" else "dimension" if text == "short" else None
        assert got[i]["embedding_error"] == want and (got[i]["embedding"] is None) == (want is not None), i
    assert got[1]["embedding"] == [6.0, 1.0]


def test_tries_counts_and_pace():
    calls, now, slept = [], [0.0], []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise TimeoutError
        return [[0.5]] * len(texts)

    pace = providers.Pace(2.0, clock=lambda: now[0], sleep=slept.append)
    assert providers.called(flaky, ["a", "b", "c"], 1, pace, tries=2) == [([0.5], None)] * 3 and calls == [3, 3] and slept == [0.5]
    assert providers.called(lambda texts: [], ["a", "b"], 1, providers.Pace(None), 1) == [(None, "count")] * 2
    seen, running, most = threading.Lock(), [0], [0]

    def counted(texts):
        with seen:
            running[0] += 1
            most[0] = max(most[0], running[0])
        with seen:
            running[0] -= 1
        return [[1.0] for _ in texts]

    assert len(providers.called(counted, ["x"] * 5, 1, providers.Pace(None), 1)) == 5 and most[0] == 1


def test_publishing_under_another_model(spark):
    kinds = "document_id long, restaurant_id long, doc_type string, content string, content_hash string, version int, embedding array<float>, is_active boolean, embedding_model string, embedding_dimensions int"
    stored = spark.createDataFrame([(1, 1, "profile", "old", "h", 1, [1.0, 0.0], True, "m1", 2), (2, 2, "profile", "old", "g", 1, [1.0, 0.0], True, "m1", 2)], kinds)
    built = spark.createDataFrame([(1, "profile", "new"), (3, "profile", "bad")], "restaurant_id long, doc_type string, content string")

    def provider(texts):
        if "bad" in texts:
            raise RuntimeError
        return [[0.6, 0.8] for _ in texts]

    with pytest.raises(ModelConflict):
        publishing.publish(stored, built, "evidence", 2, provider, model="m2")
    done = {(r["restaurant_id"], r["version"]): r for r in publishing.publish(stored, built, "evidence", 2, provider, model="m2", force=True).collect()}
    assert {k: r["is_active"] for k, r in done.items()} == {(1, 1): False, (2, 1): False, (1, 2): True, (3, 1): False}
    assert done[1, 2]["embedding_model"] == "m2" and done[3, 1]["embedding"] is None
    same = publishing.publish(stored, built, "evidence", 2, provider, model="m1").where("is_active").collect()
    assert {(r["restaurant_id"], r["version"]) for r in same} == {(1, 2), (2, 1)}

"""Refusals, ties and folds on hand-made rows."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from larkspur.functions import geo, interpret, text, vector
from larkspur.operators import errors, evidence, filters, lifecycle, plans, ranking, state
from larkspur.sources import raw
from larkspur.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_refusals():
    with pytest.raises(errors.EmptyFilter):
        filters.hard_filter(None, filters.PlaceFilter())
    with pytest.raises(errors.EmptyQuery):
        filters.text_pattern("  ")
    with pytest.raises(errors.ShortQuery):
        filters.text_pattern("ab")
    with pytest.raises(errors.MissingScope):
        ranking.vector_hits(None, None, [], 5)
    with pytest.raises(errors.BudgetExceeded):
        evidence.check_budget(23)
    assert evidence.check_budget(24) == 24 and evidence.check_budget(0) == 2000
    for bad in (filters.PlaceFilter(borough="mars"), filters.PlaceFilter(price_levels=(5,)), filters.PlaceFilter(min_rating=6), filters.PlaceFilter(max_metres=-1), filters.PlaceFilter(point=(99, 0))):
        with pytest.raises(errors.Refused):
            bad.validate()
    with pytest.raises(errors.Refused):
        lifecycle.check_positions([1, 1])


def test_limits_and_cursor(spark):
    assert [filters.clamp_limit(x) for x in (0, -1, 7, 500)] == [10, 10, 7, 100]
    assert filters.channel_depth("structured", 100) == 500 and filters.channel_depth("vector", 5) == 50
    code = spark.createDataFrame([(7, "é/?")], "id int, name string").select(filters.encode_cursor("id", "name").alias("c")).first()["c"]
    assert filters.decode_cursor(code) == {"id": 7, "name": "é/?"} and "=" not in code


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, text.collapse_spaces(lit(" a \n b "))) == "a b"
    assert one(spark, text.slug(lit("Tex-Mex & Co/ é"))) == "tex_mex_co"
    assert [one(spark, text.price_level(lit(x))) for x in ("$", " $$$$ ", "$$$$$", "$5", "")] == [1, 4, None, None, None]
    assert one(spark, text.topics(lit("the PRICE was $5"))) == ["value"] and one(spark, text.topics(lit("price"))) == ["value"]
    assert one(spark, text.topics(lit("only $"))) == []
    assert one(spark, text.layout_text(lit("a  \r\nb\n\n\n\n\nc\t"))) == "a\nb\n\n\nc"
    assert one(spark, text.scrub(lit("me@x.io +1 (212) 555-0199\x07\n"))) == "[redacted-email] [redacted-phone]\n"
    assert not one(spark, text.is_food_place(F.array(lit("Barber shop"), lit("Public library")))) and one(spark, text.is_food_place(F.array(lit("Bar & Grill"))))
    assert [one(spark, text.one_decimal(lit(x))) for x in (4.25, 0.15, 1234.5)] == ["4.2", "0.1", "1234.5"]
    assert one(spark, text.token_estimate(lit("ab"))) == 1 and one(spark, text.token_estimate(lit("金金abcd"))) == 3


def test_vectors_and_points(spark):
    assert round(one(spark, vector.trigram_similarity(F.lit("word"), F.lit("two words"))), 6) == 0.363636
    assert one(spark, vector.similarity(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-1.0), F.lit(0.0)))) == 0
    assert not one(spark, geo.valid_point(F.lit(0.0), F.lit(0.0))) and not one(spark, geo.valid_point(F.lit(None).cast("double"), F.lit(1.0)))
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]
    inside = lambda lat, lon: one(spark, geo.in_polygon(F.lit(lat), F.lit(lon), [ring, hole]))
    assert inside(3.0, 3.0) and not inside(1.5, 1.5) and not inside(5.0, 1.0)


def test_hours_and_references():
    assert interpret.interval("6PM to 2AM") == (1080, 1560, False) and interpret.interval("12AM-12PM") == (0, 720, False)
    assert interpret.interval("Closed") == (0, 0, True) and interpret.interval("Open 24 hours") == (0, 1440, False)
    assert interpret.interval("") is None and interpret.interval("25-26") is None and interpret.clock_minute("noon") == 720
    assert interpret.soft_matches("Quiet, date night! quiet") == [("quiet", "ambience"), ("date night", "ambience")]


def doc(i, kind, score, cost):
    return {"restaurant_id": 1, "document_id": i, "doc_type": kind, "score": score, "cost": cost}


def test_greedy_budget_skips_and_floor():
    rows = [doc(1, "a", 0.9, 20), doc(2, "a", 0.8, 15), doc(3, "a", 0.7, 10)]
    assert [r["document_id"] for r in evidence.assemble_rows(rows, 30)] == [1, 3]
    assert evidence.assemble_rows([doc(1, "a", 0.9, 40), doc(2, "a", 0.8, 50)], 30) == []
    floor = [doc(1, "a", 0.9, 12), doc(2, "a", 0.8, 12), doc(3, "b", 0.1, 10)]
    assert [r["document_id"] for r in evidence.assemble_rows(floor, 30)] == [1, 3]
    assert [r["document_id"] for r in evidence.assemble_rows([doc(1, "a", 0.9, 12), doc(2, "a", 0.8, 12), doc(3, "b", 0.1, 99)], 30)] == [1, 2]


def test_sample_targets_and_quotas(spark):
    assert [one(spark, evidence.sample_target(F.lit(n))) for n in (4, 50, 150, 1000)] == [4, 10, 15, 30]
    rows = [(i, 1, rating, f"t{i}", i) for i, rating in enumerate([1] * 10 + [3] * 10 + [5] * 10)]
    df = spark.createDataFrame(rows, "id int, restaurant_id int, rating int, text string, day int").withColumn("reviewed_at", F.timestamp_seconds("day"))
    got = {r["band"]: r["n"] for r in evidence.representative(df).groupBy("band").agg(F.count("*").alias("n")).collect()}
    assert got == {"negative": 4, "neutral": 3, "positive": 3}


def test_fusion_cases(spark):
    pool = spark.createDataFrame([(0, i, 1.0) for i in (1, 2, 3)], "query_id int, restaurant_id int, prior double")
    flat = spark.createDataFrame([(0, "keyword", i, 0.7) for i in (1, 2, 3)] + [(0, "keyword", 1, 0.7), (0, "keyword", 9, 0.7)], "query_id int, channel string, restaurant_id int, score double")
    assert {r["normalized"] for r in ranking.channel_scores(flat, pool).collect()} == {0.5}
    assert [r["restaurant_id"] for r in ranking.fuse(flat, pool).orderBy("rank").collect()] == [1, 2, 3]  # ties: lower id first
    assert [r["restaurant_id"] for r in ranking.unknown_hits(flat, pool).collect()] == [9]
    ranked = ranking.fuse(flat, pool)
    order = spark.createDataFrame([(0, [3, 1, 2])], "query_id int, ids array<int>")
    assert [r["restaurant_id"] for r in ranking.apply_rerank(ranked, order).orderBy("rank").collect()] == [3, 1, 2]
    bad = spark.createDataFrame([(0, [3, 1])], "query_id int, ids array<int>")
    assert [r["restaurant_id"] for r in ranking.apply_rerank(ranked, bad).orderBy("rank").collect()] == [1, 2, 3]


def test_resolution(spark):
    rows = [(1, 10, 0.80), (1, 11, 0.75), (2, 10, 0.80), (2, 11, 0.60), (3, 10, 0.5), (4, None, None)]
    got = {r["query_id"]: r["status"] for r in ranking.resolve_names(spark.createDataFrame(rows, "query_id int, id int, score double")).collect()}
    assert got == {1: "ambiguous", 2: "resolved", 3: "not_found", 4: "not_found"}


def test_holds_and_versions(spark):
    requests = spark.createDataFrame([(1, i, i, n) for i, n in enumerate((6, 3, 2, -9, 8))], "slot_id long, request_id long, at long, size long")
    got = [(r["granted"], r["booked"]) for r in state.hold_capacity(requests, 8).orderBy("request_id").collect()]
    assert got == [(True, 6), (False, 6), (True, 8), (True, 0), (True, 8)]
    current = spark.createDataFrame([(1, 2)], "t int, version int")
    after, conflicts = lifecycle.guard_versions(current, current, "t", "version")
    assert after.collect() == [(1, 2)] and conflicts.count() == 1
    history = spark.createDataFrame([("g", 3)], "g string, version int")
    batch = spark.createDataFrame([("g", 1), ("g", 2)], "g string, ord int")
    assert sorted(r["version"] for r in lifecycle.assign_versions(history, batch, ["g"], "ord").collect()) == [4, 5]


def test_memories(spark):
    current = spark.sql("SELECT 5L AS memory_id, 1 AS user_id, 'fact' AS type, 'x' AS content, 0.8D AS confidence, TIMESTAMP '2020-01-01' AS created_at, TIMESTAMP '2020-01-01' AS updated_at, TIMESTAMP '2020-02-01' AS deleted_at")
    new = spark.sql("SELECT * FROM VALUES (1, 'fact', 'x', TIMESTAMP '2021-01-01'), (1, 'constraint', 'y', TIMESTAMP '2021-01-01') AS t(user_id, type, content, at)")
    got = {r["content"]: r for r in lifecycle.save_memories(current, new).collect()}
    assert got["x"]["memory_id"] == 5 and got["x"]["deleted_at"] is None and got["x"]["updated_at"].year == 2021 and got["x"]["created_at"].year == 2020
    assert got["y"]["memory_id"] > 5 and got["y"]["confidence"] == 1.0


def test_model_guard(spark):
    docs = spark.createDataFrame([(True, "m1", 64), (False, "m2", 64)], "is_active boolean, embedding_model string, embedding_dimensions int")
    lifecycle.check_model(docs, "m1", 64)
    with pytest.raises(errors.ModelConflict):
        lifecycle.check_model(docs, "m2", 64)
    lifecycle.check_model(docs, "m2", 64, force=True)


def test_plans():
    plan = plans.normalise(plans.Plan(filters.PlaceFilter(borough="SoHo", cuisines=("quiet", "thai"), min_rating=7)))
    assert plan.wanted == filters.PlaceFilter(neighborhood="SoHo", cuisines=("thai",), min_rating=5.0) and plan.soft == (("quiet", "ambience"),) and len(plan.warnings) == 3
    assert plans.fill(filters.PlaceFilter(min_rating=3), filters.PlaceFilter(min_rating=4, borough="bronx")) == (filters.PlaceFilter(min_rating=3, borough="bronx"), ["borough"])
    assert plans.union_soft([("Quiet", "a")], [("quiet", "a"), ("quiet", "b")]) == (("Quiet", "a"), ("quiet", "b"))
    schema = {"properties": {"n": {"type": "integer"}, "k": {"type": "string", "enum": ["a"]}}, "required": ["n"]}
    plans.check_arguments(schema, {"n": 1, "k": "a"})
    for bad in ({}, {"n": True}, {"n": 1, "z": 2}, {"n": 1, "k": "b"}):
        with pytest.raises(errors.Refused):
            plans.check_arguments(schema, bad)


def test_embedding_port(spark):
    got = plans.embed(spark.createDataFrame([("a",), ("a",), (None,)], "t string"), "t", 8).collect()
    assert got[0]["embedding"] == got[1]["embedding"] != got[2]["embedding"] and abs(sum(x * x for x in got[0]["embedding"]) - 1) < 1e-5


def test_raw_places(spark, tmp_path):
    good = {"gmap_id": "g1", "name": " Joe ", "category": ["Pizza restaurant"], "latitude": 40.7, "longitude": -73.95, "price": "$$", "num_of_reviews": 9998, "MISC": {"Service options": ["Takeout", None], "Crowd": "Family-friendly", "Odd": {"a": 1}}}
    rows = [good, good | {"gmap_id": " "}, good | {"category": ["Barber shop"]}, good | {"latitude": 0, "longitude": 0}, good | {"latitude": 10.0}, good | {"name": " "}]
    path = tmp_path / "meta.json.gz"
    with gzip.open(path, "wt") as f:
        f.write("\n".join([json.dumps(r) for r in rows] + ["{broken", "", "   "]))
    scanned = raw.scan_lines(spark, str(path), raw.PLACE)
    assert raw.rejected(scanned).count() == 1 and raw.accepted(scanned).count() == 6
    assert raw.scan_lines(spark, str(path), raw.PLACE, limit=2).count() == 2
    got = raw.curate_places(raw.accepted(scanned)).collect()
    assert [(r["outcome"], r["reason"]) for r in got] == [("accept", None), ("reject", "missing_id"), ("filter", "not_food"), ("reject", "coordinates"), ("filter", "outside_area"), ("reject", "missing_name")]
    first = got[0]
    assert first["name"] == "Joe" and first["price_level"] == 2 and first["source_review_count_capped"] and first["borough"] == "manhattan" and first["cuisine_tags"] == ["pizza", "italian"]
    assert first["tri_states"]["takeout"] == "true" and first["tri_states"]["good_for_kids"] == "true" and first["tri_states"]["delivery"] == "unknown" and first["service_option_tags"] == ["takeout"]


def test_raw_reviews(spark, tmp_path):
    rows = [("u", "n", 1500000000000, 5, "  Great food, call 212-555-0199 ", "g"), ("u", "n", 1500000000000, 0, None, "g"), ("u", "n", 1893456000000, 4, "x", "g"), ("u", "n", 0, 4, "x", "g"), ("u", "n", 1, 4, "x", "")]
    got = raw.curate_reviews(spark.createDataFrame(rows, raw.REVIEW), 3).collect()
    assert [r["reason"] for r in got] == [None, "rating", "time_range", "time", "missing_id"]
    assert got[0]["text"] == "Great food, call [redacted-phone]" and got[0]["topic_tags"] == ["food"] and "user_id" not in got[0].asDict() and got[1]["text"] == ""
    ids = spark.createDataFrame([("g",), ("g",)], "gmap_id string")
    kept = raw.prefilter(spark.createDataFrame(rows, raw.REVIEW), ids)
    assert kept.count() == 4
    raw.write_lines(kept, str(tmp_path / "out"))
    assert spark.read.schema(raw.REVIEW).json(str(tmp_path / "out")).count() == 4


def test_boundaries(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2]]
    path = tmp_path / "areas.json"
    path.write_text(json.dumps([{"boroname": "Staten Island", "the_geom": {"type": "MultiPolygon", "coordinates": [[square, [[0, 0], [1, 1]]]]}}, {"boroname": "Bronx", "the_geom": {"type": "Polygon", "coordinates": [square]}}]))
    areas = raw.load_boundaries(spark, str(path))
    assert [(n, len(p), len(p[0])) for n, p in areas] == [("staten_island", 1, 1), ("bronx", 1, 1)]
    assert one(spark, geo.area_by_polygon(F.lit(1.0), F.lit(1.5), areas)) == "staten_island"
    checksum = raw.file_checksums(spark, str(path)).first()["sha256"]
    raw.load_boundaries(spark, str(path), checksum)
    with pytest.raises(errors.Refused):
        raw.load_boundaries(spark, str(path), "0" * 64)


def test_stream_twins(spark, tmp_path):
    rows = [(i % 3, i, (i * 7) % 11, (i % 5) - 1) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, n long, v long, s long")
    df.select("k", "n", "v", "s").orderBy("n").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: streams.read_stream(spark, str(tmp_path / "in"))
    streams.run_to(streams.guarded_versions(source().select(F.col("k").alias("thread"), F.col("v").alias("version"), F.col("n").alias("at"))), str(tmp_path / "v"), str(tmp_path / "cv"))
    batch = lifecycle.replay_versions(df, "k", "v", "n").select("k", "v", "accepted")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "v")).collect())) == sorted(map(tuple, batch.collect()))
    holds = lambda d: d.select(F.col("k").alias("slot_id"), F.col("n").alias("request_id"), F.col("n").alias("at"), F.col("s").alias("size"))
    streams.run_to(streams.capacity_holds(holds(source()), 5), str(tmp_path / "h"), str(tmp_path / "ch"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "h")).collect())) == sorted(map(tuple, state.hold_capacity(holds(df), 5).collect()))
    events = source().select("k", F.timestamp_seconds(F.col("n") * 30).alias("ts"))
    streams.run_to(streams.first_confirmations(events, "k", "ts", "1 hour"), str(tmp_path / "f"), str(tmp_path / "cf"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 3
    streams.run_to(streams.windowed_counts(events, "ts", "5 minutes", "1 minute", "k"), str(tmp_path / "w"), str(tmp_path / "cw"))
    assert spark.read.parquet(str(tmp_path / "w")).count() > 0

import gzip
import json

from larkspur.plans import importing


def dump(path, rows, *more):
    with gzip.open(path, "wt") as f:
        f.write("\n".join([*map(json.dumps, rows), *more]))


def test_import(spark, tmp_path):
    base = {"category": ["Thai restaurant"], "latitude": 40.7, "longitude": -73.95, "avg_rating": 4.5}
    places = [{"gmap_id": f"g{i}", "name": f"P{i}", "address": "x"} | base for i in range(5)]
    places += [{"gmap_id": "g0", "name": "P0 new"} | base, {"gmap_id": "g9", "name": "Lib", "category": ["Library"]}, {"gmap_id": "gc", "name": "Shut", "state": "Permanently closed"} | base]
    at = 1500000000000
    reviews = [{"user_id": f"u{k}", "time": at + k, "rating": 1 + k % 5, "text": f"good food {k}", "gmap_id": f"g{i}"} for i in range(3) for k in range(4)]
    reviews += [reviews[0], reviews[0] | {"gmap_id": "nowhere"}, reviews[0] | {"rating": 9}, reviews[1] | {"text": None}]
    dump(tmp_path / "p.json.gz", places, "{bad")
    dump(tmp_path / "r.json.gz", reviews)
    for _ in range(2):  # a second run gives the same tables
        importing.import_all(spark, str(tmp_path / "p.json.gz"), str(tmp_path / "r.json.gz"), str(tmp_path / "out"))
        got = {r["gmap_id"]: r for r in spark.read.parquet(str(tmp_path / "out/places")).collect()}
        assert set(got) == {"g0", "g1", "g2", "g3", "g4", "gc"} and got["g0"]["name"] == "P0 new" and got["g0"]["address"] == ""
        assert got["g1"]["stored_count"] == 4 and got["g0"]["stored_count"] == 5 and got["g0"]["text_count"] == 4 and got["g4"]["stored_count"] == 0
        assert got["gc"]["knowledge_score"] == -100 and not got["gc"]["is_active"] and all(got[f"g{i}"]["is_active"] for i in range(5))
        assert got["g1"]["knowledge_score"] > got["g4"]["knowledge_score"] and got["g1"]["source_avg"] == 4.5
        audit = {(r["stage"], r["outcome"], r["reason"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out/audit")).collect()}
        assert audit == {
            ("places", "accept", None): 7, ("places", "filter", "not_food"): 1, ("places", "reject", "decode_error"): 1,
            ("reviews", "accept", None): 14, ("reviews", "unmatched", None): 1, ("reviews", "reject", "rating"): 1,
        }
        ids = {r["gmap_id"]: r["restaurant_id"] for r in got.values()}
        assert ids == {r["gmap_id"]: r["restaurant_id"] for r in spark.read.parquet(str(tmp_path / "out/places_curated")).collect()}

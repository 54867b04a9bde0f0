"""Searches, joins, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import geo
from larkspur.operators import filters as P
from larkspur.plans.registry import query
from larkspur.sources.tables import KDOCS, PLACES, REVIEWS, events, kdocs, load, places, reviews

#: What stands for boroughs in these tables.
REGIONS = ("africa", "america", "asia", "europe", "middle east")
WANTED = P.PlaceFilter(borough=" Asia ", cuisines=("building", "machinery"), price_levels=(1, 2, 3), min_rating=2.0)


@query(f"""WITH {PLACES} SELECT restaurant_id, name, score FROM places WHERE is_active AND borough = 'asia' AND list_has_any(cuisines, ['building', 'machinery'])
AND price_level IN (1, 2, 3) AND rating >= 2.0 ORDER BY score DESC, restaurant_id LIMIT 10""")
def hard_filter_topk(spark, sf):
    return P.top_places(places(spark, sf), WANTED, areas=REGIONS).select("restaurant_id", "name", "score")


@query(f"""WITH {PLACES} SELECT restaurant_id, address, score FROM places WHERE is_active AND contains(lower(address), 'n_7 street 1') ORDER BY score DESC, restaurant_id LIMIT 100""")
def neighborhood_filter(spark, sf):
    return P.top_places(places(spark, sf), P.PlaceFilter(neighborhood="N_7 Street 1"), 500).select("restaurant_id", "address", "score")


@query("""SELECT p_partkey, name FROM (SELECT p_partkey, p_name || CASE WHEN p_partkey % 5 = 0 THEN ' 50% off_it' WHEN p_partkey % 5 = 1 THEN ' 50x offxit' ELSE '' END AS name FROM part)
WHERE name ILIKE '%50/% off/_%' ESCAPE '/'""")
def ilike_escaped_match(spark, sf):
    extra = F.when(F.col("p_partkey") % 5 == 0, " 50% off_it").when(F.col("p_partkey") % 5 == 1, " 50x offxit").otherwise("")
    named = load(spark, sf, "part").select("p_partkey", F.concat("p_name", extra).alias("name"))
    return named.where(F.expr(f"name ILIKE '{P.text_pattern('50% OFF_')}' ESCAPE '/'"))


@query("""SELECT state, count(*) AS n FROM (SELECT coalesce(json_extract_string(CASE WHEN event_id % 3 = 0 THEN '{}' ELSE props END, '$.k'), 'unknown') AS state FROM events) GROUP BY state""")
def json_flag_three_state(spark, sf):
    props = F.when(F.col("event_id") % 3 == 0, "{}").otherwise(F.col("props"))
    return events(spark, sf).select(P.flag_state(props, "k").alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND event_type = 'view' AND json_extract_string(props, '$.k') IN ('7', '69')""")
def json_key_filter(spark, sf):
    key = F.get_json_object("props", "$.k")
    return events(spark, sf).where(key.isNotNull() & (F.col("event_type") == "view") & key.isin("7", "69")).select("event_id", key.cast("long").alias("k"))


@query("""SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'ring'])""")
def array_any_of(spark, sf):
    return load(spark, sf, "part").where(F.arrays_overlap(F.split("p_name", " "), F.array(F.lit("red"), F.lit("ring")))).select("p_partkey")


@query("""SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS DISTINCT FROM 1""")
def null_safe_model_diff(spark, sf):
    joined = load(spark, sf, "documents").select("doc_id").join(load(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.where(~F.col("quality").eqNullSafe(1)).select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("""SELECT doc_id, has_label, preview FROM (SELECT d.doc_id, l.doc_id IS NOT NULL AS has_label, CASE WHEN d.doc_id % 2 = 0 THEN left(d.text, 16) END AS preview
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id)""")
def facet_and_preview(spark, sf):
    labelled = load(spark, sf, "labels").select("doc_id").distinct().withColumn("_l", F.lit(True))
    joined = load(spark, sf, "documents").select("doc_id", "text").join(labelled, "doc_id", "left")
    return joined.select("doc_id", F.col("_l").isNotNull().alias("has_label"), F.when(F.col("doc_id") % 2 == 0, F.left("text", F.lit(16))).alias("preview"))


_HAVERSINE = """2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(40.7 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40.7)) * pow(sin(radians(-74.0 - lon) / 2), 2))))"""


@query(f"""WITH {PLACES} SELECT restaurant_id, round({_HAVERSINE}, 3) AS metres FROM places WHERE is_active AND {_HAVERSINE} <= 9000""")
def haversine_within(spark, sf):
    found = P.hard_filter(places(spark, sf), P.PlaceFilter(point=(40.7, -74.0), max_metres=9000))
    return found.select("restaurant_id", F.round(geo.distance_m(F.col("lat"), F.col("lon"), F.lit(40.7), F.lit(-74.0)), 3).alias("metres"))


@query(f"""WITH {PLACES} SELECT restaurant_id, CASE WHEN lat BETWEEN 40.49 AND 40.65 AND lon BETWEEN -74.26 AND -74.05 THEN 'staten_island'
WHEN lat BETWEEN 40.78 AND 40.92 AND lon BETWEEN -73.94 AND -73.74 THEN 'bronx' WHEN lat BETWEEN 40.68 AND 40.88 AND lon BETWEEN -74.02 AND -73.90 THEN 'manhattan'
WHEN lat BETWEEN 40.55 AND 40.74 AND lon BETWEEN -74.05 AND -73.83 THEN 'brooklyn' WHEN lat BETWEEN 40.54 AND 40.81 AND lon BETWEEN -73.96 AND -73.70 THEN 'queens' END AS area,
lat BETWEEN 40.49 AND 40.93 AND lon BETWEEN -74.26 AND -73.68 AS served FROM places""")
def area_by_box(spark, sf):
    lat, lon = F.col("lat"), F.col("lon")
    return places(spark, sf).where(geo.valid_point(lat, lon)).select("restaurant_id", geo.area_by_box(lat, lon).alias("area"), geo.in_box(lat, lon, *geo.SERVICE_AREA).alias("served"))


AREAS = [
    ("west", [[[(-74.3, 40.4), (-74.0, 40.5), (-73.95, 40.8), (-74.25, 40.9)], [(-74.2, 40.6), (-74.1, 40.6), (-74.1, 40.7), (-74.2, 40.7)]]]),
    ("east", [[[(-74.05, 40.45), (-73.6, 40.45), (-73.6, 40.95), (-74.05, 40.95)]]]),
]
_EDGES = ", ".join(
    f"('{name}', {a}, {r}, {x0}, {y0}, {x1}, {y1})" for a, (name, polygons) in enumerate(AREAS) for rings in polygons for r, ring in enumerate(rings)
    for (x0, y0), (x1, y1) in zip([ring[-1], *ring[:-1]], ring, strict=True)
)


@query(f"""WITH {PLACES}, edges(name, a, r, x0, y0, x1, y1) AS (VALUES {_EDGES}),
crossed AS (SELECT restaurant_id, a, r, any_value(edges.name) AS name, count(*) FILTER (WHERE (y1 > lat) <> (y0 > lat) AND x0 + (lat - y0) / nullif(y1 - y0, 0) * (x1 - x0) > lon) % 2 = 1 AS inside
  FROM places, edges GROUP BY restaurant_id, a, r),
held AS (SELECT restaurant_id, a, any_value(name) AS name FROM crossed GROUP BY restaurant_id, a HAVING bool_or(inside AND r = 0) AND NOT bool_or(inside AND r > 0))
SELECT p.restaurant_id, arg_min(h.name, h.a) AS area FROM places p LEFT JOIN held h ON p.restaurant_id = h.restaurant_id GROUP BY p.restaurant_id""")
def point_in_polygon(spark, sf):
    return places(spark, sf).select("restaurant_id", geo.area_by_polygon(F.col("lat"), F.col("lon"), AREAS).alias("area"))


@query("""SELECT doc_id, source FROM documents SEMI JOIN labels USING (doc_id)""")
def semi_join_prefilter(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "source").join(load(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


@query("""SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)""")
def anti_join_unmatched(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "source").join(load(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT coalesce(c_mktsegment, 'unmatched') AS segment, count(*) AS n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey GROUP BY 1""")
def id_map_left_join(spark, sf):
    known = load(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    joined = load(spark, sf, "orders").select("o_custkey").join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy(F.coalesce("c_mktsegment", F.lit("unmatched")).alias("segment")).agg(F.count("*").alias("n"))


@query("""WITH lists AS (SELECT conv_id % 10 AS g, list(DISTINCT conv_id) AS ids FROM conversations GROUP BY 1), un AS (SELECT g, unnest(ids) AS id FROM lists)
SELECT g, conv_id, turn, role FROM un JOIN conversations c ON c.conv_id = un.id""")
def array_membership_join(spark, sf):
    talks = load(spark, sf, "conversations")
    lists = talks.groupBy((F.col("conv_id") % 10).alias("g")).agg(F.collect_set("conv_id").alias("ids"))  # stands for a table of id lists
    return lists.select("g", F.explode("ids").alias("conv_id")).join(talks.select("conv_id", "turn", "role"), "conv_id").select("g", "conv_id", "turn", "role")


@query("""SELECT pos, p_partkey, p_name FROM (SELECT unnest([7, 3, 900, 11, 3]) AS k, unnest([1, 2, 3, 4, 5]) AS pos) JOIN part ON p_partkey = k""")
def ordered_lookup(spark, sf):
    wanted = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in (7, 3, 900, 11, 3)])).alias("pos", "k"))
    part = load(spark, sf, "part").where(F.col("p_partkey").isin(7, 3, 900, 11))
    return part.join(F.broadcast(wanted), F.col("p_partkey") == F.col("k")).select((F.col("pos") + 1).alias("pos"), "p_partkey", "p_name").orderBy("pos")


@query("""SELECT event_id, event_type FROM events WHERE event_id < 5000 ORDER BY event_id DESC LIMIT 21""")
def keyset_page(spark, sf):
    return P.keyset_page(events(spark, sf).select("event_id", "event_type"), "event_id", 5000, 20)


@query("""SELECT user_id, event_id FROM events WHERE (user_id, event_id) < (75, 5000) ORDER BY user_id DESC, event_id DESC LIMIT 26""")
def composite_keyset(spark, sf):
    return P.composite_page(events(spark, sf).select("user_id", "event_id"), "user_id", "event_id", (75, 5000), 25)


@query("""SELECT conv_id, turn FROM conversations WHERE turn < 3 OR (turn = 3 AND conv_id > 40) ORDER BY turn DESC, conv_id LIMIT 31""")
def mixed_keyset(spark, sf):
    return P.mixed_page(load(spark, sf, "conversations").select("conv_id", "turn"), "turn", "conv_id", (3, 40), 30)


@query("""SELECT event_id, has_more FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n, count(*) OVER () > 15 AS has_more
FROM (SELECT event_id FROM events WHERE event_type = 'error' AND user_id = 8 ORDER BY event_id LIMIT 16)) WHERE n <= 15""")
def truncated_list(spark, sf):
    rows = P.optional_filters(events(spark, sf), event_type="error", user_id=8, value=None).select("event_id").orderBy("event_id").limit(16)
    return P.with_more(rows, [F.col("event_id")], 15)


@query("""SELECT * FROM (SELECT turn, role FROM conversations WHERE conv_id = 0 AND turn < 5 ORDER BY turn DESC LIMIT 3) ORDER BY turn""")
def tail_page_ascending(spark, sf):
    return P.tail_page(load(spark, sf, "conversations").where("conv_id = 0").select("turn", "role"), "turn", 5, 3)


@query(f"""WITH {PLACES} SELECT restaurant_id, score FROM places ORDER BY score DESC, restaurant_id LIMIT 20 OFFSET 40""")
def offset_window(spark, sf):
    return places(spark, sf).select("restaurant_id", "score").orderBy(F.col("score").desc(), "restaurant_id").offset(40).limit(20)


@query("""SELECT user_id, rtrim(translate(to_base64(encode('{"user_id":' || user_id || ',"event_type":"' || event_type || '"}')), '+/', '-_'), '=') AS cursor FROM events""")
def cursor_codes(spark, sf):
    return events(spark, sf).select("user_id", P.encode_cursor("user_id", "event_type").alias("cursor"))


@query(f"""WITH {REVIEWS} SELECT id, restaurant_id, rating, reviewed_at FROM reviews WHERE restaurant_id = 30 ORDER BY reviewed_at DESC, id LIMIT 50""")
def review_listing(spark, sf):
    return P.lookup(reviews(spark, sf), "restaurant_id", 30).select("id", "restaurant_id", "rating", "reviewed_at").orderBy(F.col("reviewed_at").desc(), "id").limit(50)


@query(f"""WITH {KDOCS} SELECT document_id, scope FROM kdocs WHERE document_id % 3 = 0 ORDER BY document_id LIMIT 25""")
def pending_queue(spark, sf):
    docs = kdocs(spark, sf).withColumn("embedding", F.when(F.col("document_id") % 3 != 0, F.col("embedding")))
    return docs.where(F.isnull("embedding")).orderBy("document_id").limit(25).select("document_id", "scope")


@query(f"""WITH {PLACES}, q AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 20 = 0), pool AS (SELECT query_id, p.* FROM q JOIN places p ON p.restaurant_id % 40 = query_id % 40)
SELECT query_id, count(*) FILTER (WHERE NOT coalesce(borough = 'asia' AND list_has_any(cuisines, ['building', 'machinery']) AND price_level IN (1, 2, 3) AND rating >= 2.0, false)) AS removed FROM pool GROUP BY 1""")
def pool_post_filter(spark, sf):
    asked = kdocs(spark, sf).where("document_id % 20 = 0").select(F.col("document_id").alias("query_id"), (F.col("document_id") % 40).alias("_g"))
    pool = places(spark, sf).withColumn("_g", F.col("restaurant_id") % 40).join(asked, "_g").drop("_g")
    return P.post_filter(pool, WANTED)[1]

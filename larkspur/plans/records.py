"""Queries of audit and run records, marks, pages and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import records as R
from larkspur.plans.registry import query
from larkspur.sources.tables import REVIEWS, TEXTS, events, load, reviews, texts


@query("""SELECT source AS batch_id, CASE WHEN source LIKE '%1%' THEN 9 ELSE count(*) FILTER (WHERE n_chars >= 500) END AS accepted, CASE WHEN source LIKE '%1%' THEN 1 ELSE count(*) FILTER (WHERE n_chars < 500) END AS rejected,
CASE WHEN source LIKE '%1%' THEN 'partial' ELSE 'success' END AS status, NOT (source LIKE '%1%') AS ended FROM documents WHERE source IS NOT NULL GROUP BY source UNION ALL SELECT 'lost', 0, 0, 'failed', true""")
def batch_lifecycle(spark, sf):
    docs = load(spark, sf, "documents").where("source IS NOT NULL")
    at = F.lit("2024-01-01").cast("timestamp")
    sources = docs.select(F.col("source").alias("batch_id")).distinct()
    old = sources.where(F.contains("batch_id", F.lit("1"))).select("batch_id", F.lit("s").alias("source"), at.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit("partial").alias("status"), F.lit(9).cast("long").alias("accepted"), F.lit(1).cast("long").alias("rejected"))
    begun = R.started_batches(old, sources.unionByName(spark.createDataFrame([("lost",)], "batch_id string")).select("batch_id", F.lit("s").alias("source"), at.alias("started_at")))
    judged = docs.select(F.col("source").alias("batch_id"), F.when(F.col("n_chars") >= 500, "accept").otherwise("reject").alias("outcome"))
    return R.finished_batches(begun, judged, at).select("batch_id", "accepted", "rejected", "status", F.col("finished_at").isNotNull().alias("ended"))


@query("""SELECT source AS batch_id, doc_id AS line_no, 'too_short' AS reason FROM documents WHERE n_chars < 500""")
def rejection_sink(spark, sf):
    return R.rejections(load(spark, sf, "documents").select(F.col("source").alias("batch_id"), F.col("doc_id").alias("line_no"), F.when(F.col("n_chars") < 500, "reject").otherwise("accept").alias("outcome"), F.when(F.col("n_chars") < 500, "too_short").alias("reason")))


@query("""WITH s AS (SELECT user_id AS run_id, event_id % 50 AS seq, event_id, event_type, event_id % 3 = 0 AS old FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY run_id, seq ORDER BY old DESC, event_id) AS rn, bool_or(old) OVER (PARTITION BY run_id, seq) AS has_old FROM s)
SELECT run_id, seq, event_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY seq) AS INTEGER) AS position FROM f WHERE rn = 1""")
def run_steps(spark, sf):
    rows = events(spark, sf).select(F.col("user_id").alias("run_id"), (F.col("event_id") % 50).alias("seq"), "event_id", F.col("event_id").alias("at"))
    first = rows.where("event_id % 3 = 0")
    old = R.recorded_steps(first.limit(0), first)
    return R.run_listing(R.recorded_steps(old, rows.where("event_id % 3 <> 0"))).select("run_id", "seq", "event_id", "position")


@query(f"""WITH {REVIEWS} SELECT id, restaurant_id, CASE WHEN restaurant_id % 3 = 0 THEN rating >= 4 AND id % 2 = 0 ELSE is_representative END AS is_representative FROM reviews""")
def representative_marks(spark, sf):
    rows = reviews(spark, sf).select("id", "restaurant_id", "rating", "is_representative")
    return R.marked(rows, rows.where("rating >= 4 AND id % 2 = 0"), rows.where("restaurant_id % 3 = 0"), "id", "restaurant_id", "is_representative").select("id", "restaurant_id", "is_representative")


@query(f"""WITH {REVIEWS} SELECT id, restaurant_id, CAST(row_number() OVER (PARTITION BY restaurant_id ORDER BY reviewed_at DESC, id) AS INTEGER) AS shown FROM reviews WHERE is_representative""")
def review_display(spark, sf):
    return R.display_order(reviews(spark, sf).where("is_representative"), "restaurant_id").select("id", "restaurant_id", "shown")


@query("""WITH a AS (SELECT o_orderdate, o_orderkey FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_custkey % 7 = 3))
SELECT o.o_orderkey FROM orders o, a WHERE (o.o_orderdate, o.o_orderkey) < (a.o_orderdate, a.o_orderkey) ORDER BY o.o_orderdate DESC, o.o_orderkey DESC LIMIT 25""")
def anchored_page(spark, sf):
    orders = load(spark, sf, "orders")
    anchor = orders.where("o_custkey % 7 = 3").agg(F.max("o_orderkey")).first()[0]
    return R.anchored_page(orders.select("o_orderdate", "o_orderkey"), "o_orderdate", "o_orderkey", anchor, 25).select("o_orderkey")


@query("""SELECT event_id AS call_id, CASE WHEN event_id % 5 > 2 THEN 'unknown_place' ELSE 'unknown_slot' END AS reason FROM events WHERE event_type = 'click' AND (event_id % 5 > 2 OR event_id % 3 = 0)""")
def write_domain(spark, sf):
    e = F.col("event_id")
    rows = events(spark, sf).select(e.alias("call_id"), e.alias("turn_id"), F.when(F.col("event_type") == "click", "request_reservation").otherwise("search").alias("tool"), (e % 5).alias("restaurant_id"), (e % 3).alias("slot_id"))
    seen = rows.select("turn_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 1, 2)])).alias("restaurant_id"))
    slots = rows.select("turn_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 2)])).alias("slot_id"))
    return R.refused_writes(rows, seen, slots)


@query(f"""WITH {TEXTS}, b AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS body FROM texts), t AS (SELECT doc_id, trim(body) AS c FROM b)
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'not_an_object' WHEN 1 THEN 'not_one_object' WHEN 2 THEN 'unknown_field' ELSE CASE WHEN length(c) < 150 THEN 'too_short' WHEN length(c) > 800 THEN 'too_long' WHEN doc_id % 8 = 3 THEN 'no_ids' WHEN doc_id % 8 = 4 THEN 'id_not_offered' END END AS problem,
CASE WHEN doc_id % 8 > 4 AND length(c) BETWEEN 150 AND 800 THEN '3,' || (doc_id + 10) END AS ids, CASE WHEN doc_id % 8 > 4 AND length(c) BETWEEN 150 AND 800 THEN c END AS content FROM t""")
def digest_contract(spark, sf):
    doc, case = F.col("doc_id"), F.col("doc_id") % 8
    body = F.regexp_replace("text", "[^A-Za-z ]", "")
    ids = F.when(case == 3, "[]").when(case == 4, F.concat(F.lit("[3, "), (doc + 99).cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("["), (doc + 10).cast("string"), F.lit(", 3, 3]")))
    plain = F.concat(F.lit(' {"content": "  '), body, F.lit('", "source_review_ids": '), ids, F.when(case == 2, ', "x": 1').otherwise(""), F.lit("} "))
    raw = F.when(case == 0, F.concat(F.lit("["), plain, F.lit("]"))).when(case == 1, F.concat(plain, F.lit(","), plain)).otherwise(plain)
    answer = R.digest_answer(raw, F.array(F.lit(3).cast("long"), doc + 10)).alias("a")
    return texts(spark, sf).select("doc_id", answer).select("doc_id", "a.problem", F.array_join("a.ids", ",").alias("ids"), "a.content")


@query("""WITH d AS (SELECT vec_id % 40 AS restaurant_id, max(vec_id % 17) AS n FROM embeddings WHERE vec_id % 11 <> 0 AND vec_id % 4 = 2 AND vec_id % 9 <> 0 GROUP BY 1)
SELECT r AS restaurant_id, CAST(coalesce(n, 5) AS BIGINT) AS embedded_review_count FROM (SELECT range AS r FROM range(40)) LEFT JOIN d ON restaurant_id = r""")
def embedded_write_back(spark, sf):
    n = F.col("vec_id")
    count = F.when(n % 9 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"review_count": "'), (n % 17).cast("string"), F.lit('"}')))
    docs = load(spark, sf, "embeddings").select((n % 40).alias("restaurant_id"), F.when(n % 4 == 2, "representative_reviews").otherwise("x").alias("doc_type"), (n % 11 != 0).alias("is_active"), "embedding", count.alias("metadata"))
    places = spark.range(40).select(F.col("id").alias("restaurant_id"), F.lit(5).cast("long").alias("embedded_review_count"))
    return R.embedded_counts(places, docs)


@query("""WITH p AS (SELECT event_type AS stage, event_id AS at_s, sum(event_id % 7) OVER (PARTITION BY event_type ORDER BY event_id) AS read FROM events), l AS (SELECT *, read - lag(read) OVER w AS moved, at_s - lag(at_s) OVER w AS took FROM p WINDOW w AS (PARTITION BY stage ORDER BY at_s))
SELECT stage, at_s, round(CASE WHEN moved > 0 THEN moved / took::DOUBLE END, 6) AS rate, round(CASE WHEN moved > 0 THEN (100000 - read) / (moved / took::DOUBLE) END, 3) AS eta_s FROM l""")
def progress_rates(spark, sf):
    from pyspark.sql import Window

    rows = events(spark, sf).select(F.col("event_type").alias("stage"), F.col("event_id").alias("at_s"), F.sum(F.col("event_id") % 7).over(Window.partitionBy("event_type").orderBy("event_id")).alias("read"), F.lit(100000).alias("total"))
    return R.progress(rows).select("stage", "at_s", F.round("rate", 6).alias("rate"), F.round("eta_s", 3).alias("eta_s"))


@query("""WITH s AS (SELECT c AS restaurant_id, d AS slot_date, t AS slot_time, 'r' || c || '-' || d || '-' || t AS slot_id FROM (SELECT DISTINCT c_nationkey AS c FROM customer), (VALUES ('2024-01-05'), ('2024-01-06')) v(d), (VALUES ('1700'), ('1800')) w(t)),
b AS (SELECT 'r' || c_nationkey || '-2024-01-0' || (5 + c_custkey % 3) || '-1' || (7 + c_custkey % 2) || '00' AS slot_id, c_custkey AS reservation_id, c_custkey % 11 AS created, c_custkey % 4 + 1 AS party FROM customer WHERE c_custkey % 6 = 0)
SELECT restaurant_id, slot_id, reservation_id, CAST(coalesce(sum(party) OVER (PARTITION BY slot_id), 0) AS BIGINT) AS booked, CAST(row_number() OVER (PARTITION BY restaurant_id, slot_date ORDER BY slot_time, slot_id, created DESC NULLS LAST, reservation_id) AS INTEGER) AS row FROM s LEFT JOIN b USING (slot_id)""")
def slot_inventory(spark, sf):
    c = F.col("c_custkey")
    slots = load(spark, sf, "customer").select(F.col("c_nationkey").alias("restaurant_id")).distinct()
    slots = slots.select("restaurant_id", F.explode(F.array(F.lit("2024-01-05"), F.lit("2024-01-06"))).alias("slot_date")).select("restaurant_id", "slot_date", F.explode(F.array(F.lit("1700"), F.lit("1800"))).alias("slot_time"))
    named = lambda place, date, time: F.concat(F.lit("r"), place.cast("string"), F.lit("-"), date, F.lit("-"), time).alias("slot_id")
    slots = slots.select("restaurant_id", "slot_date", "slot_time", named(F.col("restaurant_id"), F.col("slot_date"), F.col("slot_time")), F.lit(8).alias("capacity"))
    taken = load(spark, sf, "customer").where("c_custkey % 6 = 0").select(named(F.col("c_nationkey"), F.concat(F.lit("2024-01-0"), (c % 3 + 5).cast("string")), F.concat(F.lit("1"), (c % 2 + 7).cast("string"), F.lit("00"))), c.alias("reservation_id"), F.timestamp_seconds(c % 11).alias("created_at"), (c % 4 + 1).alias("party"))
    return R.inventory(slots, taken).select("restaurant_id", "slot_id", "reservation_id", "booked", "row")


@query("""WITH i AS (SELECT o_custkey % 500 AS k, o_orderkey FROM orders), old AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0), f AS (SELECT count(DISTINCT k) AS n FROM i WHERE k NOT IN (SELECT k FROM old))
SELECT n AS inserted, (SELECT count(*) FROM orders) - n AS skipped FROM f""")
def upsert_counts(spark, sf):
    from larkspur.operators import lifecycle as K

    old = load(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    return K.upsert_counts(old, load(spark, sf, "orders").select((F.col("o_custkey") % 500).alias("k"), "o_orderkey"), ["k"])

"""Writes, versions, activation, and state over ordered events."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import lifecycle as K
from larkspur.operators import state as S
from larkspur.plans.registry import query
from larkspur.sources.tables import events, load


def _halves(spark, sf):
    """Current rows (one for each of most customers) and all other orders as incoming ones."""
    rows = load(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("status"))
    current = (F.col("o_orderkey") % 2 == 0) & (F.col("k") % 5 != 0)
    return K.latest(rows.where(current), ["k"], [F.col("o_orderkey")]), rows.where(~current)


_OLD = "SELECT * FROM (SELECT o_custkey AS k, o_orderkey, o_totalprice, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 5 <> 0) WHERE rn = 1"
_NEW = "SELECT o_custkey AS k, o_orderkey, o_totalprice, o_orderstatus AS status FROM orders WHERE NOT (o_orderkey % 2 = 0 AND o_custkey % 5 <> 0)"


@query(f"""WITH old AS ({_OLD}), new AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o_orderkey DESC) AS rn FROM ({_NEW}))
SELECT coalesce(o.k, n.k) AS k, coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice, CASE WHEN o.k IS NOT NULL THEN o.status ELSE n.status END AS status
FROM old o FULL JOIN (SELECT * FROM new WHERE rn = 1) n ON o.k = n.k""")
def upsert_last_wins(spark, sf):
    old, new = _halves(spark, sf)
    return K.upsert_last_wins(old, new, ["k"], "o_orderkey", keep=["status"])


@query(f"""WITH old AS ({_OLD}), new AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o_orderkey) AS rn FROM ({_NEW}) ANTI JOIN old USING (k))
SELECT k, o_orderkey, o_totalprice, status FROM old UNION ALL SELECT k, o_orderkey, o_totalprice, status FROM new WHERE rn = 1""")
def upsert_first_wins(spark, sf):
    old, new = _halves(spark, sf)
    return K.upsert_first_wins(old, new, ["k"], "o_orderkey")


@query("""WITH cur AS (SELECT conv_id, max(turn) AS version FROM conversations WHERE turn <= 2 GROUP BY 1), inc AS (SELECT conv_id, turn AS version FROM conversations WHERE turn >= 2),
j AS (SELECT i.*, coalesce(i.version <= c.version, false) AS stale FROM inc i LEFT JOIN cur c USING (conv_id)), tak AS (SELECT conv_id, max(version) AS version FROM j WHERE NOT stale GROUP BY 1)
SELECT 'state' AS kind, conv_id, version FROM (SELECT * FROM cur ANTI JOIN tak USING (conv_id) UNION ALL SELECT * FROM tak) UNION ALL SELECT 'conflict', conv_id, version FROM j WHERE stale""")
def version_guard_checkpoint(spark, sf):
    talk = load(spark, sf, "conversations").select("conv_id", F.col("turn").alias("version"))
    state, conflicts = K.guard_versions(talk.where("version <= 2").groupBy("conv_id").agg(F.max("version").alias("version")), talk.where("version >= 2"), "conv_id", "version")
    return state.select(F.lit("state").alias("kind"), "*").unionByName(conflicts.select(F.lit("conflict").alias("kind"), "*"))


@query("""SELECT event_id, v > coalesce(max(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS accepted
FROM (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM events)""")
def checkpoint_history(spark, sf):
    writes = events(spark, sf).select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("v"))
    return K.replay_versions(writes, "user_id", "v", "event_id").select("event_id", "accepted")


@query("""WITH cur AS (SELECT conv_id, turn AS seq FROM conversations WHERE turn < 3), inc AS (SELECT conv_id, turn, role FROM conversations WHERE turn >= 3), m AS (SELECT conv_id, max(seq) AS s FROM cur GROUP BY 1)
SELECT i.conv_id, turn, role, CAST(coalesce(s, 0) + row_number() OVER (PARTITION BY i.conv_id ORDER BY turn) AS BIGINT) AS seq FROM inc i LEFT JOIN m USING (conv_id)""")
def append_sequence(spark, sf):
    talk = load(spark, sf, "conversations").select("conv_id", "turn", "role")
    return K.append_sequence(talk.where("turn < 3").select("conv_id", F.col("turn").alias("seq")), talk.where("turn >= 3"), "conv_id", ["turn"])


@query("""SELECT conv_id, turn, role FROM conversations WHERE conv_id % 4 <> 0 UNION ALL SELECT conv_id, turn + 1, 'replaced' FROM conversations WHERE conv_id % 4 = 0 AND turn < 2""")
def replace_for_keys(spark, sf):
    talk = load(spark, sf, "conversations").select("conv_id", "turn", "role")
    new = talk.where("conv_id % 4 = 0 AND turn < 2").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit("replaced").alias("role"))
    return K.replace_for_keys(talk, new, "conv_id")


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN s END, c_acctbal) AS c_acctbal FROM (SELECT c_custkey, c_acctbal FROM customer) LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS s FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def bulk_keyed_update(spark, sf):
    best = load(spark, sf, "orders").where("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return K.bulk_update(load(spark, sf, "customer").select("c_custkey", "c_acctbal"), best, "c_custkey", ["c_acctbal"])


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2024-01-01' END AS deleted_at FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)""")
def deletes(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id").withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    left = K.hard_delete({"documents": docs}, load(spark, sf, "labels").where("toxic = 1"), "doc_id")["documents"]
    return K.soft_delete(left, F.col("doc_id") % 5 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


@query("""WITH h AS (SELECT source, lang, max(doc_id % 7) AS top FROM documents WHERE doc_id % 2 = 0 GROUP BY 1, 2)
SELECT d.doc_id, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY d.source, d.lang ORDER BY d.doc_id) AS INTEGER) AS version FROM documents d LEFT JOIN h USING (source, lang) WHERE d.doc_id % 2 = 1""")
def assign_versions(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "source", "lang")
    history = docs.where("doc_id % 2 = 0").withColumn("version", F.col("doc_id") % 7)
    return K.assign_versions(history, docs.where("doc_id % 2 = 1"), ["source", "lang"], "doc_id").select("doc_id", "version")


@query("""SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq, ts - to_microseconds(CAST(floor(value * 1000) AS BIGINT)) AS started_at FROM events""")
def backfill_tool_seq(spark, sf):
    calls = events(spark, sf).withColumn("ms", F.floor(F.col("value") * 1000) / 1000.0)
    return K.backfill_sequence(calls, "user_id", "ts", "event_id", "ms").select("event_id", "seq", F.col("started_at").cast("timestamp_ntz").alias("started_at"))


@query("""WITH live AS (SELECT doc_id, source, lang FROM documents WHERE doc_id % 2 = 0), listed AS (SELECT doc_id, source, lang FROM documents WHERE doc_id % 7 = 0)
SELECT doc_id FROM live SEMI JOIN (SELECT DISTINCT source, lang FROM listed) USING (source, lang) WHERE doc_id NOT IN (SELECT doc_id FROM listed)""")
def superseded_versions(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "source", "lang")
    return K.superseded(docs.where("doc_id % 7 = 0"), docs.where("doc_id % 2 = 0"), ["source", "lang"], "doc_id")


@query("""WITH d AS (SELECT vec_id, label, vec_id % 3 <> 0 AS has, vec_id % 4 = 0 AND vec_id % 3 <> 0 AS live FROM embeddings), able AS (SELECT * FROM d WHERE vec_id % 10 = 0 AND has)
SELECT vec_id, CASE WHEN vec_id IN (SELECT vec_id FROM able) THEN true WHEN live AND label IN (SELECT label FROM able) THEN false ELSE live END AS is_active FROM d""")
def activate_documents(spark, sf):
    docs = load(spark, sf, "embeddings").select("vec_id", "label", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding"), ((F.col("vec_id") % 4 == 0) & (F.col("vec_id") % 3 != 0)).alias("is_active"))
    return K.activate(docs, docs.where("vec_id % 10 = 0"), "vec_id", ["label"]).select("vec_id", "is_active")


@query("""WITH e AS (SELECT vec_id, vec_id // 100 AS page, CASE vec_id % 50 WHEN 0 THEN [] WHEN 1 THEN embedding[1:10] WHEN 2 THEN list_transform(embedding, lambda x: 'nan'::FLOAT) WHEN 3 THEN list_transform(embedding, lambda x: 'inf'::FLOAT)
WHEN 4 THEN list_transform(embedding, lambda x: 0::FLOAT) WHEN 5 THEN list_transform(embedding, lambda x: 1::FLOAT) ELSE embedding END AS v FROM embeddings),
f AS (SELECT *, CASE WHEN len(v) = 0 THEN 'empty' WHEN len(v) <> 64 THEN 'dimension' WHEN isnan(v[1]) THEN 'nan' WHEN isinf(v[1]) THEN 'inf' WHEN list_sum(list_transform(v, lambda x: abs(x))) <= 1e-12 THEN 'zero' END AS fault FROM e)
SELECT vec_id, coalesce(fault, CASE WHEN row_number() OVER (PARTITION BY page, fault, v ORDER BY vec_id) > 1 THEN 'duplicate' END) AS problem FROM f""")
def vector_quality(spark, sf):
    k, e = F.col("vec_id") % 50, F.col("embedding")
    fill = lambda x: F.transform(e, lambda _: F.lit(x).cast("float"))
    broken = F.when(k == 0, F.array().cast("array<float>")).when(k == 1, F.slice(e, 1, 10)).when(k == 2, fill(float("nan"))).when(k == 3, fill(float("inf"))).when(k == 4, fill(0.0)).when(k == 5, fill(1.0)).otherwise(e)
    docs = load(spark, sf, "embeddings").select("vec_id", broken.alias("embedding"), F.floor(F.col("vec_id") / 100).alias("page"))
    return K.quality_gate(docs, 64, "page", "vec_id").select("vec_id", "problem")


@query("""SELECT doc_id FROM documents ANTI JOIN (SELECT sha256(text) AS h, lang FROM documents WHERE doc_id % 2 = 0) c ON sha256(documents.text) = c.h AND documents.lang = c.lang""")
def digest_cache_miss(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "lang")
    return K.uncached(docs, docs.where("doc_id % 2 = 0"), ["h", "lang"]).select("doc_id")


def _requests(spark, sf):
    rows = events(spark, sf).where("event_type IN ('purchase', 'error')")
    size = F.when(F.col("event_type") == "error", -(F.col("event_id") % 3 + 1)).otherwise(F.col("event_id") % 4 + 1)
    return rows.select((F.col("user_id") % 40).alias("slot_id"), F.col("event_id").alias("request_id"), F.col("ts").alias("at"), size.alias("size"))


@query("""WITH RECURSIVE r AS (SELECT user_id % 40 AS slot_id, event_id AS request_id, CASE WHEN event_type = 'error' THEN -(event_id % 3 + 1) ELSE event_id % 4 + 1 END AS size,
row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('purchase', 'error')),
f AS (SELECT slot_id, request_id, n, size <= 0 OR size <= 12 AS granted, CASE WHEN size <= 0 THEN 0 WHEN size <= 12 THEN size ELSE 0 END AS booked FROM r WHERE n = 1
UNION ALL SELECT r.slot_id, r.request_id, r.n, r.size <= 0 OR f.booked + r.size <= 12, CASE WHEN r.size <= 0 OR f.booked + r.size <= 12 THEN greatest(0, f.booked + r.size) ELSE f.booked END FROM f JOIN r ON r.slot_id = f.slot_id AND r.n = f.n + 1)
SELECT slot_id, request_id, granted, CAST(booked AS BIGINT) AS booked FROM f""")
def hold_capacity(spark, sf):
    return S.hold_capacity(_requests(spark, sf), 12)


@query("""WITH h AS (SELECT event_id % 60 AS slot_id, ts, event_type, event_id % 4 + 1 AS size FROM events), x AS (SELECT slot_id, sum(size) AS freed FROM h WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-20 11:50:00' GROUP BY 1)
SELECT s.slot_id, CAST(greatest(0, 100 - coalesce(freed, 0)) AS BIGINT) AS booked FROM (SELECT DISTINCT slot_id FROM h) s LEFT JOIN x USING (slot_id)""")
def hold_expiry(spark, sf):
    holds = events(spark, sf).select((F.col("event_id") % 60).alias("slot_id"), F.col("ts").cast("timestamp_ntz").alias("held_at"), F.when(F.col("event_type") == "click", "held").otherwise("done").alias("status"), (F.col("event_id") % 4 + 1).alias("size"))
    slots = holds.select("slot_id").distinct().withColumn("booked", F.lit(100).cast("long"))
    return S.give_back(slots, S.expired_holds(holds, F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")))


@query("""SELECT event_id, first_value(event_id) OVER w AS first_id, row_number() OVER w > 1 AS replay FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)""")
def idempotent_confirm(spark, sf):
    keyed = events(spark, sf).select("event_id", S.idempotency_key(F.col("user_id"), F.col("event_type"), F.lit("confirm"), F.lit("{}")).alias("key"))
    return S.confirm_once(keyed, "key", "event_id").select("event_id", "first_id", "replay")


@query("""SELECT event_id, 'res-' || left(sha256(user_id || chr(10) || event_type || chr(10) || event_id || chr(10) || sha256(coalesce(props, ''))), 32) AS key FROM events""")
def idempotency_keys(spark, sf):
    return events(spark, sf).select("event_id", S.idempotency_key(F.col("user_id"), F.col("event_type"), F.col("event_id"), F.col("props")).alias("key"))


@query("""WITH b AS (SELECT 'r' || c_custkey || '-2024-01-05-1800' AS slot_id, c_custkey % 9 AS booked FROM customer), s AS (SELECT c_custkey AS restaurant_id, d AS slot_date, t AS slot_time,
'r' || c_custkey || '-' || strftime(d, '%Y-%m-%d') || '-' || replace(t, ':', '') AS slot_id FROM customer, (VALUES (DATE '2024-01-05'), (DATE '2024-01-06')) v(d), (VALUES ('17:00'), ('18:00'), ('19:00'), ('20:00'), ('21:00')) w(t))
SELECT restaurant_id, slot_id, CAST(8 - coalesce(booked, 0) AS BIGINT) AS remaining FROM s LEFT JOIN b USING (slot_id) WHERE 8 - coalesce(booked, 0) >= 3""")
def slot_availability(spark, sf):
    places = load(spark, sf, "customer").select(F.col("c_custkey").alias("restaurant_id"))
    dates = spark.sql("SELECT explode(array(DATE '2024-01-05', DATE '2024-01-06')) AS slot_date")
    booked = load(spark, sf, "customer").select(S.slot_id(F.col("c_custkey"), F.lit("2024-01-05").cast("date"), F.lit("18:00")).alias("slot_id"), (F.col("c_custkey") % 9).alias("booked"))
    return S.availability(places, dates, booked, 8, 3).select("restaurant_id", "slot_id", "remaining")


_KINDS = "CASE event_type WHEN 'view' THEN 'propose' WHEN 'click' THEN 'confirm' WHEN 'error' THEN 'cancel' ELSE 'other' END"


@query(f"""WITH k AS (SELECT event_id, user_id, ts, {_KINDS} AS kind FROM events), w AS (SELECT *, last_value(CASE WHEN kind IN ('propose', 'cancel') THEN kind END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rs,
count(*) FILTER (WHERE kind IN ('propose', 'cancel')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS era FROM k), c AS (SELECT *, count(*) FILTER (WHERE kind = 'confirm') OVER (PARTITION BY user_id, era ORDER BY ts, event_id) AS n FROM w)
SELECT event_id, CASE WHEN rs = 'propose' AND n > 0 THEN 'completed' WHEN rs = 'propose' THEN 'pending' ELSE 'idle' END AS state,
CASE WHEN kind = 'confirm' THEN CASE WHEN coalesce(rs, '') <> 'propose' THEN 'refused' WHEN n = 1 THEN 'executed' ELSE 'replayed' END END AS effect FROM c""")
def confirmation_states(spark, sf):
    kind = F.when(F.col("event_type") == "view", "propose").when(F.col("event_type") == "click", "confirm").when(F.col("event_type") == "error", "cancel").otherwise("other")
    rows = events(spark, sf).select("event_id", F.col("user_id").alias("thread"), F.col("ts").alias("at"), kind.alias("kind"))
    return S.confirmation_states(rows).select("event_id", "state", "effect")


def _turns(spark, sf):
    kind = F.when(F.col("event_type") == "view", "delta").when(F.col("event_type") == "click", "tool_start").when(F.col("event_type") == "purchase", "tool_finish").when(F.col("event_type") == "error", "memory").otherwise("other")
    kind = F.when(F.col("event_id") % 97 == 0, "replace").when(F.col("event_id") % 101 == 0, "done").otherwise(kind)
    return events(spark, sf).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.get_json_object("props", "$.k").alias("value"))


_TURNS = """t AS (SELECT user_id AS run_id, event_id AS seq, json_extract_string(props, '$.k') AS value, CASE WHEN event_id % 97 = 0 THEN 'replace' WHEN event_id % 101 = 0 THEN 'done'
WHEN event_type = 'view' THEN 'delta' WHEN event_type = 'click' THEN 'tool_start' WHEN event_type = 'purchase' THEN 'tool_finish' WHEN event_type = 'error' THEN 'memory' ELSE 'other' END AS kind FROM events)"""


@query(f"""WITH {_TURNS}, b AS (SELECT *, max(seq) FILTER (WHERE kind = 'replace') OVER (PARTITION BY run_id) AS f FROM t)
SELECT run_id, coalesce(string_agg(value, '' ORDER BY seq) FILTER (WHERE kind IN ('delta', 'replace') AND seq >= coalesce(f, -1)), '') AS text, count(*) FILTER (WHERE kind = 'tool_start') AS started,
count(*) FILTER (WHERE kind = 'tool_finish') AS finished, arg_max(value, seq) FILTER (WHERE kind = 'memory') AS memory, coalesce(arg_min(kind, seq) FILTER (WHERE kind = 'done'), 'open') AS phase FROM b GROUP BY run_id""")
def event_reduce(spark, sf):
    return S.reduce_turns(_turns(spark, sf))


@query("""WITH s AS (SELECT user_id AS run_id, event_id AS call_id, ts FROM events WHERE event_type = 'click'), f AS (SELECT user_id AS run_id, event_id - 3 AS call_id, min(ts) AS e FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT s.run_id, s.call_id, CAST(row_number() OVER (PARTITION BY s.run_id ORDER BY ts, s.call_id) AS INTEGER) AS seq, (epoch_us(e) - epoch_us(ts)) / 1000 AS latency_ms FROM s LEFT JOIN f ON s.run_id = f.run_id AND s.call_id = f.call_id""")
def span_pairing(spark, sf):
    kind = F.when(F.col("event_type") == "click", "tool_start").when(F.col("event_type") == "purchase", "tool_finish")
    call = F.when(F.col("event_type") == "click", F.col("event_id")).otherwise(F.col("event_id") - 3)
    rows = events(spark, sf).select(F.col("user_id").alias("run_id"), call.alias("call_id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"))
    return S.pair_spans(rows).select("run_id", "call_id", "seq", "latency_ms")


@query("""SELECT event_id, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS asked, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) < 3 AS may_ask FROM events""")
def clarification_cap(spark, sf):
    rows = events(spark, sf).select("event_id", F.col("user_id").alias("thread"), F.col("ts").alias("at"), F.when(F.col("event_type") == "signup", "clarify").otherwise("x").alias("kind"))
    return S.clarifications(rows).select("event_id", "asked", "may_ask")


@query("""SELECT user_id AS run_id, count(*) AS tool_calls, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS retrieval_calls FROM events GROUP BY user_id""")
def tool_counters(spark, sf):
    return S.tool_counters(events(spark, sf).select(F.col("user_id").alias("run_id"), F.col("event_type").alias("tool")), ("view", "click"))


@query("""SELECT conv_id, CAST(unnest(range(count(*))) AS INTEGER) AS pos, unnest(list(role ORDER BY turn)) AS event, unnest(list(CAST(turn AS VARCHAR) || chr(10) || 'x' ORDER BY turn)) AS data FROM conversations GROUP BY conv_id""")
def stream_frames(spark, sf):
    talk = load(spark, sf, "conversations")
    frame = F.concat(F.lit("event: "), F.col("role"), F.lit("\n: note\ndata: "), F.col("turn").cast("string"), F.lit("\ndata:x\n\n"))
    pieces = talk.select("conv_id", (F.col("turn") * 2).alias("n"), F.left(frame, F.lit(9)).alias("chunk")).unionByName(talk.select("conv_id", (F.col("turn") * 2 + 1).alias("n"), F.substring(frame, 10, 1000).alias("chunk")))
    return S.frames(pieces, "conv_id", "n")

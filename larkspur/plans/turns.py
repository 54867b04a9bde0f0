"""Queries over turns: events of every kind are drawn from the event table, and their SQL says from the rules what must come of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import answers as A
from larkspur.operators import state as S
from larkspur.operators import turns as T
from larkspur.plans.registry import query
from larkspur.sources.tables import events, load

_SHOWN = (T.DELTA, T.TOOL_START, T.DELTA, T.CITATION, T.TOOL_FINISH, T.THINKING, T.MEMORY, T.DELTA, T.REPLACE, T.TOOL_START, T.CITATION, T.AWAITING, T.CONFIRMATION, T.END, T.ERROR, T.START)
_FOUND = (T.SEARCHED, T.RECALLED, T.RESOLVED, T.SEARCHED, T.AVAILABLE)


def _drawn(spark, sf):
    """A number for each event that its id alone decides."""
    return events(spark, sf).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), (F.col("event_id") * 48271 % 2147483647).alias("n"), F.get_json_object("props", "$.k").alias("value"))


_DRAWN = "d AS (SELECT user_id AS run_id, event_id AS seq, event_id * 48271 % 2147483647 AS n, json_extract_string(props, '$.k') AS value FROM events)"


def _kind(kinds):
    return F.element_at(F.array(*map(F.lit, kinds)), (F.col("n") % len(kinds) + 1).cast("int"))


def _kind_sql(kinds):
    return f"list_extract({list(kinds)}, CAST(n % {len(kinds)} + 1 AS BIGINT))"


def _ids(*numbers):
    return F.array(*[x.cast("long") for x in numbers])


def _shown(spark, sf):
    k, n = F.col("kind"), F.col("n")
    wide = F.floor(n / 16)
    ids = F.when(k == T.CITATION, _ids(wide % 7, wide % 5)).when(k == T.MEMORY, _ids(wide % 3))
    texts = F.when((k == T.END) & (wide % 2 == 0), F.array(F.concat(F.lit("w"), (wide % 4).cast("string")))).when((k == T.TOOL_FINISH) & (wide % 3 == 0), F.array(F.lit("failed")))
    value = F.when(k.isin(T.TOOL_START, T.TOOL_FINISH), F.concat(F.lit("c"), (wide % 3).cast("string"))).otherwise(F.col("value"))
    return _drawn(spark, sf).withColumn("kind", _kind(_SHOWN)).select("run_id", "seq", "kind", value.alias("value"), ids.alias("ids"), texts.alias("texts"))


@query(f"""WITH {_DRAWN}, e AS (SELECT run_id, seq, n // 16 AS w, value, {_kind_sql(_SHOWN)} AS kind FROM d), b AS (SELECT *, max(seq) FILTER (WHERE kind = '{T.START}') OVER (PARTITION BY run_id) AS f FROM e), o AS (SELECT * FROM b WHERE f IS NULL OR seq >= f),
m AS (SELECT run_id, max(seq) AS last_seq, max(seq) FILTER (WHERE kind = '{T.REPLACE}') AS r, arg_max(kind, seq) FILTER (WHERE kind IN ('{T.START}', '{T.END}', '{T.ERROR}')) AS t, max(seq) FILTER (WHERE kind = '{T.END}') AS ended,
 min(seq) FILTER (WHERE kind = '{T.CONFIRMATION}') AS c, min(seq) FILTER (WHERE kind = '{T.AWAITING}') AS a, arg_max('w' || w % 4, seq) FILTER (WHERE kind = '{T.END}' AND w % 2 = 0) AS warnings FROM o GROUP BY run_id),
x AS (SELECT run_id, string_agg(value, '' ORDER BY seq) AS text FROM o JOIN m USING (run_id) WHERE kind IN ('{T.DELTA}', '{T.REPLACE}') AND seq >= coalesce(r, -1) GROUP BY run_id),
s AS (SELECT run_id, seq, w % 3 AS call FROM o WHERE kind = '{T.TOOL_START}'), g AS (SELECT run_id, seq, w % 3 AS call, CASE WHEN w % 3 = 0 THEN 'failed' ELSE 'ok' END AS status FROM o WHERE kind = '{T.TOOL_FINISH}'),
l AS (SELECT s.run_id, s.seq, 'c' || s.call || ':' || coalesce(arg_max(status, g.seq), 'running') AS shown FROM s LEFT JOIN g ON s.run_id = g.run_id AND s.call = g.call AND g.seq > s.seq GROUP BY s.run_id, s.seq, s.call), tools AS (SELECT run_id, string_agg(shown, ',' ORDER BY seq) AS tools FROM l GROUP BY run_id),
ids AS (SELECT run_id, w % 7 AS id, seq * 2 AS place_ FROM o WHERE kind = '{T.CITATION}' UNION ALL SELECT run_id, w % 5, seq * 2 + 1 FROM o WHERE kind = '{T.CITATION}'), cited AS (SELECT run_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place_) AS citations FROM (SELECT run_id, id, min(place_) AS place_ FROM ids GROUP BY run_id, id) GROUP BY run_id),
mem AS (SELECT run_id, w % 3 AS id, max(seq) AS place_, arg_max(value, seq) AS v FROM o WHERE kind = '{T.MEMORY}' GROUP BY run_id, w % 3), saved AS (SELECT run_id, string_agg(id || '=' || v, ',' ORDER BY place_) AS memories FROM mem GROUP BY run_id)
SELECT run_id, CASE WHEN t IS NULL THEN 'idle' WHEN t = '{T.ERROR}' THEN 'failed' WHEN t = '{T.START}' THEN 'streaming' WHEN c < ended THEN 'awaiting_confirm' WHEN a < ended THEN 'awaiting_user' ELSE 'done' END AS phase, coalesce(text, '') AS text, coalesce(tools, '') AS tools,
 coalesce(citations, '') AS citations, coalesce(memories, '') AS memories, coalesce(warnings, '') AS warnings, last_seq FROM m LEFT JOIN x USING (run_id) LEFT JOIN tools USING (run_id) LEFT JOIN cited USING (run_id) LEFT JOIN saved USING (run_id)""")
def turn_states(spark, sf):
    done = T.reduced_turns(_shown(spark, sf))
    tools = F.array_join(F.transform("tools", lambda t: F.concat(t["call_id"], F.lit(":"), t["status"])), ",").alias("tools")
    memories = F.array_join(F.transform("memories", lambda m: F.concat(m["memory_id"].cast("string"), F.lit("="), m["content"])), ",").alias("memories")
    return done.select("run_id", "phase", "text", tools, F.array_join(F.col("citations").cast("array<string>"), ",").alias("citations"), memories, F.array_join("warnings", ",").alias("warnings"), "last_seq")


@query(f"""WITH {_DRAWN}, e AS (SELECT run_id, seq, n // 5 AS w, {_kind_sql(_FOUND)} AS kind FROM d),
i AS (SELECT run_id, seq, kind, w % 9 AS id, 0 AS p FROM e WHERE w % 4 > 0 UNION ALL SELECT run_id, seq, kind, w % 11, 1 FROM e WHERE w % 4 > 1), found AS (SELECT * FROM i WHERE kind = '{T.SEARCHED}'),
pin AS (SELECT run_id, max(seq) AS p, arg_max(id, seq) AS id FROM i WHERE kind = '{T.RESOLVED}' AND p = 0 GROUP BY run_id),
gone AS (SELECT DISTINCT pin.run_id FROM pin JOIN e s ON s.run_id = pin.run_id AND s.kind = '{T.SEARCHED}' AND s.seq > pin.p WHERE EXISTS (SELECT 1 FROM found c WHERE c.run_id = s.run_id AND c.seq <= s.seq) AND NOT EXISTS (SELECT 1 FROM found c WHERE c.run_id = s.run_id AND c.seq <= s.seq AND c.id = pin.id)),
lists AS (SELECT run_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY seq, p) FILTER (WHERE kind = '{T.SEARCHED}') AS candidates, string_agg(CAST(id AS VARCHAR), ',' ORDER BY seq, p) FILTER (WHERE kind = '{T.RECALLED}') AS evidence FROM i GROUP BY run_id),
firsts AS (SELECT run_id, w % 6 AS x, min(seq) AS seq FROM e WHERE kind IN ('{T.SEARCHED}', '{T.RECALLED}') GROUP BY run_id, w % 6), warned AS (SELECT run_id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY seq) AS warnings FROM firsts GROUP BY run_id)
SELECT r.run_id, coalesce(candidates, '') AS candidates, coalesce(evidence, '') AS evidence, coalesce(warnings, '') AS warnings, CASE WHEN gone.run_id IS NULL THEN pin.id END AS pinned, r.empty AS retrieval_empty
FROM (SELECT run_id, coalesce(bool_or(kind IN ('{T.SEARCHED}', '{T.RECALLED}') AND w % 4 = 0), false) AS empty FROM e GROUP BY run_id) r LEFT JOIN lists USING (run_id) LEFT JOIN warned USING (run_id) LEFT JOIN pin ON pin.run_id = r.run_id LEFT JOIN gone ON gone.run_id = r.run_id""")
def turn_accumulation(spark, sf):
    w = F.floor(F.col("n") / 5)
    rows = _drawn(spark, sf).withColumn("kind", _kind(_FOUND))
    ids = F.slice(_ids(w % 9, w % 11), F.lit(1), F.least(w % 4, F.lit(2)).cast("int"))
    found = T.gathered_turns(rows.select("run_id", "seq", "kind", "value", ids.alias("ids"), F.array((w % 6).cast("string")).alias("texts")))
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.select("run_id", listed("candidates"), listed("evidence"), listed("warnings"), "pinned", "retrieval_empty")


@query(f"""WITH {_DRAWN}, e AS (SELECT run_id AS thread, seq AS event_id, {_kind_sql(("propose", "confirm", "confirm", "cancel", "other"))} AS kind, n // 5 % 4 AS key FROM d),
l AS (SELECT *, max(event_id) FILTER (WHERE kind IN ('propose', 'cancel')) OVER (PARTITION BY thread ORDER BY event_id) AS place_ FROM e), c AS (SELECT l.thread, l.event_id, p.event_id AS proposed, p.key FROM l LEFT JOIN e p ON p.event_id = l.place_ AND p.kind = 'propose' WHERE l.kind = 'confirm'),
f AS (SELECT thread, key, min(event_id) AS first, arg_min(proposed, event_id) AS made FROM c WHERE proposed IS NOT NULL GROUP BY thread, key)
SELECT c.thread, c.event_id, CASE WHEN proposed IS NULL THEN 'refused' WHEN c.event_id = first THEN 'executed' ELSE 'replayed' END AS effect, 'args ' || made AS arguments, 'done-' || first AS result FROM c LEFT JOIN f ON c.thread = f.thread AND c.key = f.key""")
def confirmed_results(spark, sf):
    rows = _drawn(spark, sf).withColumn("kind", _kind(("propose", "confirm", "confirm", "cancel", "other")))
    proposes = F.col("kind") == "propose"
    key = F.when(proposes, (F.floor(F.col("n") / 5) % 4).cast("string"))
    return T.confirmed_results(rows.select(F.col("run_id").alias("thread"), F.col("seq").alias("event_id"), F.col("seq").alias("at"), "kind", key.alias("key"), F.when(proposes, F.concat(F.lit("args "), F.col("seq").cast("string"))).alias("arguments")))


@query("""WITH l AS (SELECT doc_id, k, trim(line, ' ' || chr(9) || chr(13)) AS line FROM (SELECT doc_id, unnest(string_split(text || chr(10) || '- a' || chr(10) || '•  b' || chr(10) || 'c' || chr(10) || chr(10) || 'Followups： 1) x | y' || chr(10) || '2. z；w', chr(10))) AS line, generate_subscripts(string_split(text || chr(10) || '- a' || chr(10) || '•  b' || chr(10) || 'c' || chr(10) || chr(10) || 'Followups： 1) x | y' || chr(10) || '2. z；w', chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL)),
c AS (SELECT *, CASE WHEN line = '' THEN '' WHEN regexp_matches(line, '^[-*•]\\s+') THEN 'list' ELSE 'paragraph' END AS kind FROM l), m AS (SELECT doc_id, min(k) AS place_ FROM c WHERE regexp_matches(line, '(?i)^followups?\\s*[:：]') GROUP BY doc_id),
b AS (SELECT c.*, lag(kind) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM c JOIN m USING (doc_id) WHERE k < place_)
SELECT doc_id, count(*) FILTER (WHERE kind <> '' AND kind IS DISTINCT FROM before) AS segments, count(*) FILTER (WHERE kind = 'list' AND kind IS DISTINCT FROM before) AS lists, count(*) FILTER (WHERE kind <> '') AS lines, 'x|y|z|w' AS asked FROM b GROUP BY doc_id""")
def answer_segments(spark, sf):
    """Whole texts, behind them a list in two ways, a line, and a block of questions."""
    text = F.concat("text", F.lit("\n- a\n•  b\nc\n\nFollowups： 1) x | y\n2. z；w"))
    found = load(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", A.parsed_answer(text).alias("p")).select("doc_id", "p.*")
    lists = F.size(F.filter("segments", lambda x: x["kind"] == "list")).cast("long")
    lines = F.aggregate("segments", F.lit(0).cast("long"), lambda n, x: n + F.size(x["lines"]))
    return found.select("doc_id", F.size("segments").cast("long").alias("segments"), lists.alias("lists"), lines.alias("lines"), F.array_join("follow_ups", "|").alias("asked"))


@query("""WITH f AS (SELECT conv_id, turn, conv_id % 5 AS form, role FROM conversations), e AS (SELECT conv_id, turn, role, CASE form WHEN 0 THEN CAST(turn AS VARCHAR) || chr(10) || 'x' WHEN 1 THEN '' WHEN 3 THEN 'b' ELSE NULL END AS data FROM f)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, CASE WHEN conv_id % 5 = 3 THEN 'last' ELSE role END AS event, data FROM e WHERE data IS NOT NULL""")
def frame_cases(spark, sf):
    """Frames with data, without data, without a name, with names and data repeated and padded, and comments alone; cut in two anywhere."""
    role, turn, form = F.col("role"), F.col("turn").cast("string"), F.col("conv_id") % 5
    frame = (
        F.when(form == 0, F.concat(F.lit("event: "), role, F.lit("\n: note\ndata: "), turn, F.lit(" \ndata:x\n\n"))).when(form == 1, F.concat(F.lit("event:"), role, F.lit("\n\n"))).when(form == 2, F.concat(F.lit("data: "), turn, F.lit("\n\n")))
        .when(form == 3, F.concat(F.lit("event: first\r\nevent:  last \ndata:\ndata:   \ndata:  b\t\n\n"))).otherwise(": keep-alive\n\n")
    )
    talk = load(spark, sf, "conversations").withColumn("frame", frame).withColumn("at", F.col("turn").cast("int") % 7)
    pieces = talk.select("conv_id", (F.col("turn") * 2).alias("n"), F.left("frame", F.col("at")).alias("chunk")).unionByName(talk.select("conv_id", (F.col("turn") * 2 + 1).alias("n"), F.substring(F.col("frame"), F.col("at") + 1, F.lit(10_000)).alias("chunk")))
    return S.frames(pieces, "conv_id", "n")

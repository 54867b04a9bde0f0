"""Queries that read phrases: made of words, names and numbers of the tables, and reckoned anew by their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import answers as A
from larkspur.functions import interpret as I
from larkspur.functions import text as T
from larkspur.operators import evaluate as M
from larkspur.operators import evidence as E
from larkspur.operators import state as S
from larkspur.plans.registry import query
from larkspur.sources.tables import events, load

#: The words of each turn, letters only.
_WORDS = "c AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, ' +'), lambda w: regexp_replace(w, '[^A-Za-z]', '', 'g')), lambda w: w <> '') AS w FROM conversations)"


def _talk(spark, sf):
    words = F.filter(F.transform(F.split("text", " +"), lambda w: F.regexp_replace(w, "[^A-Za-z]", "")), lambda w: w != "")
    return load(spark, sf, "conversations").select("conv_id", "turn", "text", words.alias("w"))


def _word(n):
    return F.coalesce(F.get(F.col("w"), F.lit(n)), F.lit(""))


@query(f"""WITH {_WORDS} SELECT conv_id, turn, array_to_string(list_sort(list_filter([coalesce(w[1], ''), coalesce(w[2], ''), coalesce(w[3], ''), CASE WHEN turn % 2 = 0 THEN coalesce(w[4], '') ELSE '' END], lambda x: x <> '')), '|') AS names FROM c""")
def quoted_names(spark, sf):
    text = F.concat(F.lit("go to “ "), _word(0), F.lit("” or 《"), _word(1), F.lit("》 「"), _word(2), F.lit(" 」 "), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("『"), _word(3), F.lit("』"))).otherwise(F.concat(_word(3), F.lit("』"))))
    return _talk(spark, sf).select("conv_id", "turn", F.array_join(F.array_sort(I.quoted_names(text)), "|").alias("names"))


_CLASSIFIERS = ("家", "间", "个", "位", "名", "条", "店")


@query(f"""WITH e AS (SELECT event_id, event_id % 37 AS n, event_id % 7 + 1 AS count, event_id // 259 % 8 AS form FROM events), p AS (SELECT *, CASE form WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN count WHEN 3 THEN count END AS position FROM e)
SELECT event_id, CASE WHEN form < 2 AND n = 0 THEN NULL WHEN form < 4 THEN 'ordinal' WHEN form = 4 THEN 'modifier' WHEN form < 7 THEN 'demonstrative' END AS kind,
CASE WHEN form < 2 AND n = 0 THEN NULL WHEN form < 4 THEN position WHEN form = 4 THEN CASE WHEN n BETWEEN 1 AND count THEN n ELSE 0 END WHEN form = 5 THEN 1 WHEN form = 6 THEN CASE WHEN n BETWEEN 1 AND count THEN n ELSE 0 END END::INTEGER AS position,
CASE WHEN form < 2 AND (n = 0 OR n > count) THEN NULL WHEN form < 4 THEN 100 + position WHEN form = 4 THEN CASE WHEN n BETWEEN 1 AND count THEN 100 + n END WHEN form = 5 THEN 101 WHEN form = 6 THEN 100 + n END AS place FROM p""")
def reference_positions(spark, sf):
    """Places in lists of one to seven candidates: in digits and Chinese numerals up to 36 with each classifier, the last, a description, a pointer with and without a pin, and an occasion that is none."""
    e = F.col("event_id")
    n, count, form = e % 37, e % 7 + 1, F.floor(e / 259) % 8
    numerals = ["零"] + ["".join(("", "十", "二十", "三十")[k // 10 : k // 10 + 1]) + ("", *A.DIGITS_IN_ORDER)[k % 10] for k in range(1, 37)]
    numeral = F.element_at(F.array(*map(F.lit, numerals)), (n + 1).cast("int"))
    classifier = F.element_at(F.array(*map(F.lit, _CLASSIFIERS)), (e % 5 % 7 + 1).cast("int"))
    text = (
        F.when(form == 0, F.concat(F.lit("那么第 "), n.cast("string"), F.lit(" "), classifier, F.lit("怎么样"))).when(form == 1, F.concat(F.lit("第"), numeral, classifier)).when(form == 2, F.concat(F.lit("最后"), classifier)).when(form == 3, F.concat(F.lit("第一家和最后一"), classifier))
        .when(form == 4, F.concat(F.lit("那家 Name"), n.cast("string"), F.lit("x 的呢"))).when(form == 5, "this one?").when(form == 6, "它安静吗").otherwise("第二次来纽约")
    )
    candidates = F.transform(F.sequence(F.lit(1), count.cast("int")), lambda i: F.struct(i.alias("position"), (i + 100).cast("long").alias("restaurant_id"), F.concat(F.lit("name"), i.cast("string"), F.lit("X")).alias("name"), F.array(F.lit("匹配")).alias("reasons")))
    found = A.reference_in(text, candidates, F.when(form == 6, n + 100))
    return events(spark, sf).select("event_id", found.alias("f")).select("event_id", "f.kind", "f.position", F.col("f.restaurant_id").alias("place"))


@query(f"""WITH {_WORDS} SELECT conv_id, turn, CASE WHEN turn % 6 > 0 THEN array_to_string(list_filter(w, lambda x: x <> '')[1:least(3, turn % 6)], '|') END AS questions FROM c""")
def follow_up_lists(spark, sf):
    """Lists of one to five questions with blank ones and a null among them, behind the last of two markers; every sixth turn has no list of strings."""
    asked = F.concat(F.array(F.lit(" "), F.lit(None)), F.slice("w", F.lit(1), (F.col("turn") % 6).cast("int")))
    some = F.concat(F.lit('FOLLOWUPS: ["no"]\nFOLLOWUPS: see ['), F.array_join(F.transform(asked, lambda x: F.coalesce(F.concat(F.lit('"'), x, F.lit('"')), F.lit("null"))), ", "), F.lit("] \n"))
    body = F.concat(F.col("text"), F.lit("\n"), F.when(F.col("turn") % 6 > 0, some).when(F.col("turn") % 12 == 0, "FOLLOWUPS: none").otherwise('FOLLOWUPS: ["a", 1]'))
    return _talk(spark, sf).select("conv_id", "turn", F.array_join(A.follow_ups(body), "|").alias("questions"))


@query("""WITH q AS (SELECT conv_id, turn, text, translate(replace(substr(text, turn % 40 + 1, 17), ' ', '  '), 'aeiou', 'AEIOU') AS own, role || ' ' || left(text, 2) AS other FROM conversations),
n AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t, lower(trim(regexp_replace(own, '\\s+', ' ', 'g'))) AS a, lower(trim(regexp_replace(other, '\\s+', ' ', 'g'))) AS b FROM q) SELECT conv_id, turn, contains(t, a) AS held, contains(t, b) AS other FROM n""")
def quote_containment(spark, sf):
    own = F.translate(F.replace(F.substring(F.col("text"), (F.col("turn") % 40 + 1).cast("int"), F.lit(17)), F.lit(" "), F.lit("  ")), "aeiou", "AEIOU")
    other = F.concat("role", F.lit(" "), F.left("text", F.lit(2)))
    return load(spark, sf, "conversations").select("conv_id", "turn", I.quote_held(own, F.col("text")).alias("held"), I.quote_held(other, F.col("text")).alias("other"))


@query("""WITH c AS (SELECT doc_id, [doc_id % 5, doc_id % 3, doc_id % 7, doc_id % 5][1:CAST(doc_id % 6 AS BIGINT)] AS cited, [1, 2, doc_id % 4] AS relevant, [doc_id % 5, doc_id % 3, doc_id // 9 % 7] AS offered FROM documents)
SELECT doc_id, round(CASE WHEN len(cited) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(cited), relevant)) / len(list_distinct(cited))::DOUBLE END, 6) AS precision, list_sort(cited) = list_sort(relevant) AS permuted,
len(cited) > 0 AND len(list_filter(cited, lambda x: NOT list_contains(offered, x))) = 0 AS offered FROM c""")
def citation_checks(spark, sf):
    d = F.col("doc_id")
    cited = F.slice(F.array(d % 5, d % 3, d % 7, d % 5), F.lit(1), (d % 6).cast("int"))
    relevant, offered = F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), d % 4), F.array(d % 5, d % 3, F.floor(d / 9) % 7)
    return load(spark, sf, "documents").select("doc_id", F.round(M.citation_precision(cited, relevant), 6).alias("precision"), E.is_permutation(cited, relevant).alias("permuted"), E.is_offered_subset(cited, offered).alias("offered"))


_SLOTS = ("borough", "cuisine", "party", "date", "time")


def _bits(number: str) -> str:
    return "[" + ", ".join(f"CASE WHEN {number} // {1 << k} % 2 = 1 THEN '{name}' END" for k, name in enumerate(_SLOTS)) + "]"


@query(f"""WITH e AS (SELECT event_id, list_filter({_bits('event_id')}, lambda x: x IS NOT NULL) AS before, {_bits('event_id // 32')} AS filled FROM events) SELECT event_id, array_to_string(list_filter(before, lambda x: NOT coalesce(list_contains(filled, x), false)), ',') AS missing FROM e""")
def slot_carry_over(spark, sf):
    named = lambda n: F.array_compact(F.array(*[F.when(F.floor(n / (1 << k)) % 2 == 1, name) for k, name in enumerate(_SLOTS)]))
    e = F.col("event_id")
    return events(spark, sf).select("event_id", F.array_join(S.missing_slots(named(e), named(F.floor(e / 32))), ",").alias("missing"))


@query(f"""WITH {_WORDS}, b AS (SELECT conv_id, turn, coalesce(w[1], '') || CASE WHEN turn % 2 = 0 THEN ' [f' ELSE '' END AS head, left('[follow]', CAST((conv_id + turn) % 9 AS BIGINT)) AS tail, conv_id % 4 = 0 AS more FROM c)
SELECT conv_id, turn, CASE WHEN len(tail) = 8 THEN head WHEN more THEN head || tail || '.' WHEN tail = '' AND head LIKE '%[f' THEN left(head, len(head) - 2) ELSE head END AS stable FROM b""")
def trailer_hold_back(spark, sf):
    """A marker that is whole, cut anywhere, or broken off by other text, behind words that may hold its start as well."""
    head = F.concat(_word(0), F.when(F.col("turn") % 2 == 0, " [f").otherwise(""))
    tail = F.left(F.lit("[follow]"), ((F.col("conv_id") + F.col("turn")) % 9).cast("int"))
    body = F.concat(head, tail, F.when(F.col("conv_id") % 4 == 0, ".").otherwise(""))
    return _talk(spark, sf).select("conv_id", "turn", S.stable_text(body, "[follow]").alias("stable"))


_LABELS = ("Take-Out", "Takeout", "No takeout", "Delivery", " no delivery ", "No-contact delivery", "Cosy", "Dine-in & more", "")
_STATES = {
    "takeout": {"take-out": "true", "takeout": "true", "no takeout": "false", "no take-out": "false"},
    "delivery": {"delivery": "true", "no-contact delivery": "true", "no delivery": "false"},
}


def _state_sql(key: str) -> str:
    cases = " ".join(f"WHEN '{label}' THEN '{state}'" for label, state in _STATES[key].items())
    return f"coalesce(list_filter(list_transform(labels, lambda x: CASE lower(trim(x)) {cases} END), lambda x: x IS NOT NULL)[-1], 'unknown')"


def _label_sql(by: str) -> str:
    return f"list_extract({list(_LABELS)}, CAST({by} % {len(_LABELS)} + 1 AS BIGINT))"


_SLUG = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 \\-&/]', '', 'g'), '[ \\-&/]+', '_', 'g'), '_')"


@query(f"""WITH l AS (SELECT p_partkey, [{_label_sql('p_partkey // 5')}, {_label_sql('p_partkey')}, {_label_sql('p_partkey // 3')}] AS labels FROM part), s AS (SELECT *, list_filter(list_transform(labels, lambda x: {_SLUG.format('x')}), lambda x: x <> '') AS t FROM l)
SELECT p_partkey, {_state_sql('takeout')} AS takeout, {_state_sql('delivery')} AS delivery, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), '|') AS tags FROM s""")
def tri_state_fold(spark, sf):
    """Labels of two topics, read in the order of the topics' names."""
    p = F.col("p_partkey")
    label = lambda by: F.element_at(F.array(*map(F.lit, _LABELS)), (F.floor(by) % len(_LABELS) + 1).cast("int"))
    misc = F.create_map(F.lit("Service options"), F.array(label(p), label(p / 3)), F.lit("Offerings"), F.array(label(p / 5)))
    states = T.tri_states(misc)
    return load(spark, sf, "part").select("p_partkey", states["takeout"].alias("takeout"), states["delivery"].alias("delivery"), F.array_join(T.tags_of(misc, "service_options"), "|").alias("tags"))


_PLACES = (*(c.title() for c in T.CUISINES), "Barber shop", "Fancy & Odd Restaurant", "Public library", "Restaurant", "BBQ joint", "Food restaurant", "Café")
_KNOWN = "MAP {" + ", ".join(f"'{k}': {list(v)}" for k, v in T.CUISINES.items()) + "}"
_MARKERS = "|".join(T.FOOD_MARKERS)


@query(f"""WITH c AS (SELECT p_partkey, [list_extract({list(_PLACES)}, CAST(p_partkey % {len(_PLACES)} + 1 AS BIGINT)), list_extract({list(_PLACES)}, CAST(p_partkey // 7 % {len(_PLACES)} + 1 AS BIGINT))] AS cats FROM part),
o AS (SELECT p_partkey, cats, list_transform(cats, lambda x: CASE WHEN list_contains(map_keys({_KNOWN}), lower(x)) THEN {_KNOWN}[lower(x)]
 WHEN lower(x) LIKE '% restaurant' AND {_SLUG.format("left(x, len(x) - 11)")} NOT IN ({', '.join(f"'{g}'" for g in ('', *T.GENERIC_CUISINES))}) THEN [{_SLUG.format("left(x, len(x) - 11)")}] ELSE [] END) AS t FROM c), f AS (SELECT *, flatten(t) AS u FROM o)
SELECT p_partkey, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), '|') AS tags,
len(list_filter(cats, lambda x: regexp_matches(' ' || trim(regexp_replace(lower(x), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')) || ' ', ' ({_MARKERS}) '))) > 0 AS food FROM f""")
def cuisine_tags(spark, sf):
    p = F.col("p_partkey")
    category = lambda by: F.element_at(F.array(*map(F.lit, _PLACES)), (F.floor(by) % len(_PLACES) + 1).cast("int"))
    categories = F.array(category(p), category(p / 7))
    return load(spark, sf, "part").select("p_partkey", F.array_join(T.cuisine_tags(categories), "|").alias("tags"), T.is_food_place(categories).alias("food"))


@query("""WITH e AS (SELECT event_id, event_id % 24 AS h, event_id // 24 % 60 AS m, event_id // 5 % 24 AS g, event_id % 9 AS form FROM events), t AS (SELECT *, h * 60 + m AS o, g * 60 AS c FROM e)
SELECT event_id, CASE form WHEN 7 THEN 'closed' WHEN 8 THEN '0-1440' ELSE o || '-' || (c + CASE WHEN c <= o THEN 1440 ELSE 0 END) END || ',720-' || CASE WHEN c <= 720 THEN c + 1440 ELSE c END AS hours FROM t""")
def hours_parse(spark, sf):
    """Clock times of both kinds with four marks between them, closed and whole days, noon, a day that is none and an hour that is none."""
    e = F.col("event_id")
    h, m, g, form = e % 24, F.floor(e / 24) % 60, F.floor(e / 5) % 24, e % 9
    half = lambda x, y: F.format_string("%d:%02d%s", (x + 11) % 12 + 1, y, F.when(x < 12, "AM").otherwise(" pm"))
    plain = lambda x, y: F.format_string("%d:%02d", x, y)
    short = F.format_string("%d%s", (g + 11) % 12 + 1, F.when(g < 12, "AM").otherwise("PM"))
    mark = F.element_at(F.array(*map(F.lit, ("–", "—", " to ", "-"))), (form % 4 + 1).cast("int"))
    spec = F.when(form == 7, " Closed").when(form == 8, "Open 24 hours").when(form < 4, F.concat(half(h, m), mark, short)).otherwise(F.concat(plain(h, m), mark, plain(g, F.lit(0))))
    parsed = I.hours(F.array(F.array(F.lit("Tues"), spec), F.array(F.lit("Someday"), F.lit("1PM-2PM")), F.array(F.lit("fri"), F.concat(F.lit("noon-"), short), F.lit("25AM-2PM"))))
    shown = F.transform("h", lambda x: F.when(x["closed"], "closed").otherwise(F.concat(x["open"].cast("string"), F.lit("-"), x["close"].cast("string"))))
    return events(spark, sf).select("event_id", parsed.alias("h")).select("event_id", F.array_join(shown, ",").alias("hours"))


@query("""WITH t AS (SELECT doc_id, doc_id % 4 AS k, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS said FROM documents), c AS (SELECT *, '"' || CASE WHEN length(said) > 200 THEN left(said, 200) || '…' ELSE said END || '"' AS cut FROM t)
SELECT doc_id, CASE k WHEN 0 THEN '{"min_rating":4.5,"open_now":' || CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'null' END || ',"query":' || cut || '}' WHEN 1 THEN '{"query":' || cut || ',"restaurant_ids":[' || doc_id || ',7],"top_k":' || doc_id % 50 || '}' ELSE '{}' END AS kept FROM c""")
def redacted_arguments(spark, sf):
    doc, k = F.col("doc_id"), F.col("doc_id") % 4
    said = F.regexp_replace("text", "[^A-Za-z ]", "")
    tool = F.when(k == 0, "search_restaurants").when(k == 2, "send_mail").otherwise("get_restaurant_evidence")
    search = F.concat(F.lit('{"query": "'), said, F.lit('", "phone": "212", "min_rating": 4.5, "open_now": '), F.when(doc % 3 == 0, "true").otherwise("null"), F.lit("}"))
    recall = F.concat(F.lit('{"top_k": '), (doc % 50).cast("string"), F.lit(', "restaurant_ids": ['), doc.cast("string"), F.lit(', 7], "user": {"a": 1}, "query": "'), said, F.lit('"}'))
    arguments = F.when(k == 0, search).when(k == 3, F.lit("[1]")).otherwise(recall)
    return load(spark, sf, "documents").select("doc_id", I.redact_call(tool, arguments).alias("kept"))


@query("""WITH c AS (SELECT conv_id, turn, [turn % 4, conv_id % 7, turn % 4, 3] AS ids FROM conversations) SELECT conv_id, turn, array_to_string(list_sort(list_distinct(ids)), ',') AS sorted,
CASE WHEN conv_id % 7 < 4 THEN 'accept' WHEN turn % 2 = 0 THEN 'regenerate' ELSE 'fail' END AS verdict FROM c""")
def citation_verdicts(spark, sf):
    ids = F.array(F.col("turn") % 4, F.col("conv_id") % 7, F.col("turn") % 4, F.lit(3).cast("long")).cast("array<bigint>")
    text = F.concat(F.lit("so[^"), F.array_join(ids.cast("array<string>"), "] and [^"), F.lit("]."))
    allowed = F.array(*[F.lit(x).cast("long") for x in range(4)])
    return load(spark, sf, "conversations").select("conv_id", "turn", F.array_join(E.sorted_citations(E.cited_ids(text)), ",").alias("sorted"), E.citation_verdict(text, allowed, F.col("turn") % 2).alias("verdict"))

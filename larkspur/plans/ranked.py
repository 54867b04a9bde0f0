"""Similarity search, fusion, evidence and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import vector as V
from larkspur.operators import evidence as E
from larkspur.operators import filters as P
from larkspur.operators import ranking as R
from larkspur.operators import rollups as A
from larkspur.plans.registry import SQL, query
from larkspur.session import stored
from larkspur.sources.tables import KDOCS, PLACES, TEXTS, kdocs, load, places, texts


def _queries(spark, sf):
    return kdocs(spark, sf).where("document_id % 20 = 0").select(F.col("document_id").alias("query_id"), "scope", "embedding")


_SIM = "greatest(0.0, least(1.0, list_cosine_similarity(d.embedding, q.embedding)))"


@query(f"""WITH {KDOCS} SELECT query_id, document_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT q.document_id AS query_id, d.document_id, {_SIM} AS score,
row_number() OVER (PARTITION BY q.document_id ORDER BY {_SIM} DESC, d.document_id) AS rank FROM kdocs d JOIN kdocs q ON d.scope = q.scope WHERE q.document_id % 20 = 0) WHERE rank <= 5""")
def cosine_topk(spark, sf):
    return R.vector_hits(kdocs(spark, sf), _queries(spark, sf), ["scope"], 5).select("query_id", "document_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {KDOCS} SELECT query_id, document_id, round(score, 6) AS score FROM (SELECT q.document_id AS query_id, d.document_id, {_SIM} AS score,
row_number() OVER (PARTITION BY q.document_id ORDER BY {_SIM} DESC, d.document_id) AS rank FROM kdocs d JOIN kdocs q ON d.scope = q.scope WHERE q.document_id % 20 = 0 AND {_SIM} >= 0.3) WHERE rank <= 20""")
def similarity_floor(spark, sf):
    return R.vector_hits(kdocs(spark, sf), _queries(spark, sf), ["scope"], 20, floor=R.REVIEW_FLOOR).select("query_id", "document_id", F.round("score", 6).alias("score"))


@query(f"""WITH {KDOCS} SELECT query_id, restaurant_id, document_id, round(score, 6) AS score FROM (SELECT q.document_id AS query_id, d.restaurant_id, d.document_id, {_SIM} AS score,
row_number() OVER (PARTITION BY q.document_id, d.restaurant_id ORDER BY {_SIM} DESC, d.document_id) AS rn FROM kdocs d JOIN kdocs q ON d.scope = q.scope WHERE q.document_id % 20 = 0) WHERE rn = 1""")
def pool_rescore_best(spark, sf):
    pool = kdocs(spark, sf).select("scope", "restaurant_id").distinct().join(_queries(spark, sf).select("query_id", "scope"), "scope").select("query_id", "restaurant_id")
    return R.pool_scores(kdocs(spark, sf), _queries(spark, sf), pool, ["scope"]).select("query_id", "restaurant_id", "document_id", F.round("score", 6).alias("score"))


_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_TRI = f"len(list_intersect({_GRAMS.format('name')}, {_GRAMS.format('text')})) / len(list_distinct(list_concat({_GRAMS.format('name')}, {_GRAMS.format('text')})))::DOUBLE"
_ASKED = "q(query_id, text) AS (VALUES (1, 'red'), (2, 'ring'), (3, 'red widget'), (4, 'zzz'))"


def _asked(spark):
    return spark.createDataFrame([(1, "red"), (2, "ring"), (3, "red widget"), (4, "zzz")], "query_id int, text string")


@query(f"""WITH {_ASKED}, s AS (SELECT query_id, p_partkey AS id, p_name AS name, {_TRI.replace("name", "p_name").replace("p_p_name", "p_name")} AS score FROM part, q WHERE contains(lower(p_name), text))
SELECT query_id, id, name, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM s) WHERE rn <= 10""")
def trigram_match(spark, sf):
    items = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("address"))
    return R.text_hits(items, _asked(spark), 10).select("query_id", "id", "name", F.round("score", 6).alias("score"))


@query("""SELECT p_partkey, round(len(list_filter(['red', 'bolt', 'x'], lambda t: contains(lower(p_name), t))) / 3.0, 6) AS score FROM part""")
def token_containment(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.round(V.token_containment(F.lit("Red bolt  x"), F.col("p_name")), 6).alias("score"))


@query(f"""WITH {_ASKED}, s AS (SELECT query_id, p_partkey AS id, {_TRI.replace("name", "p_name").replace("p_p_name", "p_name")} AS score FROM q LEFT JOIN part ON contains(lower(p_name), text)),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn, lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, id) AS second FROM s WHERE score >= 0.55)
SELECT q.query_id, CASE WHEN g.id IS NULL THEN 'not_found' WHEN g.score - second < 0.1 THEN 'ambiguous' ELSE 'resolved' END AS status, coalesce(g.id, -1) AS id, round(g.score, 6) AS score FROM q LEFT JOIN g ON g.query_id = q.query_id AND rn = 1""")
def resolve_name(spark, sf):
    items = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("address"))
    hits = R.text_hits(items, _asked(spark), 2)
    matches = _asked(spark).select("query_id").join(hits.select("query_id", "id", "score"), "query_id", "left")
    return R.resolve_names(matches).select("query_id", "status", F.coalesce("id", F.lit(-1).cast("long")).alias("id"), F.round("score", 6).alias("score"))


@query("""SELECT conv_id, turn, CAST(m AS INTEGER) AS matched FROM (SELECT conv_id, turn, CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'tion') AS INTEGER) + CAST(contains(lower(text), 'zzz') AS INTEGER) AS m FROM conversations) WHERE m > 0""")
def memory_terms(spark, sf):
    low = F.lower("text")
    matched = sum((F.contains(low, F.lit(t)).cast("int") for t in P.query_terms("the TION zzz a the")), F.lit(0))
    return load(spark, sf, "conversations").select("conv_id", "turn", matched.alias("matched")).where("matched > 0")


# ---- fusion: four channels over places, with many queries in one plan


def _tri(a: str, b: str) -> str:
    return f"len(list_intersect({_GRAMS.format(a)}, {_GRAMS.format(b)})) / len(list_distinct(list_concat({_GRAMS.format(a)}, {_GRAMS.format(b)})))::DOUBLE"


_BOROUGHS = ("africa", "america", "asia", "europe", "middle east")

#: Every twentieth document asks: for an area, for a street, and for what is near its vector within its scope.
_HITS = f"""{PLACES}, {KDOCS}, asked AS (SELECT document_id AS q, scope, embedding, list_extract({list(_BOROUGHS)}, CAST(document_id // 20 % {len(_BOROUGHS)} + 1 AS BIGINT)) AS area, 'street ' || document_id // 20 % 97 AS said FROM kdocs WHERE document_id % 20 = 0),
 near AS (SELECT a.q, d.document_id, d.restaurant_id, {_SIM.replace("q.embedding", "a.embedding")} AS score FROM kdocs d JOIN asked a ON d.scope = a.scope),
 said AS (SELECT q, restaurant_id, greatest({_tri('name', 'said')}, {_tri('address', 'said')}) AS score FROM places JOIN asked ON contains(lower(address), said) OR contains(lower(name), said)),
 hits AS (SELECT q AS query_id, 'structured' AS channel, restaurant_id, 1.0::DOUBLE AS score FROM places JOIN asked ON borough = area WHERE is_active AND rating >= 3.0
  UNION ALL SELECT q, 'keyword', restaurant_id, round(score, 6) FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, restaurant_id) AS rn FROM said) WHERE rn <= 500
  UNION ALL SELECT q, 'vector', document_id, round(score, 6) FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, document_id) AS rn FROM near) WHERE rn <= 200
  UNION ALL SELECT q, 'review', restaurant_id, round(score, 6) FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, document_id) AS rn FROM near WHERE score >= 0.1) WHERE rn <= 200),
 pool AS (SELECT query_id, restaurant_id, CASE WHEN rating > 0 THEN 4.0 + (rating - 4.0) * rating_count / (rating_count + 50.0) ELSE 0.0 END AS prior FROM (SELECT DISTINCT query_id, restaurant_id FROM hits) JOIN places USING (restaurant_id) WHERE is_active)"""
_BEST = "best AS (SELECT h.query_id, h.channel, h.restaurant_id, max(score) AS raw FROM hits h SEMI JOIN pool p ON h.query_id = p.query_id AND h.restaurant_id = p.restaurant_id GROUP BY 1, 2, 3)"
_WEIGHT = "CASE channel WHEN 'structured' THEN 1.0 WHEN 'keyword' THEN 0.5 WHEN 'vector' THEN 1.0 ELSE 0.8 END"
_FUSED = """s AS (SELECT query_id, restaurant_id, sum(c) AS ch FROM parts GROUP BY 1, 2), k AS (SELECT s.*, prior FROM s JOIN pool USING (query_id, restaurant_id)),
 b AS (SELECT *, min(prior) OVER (PARTITION BY query_id) AS lo, max(prior) OVER (PARTITION BY query_id) AS hi FROM k), t AS (SELECT query_id, restaurant_id, round(ch + 0.2 * CASE WHEN hi - lo <= 0 THEN 0.5 ELSE (prior - lo) / (hi - lo) END, 9) AS total FROM b)
SELECT query_id, restaurant_id, total, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, restaurant_id) AS rank FROM t) WHERE rank <= 10"""


def _asking(spark, sf):
    """Every twentieth document with what it asks for; not marked for broadcast, as their number grows with the table."""
    at = F.floor(F.col("document_id") / 20)
    area = F.element_at(F.array(*map(F.lit, _BOROUGHS)), (at % len(_BOROUGHS) + 1).cast("int"))
    return kdocs(spark, sf).where("document_id % 20 = 0").select(F.col("document_id").alias("query_id"), "scope", "embedding", area.alias("borough"), F.concat(F.lit("street "), (at % 97).cast("string")).alias("text"))


def _hits(spark, sf, floor=0.1):
    """(hits, pool, shared): the hits of the channels that search, the active places among them with their priors, and the channel of
    conditions, whose hits are the same for all who ask for an area. The hits are written once."""
    from larkspur.functions.text import rating_prior

    all_places, docs, asked = places(spark, sf), kdocs(spark, sf), _asking(spark, sf)
    hit = lambda df, channel, place, score: df.select("query_id", F.lit(channel).alias("channel"), F.col(place).alias("restaurant_id"), F.round(score, 6).alias("score"))
    prior = rating_prior(F.col("rating"), F.col("rating_count")).alias("prior")
    shared = R.Shared("structured", "borough", 1.0, all_places.where("is_active AND rating >= 3.0").select("borough", "restaurant_id", prior), asked.select("query_id", "borough"))
    named = all_places.select(F.col("restaurant_id").alias("id"), "name", "address")
    keyword = hit(R.text_hits(named, asked.select("query_id", "text"), 500), "keyword", "id", F.col("score"))
    near = stored(R.vector_hits(docs, asked, ["scope"], 200), "near")
    vector = hit(near, "vector", "document_id", F.col("score"))
    review = hit(near.where(F.col("score") >= floor), "review", "restaurant_id", F.col("score"))  # the first of those above a floor are above it among the first
    hits = stored(keyword.unionByName(vector).unionByName(review), "hits")
    known = all_places.where("is_active").select("restaurant_id", prior)
    return hits, hits.select("query_id", "restaurant_id").distinct().join(known, "restaurant_id"), shared


@query(f"""WITH {_HITS}, {_BEST}, r AS (SELECT query_id, CASE WHEN channel IN ('vector', 'review') THEN 'semantic' ELSE channel END AS family, min(score) AS lo, max(score) AS hi FROM hits GROUP BY 1, 2),
 parts AS (SELECT b.query_id, restaurant_id, {_WEIGHT} * CASE WHEN hi - lo <= 0 THEN 0.5 ELSE (raw - lo) / (hi - lo) END AS c FROM best b JOIN r ON b.query_id = r.query_id AND r.family = CASE WHEN channel IN ('vector', 'review') THEN 'semantic' ELSE channel END), {_FUSED}""")
def fuse_weighted(spark, sf):
    hits, pool, shared = _hits(spark, sf)
    return R.fuse(hits, pool, "weighted", top=10, shared=shared)


@query(f"""WITH {_HITS}, {_BEST}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY raw DESC, restaurant_id) AS n FROM best), parts AS (SELECT query_id, restaurant_id, {_WEIGHT} / (60.0 + n) AS c FROM rk), {_FUSED}""")
def fuse_rrf(spark, sf):
    hits, pool, shared = _hits(spark, sf)
    return R.fuse(hits, pool, "rrf", top=10, shared=shared)


@query(f"""WITH {_HITS} SELECT DISTINCT h.query_id, channel, h.restaurant_id FROM hits h ANTI JOIN pool p ON h.query_id = p.query_id AND h.restaurant_id = p.restaurant_id""")
def unknown_hits(spark, sf):
    hits, pool, _ = _hits(spark, sf)  # what the conditions find is active, so in the pool
    return R.unknown_hits(hits, pool)


@query(f"""WITH {_HITS}, ex AS (SELECT query_id, 'review' AS channel, restaurant_id, round((restaurant_id % 11) / 11.0::DOUBLE, 6) AS score FROM pool WHERE prior > 3.5)
SELECT query_id, channel, restaurant_id, score FROM hits WHERE channel <> 'review' UNION ALL SELECT query_id, channel, restaurant_id, score FROM ex WHERE score >= 0.3""")
def rescore_overlay(spark, sf):
    return _rescored(*_hits(spark, sf))


def _rescored(hits, pool, shared):
    """The channel of conditions is not rescored; the places it shares with a pool are rescored with its own, each once."""
    found = shared.hits().select("query_id", "channel", "restaurant_id", "score", "prior")
    whole = pool.join(shared.of(pool), ["query_id", "restaurant_id"], "left_anti").select("query_id", "restaurant_id", "prior").unionByName(found.select("query_id", "restaurant_id", "prior"))
    exact = whole.where("prior > 3.5").select("query_id", F.lit("review").alias("channel"), "restaurant_id", F.round((F.col("restaurant_id") % 11) / 11.0, 6).alias("score"))
    return R.rescored(hits, exact, {"review": 0.3}).unionByName(found.drop("prior"))


# the same under the names that told them from queries over three documents
fuse_weighted_all, fuse_rrf_all, unknown_hits_all, rescore_overlay_all = (query(SQL[f.__name__], f"{f.__name__}_all")(f) for f in (fuse_weighted, fuse_rrf, unknown_hits, rescore_overlay))


@query(f"""WITH {PLACES}, c AS (SELECT 1 AS o, restaurant_id, CASE WHEN restaurant_id % 5 <> 0 THEN address END AS address, CASE WHEN restaurant_id % 3 <> 1 THEN rating END AS rating, CASE WHEN restaurant_id % 2 = 0 THEN rating END AS prior FROM places
 UNION ALL SELECT 2, restaurant_id, address || CASE WHEN restaurant_id % 3 = 0 THEN ' x' ELSE '' END, rating + 1, 1.5 FROM places WHERE restaurant_id % 4 <> 0
 UNION ALL SELECT 3, restaurant_id, name || ' é ' || address, rating + 2, CASE WHEN restaurant_id % 6 = 0 THEN 2.5 END FROM places WHERE restaurant_id % 7 <> 0),
s AS (SELECT *, coalesce(octet_length(encode(address)), 0) AS size FROM c), t AS (SELECT *, coalesce(size > max(size) OVER (PARTITION BY restaurant_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS takes FROM s)
SELECT restaurant_id, max_by(struct_pack(a := address), o) FILTER (WHERE takes).a AS address, min_by(rating, o) FILTER (WHERE takes AND rating IS NOT NULL) AS rating, max_by(prior, o) FILTER (WHERE prior IS NOT NULL) AS prior FROM t GROUP BY 1""")
def merge_pool(spark, sf):
    rows, place = places(spark, sf).select(F.lit(0).alias("query_id"), "restaurant_id", "name", "address", "rating"), F.col("restaurant_id")
    rated = lambda more: (F.col("rating") + more).alias("rating")
    one = rows.select("query_id", F.lit(1).alias("channel_order"), "restaurant_id", F.when(place % 5 != 0, F.col("address")).alias("address"), F.when(place % 3 != 1, F.col("rating")).alias("rating"), F.when(place % 2 == 0, F.col("rating")).alias("prior"))
    two = rows.where("restaurant_id % 4 <> 0").select("query_id", F.lit(2).alias("channel_order"), "restaurant_id", F.concat("address", F.when(place % 3 == 0, " x").otherwise("")).alias("address"), rated(1), F.lit(1.5).alias("prior"))
    three = rows.where("restaurant_id % 7 <> 0").select("query_id", F.lit(3).alias("channel_order"), "restaurant_id", F.concat("name", F.lit(" é "), "address").alias("address"), rated(2), F.when(place % 6 == 0, 2.5).alias("prior"))
    return R.merge_pool(one.unionByName(two).unionByName(three)).select("restaurant_id", "address", "rating", "prior")


# ---- evidence


_DOCS = """d AS (SELECT doc_id AS document_id, restaurant_id, CASE WHEN doc_id % 3 = 0 THEN 'profile' ELSE 'sample' END AS doc_type, sha256(text) AS content_hash, (doc_id % 101) / 101.0::DOUBLE AS score, text AS content FROM texts)"""


def _evidence(spark, sf):
    doc = F.col("doc_id")
    return texts(spark, sf).select(
        doc.alias("document_id"), "restaurant_id", F.when(doc % 3 == 0, "profile").otherwise("sample").alias("doc_type"), F.sha2("text", 256).alias("content_hash"), ((doc % 101) / 101.0).alias("score"),
        F.col("text").alias("content"),
    )


@query(f"""WITH {TEXTS}, {_DOCS}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY restaurant_id, doc_type, content_hash ORDER BY score DESC, document_id) AS rn FROM d) WHERE rn = 1)
SELECT restaurant_id, doc_type, document_id FROM (SELECT *, row_number() OVER (PARTITION BY restaurant_id, doc_type ORDER BY score DESC, document_id) AS n FROM u) WHERE n <= 3""")
def evidence_dedupe_cap(spark, sf):
    return E.cap_per_kind(E.dedupe(_evidence(spark, sf))).select("restaurant_id", "doc_type", "document_id")


def _assembled(budget: int) -> str:
    """Greedy by score over whole texts, then the floor of two kinds: ``pre`` is what the kept rows cost up to each."""
    return f"""WITH RECURSIVE {TEXTS}, {_DOCS}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY restaurant_id, doc_type, content_hash ORDER BY score DESC, document_id) AS rn FROM d) WHERE rn = 1),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY restaurant_id, doc_type ORDER BY score DESC, document_id) AS n3 FROM u) WHERE n3 <= 3),
p AS (SELECT restaurant_id, document_id, doc_type, greatest(1, length(regexp_replace(content, '[\\x00-\\xff]', '', 'g')) + (length(content) - length(regexp_replace(content, '[\\x00-\\xff]', '', 'g'))) // 4) AS cost,
  row_number() OVER (PARTITION BY restaurant_id ORDER BY score DESC, document_id) AS n FROM c),
f AS (SELECT restaurant_id, n, cost <= {budget} AS keep, CASE WHEN cost <= {budget} THEN cost ELSE 0 END AS spent FROM p WHERE n = 1
 UNION ALL SELECT p.restaurant_id, p.n, f.spent + p.cost <= {budget}, f.spent + CASE WHEN f.spent + p.cost <= {budget} THEN p.cost ELSE 0 END FROM f JOIN p ON p.restaurant_id = f.restaurant_id AND p.n = f.n + 1),
k AS (SELECT p.*, sum(cost) OVER (PARTITION BY p.restaurant_id ORDER BY p.n) AS pre, count(*) OVER (PARTITION BY p.restaurant_id) AS size, min(doc_type) OVER (PARTITION BY p.restaurant_id) AS kind, max(doc_type) OVER (PARTITION BY p.restaurant_id) AS kind2
 FROM p JOIN f USING (restaurant_id, n) WHERE keep),
x AS (SELECT p.restaurant_id, min(p.n) AS n FROM p JOIN (SELECT DISTINCT restaurant_id, kind FROM k WHERE size > 1 AND kind = kind2) s ON s.restaurant_id = p.restaurant_id AND p.doc_type <> s.kind GROUP BY 1),
e AS (SELECT x.restaurant_id, x.n, p.document_id, p.cost FROM x JOIN p USING (restaurant_id, n) WHERE p.cost + (SELECT min(pre) FROM k WHERE k.restaurant_id = x.restaurant_id) <= {budget}),
r AS (SELECT k.restaurant_id, k.n, k.document_id, k.cost FROM k LEFT JOIN e USING (restaurant_id) WHERE e.cost IS NULL OR pre + e.cost <= {budget} UNION ALL SELECT restaurant_id, n, document_id, cost FROM e)
SELECT restaurant_id, document_id, CAST(cost AS BIGINT) AS cost, row_number() OVER (PARTITION BY restaurant_id ORDER BY n) AS position, 'kept' AS status FROM r
UNION ALL SELECT DISTINCT restaurant_id, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, 'budget_exceeded' FROM p WHERE restaurant_id NOT IN (SELECT restaurant_id FROM k)"""


@query(_assembled(E.DEFAULT_BUDGET))
def budget_greedy(spark, sf):
    return E.assemble(_evidence(spark, sf))


@query(_assembled(400))
def budget_whole_texts(spark, sf):
    """A budget that few whole texts fit."""
    return E.assemble(_evidence(spark, sf), 400)


@query("""WITH c AS (SELECT conv_id, turn, length(regexp_replace(text, '[\\x00-\\xff]', '', 'g')) AS w, length(text) AS l, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
k AS (SELECT *, CASE WHEN l = 0 THEN 0 ELSE greatest(1, w + (l - w) // 4) END AS cost FROM c WHERE rn <= 6)
SELECT conv_id, turn, CAST(cost AS INTEGER) AS cost FROM (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s FROM k) WHERE s <= 150""")
def history_trim(spark, sf):
    return E.trim_history(load(spark, sf, "conversations"), "conv_id", "turn", 6, 150).select("conv_id", "turn", "cost")


@query("""WITH t AS (SELECT conv_id, turn, '[^' || conv_id % 5 || '] a [^9][^' || turn || '] b [^9]' AS txt FROM conversations), x AS (SELECT *, list_transform(regexp_extract_all(txt, '\\[\\^(\\d+)\\]', 1), lambda v: v::BIGINT) AS ids FROM t)
SELECT conv_id, turn, array_to_string(ids, ',') AS cited, CAST(len(list_filter(list_distinct(ids), lambda v: v NOT IN (0, 1, 2, 3))) AS INTEGER) AS invalid FROM x""")
def citation_closure(spark, sf):
    text = F.concat(F.lit("[^"), (F.col("conv_id") % 5).cast("string"), F.lit("] a [^9][^"), F.col("turn").cast("string"), F.lit("] b [^9]"))
    allowed = F.array(*[F.lit(x).cast("long") for x in range(4)])
    return load(spark, sf, "conversations").select("conv_id", "turn", F.array_join(E.cited_ids(text), ",").alias("cited"), F.size(E.invalid_citations(text, allowed)).alias("invalid"))


@query(f"""WITH {TEXTS} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'empty_content' WHEN doc_id % 7 = 0 THEN 'missing_source' WHEN doc_id % 11 = 0 THEN 'missing_snapshot' WHEN doc_id % 13 = 0 THEN 'snapshot_in_future' WHEN doc_id % 17 = 0 THEN 'implausible_snapshot' WHEN doc_id <= 0 THEN 'missing_document_id' END AS reason FROM texts""")
def completeness_reasons(spark, sf):
    doc = F.col("doc_id")
    at = F.when(doc % 11 == 0, None).when(doc % 13 == 0, "2999-01-01").when(doc % 17 == 0, "1999-01-01").otherwise("2021-01-01").cast("timestamp")
    rows = texts(spark, sf).select("doc_id", doc.alias("document_id"), F.when(doc % 5 == 0, " ").otherwise("x").alias("content"), F.when(doc % 7 == 0, "").otherwise("s").alias("source"), at.alias("snapshot_at"))
    return rows.select("doc_id", E.incompleteness(F.current_timestamp()).alias("reason"))


@query("""SELECT 1 AS k, 'empty_content x' || a || ', token_budget x' || b AS summary FROM (SELECT count(*) FILTER (WHERE doc_id % 3 <> 0) AS a, count(*) FILTER (WHERE doc_id % 3 = 0) AS b FROM documents)""")
def drop_reasons(spark, sf):
    rows = load(spark, sf, "documents").select(F.lit(1).alias("k"), F.when(F.col("doc_id") % 3 == 0, "token_budget").otherwise("empty_content").alias("reason"))
    return A.drop_summary(rows, "k")


@query(f"""WITH {KDOCS}, r AS (SELECT q.document_id AS query_id, d.document_id AS id, row_number() OVER (PARTITION BY q.document_id ORDER BY {_SIM} DESC, d.document_id) AS rank FROM kdocs d JOIN kdocs q ON q.document_id % 20 = 0),
t AS (SELECT q.document_id AS query_id, d.document_id AS id FROM kdocs d JOIN kdocs q ON d.scope = q.scope AND q.document_id % 20 = 0), n AS (SELECT query_id, count(*) AS relevant FROM t GROUP BY 1)
SELECT n.query_id, relevant, count(t.id) AS hits, round(count(t.id) / least(relevant, 50)::DOUBLE, 6) AS recall FROM n LEFT JOIN (SELECT * FROM r WHERE rank <= 50) r USING (query_id) LEFT JOIN t ON t.query_id = n.query_id AND t.id = r.id GROUP BY 1, 2""")
def recall_at_k(spark, sf):
    asked = _queries(spark, sf).withColumn("one", F.lit(1)).select("query_id", "one", "embedding")
    found = R.vector_hits(kdocs(spark, sf).withColumn("one", F.lit(1)), asked, ["one"], 50).select("query_id", F.col("document_id").alias("id"), "rank")
    members = kdocs(spark, sf).select(F.col("document_id").alias("id"), "scope")
    return A.recall_of_groups(found, members, _queries(spark, sf), "scope", 50).select("query_id", "relevant", "hits", F.round("recall", 6).alias("recall"))

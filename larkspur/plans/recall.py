"""Document recall, memories, selection, topic keywords and small audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import memory as M
from larkspur.operators import recall as C
from larkspur.operators import rollups as A
from larkspur.operators import vector_index as V
from larkspur.plans.curation import _TOPICS, _scores
from larkspur.plans.importing import selected
from larkspur.plans.registry import SQL, query
from larkspur.sources.tables import PLACES, TEXTS, load, places, texts

_KINDS = ("restaurant_profile", "restaurant_review_summary", "representative_reviews", "restaurant_attributes")
_NAMES = tuple(sorted(T.TOPICS))


def knowledge(spark, sf):
    """Stored documents: the vectors with a place, borough, scope, kind and topic by their ids."""
    n = F.col("vec_id")
    pick = lambda words, by: F.element_at(F.array(*map(F.lit, words)), (by % len(words) + 1).cast("int"))
    return load(spark, sf, "embeddings").select(
        n.alias("document_id"), (n % 40).alias("restaurant_id"), F.concat(F.lit("area"), (n % 40 % 5).cast("string")).alias("borough"), F.when(n % 3 == 0, "profile").otherwise("evidence").alias("scope"),
        pick(_KINDS, F.floor(n / 40)).alias("doc_type"), pick(_NAMES, F.floor(n / 7)).alias("topic"), (n % 11 != 0).alias("is_active"), F.col("embedding").cast("array<double>").alias("embedding"),
    )


def _pick(words, by: str) -> str:
    return f"list_extract({list(words)}, CAST({by} % {len(words)} + 1 AS BIGINT))"


KNOWLEDGE = f"""k AS (SELECT vec_id AS document_id, vec_id % 40 AS restaurant_id, 'area' || vec_id % 40 % 5 AS borough, CASE WHEN vec_id % 3 = 0 THEN 'profile' ELSE 'evidence' END AS scope,
 {_pick(_KINDS, "vec_id // 40")} AS doc_type, {_pick(_NAMES, "vec_id // 7")} AS topic, vec_id % 11 <> 0 AS is_active, embedding::DOUBLE[] AS embedding FROM embeddings)"""


def requests(spark, sf):
    """Every document whose id is divisible by 20 asks: by its number with a borough, places, kinds, a topic, and without a vector."""
    q, at = F.col("document_id"), F.floor(F.col("document_id") / 20)
    near = F.array(F.col("restaurant_id"), (F.col("restaurant_id") + 7) % 40, F.col("restaurant_id"))
    return knowledge(spark, sf).where("document_id % 20 = 0").select(
        q.alias("query_id"), "scope", F.when(at % 2 == 0, F.col("borough")).alias("borough"), F.when(at % 5 == 0, F.array().cast("array<bigint>")).when(at % 5 == 1, F.slice(near, 1, 1)).when(at % 5 < 4, near).alias("places"),
        F.when(at % 7 < 2, F.array(F.lit(_KINDS[1]), F.lit(_KINDS[2]))).alias("kinds"), F.when(at % 6 == 0, F.col("topic")).alias("topic"), F.when(at % 3 != 0, F.col("embedding")).alias("embedding"), F.col("embedding").alias("vector"),
    )


REQUESTS = f"""r AS (SELECT document_id AS query_id, scope, CASE WHEN document_id // 20 % 2 = 0 THEN borough END AS borough,
 CASE document_id // 20 % 5 WHEN 0 THEN []::BIGINT[] WHEN 1 THEN [restaurant_id] WHEN 4 THEN NULL ELSE [restaurant_id, (restaurant_id + 7) % 40] END AS places,
 CASE document_id // 20 % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 4 THEN 0 ELSE 3 END AS named, CASE WHEN document_id // 20 % 7 < 2 THEN ['{_KINDS[1]}', '{_KINDS[2]}'] END AS kinds,
 CASE WHEN document_id // 20 % 6 = 0 THEN topic END AS topic, CASE WHEN document_id // 20 % 3 <> 0 THEN embedding END AS embedding, embedding AS vector FROM k WHERE document_id % 20 = 0)"""
_ON_TOPIC = f"(r.topic IS NULL OR (k.doc_type = '{C.SUMMARY}' AND k.topic = r.topic))"
_ON_KIND = "(r.kinds IS NULL OR list_contains(r.kinds, k.doc_type))"


@query(f"""WITH {KNOWLEDGE}, {REQUESTS}, s AS (SELECT query_id, k.document_id, greatest(0.0, least(1.0, list_cosine_similarity(k.embedding, r.vector))) AS score
 FROM k JOIN r ON k.scope = r.scope WHERE is_active AND (r.borough IS NULL OR k.borough = r.borough) AND (coalesce(len(r.places), 0) = 0 OR list_contains(r.places, k.restaurant_id)) AND {_ON_KIND} AND {_ON_TOPIC})
SELECT query_id, document_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM s) WHERE rank <= 10""")
def scoped_vector_topk(spark, sf):
    asked = requests(spark, sf).withColumn("embedding", F.col("vector"))
    return C.scoped_vector_hits(knowledge(spark, sf), asked, 10).withColumn("score", F.round("score", 6))


def _indexed(spark, sf):
    from larkspur.session import shared_folder

    asked = requests(spark, sf).select("query_id", "scope", "borough", F.col("vector").alias("embedding"))
    return V.build_index(knowledge(spark, sf), shared_folder(spark, "index"), 64), asked


@query()
def indexed_vector_topk(spark, sf):
    """The calibrated cells of every twentieth vector; its recall against the exact way is tested."""
    index, asked = _indexed(spark, sf)
    return V.index_hits(spark, index, asked, 10).withColumn("score", F.round("score", 6))


@query(f"""WITH {KNOWLEDGE}, {REQUESTS}, s AS (SELECT query_id, k.document_id, greatest(0.0, least(1.0, list_cosine_similarity(k.embedding, r.vector))) AS score
 FROM k JOIN r ON k.scope = r.scope WHERE is_active AND (r.borough IS NULL OR k.borough = r.borough))
SELECT query_id, document_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM s) WHERE rank <= 10""")
def indexed_vector_exact(spark, sf):
    """The same index, all cells read."""
    index, asked = _indexed(spark, sf)
    return V.index_hits(spark, index, asked, 10, exact=True).withColumn("score", F.round("score", 6))


@query(f"""WITH {KNOWLEDGE}, {REQUESTS}, s AS (SELECT query_id, k.document_id, k.restaurant_id, k.doc_type, r.embedding IS NULL AS plain, named = 1 AS one,
 CASE WHEN r.embedding IS NOT NULL THEN greatest(0.0, least(1.0, list_cosine_similarity(k.embedding, r.vector))) END AS score
 FROM k JOIN r ON list_contains(r.places, k.restaurant_id) WHERE is_active AND k.scope = 'evidence' AND {_ON_TOPIC} AND ((r.embedding IS NULL AND named = 1) OR {_ON_KIND})),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, CASE WHEN plain THEN restaurant_id END, CASE WHEN plain THEN doc_type END, document_id) AS rank FROM s)
SELECT query_id, document_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 5 OR (plain AND one)""")
def evidence_recall(spark, sf):
    return C.evidence_recall(knowledge(spark, sf), requests(spark, sf), 5).withColumn("score", F.round("score", 6))


@query(f"""WITH {KNOWLEDGE}, {REQUESTS} SELECT query_id, 'no_scope' AS reason FROM r WHERE coalesce(len(places), 0) = 0""")
def evidence_refused(spark, sf):
    return C.refused(requests(spark, sf))


@query(f"""WITH {KNOWLEDGE}, a AS (SELECT document_id AS query_id, unnest([document_id + 3, document_id, document_id + 1, document_id + 3, document_id + 11]) AS id, unnest([0, 1, 2, 3, 4]) AS pos FROM k WHERE document_id % 20 = 0),
f AS (SELECT query_id, id, min(pos) AS pos FROM a GROUP BY 1, 2) SELECT query_id, id AS document_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS position FROM f JOIN k ON k.document_id = id WHERE is_active AND scope = 'evidence'""")
def evidence_by_id(spark, sf):
    d = F.col("document_id")
    asked = knowledge(spark, sf).where("document_id % 20 = 0").select(d.alias("query_id"), F.array(d + 3, d, d + 1, d + 3, d + 11).alias("ids"))
    return C.documents_by_id(knowledge(spark, sf), asked)


@query(f"""WITH {KNOWLEDGE}, {PLACES}, h AS (SELECT a.document_id AS query_id, b.restaurant_id FROM k a JOIN k b ON b.scope = a.scope AND b.doc_type = a.doc_type AND b.is_active WHERE a.document_id % 20 = 0),
j AS (SELECT query_id, p.restaurant_id IS NOT NULL AS known, coalesce(p.rating >= 2.0, false) AS keep FROM h LEFT JOIN places p ON p.restaurant_id = h.restaurant_id AND p.is_active)
SELECT query_id, count(*) AS found, count(*) FILTER (WHERE NOT known) AS unknown, count(*) FILTER (WHERE known AND NOT keep) AS removed FROM j GROUP BY 1""")
def detail_backfill(spark, sf):
    docs = knowledge(spark, sf)
    asked = docs.where("document_id % 20 = 0").select(F.col("document_id").alias("query_id"), "scope", "doc_type")
    details = places(spark, sf).where("is_active").select("restaurant_id", "name", "address", "rating")
    return C.backfill_counts(docs.where("is_active"), asked, ["scope", "doc_type"], details, F.col("rating") >= 2.0)


@query("""WITH t AS (SELECT conv_id, turn, role AS topic, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM conversations), c AS (SELECT conv_id, turn, topic, coalesce(w[1], '') AS a, coalesce(w[2], '') AS b, coalesce(w[3], '') AS question FROM t),
s AS (SELECT *, list_filter(CASE WHEN lower(a) = lower(b) THEN [a, topic] WHEN a = '' THEN [topic] WHEN b = '' THEN [a, topic] ELSE [a, topic, b] END, lambda x: x <> '') AS said FROM c)
SELECT conv_id, turn, array_to_string(list_filter(list_concat([question], said), lambda x: x <> ''), ' ') AS text,
 '评论推断：' || array_to_string(CASE WHEN a = '' AND b = '' THEN [topic] WHEN lower(a) = lower(b) OR b = '' THEN [a || '（' || topic || '）'] || CASE WHEN b = '' THEN [topic] ELSE [] END ELSE [a || '（' || topic || '）', b || '（' || topic || '）'] END, '、') AS reason FROM s""")
def soft_texts(spark, sf):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
    asked = load(spark, sf, "conversations").select("conv_id", "turn", word(2).alias("question"), F.array(*[F.struct(word(i).alias("words"), F.col("role").alias("topic")) for i in (0, 1)]).alias("soft"))
    return asked.select("conv_id", "turn", C.embedding_text(F.col("question"), F.col("soft")).alias("text"), C.soft_reason(F.col("soft")).alias("reason"))


@query("""SELECT vec_id, len(embedding) AS size, true AS same FROM embeddings WHERE len(embedding) > 0""")
def vector_text(spark, sf):
    rows = load(spark, sf, "embeddings").where(F.size("embedding") > 0)
    return rows.select("vec_id", F.size("embedding").cast("long").alias("size"), (C.parsed_vector(C.vector_literal(F.col("embedding"))) == F.col("embedding")).alias("same"))


# ---- memories


def memories(spark, sf):
    """Turns of conversations as memories of fifty users."""
    key = F.col("conv_id") + F.col("turn")
    at = F.timestamp_seconds(1_700_000_000 + key % 97 * 60)
    kind = F.when(key % 5 == 0, "constraint").when(key % 5 < 3, "preference").otherwise("fact")
    return load(spark, sf, "conversations").select(
        (F.col("conv_id") % 50).alias("user_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("memory_id"), kind.alias("type"), F.col("text").alias("content"), ((key % 4) / 4.0).alias("confidence"),
        F.timestamp_seconds(1_600_000_000 + key % 3).alias("created_at"), at.alias("updated_at"), F.when(key % 13 == 0, at).alias("deleted_at"),
    )


_LIVE = """m AS (SELECT conv_id % 50 AS user_id, conv_id * 1000 + turn AS memory_id, CASE WHEN (conv_id + turn) % 5 = 0 THEN 'constraint' ELSE 'other' END AS type, text AS content, (conv_id + turn) % 4 AS trust,
 (conv_id + turn) % 3 AS created, (conv_id + turn) % 97 AS updated FROM conversations WHERE (conv_id + turn) % 13 <> 0), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated DESC, created DESC, memory_id) AS place FROM m)"""


@query(f"""WITH {_LIVE} SELECT user_id, memory_id, CAST(place AS INTEGER) AS place FROM l""")
def memory_list(spark, sf):
    return M.listed(memories(spark, sf)).select("user_id", "memory_id", "place")


@query(f"""WITH {_LIVE}, q AS (SELECT user_id, CASE user_id % 3 WHEN 0 THEN ['zzzz'] WHEN 1 THEN ['the', 'tion'] ELSE ['ing', 'rea'] END AS terms FROM (SELECT DISTINCT user_id FROM m)),
x AS (SELECT l.*, len(list_filter(terms, lambda t: contains(lower(content), t))) AS matched FROM l JOIN q USING (user_id)), h AS (SELECT user_id, memory_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY matched DESC, place) AS rn FROM x WHERE matched > 0) WHERE rn <= 10),
t AS (SELECT x.*, row_number() OVER (PARTITION BY user_id, type = 'constraint' ORDER BY trust DESC, place) AS rn, count(*) FILTER (WHERE type <> 'constraint') OVER (PARTITION BY user_id) AS others, user_id IN (SELECT user_id FROM h) AS found, memory_id IN (SELECT memory_id FROM h) AS hit FROM x)
SELECT user_id, memory_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY place) AS INTEGER) AS position, found OR others = 0 AS by_relevance FROM t WHERE type = 'constraint' OR CASE WHEN found THEN hit ELSE rn <= 10 END""")
def memory_selection(spark, sf):
    user = F.col("user_id")
    turns = memories(spark, sf).select("user_id").distinct().withColumn("question", F.when(user % 3 == 0, "zzzz a").when(user % 3 == 1, "the  TION the").otherwise("ing rea a"))
    return M.selected(memories(spark, sf), turns)


# ---- selection, keywords, audits


@query(f"""WITH {PLACES}, s AS (SELECT restaurant_id, score FROM ({SQL["knowledge_score"].removeprefix(f"WITH {PLACES} ")})), e AS (SELECT *, row_number() OVER (ORDER BY score DESC, lpad(CAST(restaurant_id AS VARCHAR), 9, '0')) AS rn FROM s WHERE score > -100)
SELECT s.restaurant_id, coalesce(rn <= 2000, false) AS is_active FROM s LEFT JOIN e USING (restaurant_id)""")
def demo_selection(spark, sf):
    scored = _scores(spark, sf).select("restaurant_id", F.lpad(F.col("restaurant_id").cast("string"), 9, "0").alias("gmap_id"), F.col("score").alias("knowledge_score"), F.when(F.col("score") == -100, "permanently_closed").otherwise("open").alias("snapshot_status"), F.lit(40.7).alias("lat"))
    return selected(scored, 2000).select("restaurant_id", "is_active")


@query(f"""WITH {TEXTS}, tagged AS (SELECT restaurant_id, text, unnest({_TOPICS}) AS topic FROM (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS low FROM texts)),
words AS (SELECT restaurant_id, topic, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM tagged),
counts AS (SELECT restaurant_id, topic, word, count(*) AS n FROM words WHERE length(word) >= 3 AND word NOT IN ({', '.join(f"'{w}'" for w in T.STOP_WORDS)}) GROUP BY 1, 2, 3)
SELECT restaurant_id, topic, string_agg(word, '、' ORDER BY rank) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY restaurant_id, topic ORDER BY n DESC, word) AS rank FROM counts) WHERE rank <= 3 GROUP BY 1, 2""")
def topic_keywords(spark, sf):
    return A.topic_keywords(texts(spark, sf), 3).select("restaurant_id", "topic", F.array_join("keywords", "、").alias("keywords"))


@query("""SELECT len(embedding) AS size, label AS model, count(*) AS n FROM embeddings WHERE vec_id % 11 <> 0 AND embedding IS NOT NULL GROUP BY 1, 2""")
def live_models(spark, sf):
    live = load(spark, sf, "embeddings").where("vec_id % 11 <> 0 AND embedding IS NOT NULL")
    return A.histogram(live.select(F.size("embedding").cast("long").alias("size"), F.col("label").alias("model")), "size", "model")


@query("""SELECT count(DISTINCT o_custkey) AS covered, (SELECT count(*) FROM customer) AS known, round(count(DISTINCT o_custkey) / (SELECT count(*) FROM customer)::DOUBLE, 6) AS kept_fraction FROM orders JOIN customer ON o_custkey = c_custkey""")
def kept_fraction(spark, sf):
    keys = load(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return A.coverage(load(spark, sf, "orders").select(F.col("o_custkey").alias("key")), keys, "key").withColumn("kept_fraction", F.round("kept_fraction", 6))


@query("""SELECT vec_id, CASE WHEN vec_id % 5 = 0 OR vec_id % 7 = 0 THEN 'skipped' WHEN vec_id % 3 = 0 THEN 'degraded' WHEN vec_id % 2 = 0 AND len(embedding) <> 32 OR vec_id % 2 = 1 AND len(embedding) <> 64 THEN 'failed' ELSE 'ready' END AS status FROM embeddings""")
def semantic_plans(spark, sf):
    n = F.col("vec_id")
    text, error = F.when(n % 5 == 0, "  ").otherwise("quiet place"), F.when(n % 3 == 0, "timeout")
    status = lambda size: C.semantic_status(text, n % 7 != 0, error, F.col("embedding"), size)
    return load(spark, sf, "embeddings").select("vec_id", F.when(n % 2 == 0, status(32)).otherwise(status(64)).alias("status"))

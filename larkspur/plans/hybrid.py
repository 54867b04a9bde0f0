"""The hybrid search, asked by every twentieth document, names looked up in a stored index by every twentieth, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import name_index as I
from larkspur.operators import search as H
from larkspur.plans.ranked import _BOROUGHS, _tri
from larkspur.plans.registry import query
from larkspur.session import shared_folder
from larkspur.sources.tables import PLACES, load, places

_SCOPES = 3


def documents(spark, sf):
    """Vectored documents of places, a few of which are in no table of places; every other one is a digest."""
    n = F.col("vec_id")
    return load(spark, sf, "embeddings").select(
        n.alias("document_id"), F.when(n % 17 == 0, -n).otherwise(n * 7 % 150 + 1).alias("restaurant_id"), F.concat(F.lit("s"), (F.col("label") % _SCOPES).cast("string")).alias("scope"),
        F.when(n % 2 == 0, H.PROFILE).otherwise(H.DIGEST).alias("doc_type"), (n % 13 != 0).alias("is_active"), F.col("embedding").cast("array<double>").alias("embedding"),
    )


def requests(spark, sf):
    """Every twentieth document asks: some without an area, a rating, a text or a vector."""
    n = F.col("vec_id")
    k = F.floor(n / 20)
    area = F.element_at(F.array(*map(F.lit, _BOROUGHS)), (k % len(_BOROUGHS) + 1).cast("int"))
    soft = F.when(k % 3 == 0, F.array(F.struct(F.lit("安静").alias("words"), F.lit("ambience").alias("topic"))))
    return load(spark, sf, "embeddings").where("vec_id % 20 = 0").select(
        n.alias("query_id"), F.when(k % 4 != 0, F.concat(F.lit("street "), (k % 97).cast("string"))).alias("text"), F.when(k % 5 < 3, area).otherwise("").alias("borough"), F.when(k % 5 > 1, ((k % 40) / 10)).alias("min_rating"),
        F.concat(F.lit("s"), (F.col("label") % _SCOPES).cast("string")).alias("scope"), F.when(k % 6 != 5, F.col("embedding").cast("array<double>")).alias("embedding"), soft.alias("soft"),
    )


_SQL = f"""WITH {PLACES}, docs AS (SELECT vec_id AS document_id, CASE WHEN vec_id % 17 = 0 THEN -vec_id ELSE vec_id * 7 % 150 + 1 END AS restaurant_id, label % {_SCOPES} AS scope, CASE WHEN vec_id % 2 = 0 THEN 'vector' ELSE 'review' END AS channel, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 13 <> 0),
asked AS (SELECT vec_id AS q, vec_id // 20 AS k, CASE WHEN vec_id // 20 % 4 <> 0 THEN 'street ' || vec_id // 20 % 97 ELSE '' END AS said, CASE WHEN vec_id // 20 % 5 < 3 THEN list_extract({list(_BOROUGHS)}, CAST(vec_id // 20 % {len(_BOROUGHS)} + 1 AS BIGINT)) END AS area,
 CASE WHEN vec_id // 20 % 5 > 1 THEN (vec_id // 20 % 40) / 10.0::DOUBLE END AS least, label % {_SCOPES} AS scope, CASE WHEN vec_id // 20 % 6 <> 5 THEN embedding::DOUBLE[] END AS e FROM embeddings WHERE vec_id % 20 = 0),
near AS (SELECT q, channel, restaurant_id, document_id, round(greatest(0.0, least(1.0, list_cosine_similarity(d.e, a.e))), 9) AS score FROM docs d JOIN asked a ON d.scope = a.scope WHERE a.e IS NOT NULL),
told AS (SELECT q, restaurant_id, greatest({_tri('name', 'said')}, {_tri('address', 'said')}) AS score FROM places JOIN asked ON said <> '' AND (contains(lower(address), said) OR contains(lower(name), said))),
fits AS (SELECT q, restaurant_id, score FROM places JOIN asked ON (area IS NULL OR borough = area) AND (least IS NULL OR rating >= least) WHERE is_active AND (area IS NOT NULL OR least IS NOT NULL)),
hits AS (SELECT q, 'structured' AS channel, restaurant_id, 1.0::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, restaurant_id) AS n FROM fits) WHERE n <= 200
 UNION ALL SELECT q, 'keyword', restaurant_id, round(score, 9) FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, restaurant_id) AS n FROM told) WHERE n <= 200
 UNION ALL SELECT q, channel, restaurant_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q, channel ORDER BY score DESC, document_id) AS n FROM near) WHERE n <= 200),
fated AS (SELECT h.*, CASE WHEN h.channel = 'review' AND h.score < 0.3 THEN 'below' WHEN p.restaurant_id IS NULL THEN 'unknown' WHEN is_active AND (area IS NULL OR borough = area) AND coalesce(least IS NULL OR rating >= least, false) THEN 'kept' ELSE 'removed' END AS fate,
 CASE WHEN rating > 0 THEN 4.0 + (rating - 4.0) * rating_count / (rating_count + 50.0) ELSE 0.0 END AS prior FROM hits h JOIN asked USING (q) LEFT JOIN places p ON p.restaurant_id = h.restaurant_id),
pool AS (SELECT DISTINCT q, restaurant_id, prior FROM fated WHERE fate = 'kept'), open_ AS (SELECT *, CASE WHEN channel IN ('vector', 'review') THEN 'semantic' ELSE channel END AS family FROM fated WHERE fate <> 'below'),
r AS (SELECT q, family, min(score) AS lo, max(score) AS hi FROM open_ GROUP BY 1, 2), best AS (SELECT o.q, channel, family, restaurant_id, max(score) AS raw FROM open_ o SEMI JOIN pool p ON p.q = o.q AND p.restaurant_id = o.restaurant_id GROUP BY 1, 2, 3, 4),
parts AS (SELECT b.q, restaurant_id, channel, raw, w, w * CASE WHEN hi - lo <= 0 THEN 0.5 ELSE (raw - lo) / (hi - lo) END AS c FROM (SELECT *, CASE channel WHEN 'structured' THEN 1.0 WHEN 'keyword' THEN 0.5 WHEN 'vector' THEN 1.0 ELSE 0.8 END AS w FROM best) b JOIN r ON r.q = b.q AND r.family = b.family),
s AS (SELECT q, restaurant_id, sum(c) AS ch FROM parts GROUP BY 1, 2), b AS (SELECT s.*, prior, min(prior) OVER (PARTITION BY s.q) AS plo, max(prior) OVER (PARTITION BY s.q) AS phi FROM s JOIN pool p ON p.q = s.q AND p.restaurant_id = s.restaurant_id),
t AS (SELECT q, restaurant_id, round(ch + 0.2 * CASE WHEN phi - plo <= 0 THEN 0.5 ELSE (prior - plo) / (phi - plo) END, 9) AS total FROM b), ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY total DESC, restaurant_id) AS rank FROM t) WHERE rank <= 10),
why AS (SELECT p.q, p.restaurant_id, string_agg(CASE channel WHEN 'structured' THEN '满足全部硬条件（' || array_to_string(list_filter(['评分>=' || printf('%.1f', least), '行政区=' || area], lambda x: x IS NOT NULL), '、') || '）'
 WHEN 'keyword' THEN '名称/地址匹配“' || said || '”（相似度 ' || printf('%.3f', raw) || '）' ELSE CASE WHEN k % 3 = 0 THEN '评论推断：安静（ambience）；' ELSE '' END || CASE channel WHEN 'vector' THEN '语义匹配“' ELSE '评论综合语义匹配“' END || said || '”（相似度 ' || printf('%.3f', raw) || '）' END
 || '（权重 ' || printf('%.2f', w) || CASE WHEN round(c, 9) > 0 THEN '，贡献 ' || printf('%.3f', round(c, 9)) ELSE '，归一化后贡献为 0：该通道内最弱命中，仍被该通道召回' END || '）', ' / ' ORDER BY list_position(['structured', 'keyword', 'vector', 'review'], channel)) AS reasons
 FROM parts p JOIN asked USING (q) GROUP BY 1, 2),"""


def _asked(spark, sf):
    return H.hybrid_search(requests(spark, sf), places(spark, sf), documents(spark, sf))


@query(f"""{_SQL} z AS (SELECT 1) SELECT ranked.q AS query_id, CAST(rank AS INTEGER) AS rank, ranked.restaurant_id, total, reasons FROM ranked JOIN why ON why.q = ranked.q AND why.restaurant_id = ranked.restaurant_id""")
def hybrid_search(spark, sf):
    found = _asked(spark, sf).select("query_id", F.explode("candidates").alias("c"))
    return found.select("query_id", "c.rank", "c.restaurant_id", "c.total", F.array_join("c.reasons", " / ").alias("reasons"))


@query(f"""{_SQL} n AS (SELECT q, channel, count(*) AS a, count(*) FILTER (WHERE fate = 'below') AS b, count(*) FILTER (WHERE fate = 'unknown') AS u, count(*) FILTER (WHERE fate = 'removed') AS d FROM fated GROUP BY 1, 2),
every AS (SELECT q, k, area, least, said, e, c.channel, o FROM asked, (VALUES ('structured', 1), ('keyword', 2), ('vector', 3), ('review', 4)) c(channel, o)),
told2 AS (SELECT v.*, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(u, 0) AS u, coalesce(d, 0) AS d, CASE channel WHEN 'structured' THEN area IS NOT NULL OR least IS NOT NULL WHEN 'keyword' THEN said <> '' ELSE e IS NOT NULL END AS ran FROM every v LEFT JOIN n USING (q, channel))
SELECT q AS query_id, string_agg(channel || CASE WHEN ran THEN ' ' ELSE ' - ' END || a || '/' || b || '/' || u || '/' || d, ', ' ORDER BY o) AS trace,
 concat_ws('; ', string_agg(channel || '：' || CASE channel WHEN 'structured' THEN '没有硬条件' WHEN 'keyword' THEN '没有查询文本' ELSE '没有查询向量' END, '; ' ORDER BY o) FILTER (WHERE NOT ran), CASE WHEN any_value(k) % 3 = 0 AND bool_or(ran AND channel = 'vector') THEN '软条件按评论主题与向量召回，属于评论推断' END,
 string_agg(channel || '：' || u || ' 家餐厅未知', '; ' ORDER BY o) FILTER (WHERE u > 0)) AS warnings FROM told2 GROUP BY q""")
def search_trace(spark, sf):
    shown = F.transform("trace", lambda t: F.concat(t["channel"], F.when(t["ran"], " ").otherwise(" - "), F.concat_ws("/", *[t[n].cast("string") for n in ("recalled", "below", "unknown", "removed")])))
    return _asked(spark, sf).select("query_id", F.array_join(shown, ", ").alias("trace"), F.array_join("warnings", "; ").alias("warnings"))


@query(f"""WITH q AS (SELECT p_partkey AS query_id, CASE p_partkey // 20 % 6 WHEN 0 THEN lower(p_name) WHEN 1 THEN '  ' WHEN 2 THEN left(p_name, 2) WHEN 3 THEN left(p_name, 1) ELSE substr(p_name, 3, 8) END AS said FROM part WHERE p_partkey % 20 = 0),
s AS (SELECT query_id, p_partkey AS id, p_name AS name, {_tri('p_name', 'lower(said)')} AS score FROM part, q WHERE trim(said) <> '' AND contains(lower(p_name), lower(said)))
SELECT query_id, id, name, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def indexed_names(spark, sf):
    """Every twentieth part asks with its name, a part of it, its first one or two characters, or blanks."""
    part = load(spark, sf, "part")
    index = I.build_name_index(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("address")), shared_folder(spark, "names"))
    form, name = F.floor(F.col("p_partkey") / 20) % 6, F.col("p_name")
    said = F.when(form == 0, F.lower(name)).when(form == 1, "  ").when(form == 2, F.left(name, F.lit(2))).when(form == 3, F.left(name, F.lit(1))).otherwise(F.substring(name, 3, 8))
    asked = part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), said.alias("text"))
    return I.name_hits(spark, index, asked, 10).select("query_id", "id", "name", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {PLACES}, q AS (SELECT restaurant_id AS query_id, restaurant_id // 20 AS k, CASE WHEN restaurant_id // 20 % 3 = 0 THEN address WHEN restaurant_id // 20 % 3 = 1 THEN name ELSE substr(address, 3, 12) END AS said, CASE WHEN restaurant_id // 20 % 2 = 0 THEN upper(borough) || ' ' END AS area, CASE WHEN restaurant_id // 20 % 5 = 0 THEN upper(substr(address, 2, 6)) WHEN restaurant_id // 20 % 5 = 1 THEN 'nowhere' END AS near FROM places WHERE restaurant_id % 20 = 0),
s AS (SELECT query_id, restaurant_id AS id, round(greatest({_tri('name', 'lower(said)')}, {_tri('address', 'lower(said)')}), 9) AS score FROM places, q WHERE (contains(lower(name), lower(said)) OR contains(lower(address), lower(said))) AND (area IS NULL OR borough = lower(trim(area))) AND (near IS NULL OR contains(lower(address), lower(near)))),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.55), f AS (SELECT a.query_id, a.id, a.score, b.score AS second FROM r a LEFT JOIN r b ON b.query_id = a.query_id AND b.rank = 2 WHERE a.rank = 1)
SELECT q.query_id, CASE WHEN f.id IS NULL THEN 'not_found' WHEN score - second < 0.10 THEN 'ambiguous' ELSE 'resolved' END AS status, f.id, round(score, 6) AS score FROM q LEFT JOIN f USING (query_id)""")
def resolve_hinted(spark, sf):
    """Every twentieth place is asked for by its address, its name or a part of its address, with a borough, a part of the address, one that fits nothing, or no hint."""
    all_places = places(spark, sf)
    index = I.build_name_index(all_places.select(F.col("restaurant_id").alias("id"), "name", "address", "borough"), shared_folder(spark, "names"))
    k = F.floor(F.col("restaurant_id") / 20)
    said = F.when(k % 3 == 0, F.col("address")).when(k % 3 == 1, F.col("name")).otherwise(F.substring("address", 3, 12))
    area, near = F.when(k % 2 == 0, F.concat(F.upper("borough"), F.lit(" "))), F.when(k % 5 == 0, F.upper(F.substring("address", 2, 6))).when(k % 5 == 1, "nowhere")
    asked = all_places.where("restaurant_id % 20 = 0").select(F.col("restaurant_id").alias("query_id"), said.alias("text"), area.alias("borough_hint"), near.alias("address_hint"))
    return I.resolve_in_index(spark, index, asked, depth=1_000_000).select("query_id", "status", "id", F.round("score", 6).alias("score"))

"""Queries that build documents of places."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import documents as D
from larkspur.functions import text as T
from larkspur.operators import evidence as E
from larkspur.operators import rollups as A
from larkspur.plans.curation import _TOPICS
from larkspur.plans.registry import query
from larkspur.sources.tables import PLACES, REVIEWS, TEXTS, places, reviews, texts


def _places(spark, sf):
    """Places with the fields of their documents, some of them missing."""
    r = F.col("restaurant_id")
    hour = lambda day, at, to, closed, raw: F.struct(day.cast("int").alias("weekday"), at.cast("int").alias("open"), to.cast("int").alias("close"), closed.alias("closed"), raw.alias("raw"))
    second = hour(r % 7, r % 9 * 60, r % 9 * 60 + 135, F.lit(False), F.lit(""))
    hours = F.when(r % 4 == 0, None).otherwise(F.array(hour(r % 7, F.lit(900), F.lit(1320), r % 5 == 0, F.when(r % 3 == 0, " 3PM–10PM ")), second, hour((r + 3) % 7, F.lit(605), F.lit(1500), F.lit(False), F.lit(None).cast("string"))))
    tags = lambda n, *words: F.when(r % n == 0, F.array(*map(F.lit, words)))
    counted = A.review_rollup(reviews(spark, sf)).select("restaurant_id", "stored_count", "text_count", "computed_avg")
    return places(spark, sf).select(
        "restaurant_id", "name", F.when(r % 6 != 0, F.col("address")).alias("address"), "borough", F.when(r % 2 == 0, F.concat(F.lit(" about "), "name")).alias("description"), hours.alias("hours"),
        F.when(r % 8 != 0, F.col("cuisines")).alias("cuisine_tags"), "price_level", F.col("rating").alias("source_avg"), (r % 9 == 0).alias("source_review_count_capped"),
        F.when(r % 29 == 0, "permanently_closed").when(r % 3 == 0, "open").otherwise("x").alias("snapshot_status"), tags(2, "cosy", "loud", "cosy").alias("atmosphere_tags"), tags(3, "lunch").alias("popular_for_tags"),
        tags(5, "delivery", "takeout").alias("service_option_tags"), tags(10**9, "x").alias("accessibility_tags"),
    ).join(counted, "restaurant_id", "left")


_CLOCK = "printf('%d:%02d', ({0}) % 1440 // 60, ({0}) % 60)"
_DAYS = f"list_extract({list(D.WEEKDAYS)}, CAST(d + 1 AS BIGINT))"
_FIELDS = f"""{PLACES}, {REVIEWS}, g AS (SELECT restaurant_id, count(*) AS n, count(*) FILTER (WHERE text <> '') AS t, avg(rating) AS m FROM reviews GROUP BY 1),
h AS (SELECT restaurant_id AS r, unnest([restaurant_id % 7, restaurant_id % 7, (restaurant_id + 3) % 7]) AS d, unnest([900, restaurant_id % 9 * 60, 605]) AS o,
 unnest([CASE WHEN restaurant_id % 5 = 0 THEN '{D.CLOSED_DAY}' WHEN restaurant_id % 3 = 0 THEN '3PM–10PM' ELSE '15:00-22:00' END, {_CLOCK.format('restaurant_id % 9 * 60')} || '-' || {_CLOCK.format('restaurant_id % 9 * 60 + 135')}, '10:05-1:00']) AS s FROM places WHERE restaurant_id % 4 <> 0),
hd AS (SELECT r, d, {_DAYS} || ' ' || string_agg(s, '、' ORDER BY o) AS s FROM h GROUP BY r, d), hh AS (SELECT r AS restaurant_id, string_agg(s, '；' ORDER BY d) AS hours FROM hd GROUP BY r),
f AS (SELECT p.*, n, t, m, hours, CASE WHEN p.restaurant_id % 2 = 0 THEN 'cosy、loud' END AS atm, CASE WHEN p.restaurant_id % 3 = 0 THEN 'lunch' END AS pop, CASE WHEN p.restaurant_id % 5 = 0 THEN 'delivery、takeout' END AS svc,
 CASE WHEN p.restaurant_id = 0 THEN 'x' END AS acc, CASE WHEN p.restaurant_id % 8 <> 0 THEN array_to_string(cuisines, '、') END AS cuis, CASE WHEN p.restaurant_id % 8 <> 0 THEN cuisines[1] END AS first, repeat('$', price_level) AS cost
 FROM places p LEFT JOIN g USING (restaurant_id) LEFT JOIN hh USING (restaurant_id))"""
_PROFILE = f"""concat_ws(chr(10), name || coalesce('（' || nullif(concat_ws('，', first, cost, printf('%.1f', m) || '星'), '') || '）', ''),
 '地址：' || CASE WHEN restaurant_id % 6 = 0 THEN '{D.UNKNOWN_ADDRESS}' ELSE address END || '（' || borough || '）', '简介：' || CASE WHEN restaurant_id % 2 = 0 THEN 'about ' || name ELSE '{D.UNKNOWN_DESCRIPTION}' END, '营业时间：' || hours,
 '特色：' || nullif(concat_ws('；', cuis, '氛围：' || atm, '适合：' || pop, '服务：' || svc, '无障碍：' || acc), ''),
 '评论概况：' || nullif(concat_ws('，', '入库评论样本均分 ' || printf('%.1f', m), '样本量 ' || n || ' 条', CASE WHEN t > 0 THEN '含文字评论 ' || t || ' 条' END, '来源站评分 ' || printf('%.1f', rating) || CASE WHEN restaurant_id % 9 = 0 THEN '（已截顶）' ELSE '' END), ''),
 CASE WHEN restaurant_id % 29 = 0 THEN '{D.STATUS_LINES["permanently_closed"]}' WHEN restaurant_id % 3 = 0 THEN '{D.STATUS_LINES["open"]}' ELSE '{D.UNKNOWN_STATUS}' END, '{D.SNAPSHOT_NOTE}')"""


@query(f"""WITH {_FIELDS} SELECT restaurant_id, 'restaurant_profile' AS doc_type, {_PROFILE} AS content FROM f
UNION ALL SELECT restaurant_id, 'restaurant_hours', name || '的营业时间' || chr(10) || hours FROM f WHERE hours IS NOT NULL
UNION ALL SELECT restaurant_id, 'restaurant_attributes', name || '的服务与设施' || chr(10) || concat_ws(chr(10), '氛围：' || atm, '适合场合：' || pop, '服务：' || svc, '无障碍：' || acc) FROM f WHERE coalesce(atm, pop, svc, acc) IS NOT NULL""")
def place_documents(spark, sf):
    return D.place_documents(_places(spark, sf))


_CHOSEN = """bands AS (SELECT *, CASE WHEN rating >= 4 THEN 2 WHEN rating = 3 THEN 1 ELSE 0 END AS b FROM reviews WHERE trim(text) <> ''), sizes AS (SELECT restaurant_id, b, count(*) AS size FROM bands GROUP BY 1, 2),
tot AS (SELECT *, sum(size) OVER (PARTITION BY restaurant_id) AS total FROM sizes), sh AS (SELECT *, least(greatest(floor(total * 0.1), 10), 30, total) AS target FROM tot),
ba AS (SELECT *, target * size / total::DOUBLE AS share, floor(target * size / total::DOUBLE) AS base FROM sh), se AS (SELECT *, target - sum(base) OVER (PARTITION BY restaurant_id) AS lef, row_number() OVER (PARTITION BY restaurant_id ORDER BY share - base DESC, b) AS seat FROM ba),
q AS (SELECT restaurant_id, b, least(size, base + CASE WHEN seat <= lef THEN 1 ELSE 0 END) AS quota FROM se), rk AS (SELECT *, row_number() OVER (PARTITION BY restaurant_id, b ORDER BY rating, reviewed_at DESC, id) AS rn FROM bands),
chosen AS (SELECT rk.* FROM rk JOIN q ON rk.restaurant_id = q.restaurant_id AND rk.b = q.b WHERE rn <= quota)"""


@query(f"""WITH {REVIEWS}, {_CHOSEN}, a AS (SELECT restaurant_id, count(*) AS available FROM bands GROUP BY 1)
SELECT restaurant_id, 'representative_reviews' AS doc_type, '代表性评论（2021 快照，' || any_value(available) || ' 条可用评论中选出 ' || count(*) || ' 条）' || chr(10) || string_agg('[' || rating || '星] “' || text || '”（' || strftime(reviewed_at, '%Y-%m-%d') || '）', chr(10) ORDER BY reviewed_at DESC, id) AS content
FROM chosen JOIN a USING (restaurant_id) GROUP BY restaurant_id""")
def representative_documents(spark, sf):
    rows = reviews(spark, sf)
    counts = rows.where("trim(text) <> ''").groupBy("restaurant_id").agg(F.count("*").alias("available"))
    return D.representative_documents(E.representative(rows), counts)


@query(f"""WITH {PLACES}, {TEXTS}, reviews AS (SELECT doc_id AS id, restaurant_id, rating, text, doc_id AS reviewed_at FROM texts), {_CHOSEN},
tagged AS (SELECT restaurant_id, rating, text, unnest({_TOPICS}) AS topic FROM (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS low FROM bands)), mean AS (SELECT restaurant_id, avg(rating) AS m, count(*) AS n FROM bands GROUP BY 1),
words AS (SELECT restaurant_id, topic, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM tagged),
counts AS (SELECT restaurant_id, topic, word, count(*) AS n FROM words WHERE length(word) >= 3 AND word NOT IN ({', '.join(f"'{w}'" for w in T.STOP_WORDS)}) GROUP BY 1, 2, 3),
kw AS (SELECT restaurant_id, topic, string_agg(word, ', ' ORDER BY rank) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY restaurant_id, topic ORDER BY n DESC, word) AS rank FROM counts) WHERE rank <= 3 GROUP BY 1, 2),
st AS (SELECT restaurant_id, topic, count(*) AS n, avg(rating) AS m, avg(CASE WHEN rating >= 4 THEN 1.0 ELSE 0.0 END) AS p FROM tagged GROUP BY 1, 2),
ln AS (SELECT st.restaurant_id, string_agg(topic || ': ' || st.n || ' reviews, average ' || printf('%.1f', st.m) || ' stars, positive ratio ' || printf('%.0f', p * 100) || '%, ' || CASE WHEN st.m - mean.m > 0.15 THEN 'relatively better reviewed' WHEN st.m - mean.m < -0.15 THEN 'relatively lower reviewed'
 ELSE 'in line with the overall restaurant' END || '; keywords: ' || coalesce(keywords, 'no notable keywords') || '.', chr(10) ORDER BY topic) AS said FROM st JOIN mean USING (restaurant_id) LEFT JOIN kw USING (restaurant_id, topic) GROUP BY 1),
ps AS (SELECT restaurant_id, avg(CASE WHEN rating >= 4 THEN 1.0 ELSE 0.0 END) AS positive FROM chosen GROUP BY 1)
SELECT restaurant_id, concat_ws(chr(10), name || ' review comprehension (offline rule statistics over ' || n || ' text reviews).', concat_ws(', ', 'cuisine: ' || cuisines[1], 'borough: ' || borough, 'price: ' || repeat('$', price_level)) || '.',
 'Average sample rating ' || printf('%.1f', m) || ' stars; positive (4-5 stars) share among representative reviews is ' || printf('%.0f', positive * 100) || '%.', said, '{D.DIGEST_END}') AS content
FROM places JOIN mean USING (restaurant_id) JOIN ps USING (restaurant_id) LEFT JOIN ln USING (restaurant_id)""")
def rules_digest(spark, sf):
    rows = texts(spark, sf).select(F.col("doc_id").alias("id"), "restaurant_id", "rating", "text", F.col("doc_id").alias("reviewed_at")).where(F.trim("text") != "")
    return D.rules_digest(places(spark, sf).withColumnRenamed("cuisines", "cuisine_tags"), rows, E.representative(rows), A.topic_figures(rows, 3))

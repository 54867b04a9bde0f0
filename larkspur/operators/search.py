"""The hybrid search as one operator: recall by four channels, details, hard filters behind it, fusion, reasons and a trace.

Every step carries ``query_id``, so all requests run in one plan. The hits of all channels are written once, with what
became of each, and everything behind them (counts, pool, fusion) reads that table.

Requests: query_id, text, borough, min_rating, scope, embedding, soft (structs of words and topic), each but the first possibly null.
Places: restaurant_id, name, address, borough, rating, rating_count, score, is_active. Documents: document_id,
restaurant_id, scope, doc_type, is_active, embedding.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import rating_prior
from larkspur.operators import ranking as R
from larkspur.operators import tiles
from larkspur.operators.recall import soft_reason
from larkspur.session import stored

#: Kinds of documents that the semantic channels recall, and texts of reasons and notes.
PROFILE, DIGEST = "restaurant_profile", "restaurant_review_summary"
SOFT_NOTE, NO_CONDITIONS, NO_TEXT, NO_VECTOR = "软条件按评论主题与向量召回，属于评论推断", "没有硬条件", "没有查询文本", "没有查询向量"

#: Longest question that a reason quotes.
SHOWN_CHARS = 40


@dataclass(frozen=True)
class Depths:
    """Hits that each channel keeps for a request, by score, then id; places that are returned; least similarity of the review channel."""

    structured: int = 200
    keyword: int = 200
    semantic: int = 200
    top: int = 10
    floor: float = R.REVIEW_FLOOR


def _told(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit("")))


def _best(hits: DataFrame, depth: int, key: str, *order: Column) -> DataFrame:
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "channel").orderBy(*order, key))).where(F.col("_n") <= depth).drop("_n")


def _satisfies() -> Column:
    """Hard conditions of a request on a place: unknown values don't satisfy."""
    area = F.col("asked_borough").isNull() | F.coalesce(F.col("borough") == F.col("asked_borough"), F.lit(False))
    return F.col("is_active") & area & (F.col("asked_rating").isNull() | F.coalesce(F.col("rating") >= F.col("asked_rating"), F.lit(False)))


def structured_hits(places: DataFrame, asked: DataFrame, depth: int) -> DataFrame:
    """Places that satisfy all conditions of a request; equal conditions are met once. A request without a borough meets them by tenths of its rating, so each join has a key."""
    asking = asked.where(F.col("asked_borough").isNotNull() | F.col("asked_rating").isNotNull()).select("query_id", "asked_borough", "asked_rating")
    conditions = ["asked_borough", "asked_rating"]
    some = asking.select(conditions).distinct()
    by_area = places.join(R._queries(some.where(F.col("asked_borough").isNotNull()).withColumn("borough", F.col("asked_borough"))), "borough")
    tenth = F.floor(F.col("asked_rating") * 10).cast("int")
    rated = some.where(F.col("asked_borough").isNull()).withColumn("_tenth", F.explode(F.sequence(tenth, F.greatest(tenth, F.lit(50)))))
    by_rating = places.withColumn("_tenth", F.floor(F.col("rating") * 10).cast("int")).join(R._queries(rated), "_tenth")
    columns = ["restaurant_id", "score", "borough", "rating", "is_active", *conditions]
    met = by_area.select(columns).unionByName(by_rating.select(columns)).where(_satisfies())
    best = met.withColumn("_n", F.row_number().over(Window.partitionBy(conditions).orderBy(F.desc("score"), "restaurant_id"))).where(F.col("_n") <= depth).select("restaurant_id", F.col("asked_borough").alias("_area"), F.col("asked_rating").alias("_least"))
    same = F.col("asked_borough").eqNullSafe(F.col("_area")) & F.col("asked_rating").eqNullSafe(F.col("_least"))
    return best.join(asking, same).select("query_id", F.lit("structured").alias("channel"), "restaurant_id", F.lit(1.0).alias("score"))


#: More than rounding to nine digits moves a score.
_ROUNDED = 2e-9


def semantic_hits(documents: DataFrame, asked: DataFrame, depth: int) -> DataFrame:
    """Profiles (channel vector) and digests (channel review) nearest to a request's vector within its scope, in tiles of each kind."""
    live = documents.where(F.col("is_active") & F.col("doc_type").isin(PROFILE, DIGEST)).select("document_id", "restaurant_id", "scope", "doc_type", "embedding")
    kinds = F.explode(F.array(F.lit(PROFILE), F.lit(DIGEST))).alias("doc_type")
    wanted = asked.where(F.col("embedding").isNotNull()).select("query_id", "scope", F.col("embedding").alias("_q"), kinds)
    met = tiles.nearest(live, wanted, ["scope", "doc_type"], depth, floor=0.0, blur=_ROUNDED, keep=("document_id", "restaurant_id", "doc_type"))
    channel = F.when(F.col("doc_type") == PROFILE, "vector").otherwise("review").alias("channel")
    scored = met.select("query_id", channel, "restaurant_id", "document_id", F.round("score", 9).alias("score"))
    return _best(scored, depth, "document_id", F.desc("score")).drop("document_id")


def _reason() -> Column:
    conditions = F.concat_ws("、", F.concat(F.lit("评分>="), F.format_number("asked_rating", 1)), F.concat(F.lit("行政区="), "asked_borough"))
    text, alike = F.col("_shown"), F.format_number("raw", 3)
    quoted = lambda before: F.concat(F.lit(before), text, F.lit("”（相似度 "), alike, F.lit("）"))
    soft = F.when(F.col("_soft") != "", F.concat("_soft", F.lit("；"))).otherwise("")
    return (
        F.when(F.col("channel") == "structured", F.concat(F.lit("满足全部硬条件（"), conditions, F.lit("）"))).when(F.col("channel") == "keyword", quoted("名称/地址匹配“"))
        .when(F.col("channel") == "vector", F.concat(soft, quoted("语义匹配“"))).otherwise(F.concat(soft, quoted("评论综合语义匹配“")))
    )


def hybrid_search(requests: DataFrame, places: DataFrame, documents: DataFrame, depths: Depths = Depths()) -> DataFrame:
    """One row for each request: query_id, candidates, trace, warnings.

    ``candidates``: structs of rank, restaurant_id, total and reasons, best first. ``trace``: a struct for each channel in
    the order of the fusion, with whether it ran, how many hits it recalled, and how many of them lay below the floor of
    similarity, had an unknown place, or a place that fails the hard conditions; the rest is fused. ``warnings`` say what
    was skipped, that soft conditions steered the recall, and which channels met unknown places.
    """
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    asked = requests.select("query_id", _told("text").alias("text"), blank("borough").alias("asked_borough"), F.col("min_rating").alias("asked_rating"), "scope", F.when(F.size("embedding") > 0, F.col("embedding")).alias("embedding"), soft_reason(F.col("soft")).alias("_soft"))
    named = places.select(F.col("restaurant_id").alias("id"), "name", "address")
    keyword = R.text_hits(named, asked.select("query_id", "text"), depths.keyword).select("query_id", F.lit("keyword").alias("channel"), F.col("id").alias("restaurant_id"), F.round("score", 9).alias("score"))
    recalled = structured_hits(places, asked, depths.structured).unionByName(keyword).unionByName(semantic_hits(documents, asked, depths.semantic))
    low = (F.col("channel") == "review") & (F.col("score") < depths.floor)
    details = places.select("restaurant_id", "borough", "rating", "is_active", rating_prior(F.col("rating"), F.col("rating_count")).alias("prior"), F.lit(True).alias("_known"))
    met = recalled.join(details, "restaurant_id", "left").join(R._queries(asked.select("query_id", "asked_borough", "asked_rating")), "query_id")
    fate = F.when(low, "below").when(F.col("_known").isNull(), "unknown").when(~_satisfies(), "removed").otherwise("kept")
    hits = stored(met.select("query_id", "channel", "restaurant_id", "score", "prior", fate.alias("fate")), "hits")

    counts = hits.groupBy("query_id", "channel").agg(F.count("*").alias("recalled"), *[F.count_if(F.col("fate") == f).alias(f) for f in ("below", "unknown", "removed")])
    pool = hits.where("fate = 'kept'").select("query_id", "restaurant_id", "prior").distinct()
    said = hits.where("fate <> 'below'").select("query_id", "channel", "restaurant_id", "score")
    parts = R.channel_scores(said, pool).withColumn("contribution", F.round("contribution", 9))
    ranked = R.fuse(said, pool, "weighted", top=depths.top)
    shown = F.when(F.length("text") > SHOWN_CHARS, F.concat(F.left("text", F.lit(SHOWN_CHARS)), F.lit("…"))).otherwise(F.col("text"))
    told = parts.join(ranked.select("query_id", "restaurant_id"), ["query_id", "restaurant_id"], "left_semi").join(asked.select("query_id", "asked_borough", "asked_rating", shown.alias("_shown"), "_soft"), "query_id")
    reasons = R.explain(told.withColumn("reason", _reason()))
    best = ranked.join(reasons, ["query_id", "restaurant_id"]).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "restaurant_id", "total", "reasons"))).alias("candidates"))  # at most ``top`` a request

    by_channel = counts.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("channel", F.struct("recalled", "below", "unknown", "removed")))).alias("_counts"))  # one entry a channel
    out = asked.join(by_channel, "query_id", "left").join(best, "query_id", "left")
    ran = {"structured": F.col("asked_borough").isNotNull() | F.col("asked_rating").isNotNull(), "keyword": F.col("text") != "", "vector": F.col("embedding").isNotNull(), "review": F.col("embedding").isNotNull()}
    count = lambda channel, name: F.coalesce(F.try_element_at("_counts", F.lit(channel))[name], F.lit(0).cast("long")).alias(name)
    trace = F.array(*[F.struct(F.lit(c).alias("channel"), ran[c].alias("ran"), *[count(c, n) for n in ("recalled", "below", "unknown", "removed")]) for c in R.WEIGHTS])
    skipped = {"structured": NO_CONDITIONS, "keyword": NO_TEXT, "vector": NO_VECTOR, "review": NO_VECTOR}
    notes = [F.when(~ran[c], F.concat(F.lit(f"{c}："), F.lit(skipped[c]))) for c in R.WEIGHTS]
    notes.append(F.when((F.col("_soft") != "") & ran["vector"], F.lit(SOFT_NOTE)))
    notes += [F.when(count(c, "unknown") > 0, F.concat(F.lit(f"{c}："), count(c, "unknown").cast("string"), F.lit(" 家餐厅未知"))) for c in R.WEIGHTS]
    empty = F.array().cast("array<struct<rank:int,restaurant_id:bigint,total:double,reasons:array<string>>>")
    return out.select("query_id", F.coalesce("candidates", empty).alias("candidates"), trace.alias("trace"), F.array_compact(F.array(*notes)).alias("warnings"))

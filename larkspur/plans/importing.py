"""The import as a chain of stages: places, reviews, statistics, scores; with an audit row for each source.

Each stage is a function of DataFrames that leaves tables behind under one folder; a stage
that is run again gives the same tables (natural keys, hashes as ids).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import knowledge_score
from larkspur.operators.lifecycle import latest
from larkspur.operators.rollups import outcome_counts, review_rollup
from larkspur.sources import raw

#: Bounds of the number of places that are shown, and its default.
FEWEST, MOST, SHOWN = 2000, 5000, 3000


def stable_id(*keys: str) -> F.Column:
    """A positive 62-bit id from natural keys: the same on every run, with no numbering over the whole table."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 2)


def import_places(spark: SparkSession, path: str, limit: int | None = None, areas: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(places, audit): one row per natural key, the last line of a key wins; boroughs by the boundaries ``areas``, if any."""
    scanned = raw.scan_lines(spark, path, raw.PLACE, limit)
    curated = raw.curate_places(raw.accepted(scanned), areas)
    kept = curated.where("outcome = 'accept'").drop("outcome", "reason")
    places = latest(kept, ["gmap_id"], [F.col("line_no").desc()]).drop("line_no")
    bad = raw.rejected(scanned).select(F.lit("reject").alias("outcome"), "reason")
    audit = outcome_counts(curated.select("outcome", "reason").unionByName(bad)).withColumn("stage", F.lit("places"))
    return places.withColumn("restaurant_id", stable_id("gmap_id")), audit


def import_reviews(spark: SparkSession, path: str, places: DataFrame, least_chars: int = 1, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(reviews, audit): reviews of known places, one per (place, text hash, rating, time); the last line of a key wins."""
    scanned = raw.scan_lines(spark, path, raw.REVIEW, limit)
    curated = raw.curate_reviews(raw.accepted(scanned), least_chars)
    joined = curated.join(places.select("gmap_id", "restaurant_id"), "gmap_id", "left")
    judged = joined.withColumn("outcome", F.when((F.col("outcome") == "accept") & F.col("restaurant_id").isNull(), "unmatched").otherwise(F.col("outcome")))
    key = ["restaurant_id", "text_hash", "rating", "reviewed_at"]
    reviews = latest(judged.where("outcome = 'accept'"), key, [F.col("line_no").desc()]).withColumn("id", stable_id(*key)).select("id", *key, "text", "topic_tags", "dedup_key")
    bad = raw.rejected(scanned).select(F.lit("reject").alias("outcome"), "reason")
    audit = outcome_counts(judged.select("outcome", "reason").unionByName(bad)).withColumn("stage", F.lit("reviews"))
    return reviews, audit


def with_stats(places: DataFrame, reviews: DataFrame) -> DataFrame:
    """Places with counts over their stored reviews; the source's own average is never overwritten."""
    counts = review_rollup(reviews.withColumn("is_representative", F.lit(False))).drop("representative_count")
    joined = places.join(counts, "restaurant_id", "left")
    return joined.fillna({"stored_count": 0, "text_count": 0})


def scored(places: DataFrame) -> DataFrame:
    return places.withColumn(
        "knowledge_score",
        knowledge_score(
            description=F.col("description") != "", address=F.col("address") != "", location=F.col("lat").isNotNull(), cuisine=F.size("cuisine_tags") > 0, attributes=F.exists(F.map_values("tri_states"), lambda x: x == "true"),
            atmosphere=F.size("atmosphere_tags") + F.size("popular_for_tags") > 0, service_options=F.size("service_option_tags") > 0, rating=F.col("source_avg").isNotNull(), text_reviews=F.col("text_count"),
            closed=F.col("snapshot_status") == "permanently_closed",
        ),
    )


def selected(places: DataFrame, target: int = 0) -> DataFrame:
    """Places marked ``is_active``: those that may be shown, by score, then natural key, up to the target.

    The threshold row is found by a bounded top-n, so no global sort of the table is needed.
    """
    target = min(MOST, max(FEWEST, target if target > 0 else SHOWN))
    may = (F.col("snapshot_status") != "permanently_closed") & F.col("lat").isNotNull()
    top = places.where(may).orderBy(F.col("knowledge_score").desc(), "gmap_id").limit(target).select("gmap_id").withColumn("_on", F.lit(True))
    return places.join(F.broadcast(top), "gmap_id", "left").withColumn("is_active", F.coalesce("_on", F.lit(False))).drop("_on")  # at most MOST rows


def import_all(spark: SparkSession, place_path: str, review_path: str, folder: str, target: int = 0, boundary_path: str | None = None) -> None:
    """All stages in order; tables ``places``, ``reviews`` and ``audit`` are written under the folder."""
    areas = raw.load_boundaries(spark, boundary_path) if boundary_path else None
    places, place_audit = import_places(spark, place_path, areas=areas)
    places.write.mode("overwrite").parquet(f"{folder}/places_curated")
    places = spark.read.parquet(f"{folder}/places_curated")
    reviews, review_audit = import_reviews(spark, review_path, places)
    reviews.write.mode("overwrite").parquet(f"{folder}/reviews")
    done = selected(scored(with_stats(places, spark.read.parquet(f"{folder}/reviews"))), target)
    done.write.mode("overwrite").parquet(f"{folder}/places")
    place_audit.unionByName(review_audit).write.mode("overwrite").parquet(f"{folder}/audit")


"""Names and addresses under the runs of characters in them, written once: postings run -> id, counts of each run, and the items.

A text of three characters or more looks under the one of its own runs of three that fewest items have, by the stored
counts; shorter ones are a run themselves. Postings and counts lie in folders by a hash of the run and are
sorted by it, so a search reads the folders of its runs and, within them, the parts of files that can hold them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.vector import trigram_similarity
from larkspur.operators.ranking import AMBIGUITY_GAP, MIN_SIMILARITY, _queries, _runs, resolve_names

#: Folders of runs.
BUCKETS = 64


@dataclass(frozen=True)
class NameIndex:
    path: str


def _bucket(run: str) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(BUCKETS)).cast("int").alias("bucket")


def build_name_index(items: DataFrame, path: str) -> NameIndex:
    """Store items (id, name, address, and what else they have) and their runs of one to three characters under path."""
    items.write.mode("overwrite").parquet(f"{path}/items")
    kept = items.sparkSession.read.schema(items.schema).parquet(f"{path}/items")
    whole = F.concat_ws("\u0000", F.lower("name"), F.lower("address"))
    runs = F.array_distinct(F.flatten(F.array(*[_runs(whole, F.lit(n)) for n in (1, 2, 3)])))
    postings = kept.select("id", F.explode(runs).alias("run")).select("id", "run", _bucket("run"))
    # a run may be in a third of all items: REBALANCE lets AQE split its rows, where a hash would send them to one task
    postings.hint("rebalance", "bucket", "run").sortWithinPartitions("bucket", "run").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    counts = items.sparkSession.read.parquet(f"{path}/postings").groupBy("bucket", "run").agg(F.count("*").alias("n"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "run").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts")
    return NameIndex(path)


def name_hits(spark: SparkSession, index: NameIndex, queries: DataFrame, limit: int, keep: Column | None = None) -> DataFrame:
    """Items whose name or address holds a query's text: query_id, the item's columns, score, rank; by trigram similarity, then id.

    ``queries`` has query_id, text and what ``keep`` needs beside the item's columns; what it refuses takes no rank. Blank texts find nothing.
    Queries that ask for the same are answered once.
    """
    same = [c for c in queries.columns if c not in ("query_id", "text")]
    asking = queries.withColumn("_t", F.lower("text")).where(F.trim(F.coalesce("_t", F.lit(""))) != "").withColumn("_as", F.xxhash64("_t", *same))
    # the first query that asks for it stands for all; equal requests are compared as such, not by their hash
    asking = asking.withColumn("_first", F.min("query_id").over(Window.partitionBy("_as", "_t", *same))).drop("_as")
    asked = asking.where("query_id = _first").drop("_first", "text").dropDuplicates(["query_id"])
    own = asked.select("query_id", F.explode(F.array_distinct(_runs(F.col("_t"), F.least(F.length("_t"), F.lit(3))))).alias("run")).select("query_id", "run", _bucket("run"))
    counts, postings, items = (spark.read.parquet(f"{index.path}/{name}") for name in ("counts", "postings", "items"))
    # a run that no item has is in no posting: its text is nowhere
    met = own.join(_queries(own.select("bucket", "run").distinct()).join(counts, ["bucket", "run"]), ["bucket", "run"], "left")
    rarest = met.groupBy("query_id").agg(F.min_by(F.struct("bucket", "run"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("r"), F.min(F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
    ids = postings.join(_queries(rarest.select("query_id", "r.bucket", "r.run")), ["bucket", "run"]).select("query_id", "id")
    held = items.join(ids, "id").join(_queries(asked), "query_id").where(F.contains(F.lower("name"), F.col("_t")) | F.coalesce(F.contains(F.lower("address"), F.col("_t")), F.lit(False)))
    scored = held.withColumn("score", F.greatest(trigram_similarity(F.col("name"), F.col("_t")), F.coalesce(trigram_similarity(F.col("address"), F.col("_t")), F.lit(0.0))))
    if keep is not None:
        scored = scored.where(F.coalesce(keep, F.lit(False)))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    best = ranked.where(F.col("rank") <= limit).select(F.col("query_id").alias("_first"), *items.columns, "score", "rank")
    return best.join(asking.select("query_id", "_first"), "_first").select("query_id", *items.columns, "score", "rank")


def hinted() -> Column:
    """Whether an item fits a request's hints: its borough, whatever the case, and a part of its address; blank hints fit all."""
    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    area = (plain("borough_hint") == "") | (plain("borough") == plain("borough_hint"))
    return area & ((plain("address_hint") == "") | F.contains(F.lower(F.coalesce("address", F.lit(""))), plain("address_hint")))


def resolve_in_index(spark: SparkSession, index: NameIndex, queries: DataFrame, depth: int = 20, least: float = MIN_SIMILARITY, gap: float = AMBIGUITY_GAP) -> DataFrame:
    """What each name (query_id, text, borough_hint, address_hint) is: query_id, status (resolved, ambiguous, not_found), id, score.

    Hints and the least similarity narrow what counts as a match before the two best are compared, so a
    near miss that a hint refuses makes no name ambiguous.
    """
    # what a name is shows in its two best matches, so no more of the ``depth`` are ranked
    found = name_hits(spark, index, queries, min(depth, 2), hinted()).select("query_id", "id", "score")
    none = queries.select("query_id").distinct().join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit(None).cast(found.schema["id"].dataType).alias("id"), F.lit(None).cast("double").alias("score"))
    return resolve_names(found.unionByName(none), least, gap)

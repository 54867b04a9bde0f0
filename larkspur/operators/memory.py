"""A user's memories: their list, search by terms, and the choice of those that a turn gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONSTRAINT = "constraint"

#: Most memories that a turn gets besides constraints, and the shortest term that is searched for.
INJECTED, SHORTEST_TERM = 10, 3


def listed(memories: DataFrame) -> DataFrame:
    """Live memories with ``place``, their number in a user's list: the latest updated first, then the latest created, then the id."""
    order = Window.partitionBy("user_id").orderBy(F.col("updated_at").desc(), F.col("created_at").desc(), "memory_id")
    return memories.where("deleted_at IS NULL").withColumn("place", F.row_number().over(order))


def terms(question: Column) -> Column:
    """The words of a question that are searched for: three characters or more, each once, in lower case."""
    words = F.split(F.lower(question), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= SHORTEST_TERM))


def searched(live: DataFrame, turns: DataFrame, most: int = INJECTED) -> DataFrame:
    """Listed memories of a turn's user that hold any of its terms, the most terms first, then in list order; ``turns``: user_id, question."""
    asked = turns.select("user_id", terms(F.col("question")).alias("_terms"))
    low = F.lower("content")
    held = live.join(asked, "user_id").withColumn("matched", F.size(F.filter("_terms", lambda t: F.contains(low, t)))).where("matched > 0").drop("_terms")
    return held.withColumn("_rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("matched").desc(), "place"))).where(F.col("_rn") <= most).drop("_rn")


def selected(memories: DataFrame, turns: DataFrame, most: int = INJECTED) -> DataFrame:
    """user_id, memory_id, position and by_relevance of what each turn gets, one turn per user.

    Constraints always. Of the others those that the search finds; where it finds nothing at all
    the most confident ones, ties in list order. The search knows no types, so constraints
    count among its hits. Positions follow the list.
    """
    live = listed(memories).join(turns.select("user_id"), "user_id", "left_semi")
    hits = searched(live, turns, most).select("user_id", "memory_id", F.lit(True).alias("_hit"))
    found = hits.groupBy("user_id").agg(F.lit(True).alias("_found"))
    by_trust = Window.partitionBy("user_id", F.col("type") == CONSTRAINT).orderBy(F.col("confidence").desc(), "place")
    others = F.count_if(F.col("type") != CONSTRAINT).over(Window.partitionBy("user_id"))
    known = live.withColumn("_trust", F.row_number().over(by_trust)).withColumn("_others", others).join(hits, ["user_id", "memory_id"], "left").join(found, "user_id", "left")
    keep = F.when(F.col("type") == CONSTRAINT, True).when(F.col("_found"), F.coalesce("_hit", F.lit(False))).otherwise(F.col("_trust") <= most)
    kept = known.where(keep).withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy("place")))
    return kept.select("user_id", "memory_id", "position", (F.coalesce("_found", F.lit(False)) | (F.col("_others") == 0)).alias("by_relevance"))

"""Aggregations: rollups, histograms, topics, keywords, quality counters, percentiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from larkspur.functions.text import TOPICS, cut_alike, cut_words, is_significant, known_words, significant_words, topic_cut, topics, topics_told, word_cut
from larkspur.session import ship

#: Places whose counts a task keeps in mind while it looks for the leading words.
PLACES_KNOWN = 1 << 16


def review_rollup(reviews: DataFrame) -> DataFrame:
    """Per place: stored, text and representative reviews, the last time and the mean rating."""
    return reviews.groupBy("restaurant_id").agg(
        F.count("*").alias("stored_count"), F.count_if(F.col("text") != "").alias("text_count"), F.count_if("is_representative").alias("representative_count"),
        F.max("reviewed_at").alias("last_reviewed_at"), F.avg("rating").alias("computed_avg"),
    )


def merged_stats(previous: DataFrame, counts: DataFrame) -> DataFrame:
    """New counts replace old ones; what other stages wrote, and the source's own average, stay."""
    fresh = counts.select("restaurant_id", *[F.col(c).alias(f"_{c}") for c in ("stored_count", "text_count")], "computed_avg")
    joined = previous.join(fresh, "restaurant_id", "left")
    return joined.select("restaurant_id", "source_avg", "computed_avg", F.coalesce("_stored_count", "stored_count").alias("stored_count"), F.coalesce("_text_count", "text_count").alias("text_count"))


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def histogram_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """One map of value to count per key."""
    return histogram(df, key, value).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("distribution"))


def missing_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """How many rows lack each field (null or blank), one row per field; one pass over the data."""
    counts = df.agg(*[F.count_if(F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == "")).alias(f) for f in fields])
    return counts.unpivot([], list(fields), "field", "missing")


def duplicates(df: DataFrame, key: Column) -> DataFrame:
    """Rows, distinct keys and repeats."""
    grouped = df.groupBy(key.alias("_k")).agg(F.count("*").alias("_n"))
    return grouped.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total"), F.count("*").alias("distinct_keys"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def topic_rollup(texts: DataFrame) -> DataFrame:
    """Per place and topic: texts, mean rating, positive share, and the mean's offset from the place's mean."""
    means = texts.groupBy(F.col("restaurant_id").alias("_place")).agg(F.avg("rating").alias("place_mean"))
    tagged = texts.select("restaurant_id", "rating", F.explode(topics(F.col("text"))).alias("topic"))
    per = tagged.groupBy("restaurant_id", "topic").agg(F.count("*").alias("n"), F.avg("rating").alias("mean_rating"), F.avg((F.col("rating") >= 4).cast("double")).alias("positive_ratio"))
    joined = per.join(means, F.col("restaurant_id").eqNullSafe(F.col("_place")), "left")
    return joined.select("restaurant_id", "topic", "n", "mean_rating", "positive_ratio", (F.col("mean_rating") - F.col("place_mean")).alias("sentiment"))


def top_keywords(texts: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The most frequent significant words per key, by count falling, then word; exact counts."""
    words = texts.select(*keys, F.explode(significant_words(F.col("text"))).alias("word"))
    return _most_frequent(words.groupBy(*keys, "word").agg(F.count("*").alias("n")), keys, limit)


def _most_frequent(counts: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "word")))
    return ranked.where(F.col("rank") <= limit)


def topic_keywords(texts: DataFrame, limit: int) -> DataFrame:
    """restaurant_id, topic and keywords: the most frequent significant words of the texts of each place and topic, an array of at most ``limit``.

    A text is cut into words once, whatever the number of its topics. A word of a place is one row with a count for each
    topic, so that what is shuffled grows with the words of places, not with their topics; the counts are dealt out to topics after that.
    """
    names = sorted(TOPICS)
    tagged = texts.select("restaurant_id", "text", topics(F.col("text")).alias("_topics"))
    flags = tagged.select("restaurant_id", *[F.array_contains("_topics", name).alias(name) for name in names], F.when(F.size("_topics") > 0, cut_words(F.col("text"))).alias("_words"))
    # explode of a column makes Spark filter by its size first, and that filter is pushed down to the texts and finds the topics twice more
    words = flags.select("restaurant_id", *names, F.explode_outer("_words").alias("word")).where(is_significant(F.col("word")))
    counts = words.groupBy("restaurant_id", "word").agg(*[F.count_if(F.col(name)).alias(name) for name in names])
    best = _most_frequent(_leading(counts, names, limit), ["restaurant_id", "topic"], limit)
    return best.groupBy("restaurant_id", "topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("keywords"))


def topic_figures(texts: DataFrame, limit: int) -> DataFrame:
    """``topic_rollup`` with the column keywords of ``topic_keywords`` (null where a topic has none), from one reading of the texts' topics and words.

    Beside its words each text counts as a row without a word but with its rating, so the same shuffle brings both; as many of them come out of it
    as a place has ratings. A text that both rules cut alike is cut once for both. Each step is a column of its own, not a bound variable: those copy their arrays.
    """
    names = sorted(TOPICS)
    low, word, itself = F.col("_low"), F.col("word"), F.array(F.lit(None).cast("string"))
    read = texts.select("restaurant_id", "rating", F.lower(F.coalesce("text", F.lit(""))).alias("_low"))
    read = read.select("*", cut_alike(low).alias("_alike"))
    read = read.select("*", F.when(F.col("_alike"), topic_cut(low)).otherwise(word_cut(low)).alias("_words"))
    read = read.select("*", known_words(F.when(F.col("_alike"), F.col("_words")).otherwise(topic_cut(low))).alias("_known"))
    told = read.select("restaurant_id", "rating", "_words", topics_told(low, F.col("_known")).alias("_topics"))
    flags = told.select("restaurant_id", "rating", *[F.array_contains("_topics", name).alias(name) for name in names], F.when(F.size("_topics") > 0, F.concat(itself, "_words")).alias("_words"))
    words = flags.select("restaurant_id", *names, F.explode_outer("_words").alias("word"), "rating").where(word.isNull() | is_significant(word))
    counts = words.groupBy("restaurant_id", "word", F.when(word.isNull(), F.col("rating")).alias("rating")).agg(*[F.count_if(F.col(name)).alias(name) for name in names])
    leading = _leading(counts, names, limit)
    of_kind = Window.partitionBy("restaurant_id", "topic", word.isNull()).orderBy(F.col("n").desc(), "word")
    ranked = leading.withColumn("rank", F.row_number().over(of_kind)).where(word.isNull() | (F.col("rank") <= limit))
    n = F.when(word.isNull(), F.col("n"))
    rated = F.sum(F.when(F.col("rating").isNotNull(), n))
    listed = F.array_sort(F.collect_list(F.when(word.isNotNull(), F.struct("rank", "word"))))
    per = ranked.groupBy("restaurant_id", "topic").agg(
        F.sum(n).alias("n"), (F.sum(F.col("rating") * n) / rated).alias("mean_rating"), (F.sum(F.when(F.col("rating") >= 4, n).when(F.col("rating").isNotNull(), n * 0)) / rated).alias("positive_ratio"),
        F.transform(listed, lambda x: x["word"]).alias("_listed"),
    )
    means = texts.groupBy(F.col("restaurant_id").alias("_place")).agg(F.count("*").alias("_texts"), F.avg("rating").alias("place_mean"))
    joined = per.join(means, F.col("restaurant_id").eqNullSafe(F.col("_place")), "left")
    figures = ["restaurant_id", "topic", "n", "mean_rating", "positive_ratio", (F.col("mean_rating") - F.col("place_mean")).alias("sentiment")]
    return joined.select(*figures, F.when(F.size("_listed") > 0, F.col("_listed")).alias("keywords"))


def _leading(counts: DataFrame, names: Sequence[str], limit: int) -> DataFrame:
    """The counts by restaurant_id and word dealt out to topics, as topic and n, without most words that ``limit`` others of their place and topic precede.

    ``counts`` has a column of counts for each topic; rows without a word all stay. What a task drops is preceded among its own rows,
    so the first ``limit`` of all are never dropped, and the words of places need no sort.
    """
    ship(counts.sparkSession)
    kept = [f for f in counts.schema.fields if f.name not in names]
    return counts.mapInArrow(_leaders(list(names), [f.name for f in kept], limit), S.StructType([*kept, S.StructField("topic", S.StringType()), S.StructField("n", S.LongType())]))


def _leaders(names: list[str], kept: list[str], limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: of each batch the first ``limit`` words of a place and topic, but none that is rarer than ``limit`` of an earlier batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict = {}  # of a place: by topic the least count with which a word may lead
        for batch in batches:
            coded = batch.column("restaurant_id").dictionary_encode(null_encoding="encode")
            places, place = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            floor = np.array([floors.get(p, (1,) * len(names)) for p in places], np.int64).reshape(-1, len(names))
            bare = batch.column("word").is_null().to_numpy(zero_copy_only=False)
            taken, counts = [], []
            for t, name in enumerate(names):
                n = batch.column(name).to_numpy(zero_copy_only=False)
                rows = np.flatnonzero(~bare & (n >= floor[place, t]))
                table = pa.table({"place": place[rows], "n": n[rows], "word": batch.column("word").take(pa.array(rows))})
                rows = rows[pc.sort_indices(table, [("place", "ascending"), ("n", "descending"), ("word", "ascending")]).to_numpy()]
                at = np.arange(len(rows))
                rank = at - np.maximum.accumulate(np.where(np.diff(place[rows], prepend=-1) != 0, at, 0))
                last = rows[rank == limit - 1]
                floor[place[last], t] = n[last]
                rows = np.concatenate([rows[rank < limit], np.flatnonzero(bare & (n > 0))])
                taken.append(rows)
                counts.append(n[rows])
            if len(floors) + len(places) > PLACES_KNOWN:
                floors.clear()
            floors.update(zip(places, floor.tolist()))
            rows = pa.array(np.concatenate(taken))
            topic = pa.array(np.repeat(names, [len(x) for x in taken]).tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in kept], topic, pa.array(np.concatenate(counts))], [*kept, "topic", "n"])

    return run


def coverage(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """How many known keys have rows, how many are known, and the one's share of the other (0 where none is known)."""
    covered = rows.select(key).distinct().join(known.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("covered"))
    total = known.select(key).distinct().agg(F.count("*").alias("known"))
    return covered.join(total).withColumn("kept_fraction", F.when(F.col("known") > 0, F.col("covered") / F.col("known")).otherwise(0.0))  # one row each


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Per key the values at sorted index int(p * (n - 1)), by counting distinct values, not collecting rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*keys)
    ranked = counts.withColumn("_end", F.sum("_n").over(by.orderBy(value))).withColumn("_total", F.sum("_n").over(by))
    at = lambda p: F.floor(F.lit(p) * (F.col("_total") - 1))
    aggs = [F.min(F.when(F.col("_end") > at(p), F.col(value))).alias(f"p{round(p * 100)}") for p in shares]
    return ranked.groupBy(*keys).agg(*aggs)


def outcome_counts(df: DataFrame) -> DataFrame:
    """Audit of a batch whose rows carry outcome and reason."""
    return df.groupBy("outcome", "reason").agg(F.count("*").alias("n"))


def drop_summary(reasons: DataFrame, key: str) -> DataFrame:
    """Reasons per key as 'reason xN', by count falling, then name."""
    counts = reasons.groupBy(key, "reason").agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "reason")))
    return counts.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: F.concat(x["reason"], F.lit(" x"), (-x["m"]).cast("string"))), ", ").alias("summary"))


def recall_at_k(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per query: share of the relevant ids among its first k results."""
    hits = results.where(F.col("rank") <= k).join(truth, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    relevant = truth.groupBy("query_id").agg(F.count("*").alias("relevant"))
    return relevant.join(hits, "query_id", "left").select("query_id", "relevant", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("hits", F.lit(0)) / F.least(F.col("relevant"), F.lit(k))).alias("recall"))


def recall_of_groups(results: DataFrame, members: DataFrame, asked: DataFrame, group: str, k: int) -> DataFrame:
    """As ``recall_at_k``, where all members (id, group) of the group that a query (query_id, group) asks for are relevant: they are counted, not paired."""
    known = results.where(F.col("rank") <= k).join(asked.select("query_id", group), "query_id")
    hits = known.join(members.select("id", group), ["id", group], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    relevant = asked.select("query_id", group).join(members.groupBy(group).agg(F.count("*").alias("relevant")), group)
    return relevant.join(hits, "query_id", "left").select("query_id", "relevant", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("hits", F.lit(0)) / F.least(F.col("relevant"), F.lit(k))).alias("recall"))

"""Audit and run records, marks, write checks, anchored pages and contracts of generated answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.evidence import text_problems
from larkspur.operators.lifecycle import bulk_update, upsert_first_wins


def started_batches(batches: DataFrame, incoming: DataFrame) -> DataFrame:
    """Batches with a running row for each incoming batch that isn't there yet: batch_id, source, started_at, finished_at, status, accepted, rejected."""
    fresh = incoming.select("batch_id", "source", "started_at", F.lit(None).cast("timestamp").alias("finished_at"), F.lit("running").alias("status"), F.lit(0).cast("long").alias("accepted"), F.lit(0).cast("long").alias("rejected"))
    return upsert_first_wins(batches, fresh, ["batch_id"], "started_at")


def finished_batches(batches: DataFrame, judged: DataFrame, now: Column) -> DataFrame:
    """Running batches with counts of their judged rows (batch_id, outcome) and an end; one without a row of its own failed."""
    counts = judged.groupBy("batch_id").agg(F.count_if(F.col("outcome") == "accept").alias("_accepted"), F.count_if(F.col("outcome") == "reject").alias("_rejected"))
    joined = batches.join(counts, "batch_id", "left")
    running = F.col("status") == "running"
    return joined.select(
        "batch_id", "source", "started_at", F.when(running, now).otherwise(F.col("finished_at")).alias("finished_at"), F.when(~running, F.col("status")).when(F.col("_accepted").isNull(), "failed").otherwise("success").alias("status"),
        F.when(running, F.coalesce("_accepted", F.lit(0))).otherwise(F.col("accepted")).alias("accepted"), F.when(running, F.coalesce("_rejected", F.lit(0))).otherwise(F.col("rejected")).alias("rejected"),
    )


def rejections(judged: DataFrame) -> DataFrame:
    """The sink of rejected rows: batch, line and reason, never the text."""
    return judged.where("outcome = 'reject'").select("batch_id", "line_no", "reason")


def recorded_steps(steps: DataFrame, incoming: DataFrame) -> DataFrame:
    """Steps of runs, one per (run_id, seq): the first that was written stays."""
    return upsert_first_wins(steps, incoming, ["run_id", "seq"], "at")


def run_listing(steps: DataFrame) -> DataFrame:
    """Steps numbered within their run by seq, whatever their times say."""
    return steps.withColumn("position", F.row_number().over(Window.partitionBy("run_id").orderBy("seq")))


def marked(rows: DataFrame, chosen: DataFrame, targets: DataFrame, key: str, group: str, flag: str) -> DataFrame:
    """``flag`` of every row of a target group says whether its key was chosen; other groups keep theirs."""
    ids = chosen.select(F.col(key).alias("_key")).distinct().withColumn("_on", F.lit(True))
    groups = targets.select(F.col(group).alias("_group")).distinct().withColumn("_target", F.lit(True))
    joined = rows.join(groups, F.col(group) == F.col("_group"), "left").join(ids, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(flag, F.when(F.col("_target"), F.coalesce("_on", F.lit(False))).otherwise(F.col(flag))).select(*rows.columns)


def display_order(rows: DataFrame, group: str) -> DataFrame:
    """Chosen reviews in the order in which they are shown: newest first, then by id."""
    return rows.withColumn("shown", F.row_number().over(Window.partitionBy(group).orderBy(F.col("reviewed_at").desc(), "id")))


def anchored_page(rows: DataFrame, first: str, second: str, anchor: object, size: int) -> DataFrame:
    """The page behind the row whose ``second`` is the anchor, by (first, second) falling; an unknown anchor has nothing behind it.

    The anchor's place is a scalar subquery: one row, found by its key.
    """
    place = rows.where(F.col(second) == F.lit(anchor)).select(F.struct(first, second).alias("_place")).limit(1)
    behind = rows.join(F.broadcast(place), F.struct(first, second) < F.col("_place")).drop("_place")  # one row
    return behind.orderBy(F.col(first).desc(), F.col(second).desc()).limit(size)


def refused_writes(calls: DataFrame, seen_places: DataFrame, seen_slots: DataFrame) -> DataFrame:
    """Booking calls that name a place or a slot which their turn never saw: call_id, reason. Who saw nothing may write nothing."""
    place = seen_places.select("turn_id", "restaurant_id").distinct().withColumn("_place", F.lit(True))
    slot = seen_slots.select("turn_id", "slot_id").distinct().withColumn("_slot", F.lit(True))
    judged = calls.where("tool = 'request_reservation'").join(place, ["turn_id", "restaurant_id"], "left").join(slot, ["turn_id", "slot_id"], "left")
    reason = F.when(F.col("_place").isNull(), "unknown_place").when(F.col("_slot").isNull(), "unknown_slot")
    return judged.select("call_id", reason.alias("reason")).where("reason IS NOT NULL")


def digest_answer(raw: Column, offered: Column) -> Column:
    """Struct of content, ids and problem of a generated answer: one JSON object of content and source_review_ids, nothing else.

    The content passes the text gate; the ids are some, all offered, and come back sorted, each once.
    """
    known = F.array(F.lit("content"), F.lit("source_review_ids"))
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  so that a value used in many places is computed once

    def read(body: Column) -> Column:
        parsed = F.from_json(body, "content string, source_review_ids array<bigint>", {"mode": "PERMISSIVE"})
        # the keys of what follows a first object would be lost, so the text must be no longer than its one object
        whole = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>")
        return F.struct(parsed.alias("parsed"), F.json_object_keys(body).alias("fields"), F.coalesce(F.size(F.coalesce(whole, F.array().cast("array<string>"))), F.lit(0)).alias("count"), body.startswith("{").alias("opens"))

    def said(p: Column) -> Column:
        content = F.trim(p["parsed"]["content"])
        return F.struct(content.alias("content"), p["parsed"]["source_review_ids"].alias("ids"), F.get(once(F.coalesce(content, F.lit("")), text_problems), F.lit(0)).alias("first"), p["fields"].alias("fields"), p["count"].alias("count"), p["opens"].alias("opens"))

    def judged(p: Column) -> Column:
        ids = p["ids"]
        problem = (
            F.when(p["fields"].isNull() | ~p["opens"], "not_an_object").when(p["count"] != 1, "not_one_object").when(F.size(F.array_except(p["fields"], known)) > 0, "unknown_field")
            .when(p["first"].isNotNull(), p["first"]).when(F.coalesce(F.size(ids), F.lit(0)) <= 0, "no_ids").when(F.size(F.array_except(ids, offered)) > 0, "id_not_offered")
        )
        return F.struct(p.alias("p"), problem.alias("problem"))

    def told(j: Column) -> Column:
        good = j["problem"].isNull()
        return F.struct(F.when(good, j["p"]["content"]).alias("content"), F.when(good, F.array_sort(F.array_distinct(j["p"]["ids"]))).alias("ids"), j["problem"].alias("problem"))

    return once(once(once(once(F.trim(raw), read), said), judged), told)


def embedded_counts(places: DataFrame, documents: DataFrame) -> DataFrame:
    """Places with embedded_review_count out of the metadata of their live, vectored review documents; places without one keep theirs.

    ``documents``: restaurant_id, doc_type, is_active, embedding, metadata (JSON with review_count).
    """
    live = documents.where("is_active AND doc_type = 'representative_reviews' AND embedding IS NOT NULL")
    counts = live.groupBy("restaurant_id").agg(F.max(F.get_json_object("metadata", "$.review_count").try_cast("long")).alias("embedded_review_count")).where("embedded_review_count IS NOT NULL")
    return bulk_update(places, counts, "restaurant_id", ["embedded_review_count"])


def progress(rows: DataFrame) -> DataFrame:
    """Rate and remaining seconds after each report of a stage (stage, at_s, read, total): from the last report, none for the first or without movement."""
    w = Window.partitionBy("stage").orderBy("at_s")
    moved, took = F.col("read") - F.lag("read").over(w), F.col("at_s") - F.lag("at_s").over(w)
    rate = F.when((moved > 0) & (took > 0), moved / took)
    return rows.withColumn("rate", rate).withColumn("eta_s", F.when(F.col("rate").isNotNull(), (F.col("total") - F.col("read")) / F.col("rate")))


def inventory(slots: DataFrame, reservations: DataFrame) -> DataFrame:
    """Every slot with its reservations beside it, by time, then id; reservations newest first, then by id; a slot without any has one row.

    ``slots``: restaurant_id, slot_date, slot_time, slot_id, capacity; ``reservations``: slot_id, reservation_id, created_at, party.
    """
    joined = slots.join(reservations, "slot_id", "left")
    of_slot = Window.partitionBy("slot_id")
    place = Window.partitionBy("restaurant_id", "slot_date").orderBy("slot_time", "slot_id", F.col("created_at").desc_nulls_last(), "reservation_id")
    return joined.withColumn("booked", F.coalesce(F.sum("party").over(of_slot), F.lit(0))).withColumn("row", F.row_number().over(place))

"""Stateful logic over ordered events: holds, expiry, confirmations, turns, spans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOLD_MINUTES = 10
CLARIFICATION_CAP = 3
SLOT_TIMES = ("17:00", "18:00", "19:00", "20:00", "21:00")


def hold_capacity(requests: DataFrame, capacity: int) -> DataFrame:
    """Holds and releases per slot in request order: request_id, granted, booked (after it).

    ``requests``: slot_id, request_id, at, size (negative: a release, which floors at 0).
    A hold that doesn't fit is refused whole; later smaller ones may fit, so the fold is sequential
    per slot. Sorted partitions are streamed through it: what is held is one slot and one number, however
    many requests a slot has.
    """

    def run(batches):
        slot, booked = None, 0
        for batch in batches:
            granted, after = [], []
            for now, size in zip(batch["slot_id"], batch["size"], strict=True):
                if slot is None or now != slot:
                    slot, booked = now, 0
                fits = size <= 0 or booked + size <= capacity
                booked = max(0, booked + int(size)) if fits else booked
                granted.append(fits)
                after.append(booked)
            yield pd.DataFrame({"slot_id": batch["slot_id"], "request_id": batch["request_id"], "granted": granted, "booked": after})

    ordered = requests.select("slot_id", "request_id", "at", "size").repartition("slot_id").sortWithinPartitions("slot_id", "at", "request_id")
    return ordered.select("slot_id", "request_id", "size").mapInPandas(run, "slot_id long, request_id long, granted boolean, booked long")


def expired_holds(holds: DataFrame, now: Column, minutes: int = HOLD_MINUTES) -> DataFrame:
    return holds.where((F.col("status") == "held") & (F.col("held_at") < now - F.make_dt_interval(mins=F.lit(minutes))))


def give_back(slots: DataFrame, expired: DataFrame) -> DataFrame:
    """Slots with the expired holds' seats returned, never below none booked."""
    freed = expired.groupBy("slot_id").agg(F.sum("size").alias("_freed"))
    return slots.join(freed, "slot_id", "left").withColumn("booked", F.greatest(F.lit(0), F.col("booked") - F.coalesce("_freed", F.lit(0)))).drop("_freed")


def confirm_once(requests: DataFrame, key: str, order: str) -> DataFrame:
    """Each request with the first result of its key, and whether it is a replay."""
    w = Window.partitionBy(key).orderBy(order)
    return requests.withColumn("first_id", F.first(order).over(w)).withColumn("replay", F.row_number().over(w) > 1)


def availability(places: DataFrame, dates: DataFrame, booked: DataFrame, capacity: int, party: int) -> DataFrame:
    """Fixed slots of each place and date with room for the party; the slot's id is made of its parts."""
    times = F.explode(F.array(*map(F.lit, SLOT_TIMES))).alias("slot_time")
    # every place has a slot on every day: the result is that product, so it is made directly
    slots = places.select("restaurant_id").crossJoin(dates.select("slot_date")).select("restaurant_id", "slot_date", times)
    named = slots.withColumn("slot_id", slot_id(F.col("restaurant_id"), F.col("slot_date"), F.col("slot_time")))
    left = named.join(booked.select("slot_id", "booked"), "slot_id", "left").withColumn("remaining", F.lit(capacity) - F.coalesce("booked", F.lit(0)))
    return left.where(F.col("remaining") >= party).select("restaurant_id", "slot_date", "slot_time", "slot_id", "remaining")


def slot_id(place: Column, date: Column, time: Column) -> Column:
    return F.concat(F.lit("r"), place.cast("string"), F.lit("-"), F.date_format(date, "yyyy-MM-dd"), F.lit("-"), F.replace(time, F.lit(":"), F.lit("")))


def idempotency_key(thread: Column, action: Column, request: Column, arguments: Column) -> Column:
    """The key a confirmation is remembered by, made of its thread, action, request id and the digest of its arguments."""
    parts = [*[F.coalesce(p.cast("string"), F.lit("")) for p in (thread, action, request)], F.sha2(F.coalesce(arguments, F.lit("")), 256)]
    return F.concat(F.lit("res-"), F.left(F.sha2(F.concat_ws("\n", *parts), 256), F.lit(32)))


def confirmation_states(events: DataFrame) -> DataFrame:
    """State of each thread after each event, and whether a confirm is executed, replayed or refused.

    Events (thread, at, kind): propose -> pending; confirm when pending -> completed (executed once), when
    completed -> replay; cancel -> idle. Since a propose or cancel resets everything, the state is decided by
    the last reset and the confirms behind it: a window does it, no fold.
    """
    w = Window.partitionBy("thread").orderBy("at", "event_id")
    reset = F.col("kind").isin("propose", "cancel")
    marked = events.withColumn("_reset", F.last(F.when(reset, F.col("kind")), ignorenulls=True).over(w)).withColumn("_era", F.count_if(reset).over(w))
    confirms = F.count_if(F.col("kind") == "confirm").over(Window.partitionBy("thread", "_era").orderBy("at", "event_id"))
    pending = F.col("_reset") == "propose"
    state = F.when(pending & (confirms > 0), "completed").when(pending, "pending").otherwise("idle")
    effect = F.when((F.col("kind") == "confirm") & pending, F.when(confirms == 1, "executed").otherwise("replayed")).when(F.col("kind") == "confirm", "refused")
    return marked.withColumn("state", state).withColumn("effect", effect).drop("_reset", "_era")


def reduce_turns(events: DataFrame) -> DataFrame:
    """One row per run: text of the deltas since the last replace, tools started and finished, last memory, terminal phase.

    ``events``: run_id, seq, kind (delta, replace, tool_start, tool_finish, memory, done, failed), value.
    """
    seq = F.col("seq")
    last_replace = F.max(F.when(F.col("kind") == "replace", seq))
    base = events.join(events.groupBy("run_id").agg(last_replace.alias("_from")), "run_id")
    kept = F.col("kind").isin("delta", "replace") & (seq >= F.coalesce("_from", F.lit(-1)))
    pieces = F.array_sort(F.collect_list(F.when(kept, F.struct("seq", "value"))))
    return base.groupBy("run_id").agg(
        F.array_join(F.transform(pieces, lambda p: p["value"]), "").alias("text"), F.count_if(F.col("kind") == "tool_start").alias("started"),
        F.count_if(F.col("kind") == "tool_finish").alias("finished"), F.max_by(F.when(F.col("kind") == "memory", F.col("value")), F.when(F.col("kind") == "memory", seq)).alias("memory"),
        F.coalesce(F.min_by(F.when(F.col("kind").isin("done", "failed"), F.col("kind")), F.when(F.col("kind").isin("done", "failed"), seq)), F.lit("open")).alias("phase"),
    )


def pair_spans(events: DataFrame) -> DataFrame:
    """Latency of each call from its start and finish; an unfinished call has none. seq counts starts per run."""
    starts = events.where("kind = 'tool_start'").select("run_id", "call_id", F.col("at").alias("started_at")).withColumn("seq", F.row_number().over(Window.partitionBy("run_id").orderBy("started_at", "call_id")))
    ends = events.where("kind = 'tool_finish'").groupBy("run_id", "call_id").agg(F.min("at").alias("finished_at"))
    return starts.join(ends, ["run_id", "call_id"], "left").withColumn("latency_ms", (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1000)


def clarifications(events: DataFrame, cap: int = CLARIFICATION_CAP) -> DataFrame:
    """Running count of clarifications per thread, and whether one more is allowed."""
    w = Window.partitionBy("thread").orderBy("at", "event_id")
    count = F.count_if(F.col("kind") == "clarify").over(w)
    return events.withColumn("asked", count).withColumn("may_ask", count < cap)


def missing_slots(before: Column, filled: Column) -> Column:
    """What was missing last turn and is still not filled."""
    return F.array_except(before, filled)


RETRIEVAL_TOOLS = ("search_restaurants", "get_evidence")


def tool_counters(calls: DataFrame, retrieval: tuple[str, ...] = RETRIEVAL_TOOLS) -> DataFrame:
    return calls.groupBy("run_id").agg(F.count("*").alias("tool_calls"), F.count_if(F.col("tool").isin(*retrieval)).alias("retrieval_calls"))


def frames(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """Frames of a server-sent stream cut at blank lines, whatever the chunk bounds: pos, event, data.

    A frame without an event's name goes, comments with it; one without data stays, with empty data. Data lines are
    trimmed and joined by newlines, leading empty ones left out. What follows the last blank line is a frame as well.
    """
    whole = chunks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "chunk"))), lambda x: x["chunk"]), "").alias("_all"))
    cut = whole.select(key, F.posexplode(F.split("_all", "\n\n")).alias("pos", "frame"))
    lines = F.split("frame", "\n")
    trimmed = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    pick = lambda name: F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(f"{name}:"))), lambda x: trimmed(F.substring(x, len(name) + 2, 1 << 30)))
    named = cut.select(key, "pos", F.try_element_at(pick("event"), F.lit(-1)).alias("event"), F.regexp_replace(F.array_join(pick("data"), "\n"), "^\n+", "").alias("data"))
    return named.where(F.coalesce("event", F.lit("")) != "")


def stable_text(text: Column, marker: str) -> Column:
    """The text without the longest suffix that could still grow into the marker."""
    out = text
    for n in range(1, len(marker)):
        out = F.when(F.endswith(text, F.lit(marker[:n])), F.left(text, F.length(text) - n)).otherwise(out)
    return F.when(F.contains(text, F.lit(marker)), F.substring_index(text, marker, 1)).otherwise(out)

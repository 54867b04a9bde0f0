"""Turns of a conversation out of their ordered events: what a reader of the stream sees, and what the run gathers.

Events have run_id, seq, kind, value (string), ids (array<bigint>) and texts (array<string>); fields that a kind
doesn't use are null. ``larkspur.streaming.stateful`` has the streaming twins of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENTS = "run_id long, seq long, kind string, value string, ids array<bigint>, texts array<string>"
REDUCED = "run_id long, phase string, text string, thinking string, tools array<struct<call_id:string,status:string>>, open_tools int, citations array<bigint>, memories array<struct<memory_id:bigint,content:string>>, warnings array<string>, last_seq long"
GATHERED = "run_id long, candidates array<bigint>, evidence array<bigint>, warnings array<string>, place_ids array<bigint>, slot_ids array<string>, pinned long, retrieval_empty boolean"

#: Kinds of events of a stream and of tool results.
START, DELTA, THINKING, REPLACE, TOOL_START, TOOL_FINISH, CITATION, AWAITING, CONFIRMATION, MEMORY, END, ERROR = (
    "message.start", "message.delta", "thinking.delta", "message.replace", "tool.start", "tool.finish", "citation", "state.awaiting_input", "confirmation.required", "memory.saved", "message.end", "error",
)
SEARCHED, RECALLED, RESOLVED, AVAILABLE = "search", "evidence", "resolved", "availability"


def _is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def _in_order(rows: DataFrame, value: Column, order: Column, name: str) -> DataFrame:
    """One array a run: ``value`` in the order of ``order``."""
    return rows.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]).alias(name))


def _firsts(rows: DataFrame, many: str, name: str) -> DataFrame:
    """One array a run: the distinct members of an array column in first-seen order."""
    each = rows.select("run_id", "seq", F.posexplode(many).alias("pos", "v")).groupBy("run_id", "v").agg(F.min(F.struct("seq", "pos")).alias("o"))
    return _in_order(each, F.col("v"), F.col("o"), name)


def reduced_turns(events: DataFrame) -> DataFrame:
    """What a reader of each run's events shows at their end (columns REDUCED).

    A start resets all but the phases before it. The text is what came since the last replacement; a tool finishes
    by its call id, whatever the order of calls; cited ids are united in first-seen order; a saved memory
    replaces one with the same id and goes to the end. An end parks the run if a confirmation or an input was asked for before it; its
    warnings, if it has any list, are the run's. Without a start, end or error a run is idle.
    """
    begun = events.where(_is(START)).groupBy("run_id").agg(F.max("seq").alias("_from"))
    own = events.join(begun, "run_id", "left").where(F.col("_from").isNull() | (F.col("seq") >= F.col("_from"))).drop("_from")
    marks = own.groupBy("run_id").agg(
        F.max(F.when(_is(REPLACE), F.col("seq"))).alias("_replaced"), F.max(F.when(_is(END), F.col("seq"))).alias("_ended"), F.max(F.when(_is(ERROR), F.col("seq"))).alias("_failed"), F.max(F.when(_is(START), F.col("seq"))).alias("_started"),
        F.min(F.when(_is(CONFIRMATION), F.col("seq"))).alias("_confirm"), F.min(F.when(_is(AWAITING), F.col("seq"))).alias("_await"), F.max("seq").alias("last_seq"),
        F.max_by(F.when(_is(END), F.col("texts")), F.when(_is(END) & F.col("texts").isNotNull(), F.col("seq"))).alias("_warnings"),
    )
    said = own.join(marks.select("run_id", "_replaced"), "run_id").where(_is(DELTA, REPLACE) & (F.col("seq") >= F.coalesce("_replaced", F.lit(-1))))
    text = _in_order(said, F.coalesce("value", F.lit("")), F.col("seq"), "_text")
    thinking = _in_order(own.where(_is(THINKING)), F.coalesce("value", F.lit("")), F.col("seq"), "_thinking")
    starts = own.where(_is(TOOL_START)).select("run_id", "seq", F.col("value").alias("call_id"))
    ends = own.where(_is(TOOL_FINISH)).select("run_id", F.col("value").alias("call_id"), F.col("seq").alias("_end"), F.coalesce(F.try_element_at("texts", F.lit(1)), F.lit("ok")).alias("_status"))
    status = starts.join(ends, ["run_id", "call_id"], "left").groupBy("run_id", "seq", "call_id").agg(F.max_by("_status", F.when(F.col("_end") > F.col("seq"), F.col("_end"))).alias("_status"))
    tools = _in_order(status, F.struct("call_id", F.coalesce("_status", F.lit("running")).alias("status")), F.col("seq"), "tools")
    cited = _firsts(own.where(_is(CITATION)), "ids", "citations")
    saved = own.where(_is(MEMORY)).groupBy("run_id", F.try_element_at("ids", F.lit(1)).alias("memory_id")).agg(F.max_by("value", "seq").alias("content"), F.max("seq").alias("_at"))
    memories = _in_order(saved, F.struct("memory_id", "content"), F.col("_at"), "memories")
    last = F.greatest("_started", "_ended", "_failed")
    parked = F.when(F.col("_confirm") < F.col("_ended"), "awaiting_confirm").when(F.col("_await") < F.col("_ended"), "awaiting_user").otherwise("done")
    phase = F.when(last.isNull(), "idle").when(last == F.col("_failed"), "failed").when(last == F.col("_ended"), parked).otherwise("streaming")
    out = marks
    for part in (text, thinking, tools, cited, memories):
        out = out.join(part, "run_id", "left")
    listed = lambda name, kind: F.coalesce(name, F.array().cast(kind)).alias(name)
    return out.select(
        "run_id", phase.alias("phase"), F.array_join(F.coalesce("_text", F.array().cast("array<string>")), "").alias("text"), F.array_join(F.coalesce("_thinking", F.array().cast("array<string>")), "").alias("thinking"),
        listed("tools", "array<struct<call_id:string,status:string>>"), F.coalesce(F.size(F.filter("tools", lambda t: t["status"] == "running")), F.lit(0)).alias("open_tools"), listed("citations", "array<bigint>"),
        listed("memories", "array<struct<memory_id:bigint,content:string>>"), F.coalesce("_warnings", F.array().cast("array<string>")).alias("warnings"), "last_seq",
    )


def gathered_turns(events: DataFrame) -> DataFrame:
    """What each run has gathered from its tools' results (columns GATHERED).

    Candidates of searches and evidence are appended, repeats included; warnings, places and slots count once, in first-seen
    order. A resolved name pins its id. A search drops a pin that is not among the candidates gathered by then; while there
    are no candidates at all the pin stays. A search or recall without results is remembered.
    """
    searched = events.where(_is(SEARCHED))
    each = searched.select("run_id", "seq", F.posexplode("ids").alias("pos", "id"))
    candidates = _in_order(each, F.col("id"), F.struct("seq", "pos"), "candidates")
    recalled = events.where(_is(RECALLED)).select("run_id", "seq", F.posexplode("ids").alias("pos", "id"))
    evidence = _in_order(recalled, F.col("id"), F.struct("seq", "pos"), "evidence")
    warned = _firsts(events.where(_is(SEARCHED, RECALLED)), "texts", "warnings")
    offered = events.where(_is(AVAILABLE))
    places, slots = _firsts(offered, "ids", "place_ids"), _firsts(offered, "texts", "slot_ids")
    empty = events.groupBy("run_id").agg(F.coalesce(F.bool_or(_is(SEARCHED, RECALLED) & (F.size(F.coalesce("ids", F.array().cast("array<bigint>"))) == 0)), F.lit(False)).alias("retrieval_empty"))

    pins = events.where(_is(RESOLVED) & F.try_element_at("ids", F.lit(1)).isNotNull()).groupBy("run_id").agg(F.max("seq").alias("_at"), F.max_by(F.try_element_at("ids", F.lit(1)), "seq").alias("_pin"))
    some = each.groupBy("run_id").agg(F.min("seq").alias("_some"))
    own = each.groupBy("run_id", F.col("id").alias("_pin")).agg(F.min("seq").alias("_listed"))
    # the first search behind the pin that finds candidates gathered decides: what it lists stays listed
    decides = searched.select("run_id", "seq").join(pins, "run_id").join(some, "run_id").where((F.col("seq") > F.col("_at")) & (F.col("seq") >= F.col("_some"))).groupBy("run_id").agg(F.min("seq").alias("_decides"))
    kept = pins.join(decides, "run_id", "left").join(own, ["run_id", "_pin"], "left")
    pinned = kept.select("run_id", F.when(F.col("_decides").isNull() | (F.col("_listed") <= F.col("_decides")), F.col("_pin")).alias("pinned"))
    out = empty
    for part in (candidates, evidence, warned, places, slots, pinned):
        out = out.join(part, "run_id", "left")
    listed = lambda name, kind="array<bigint>": F.coalesce(name, F.array().cast(kind)).alias(name)
    return out.select("run_id", listed("candidates"), listed("evidence"), listed("warnings", "array<string>"), listed("place_ids"), listed("slot_ids", "array<string>"), "pinned", "retrieval_empty")


def confirmed_results(events: DataFrame) -> DataFrame:
    """What becomes of each confirm: thread, event_id, effect (executed, replayed, refused), arguments, result.

    Events have thread, event_id, at, kind (propose, confirm, cancel), key (that a confirmation is remembered by) and arguments. A confirm
    carries out the thread's open proposal once; any later confirm of the same key, also one that was proposed anew,
    gives the first result again. Without an open proposal it is refused.
    """
    from pyspark.sql import Window

    ordered = Window.partitionBy("thread").orderBy("at", "event_id")
    reset = _is("propose", "cancel")
    last = F.last(F.when(reset, F.struct("kind", "key", "arguments")), ignorenulls=True).over(ordered)
    confirms = events.withColumn("_last", last).where(_is("confirm"))
    open_ = F.coalesce(F.col("_last.kind") == "propose", F.lit(False))
    keyed = confirms.select("thread", "at", "event_id", F.when(open_, F.col("_last.key")).alias("key"), F.when(open_, F.col("_last.arguments")).alias("_arguments"), open_.alias("_open"))
    same = Window.partitionBy("thread", "key").orderBy("at", "event_id")
    first, n = F.first(F.struct("event_id", "_arguments")).over(same), F.row_number().over(same)
    done = keyed.withColumn("_first", first).withColumn("_n", n)
    return done.select(
        "thread", "event_id", F.when(~F.col("_open"), "refused").when(F.col("_n") == 1, "executed").otherwise("replayed").alias("effect"), F.when(F.col("_open"), F.col("_first._arguments")).alias("arguments"),
        F.when(F.col("_open"), F.concat(F.lit("done-"), F.col("_first.event_id").cast("string"))).alias("result"),
    )

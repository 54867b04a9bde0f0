"""Streams with keyed state and timers: turns, holds that expire, and confirmations that remember their result.

Each is a processor of ``transformWithState``: values, lists and maps are kept per key by the state store, so a batch reads and
writes what its keys need and nothing is folded over a key's whole past. Events of a key come in the order of
their batches; within a batch they are sorted. Given the same events the rows do not depend on how they were
split into batches, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larkspur.operators import turns as T
from larkspur.operators.state import HOLD_MINUTES
from larkspur.session import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state(spark: SparkSession) -> None:
    """These processors need a state store with several states a key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    ship(spark)


def _entries(state, by: int = 0) -> list[tuple]:
    """A map state's (key, value) tuples in the order of a part of the value."""
    return sorted(state.iterator(), key=lambda kv: kv[1][by])


class TurnReducer(StatefulProcessor):
    """Twin of ``reduced_turns``: a row with a run's present state for each batch that has events of it."""

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "phase string, text string, thinking string, confirm boolean, await boolean, warnings array<string>, last_seq long")
        self.tools = handle.getMapState("tools", "seq long", "seq long, call_id string, status string")
        self.cited = handle.getMapState("cited", "id long", "at long")
        self.memories = handle.getMapState("memories", "id long", "at long, content string")
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        phase, text, thinking, confirm, wait, warnings, last = self.head.get() if self.head.exists() else ("idle", "", "", False, False, [], -1)
        said, thought = [text], [thinking]
        cited = sum(1 for _ in self.cited.keys())
        rows = sorted(rows, key=lambda r: r.seq)
        if self.keep_ms is not None:
            until = max([_ms(e.at) + self.keep_ms for e in rows] + [self.until.get()[0] if self.until.exists() else 0])
            self.until.update((until,))
            self.handle.registerTimer(until)
        for e in rows:
            last = max(last, e.seq)
            if e.kind == T.START:
                phase, said, thought, confirm, wait, warnings, cited = "streaming", [], [], False, False, [], 0
                for state in (self.tools, self.cited, self.memories):
                    state.clear()
            elif e.kind == T.DELTA:
                said.append(e.value or "")
            elif e.kind == T.THINKING:
                thought.append(e.value or "")
            elif e.kind == T.REPLACE:
                said = [e.value or ""]
            elif e.kind == T.TOOL_START:
                self.tools.updateValue((e.seq,), (e.seq, e.value, "running"))
            elif e.kind == T.TOOL_FINISH:
                for at, (seq, call, _) in list(self.tools.iterator()):
                    if call == e.value and seq < e.seq:
                        self.tools.updateValue(at, (seq, call, (e.texts or ["ok"])[0]))
            elif e.kind == T.CITATION:
                for x in e.ids or ():
                    if not self.cited.containsKey((x,)):
                        self.cited.updateValue((x,), (cited,))
                        cited += 1
            elif e.kind == T.MEMORY:
                self.memories.updateValue(((e.ids or [None])[0],), (e.seq, e.value))
            elif e.kind == T.CONFIRMATION:
                confirm = True
            elif e.kind == T.AWAITING:
                wait = True
            elif e.kind == T.END:
                phase = "awaiting_confirm" if confirm else "awaiting_user" if wait else "done"
                warnings = warnings if e.texts is None else list(e.texts)
            elif e.kind == T.ERROR:
                phase = "failed"
        text, thinking = "".join(said), "".join(thought)
        self.head.update((phase, text, thinking, confirm, wait, list(warnings), last))
        tools = [(call, status) for _, (_, call, status) in _entries(self.tools)]
        yield Row(
            run_id=key[0], phase=phase, text=text, thinking=thinking, tools=tools, open_tools=sum(s == "running" for _, s in tools), citations=[k[0] for k, _ in _entries(self.cited)],
            memories=[(k[0], content) for k, (_, content) in _entries(self.memories)], warnings=list(warnings), last_seq=last,
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.until.exists() and self.until.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():  # no event has come since
            for state in (self.head, self.tools, self.cited, self.memories, self.until):
                state.clear()
        yield from ()

    def close(self) -> None:
        pass


class TurnGatherer(StatefulProcessor):
    """Twin of ``gathered_turns``; candidates and evidence are list states that only grow at their end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "pinned long, retrieval_empty boolean")
        self.candidates = handle.getListState("candidates", "id long")
        self.listed = handle.getMapState("listed", "id long", "n int")
        self.evidence = handle.getListState("evidence", "id long")
        self.firsts = {name: handle.getMapState(name, f"value {kind}", "at long") for name, kind in (("warnings", "string"), ("place_ids", "long"), ("slot_ids", "string"))}

    def note(self, name: str, values) -> None:
        state = self.firsts[name]
        n = sum(1 for _ in state.keys())
        for x in values or ():
            if not state.containsKey((x,)):
                state.updateValue((x,), (n,))
                n += 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        pinned, empty = self.head.get() if self.head.exists() else (None, False)
        for e in sorted(rows, key=lambda r: r.seq):
            ids = [(x,) for x in e.ids or ()]
            if e.kind == T.SEARCHED:
                if ids:
                    self.candidates.appendList(ids)
                for x in ids:
                    self.listed.updateValue(x, (1,))
                if pinned is not None and self.listed.exists() and not self.listed.containsKey((pinned,)):
                    pinned = None
            elif e.kind == T.RECALLED and ids:
                self.evidence.appendList(ids)
            elif e.kind == T.RESOLVED and ids and ids[0][0] is not None:
                pinned = ids[0][0]
            elif e.kind == T.AVAILABLE:
                self.note("place_ids", e.ids)
                self.note("slot_ids", e.texts)
            if e.kind in (T.SEARCHED, T.RECALLED):
                self.note("warnings", e.texts)
                empty = empty or not ids
        self.head.update((pinned, empty))
        lists = {name: [k[0] for k, _ in _entries(state)] for name, state in self.firsts.items()}
        yield Row(run_id=key[0], candidates=[x[0] for x in self.candidates.get()], evidence=[x[0] for x in self.evidence.get()], **lists, pinned=pinned, retrieval_empty=empty)

    def close(self) -> None:
        pass


def reduced_turn_stream(events: DataFrame, keep: timedelta | None = None, late: str = "0 seconds") -> DataFrame:
    """``reduced_turns`` as a stream: the last row of a run is its batch row.

    With ``keep`` events also have a time ``at``, and a run without an event for so long is forgotten when the
    watermark (``late`` behind) has passed it; without it the state of every run stays.
    """
    use_state(events.sparkSession)
    if keep is None:
        return events.groupBy("run_id").transformWithState(TurnReducer(), T.REDUCED, "Update", "None")
    return events.withWatermark("at", late).groupBy("run_id").transformWithState(TurnReducer(_length(keep)), T.REDUCED, "Update", "EventTime")


def gathered_turn_stream(events: DataFrame) -> DataFrame:
    """``gathered_turns`` as a stream: the last row of a run is its batch row."""
    use_state(events.sparkSession)
    return events.groupBy("run_id").transformWithState(TurnGatherer(), T.GATHERED, "Update", "None")


def _ms(at: datetime) -> int:
    return round((at if at.tzinfo else at.astimezone()).timestamp() * 1000)


def _length(span: timedelta) -> int:
    return round(span.total_seconds() * 1000)


class HoldKeeper(StatefulProcessor):
    """Capacity of one slot: holds expire by timer, so seats come back even where no request follows."""

    def __init__(self, capacity: int, minutes: int):
        self.capacity, self.last_ms = capacity, minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.booked = handle.getValueState("booked", "n long")
        self.held = handle.getMapState("held", "request_id long", "size long, until long")
        self.kept = handle.getMapState("kept", "request_id long", "size long")

    def expired(self, slot, before_ms: int, booked: int) -> Iterator[tuple[int, Row]]:
        """(booked, row) for each hold whose time ended before the moment, in the order of their ends."""
        gone = sorted((until, k[0], size) for k, (size, until) in self.held.iterator() if until < before_ms)
        for until, request, size in gone:
            self.held.removeKey((request,))
            booked = max(0, booked - size)
            yield booked, Row(slot_id=slot, request_id=request, at=datetime.fromtimestamp(until / 1000, timezone.utc), outcome="expired", booked=booked)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (booked,) = self.booked.get() if self.booked.exists() else (0,)
        for r in sorted(rows, key=lambda r: (r.at, r.request_id, r.kind)):
            now = _ms(r.at)
            for booked, row in self.expired(key[0], now, booked):  # noqa: B020  the last row's count goes on
                yield row
            mine = (r.request_id,)
            outcome = "ignored"
            if r.kind == "hold" and not self.held.containsKey(mine) and not self.kept.containsKey(mine):
                outcome = "granted" if booked + r.size <= self.capacity else "refused"
                if outcome == "granted":
                    booked += r.size
                    self.held.updateValue(mine, (r.size, now + self.last_ms))
                    self.handle.registerTimer(now + self.last_ms + 1)
            elif r.kind == "confirm" and self.held.containsKey(mine):
                outcome = "confirmed"
                self.kept.updateValue(mine, (self.held.getValue(mine)[0],))
                self.held.removeKey(mine)
            elif r.kind == "cancel":
                for state in (self.held, self.kept):
                    if state.containsKey(mine):
                        outcome, booked = "released", max(0, booked - state.getValue(mine)[0])
                        state.removeKey(mine)
            yield Row(slot_id=key[0], request_id=r.request_id, at=r.at, outcome=outcome, booked=booked)
        self.booked.update((booked,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (booked,) = self.booked.get() if self.booked.exists() else (0,)
        for booked, row in self.expired(key[0], expiredTimerInfo.getExpiryTimeInMs(), booked):  # noqa: B020
            yield row
        self.booked.update((booked,))

    def close(self) -> None:
        pass


def expiring_holds(requests: DataFrame, capacity: int, late: str = "0 seconds", minutes: int = HOLD_MINUTES) -> DataFrame:
    """slot_id, request_id, at, outcome (granted, refused, confirmed, released, expired, ignored) and seats booked behind it.

    Requests have slot_id, request_id, at, kind (hold, confirm, cancel) and size, null for the latter two. A hold that is
    neither confirmed nor cancelled gives its seats back once event time is more than ``minutes`` behind it: when the next request
    of its slot comes, or when the watermark passes, whichever is first. What comes later than ``late`` is not seen.
    """
    use_state(requests.sparkSession)
    timed = requests.withWatermark("at", late)
    return timed.groupBy("slot_id").transformWithState(HoldKeeper(capacity, minutes), "slot_id long, request_id long, at timestamp, outcome string, booked long", "Append", "EventTime")


class Confirmer(StatefulProcessor):
    """The open proposal of a thread, and by key the arguments and first result of what was carried out."""

    def __init__(self, execute: Callable[[int, str], str], keep_ms: int):
        self.execute, self.keep_ms = execute, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "key string, arguments string")
        self.done = handle.getMapState("done", "key string", "arguments string, result string, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for e in sorted(rows, key=lambda r: (r.at, r.event_id)):
            if e.kind == "propose":
                self.open.update((e.key, e.arguments))
            elif e.kind == "cancel":
                self.open.clear()
            elif e.kind == "confirm":
                if not self.open.exists():
                    yield Row(thread=key[0], event_id=e.event_id, effect="refused", arguments=None, result=None)
                    continue
                (name, arguments), now = self.open.get(), _ms(e.at)
                known = self.done.getValue((name,)) if self.done.containsKey((name,)) else None
                effect = "replayed" if known and known[2] >= now else "executed"
                if effect == "executed":
                    known = (arguments, self.execute(e.event_id, arguments), now + self.keep_ms)
                    self.done.updateValue((name,), known)
                    self.handle.registerTimer(known[2] + 1)
                yield Row(thread=key[0], event_id=e.event_id, effect=effect, arguments=known[0], result=known[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for name in [k for k, v in self.done.iterator() if v[2] < expiredTimerInfo.getExpiryTimeInMs()]:
            self.done.removeKey(name)
        yield from ()

    def close(self) -> None:
        pass


def named_result(event_id: int, arguments: str) -> str:
    return f"done-{event_id}"


def confirmation_stream(events: DataFrame, execute: Callable[[int, str], str] = named_result, keep: timedelta = timedelta(days=30), late: str = "0 seconds") -> DataFrame:
    """``confirmed_results`` as a stream, in any split and behind a restart; results are forgotten once event time ``at`` is more than ``keep`` behind them.

    ``execute`` carries out a proposal. Its result is stored with the batch, so a batch that is run again
    runs it again: what it calls must know the key as well.
    """
    use_state(events.sparkSession)
    processor = Confirmer(execute, _length(keep))
    return events.withWatermark("at", late).groupBy("thread").transformWithState(processor, "thread long, event_id long, effect string, arguments string, result string", "Append", "EventTime")

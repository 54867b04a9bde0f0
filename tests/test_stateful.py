"""Stateful streams against their batch twins and plain loops, for several splits into batches and a restart."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larkspur.operators import turns as T
from larkspur.streaming import stateful

KINDS = [T.START, T.DELTA, T.DELTA, T.THINKING, T.REPLACE, T.TOOL_START, T.TOOL_START, T.TOOL_FINISH, T.CITATION, T.AWAITING, T.CONFIRMATION, T.MEMORY, T.END, T.ERROR]


def shown(draw, n=260):
    rows = []
    for seq in range(n):
        kind = draw.choice(KINDS)
        ids = draw.sample(range(9), draw.randrange(4)) if kind == T.CITATION else [draw.randrange(4)] if kind == T.MEMORY else None
        texts = draw.choice([None, [], ["w1", "w2"]]) if kind == T.END else ["failed"] if kind == T.TOOL_FINISH and seq % 3 == 0 else None
        rows.append((seq % 7 if seq % 29 else 7, seq, kind, draw.choice(["a", "b", "c "]), ids, texts))
    return rows + [(8, n, T.DELTA, None, None, None), (9, n + 1, "other", None, None, None)]


def plain_reduce(rows):
    out = {}
    for run in {r[0] for r in rows}:
        s = dict(phase="idle", text="", thinking="", tools=[], citations=[], memories=[], warnings=[], confirm=False, wait=False)
        for _, seq, kind, value, ids, texts in sorted((r for r in rows if r[0] == run), key=lambda r: r[1]):
            s["last"] = seq
            if kind == T.START:
                s |= dict(phase="streaming", text="", thinking="", tools=[], citations=[], memories=[], warnings=[], confirm=False, wait=False)
            s["text"] = value or "" if kind == T.REPLACE else s["text"] + (value or "") * (kind == T.DELTA)
            s["thinking"] += (value or "") * (kind == T.THINKING)
            if kind == T.TOOL_START:
                s["tools"].append((value, "running"))
            if kind == T.TOOL_FINISH:
                s["tools"] = [(c, (texts or ["ok"])[0]) if c == value else (c, x) for c, x in s["tools"]]
            if kind == T.CITATION:
                s["citations"] += [x for x in ids if x not in s["citations"]]
            if kind == T.MEMORY:
                s["memories"] = [m for m in s["memories"] if m[0] != ids[0]] + [(ids[0], value)]
            s["confirm"] |= kind == T.CONFIRMATION
            s["wait"] |= kind == T.AWAITING
            if kind == T.END:
                s["phase"] = "awaiting_confirm" if s["confirm"] else "awaiting_user" if s["wait"] else "done"
                s["warnings"] = s["warnings"] if texts is None else texts
            if kind == T.ERROR:
                s["phase"] = "failed"
        out[run] = (s["phase"], s["text"], s["thinking"], s["tools"], sum(x == "running" for _, x in s["tools"]), s["citations"], s["memories"], s["warnings"], s["last"])
    return out


def gathered(draw, n=150):
    rows = []
    for seq in range(n):
        kind = draw.choice([T.SEARCHED, T.SEARCHED, T.RECALLED, T.RESOLVED, T.AVAILABLE, "other"])
        ids = draw.sample(range(6), draw.randrange(3)) if kind in (T.SEARCHED, T.RECALLED) else [draw.randrange(6)]
        rows.append((seq % 12, seq, kind, None, ids, draw.sample(["x", "y", "z"], draw.randrange(3))))
    return rows + [(20, n, T.RESOLVED, None, [5], None), (20, n + 1, T.SEARCHED, None, [], None), (21, n + 2, T.RESOLVED, None, [5], None), (21, n + 3, T.SEARCHED, None, [4], None), (21, n + 4, T.RESOLVED, None, [], None)]


def plain_gather(rows):
    unique = lambda have, more: have + [x for i, x in enumerate(more or []) if x not in have and x not in (more or [])[:i]]
    out = {}
    for run in {r[0] for r in rows}:
        c, e, w, p, s, pin, empty = [], [], [], [], [], None, False
        for _, _, kind, _, ids, texts in sorted((r for r in rows if r[0] == run), key=lambda r: r[1]):
            if kind == T.SEARCHED:
                c = c + ids
                pin = None if c and pin not in c else pin
            if kind == T.RECALLED:
                e = e + ids
            if kind in (T.SEARCHED, T.RECALLED):
                w, empty = unique(w, texts), empty or not ids
            if kind == T.RESOLVED and ids:
                pin = ids[0]
            if kind == T.AVAILABLE:
                p, s = unique(p, ids), unique(s, texts)
        out[run] = (c, e, w, p, s, pin, empty)
    return out


def plain_row(row):
    return tuple([tuple(y) if isinstance(y, tuple) else y for y in x] if isinstance(x, list) else x for x in row[1:])


def test_batch_twins_against_loops(spark):
    draw = random.Random(4)
    for _ in range(2):
        rows = shown(draw)
        got = {r["run_id"]: plain_row(r) for r in T.reduced_turns(spark.createDataFrame(rows, T.EVENTS)).collect()}
        assert got == plain_reduce(rows)
        rows = gathered(draw)
        got = {r["run_id"]: plain_row(r) for r in T.gathered_turns(spark.createDataFrame(rows, T.EVENTS)).collect()}
        assert got == plain_gather(rows) and got[20][5] == 5 and got[21][5] is None
    assert T.reduced_turns(spark.createDataFrame([], T.EVENTS)).count() == 0 and T.gathered_turns(spark.createDataFrame([], T.EVENTS)).count() == 0


def files(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def collected(folder):
    """A sink that keeps the rows of each batch under its number, so a batch that is run again replaces itself."""

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    return sink


def drive(spark, folder, rows, schema, cuts, of, mode):
    """All rows through a stream, a part at a time, with a stop and a restart between parts."""
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        files(spark, folder, rows[a:b], schema)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        of(stream).writeStream.foreachBatch(collected(folder)).outputMode(mode).option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@pytest.mark.parametrize("cuts", [[], [90, 91, 200]])
def test_turns_as_streams(spark, tmp_path, cuts):
    for name, make, plain, of in (("r", shown, plain_reduce, stateful.reduced_turn_stream), ("g", gathered, plain_gather, stateful.gathered_turn_stream)):
        rows = make(random.Random(11))
        out = drive(spark, tmp_path / name, rows, T.EVENTS, [c for c in cuts if c < len(rows)], of, "update")
        last = out.join(out.groupBy("run_id").agg(F.max("batch").alias("batch")), ["run_id", "batch"]).drop("batch")
        assert {r["run_id"]: plain_row(r) for r in last.collect()} == plain(rows)


HOLDS = "slot_id long, request_id long, at timestamp, kind string, size long"


def requests(draw, n=120):
    at, rows = datetime(2024, 1, 1), []
    for i in range(n):
        at += timedelta(seconds=draw.randrange(1, 90))
        kind = draw.choice(["hold", "hold", "hold", "confirm", "cancel"])
        rows.append((i % 3, i if kind == "hold" else max(0, i - 3 * draw.randrange(1, 5)), at, kind, draw.randrange(1, 4) if kind == "hold" else None))
    return rows


def plain_holds(rows, capacity, end):
    """A clock: at each request, and at the end, what has run out gives its seats back."""
    out = []
    for slot in {r[0] for r in rows}:
        booked, held, kept = 0, {}, {}

        def expire(now, slot=slot, held=held):
            nonlocal booked
            for until, request, size in sorted((u, q, s) for q, (s, u) in held.items() if u < now):
                del held[request]
                booked -= size
                out.append((slot, request, until, "expired", booked))

        for _, request, at, kind, size in sorted((r for r in rows if r[0] == slot), key=lambda r: (r[2], r[1])):
            expire(at)
            what = "ignored"
            if kind == "hold" and request not in held and request not in kept:
                what = "granted" if booked + size <= capacity else "refused"
                if what == "granted":
                    booked, held[request] = booked + size, (size, at + timedelta(minutes=10))
            elif kind == "confirm" and request in held:
                what, kept[request] = "confirmed", held.pop(request)[0]
            elif kind == "cancel" and request in held:
                what, booked = "released", booked - held.pop(request)[0]
            elif kind == "cancel" and request in kept:
                what, booked = "released", booked - kept.pop(request)
            out.append((slot, request, at, what, booked))
        expire(end)
    return sorted(out)


@pytest.mark.parametrize("cuts", [[], [30, 31, 80]])
def test_holds_expire_by_the_clock(spark, tmp_path, cuts):
    rows = requests(random.Random(2))
    rows.append((9, 999, rows[-1][2] + timedelta(hours=2), "hold", 1))  # only moves event time on: the other slots get no further request
    out = drive(spark, tmp_path, rows, HOLDS, cuts, lambda s: stateful.expiring_holds(s, 8), "append")
    got = sorted((r["slot_id"], r["request_id"], r["at"], r["outcome"], r["booked"]) for r in out.collect())
    assert got == plain_holds(rows, 8, rows[-1][2])
    assert {g[3] for g in got} == {"granted", "refused", "confirmed", "released", "expired", "ignored"}


CONFIRMS = "thread long, event_id long, at timestamp, kind string, key string, arguments string"


@pytest.mark.parametrize("cuts", [[], [50, 51, 120]])
def test_a_replay_gives_the_first_result(spark, tmp_path, cuts):
    draw, rows = random.Random(6), []
    for i in range(160):
        kind, key = draw.choice(["propose", "confirm", "confirm", "cancel"]), f"k{draw.randrange(3)}"
        rows.append((i % 4, i, datetime(2024, 1, 1) + timedelta(minutes=i), kind, key if kind == "propose" else None, f"args {i}" if kind == "propose" else None))
    want, open_, done = [], {}, {}
    for thread, i, _, kind, key, arguments in rows:
        if kind == "propose":
            open_[thread] = (key, arguments)
        elif kind == "cancel":
            open_.pop(thread, None)
        elif thread not in open_:
            want.append((thread, i, "refused", None, None))
        else:
            key, arguments = open_[thread]
            effect = "replayed" if (thread, key) in done else "executed"
            want.append((thread, i, effect, *done.setdefault((thread, key), (arguments, f"done-{i}"))))
    table = spark.createDataFrame(rows, CONFIRMS)
    assert sorted(map(tuple, T.confirmed_results(table).collect())) == sorted(want)
    out = drive(spark, tmp_path, rows, CONFIRMS, cuts, stateful.confirmation_stream, "append")
    got = [(r["thread"], r["event_id"], r["effect"], r["arguments"], r["result"]) for r in out.collect()]
    assert sorted(got) == sorted(want) and {g[2] for g in got} == {"executed", "replayed", "refused"}


def test_results_and_runs_are_forgotten(spark, tmp_path):
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    rows = [(1, 1, at(0), "propose", "k", "a"), (1, 2, at(1), "confirm", None, None), (1, 3, at(9), "confirm", None, None), (1, 4, at(30), "confirm", None, None), (2, 5, at(99), "confirm", None, None)]
    out = drive(spark, tmp_path / "c", rows, CONFIRMS, [2, 3], lambda s: stateful.confirmation_stream(s, keep=timedelta(minutes=10)), "append")
    assert sorted((r["event_id"], r["effect"], r["result"]) for r in out.collect()) == [(2, "executed", "done-2"), (3, "replayed", "done-2"), (4, "executed", "done-4"), (5, "refused", None)]
    said = [(1, 1, T.DELTA, "a", None, None, at(0)), (2, 2, T.DELTA, "x", None, None, at(60)), (1, 3, T.DELTA, "b", None, None, at(61))]
    out = drive(spark, tmp_path / "t", said, T.EVENTS + ", at timestamp", [1, 2], lambda s: stateful.reduced_turn_stream(s, timedelta(minutes=10)), "update")
    assert sorted((r["last_seq"], r["text"]) for r in out.collect()) == [(1, "a"), (2, "x"), (3, "b")]

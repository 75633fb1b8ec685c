"""The stream gives what its batch twin gives."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from parley.streaming.spans import TurnCalls, read_payload_stream, stream_tool_calls
from parley.streaming.turns import EVENTS, FATES, collect_batch, collect_stream


def span(c, t, name):
    attributes = [{"key": "eval.conversation_id", "value": {"stringValue": c}}, {"key": "eval.turn_id", "value": {"intValue": str(t)}}]
    return json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [{"name": f"execute_tool {name}", "spanId": name, "attributes": attributes}]}]}]})


def test_stateless_stream_equals_batch(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.json").write_text(span(f"c{i % 2}", i, f"n{i}") if i != 3 else "broken")
    q = stream_tool_calls(read_payload_stream(spark, str(tmp_path), maxFilesPerTrigger=2)).writeStream.format("memory").queryName("calls").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = stream_tool_calls(spark.read.text(str(tmp_path), wholetext=True).select(F.col("value").alias("payload")))
    columns = ["conversation_id", "turn_id", "name"]
    assert sorted(map(tuple, spark.table("calls").select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))
    assert spark.table("calls").count() == 4


CALLS, ENDS = "conversation_id string, turn_id int, id string, arrival long", "conversation_id string, turn_id int, waited_from long, signalled boolean"


def fates(spark, calls, ends, **times):
    took, rest = collect_batch(spark.createDataFrame(calls, CALLS), spark.createDataFrame(ends, ENDS), **({"wait": 5000, "settle": 100} | times))
    return {r["id"]: "turn" for r in took.collect()} | {r["id"]: r["fate"] for r in rest.collect()}


def test_batch_windows(spark):
    calls = [("c", 0, "a", 0), ("c", 0, "b", 1050), ("c", 0, "l", 1200), ("c", 1, "x", 3000), ("c", 1, "y", 3080), ("c", 1, "z", 3200), ("c", 2, "n", 9000), ("c", 3, "o", 500), ("c", 7, "s", 99)]
    ends = [("c", 0, 1000, True), ("c", 1, 2000, False), ("c", 2, 3000, False), ("c", 4, 9000, True)]
    assert fates(spark, calls, ends) == {"a": "turn", "b": "turn", "l": "late", "x": "turn", "y": "turn", "z": "late", "n": "late", "o": "purged", "s": "stale"}


def test_a_drained_turn_purges_earlier_ones(spark):
    # turn 1 is drained at 100, turn 0 waited for from 5000: what it had is gone, so it waits anew
    calls = [("c", 0, "gone", 50), ("c", 0, "new", 7000), ("c", 1, "own", 40), ("d", 0, "kept", 50)]
    ends = [("c", 0, 5000, False), ("c", 1, 0, True), ("d", 0, 5000, False)]
    assert fates(spark, calls, [*ends[:1], ("c", 1, 100, True), ends[2]]) == {"gone": "purged", "new": "turn", "own": "turn", "kept": "turn"}
    # a waiter that has seen a call settles even if the call is purged meanwhile
    calls = [("c", 0, "seen", 1000), ("c", 0, "after", 1090), ("c", 0, "too late", 1150), ("c", 1, "x", 900)]
    assert fates(spark, calls, [("c", 0, 900, False), ("c", 1, 950, True)]) == {"seen": "purged", "after": "turn", "too late": "late", "x": "turn"}


def by_time(calls, ends, wait=5000, settle=100):
    """The fates by walking through time, millisecond by millisecond."""
    out, buffer, waiting, closed = {}, {}, {}, set()
    for now in range(0, 12_000):
        for c, t, i, a in calls:
            if a == now:
                if (c, t) in closed:
                    out[i] = "late"
                else:
                    buffer.setdefault((c, t), []).append(i)
                    if (c, t) in waiting and waiting[c, t][1] is None:
                        waiting[c, t] = (waiting[c, t][0], now + settle)
        for c, t, w, s in ends:
            if w == now:
                waiting[c, t] = (now + wait, now if s and (c, t) not in buffer else now + settle if (c, t) in buffer else None)
        for c, t in sorted(waiting):
            if now == (waiting[c, t][1] if waiting[c, t][1] is not None else waiting[c, t][0]):
                out |= dict.fromkeys(buffer.pop((c, t), []), "turn")
                del waiting[c, t]
                closed.add((c, t))
                for k in [k for k in buffer if k[0] == c and k[1] < t]:
                    out |= dict.fromkeys(buffer.pop(k), "purged")
    return out | {i: "stale" for ids in buffer.values() for i in ids}


def random_events(seed, n=60):
    rng = random.Random(seed)
    calls = [(f"c{rng.randrange(4)}", rng.randrange(6), f"i{j}", rng.randrange(0, 3000, 10)) for j in range(n)]
    ends = [(f"c{c}", t, rng.randrange(5, 3000, 10), rng.random() < 0.5) for c in range(4) for t in range(6) if rng.random() < 0.8]
    return calls, ends


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_equals_a_walk_through_time(spark, seed):
    calls, ends = random_events(seed)
    assert fates(spark, calls, ends) == by_time(calls, ends)


def test_empty_and_null(spark):
    assert fates(spark, [], []) == {} and fates(spark, [("c", 0, "a", 1)], []) == {"a": "stale"} and fates(spark, [], [("c", 0, 5, True)]) == {}


def stream_fates(spark, tmp_path, batches, delay="1 second", **options):
    """Fates of events in files, read one by one, and how often each turn was given."""
    src = tmp_path / "in"
    src.mkdir()
    for i, rows in enumerate(batches):
        (src / f"{i:03d}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(src / f"{i:03d}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(src))
    q = collect_stream(stream, delay, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    rows = spark.read.schema(FATES).parquet(str(tmp_path / "out")).where("conversation_id <> 'clock'").collect()
    return rows


def events_of(calls, ends):
    rows = [{"conversation_id": c, "turn_id": t, "kind": "call", "payload": i, "at": a} for c, t, i, a in calls]
    return rows + [{"conversation_id": c, "turn_id": t, "kind": "end", "signalled": s, "at": w} for c, t, w, s in ends]


CLOCK = {"conversation_id": "clock", "turn_id": 0, "kind": "tick", "at": 90_000_000}


def test_stream_out_of_order_equals_batch(spark, tmp_path):
    calls, ends = random_events(5)
    rows = events_of(calls, ends)
    rng = random.Random(6)
    rows.sort(key=lambda r: r["at"] + rng.randrange(900))
    got = stream_fates(spark, tmp_path, [rows[i : i + 20] for i in range(0, len(rows), 20)] + [[CLOCK], [CLOCK]])
    assert {i: r["fate"] for r in got for i in r["calls"]} == by_time(calls, ends)
    given = [(r["conversation_id"], r["turn_id"]) for r in got if r["fate"] == "turn"]
    assert sorted(given) == sorted((c, t) for c, t, _, _ in ends)


def test_stream_repeats_late_rows_and_expiry(spark, tmp_path):
    end = {"conversation_id": "c", "turn_id": 0, "kind": "end", "signalled": True, "at": 1000}
    call = lambda t, i, at: {"conversation_id": "c", "turn_id": t, "kind": "call", "payload": i, "at": at}
    batches = [[call(0, "a", 990), end, end], [{**CLOCK, "at": 20_000}], [call(0, "very late", 995), end, call(5, "never", 20_500)], [{**CLOCK, "at": 10_000_000}], [{**CLOCK, "at": 10_000_000}], [call(0, "after all", 10_000_001)], [{**CLOCK, "at": 90_000_000}], [CLOCK]]
    got = stream_fates(spark, tmp_path, batches)
    assert [(r["fate"], r["at"], r["calls"]) for r in got if r["fate"] == "turn"] == [("turn", 1100, ["a"])]
    assert {i: r["fate"] for r in got if r["fate"] != "turn" for i in r["calls"]} == {"very late": "late", "never": "stale", "after all": "stale"}


def test_calls_accumulate_over_batches_and_replays_change_nothing(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, (c, t, n) in enumerate([("c", 0, "a"), ("c", 0, "b"), ("d", 1, "x"), ("c", 0, "a"), ("c", 1, "z")]):
        (src / f"{i}.json").write_text(span(c, t, n))
        os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    table = TurnCalls(spark, f"file://{tmp_path}/table", buckets=4)
    payloads = read_payload_stream(spark, str(src), maxFilesPerTrigger=2)
    table.run(payloads, str(tmp_path / "ck")).awaitTermination(300)
    rows = lambda: {(r["conversation_id"], r["turn_id"]): [c["name"] for c in r["calls"]] for r in table.read().collect()}
    want = {("c", 0): ["a", "b", "a"], ("d", 1): ["x"], ("c", 1): ["z"]}
    assert rows() == want
    commits = table.table.state()["number"]
    # the same batches again, by a query that has lost its checkpoint, and by hand
    table.run(payloads, str(tmp_path / "ck2")).awaitTermination(300)
    table.upsert(stream_tool_calls(spark.createDataFrame([(span("c", 0, "again"), "p")], "payload string, payload_id string")), 1)
    assert rows() == want and table.table.state()["number"] == commits
    table.upsert(stream_tool_calls(spark.createDataFrame([(span("d", 1, "y"), "p")], "payload string, payload_id string")), 9)
    assert rows() == want | {("d", 1): ["x", "y"]}


def test_state_is_read_once_for_a_key():
    from types import SimpleNamespace

    import pandas as pd

    from parley.streaming.turns import TurnCollector

    asked = []

    class State:
        def __init__(self):
            self.rows, self.value = {}, None

        def __getattribute__(self, name):
            if name not in ("rows", "value", "__class__"):
                asked.append(name)
            return object.__getattribute__(self, name)

        get = lambda self: iter(()) if self.value is None else self.value
        iterator = lambda self: iter(list(self.rows.items()))
        containsKey = lambda self, k: k in self.rows
        updateValue = lambda self, k, v: self.rows.update({k: v})
        exists = lambda self: False
        appendValue = appendList = put = update = lambda self, v: None

    collector = TurnCollector(5000, 100)
    state = lambda *_: State()
    collector.init(SimpleNamespace(getListState=state, getMapState=state, getValueState=state, registerTimer=lambda t: None))
    collector.last.get = lambda: None
    rows = pd.DataFrame([(0, "call", f"p{i}", None, 10 + i) for i in range(200)], columns=["turn_id", "kind", "payload", "signalled", "at"])
    asked.clear()
    assert sum(len(x) for x in collector.handleInputRows(("c",), iter([rows]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))) == 0
    assert len(asked) <= 10

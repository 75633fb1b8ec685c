"""Which calls a turn gets, when spans arrive in any order: an event-time stream, and the same over whole tables.

Times are whole milliseconds. A turn is waited for from some moment on. If it
was signalled complete before, it closes at once, or settle later if a call was
there; else settle after its first call, or after wait without one. When a turn
closes it gets its calls so far, and calls of earlier turns that are held are
purged. Calls after their turn's end are late; calls of turns that nobody waits
for are purged, or stale in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from parley.constants import SETTLE_SECONDS, WAIT_SECONDS
from parley.functions.tables import fresh_path, materialize, remove
from parley.operators.turns import conversation_keys

WAIT_MS, SETTLE_MS = int(1000 * WAIT_SECONDS), int(1000 * SETTLE_SECONDS)
#: A conversation without events for so long is forgotten, and so is a closed turn.
EXPIRE_MS = 3_600_000
EVENTS = "conversation_id string, turn_id int, kind string, payload string, signalled boolean, at long"
FATES = "conversation_id string, turn_id int, fate string, at long, calls array<string>"


def close_time(waited_from: int, signalled: bool, arrivals: list[int], wait: int = WAIT_MS, settle: int = SETTLE_MS) -> int:
    if signalled:
        return waited_from + (settle if any(a <= waited_from for a in arrivals) else 0)
    first = min((a for a in arrivals if a <= waited_from + wait), default=None)
    return waited_from + wait if first is None else max(first, waited_from) + settle


class TurnCollector(StatefulProcessor):
    """Holds a conversation's calls and awaited turns until the watermark passes a turn's end.

    Rows are events (EVENTS): kind is call, with a payload, or end, with signalled; at is a
    call's arrival or the moment from which a turn is waited for. Turns close
    in the order of their ends, each once; a repeated end changes nothing.
    Events that come after the watermark passed them are late themselves.
    """

    def __init__(self, wait: int = WAIT_MS, settle: int = SETTLE_MS, expire: int = EXPIRE_MS):
        self.wait, self.settle, self.expire = wait, settle, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getListState("calls", "turn_id int, at long, payload string")
        self.pending = handle.getMapState("pending", "turn_id int", "waited_from long, signalled boolean, closes long")
        self.closed = handle.getMapState("closed", "turn_id int", "at long")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()  # 0 before there is one
        out: list[tuple] = []
        # each access to the state is a message to the JVM, so a key's state is read once
        last = self._last()
        closed, pending, held = self._closed(), self._pending(), self._held()
        was, begun = len(held), set()
        for pdf in rows:
            for turn, kind, payload, signalled, at in zip(*(pdf[c] for c in ("turn_id", "kind", "payload", "signalled", "at"))):
                turn, at = int(turn), int(at)
                last = max(last, at)
                if kind == "call":
                    if at <= mark > 0 or turn in closed:
                        out.append((turn, "late", at, [payload]))
                    else:
                        held.append((turn, at, payload))
                elif kind == "end" and turn not in closed and turn not in pending:
                    pending[turn] = (at, bool(signalled), None)
                    begun.add(turn)
        self.last.update((last,))
        out += self._advance(mark, last, closed, pending, held, was, begun)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        yield self._rows(key, self._advance(timerValues.getCurrentWatermarkInMs(), self._last(), self._closed(), self._pending(), held, len(held), set()))

    def _last(self) -> int:
        return int(found[0]) if (found := self.last.get()) is not None else 0

    def _closed(self) -> dict[int, int]:
        return {int(t): int(a) for (t,), (a,) in self.closed.iterator()}

    def _pending(self) -> dict[int, tuple]:
        return {int(t): (int(w), bool(s), None if c is None else int(c)) for (t,), (w, s, c) in self.pending.iterator()}

    def _held(self) -> list[tuple]:
        return [(int(t), int(a), p) for t, a, p in self.calls.get()]

    def _rows(self, key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *x) for x in out], columns=["conversation_id", "turn_id", "fate", "at", "calls"])

    def _advance(self, mark: int, last: int, closed: dict[int, int], pending: dict[int, tuple], held: list[tuple], was: int, begun: set[int]) -> list[tuple]:
        """Closes what ends up to the watermark, the earliest first, sets the timer for the next end, and writes what changed: was is how many calls the state holds, begun has the awaited turns that it doesn't have yet."""
        out, had, changed, grown = [], set(pending) - begun, set(begun), held[was:]
        whole = False  # calls that the state holds are gone
        while pending:
            ends = {t: c if c is not None else close_time(w, s, [a for u, a, _ in held if u == t], self.wait, self.settle) for t, (w, s, c) in pending.items()}
            turn = min(ends, key=lambda t: (ends[t], t))
            end = ends[turn]
            if end > mark:
                self.handle.registerTimer(end)
                break
            out.append((turn, "turn", end, [p for _, p in sorted((a, p) for t, a, p in held if t == turn and a <= end)]))
            out += [(t, "late", a, [p]) for t, a, p in held if t == turn and a > end]
            purged = [(t, a, p) for t, a, p in held if t < turn and a <= end]
            out += [(t, "purged", a, [p]) for t, a, p in purged]
            for t in {t for t, _, _ in purged} & set(pending):
                w, s, c = pending[t]
                if w <= end:  # its waiter has seen the calls that are lost now
                    pending[t] = (w, s, ends[t])
                    changed.add(t)
            gone = set(purged)
            kept = [x for x in held if x[0] != turn and x not in gone]
            whole, held = whole or len(kept) != len(held), kept
            del pending[turn]
            closed[turn] = end
            self.closed.updateValue((turn,), (end,))
        if not pending and last + self.expire <= mark:
            out += [(t, "stale", a, [p]) for t, a, p in held]
            for state in (self.calls, self.closed, self.last, self.pending):
                state.clear()
            return out
        for t, at in closed.items():
            if at + self.expire <= mark:
                self.closed.removeKey((t,))
        if not pending:
            self.handle.registerTimer(last + self.expire)
        for t in had - set(pending):
            self.pending.removeKey((t,))
        for t in changed & set(pending):
            self.pending.updateValue((t,), pending[t])
        if whole:
            self.calls.put(held) if held else self.calls.clear()
        elif grown:
            self.calls.appendList(grown)
        return out

    def close(self) -> None:
        pass


def collect_stream(events: DataFrame, delay: str = "10 seconds", wait: int = WAIT_MS, settle: int = SETTLE_MS, expire: int = EXPIRE_MS) -> DataFrame:
    """(conversation_id, turn_id, fate, at, calls) of a stream of events (EVENTS) that come up to delay out of order.

    fate turn: the calls that a turn got by its end at. late, purged, stale: a
    call that none got. Rows older than the watermark are not filtered away
    but come out as late. Needs the RocksDB state store.
    """
    clocked = events.withColumn("clock", F.timestamp_millis("at")).withWatermark("clock", delay).drop("clock")
    return clocked.groupBy("conversation_id").transformWithStateInPandas(TurnCollector(wait, settle, expire), outputStructType=FATES, outputMode="append", timeMode="eventTime")


def run_stream(fates: DataFrame, out: str) -> None:
    """Runs a stream of fates over all that is there now, into Parquet files below out, with the state store that it needs."""
    spark = fates.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    try:
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        fates.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, was) if was is not None else spark.conf.unset(name)


def _closes(ends: DataFrame, calls: DataFrame, keys: list[str], wait, settle) -> DataFrame:
    """ends (keys, turn_id, waited_from, signalled, gone) with closed; calls up to gone were purged before the wait began."""
    turn = [*keys, "turn_id"]
    live = calls.select(*turn, "arrival").join(ends.select(*turn, "waited_from", "gone"), turn).where("gone is null or arrival > gone")
    seen = live.groupBy(*turn).agg(F.max(F.col("arrival") <= F.col("waited_from")).alias("early"), F.min(F.when(F.col("arrival") <= F.col("waited_from") + wait, F.col("arrival"))).alias("first"))
    w = F.col("waited_from")
    closed = F.when(F.col("signalled"), F.when(F.coalesce("early", F.lit(False)), w + settle).otherwise(w)).otherwise(F.when(F.col("first").isNull(), w + wait).otherwise(F.greatest("first", w) + settle))
    return ends.join(seen, turn, "left").select(*ends.columns, closed.alias("closed"))


def collect_batch(calls: DataFrame, turn_ends: DataFrame, wait=WAIT_SECONDS, settle=SETTLE_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(collected, rest) of calls (keys, turn_id, arrival, ...) and one row for each awaited turn (keys, turn_id, waited_from, signalled); rest has a column fate: late, purged or stale.

    What closes in the order of its turns takes one pass. Turns that close after
    a later one lose calls to it, which may move their end, so these are
    compared with the later turns of their conversation until no end moves.
    All times are in the unit of wait and settle.
    """
    spark = calls.sparkSession
    keys = conversation_keys(calls)
    turn = [*keys, "turn_id"]
    higher = Window.partitionBy(*keys).orderBy(F.desc("turn_id")).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(None).cast(calls.schema["arrival"].dataType)
    base = materialize(turn_ends.select(*turn, "waited_from", "signalled"), "ends")
    ends = materialize(_closes(base.withColumn("gone", none), calls, keys, wait, settle).withColumn("lost", none), "ends")
    while True:
        odd = ends.withColumn("least", F.min("closed").over(higher)).where("least < closed").drop("least", "gone", "lost")
        others = ends.select(*keys, F.col("turn_id").alias("_turn"), F.col("closed").alias("_closed"))
        before = odd.join(others, keys).where("_turn > turn_id and _closed < closed")
        lost = before.groupBy(*turn).agg(F.max("_closed").alias("lost"), F.max(F.when(F.col("_closed") < F.col("waited_from"), F.col("_closed"))).alias("gone"))
        new = _closes(base.join(lost, turn, "left"), calls, keys, wait, settle)
        step = materialize(new.join(ends.select(*turn, F.col("closed").alias("was")), turn), "ends")
        moved = step.where("closed <> was").limit(1).count()
        remove(spark, ends)
        ends = step.drop("was")
        if not moved:
            break
    after = F.max("closed").over(higher)
    turns = calls.select(*turn).union(ends.select(*turn)).distinct().join(ends.select(*turn, "closed", "lost"), turn, "left").withColumn("after", after)
    judged = calls.join(turns, turn)
    a = F.col("arrival")
    fate = F.when(a > F.col("closed"), "late").when(a <= F.col("lost"), "purged").when(F.col("closed").isNotNull(), "turn").when(a <= F.col("after"), "purged").otherwise("stale")
    judged = materialize(judged.select(*calls.columns, fate.alias("fate")), "fates")
    return judged.where("fate = 'turn'").drop("fate"), judged.where("fate <> 'turn'")

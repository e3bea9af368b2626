"""Releases, ledgers and monitors on streams. The Column expressions are those of batch: keyed noise needs no state."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import mechanisms as N
from ..functions.dialect import SPARK


def released_events(events: DataFrame, eps: float, lo: float, hi: float, cached: bool = False) -> DataFrame:
    """events (event_id, ts, user_id, value) with the noised grid index and value; batch or stream.

    cached: one draw per user and value, replayed; else one per event.
    """
    key = ("user_id", "value") if cached else ("event_id",)
    t = N.grid_position(SPARK, N.clip("value", SPARK.num(lo), SPARK.num(hi)), SPARK.num(lo), SPARK.num(hi))
    index = N.noise_index(SPARK, "exp", t, SPARK.num(eps), "'events'", *key)
    return events.withColumn("idx", F.expr(index)).withColumn("released", F.expr(N.value_of(SPARK, "idx", SPARK.num(lo), SPARK.num(hi))))


def spend_within(events: DataFrame, limit: float, watermark: str = "1 day") -> DataFrame:
    """(user_id, event_id, eps, spent, allowed) of a stream of events (user_id, event_id, ts, eps), replays left out.

    A user's events are charged in order of time within a batch; one that would go beyond the limit is refused and
    costs nothing. State: a sum per user.
    """

    def charge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event, eps in zip(rows["event_id"], rows["eps"], strict=True):
            ok = round(spent + eps, 9) <= limit
            spent += eps if ok else 0.0
            out.append((key[0], event, eps, spent, ok))
        state.update((spent,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "eps", "spent", "allowed"])

    once = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("user_id").applyInPandasWithState(charge, "user_id long, event_id long, eps double, spent double, allowed boolean", "spent double", "append", GroupStateTimeout.NoTimeout)


class _Ledger(StatefulProcessor):
    """A user's ledger: (spent, time of the last charge) and the events that wait for the watermark."""

    def __init__(self, limit: float, idle: int | None) -> None:
        self.limit, self.idle = limit, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "spent double, last long")
        self.waiting = handle.getListState("waiting", "at long, event_id long, eps double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for batch in rows:
            own = [(int(a), int(e), float(c)) for a, e, c in zip(batch["at"], batch["event_id"], batch["eps"], strict=True)]
            self.waiting.appendList(own)
            first = min(a for a, _, _ in own)
            least = first if least is None else min(least, first)
        if least is not None:
            self.handle.registerTimer(-(-least // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted(w for w in map(tuple, waiting) if w[0] <= passed)
        rest = [tuple(w) for w in waiting if w[0] > passed]
        spent, last = self.spent.get() if self.spent.exists() else (0.0, None)
        out = []
        for at, event, eps in due:
            if self.idle is not None and last is not None and at - last > self.idle:
                spent = 0.0
            ok = round(spent + eps, 9) <= self.limit
            spent, last = spent + (eps if ok else 0.0), at
            out.append((key[0], event, at, eps, spent, ok))
        if due:
            self.spent.update((spent, last))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if rest:
            self.handle.registerTimer(-(-min(w[0] for w in rest) // 1000))
        elif self.idle is not None and last is not None:
            if passed > last + self.idle:
                self.spent.clear()
            else:
                self.handle.registerTimer((last + self.idle) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_id", "at", "eps", "spent", "allowed"])

    def close(self) -> None:
        pass


def charged_in_order(events: DataFrame, limit: float, watermark: str = "1 day", idle_seconds: float | None = None) -> DataFrame:
    """(user_id, event_id, ts, eps, spent, allowed) of a stream of events (user_id, event_id, ts, eps), in order of event time.

    An event waits until the watermark has passed it, so that one that comes later, in another batch, but happened
    before is charged first; ties go by event_id. One that would go beyond the limit is refused and costs nothing.
    Replays of an event are left out. A user without events for more than idle_seconds starts anew with nothing spent,
    and the user's state goes when the watermark has passed that time (None: never). Events behind the watermark are
    left out and counted (late_events). Events without user, id, time or budget are left out.

    State: per user two numbers and the events of the watermark's time. Needs the RocksDB state store (ledger_session).
    """
    once = events.where("user_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL AND eps IS NOT NULL").withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    rows = once.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("at"), "eps")
    idle = None if idle_seconds is None else int(idle_seconds * 1_000_000)
    schema = "user_id long, event_id long, at long, eps double, spent double, allowed boolean"
    charged = rows.groupBy("user_id").transformWithStateInPandas(_Ledger(limit, idle), schema, "append", "eventtime")
    return charged.select("user_id", "event_id", F.timestamp_micros("at").alias("ts"), "eps", "spent", "allowed")


def ledger_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB; the given one's settings stay."""
    own = spark.newSession()
    for key in ("spark.checkpoint.dir", "spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        if (value := spark.conf.get(key, None)) is not None and value != own.conf.get(key, None):
            own.conf.set(key, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def late_events(progress: Iterable) -> int:
    """How many events a query left out as late, from its progress reports (recentProgress)."""
    return sum(o["numRowsDroppedByWatermark"] for p in progress for o in (p if isinstance(p, dict) else json.loads(p.json))["stateOperators"])


def utility_windows(released: DataFrame, width: str = "1 day", watermark: str | None = None) -> DataFrame:
    """(start, n, wmape) per time window."""
    rows = released.withWatermark("ts", watermark) if watermark else released
    w = rows.groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.try_divide(100 * F.sum(F.abs(F.col("released") - F.col("value"))), F.sum(F.abs("value"))).alias("wmape"))
    return w.select(F.col("w.start").alias("start"), "n", "wmape")

"""Keyed states over streams of events, advanced by event time.

Each state is fed by one row per (entity, closed day): a windowed aggregation merges the events of a day
inside every task before they move, keeps late ones until the watermark has passed their day, and then
emits the day once. The ordered part behind it sees at most one small row per calendar day of an entity.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """The state store that value states and timers need, for the queries started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def closed_days(rows: DataFrame, key: str, time: str, delay: str, **values: Column) -> DataFrame:
    """(k, at, d, values) of each (entity, day) once the watermark has passed the day's end.

    *values* are aggregations; *at* is the last instant of the day and carries the watermark on.
    """
    g = rows.withWatermark(time, delay).groupBy(F.col(key).cast("long").alias("k"), F.window(time, "1 day")).agg(
        *[v.alias(n) for n, v in values.items()])
    return g.select("k", F.window_time("window").alias("at"), F.unix_date(F.to_date("window.start")).cast("long").alias("d"), *values)


class DayState(StatefulProcessor):
    """One value state per key and one timer at the end of its next day.

    A key's days come in order: those of one batch are sorted, and a later batch only has later days. The timer
    fires when the watermark has passed a day that brought no row.
    """

    schema = "day long, value double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days = pd.concat(list(rows)).sort_values("d")
        yield self.advance(key, days["d"].tolist(), days["x"].tolist())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() // DAY_MS - 1
        yield self.advance(key, [closed], [None])

    def advance(self, key, days: list[int], values: list[float | None]) -> pd.DataFrame:
        raise NotImplementedError

    def wait_for(self, day: int) -> None:
        """A timer behind the end of *day*, in place of any other."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((day + 1) * DAY_MS)

    def close(self) -> None:
        pass


class Decay(DayState):
    """s(t) = lam * s(t - 1) + (1 - lam) * drive(t) for every calendar day; the first day has state 0."""

    def __init__(self, lam: float):
        self.lam = lam

    def advance(self, key, days, values):
        last, value = self.state.get() if self.state.exists() else (None, 0.0)
        out = []
        for d, x in zip(days, values):
            if last is None:
                last = d
                out.append((key[0], d, 0.0))
                continue
            while last < d:
                last += 1
                value = value * self.lam + (1 - self.lam) * ((x or 0.0) if last == d else 0.0)
                out.append((key[0], last, value))
        self.state.update((last, value))
        self.wait_for(last + 1)
        return pd.DataFrame(out, columns=["k", "d", "s"]).astype({"k": "int64", "d": "int64", "s": "float64"})


class Decluster(DayState):
    """Keeps a day more than *gap* days after the last kept one; silent days need no timer."""

    schema = "day long"

    def __init__(self, gap: int):
        self.gap = gap

    def advance(self, key, days, values):
        kept = self.state.get()[0] if self.state.exists() else None
        out = []
        for d in days:
            if kept is None or d - kept > self.gap:
                kept = d
                out.append((key[0], d))
        self.state.update((kept,))
        return pd.DataFrame(out, columns=["k", "d"]).astype("int64")


def decayed_state(rows: DataFrame, key: str, time: str, drive: Column, lam: float = 0.95, delay: str = "30 days") -> DataFrame:
    """(key, day, state) of every closed calendar day of each entity from its first event on.

    Drives of one day are summed, late ones wait behind the watermark, silent days decay and are emitted
    as the watermark passes them. A null drive counts as 0. Equals the batch EWMA over the daily spine that ends
    with the last closed day.
    """
    days = closed_days(rows, key, time, delay, x=F.sum(F.coalesce(drive, F.lit(0.0))))
    out = days.groupBy("k").transformWithStateInPandas(Decay(lam), "k long, d long, s double", "append", "eventTime")
    return out.select(F.col("k").alias(key), F.date_from_unix_date(F.col("d").cast("int")).alias("day"), F.col("s").alias("state"))


def declustered_days(rows: DataFrame, key: str, time: str, gap_days: int = 45, delay: str = "30 days") -> DataFrame:
    """(key, day) kept by online greedy declustering over the closed days of each entity.

    Equals the batch form on the events of those days: a late event takes its place in time, because no day
    is decided before it is closed.
    """
    days = closed_days(rows, key, time, delay, x=F.count(F.lit(1)))
    out = days.groupBy("k").transformWithStateInPandas(Decluster(gap_days), "k long, d long", "append", "eventTime")
    return out.select(F.col("k").alias(key), F.date_from_unix_date(F.col("d").cast("int")).alias("day"))

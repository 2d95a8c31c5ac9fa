"""Named variables per key that live across micro-batches, with timers; and the same on bounded tables.

An event assigns a value to one of its key's variables, adds to it, reads it, or
resets all of them. A key that hears nothing for ``idle`` seconds of event time
is reset too: a timer frees its state when the watermark passes, and an event
that comes after such a gap finds nothing of what was before it.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loamgrid.streaming.batch import micros

#: What an event can do; others are left out.
ACTS = ("assign", "add", "read", "reset")
RESULT = "key long, at timestamp, seq long, act string, name string, value double"
#: The setting that keeps state on the executors' disks; states of several variables need it.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Variables(StatefulProcessor):
    """A key's variables (a map) and the time of its last event (a value); one timer, ``idle`` after that."""

    def __init__(self, idle: float):
        self.idle = round(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getMapState("values", "name string", "value double")
        self.last = handle.getValueState("last", "ms long, us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        events = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        held = {k[0]: v[0] for k, v in self.values.iterator()}
        last = self.last.get()[1] if self.last.exists() else None
        before, out = set(held), []
        for at, us, seq, act, name, value in zip(events["at"], events["us"], events["seq"], events["act"], events["name"], events["value"], strict=True):
            if last is not None and us - last > self.idle * 1000:
                held = {}
                out.append((key[0], moment(last + self.idle * 1000), -1, "expired", None, None))
            last = us if last is None else max(last, us)
            number = None if pd.isna(value) else float(value)
            if act == "reset":
                held = {}
            elif act == "assign":
                held[name] = number
            elif act == "add":
                old = held.get(name)
                held[name] = old if number is None else number if old is None else old + number
            else:
                out.append((key[0], at, seq, "read", name, held.get(name)))
        for gone in before - set(held):
            self.values.removeKey((gone,))
        for name, value in held.items():
            self.values.updateValue((name,), (value,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((last // 1000, last))
        self.handle.registerTimer(last // 1000 + self.idle + 1)
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "seq", "act", "name", "value"]).astype({"value": "float64"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        last = self.last.get()[1]
        self.values.clear()
        self.last.clear()
        yield pd.DataFrame([(key[0], moment(last + self.idle * 1000), -1, "expired", None, float("nan"))], columns=["key", "at", "seq", "act", "name", "value"])

    def close(self) -> None:
        pass


def moment(us: int) -> datetime.datetime:
    return datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=us)


def usable(events: DataFrame, key: str, at: str, seq: str, act: str, name: str, value: str) -> DataFrame:
    """The events in one form: those with a key, a time and a known act; a variable without a name is named ''."""
    cast = F.col(value).cast("double")
    rows = events.select(F.col(key).cast("long").alias("key"), F.col(at).alias("at"), F.col(seq).cast("long").alias("seq"), F.col(act).alias("act"), F.coalesce(F.col(name), F.lit("")).alias("name"), F.when(~F.isnan(cast), cast).alias("value"))
    return rows.where(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("act").isin(*ACTS))


def stream_variables(events: DataFrame, idle: float, late: str, key: str = "key", at: str = "at", seq: str = "seq", act: str = "act", name: str = "name", value: str = "value") -> DataFrame:
    """(key, at, seq, act, name, value): what each read finds, null where nothing was assigned, and the moments at which a key expired.

    Events of a key are taken in the order of their time and ``seq`` within a
    micro-batch; those that come behind the watermark, ``late`` behind the latest
    time, are dropped. The session needs PROVIDER.
    """
    rows = usable(events, key, at, seq, act, name, value).withWatermark("at", late).withColumn("us", micros("at"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Variables(idle), outputStructType=RESULT, outputMode="append", timeMode="eventTime")


def batch_variables(events: DataFrame, idle: float, key: str = "key", at: str = "at", seq: str = "seq", act: str = "act", name: str = "name", value: str = "value") -> DataFrame:
    """The rows of :func:`stream_variables` for a bounded table, but for keys that expire after their last event.

    A key's resets and gaps cut its events into lives, and assignments a
    variable's life into runs; a read finds the run's value and what was added.
    """
    rows = usable(events, key, at, seq, act, name, value).withColumn("us", micros("at"))
    order = Window.partitionBy("key").orderBy("at", "seq", "act", "name", "value")
    gap = F.coalesce(F.col("us") - F.lag("us").over(order) > F.lit(round(idle * 1000) * 1000), F.lit(False))
    lived = rows.withColumn("gap", gap).withColumn("before", F.lag("us").over(order)).withColumn("life", F.sum((F.col("gap") | (F.col("act") == "reset")).cast("long")).over(order))
    own = Window.partitionBy("key", "life", "name").orderBy("at", "seq", "act", "value")
    runs = lived.withColumn("run", F.sum((F.col("act") == "assign").cast("long")).over(own))
    within = Window.partitionBy("key", "life", "name", "run").orderBy("at", "seq", "act", "value")
    found = runs.withColumn("now", F.sum(F.when(F.col("act").isin("assign", "add"), F.col("value"))).over(within))
    reads = found.where("act = 'read'").select("key", "at", "seq", F.lit("read").alias("act"), "name", F.col("now").alias("value"))
    ended = lived.where("gap").select("key", F.timestamp_micros(F.col("before") + round(idle * 1000) * 1000).alias("at"), F.lit(-1).cast("long").alias("seq"), F.lit("expired").alias("act"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("value"))
    return reads.unionByName(ended)


class Ticks(StatefulProcessor):
    """A timer that sets itself anew, ``every`` after the moment it was served."""

    def __init__(self, every: float):
        self.every = round(every * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ticks = handle.getValueState("ticks", "n long")
        self.sum = handle.getValueState("sum", "value double, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        total, n = self.sum.get() if self.sum.exists() else (0.0, 0)
        first = None
        for frame in rows:
            total, n = total + float(frame["value"].fillna(0.0).sum()), n + int(frame["value"].notna().sum())
            first = int(frame["ms"].min()) if first is None else min(first, int(frame["ms"].min()))
        self.sum.update((total, n))
        if not self.ticks.exists():
            self.ticks.update((0,))
            self.handle.registerTimer(first + self.every)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        ticks, (total, n) = self.ticks.get()[0] + 1, self.sum.get()
        served = timerValues.getCurrentWatermarkInMs()
        self.ticks.update((ticks,))
        self.sum.update((0.0, 0))
        self.handle.registerTimer(served + self.every)
        yield pd.DataFrame({"key": [key[0]], "tick": [ticks], "due": [moment(expiredTimerInfo.getExpiryTimeInMs() * 1000)], "served": [moment(served * 1000)], "total": [total], "n": [n]})

    def close(self) -> None:
        pass


def periodic(events: DataFrame, every: float, late: str, key: str = "key", at: str = "at", value: str = "value") -> DataFrame:
    """(key, tick, due, served, total, n): every ``every`` seconds of event time, what came since the last tick.

    The delay is counted from when a tick is served, the watermark of a
    micro-batch, not from when it was due, so ticks drift by as much as they are
    late. Needs PROVIDER.
    """
    rows = events.select(F.col(key).cast("long").alias("key"), F.col(at).alias("at"), F.col(value).cast("double").alias("value")).where("key is not null and at is not null")
    rows = rows.withWatermark("at", late).withColumn("ms", F.expr("unix_millis(at)"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Ticks(every), outputStructType="key long, tick long, due timestamp, served timestamp, total double, n long", outputMode="append", timeMode="eventTime")


def needs_provider(spark: SparkSession) -> None:
    """Sets PROVIDER for the queries that the session starts from now on."""
    spark.conf.set(*PROVIDER)

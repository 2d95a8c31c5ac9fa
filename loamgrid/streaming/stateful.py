"""Structured Streaming: the sensor chain, triggers that coalesce or count, running means and windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loamgrid.streaming.batch import sensor_value


def sensor_stream(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """(timestamp, moisture): the simulated sensor as an unbounded source."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select("timestamp", sensor_value(F.col("value")).alias("moisture"))


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder, a bounded number in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def control_chain(readings: DataFrame, dry: int = 30, wet: int = 70) -> DataFrame:
    """Sensor, decision and display as one chain of projections; each row of a micro-batch is one wake-up."""
    decided = readings.withColumn("decision", F.when(F.col("moisture") < dry, "WATER").when(F.col("moisture") > wet, "STOP").otherwise("HOLD"))
    return decided.withColumn("line", F.format_string("moisture=%d decision=%s", F.col("moisture").cast("int"), "decision"))


def windowed_counts(events: DataFrame, ts: str, by: list[str], size: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts in event-time windows; rows later than the watermark are dropped."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def pending_triggers(events: DataFrame, key: str, most: int = 1) -> DataFrame:
    """(key, taken, rejected) per micro-batch: a bounded semaphore with one service between batches.

    Up to ``most`` signals of a key wait for the next batch, further ones are
    rejected. With a large ``most`` no wake-up is lost.
    """

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = state.get[0] if state.exists else 0
        taken = min(waiting, 1)  # the server takes one signal between two batches
        waiting -= taken
        rejected = 0
        for frame in frames:
            room = max(0, most - waiting)
            waiting += min(room, len(frame))
            rejected += max(0, len(frame) - room)
        state.update((waiting,))
        yield pd.DataFrame({"key": [group[0]], "taken": [taken], "rejected": [rejected], "waiting": [waiting]})

    return events.select(F.col(key).alias("key")).groupBy("key").applyInPandasWithState(run, "key long, taken long, rejected long, waiting long", "waiting long", "update", GroupStateTimeout.NoTimeout)


def running_mean(events: DataFrame, key: str, order: str, value: str, keep: float = 0.9) -> DataFrame:
    """(key, ema): the exponential mean after each micro-batch, kept as state."""

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("order")
        for x in rows["value"]:
            mean = x if mean is None else keep * mean + (1 - keep) * x
        state.update((float(mean),))
        yield pd.DataFrame({"key": [group[0]], "ema": [float(mean)]})

    given = events.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(value).cast("double").alias("value"))
    return given.groupBy("key").applyInPandasWithState(run, "key long, ema double", "mean double", "update", GroupStateTimeout.NoTimeout)


def frames_every(events: DataFrame, key: str, order: str, value: str, size: int, every: int) -> DataFrame:
    """(key, frame) for every ``every``-th value of a key: its last ``size`` values, kept as state between batches."""

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, kept = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        out = []
        for x in pd.concat(list(frames)).sort_values("order")["value"]:
            kept, seen = [*kept, float(x)][-size:], seen + 1
            if seen % every == 0:
                out.append(list(kept))
        state.update((seen, kept))
        if out:
            yield pd.DataFrame({"key": [group[0]] * len(out), "frame": out})

    given = events.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(value).cast("double").alias("value"))
    return given.groupBy("key").applyInPandasWithState(run, "key long, frame array<double>", "seen long, kept array<double>", "append", GroupStateTimeout.NoTimeout)

"""Ordered logic on bounded tables, with the same meaning as the streaming operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def ema(events: DataFrame, key: str, order: list[str], value: str, keep: float) -> DataFrame:
    """(key, ema): keep * previous + (1 - keep) * value in order, from the first value on.

    By the closed form: a weighted sum of the values, whose weights depend on
    their rank from the end only; a key's rows need not meet in one row.
    """
    ranked = events.withColumn("_back", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    weight = F.pow(F.lit(keep), F.col("_back")) * F.when(F.col("_back") == F.col("_n") - 1, 1.0).otherwise(1 - keep)
    return ranked.groupBy(key).agg(F.sum(weight * F.col(value)).alias("ema"))


def frame_gaps(events: DataFrame, key: str, ts: str, tie: str, least: float) -> DataFrame:
    """Adds ``dt``: seconds since the key's row before, at least ``least``, which the first row gets too."""
    before = F.lag(micros(ts)).over(Window.partitionBy(key).orderBy(ts, tie))
    return events.withColumn("dt", F.greatest(F.coalesce((micros(ts) - before) / 1e6, F.lit(0.0)), F.lit(least)))


def sliding_frames(events: DataFrame, key: str, order: list[str], value: str, size: int, every: int) -> DataFrame:
    """Every ``every``-th row of a key with ``frame``, its last ``size`` values."""
    ordered = Window.partitionBy(key).orderBy(*order)
    framed = events.withColumn("_r", F.row_number().over(ordered)).withColumn("frame", F.collect_list(value).over(ordered.rowsBetween(1 - size, 0)))
    return framed.where(F.col("_r") % every == 0).drop("_r")


def coalesced(events: DataFrame, key: str, ts: str, tie: str, service_seconds: float) -> DataFrame:
    """(key, served, dropped): a server that takes a fixed time per event and holds one waiting event at most.

    An event that comes while another waits is dropped. The rule is
    sequential; events of a key stream through in order, in bounded batches.
    """
    ordered = events.select(F.col(key).alias("key"), (micros(ts) / 1e6).alias("t"), F.col(tie).alias("tie")).repartition("key").sortWithinPartitions("key", "t", "tie")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, free, waiting, served, dropped = None, 0.0, False, 0, 0

        def row() -> pd.DataFrame:
            return pd.DataFrame({"key": [now], "served": [served], "dropped": [dropped]})

        for pdf in batches:
            for key_, t in zip(pdf["key"], pdf["t"], strict=True):
                if key_ != now:
                    if now is not None:
                        yield row()
                    now, free, waiting, served, dropped = key_, float("-inf"), False, 0, 0
                if waiting and t >= free:
                    free, waiting = free + service_seconds, False
                if t >= free and not waiting:
                    free = t + service_seconds
                    served += 1
                elif not waiting:
                    waiting = True
                    served += 1
                else:
                    dropped += 1
        if now is not None:
            yield row()

    return ordered.mapInPandas(run, "key long, served long, dropped long")


def sensor_value(k: Column) -> Column:
    """The k-th reading (from 0) of the simulated sensor: steps of 5 from 40, modulo 100."""
    return F.pmod(40 + 5 * (k + 1), F.lit(100))

"""Where the threshold of a duplicate belongs: measures of likely copies, of unlike items and of candidates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.operators import fingerprints, hamming, ranking, sampling
from loamgrid.session import durable

#: Items of a block; digits to which measures are told apart, so that a population has a bounded number of values.
BLOCK, DIGITS = 256, 5


def same_key_measures(items: DataFrame, keys: Sequence[str], feature: str = "feature", key: str = "id", block: int | None = None) -> DataFrame:
    """(value, n): how many pairs of items of equal ``keys`` have which correlation of features, of all such pairs.

    Items are dealt into blocks within their key, and two blocks at a time are
    compared; what leaves a task are counts of values, not pairs, once for all of its groups. Items with a
    null among the keys or without feature pair with nothing; with a constant
    feature a measure is 0. Features of a key have one length.
    """
    block = block or BLOCK
    there = items.where(" and ".join(f"{k} is not null" for k in [*keys, feature, key])).select(F.struct(*keys).alias("_key"), F.col(key).alias("_id"), F.col(feature).cast("array<double>").alias("_f"))
    placed = ranking.ranked(there, ["_key"], ["_id"]).where("n > 1").withColumn("_own", F.floor(F.col("rank") / block).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int")))
    dealt = placed.withColumn("_other", other).withColumns({"_p": F.least("_own", "_other"), "_q": F.greatest("_own", "_other")})
    parts = dealt.repartition("_key", "_p", "_q").sortWithinPartitions("_key", "_p", "_q", "rank")
    # a group of two blocks, or of one, begins with the first item of the first one
    rows = parts.select((F.col("rank") == F.col("_p") * block).alias("first"), (F.col("_own") == F.col("_p")).alias("own"), (F.col("_p") == F.col("_q")).alias("one"), "_f")

    def measures(rows: pa.Table) -> Iterator[np.ndarray]:
        lists = rows["_f"].combine_chunks()
        values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.append(0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
        own, one = (rows[c].to_numpy() for c in ("own", "one"))
        begin = np.flatnonzero(rows["first"].to_numpy())
        for s, e in zip(begin.tolist(), [*begin[1:].tolist(), rows.num_rows], strict=True):
            x = values[ends[s] : ends[e]].reshape(e - s, -1)
            x = x - x.mean(axis=1, keepdims=True)
            deviation = np.sqrt((x * x).mean(axis=1, keepdims=True))
            x = x / np.where(deviation < 1e-6, 1.0, deviation) / np.sqrt(x.shape[1])
            r = (x @ x.T)[np.triu_indices(len(x), 1)] if one[s] else (x[own[s:e]] @ x[~own[s:e]].T).ravel()
            # whole numbers from -10 ** DIGITS to 10 ** DIGITS are counted without sorting the pairs
            yield np.rint(r[np.isfinite(r)] * 10**DIGITS).astype(np.int64) + 10**DIGITS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, waiting, n = np.zeros(2 * 10**DIGITS + 3, np.int64), [], [], 0

        def add(rows: pa.Table) -> None:
            nonlocal n
            for level in measures(rows):
                waiting.append(level)
                n += len(level)
                if n > 1_000_000:
                    counts[:] += np.bincount(np.concatenate(waiting), minlength=len(counts))
                    waiting.clear()
                    n = 0

        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.flatnonzero(batch["first"].to_numpy(zero_copy_only=False))
            if len(starts):  # the last group may go on in the next batch
                last = int(starts[-1])
                whole = [*held, batch.slice(0, last)]
                if sum(x.num_rows for x in whole):
                    add(pa.Table.from_batches(whole))
                held = []
                batch = batch.slice(last)
            held.append(batch)
        if held:
            add(pa.Table.from_batches(held))
        if waiting:
            counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
        value = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array((value - 10**DIGITS - 1) / 10**DIGITS), pa.array(counts[value])], ["value", "n"])

    return rows.mapInArrow(run, "value double, n long").groupBy("value").agg(F.sum("n").alias("n"))


def counted(scored: DataFrame, value: str = "r") -> DataFrame:
    """(value, n) of a table of measures."""
    rows = scored.where(F.col(value).isNotNull() & ~F.isnan(value))
    return rows.groupBy((F.round(value, DIGITS) + 0.0).alias("value")).agg(F.count("*").alias("n"))


def summary(populations: dict[str, DataFrame], fractions: Sequence[float]) -> DataFrame:
    """A row for each population of counted measures: n, lo, hi and its quantiles p05, p50, ..., with linear interpolation.

    Exact for the rounded measures; an empty population has n = 0 and nulls. Its
    values are under 10 ** DIGITS in number, so their running sums are a bounded
    window.
    """
    rows = None
    for name, counts in populations.items():
        one = counts.select(F.lit(name).alias("population"), "value", "n")
        rows = one if rows is None else rows.unionByName(one)
    rows = durable(rows)
    upto = Window.partitionBy("population").orderBy("value")
    ends = rows.withColumn("_end", F.sum("n").over(upto))
    totals = rows.groupBy("population").agg(F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    place = lambda f: F.lit(float(f)) * (F.col("t.n") - 1)
    met = ends.alias("e").join(totals.alias("t"), "population")
    at = lambda k: F.max(F.when((F.col("e._end") - F.col("e.n") <= k) & (k < F.col("e._end")), F.col("value")))
    marks = []
    for f in fractions:
        low, high, part = at(F.floor(place(f))), at(F.ceil(place(f))), F.max(place(f) - F.floor(place(f)))
        marks.append((low + (high - low) * part).alias(f"p{round(f * 100):02d}"))
    found = met.groupBy("population").agg(*marks)
    every = rows.sparkSession.createDataFrame([(k, n) for k, n in enumerate(populations)], "_k int, population string")
    out = F.broadcast(every).join(totals, "population", "left").join(found, "population", "left")
    return out.select("population", F.coalesce("n", F.lit(0)).alias("n"), "lo", "hi", *(f"p{round(f * 100):02d}" for f in fractions))


def calibrate_duplicates(
    items: DataFrame, keys: Sequence[str], label: str, hashes: str, feature: str, thresholds: Sequence[float], distance: int = 4, negatives: int = 3000, seed: int = 0, key: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """What is needed to choose the correlation from which candidates count as duplicates.

    Likely copies are all pairs of items of equal ``keys``; unlike items are
    ``negatives`` random pairs of different labels; candidates are all pairs of
    items whose hashes differ in ``distance`` bits or less. Returns (population,
    n, lo, hi, p05, p50, p99) of these three, and for the candidates (threshold,
    kept, crossing): how many pairs each threshold keeps, and how many of them
    are of different labels.
    """
    rows = durable(items.select(F.col(key).alias("id"), *keys, *([label] if label not in keys else []), F.col(hashes).alias("h"), F.col(feature).cast("array<double>").alias("feature")))
    features = rows.select("id", "feature")
    unlike = fingerprints.correlated(durable(sampling.cross_class_pairs(rows.select("id", label), label, negatives, seed)), features, -2.0)
    candidates = durable(fingerprints.near_correlated(rows, distance, -2.0, [label]))
    measured = summary({"same key": same_key_measures(rows, keys), "cross class": counted(unlike), "candidates": counted(candidates)}, [0.05, 0.5, 0.99])
    crossing = candidates.withColumn("crosses", ~F.col(f"{label}_a").eqNullSafe(F.col(f"{label}_b")))
    return measured, hamming.threshold_sweep(crossing, list(thresholds), "r", "crosses")

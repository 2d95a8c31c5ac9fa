"""Groups, label conflicts, site hold-out, leakage-free splits and their checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.operators import ranking
from loamgrid.operators.components import connected_components
from loamgrid.operators.dedupe import first_per_key, majority
from loamgrid.session import durable

SPLITS = ("train", "val", "test")
#: Runs of groups of one size (under 100 bytes each) that are broadcast; more are joined by shuffle.
MOST_RUNS = 100_000


def assign_groups(items: DataFrame, pairs: DataFrame, leaf: list[str], key: str = "id") -> DataFrame:
    """Adds ``group_id``: the least key reachable over equal ``leaf`` columns and ``pairs(a, b)``.

    Items of one leaf are linked through its least key, not with each other.
    """
    heads = items.groupBy(*leaf).agg(F.min(key).alias("head"))
    star = items.join(heads, leaf).select(F.col(key).alias("a"), F.col("head").alias("b"))
    found = connected_components(star.unionByName(pairs.select("a", "b")))
    return items.join(found, F.col(key) == F.col("node"), "left").withColumn("group_id", F.coalesce("component", key)).drop("node", "component")


def flag_conflicts(grouped: DataFrame, label: str, site: str, key: str = "id") -> DataFrame:
    """Rows of groups with several labels whose label isn't the group's winner.

    A label's affinity is the number of rows, over all items, with it and one
    of the group's sites; the greatest wins, ties going to the label seen first.
    """
    several = grouped.groupBy("group_id").agg(F.countDistinct(label).alias("n")).where("n > 1").select("group_id")
    rows = grouped.join(several, "group_id", "left_semi")
    pairs = rows.select("group_id", site).distinct().join(rows.groupBy("group_id", label).agg(F.min(key).alias("first")), "group_id")
    counts = grouped.groupBy(site, label).agg(F.count("*").alias("n"))
    scored = pairs.join(counts, [site, label], "left").groupBy("group_id", label).agg(F.sum(F.coalesce("n", F.lit(0))).alias("affinity"), F.min("first").alias("first"))
    winner = first_per_key(scored, "group_id", [F.desc("affinity"), "first"]).select("group_id", F.col(label).alias("winner"))
    return rows.join(winner, "group_id").where(F.col(label) != F.col("winner")).select(key, "group_id", label, "winner")


def holdout_sites(items: DataFrame, label: str, site: str, least: int, key: str = "id") -> DataFrame:
    """(label, site, n): of each label's sites but its largest, the smallest of at least ``least`` rows."""
    counts = items.groupBy(label, site).agg(F.count("*").alias("n"), F.min(key).alias("first"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(F.desc("n"), "first")))
    return first_per_key(ranked.where(f"rank > 1 and n >= {least}"), label, ["n", "rank"]).select(label, site, "n")


def next_split(have: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """For each row, the split furthest below its target; ties go to the one that has least, then to the first."""
    missing = targets - have
    return np.where(missing == missing.max(axis=1, keepdims=True), have, np.inf).argmin(axis=1)


def after_groups(have: np.ndarray, targets: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each row, what the splits have after ``count`` groups of ``size`` went to one split after the other.

    Filling the splits to a common level tells how many groups each gets, but for
    the last few: as long as a split is more than two groups over the level, its
    turn comes before the count is used up. Only these last ones, under three for
    each split, are given out one at a time.
    """
    have = have.astype(float)
    missing = targets - have
    deep = -np.sort(-missing, axis=1)
    levels = (np.cumsum(deep, axis=1) - (count * size)[:, None]) / np.arange(1, deep.shape[1] + 1)
    filled = (deep > levels).cumprod(axis=1).sum(axis=1).clip(1)
    level = levels[np.arange(len(levels)), filled - 1]
    given = np.maximum(0.0, np.floor((missing - level[:, None]) / size[:, None]) - 1)
    have += given * size[:, None]
    left = count - given.sum(axis=1)
    while (open_ := np.flatnonzero(left > 0)).size:
        have[open_, next_split(have[open_], targets[open_])] += size[open_]
        left[open_] -= 1
    return have


def allocate(sizes: DataFrame, fractions: dict[str, float], seed: int) -> DataFrame:
    """(group_id, split): within each label, groups from large to small go to the split furthest below its share.

    ``sizes(group_id, label, size)``, sizes of 1 or more. Ties between splits go
    to the smaller one, then in order of ``fractions``; ties between groups are
    shuffled by a seeded hash. The rule is sequential, but groups of one size are
    a run whose outcome can be computed at once, and a label of n items has
    sqrt(2 n) different sizes at most: these are what a label's task sees. What
    the splits have before each run is then joined to the groups, and each gets
    its split by its rank within the run.
    """
    names, shares = list(fractions), np.array(list(fractions.values()), float)

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        total = float((pdf["size"] * pdf["n"]).sum())
        have, starts = np.zeros((1, len(names))), []
        for size, n in zip(pdf["size"], pdf["n"], strict=True):
            starts.append(have[0].tolist())
            have = after_groups(have, shares[None, :] * total, np.array([float(size)]), np.array([float(n)]))
        return pdf[["label", "size"]].assign(have=starts, total=total)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            have = batch["have"].flatten().to_numpy().reshape(batch.num_rows, len(names))
            total, size, rank = (batch[c].to_numpy().astype(float) for c in ("total", "size", "rank"))
            targets = shares[None, :] * total[:, None]
            chosen = next_split(after_groups(have, targets, size, rank), targets)
            yield pa.RecordBatch.from_arrays([batch["group_id"], pa.array(np.array(names, object)[chosen], pa.string())], ["group_id", "split"])

    label, wanted = sizes.schema["label"].dataType.simpleString(), sizes.select("group_id").schema.add("split", "string")
    tie = F.md5(F.concat(F.lit(f"{seed}:"), F.col("group_id").cast("string")))
    runs = sizes.groupBy("label", F.col("size").cast("long").alias("size")).agg(F.count("*").alias("n"))
    starts = durable(runs.groupBy("label").applyInPandas(begin, f"label {label}, size long, have array<double>, total double"))
    ranks = ranking.ranked(sizes.select("group_id", "label", F.col("size").cast("long").alias("size"), tie.alias("tie")), ["label", "size"], ["tie", "group_id"])
    near = F.broadcast(starts) if starts.count() <= MOST_RUNS else starts
    met = ranks.alias("r").join(near.alias("s"), F.col("r.label").eqNullSafe(F.col("s.label")) & (F.col("r.size") == F.col("s.size")))
    return met.select("r.group_id", "r.size", "r.rank", "s.have", "s.total").mapInArrow(place, wanted)


def build_splits(grouped: DataFrame, label: str, site: str, least: int = 100, fractions: dict[str, float] | None = None, seed: int = 1337, key: str = "id") -> DataFrame:
    """Adds ``split``: whole groups of held-out sites to test_site, the others by :func:`allocate`."""
    held = holdout_sites(grouped, label, site, least, key).select(label, site)
    dragged = grouped.join(held, [label, site], "left_semi").select("group_id").distinct()
    rest = grouped.join(dragged, "group_id", "left_anti")
    sizes = majority(rest, "group_id", label).withColumnRenamed(label, "label")
    chosen = allocate(sizes, fractions or {"train": 0.70, "val": 0.15, "test": 0.15}, seed)
    chosen = chosen.unionByName(dragged.withColumn("split", F.lit("test_site")))
    return grouped.join(chosen, "group_id")


def hashed_splits(grouped: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """Adds ``split`` by a hash of the group: no sequence, so it scales to any number of groups."""
    u = F.conv(F.substring(F.md5(F.col("group_id").cast("string")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    bounds, low = [], 0.0
    for name, share in fractions.items():
        low += share
        bounds.append((name, low))
    chosen = F.lit(bounds[-1][0])
    for name, high in reversed(bounds[:-1]):
        chosen = F.when(u < high, name).otherwise(chosen)
    return grouped.withColumn("split", chosen)


def verify_splits(split: DataFrame, label: str, site: str, unique: list[str], held: DataFrame) -> DataFrame:
    """(problem, item): what is wrong with a split table; empty if nothing is.

    Checks that values of each column in ``unique`` stay in one split, that
    every label occurs in train, val and test, and that the held-out sites
    ``held(label, site)`` don't occur in train or val.
    """
    spread = [
        split.groupBy(F.col(c).cast("string").alias("item")).agg(F.countDistinct("split").alias("n")).where("n > 1").select(F.lit(f"{c} in several splits").alias("problem"), "item") for c in unique
    ]
    wanted = split.select(F.col(label).cast("string").alias("l")).distinct().select(F.explode(F.array(*map(F.lit, SPLITS))).alias("s"), "l")
    there = split.select(F.col("split").alias("s"), F.col(label).cast("string").alias("l")).distinct()
    missing = wanted.join(there, ["s", "l"], "left_anti").select(F.concat(F.lit("label missing in "), F.col("s")).alias("problem"), F.col("l").alias("item"))
    leaked = split.where("split in ('train', 'val')").join(held, [label, site], "left_semi").select(F.lit("held site in train or val").alias("problem"), F.concat_ws("/", label, site).alias("item")).distinct()
    out = missing.unionByName(leaked)
    for s in spread:
        out = out.unionByName(s)
    return out

"""Seeded samples, pairs for calibration, and weighted draws, all by hashes, so that every run gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: str | Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the key and the seed only."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def seeded_sample(items: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """``n`` rows in a random order that the seed fixes: ``place`` from 1 on. Each task keeps its first n only."""
    first = items.withColumn("_u", draw(key, seed)).orderBy("_u", key).limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy("_u", key))).drop("_u")


def same_key_pairs(items: DataFrame, keys: list[str], key: str = "id") -> DataFrame:
    """(a, b), a < b: each item and the next one with the same ``keys``, as likely copies.

    Neighbours connect a key's items without all their pairs; rows with a null
    among the keys pair with nothing.
    """
    there = items.where(" and ".join(f"{k} is not null" for k in keys))
    after = F.lead(key).over(Window.partitionBy(*keys).orderBy(key))
    return there.select(F.col(key).alias("a"), after.alias("b")).where("b is not null")


def cross_class_pairs(items: DataFrame, label: str, n: int, seed: int, key: str = "id") -> DataFrame:
    """Up to ``n`` random pairs (a, b) of items of different classes.

    Two seeded samples are laid side by side, and the first n places whose
    classes differ count.
    """
    left = seeded_sample(items.select(F.col(key).alias("a"), F.col(label).alias("la")), 4 * n, seed, "a")
    right = seeded_sample(items.select(F.col(key).alias("b"), F.col(label).alias("lb")), 4 * n, seed + 1, "b")
    return left.join(right, "place").where("la <> lb").orderBy("place").limit(n).select("a", "b")


def weighted_draws(items: DataFrame, weight: str, n: int, seed: int, key: str = "id", span: int = 4096) -> DataFrame:
    """(draw, key): ``n`` draws with replacement, each item with a probability in proportion to its weight.

    Items lie in the order of their keys on a line, each as long as its weight;
    sums are formed in spans of ``span`` keys, in spans of as many spans, and
    over these, one for each 16 million keys. Draws are joined by the n-th parts
    of the line that an item covers, not by a range.
    """
    placed = items.select(key, F.col(weight).cast("double").alias("_w"), F.floor(F.col(key) / span).alias("_span"))
    spans = placed.groupBy("_span").agg(F.sum("_w").alias("_of"))
    spans = spans.withColumn("_wide", F.floor(F.col("_span") / span))
    wide = spans.groupBy("_wide").agg(F.sum("_of").alias("_sum"))
    wide = wide.withColumn("_start", F.sum("_sum").over(Window.orderBy("_wide")) - F.col("_sum"))
    total = wide.agg(F.sum("_sum").alias("_total"))
    inner = F.sum("_of").over(Window.partitionBy("_wide").orderBy("_span")) - F.col("_of")
    spans = spans.join(wide.select("_wide", "_start"), "_wide").select("_span", (F.col("_start") + inner).alias("_before"))
    here = F.sum("_w").over(Window.partitionBy("_span").orderBy(key))
    line = placed.join(spans, "_span").join(F.broadcast(total), F.lit(True)).withColumn("_hi", (F.col("_before") + here) / F.col("_total"))
    line = line.withColumn("_lo", F.col("_hi") - F.col("_w") / F.col("_total"))
    cells = line.select(key, "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") * n), F.floor(F.col("_hi") * n))).alias("_cell"))
    draws = items.sparkSession.range(n).select(F.col("id").alias("draw"), draw("id", seed).alias("_u")).withColumn("_cell", F.floor(F.col("_u") * n))
    return cells.join(draws, "_cell").where("_u >= _lo and _u < _hi").select("draw", key)

"""Pixels and masks as columns: colour distance, ratios, blending, mixing, thresholds from histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of lightness and the two colour axes.
LAB_WEIGHTS = (0.5, 1.5, 1.5)


def warmup_cosine(epoch: Column, warmup: int, total: int, least: float) -> Column:
    """A learning rate's factor: a linear rise, then half a cosine down to ``least``."""
    along = (epoch - warmup) / float(max(1, total - warmup))
    return F.when(epoch < warmup, (epoch + 1) / float(max(1, warmup))).otherwise(least + (1 - least) * 0.5 * (1 + F.cos(math.pi * along)))


def lab_distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * w) ** 2 for x, y, w in zip(a, b, LAB_WEIGHTS, strict=True)))


def chroma(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def normalised(x: Column, mean: float, std: float) -> Column:
    return (x / 255.0 - mean) / std


def blended(image: Column, mask: Column, backdrop: float) -> Column:
    """``image`` over a plain backdrop by a mask from 0 to 255; an all but empty or full mask leaves it as it is."""
    level = F.aggregate(mask, F.lit(0.0), lambda acc, x: acc + x) / F.size(mask)
    over = F.zip_with(image, mask, lambda x, m: F.greatest(F.lit(0.0), F.least(F.lit(255.0), x * m / 255.0 + backdrop * (1 - m / 255.0))))
    return F.when((level >= 2) & (level <= 253), over).otherwise(image)


def mixed_up(x: Column, y: Column, share: Column) -> Column:
    """Element-wise ``share`` of x and the rest of y, for values and targets alike."""
    return F.zip_with(x, y, lambda a, b: share * a + (1 - share) * b)


def cut_mixed(x: Column, y: Column, first: Column, last: Column) -> Column:
    """x with the elements from ``first`` to before ``last`` taken from y."""
    return F.transform(x, lambda a, i: F.when((i >= first) & (i < last), y[i]).otherwise(a))


def otsu(values: DataFrame, by: list[str], level: str = "level") -> DataFrame:
    """(by, threshold): the level after which the variance between the lower and upper part is largest; ties go to the least.

    Works on the histogram, one row for each level.
    """
    bins = values.groupBy(*by, level).agg(F.count("*").cast("double").alias("n")).withColumn("s", F.col("n") * F.col(level))
    whole, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(level)
    sums = bins.select(*by, level, F.sum("n").over(upto).alias("n0"), F.sum("s").over(upto).alias("s0"), F.sum("n").over(whole).alias("n"), F.sum("s").over(whole).alias("s"))
    n1 = F.col("n") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / n1
    between = F.when(n1 > 0, F.round(F.col("n0") * n1 * gap * gap / (F.col("n") * F.col("n")), 9)).otherwise(0.0)
    ranked = sums.withColumn("between", between).withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("between"), level)))
    return ranked.where("r = 1").select(*by, F.col(level).alias("threshold"), "between")

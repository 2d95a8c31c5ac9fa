"""Pictures of other sizes, and the hashes of small ones.

A picture is a table of rows (image, y, v), v an array of levels from 0 to 255.
Resampling is separable: the weights of a line of n pixels are a band that only
depends on n, so bands are made once for each size that occurs and joined. Each
picture row is resampled by itself; then it adds to the few new rows in its
reach, by an aggregation with partial sums. Weights are whole multiples of
2 ** -22, so sums are exact in any order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Binary digits of a weight; lobes of the kernel; sides of a thumbnail and of a hash.
DIGITS, LOBES, THUMB, HASH = 22, 3, 32, 8
#: Sizes of lines whose bands are broadcast; a band has a few weights for each new pixel.
MOST_SIZES = 2_000


def lanczos(x: Column) -> Column:
    """sinc(x) sinc(x / LOBES), 0 beyond LOBES."""
    at = x * math.pi
    return F.when(F.abs(x) >= LOBES, 0.0).when(x == 0, 1.0).otherwise(LOBES * F.sin(at) * F.sin(at / LOBES) / (at * at))


def bands(sizes: DataFrame, to: int) -> DataFrame:
    """(size, bands) for each ``size``: for each of ``to`` new pixels (first, ws), the weights of the old pixels from ``first`` on.

    Shrinking widens the kernel by as much; weights at the ends, where the kernel
    reaches out of the line, are scaled up to add to one.
    """
    scale = F.col("size") / F.lit(float(to))
    wide = F.greatest(scale, F.lit(1.0))
    centre = lambda k: (k + 0.5) * scale
    first = lambda k: F.greatest(F.lit(0), F.floor(centre(k) - wide * LOBES + 0.5)).cast("int")
    end = lambda k: F.least(F.col("size"), F.floor(centre(k) + wide * LOBES + 0.5)).cast("int")
    raw = lambda k: F.transform(F.sequence(first(k), end(k) - 1), lambda i: lanczos((i - centre(k) + 0.5) / wide))
    total = lambda ws: F.aggregate(ws, F.lit(0.0), lambda s, w: s + w)
    whole = lambda ws: F.transform(ws, lambda w: F.floor(w / total(ws) * 2**DIGITS + 0.5).cast("long"))
    each = F.transform(F.sequence(F.lit(0), F.lit(to - 1)), lambda k: F.struct(first(k).alias("first"), F.transform(F.array(raw(k)), whole)[0].alias("ws")))
    return sizes.where("size > 0").select("size", each.alias("bands"))


def level(total: Column) -> Column:
    """A weighted sum of levels, rounded, from 0 to 255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright(total + 2 ** (DIGITS - 1), DIGITS))).cast("long")


def _near(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= MOST_SIZES else table


def resize(rows: DataFrame, height: int, width: int) -> DataFrame:
    """(image, y, v): the pictures in ``height`` rows of ``width`` levels, by Lanczos' kernel.

    Levels are taken as whole numbers. A picture's rows are numbered from 0 and
    of one length; pictures may differ in size. Those without pixels are left out.
    """
    flat = rows.select("image", "y", F.transform("v", lambda x: F.rint(x).cast("long")).alias("v")).withColumn("size", F.size("v"))
    across = _near(bands(flat.select("size").distinct(), width))
    weighed = lambda b: F.aggregate(F.zip_with(F.slice("v", b["first"] + 1, F.size(b["ws"])), b["ws"], lambda x, w: x * w), F.lit(0).cast("long"), lambda s, x: s + x)
    narrow = flat.join(across, "size").select("image", "y", F.transform("bands", lambda b: level(weighed(b))).alias("v"))
    heights = rows.groupBy("image").agg((F.max("y") + 1).cast("int").alias("size"))
    down = _near(bands(heights.select("size").distinct(), height))
    # The new rows that an old row reaches, with its weight in each.
    reach = F.filter(F.transform("bands", lambda b, k: F.struct(k.alias("k"), F.when(F.col("y") >= b["first"], F.get(b["ws"], (F.col("y") - b["first"]).cast("int"))).alias("w"))), lambda r: r["w"].isNotNull())
    met = narrow.join(heights, "image").join(down, "size").select("image", "v", F.explode(reach).alias("r"))
    cells = met.select("image", F.col("r.k").alias("y"), F.col("r.w").alias("w"), F.posexplode("v").alias("x", "l"))
    summed = cells.groupBy("image", "y", "x").agg(level(F.sum(F.col("w") * F.col("l"))).alias("l"))
    return summed.groupBy("image", "y").agg(F.array_sort(F.collect_list(F.struct("x", "l"))).alias("c")).select("image", "y", F.col("c.l").alias("v"))


def thumbnails(rows: DataFrame, side: int = THUMB) -> DataFrame:
    """(image, thumb): small pictures as one array, row by row."""
    small = resize(rows, side, side)
    return small.groupBy("image").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("y", "v"))), lambda r: r["v"])).alias("thumb"))


def dhash(rows: DataFrame, side: int = HASH) -> DataFrame:
    """(image, h): for each pixel of a small picture, whether the one to its right is brighter, as the bits of a whole number from the greatest on."""
    if side * side > 64:
        raise ValueError("a hash has 64 bits")
    small = resize(rows, side, side + 1)
    brighter = F.zip_with(F.slice("v", 2, side), F.slice("v", 1, side), lambda b, a: F.when(b > a, 1).otherwise(0))
    bits = small.groupBy("image").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("y", brighter.alias("b")))), lambda r: r["b"])).alias("bits"))
    return bits.select("image", F.aggregate("bits", F.lit(0).cast("long"), lambda h, b: F.shiftleft(h, 1).bitwiseOR(b.cast("long"))).alias("h"))

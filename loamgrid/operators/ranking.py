"""Ranks and quantiles over any number of rows, without a task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.session import durable

#: Buckets of a histogram, and the rows of an interval that are sorted at once.
BUCKETS, FEW = 4096, 20_000


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], rank: str = "rank", n: str = "n") -> DataFrame:
    """``rows`` with their rank from 0 within ``by``, in ``order``, and the number of rows of their group.

    Rows are sorted over all partitions, so a group may be of any size; what a
    window counts are the groups' rows in each partition. Rows that are equal in
    ``order`` have ranks of their own, by their place in the input. A null key is
    a group.
    """
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    keys = [*by, *order, "_place"]
    dealt = durable(placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_place").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    group = F.struct(*by, F.lit(0).alias("_")) if by else F.struct(F.lit(0).alias("_"))
    parts = dealt.groupBy(group.alias("_group"), part.alias("_part")).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = parts.select("_group", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias(n))
    met = dealt.withColumn("_group", group).withColumn("_part", part).alias("_r").join(shifts.alias("_s"), F.col("_r._group").eqNullSafe(F.col("_s._group")) & (F.col("_r._part") == F.col("_s._part")))
    return met.select(*(F.col(f"_r.`{c}`") for c in rows.columns), (F.col("_at") + F.col("_shift")).alias(rank), F.col(n))


def _bucket(x: Column, low: Column, high: Column) -> Column:
    """A number that never falls as ``x`` grows, 0 at ``low`` and BUCKETS - 1 at ``high``.

    Both are finite and of one sign. Where they differ by their size, buckets
    are equal in logarithms. Rounding can't put two values in the wrong order.
    """
    size = lambda v: F.when(v < 0, -F.ln(-v)).otherwise(F.ln(F.abs(v)))
    wide = F.greatest(F.abs(low), F.abs(high)) / 16 > F.least(F.abs(low), F.abs(high))
    along = F.when(wide, (size(x) - size(low)) / (size(high) - size(low))).otherwise((x - low) / (high - low))
    return F.least(F.floor(along * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def quantiles(rows: DataFrame, value: str, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, fraction, quantile): exact quantiles, with linear interpolation between neighbours.

    Nulls don't count; NaN is greater than all numbers. A group without values
    has no rows. Each pass counts the rows of the intervals in which the wanted
    ranks lie by buckets, and goes on with the bucket of each rank; intervals of
    few rows are sorted. A pass is a scan with partial sums; groups and their
    intervals are joined to it as a small table.
    """
    if not fractions or not all(0 <= f <= 1 for f in fractions):
        raise ValueError("fractions are from 0 to 1")
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    group = F.struct(*names, F.lit(0).alias("_")).alias("g") if by else F.struct(F.lit(0).alias("_")).alias("g")
    values = durable(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x")).select(group, (F.col("x") + 0.0).alias("x")))
    kind = F.when(F.isnan("x"), 5).when(F.col("x") == float("inf"), 4).when(F.col("x") == -float("inf"), 0).otherwise(F.signum("x").cast("int") + 2)
    counted = durable(values.groupBy("g", kind.alias("bucket")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")))
    sizes = counted.groupBy("g").agg(F.sum("n").alias("total"))
    # The wanted ranks of a group: those under and over each fraction's place.
    place = F.col("fraction") * (F.col("total") - 1)
    asked = durable(sizes.select("g", "total", F.explode(F.array(*(F.lit(float(f)) for f in dict.fromkeys(fractions)))).alias("fraction")).select("g", "fraction", place.alias("place"), F.floor(place).alias("under"), F.ceil(place).alias("over")))
    ranks = asked.select("g", F.explode(F.array("under", "over")).alias("rank")).distinct()
    intervals = durable(_narrowed(counted.withColumn("_id", F.lit(0).cast("long")), ranks.withColumn("_id", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long"))))
    while intervals.where((F.col("low") < F.col("high")) & (F.col("n") > FEW)).limit(1).count():
        large = intervals.where((F.col("low") < F.col("high")) & (F.col("n") > FEW))
        open_ones = large.select("g", F.col("before").alias("_id"), "low", "high").distinct()
        held = values.join(_small(open_ones), "g").where((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high")))
        counts = held.groupBy("g", "_id", _bucket(F.col("x"), F.col("low"), F.col("high")).alias("bucket")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        inner = _narrowed(counts, large.select("g", "rank", F.col("before").alias("_id"), "before"))
        intervals = durable(intervals.where((F.col("low") >= F.col("high")) | (F.col("n") <= FEW)).unionByName(inner))
    few = intervals.where(F.col("low") < F.col("high")).select("g", F.col("before").alias("_id"), "low", "high").distinct()
    sorted_ = values.join(_small(few), "g").where((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high"))).groupBy("g", "_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    chosen = intervals.where(F.col("low") < F.col("high")).join(sorted_.withColumnRenamed("_id", "before"), ["g", "before"]).select("g", "rank", F.get("xs", (F.col("rank") - F.col("before")).cast("int")).alias("x"))
    found = durable(intervals.where(~(F.col("low") < F.col("high"))).select("g", "rank", F.col("low").alias("x")).unionByName(chosen))
    under, over = found.select("g", F.col("rank").alias("under"), F.col("x").alias("a")), found.select("g", F.col("rank").alias("over"), F.col("x").alias("b"))
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.col("over") - F.col("place")) * F.col("a") + (F.col("place") - F.col("under")) * F.col("b"))
    out = asked.join(under, ["g", "under"]).join(over, ["g", "over"])
    return out.select(*(F.col(f"g.{k}").alias(c) for k, c in zip(names, by)), "fraction", between.alias("quantile"))


def _small(intervals: DataFrame) -> DataFrame:
    """Intervals, to be broadcast while they are few; a group has two for each fraction at most."""
    return F.broadcast(intervals) if intervals.count() <= FEW else intervals


def _narrowed(counts: DataFrame, ranks: DataFrame) -> DataFrame:
    """(g, rank, before, n, low, high): the bucket of each rank, and the rows of its group before it.

    ``counts`` are (g, _id, bucket, n, low, high), ``ranks`` (g, rank, _id, before).
    """
    order = Window.partitionBy("g", "_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    upto = counts.withColumn("_upto", F.coalesce(F.sum("n").over(order), F.lit(0)))
    met = upto.join(ranks, ["g", "_id"]).withColumn("before", F.col("before") + F.col("_upto"))
    return met.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).select("g", "rank", "before", "n", "low", "high")

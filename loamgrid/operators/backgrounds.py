"""Backdrops for items: drawn from a bank so that no item gets one of its own label.

The bank's files have one order, in which each label's files are an interval. A
draw that must stay out of an item's own interval is a draw from what is left of
the line, moved past the interval where it reaches it, and then an equi-join on
the place. No pool is built, for any number of labels and files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.operators.ranking import ranked
from loamgrid.operators.sampling import draw
from loamgrid.session import durable

#: The sorts of made backdrops.
KINDS = ("soil", "gravel", "foliage", "sky", "straw", "concrete")
#: Files or labels (of about 100 bytes) that are broadcast; more are joined by shuffle.
MOST_BROADCAST = 100_000
#: Keys that no place has, over which rows without a draw are spread.
NOWHERE = 1 << 20


def bank(files: DataFrame, label: str | None = None, file: str = "file", readable: str | None = None) -> DataFrame:
    """(place, file, readable, and label if the files have one): all files in one order, by label, then by name.

    A null label is one of the labels; files are readable unless a column says
    that they aren't, and a null there says so.
    """
    can = F.coalesce(F.col(readable).cast("boolean"), F.lit(False)) if readable else F.lit(True)
    named = [F.col(label).alias("label")] if label else []
    rows = files.select(*named, F.col(file).alias("file"), can.alias("readable"))
    return durable(ranked(rows, [], (["label"] if label else []) + ["file"], rank="place").drop("n"))


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def intervals(files: DataFrame) -> DataFrame:
    """(label, first, held): where each label's files lie in the order."""
    return files.groupBy("label").agg(F.min("place").alias("first"), F.count("*").alias("held"))


def own_left_out(u: Column, total: Column | int, first: Column, held: Column) -> Column:
    """The place that a draw ``u`` from 0 to 1 means on a line of ``total`` places without ``held`` of them from ``first`` on.

    Where nothing else is left, or the label has no interval (nulls), the whole
    line counts.
    """
    total = F.lit(total) if isinstance(total, int) else total
    out = F.coalesce(F.when(held < total, held), F.lit(0))
    place = F.least(F.floor(u * (total - out)), total - out - 1)
    return F.when(place >= F.coalesce(first, F.lit(0)), place + out).otherwise(place)


def _found(items: DataFrame, files: DataFrame, place: str, name: str) -> DataFrame:
    """``items`` with the readable file at ``place``, null where there is none."""
    spot = F.coalesce(F.col(place), -1 - F.pmod(F.xxhash64("_key"), F.lit(NOWHERE)))
    there = files.where("readable").select(F.col("place").alias("_place"), F.col("file").alias(name))
    return items.withColumn("_spot", spot).join(_small(there), F.col("_spot") == F.col("_place"), "left").drop("_spot", "_place", place)


def draw_backdrops(items: DataFrame, key: str, label: str, harvested: DataFrame, field: DataFrame, seed: int, kinds: tuple[str, ...] = KINDS, p_field: float = 0.5, p_procedural: float = 0.5) -> DataFrame:
    """(key, label, source, file, kind): a backdrop for every item.

    ``harvested`` and ``field`` come from :func:`bank`. With ``p_field`` an item
    gets a field file; else, but for ``p_procedural`` of these, a harvested file
    of another label; else a made one of one of ``kinds``. Without files of a sort,
    or where the drawn one can't be read, the next sort has its turn. All draws
    are hashes of the key and the seed, so a repeated key has the same backdrop,
    and no run differs from another.
    """
    n_field, n_harvested = field.count(), harvested.count()
    u = lambda k: draw(F.col("_key"), seed + k)
    rows = items.select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    near = _small(intervals(harvested).select(F.col("label").alias("_of"), "first", "held"))
    rows = rows.join(near, F.col("_label").eqNullSafe(F.col("_of")), "left").drop("_of")
    in_field = F.when((u(0) < p_field) & F.lit(n_field > 0), F.least(F.floor(u(1) * n_field), F.lit(n_field - 1)))
    in_bank = F.when((u(2) >= p_procedural) & F.lit(n_harvested > 0), own_left_out(u(3), n_harvested, F.col("first"), F.col("held")))
    rows = rows.select("_key", "_label", in_field.alias("_f"), in_bank.alias("_h"))
    rows = _found(_found(rows, field, "_f", "_field"), harvested, "_h", "_harvested")
    source = F.when(F.col("_field").isNotNull(), "field").when(F.col("_harvested").isNotNull(), "harvested").otherwise("procedural")
    kind = F.when(source == "procedural", F.get(F.array(*map(F.lit, kinds)), F.floor(u(4) * len(kinds)).cast("int")))
    same = F.coalesce(F.col("_field").cast("string"), F.col("_harvested").cast("string"))
    return rows.select(F.col("_key").alias(key), F.col("_label").alias(label), source.alias("source"), same.alias("file"), kind.alias("kind"))

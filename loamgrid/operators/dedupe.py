"""Exact duplicates: keep-first, conflicts between copies, and profiles of what stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mark_duplicates(items: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """Adds ``copy_no``: 1 for the first row of each digest in ``order``, 2 and on for its copies."""
    return items.withColumn("copy_no", F.row_number().over(Window.partitionBy(digest).orderBy(*order)))


def keep_first(items: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """The first row of each digest in ``order``, whose columns together identify a row.

    Only these columns are shuffled, and tasks find their own first rows before.
    """
    first = items.groupBy(digest).agg(F.min(F.struct(*order)).alias("f")).select("f.*")
    return items.join(first, order, "left_semi")


def label_conflicts(marked: DataFrame, digest: str, label: str, key: str) -> DataFrame:
    """Copies whose label is not that of the row kept for their digest."""
    kept = marked.where("copy_no = 1").select(digest, F.col(label).alias("kept_label"), F.col(key).alias("kept_key"))
    return marked.where("copy_no > 1").join(kept, digest, "left").where(F.col(label) != F.col("kept_label"))


def first_per_key(items: DataFrame, key: str, order: list, k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key."""
    return items.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def shares(items: DataFrame, by: list[str], of: str) -> DataFrame:
    """(by, of, n, share): how each group's rows are spread over ``of``."""
    counts = items.groupBy(*by, of).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def dominant(items: DataFrame, by: str, of: str) -> DataFrame:
    """(by, top, share, distinct): the most frequent value of ``of`` in each group; ties go to the least value."""
    spread = shares(items, [by], of)
    top = first_per_key(spread, by, [F.desc("n"), of]).select(by, F.col(of).alias("top"), "share")
    return top.join(spread.groupBy(by).agg(F.count("*").alias("distinct")), by)


def majority(items: DataFrame, group: str, label: str) -> DataFrame:
    """(group, size, label): each group's size and most frequent label; ties go to the least label."""
    counts = items.groupBy(group, label).agg(F.count("*").alias("n"))
    top = first_per_key(counts, group, [F.desc("n"), label]).select(group, label)
    return counts.groupBy(group).agg(F.sum("n").alias("size")).join(top, group)

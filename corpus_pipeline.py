"""The corpus pipeline: five stages over documents, each on what the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.common import table
from loamgrid.llm.decontam import find_contamination
from loamgrid.llm.langid import UNKNOWN, identify
from loamgrid.llm.lines import dedup_lines
from loamgrid.llm.linking import sized
from loamgrid.llm.mixing import mix
from loamgrid.llm.neardup import near_duplicates
from loamgrid.session import checkpoint_dir, durable

#: Least calibrated probability of a document's language.
LEAST_SCORE = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: a text without letters or of no clear language goes."""
    found = identify(docs, F.lit(True), out="_language")
    return found.where((F.col("_language.lang_pred") != UNKNOWN) & (F.col("_language.score") >= LEAST_SCORE)).select(*docs.columns)


def lines_deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that had lines and lost every word goes. n_chars is counted anew."""
    done = dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    left = done.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def near_deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least doc_id."""
    dropped = durable(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_dropped")).distinct())
    return docs.join(sized(dropped), F.col("doc_id") == F.col("_dropped"), "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which less than one word in twenty is a benchmark's."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = durable(found.where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    return docs.join(sized(bad), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents whose tokens have the target shares of sources, languages and topics."""
    return mix(docs, prefix="_mix_").where("_mix_sampled").select(*docs.columns)


STAGES = [
    ("language_id", identified),
    ("line_dedup", lines_deduped),
    ("near_dedup", near_deduped),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

#: Trained models and similarity joins have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again as the next one's documents."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

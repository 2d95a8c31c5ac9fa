"""Sources and sinks: folders of labelled files, typed tables, reports and caches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.functions.text import class_of_path, parse_filename, stem

#: File suffixes of images, and folders that hold no class.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp")
NON_CLASS_FOLDERS = ("scripts", "src", "tools", "__pycache__", "reports", "artifacts", "export")
#: The first bytes, in hex, of JPEG, PNG, BMP and WebP files.
SIGNATURES = ("FFD8FF", "89504E47", "424D", "52494646")
MANIFEST = "path string, filename string, class string, site string, leaf_core string, shot string, day string, uuid string, md5 string, dhash string, width int, height int, mode string, error string, group_id bigint, label_conflict boolean"


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, filename, class, length, content) of all files in the folders of ``root``; contents are read only where used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.withColumn("filename", F.element_at(F.split("path", "/"), -1)).withColumn("class", class_of_path(F.col("path")))


def class_folders(files: DataFrame) -> DataFrame:
    """(class): folders with at least one image that are neither hidden nor for tools."""
    image = suffix(F.col("filename")).isin(*IMAGE_SUFFIXES)
    seen = files.groupBy("class").agg(F.max(image).alias("images"))
    return seen.where(F.col("images") & ~F.col("class").isin(*NON_CLASS_FOLDERS) & ~F.col("class").startswith(".")).select("class")


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(ok, failed): a row for each image or file without suffix in a class folder.

    Files that don't begin like an image fail with an error text; empty files
    hold nothing to read and give no row.
    """
    files = listing(spark, root)
    wanted = files.join(class_folders(files), "class", "left_semi").where(suffix(F.col("filename")).isin(*IMAGE_SUFFIXES, ""))
    parsed = wanted.withColumn("p", parse_filename(F.col("filename"))).select("path", "filename", "class", "p.site", "p.leaf_core", "p.shot", "p.day", "p.uuid", F.md5("content").alias("md5"), F.when(F.hex(F.substring("content", 1, 4)).rlike("^(" + "|".join(SIGNATURES) + ")"), "").otherwise("ValueError: not an image").alias("error"))
    return parsed.where("error = ''"), parsed.where("error <> ''")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest's rows with fixed types; absent shots and days are ''."""
    return spark.read.schema(MANIFEST).csv(path, header=True).na.fill("", ["shot", "day"])


def optional_csv(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table, or None if it isn't there."""
    try:
        return spark.read.schema(schema).csv(path, header=True)
    except AnalysisException:
        return None


def last_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of the last summary file by name; all fields trimmed text."""
    rows = spark.read.csv(f"{folder}/*summary*.csv", header=True, inferSchema=False).withColumns({"_file": F.input_file_name(), "_at": F.monotonically_increasing_id()})
    last = rows.orderBy(F.desc("_file"), F.desc("_at")).limit(1).drop("_file", "_at")
    return last.select(*[F.trim(f"`{c}`").alias(c.strip()) for c in last.columns])


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """(temperature, threshold) of a calibration file: 1 and 10 where a key is missing, 1 and 100 where the file is."""
    try:
        found = spark.read.schema("temperature double, energy_threshold_95tpr double").json(path, multiLine=True)
    except AnalysisException:
        return spark.range(1).select(F.lit(1.0).alias("temperature"), F.lit(100.0).alias("threshold"))
    return found.select(F.coalesce("temperature", F.lit(1.0)).alias("temperature"), F.coalesce("energy_threshold_95tpr", F.lit(10.0)).alias("threshold"))


def cache_key(path: Column) -> Column:
    """Folder and stem of a file, the key of what is cached for it."""
    return F.concat(class_of_path(path), F.lit("/"), stem(path))


def not_cached(items: DataFrame, cached: DataFrame, overwrite: bool = False) -> DataFrame:
    """Items whose result isn't in ``cached(cache_key)`` yet."""
    keyed = items.withColumn("cache_key", cache_key(F.col("path")))
    return keyed if overwrite else keyed.join(cached.select("cache_key").distinct(), "cache_key", "left_anti")


def write_csv(table: DataFrame, path: str, append: bool = False) -> None:
    table.write.mode("append" if append else "overwrite").csv(path, header=True)


def write_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def markdown(table: DataFrame, limit: int = 200) -> str:
    """A small aggregate as a Markdown table; it says so if there are more than ``limit`` rows."""
    rows = table.limit(limit + 1).collect()
    more = [f"\nMore than {limit} rows; these are some."] if len(rows) > limit else []
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(table.columns), line(["---"] * len(table.columns)), *map(line, rows[:limit]), *more])

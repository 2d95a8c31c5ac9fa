"""Sinks of streams: rows that are written once however often a batch is tried, snapshots on demand, a console.

A micro-batch is written to a folder of its own that is named after it, and
counts as written when Spark's writer has left its mark there. A batch that is
tried again after that changes nothing, and one that failed half-way is written
anew; so are executors' tasks. Readers see whole batches only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

#: What Spark's writers leave in a folder that is complete.
DONE = "_SUCCESS"
Writer = Callable[[DataFrame, int], None]


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, wherever Spark can read."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def _whole(spark: SparkSession, folder: str) -> list[str]:
    """The complete subfolders of ``folder``, in the order of their names."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(folder)
    files = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(there):
        return []
    found = sorted(s.getPath().toString() for s in files.listStatus(there) if s.isDirectory())
    return [f for f in found if _exists(spark, f"{f}/{DONE}")]


def batch_folder(folder: str, batch: int) -> str:
    return f"{folder.rstrip('/')}/batch={batch:012d}"


def written_once(folder: str, change: Callable[[DataFrame], DataFrame] | None = None) -> Writer:
    """For foreachBatch: writes each batch (what ``change`` makes of it) once, as Parquet.

    A stream has a ``folder`` of its own, as it has a checkpoint of its own.
    """

    def write(rows: DataFrame, batch: int) -> None:
        path = batch_folder(folder, batch)
        if not _exists(rows.sparkSession, f"{path}/{DONE}"):
            (change(rows) if change else rows).write.mode("overwrite").parquet(path)

    return write


def read_batches(spark: SparkSession, folder: str, schema: str | T.StructType, after: int = -1) -> DataFrame:
    """The rows of all complete batches after a given one, with ``batch``; none if there are none."""
    paths = [p for p in _whole(spark, folder) if "/batch=" in p and int(p.rsplit("=", 1)[1]) > after]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("long") if paths else F.lit(None).cast("long")
    return rows.select("*", number.alias("batch"))


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``; which one of equal rows doesn't matter, others are told apart by all their values.

    A partial maximum per task and key, so no task sees a key's history.
    """
    others = [c for c in rows.columns if c not in keys]
    whole = F.struct(*order, *(c for c in others if c not in order))
    found = rows.groupBy(*keys).agg(F.max(whole).alias("_last"))
    return found.select(*(c if c in keys else F.col("_last").getField(c).alias(c) for c in rows.columns))


def keep_newest(folder: str, keys: Sequence[str], order: Sequence[str]) -> Writer:
    """For foreachBatch: each batch adds its last row of each key, once; :func:`current` has the table that this makes."""
    return written_once(folder, lambda rows: newest(rows, keys, order))


def current(spark: SparkSession, folder: str, schema: str | T.StructType, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key of all batches; what was compacted is read from there.

    Where rows are equal in ``order``, a later batch's row is later.
    """
    done = [int(p.rsplit("=", 1)[1]) for p in _whole(spark, f"{folder.rstrip('/')}/base") if "/upto=" in p]
    rows = read_batches(spark, folder, schema, max(done, default=-1))
    if done:
        base = spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/base/upto={max(done):012d}")
        rows = rows.unionByName(base.withColumn("batch", F.lit(-1).cast("long")))
    return newest(rows, keys, [*order, "batch"]).drop("batch")


def compact(spark: SparkSession, folder: str, schema: str | T.StructType, keys: Sequence[str], order: Sequence[str]) -> int:
    """Writes the current table to a folder that later reads start from; the last batch in it, -1 if there is none.

    Nothing is deleted: readers that began before go on with what they listed.
    """
    done = [int(p.rsplit("=", 1)[1]) for p in _whole(spark, folder) if "/batch=" in p]
    upto = max(done, default=-1)
    path = f"{folder.rstrip('/')}/base/upto={upto:012d}"
    if done and not _exists(spark, f"{path}/{DONE}"):
        current(spark, folder, schema, keys, order).write.mode("overwrite").parquet(path)
    return upto


def snapshots(requests: DataFrame, request: str, target: str, table: Callable[[SparkSession], DataFrame], checkpoint: str) -> StreamingQuery:
    """Starts a query that writes ``table`` to target/request=<id> when the stream ``requests`` asks for it.

    A request that was served before, or that comes twice, has its first
    snapshot. Requests of a micro-batch see the same table. Ids are taken as
    text; nulls and ids that aren't letters, digits, - or _ are left out.
    """

    def serve(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        asked = rows.select(F.col(request).cast("string").alias("id")).where(F.col("id").rlike(r"^[A-Za-z0-9_-]+\z")).distinct()
        open_ = [r.id for r in asked.orderBy("id").toLocalIterator() if not _exists(spark, f"{target.rstrip('/')}/request={r.id}/{DONE}")]
        if open_:
            now = table(spark)
            for k, one in enumerate(open_):
                path = f"{target.rstrip('/')}/request={one}"
                # The first copy is the table as it was; the others are copies of it.
                (now if k == 0 else spark.read.parquet(f"{target.rstrip('/')}/request={open_[0]}")).write.mode("overwrite").parquet(path)

    return requests.writeStream.foreachBatch(serve).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start(stream: DataFrame, writer: Writer, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Starts ``stream`` into a writer: every so often, or for what there is now."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.outputMode("update").foreachBatch(writer).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def console(stream: DataFrame, line: str = "line", rows: int = 20, checkpoint: str | None = None) -> StreamingQuery:
    """Starts ``stream`` to the driver's standard output: its column ``line``, ``rows`` of a batch at most, which is what a console is for."""

    def show(batch: DataFrame, number: int) -> None:
        for r in batch.select(F.col(line).cast("string").alias("line")).take(rows):
            print(f"[{number}] {r.line}", flush=True)

    out = stream.writeStream.foreachBatch(show).trigger(availableNow=True)
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()

import datetime

from pyspark.sql import functions as F

from loamgrid.sources import files
from loamgrid.streaming import batch, stateful


def run(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return query


def test_running_mean_over_micro_batches(spark, tmp_path):
    rows = [(1, k, float(k)) for k in range(6)] + [(2, k, 5.0) for k in range(3)]
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] % 6 // 2 == part], "user long, at long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stateful.event_stream(spark, str(tmp_path / "in"), "user long, at long, value double", files_per_trigger=100)
    run(stateful.running_mean(stream, "user", "at", "value"), "means", "update")
    got = {r["key"]: r["ema"] for r in spark.table("means").collect()}
    want = 0.0
    for k in range(1, 6):
        want = 0.9 * want + 0.1 * k
    assert abs(got[1] - want) < 1e-9 and got[2] == 5.0


def test_pending_triggers_reject_over_one(spark, tmp_path):
    spark.createDataFrame([(7, k) for k in range(5)], "user long, at long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stateful.event_stream(spark, str(tmp_path / "in"), "user long, at long")
    run(stateful.pending_triggers(stream, "user"), "pending", "update")
    row = spark.table("pending").first()
    assert (row["taken"], row["rejected"], row["waiting"]) == (0, 4, 1)


def test_late_rows_and_windows(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([(at(1), "a"), (at(4), "a"), (at(11), "b")], "ts timestamp, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stateful.event_stream(spark, str(tmp_path / "in"), "ts timestamp, kind string")
    run(stateful.windowed_counts(stream, "ts", ["kind"], "10 minutes", "5 minutes"), "windows", "update")
    assert {(r["kind"], r["n"]) for r in spark.table("windows").collect()} == {("a", 2), ("b", 1)}


def test_sensor_cycle(spark):
    got = [r[0] for r in spark.range(21).select(batch.sensor_value(F.col("id"))).collect()]
    assert got[0] == 45 and got[20] == got[0] and len(set(got[:20])) == 20


def test_folder_scan(spark, tmp_path):
    for path, data in {"Tomato/a___GH Leaf 1.jpg": b"\xff\xd8\xff\xe0", "Tomato/b.JPG": b"text", "Tomato/noext": b"\x89PNG", "scripts/c.jpg": b"\xff\xd8\xff", "notes/readme": b"t"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(data)
    ok, failed = files.scan(spark, str(tmp_path))
    assert {r["filename"] for r in ok.collect()} == {"a___GH Leaf 1.jpg", "noext"}
    assert [r["error"] for r in failed.collect()] == ["ValueError: not an image"]
    row = files.calibration(spark, str(tmp_path / "absent.json")).first()
    assert (row["temperature"], row["threshold"]) == (1.0, 100.0)

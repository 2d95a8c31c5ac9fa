import os
from pathlib import Path

from pyspark.sql import functions as F

from loamgrid.streaming import sinks, stateful

SCHEMA = "id long, user long, at long, value double"


def add(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder):
    return stateful.event_stream(spark, f"{folder}/*", SCHEMA)


def ended(query):
    query.awaitTermination(120)
    assert query.exception() is None


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*") if p.is_file()}


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for k in range(3):
        add(spark, src, f"f{k}", [(10 * k + i, i % 3, k, float(i)) for i in range(10)])
    ended(sinks.start(stream(spark, src), sinks.written_once(out), ckpt))
    before, content = files(out), rows_of(sinks.read_batches(spark, out, SCHEMA))
    assert len(content) == 30 and {r[-1] for r in content} == {0, 1, 2}
    # The same batches by hand, and after the loss of the note that the last one was done.
    for k in range(3):
        sinks.written_once(out)(spark.createDataFrame([(99, 9, 9, 9.0)], SCHEMA), k)
    for name in ("2", ".2.crc"):
        if os.path.exists(f"{ckpt}/commits/{name}"):
            os.remove(f"{ckpt}/commits/{name}")
    ended(sinks.start(stream(spark, src), sinks.written_once(out), ckpt))
    assert files(out) == before and rows_of(sinks.read_batches(spark, out, SCHEMA)) == content
    add(spark, src, "later", [(100, 1, 7, 1.0)])
    ended(sinks.start(stream(spark, src), sinks.written_once(out), ckpt))
    assert len(rows_of(sinks.read_batches(spark, out, SCHEMA))) == 31


def test_a_half_written_batch_is_not_read_and_is_written_anew(spark, tmp_path):
    out = str(tmp_path / "out")
    writer = sinks.written_once(out)
    writer(spark.createDataFrame([(1, 1, 1, 1.0)], SCHEMA), 0)
    writer(spark.createDataFrame([(2, 1, 1, 1.0)], SCHEMA), 1)
    os.remove(f"{sinks.batch_folder(out, 1)}/_SUCCESS")
    assert [r[0] for r in rows_of(sinks.read_batches(spark, out, SCHEMA))] == [1]
    writer(spark.createDataFrame([(3, 1, 1, 1.0)], SCHEMA), 1)
    assert [r[0] for r in rows_of(sinks.read_batches(spark, out, SCHEMA))] == [1, 3]


def test_the_newest_row_of_each_key_and_compaction(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    add(spark, src, "a", [(1, 1, 5, 1.0), (2, 1, 6, 2.0), (3, 2, 1, 3.0), (4, None, 1, 4.0)])
    now = lambda: rows_of(sinks.current(spark, out, SCHEMA, ["user"], ["at"]).na.fill(-1))
    assert now() == [] and sinks.compact(spark, out, SCHEMA, ["user"], ["at"]) == -1
    ended(sinks.start(stream(spark, src), sinks.keep_newest(out, ["user"], ["at"]), ckpt))
    assert now() == [(2, 1, 6, 2.0), (3, 2, 1, 3.0), (4, -1, 1, 4.0)]
    add(spark, src, "b", [(5, 1, 2, 9.0), (6, 2, 1, 0.5)])  # an older row, and a later one of the same time
    ended(sinks.start(stream(spark, src), sinks.keep_newest(out, ["user"], ["at"]), ckpt))
    want = [(2, 1, 6, 2.0), (4, -1, 1, 4.0), (6, 2, 1, 0.5)]
    assert now() == want and sinks.compact(spark, out, SCHEMA, ["user"], ["at"]) == 1
    before = files(out)
    assert now() == want and sinks.compact(spark, out, SCHEMA, ["user"], ["at"]) == 1 and files(out) == before
    add(spark, src, "c", [(7, 3, 1, 7.0)])
    ended(sinks.start(stream(spark, src), sinks.keep_newest(out, ["user"], ["at"]), ckpt))
    assert now() == [*want, (7, 3, 1, 7.0)]


def test_snapshots_on_demand(spark, tmp_path):
    src, out, asks, target = (str(tmp_path / n) for n in ("in", "out", "asks", "shots"))
    ask = lambda name, ids: spark.createDataFrame([(i,) for i in ids], "request string").coalesce(1).write.parquet(f"{asks}/{name}")
    table = lambda s: sinks.current(s, out, SCHEMA, ["user"], ["at"])
    serve = lambda: ended(sinks.snapshots(stateful.event_stream(spark, f"{asks}/*", "request string"), "request", target, table, str(tmp_path / "ckpt2")))
    update = lambda: ended(sinks.start(stream(spark, src), sinks.keep_newest(out, ["user"], ["at"]), str(tmp_path / "ckpt1")))
    shot = lambda i: rows_of(spark.read.parquet(f"{target}/request={i}"))
    add(spark, src, "a", [(1, 1, 1, 1.0)])
    update()
    ask("first", ["s1", None, "../no", "s1b"])
    serve()
    add(spark, src, "b", [(2, 1, 2, 2.0)])
    update()
    ask("second", ["s2", "s1"])
    serve()
    assert shot("s1") == shot("s1b") == [(1, 1, 1, 1.0)] and shot("s2") == [(2, 1, 2, 2.0)]
    assert sorted(os.listdir(target)) == ["request=s1", "request=s1b", "request=s2"]
    before = files(target)
    serve()
    assert files(target) == before


def test_console_prints_a_bounded_number_of_lines(spark, tmp_path, capsys):
    add(spark, str(tmp_path / "in"), "a", [(i, 1, 1, 40.0 + i) for i in range(5)])
    readings = stream(spark, str(tmp_path / "in")).select(F.col("value").alias("moisture"))
    ended(sinks.console(stateful.control_chain(readings), rows=3, checkpoint=str(tmp_path / "ckpt")))
    lines = [x for x in capsys.readouterr().out.splitlines() if x.startswith("[0]")]
    assert len(lines) == 3 and all("decision=HOLD" in x for x in lines)

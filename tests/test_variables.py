import datetime
import random

import pytest

from loamgrid.streaming import stateful, variables

SCHEMA = "key long, at timestamp, seq long, act string, name string, value double"
START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def by_hand(rows, idle):
    out = []
    for key in sorted({r[0] for r in rows}):
        held, last = {}, None
        for _, when, seq, act, name, value in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
            if last is not None and (when - last).total_seconds() > idle:
                held = {}
                out.append((key, last + datetime.timedelta(seconds=idle), -1, "expired", None, None))
            last = when
            if act == "reset":
                held = {}
            elif act == "assign":
                held[name] = value
            elif act == "add":
                held[name] = value + (held.get(name) or 0.0)
            else:
                out.append((key, when, seq, "read", name, held.get(name)))
    return sorted(out, key=repr)


def random_events(n, seed):
    rng = random.Random(seed)
    now, rows = 0, []
    for i in range(n):
        now += rng.choice([0, 0, 1, 2, 30])
        act = rng.choice(["assign", "add", "read", "read", "reset"] if rng.random() < 0.3 else ["assign", "add", "read", "read"])
        rows.append((rng.randrange(4), at(now), i, act, rng.choice(["x", "y"]), float(rng.randrange(9)) if act in ("assign", "add") else None))
    return rows


def found(df):
    return sorted(((r.key, r["at"], r.seq, r.act, r.name, r.value) for r in df.collect()), key=repr)


@pytest.fixture
def states(spark):
    before = spark.conf.get(variables.PROVIDER[0])
    variables.needs_provider(spark)
    yield
    spark.conf.set(variables.PROVIDER[0], before)


def run(spark, stream, name, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ckpt-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return query


def feed(spark, tmp_path, parts, schema=SCHEMA):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k:03}"))
    for k in range(len(parts)):  # files are read in the order of their times
        for f in (tmp_path / "in" / f"{k:03}").glob("*.parquet"):
            import os

            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    return stateful.event_stream(spark, str(tmp_path / "in" / "*"), schema)


def test_batch_variables_equal_a_loop(spark):
    rows = random_events(600, 1)
    odd = [(None, at(1), 1, "read", "x", None), (1, None, 2, "read", "x", None), (1, at(1), 3, "explode", "x", None)]
    assert found(variables.batch_variables(spark.createDataFrame(rows + odd, SCHEMA).repartition(3), 20)) == by_hand(rows, 20)
    assert variables.batch_variables(spark.createDataFrame([], SCHEMA), 5).count() == 0


def test_variables_live_across_micro_batches(spark, tmp_path, states):
    rows = random_events(120, 2)
    parts = [rows[:40], rows[40:41], rows[41:90], rows[90:]]
    end = [(99, at(100_000), 0, "assign", "x", 1.0)]
    stream = variables.stream_variables(feed(spark, tmp_path, [*parts, end, [(99, at(200_000), 1, "read", "x", None)]]), 20, "0 seconds")
    query = run(spark, stream, "vars", tmp_path)
    assert len([p for p in query.recentProgress if p.numInputRows]) == 6
    wanted = by_hand(rows, 20)
    # The watermark has passed every key's last event by its idle time, so each expires once more.
    for key in {r[0] for r in rows}:
        wanted.append((key, max(r[1] for r in rows if r[0] == key) + datetime.timedelta(seconds=20), -1, "expired", None, None))
    wanted += [(99, at(100_020), -1, "expired", None, None), (99, at(200_000), 1, "read", "x", None)]
    got = [(*r[:5], None if r[5] is None or r[5] != r[5] else r[5]) for r in found(spark.table("vars"))]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_a_restarted_query_goes_on_with_its_state(spark, tmp_path, states):
    stream = feed(spark, tmp_path, [[(1, at(1), 0, "assign", "x", 5.0)]])
    out = str(tmp_path / "out")

    def go():
        query = variables.stream_variables(stream, 1000, "0 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ckpt")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    go()
    spark.createDataFrame([(1, at(2), 1, "add", "x", 2.0), (1, at(3), 2, "read", "x", None)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / "later"))
    go()
    assert [(r.act, r.value) for r in spark.read.schema(SCHEMA).parquet(out).collect()] == [("read", 7.0)]


def test_ticks_drift_by_their_delay(spark, tmp_path, states):
    schema = "key long, at timestamp, value double"
    parts = [[(1, at(0), 1.0), (1, at(1), 2.0)], [(1, at(5), 4.0)], [(1, at(6), 8.0)], [(1, at(20), 16.0)], [(1, at(40), None)]]
    run(spark, variables.periodic(feed(spark, tmp_path, parts, schema), 3, "0 seconds"), "ticks", tmp_path)
    rows = sorted((r.tick, r.due, r.served, r.total, r.n) for r in spark.table("ticks").collect())
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) >= 2
    assert rows[0][1] == at(3)
    for before, after in zip(rows, rows[1:]):
        assert after[1] == before[2] + datetime.timedelta(seconds=3)  # due three seconds after the last one was served
        assert after[2] >= after[1]
    assert sum(r[3] for r in rows) <= 31.0 and rows[0][3] > 0

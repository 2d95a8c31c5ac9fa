import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import ranking

NAN, INF = float("nan"), float("inf")


def found_of(df, by=()):
    return {(*(r[c] for c in by), r.fraction): r["quantile"] for r in df.collect()}


def check(spark, values, fractions):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    found = found_of(ranking.quantiles(df, "x", fractions))
    for f in fractions:
        want = df.agg(F.percentile("x", f)).first()[0]
        assert found[f,] == want or found[f,] == pytest.approx(want, rel=1e-12) or math.isnan(want) and math.isnan(found[f,]), (f, want, found)


FRACTIONS = [0.0, 0.05, 0.25, 0.5, 0.77, 0.95, 1.0]


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(ranking, "FEW", 10)
    monkeypatch.setattr(ranking, "BUCKETS", 16)


@pytest.mark.parametrize("seed", range(4))
def test_random_values_equal_percentile(spark, few, seed):
    rng = random.Random(seed)
    draw = [lambda: rng.gauss(0, 1), lambda: rng.choice([-1.0, 0.0, -0.0, 2.5]), lambda: 10 ** rng.uniform(-300, 300) * rng.choice([-1, 1]), lambda: 1 + rng.random() * 1e-13][seed]
    check(spark, [draw() for _ in range(900)], FRACTIONS)


def test_odd_values(spark, few):
    check(spark, [5.0], FRACTIONS)
    check(spark, [INF, -INF, 1.0, 2.0, INF] * 20, [0.0, 0.4, 0.5, 1.0])
    check(spark, [NAN, 1.0, 2.0, 3.0] * 30, [0.1, 0.5, 1.0])
    check(spark, [5e-324, 1e-323, 1.7e308, -1.7e308, 0.0] * 20, FRACTIONS)
    check(spark, [7.0] * 500 + [8.0], FRACTIONS)


def test_groups_nulls_and_no_rows(spark, few):
    rng = random.Random(9)
    rows = [(rng.choice(["a", None, "b"]), i % 2, rng.choice([None, rng.random(), float(i % 5)])) for i in range(2000)] + [("only nulls", 0, None), ("one", 1, 3.0)]
    df = spark.createDataFrame(rows, "rank string, n int, x double").repartition(4)
    found = found_of(ranking.quantiles(df, "x", FRACTIONS, ["rank", "n"]), ["rank", "n"])
    wanted = {}
    for r in df.groupBy("rank", "n").agg(F.percentile("x", FRACTIONS).alias("p")).collect():
        wanted |= {(r[0], r[1], f): v for f, v in zip(FRACTIONS, r["p"] or [])}
    assert found == pytest.approx(wanted, rel=1e-12) and ("only nulls", 0, 0.5) not in found
    assert ranking.quantiles(df.where("false"), "x", [0.5]).count() == 0
    with pytest.raises(ValueError, match="0 to 1"):
        ranking.quantiles(df, "x", [1.5])


def test_default_sizes_and_integers(spark):
    df = spark.range(200_000).select((F.pmod(F.xxhash64("id"), F.lit(100_003))).alias("v"))
    found = found_of(ranking.quantiles(df, "v", [0.01, 0.5, 0.999]))
    assert found == {(f,): df.agg(F.percentile("v", f)).first()[0] for f in (0.01, 0.5, 0.999)}


def test_no_task_sorts_all_values(spark, few, monkeypatch):
    seen = []
    monkeypatch.setattr(ranking, "durable", lambda df, real=ranking.durable: (seen.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    ranking.quantiles(spark.range(5000).select(F.rand(1).alias("x")), "x", [0.5]).collect()
    for plan in seen:
        assert "percentile" not in plan and "SinglePartition" not in plan, plan


def test_ranks_equal_a_window(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, "hot", "hot", "hot", "x"]), rng.choice([None, *range(20)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(6)
    found = [tuple(r) for r in ranking.ranked(df, ["k"], [F.desc("v"), F.col("id")]).collect()]
    key = lambda r: (r[1] is None, -(r[1] or 0), r[2])
    wanted = []
    for k in (None, "hot", "x"):
        own = sorted((r for r in rows if r[0] == k), key=key)
        wanted += [(*r, i, len(own)) for i, r in enumerate(own)]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
    every = ranking.ranked(df, [], ["id"], rank="place", n="all").collect()
    assert sorted(r.place for r in every) == list(range(3000)) and all(r.place == r.id and r["all"] == 3000 for r in every)
    repeated = ranking.ranked(spark.createDataFrame([(1,)] * 50, "k int"), ["k"], ["k"]).collect()
    assert sorted(r["rank"] for r in repeated) == list(range(50))
    assert ranking.ranked(df.where("false"), ["k"], ["v"]).count() == 0
    assert np.array([r["n"] for r in repeated]).max() == 50

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from loamgrid.functions import masks
from loamgrid.operators import dedupe, sampling
from loamgrid.plans import reports
from loamgrid.plans.catalog import ORACLE, QUERIES
from loamgrid.sources.files import markdown

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n, f in QUERIES.items() if f.__module__ == reports.__name__)


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events", "embeddings", "lineitem", "orders", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    key = lambda r: tuple(map(shown, r))
    assert sorted(map(key, df.select(*columns).collect())) == sorted(map(key, cur.fetchall()))


def test_weighted_draws_follow_the_weights(spark):
    items = spark.createDataFrame([(1, 1.0), (5000, 3.0), (9000, 0.0)], "id long, w double")
    got = [r["id"] for r in sampling.weighted_draws(items, "w", 2000, 7).collect()]
    assert len(got) == 2000 and set(got) == {1, 5000} and abs(got.count(5000) / 2000 - 0.75) < 0.04


def test_pairs_are_of_one_key_or_of_two_classes(spark):
    items = spark.createDataFrame([(i, "ab"[i % 2], i % 3 or None) for i in range(30)], "id long, cls string, leaf long")
    label = {i: "ab"[i % 2] for i in range(30)}
    pairs = sampling.cross_class_pairs(items, "cls", 5, 1).collect()
    assert len(pairs) == 5 and all(label[r["a"]] != label[r["b"]] for r in pairs)
    assert all(r["a"] % 3 == r["b"] % 3 != 0 for r in sampling.same_key_pairs(items, ["cls", "leaf"]).collect())
    assert sampling.cross_class_pairs(items.limit(0), "cls", 5, 1).collect() == []


def test_first_of_equal_digests_stays(spark):
    items = spark.createDataFrame([(3, "x", "d1"), (1, "y", "d1"), (2, "x", "d2"), (4, "x", None), (5, "x", None)], "id long, cls string, digest string")
    assert sorted(r["id"] for r in dedupe.keep_first(items, "digest", ["cls", "id"]).collect()) == [2, 3, 4]


def test_blend_leaves_empty_and_full_masks(spark):
    rows = spark.createDataFrame([(1, [100.0, 50.0], [255.0, 0.0]), (2, [100.0, 50.0], [0.0, 0.0]), (3, [100.0, 50.0], [255.0, 255.0])], "id long, p array<double>, m array<double>")
    got = {r["id"]: r["x"] for r in rows.select("id", masks.blended(F.col("p"), F.col("m"), 128.0).alias("x")).collect()}
    assert got == {1: [100.0, 128.0], 2: [100.0, 50.0], 3: [100.0, 50.0]}


def test_schedule_ends_at_its_floor(spark):
    got = [r[0] for r in spark.range(0, 11).select(masks.warmup_cosine(F.col("id"), 2, 10, 0.1)).collect()]
    assert got[:2] == [0.5, 1.0] and got[2] == 1.0 and math.isclose(got[10], 0.1)


def test_markdown_says_when_rows_are_left_out(spark):
    assert "More than 3 rows" in markdown(spark.range(5), 3) and "More" not in markdown(spark.range(3), 3)

import random

import numpy as np
import pyarrow as pa

import pytest
from pyspark.sql import functions as F

from loamgrid.operators import hamming
from loamgrid.operators.components import connected_components


def hashes(seed, n=500):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(n):
        kind = rng.random()
        h = rng.getrandbits(64) if kind < 0.3 else base[0] if kind < 0.5 else rng.choice(base)
        for _ in range(rng.choice([0, 1, 3, 5, 8]) if kind >= 0.5 else 0):
            h ^= 1 << rng.randrange(64)
        rows.append((i, h - (1 << 64) if h >> 63 else h))
    return rows


def brute(rows, distance):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, ha) in enumerate(rows):
        for b, hb in rows[:i]:
            if ((ha ^ hb) & (2**64 - 1)).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i, _ in rows}


@pytest.mark.parametrize(("distance", "block", "small", "join"), [(4, 512, 8, 1000), (7, 512, 8, 0), (7, 5, 2, 1000), (3, 9, 1, 1000)])
def test_links_connect_as_all_pairs_do(spark, monkeypatch, distance, block, small, join):
    for name, value in (("BLOCK", block), ("SMALL", small), ("MOST_BROADCAST", join)):
        monkeypatch.setattr(hamming, name, value)
    rows = hashes(distance + block)
    df = spark.createDataFrame([*rows, (9999, None)], "id long, h long").repartition(5)
    links = hamming.near_links(df, distance)
    found = {r.node: r.component for r in connected_components(links).collect()}
    assert {i: found.get(i, i) for i, _ in rows} == brute(rows, distance) and 9999 not in found
    by_id = dict(rows)
    assert all(((by_id[r.a] ^ by_id[r.b]) & (2**64 - 1)).bit_count() <= distance for r in links.collect())


def test_a_large_group_gives_few_links(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        h = 0x0123456789ABCDEF
        for _ in range(3):
            h ^= 1 << rng.randrange(62)
        rows.append((i, h))
    df = spark.createDataFrame(rows, "id long, h long")
    assert hamming.near_links(df, 7).count() < 36 * (3000 + 100)
    assert hamming.near_links(df.where("false"), 7).count() == 0


def all_pairs(rows, distance):
    return {(a, b, d) for a, ha in rows for b, hb in rows if a < b and (d := ((ha ^ hb) & (2**64 - 1)).bit_count()) <= distance}


@pytest.mark.parametrize(("distance", "shared", "block", "steps", "join"), [(7, None, 8192, 48, 1000), (7, 2, 7, 3, 1000), (4, 3, 50, 2, 0), (0, 2, 20, 1, 1000)])
def test_pairs_of_large_buckets_are_compared_in_parts(spark, monkeypatch, distance, shared, block, steps, join):
    for name, value in (("BLOCK", block), ("STEPS", steps), ("MOST_BROADCAST", join), ("COMPARED", 100)):
        monkeypatch.setattr(hamming, name, value)
    rows = hashes(distance + block, 400)
    df = spark.createDataFrame([*rows, (9999, None)], "id long, h long").repartition(5)
    found = [tuple(r) for r in hamming.near_pairs(df, distance, shared=shared).collect()]
    assert len(found) == len(set(found)) and set(found) == all_pairs(rows, distance)


def test_pairs_keep_the_kind_of_key_and_meet_no_row_pairs_in_the_engine(spark):
    rows = hashes(3, 200)
    df = spark.createDataFrame([(f"k{i:04d}", h) for i, h in rows], "id string, h long")
    near = hamming.near_pairs(df, 7)
    assert near.dtypes == [("a", "string"), ("b", "string"), ("distance", "int")]
    assert {(int(r.a[1:]), int(r.b[1:]), r.distance) for r in near.collect()} == all_pairs(rows, 7)
    # the join of a bucket's rows with themselves grew with the square of its size, a row for each pair that it met
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(") <= 2 and "Join Inner" not in plan


@pytest.mark.parametrize(("shared", "block", "steps", "rows_an_item"), [(2, 8192, 48, 8), (2, 2, 3, 8), (3, 3, 2, 36), (1, 4, 3, 8)])
def test_items_are_dealt_by_their_first_pieces_and_pairs_not_at_all(spark, monkeypatch, shared, block, steps, rows_an_item):
    from loamgrid.operators import fingerprints

    for name, value in (("BLOCK", block), ("STEPS", steps), ("COMPARED", 50)):
        monkeypatch.setattr(hamming, name, value)
    monkeypatch.setattr(fingerprints, "PAIRS", 70)
    keyed = []
    monkeypatch.setattr(hamming, "_keyed", lambda *a, f=hamming._keyed: keyed.append(f(*a)) or keyed[-1])
    rng = random.Random(block)
    rows = [(f"k{i:04d}", h, f"s{rng.randrange(3)}", [rng.randrange(9) for _ in range(6)] if i % 9 else None) for i, h in hashes(block, 300)]
    df = spark.createDataFrame(rows, "id string, h long, site string, feature array<int>").repartition(4)
    found = fingerprints.near_correlated(df, 7, -0.2, ["site"], shared=shared)
    assert found.columns == ["a", "b", "distance", "site_a", "site_b", "r"]
    want = fingerprints.correlated(hamming.near_pairs(df.where("feature is not null"), 7), df.select("id", "feature"), -0.2).collect()
    site = {r[0]: r[2] for r in rows}
    got = {(r.a, r.b): r for r in found.collect()}
    assert len(got) == found.count() and {k: (r.distance, r.r) for k, r in got.items()} == {(r.a, r.b): (r.distance, r.r) for r in want}
    assert all((r.site_a, r.site_b) == (site[r.a], site[r.b]) for r in got.values())
    # it was a row for each choice of two pieces, 36, and pairs were joined with the features of both ends
    assert keyed[0].count() == rows_an_item * sum(r[3] is not None for r in rows)
    assert "Join Inner" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_features_are_unfolded_once_for_all_pairs_of_a_step(spark, monkeypatch):
    from loamgrid.operators import fingerprints, hamming

    seen = {}
    monkeypatch.setattr(fingerprints, "_packed", lambda rows, feature: rows.select("id", "h", F.lit(b"").alias("p")))
    monkeypatch.setattr(hamming, "near_pairs", lambda *a: seen.update(score=a[-1][1]))
    fingerprints.near_correlated(spark.createDataFrame([], "id long, h long, feature array<double>"), 4, -1.0)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (40, 16)).astype(np.uint8)
    a, b = np.triu_indices(40, 1)
    asked = []
    scores = fingerprints._scores
    monkeypatch.setattr(fingerprints, "_scores", lambda p: asked.append(len(p)) or scores(p))
    monkeypatch.setattr(fingerprints, "PAIRS", 25)
    monkeypatch.setattr(fingerprints, "FEW", 7)
    r = seen["score"](pa.array([b"\1" + v.tobytes() for v in x], pa.binary()), a, b)
    assert np.allclose(r, np.corrcoef(x)[a, b])
    # a feature was unfolded again for each lot of pairs that it is in
    assert sum(asked) == 40

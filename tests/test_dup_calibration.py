import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import calibration

SCHEMA = "id long, cls string, leaf string, shot string, h long, feature array<double>"


def items(n, seed):
    rng, pick = np.random.default_rng(seed), random.Random(seed)
    base = rng.normal(size=(20, 12))
    rows = []
    for i in range(n):
        k = pick.randrange(20)
        f = base[k] + rng.normal(size=12) * pick.choice([0.0, 0.1, 1.0])
        hash_ = (k * 0x9E3779B97F4A7C15) % 2**63 ^ (1 << pick.randrange(60))
        rows.append((i, "abc"[k % 3], pick.choice(["hot", "hot", f"l{k}", None]), pick.choice(["1", None]), hash_, None if i % 41 == 0 else [2.0] * 12 if i % 43 == 0 else f.tolist()))
    return rows


def correlation(a, b):
    x, y = np.array(a) - np.mean(a), np.array(b) - np.mean(b)
    d = np.sqrt((x @ x) * (y @ y))
    return 0.0 if d < 1e-9 else float(x @ y / d)


@pytest.mark.parametrize("block", [1, 7, 256])
def test_all_pairs_of_a_key_equal_brute_force(spark, block):
    rows = items(300, 1)
    found = {r.value: r.n for r in calibration.same_key_measures(spark.createDataFrame(rows, SCHEMA).repartition(5), ["cls", "leaf", "shot"], block=block).collect()}
    want = Counter()
    good = [r for r in rows if None not in (r[1], r[2], r[3], r[5])]
    for i, a in enumerate(good):
        for b in good[i + 1 :]:
            if a[1:4] == b[1:4]:
                want[round(correlation(a[5], b[5]), 5) + 0.0] += 1
    assert sum(found.values()) == sum(want.values())
    near = lambda c: np.sort(np.repeat(list(c.keys()), list(c.values())))
    assert np.abs(near(found) - near(want)).max() < 2e-5


def test_quantiles_of_counts(spark):
    rng = random.Random(3)
    values = [rng.choice([0.1, 0.25, -0.5, rng.random()]) for _ in range(501)]
    df = spark.createDataFrame([(round(v, 5),) for v in values], "r double")
    out = {r.population: r for r in calibration.summary({"some": calibration.counted(df), "none": calibration.counted(df.where("false"))}, [0.05, 0.5, 0.99]).collect()}
    p = df.agg(F.percentile("r", [0.05, 0.5, 0.99])).first()[0]
    assert [out["some"].p05, out["some"].p50, out["some"].p99] == pytest.approx(p) and out["some"].n == 501
    assert tuple(out["none"]) == ("none", 0, None, None, None, None, None)


def test_the_whole_calibration(spark):
    rows = items(250, 4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    measured, sweep = calibration.calibrate_duplicates(df, ["cls", "leaf", "shot"], "cls", "h", "feature", [0.8, 0.95], distance=4, negatives=200, seed=1)
    out = {r.population: r for r in measured.collect()}
    assert set(out) == {"same key", "cross class", "candidates"} and out["cross class"].n > 150
    by_id = {r[0]: r for r in rows}
    candidates = [(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if (a[4] ^ b[4]).bit_count() <= 4]
    scored = [(correlation(by_id[a][5], by_id[b][5]), by_id[a][1] != by_id[b][1]) for a, b in candidates if by_id[a][5] and by_id[b][5]]
    assert out["candidates"].n == len(scored)
    assert out["candidates"].p50 == pytest.approx(np.median([s[0] for s in scored]), abs=1e-5)
    for r in sweep.collect():
        assert r.kept == sum(s[0] >= r.threshold for s in scored) and r.crossing == sum(s[0] >= r.threshold and s[1] for s in scored)


def test_no_items(spark):
    measured, sweep = calibration.calibrate_duplicates(spark.createDataFrame([], SCHEMA), ["cls", "leaf", "shot"], "cls", "h", "feature", [0.8])
    assert [(r.population, r.n) for r in measured.orderBy("population").collect()] == [("candidates", 0), ("cross class", 0), ("same key", 0)] and sweep.count() == 0


def test_many_small_groups_give_one_lot_of_counts_a_task(spark):
    rows = [(i, "a", f"k{i // 2}", "1", 0, [float(i % 2), 1.0, 0.5 * (i % 3)]) for i in range(6000)]
    found = calibration.same_key_measures(spark.createDataFrame(rows, SCHEMA), ["cls", "leaf", "shot"])
    assert sum(r.n for r in found.collect()) == 3000
    # a call for each group cost milliseconds, whatever its size
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_pairs_of_near_texts_are_not_joined_with_features(spark, tmp_path, monkeypatch):
    from loamgrid.operators import fingerprints
    from loamgrid.plans import integrity

    docs = [(i, "abc"[i % 3], "s", " ".join(f"w{(i // 4) * 31 + k}" for k in range(60)) + f" x{i}") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    # the rows of such a join grew with the pairs, nearly by the square of the table
    monkeypatch.setattr(fingerprints, "correlated", None)
    row = integrity.q_dup_calibration(spark, str(tmp_path)).collect()[0]
    assert row.n >= 40 and 0.9 < row.lo <= row.p05 <= row.p50 <= row.p95 <= row.hi <= 1

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.functions import pooling


def weights(rng, channels, hidden):
    w1, b1, w2 = rng.normal(size=(hidden, channels)), rng.normal(size=hidden), rng.normal(size=hidden)
    lit = lambda a: F.array(*map(F.lit, a.tolist()))
    return (w1, b1, w2, 0.3), (F.array(*[lit(r) for r in w1]), lit(b1), lit(w2), F.lit(0.3))


def test_poolings_equal_numpy(spark):
    rng = np.random.default_rng(0)
    maps = rng.random((4, 6, 49)) + 0.1
    (w1, b1, w2, b2), cols = weights(rng, 6, 3)
    df = spark.createDataFrame([(k, m.tolist()) for k, m in enumerate(maps)], "k int, m array<array<double>>")
    found = {}
    for kind in ("gem", "avg", "max", "concat", "attention"):
        pool, size = pooling.pooling(kind, 6, cols)
        found[kind] = np.array([r.v for r in df.select("k", pool(F.col("m")).alias("v")).orderBy("k").collect()])
        assert found[kind].shape == (4, size)
    gem = (maps**3).mean(axis=2) ** (1 / 3)
    score = np.einsum("h,bhp->bp", w2, np.maximum(np.einsum("hc,bcp->bhp", w1, maps) + b1[:, None], 0)) + b2
    soft = np.exp(score - score.max(axis=1, keepdims=True))
    soft /= soft.sum(axis=1, keepdims=True)
    want = {"gem": gem, "avg": maps.mean(axis=2), "max": maps.max(axis=2), "concat": np.concatenate([gem, maps.max(axis=2)], axis=1), "attention": np.einsum("bcp,bp->bc", maps, soft)}
    for kind, value in want.items():
        assert found[kind] == pytest.approx(value, rel=1e-9)
    flat = df.select(pooling.generalised(F.col("m"), 1.0).alias("v")).first().v
    assert flat == pytest.approx(maps[0].mean(axis=1))


def test_unknown_poolings_are_errors():
    with pytest.raises(ValueError, match="attention needs weights"):
        pooling.pooling("attention", 4)
    with pytest.raises(ValueError, match="no pooling 'sum'"):
        pooling.pooling("sum", 4, (None,) * 4)

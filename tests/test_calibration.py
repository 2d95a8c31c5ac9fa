import math

import numpy as np
import pytest

from loamgrid.operators import metrics


def loss(z, y, t):
    z = z / t
    m = z.max(axis=1)
    return float((m + np.log(np.exp(z - m[:, None]).sum(axis=1)) - z[np.arange(len(z)), y]).mean())


def frame(spark, z, y):
    return spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(z, y)], "logits array<double>, label int").repartition(3)


def sharp(n=400, classes=15, by=5.0, seed=42):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, classes)) * by, rng.integers(0, classes, n)


def informed(n=500, by=0.7, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 6, n)
    z = rng.normal(size=(n, 6))
    z[np.arange(n), y] += 2.0
    return z * by, y


@pytest.mark.parametrize("by", [0.05, 0.7, 12.0])
def test_agrees_with_a_fine_grid(spark, by):
    z, y = informed(by=by)
    r = metrics.minimised_temperature(frame(spark, z, y)).first()
    grid = r.temperature * np.linspace(0.99, 1.01, 2001)
    best = grid[np.argmin([loss(z, y, t) for t in grid])]
    assert r.temperature == pytest.approx(best, rel=1e-4) and abs(r.slope) < 1e-6 and r.steps < 30
    assert r.nll == pytest.approx(loss(z, y, r.temperature), rel=1e-9)
    wide = np.geomspace(metrics.COLDEST, 100, 4000)
    assert min(loss(z, y, t) for t in wide) >= r.nll - 1e-9


def test_overconfident_logits_get_a_higher_temperature(spark):
    z, y = sharp(100)
    assert metrics.minimised_temperature(frame(spark, z, y), start=1.0).first().temperature > 1.0


def test_the_range_bounds_a_loss_without_minimum(spark):
    right = np.eye(3)[[0, 1, 2] * 5]
    assert metrics.minimised_temperature(frame(spark, right, [0, 1, 2] * 5)).first().temperature == pytest.approx(metrics.COLDEST, rel=1e-3)
    assert metrics.minimised_temperature(frame(spark, right, [1, 2, 0] * 5)).first().temperature == pytest.approx(metrics.HOTTEST, rel=1e-3)


def test_flat_logits_and_no_rows(spark):
    flat = metrics.minimised_temperature(frame(spark, np.zeros((4, 3)), [0, 1, 2, 0])).first()
    assert flat.nll == pytest.approx(math.log(3))
    none = metrics.minimised_temperature(frame(spark, np.zeros((1, 3)), [0]).where("false")).first()
    assert (none.temperature, none.nll, none.slope) == (None, None, None)


def test_rows_without_use_do_not_count(spark):
    z, y = informed(120)
    good = [(v.tolist(), int(k)) for v, k in zip(z, y)]
    odd = [(None, 1), ([1.0, None, 0.0], 0), ([1.0, float("nan")], 0), ([float("inf"), 1.0], 1), ([1.0, 2.0], None), ([1.0, 2.0], 2), ([1.0, 2.0], -1), ([], 0)]
    both = [metrics.minimised_temperature(spark.createDataFrame(r, "logits array<double>, label int")).first().temperature for r in (good, good + odd)]
    assert both[0] == pytest.approx(both[1], rel=1e-9)


def test_calibration_as_one_call(spark):
    (vz, vy), (tz, ty) = informed(600, 3.0, 1), informed(500, 3.0, 2)
    oz = np.random.default_rng(7).normal(size=(200, 6)) * 0.3
    r = metrics.calibrate(frame(spark, vz, vy), frame(spark, tz, ty), frame(spark, oz, np.zeros(200))).first()
    grid = np.linspace(0.2, 20, 40_000)
    t = r.temperature
    assert min(loss(vz, vy, x) for x in grid[::50]) >= loss(vz, vy, t) - 1e-9
    energy = lambda z: -t * np.log(np.exp(z / t).sum(axis=1))
    assert r.energy_threshold == pytest.approx(np.percentile(energy(vz), 95))
    assert r.fpr == pytest.approx((energy(oz) <= r.energy_threshold).mean())
    both = np.subtract.outer(energy(oz), energy(tz))
    assert r.ood_auroc == pytest.approx((both > 0).mean() + (both == 0).mean() / 2)

    def ece(z):
        p = np.exp(z - z.max(axis=1)[:, None])
        p /= p.sum(axis=1)[:, None]
        c, hit = p.max(axis=1), p.argmax(axis=1) == ty
        b = np.ceil(c * 10)
        return sum(abs(c[b == k].mean() - hit[b == k].mean()) * (b == k).sum() for k in np.unique(b)) / len(c)

    assert r.uncalibrated_ece == pytest.approx(ece(tz)) and r.calibrated_ece == pytest.approx(ece(tz / t))
    assert r.calibrated_ece < r.uncalibrated_ece

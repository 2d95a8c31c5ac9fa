import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.functions import models, signal, tensor, text, vec
from loamgrid.operators import hamming, metrics, predict, splits


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def array(values):
    return F.array(*[F.lit(float(v)) for v in values])


GOLDEN = [
    ("00fc2ee5-x___RS_HL 1864.JPG", "RS_HL", "RS_HL 1864", "", ""),
    ("000146ff-x___GH_HL Leaf 259.1.JPG", "GH_HL", "GH_HL Leaf 259", "1", ""),
    ("d0badc95-x___GHLB Leaf 10 Day 6.jpeg", "GHLB", "GHLB Leaf 10", "", "6"),
    ("x___GHLB Leaf 2.1 Day 16.JPG", "GHLB", "GHLB Leaf 2", "1", "16"),
    ("svn-r6Yb5c.JPG", "svn-r6Yb5c", "svn-r6Yb5c", "", ""),
]


def test_parse_filename(spark):
    rows = spark.createDataFrame([(g[0],) for g in GOLDEN], "name string").select("name", text.parse_filename(F.col("name")).alias("p")).collect()
    assert [(r["name"], r["p"]["site"], r["p"]["leaf_core"], r["p"]["shot"], r["p"]["day"]) for r in rows] == GOLDEN


def test_hash_hex_round_trip(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    rows = spark.createDataFrame([(v,) for v in values], "h long").select("h", text.hash_to_hex(F.col("h")).alias("x"), text.hex_to_hash(text.hash_to_hex(F.col("h"))).alias("back")).collect()
    assert all(r["h"] == r["back"] and len(r["x"]) == 16 for r in rows)


@pytest.mark.parametrize("distance", [2, 4, 7])
def test_near_pairs_equal_brute_force(spark, distance):
    rng = random.Random(0)
    hashes = [rng.getrandbits(64) for _ in range(300)]
    hashes += [hashes[k] ^ (1 << k) for k in range(20)] + [hashes[k] ^ sum(1 << b for b in rng.sample(range(64), 6)) for k in range(20)]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    got = hamming.near_pairs(spark.createDataFrame(list(enumerate(signed)), "id long, h long"), distance).collect()
    want = {(i, j) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if (hashes[i] ^ hashes[j]).bit_count() <= distance}
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want


def test_softmax_energy_and_losses(spark):
    peaked, flat = array([10, 0, 0, 0]), array([1, 1, 1, 1])
    r = one(spark, p=vec.softmax(peaked), a=vec.energy(peaked), b=vec.energy(flat), hot=vec.one_hot(F.lit(2), 5, 0.1), kl=vec.distillation(peaked, peaked, vec.one_hot(F.lit(0), 4), 1.0))
    assert sum(r["p"]) == pytest.approx(1) and r["a"] < r["b"]
    assert r["hot"] == pytest.approx([0.02, 0.02, 0.92, 0.02, 0.02]) and r["kl"] == pytest.approx(0, abs=1e-9)


def test_pearson_of_copies_and_noise(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=200), rng.normal(size=200)
    r = one(spark, same=vec.pearson(array(a), array(a)), other=vec.pearson(array(a), array(b)), flat=vec.zscore(array([3, 3, 3])))
    assert r["same"] == pytest.approx(1) and r["other"] == pytest.approx(np.corrcoef(a, b)[0, 1]) and r["flat"] == [0, 0, 0]


def test_expected_calibration_error(spark):
    rows = spark.createDataFrame([(0.9, True)] * 4, "confidence double, correct boolean")
    bins = metrics.calibration_bins(rows, 10)
    assert bins.count() == 10
    assert metrics.expected_calibration_error(bins).first()["ece"] == pytest.approx(0.1)


def test_auroc_with_ties(spark):
    rows = [(0.1, False), (0.4, True), (0.4, False), (0.8, True), (0.8, True), (0.2, False)]
    want = np.mean([1.0 if p > q else 0.5 if p == q else 0.0 for p, y in rows if y for q, z in rows if not z])
    assert metrics.auroc(spark.createDataFrame(rows, "s double, y boolean"), "s", "y").first()["auroc"] == pytest.approx(want)


def test_over_confident_logits_need_heat(spark):
    rng = np.random.default_rng(42)
    rows = [(rng.normal(size=15).dot(5 * np.eye(15)).tolist(), int(rng.integers(15))) for _ in range(100)]
    grid = [0.5, 1.0, 2.0, 5.0, 20.0]
    assert metrics.fit_temperature(spark.createDataFrame(rows, "logits array<double>, label int"), grid).first()["temperature"] > 1


def test_first_rule_names_the_reason_and_null_gates_fail(spark):
    rows = spark.createDataFrame([(0.01, 0.1, 0.9), (0.99, 0.9, 0.0), (0.5, 0.9, 0.9), (0.5, 0.9, 0.0), (None, None, None)], "area_frac double, largest_cc_frac double, leak_frac double")
    assert [r[0] for r in rows.select(predict.quality_reason()).collect()] == ["area too small", "area too large", "leaks", "", ""]
    r = one(spark, a=predict.passes(F.lit(True), F.lit(None).cast("boolean")), b=predict.passes(F.lit(True)))
    assert r["a"] is False and r["b"] is True


def test_splits_keep_groups_whole(spark):
    rng = random.Random(7)
    rows = [(i, f"c{rng.randrange(3)}", f"s{rng.randrange(6)}", i - i % 4) for i in range(1200)]
    items = spark.createDataFrame(rows, "id long, cls string, site string, group_id long")
    items = items.join(items.groupBy("group_id").agg(F.min("cls").alias("c"), F.min("site").alias("s")), "group_id").select("id", F.col("c").alias("cls"), F.col("s").alias("site"), "group_id")
    made = splits.build_splits(items, "cls", "site", least=4)
    held = splits.holdout_sites(items, "cls", "site", 4).select("cls", "site")
    assert made.count() == 1200 and splits.verify_splits(made, "cls", "site", ["group_id", "id"], held).count() == 0
    n = {r["split"]: r["count"] for r in made.groupBy("split").count().collect()}
    rest = sum(v for k, v in n.items() if k != "test_site")
    assert all(abs(n[k] / rest - share) < 0.03 for k, share in (("train", 0.70), ("val", 0.15), ("test", 0.15)))


def test_tensor_shapes(spark):
    a = array(range(1, 17))
    rows = tensor.reshape(a, 4)
    r = one(spark, t=tensor.transpose(rows), avg=tensor.average_pool(rows, 2), mx=tensor.max_pool(rows, 2), mm=tensor.matmul(rows, rows), back=tensor.depth_to_space(tensor.space_to_depth(rows, 2), 2), conv=tensor.conv2d(rows, [[1.0, 0.0], [0.0, -1.0]]), cs=tensor.cumsum(a, exclusive=True), mp=tensor.mirror_pad(a, 2, 1), rs=tensor.resize_nearest(rows, 2, 2))
    m = np.arange(1, 17).reshape(4, 4)
    assert r["t"] == m.T.tolist() and r["mm"] == (m @ m).tolist() and r["back"] == m.tolist()
    assert r["avg"] == m.reshape(2, 2, 2, 2).mean(axis=(1, 3)).tolist() and r["mx"] == m.reshape(2, 2, 2, 2).max(axis=(1, 3)).tolist()
    assert r["conv"] == (m[:-1, :-1] - m[1:, 1:]).tolist() and r["cs"] == np.concatenate([[0], np.cumsum(np.arange(1, 16))]).tolist()
    assert r["mp"][:3] == [3, 2, 1] and r["mp"][-2:] == [16, 15] and r["rs"] == [[1, 3], [9, 11]]


def test_signals_equal_numpy(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=32), rng.normal(size=5)
    q = np.array([0.5, 0.5, -0.5, 0.5])
    r = one(spark, conv=signal.convolve(array(a), array(b)), corr=signal.correlate(array(a), array(b)), fir=signal.fir(array(a), b.tolist()), fft=signal.RFFT(array(a)), dct=signal.DCT4(array(a)), inv=signal.MATRIX_INVERSE(array([2, 1, 1, 3])), rot=signal.quaternion_rotation(array(q)), qq=signal.quaternion_product(array(q), signal.quaternion_inverse(array(q))), lin=signal.linear_interpolate(array([0, 10, 20]), F.lit(1.25)))
    assert r["conv"] == pytest.approx(np.convolve(a, b)) and r["corr"] == pytest.approx(np.correlate(a, b, "full"))
    assert r["fir"] == pytest.approx(np.convolve(a, b)[:32]) and r["fft"][2:4] == pytest.approx([np.fft.rfft(a)[1].real, np.fft.rfft(a)[1].imag])
    assert signal.dct4(signal.dct4(a)) == pytest.approx(a) and r["inv"] == pytest.approx([0.6, -0.2, -0.2, 0.4])
    assert r["qq"] == pytest.approx([1, 0, 0, 0]) and abs(np.linalg.det(np.array(r["rot"]).reshape(3, 3)) - 1) < 1e-9 and r["lin"] == pytest.approx(12.5)


def test_recursions(spark):
    assert signal.dtw(np.array([1.0, 2, 3]), np.array([1.0, 1, 2, 3])) == 0
    r = np.array([1.0, 0.5, 0.25])
    assert signal.levinson_durbin(r) == pytest.approx([0.5, 0.0])
    assert signal.biquad(np.array([1.0, 0, 0]), 1, 0, 0, 0.5, 0).tolist() == [1, 0.5, 0.25]
    errors = signal.lms(np.ones(200), np.ones(200) * 2, 1, 0.1)
    assert abs(errors[-1]) < 1e-3 and math.isfinite(errors[0])


def test_models(spark):
    rng = np.random.default_rng(9)
    x, sv, w = rng.normal(size=3), rng.normal(size=(2, 3)), [0.7, -0.4]
    got = one(spark, lin=models.svm_decision(array(x), sv.tolist(), w, 0.1), rbf=models.svm_decision(array(x), sv.tolist(), w, 0.1, "rbf", 0.5), poly=models.svm_decision(array(x), sv.tolist(), w, 0.1, "polynomial", 0.5, 1.0, 2), sig=models.svm_decision(array(x), sv.tolist(), w, 0.1, "sigmoid", 0.5, 1.0), bary=models.barycenter(F.array(array([0, 0]), array([2, 4])), array([1, 3])))
    assert got["lin"] == pytest.approx(w @ (sv @ x) + 0.1) and got["rbf"] == pytest.approx(w @ np.exp(-0.5 * ((sv - x) ** 2).sum(1)) + 0.1)
    assert got["poly"] == pytest.approx(w @ (0.5 * sv @ x + 1) ** 2 + 0.1) and got["sig"] == pytest.approx(w @ np.tanh(0.5 * sv @ x + 1) + 0.1)
    assert got["bary"] == pytest.approx([1.5, 3.0])
    assert models.pid(np.ones(3), 1.0, 0.5, 0.0).tolist() == [1.5, 2.0, 2.5]
    assert models.svdf(np.array([1.0, 0, 0]), np.array([2.0]), np.array([0.5, 1.0])).tolist() == [2.0, 1.0, 0.0]
    assert models.lstm(np.zeros((2, 1)), np.zeros((4, 1)), np.zeros((4, 1)), np.zeros(4)).tolist() == [[0.0], [0.0]]
    k = np.arange(5.0)
    assert models.spline(k, 2 * k + 1, np.array([0.5, 3.25])) == pytest.approx([2.0, 7.5])
    a = rng.normal(size=(4, 4))
    low, d = models.ldlt(a @ a.T)
    assert low @ np.diag(d) @ low.T == pytest.approx(a @ a.T)
    v, tau = models.householder(x)
    assert (x - tau * v * (v @ x))[1:] == pytest.approx([0, 0], abs=1e-12)

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.functions import text, vec
from loamgrid.operators import hamming, resize


def weights(n, to):
    """Rows of a matrix, by the definition of the kernel."""
    scale = n / to
    wide = max(scale, 1.0)
    out = np.zeros((to, n))
    for k in range(to):
        centre = (k + 0.5) * scale
        first, end = max(0, int(math.floor(centre - 3 * wide + 0.5))), min(n, int(math.floor(centre + 3 * wide + 0.5)))
        x = (np.arange(first, end) - centre + 0.5) / wide
        w = np.where(np.abs(x) >= 3, 0.0, np.sinc(x) * np.sinc(x / 3))
        out[k, first:end] = w / w.sum()
    return out


def by_hand(picture, height, width):
    whole = lambda m: np.floor(m * 2**22 + 0.5).astype(np.int64)
    level = lambda s: np.clip((s + 2**21) >> 22, 0, 255)
    across = level(picture.astype(np.int64) @ whole(weights(picture.shape[1], width)).T)
    return level(whole(weights(picture.shape[0], height)) @ across)


def frame(spark, pictures):
    return spark.createDataFrame([(k, y, [float(v) for v in row]) for k, p in pictures.items() for y, row in enumerate(p)], "image long, y int, v array<double>").repartition(4)


def pictures(n=12, seed=0):
    rng = np.random.default_rng(seed)
    shapes = [(40, 61), (8, 9), (7, 3), (1, 1), (33, 200), (100, 12)]
    return {k: rng.integers(0, 256, shapes[k % len(shapes)]) for k in range(n)}


@pytest.mark.parametrize("join", [2000, 0])
@pytest.mark.parametrize(("height", "width"), [(8, 9), (32, 32), (1, 5)])
def test_sizes_equal_numpy(spark, monkeypatch, height, width, join):
    monkeypatch.setattr(resize, "MOST_SIZES", join)
    found = {(r.image, r.y): r.v for r in resize.resize(frame(spark, pictures()), height, width).collect()}
    for k, p in pictures().items():
        want = by_hand(p, height, width)
        assert [found[k, y] for y in range(height)] == want.tolist(), k
    assert len(found) == height * len(pictures())


def test_bands_agree_with_the_kernel(spark):
    for n, to in ((61, 9), (9, 9), (5, 32), (1, 4)):
        row = resize.bands(spark.createDataFrame([(n,)], "size int"), to).first()
        found = np.zeros((to, n))
        for k, b in enumerate(row.bands):
            found[k, b["first"] : b["first"] + len(b.ws)] = b.ws
        assert np.abs(found / 2**22 - weights(n, to)).max() < 2**-22
        assert np.abs(found.sum(axis=1) / 2**22 - 1).max() < n * 2**-22


def test_a_picture_of_the_same_size_stays(spark):
    p = {1: np.arange(63).reshape(7, 9) * 4}
    assert [r.v for r in resize.resize(frame(spark, p), 7, 9).orderBy("y").collect()] == p[1].tolist()


def test_hashes_of_bits_and_hex(spark):
    ramp = np.tile(np.arange(90) * 2, (40, 1))
    shapes = {1: ramp, 2: ramp[:, ::-1], 3: np.full((30, 30), 7), 4: np.concatenate([ramp[:20], ramp[:20, ::-1]])}
    found = {r.image: (r.h, r.hex) for r in resize.dhash(frame(spark, shapes)).withColumn("hex", text.hash_to_hex(F.col("h"))).collect()}
    assert found[1] == (-1, "f" * 16) and found[2][1] == found[3][1] == "0" * 16 and found[4][1] == "ffffffff00000000"
    rng = np.random.default_rng(5)
    noisy = {k: rng.integers(0, 256, (25, 31)) for k in range(20)}
    hashes = {r.image: r.h & (2**64 - 1) for r in resize.dhash(frame(spark, noisy)).collect()}
    for k, p in noisy.items():
        small = by_hand(p, 8, 9)
        assert hashes[k] == int("".join("01"[int(b)] for b in (small[:, 1:] > small[:, :-1]).ravel()), 2)
    with pytest.raises(ValueError, match="64 bits"):
        resize.dhash(frame(spark, shapes), 9)


def test_thumbnails_confirm_copies_only(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 255, (64, 64))
    shapes = {0: a, 1: a.copy(), 2: rng.integers(0, 255, (64, 64))}
    thumbs = resize.thumbnails(frame(spark, shapes)).select(F.col("image").alias("id"), F.col("thumb").cast("array<double>").alias("feature"))
    assert thumbs.select(F.size("feature")).distinct().collect() == [(1024,)]
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    kept = hamming.confirmed(pairs, thumbs, vec.pearson, 0.9).collect()
    assert [(r.a, r.b) for r in kept] == [(0, 1)] and kept[0].r == pytest.approx(1.0)


def test_no_pictures(spark):
    assert resize.dhash(frame(spark, {1: np.zeros((1, 1))}).where("false")).count() == 0
    assert resize.thumbnails(spark.createDataFrame([(1, 0, [])], "image long, y int, v array<double>")).count() == 0

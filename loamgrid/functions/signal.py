"""Signal functions: column expressions where a fold or lookup does, NumPy batches where a recursion is needed."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loamgrid.functions import vec

#: Cosine-series coefficients of window functions, signs alternating from plus.
COSINE_WINDOWS = {
    "hanning": (0.5, 0.5),
    "hamming": (0.54, 0.46),
    "blackman_harris_92db": (0.35875, 0.48829, 0.14128, 0.01168),
    "nuttall3": (0.375, 0.5, 0.125),
    "nuttall3a": (0.40897, 0.5, 0.09103),
    "nuttall3b": (0.4243801, 0.4973406, 0.0782793),
    "nuttall4": (0.3125, 0.46875, 0.1875, 0.03125),
    "nuttall4a": (0.338946, 0.481973, 0.161054, 0.018027),
    "nuttall4b": (0.355768, 0.487396, 0.144232, 0.012604),
    "nuttall4c": (0.3635819, 0.4891775, 0.1365995, 0.0106411),
    "hft90d": (1.0, 1.942604, 1.340318, 0.440811, 0.043097),
    "hft95": (1.0, 1.9383379, 1.3045202, 0.4028270, 0.0350665),
    "hft116d": (1.0, 1.9575375, 1.4780705, 0.6367431, 0.1228389, 0.0066288),
    "hft144d": (1.0, 1.96760033, 1.57983607, 0.81123644, 0.22583558, 0.02773848, 0.00090360),
    "hft169d": (1.0, 1.97441842, 1.65409888, 0.95788186, 0.33673420, 0.06364621, 0.00521942, 0.00010599),
    "hft196d": (1.0, 1.979280420, 1.710288951, 1.081629853, 0.448734314, 0.112376628, 0.015122992, 0.000871252, 0.000011896),
    "hft223d": (1.0, 1.98298997309, 1.75556083063, 1.19037717712, 0.56155440797, 0.17296769663, 0.03233247087, 0.00324954578, 0.00013801040, 0.00000132725),
    "hft248d": (1.0, 1.985844164102, 1.791176438506, 1.282075284005, 0.667777530266, 0.240160796576, 0.056656381764, 0.008134974479, 0.000624544650, 0.000019808998, 0.000000132974),
}


def window(name: str, n: int) -> Column:
    """``n`` coefficients of a periodic window function."""
    at = F.sequence(F.lit(0), F.lit(n - 1))
    if name == "bartlett":
        return F.transform(at, lambda i: F.when(i * 2 <= n, i * 2.0 / n).otherwise(2 - i * 2.0 / n))
    if name == "welch":
        return F.transform(at, lambda i: 1 - (i * 2.0 / n - 1) * (i * 2.0 / n - 1))
    series = COSINE_WINDOWS[name]
    return F.transform(at, lambda i: sum((F.lit((-1) ** k * c) * F.cos(i * (2 * math.pi * k / n)) for k, c in enumerate(series)), F.lit(0.0)))


def shifted_dot(a: Column, taps: Column, at: Column) -> Column:
    """sum taps[k] * a[at - k], positions outside the array being 0."""
    return F.aggregate(F.transform(taps, lambda t, k: t * F.coalesce(F.when((at - k >= 0) & (at - k < F.size(a)), F.get(a, at - k)), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def fir(a: Column, taps: list[float]) -> Column:
    h = F.array(*map(F.lit, taps))
    return F.transform(a, lambda x, i: shifted_dot(a, h, i))


def fir_decimate(a: Column, taps: list[float], by: int) -> Column:
    return F.filter(fir(a, taps), lambda x, i: i % by == by - 1)


def fir_interpolate(a: Column, taps: list[float], by: int) -> Column:
    spread = F.flatten(F.transform(a, lambda x: F.concat(F.array(x), F.array_repeat(F.lit(0.0), by - 1))))
    return fir(spread, taps)


def fir_sparse(a: Column, taps: dict[int, float]) -> Column:
    """Taps at given delays only."""
    term = lambda i: sum((F.lit(t) * F.coalesce(F.when(i - d >= 0, F.get(a, i - d)), F.lit(0.0)) for d, t in taps.items()), F.lit(0.0))
    return F.transform(a, lambda x, i: term(i))


def convolve(a: Column, b: Column) -> Column:
    """Full convolution."""
    return F.transform(F.sequence(F.lit(0), F.size(a) + F.size(b) - 2), lambda i: shifted_dot(a, b, i))


def correlate(a: Column, b: Column) -> Column:
    """Full cross-correlation: convolution with the second array reversed."""
    return convolve(a, F.reverse(b))


def linear_interpolate(table: Column, x: Column) -> Column:
    """Value at position ``x`` of equally spaced samples, constant beyond the ends."""
    i = F.least(F.greatest(F.floor(x).cast("int"), F.lit(0)), F.size(table) - 2)
    t = F.least(F.greatest(x - i, F.lit(0.0)), F.lit(1.0))
    return F.get(table, i) * (1 - t) + F.get(table, i + 1) * t


def bilinear_interpolate(rows: Column, y: Column, x: Column) -> Column:
    i = F.least(F.greatest(F.floor(y).cast("int"), F.lit(0)), F.size(rows) - 2)
    t = F.least(F.greatest(y - i, F.lit(0.0)), F.lit(1.0))
    return linear_interpolate(F.get(rows, i), x) * (1 - t) + linear_interpolate(F.get(rows, i + 1), x) * t


def magnitude(re: Column, im: Column) -> Column:
    return F.zip_with(re, im, lambda a, b: F.hypot(a, b))


def complex_multiply(a: Column, b: Column) -> Column:
    """Of structs (re, im)."""
    return F.struct((a["re"] * b["re"] - a["im"] * b["im"]).alias("re"), (a["re"] * b["im"] + a["im"] * b["re"]).alias("im"))


def conjugate(a: Column) -> Column:
    return F.struct(a["re"].alias("re"), (-a["im"]).alias("im"))


def quaternion_product(p: Column, q: Column) -> Column:
    a, b, c, d = (p[i] for i in range(4))
    e, f, g, h = (q[i] for i in range(4))
    return F.array(a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e)


def quaternion_conjugate(q: Column) -> Column:
    return F.transform(q, lambda x, i: F.when(i == 0, x).otherwise(-x))


def quaternion_inverse(q: Column) -> Column:
    return vec.bound(vec.power(q), lambda n: F.transform(quaternion_conjugate(q), lambda x: x / n))


def quaternion_rotation(q: Column) -> Column:
    """Row-major rotation matrix of a unit quaternion."""
    w, x, y, z = (q[i] for i in range(4))
    return F.array(
        w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z,
    )


def batched(fn: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A function of one vector as an Arrow-batched column function; null stays null."""

    def run(arrays: pa.Array) -> pa.Array:
        out = [None if a is None else np.asarray(fn(np.asarray(a, float)), float).ravel().tolist() for a in arrays.to_pylist()]
        return pa.array(out, pa.list_(pa.float64()))

    return lambda column: F.arrow_udf(run, "array<double>")(column)


def biquad(a: np.ndarray, b0: float, b1: float, b2: float, a1: float, a2: float) -> np.ndarray:
    """One second-order section, feedback coefficients added."""
    out, x1, x2, y1, y2 = np.zeros(len(a)), 0.0, 0.0, 0.0, 0.0
    for i, x in enumerate(a):
        y = b0 * x + b1 * x1 + b2 * x2 + a1 * y1 + a2 * y2
        x1, x2, y1, y2, out[i] = x, x1, y, y1, y
    return out


def lms(a: np.ndarray, target: np.ndarray, taps: int, rate: float, normalised: bool = False) -> np.ndarray:
    """Errors of an adaptive filter that follows ``target``."""
    w, line, errors = np.zeros(taps), np.zeros(taps), np.zeros(len(a))
    for i, x in enumerate(a):
        line = np.concatenate([[x], line[:-1]])
        errors[i] = target[i] - w @ line
        w += rate * errors[i] * line / (line @ line + 1e-12 if normalised else 1.0)
    return errors


def levinson_durbin(r: np.ndarray) -> np.ndarray:
    """Prediction coefficients from autocorrelations r[0], r[1], ..."""
    a, error = np.zeros(len(r) - 1), r[0]
    for k in range(len(a)):
        reflection = (r[k + 1] - a[:k] @ r[k:0:-1]) / error
        a[:k], a[k] = a[:k] - reflection * a[:k][::-1], reflection
        error *= 1 - reflection**2
    return a


def dct4(a: np.ndarray) -> np.ndarray:
    n = len(a)
    k = np.arange(n) + 0.5
    return math.sqrt(2 / n) * np.cos(np.pi / n * np.outer(k, k)) @ a


def dtw(a: np.ndarray, b: np.ndarray, width: int | None = None) -> float:
    """Dynamic time warping distance with absolute differences, within a band of ``width``."""
    n, m = len(a), len(b)
    band = max(width, abs(n - m)) if width is not None else max(n, m)
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(m, i + band) + 1):
            cost[i, j] = abs(a[i - 1] - b[j - 1]) + min(cost[i - 1, j], cost[i, j - 1], cost[i - 1, j - 1])
    return float(cost[n, m])


def rfft_interleaved(a: np.ndarray) -> np.ndarray:
    """Real and imaginary parts in turn of the spectrum's non-negative frequencies."""
    s = np.fft.rfft(a)
    return np.stack([s.real, s.imag], 1).ravel()


def cfft_interleaved(a: np.ndarray) -> np.ndarray:
    s = np.fft.fft(a[::2] + 1j * a[1::2])
    return np.stack([s.real, s.imag], 1).ravel()


def square(a: np.ndarray) -> np.ndarray:
    n = math.isqrt(len(a))
    return a.reshape(n, n)


#: NumPy functions of a vector (or a square matrix, row by row) as column functions.
RFFT = batched(rfft_interleaved)
CFFT = batched(cfft_interleaved)
DCT4 = batched(dct4)
LEVINSON_DURBIN = batched(levinson_durbin)
MATRIX_INVERSE = batched(lambda a: np.linalg.inv(square(a)))
CHOLESKY = batched(lambda a: np.linalg.cholesky(square(a)))


def biquad_cascade(sections: list[tuple[float, float, float, float, float]]) -> Callable[[Column], Column]:
    def run(a: np.ndarray) -> np.ndarray:
        for s in sections:
            a = biquad(a, *s)
        return a

    return batched(run)

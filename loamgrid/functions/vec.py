"""Array maths as column expressions: an array is a vector, nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(x: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(x)`` with ``x`` computed once, however often ``fn`` uses it."""
    return F.transform(F.array(x), lambda v: fn(v))[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def power(a: Column) -> Column:
    return total(F.transform(a, lambda x: x * x))


def norm(a: Column) -> Column:
    return F.sqrt(power(a))


def rms(a: Column) -> Column:
    return F.sqrt(power(a) / F.size(a))


def var_pop(a: Column) -> Column:
    return bound(mean(a), lambda m: total(F.transform(a, lambda x: (x - m) * (x - m))) / F.size(a))


def var_samp(a: Column) -> Column:
    """Sample variance; 0 for fewer than two values."""
    return F.when(F.size(a) > 1, bound(mean(a), lambda m: total(F.transform(a, lambda x: (x - m) * (x - m))) / (F.size(a) - 1))).otherwise(0.0)


def std_samp(a: Column) -> Column:
    return F.sqrt(var_samp(a))


def zscore(a: Column, least: float = 1e-6) -> Column:
    """(x - mean) / population deviation; deviations under ``least`` count as 1."""
    scale = lambda s: F.when(s < least, 1.0).otherwise(s)
    return bound(mean(a), lambda m: bound(scale(F.sqrt(var_pop(a))), lambda s: F.transform(a, lambda x: (x - m) / s)))


def pearson(a: Column, b: Column) -> Column:
    """Mean product of z-scores."""
    return mean(F.zip_with(zscore(a), zscore(b), lambda x, y: x * y))


def logsumexp(a: Column) -> Column:
    return bound(F.array_max(a), lambda m: m + F.ln(total(F.transform(a, lambda x: F.exp(x - m)))))


def softmax(a: Column) -> Column:
    return bound(F.array_max(a), lambda m: bound(F.transform(a, lambda x: F.exp(x - m)), lambda e: bound(total(e), lambda s: F.transform(e, lambda x: x / s))))


def log_softmax(a: Column) -> Column:
    return bound(logsumexp(a), lambda z: F.transform(a, lambda x: x - z))


def scaled(a: Column, temperature: float) -> Column:
    return F.transform(a, lambda x: x / temperature)


def energy(a: Column, temperature: float = 1.0) -> Column:
    """-T logsumexp(a / T); higher means less like the training data."""
    return -F.lit(temperature) * logsumexp(scaled(a, temperature))


def argmax(a: Column) -> Column:
    """Index of the first greatest value, from 0."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def argmin(a: Column) -> Column:
    return F.array_position(a, F.array_min(a)).cast("int") - 1


def one_hot(label: Column, classes: int, smoothing: float = 0.0) -> Column:
    off, on = smoothing / classes, 1 - smoothing + smoothing / classes
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == label, on).otherwise(off))


def cross_entropy(logits: Column, target: Column) -> Column:
    """-sum target * log softmax(logits)."""
    return -dot(target, log_softmax(logits))


def distillation(student: Column, teacher: Column, target: Column, alpha: float = 0.5, temperature: float = 4.0) -> Column:
    """(1 - alpha) CE + alpha T^2 KL(teacher || student) at temperature T."""
    hot, cold = scaled(student, temperature), scaled(teacher, temperature)
    kl = bound(softmax(cold), lambda p: dot(p, F.zip_with(F.transform(p, lambda x: F.ln(x)), log_softmax(hot), lambda x, y: x - y)))
    return (1 - alpha) * cross_entropy(student, target) + alpha * kl * temperature**2


def quantize(a: Column, scale: float, zero: int = 0) -> Column:
    """Affine int8, halves to even, saturating."""
    return F.transform(a, lambda x: F.least(F.greatest(F.rint(x / scale) + zero, F.lit(-128.0)), F.lit(127.0)).cast("int"))


def dequantize(a: Column, scale: float, zero: int = 0) -> Column:
    return F.transform(a, lambda q: (q - zero) * scale)


def gem(a: Column, p: float = 3.0, least: float = 1e-6) -> Column:
    """Generalised mean pooling."""
    return F.pow(mean(F.transform(a, lambda x: F.pow(F.greatest(x, F.lit(least)), F.lit(p)))), F.lit(1 / p))


def entropy(p: Column) -> Column:
    """-sum p ln p; a zero probability gives null, as its logarithm does."""
    return -total(F.transform(p, lambda x: x * F.ln(x)))


def kullback_leibler(a: Column, b: Column) -> Column:
    return -total(F.zip_with(a, b, lambda x, y: x * F.ln(y / x)))


def logsumexp_dot(a: Column, b: Column) -> Column:
    return logsumexp(F.zip_with(a, b, lambda x, y: x + y))


def weighted_average(a: Column, w: Column) -> Column:
    return dot(a, w) / total(w)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cityblock(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def canberra(a: Column, b: Column) -> Column:
    """Terms with both values 0 count 0."""
    return total(F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), 0.0).otherwise(F.abs(x - y) / F.nullif(F.abs(x) + F.abs(y), F.lit(0.0)))))


def braycurtis(a: Column, b: Column) -> Column:
    return cityblock(a, b) / total(F.zip_with(a, b, lambda x, y: F.abs(x + y)))


def cosine(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def minkowski(a: Column, b: Column, p: float) -> Column:
    return F.pow(total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1 / p))


def correlation_distance(a: Column, b: Column) -> Column:
    return bound(mean(a), lambda m: bound(mean(b), lambda n: cosine(F.transform(a, lambda x: x - m), F.transform(b, lambda y: y - n))))


def jensen_shannon(a: Column, b: Column) -> Column:
    """Of two distributions; a zero term counts 0."""
    part = lambda x, y: F.when(x > 0, x * F.ln(2 * x / (x + y))).otherwise(0.0)
    return F.sqrt((total(F.zip_with(a, b, part)) + total(F.zip_with(b, a, part))) / 2)


def contingency(a: Column, b: Column) -> dict[str, Column]:
    """Counts of positions by the two arrays' booleans."""
    count = lambda test: F.aggregate(F.zip_with(a, b, lambda x, y: F.when(test(x, y), 1).otherwise(0)), F.lit(0), lambda s, v: s + v).cast("double")
    return {"tt": count(lambda x, y: x & y), "tf": count(lambda x, y: x & ~y), "ft": count(lambda x, y: ~x & y), "ff": count(lambda x, y: ~x & ~y)}


def boolean_distances(tt: Column, tf: Column, ft: Column, ff: Column) -> dict[str, Column]:
    n, r = tt + tf + ft + ff, 2 * (tf + ft)
    return {
        "dice": (tf + ft) / (2 * tt + tf + ft),
        "hamming": (tf + ft) / n,
        "jaccard": (tf + ft) / (tt + tf + ft),
        "kulsinski": (tf + ft - tt + n) / (tf + ft + n),
        "rogerstanimoto": r / (r + tt + ff),
        "russellrao": (n - tt) / n,
        "sokalmichener": r / (tt + ff + r),
        "sokalsneath": r / (r + tt),
        "yule": 2 * tf * ft / (tf * ft + tt * ff),
    }

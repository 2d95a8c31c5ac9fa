"""Tensor operators on array columns, by name: one expression each, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamgrid.functions import vec


def each(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda a: F.transform(a, lambda x: fn(x))


def paired(fn: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.zip_with(a, b, lambda x, y: fn(x, y))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def hard_swish(x: Column) -> Column:
    return x * F.least(F.greatest(x + 3, F.lit(0.0)), F.lit(6.0)) / 6


def floor_mod(x: Column, y: Column) -> Column:
    """Remainder with the divisor's sign."""
    return x - y * F.floor(x / y)


#: Operators of one array.
UNARY: dict[str, Callable[[Column], Column]] = {
    "ABS": each(F.abs),
    "CEIL": each(lambda x: F.ceil(x).cast("double")),
    "COS": each(F.cos),
    "ELU": each(lambda x: F.when(x < 0, F.expm1(x)).otherwise(x)),
    "EXP": each(F.exp),
    "FLOOR": each(lambda x: F.floor(x).cast("double")),
    "HARD_SWISH": each(hard_swish),
    "L2_NORMALIZATION": lambda a: vec.bound(vec.norm(a), lambda n: F.transform(a, lambda x: x / n)),
    "LEAKY_RELU": each(lambda x: F.when(x > 0, x).otherwise(0.01 * x)),
    "LOG": each(F.ln),
    "LOGICAL_NOT": each(lambda x: ~x),
    "LOGISTIC": each(logistic),
    "LOG_SOFTMAX": vec.log_softmax,
    "NEG": each(lambda x: -x),
    "RELU": each(lambda x: F.greatest(x, F.lit(0.0))),
    "RELU6": each(lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(6.0))),
    "ROUND": each(F.rint),
    "RSQRT": each(lambda x: 1 / F.sqrt(x)),
    "SIN": each(F.sin),
    "SOFTMAX": vec.softmax,
    "SQRT": each(F.sqrt),
    "SQUARE": each(lambda x: x * x),
    "TANH": each(F.tanh),
    "ZEROS_LIKE": each(lambda x: F.lit(0.0)),
}

#: Operators of two arrays of one length.
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "ADD": paired(lambda x, y: x + y),
    "DIV": paired(lambda x, y: x / y),
    "EQUAL": paired(lambda x, y: x == y),
    "FLOOR_DIV": paired(lambda x, y: F.floor(x / y).cast("double")),
    "FLOOR_MOD": paired(floor_mod),
    "GREATER": paired(lambda x, y: x > y),
    "GREATER_EQUAL": paired(lambda x, y: x >= y),
    "LESS": paired(lambda x, y: x < y),
    "LESS_EQUAL": paired(lambda x, y: x <= y),
    "LOGICAL_AND": paired(lambda x, y: x & y),
    "LOGICAL_OR": paired(lambda x, y: x | y),
    "MAXIMUM": paired(F.greatest),
    "MINIMUM": paired(F.least),
    "MUL": paired(lambda x, y: x * y),
    "NOT_EQUAL": paired(lambda x, y: x != y),
    "SQUARED_DIFFERENCE": paired(lambda x, y: (x - y) * (x - y)),
    "SUB": paired(lambda x, y: x - y),
}

#: Operators from an array to one value.
REDUCE: dict[str, Callable[[Column], Column]] = {
    "ARG_MAX": vec.argmax,
    "ARG_MIN": vec.argmin,
    "MEAN": vec.mean,
    "REDUCE_MAX": F.array_max,
    "REDUCE_MIN": F.array_min,
    "SHAPE": F.size,
    "SUM": vec.total,
}


def add_n(*arrays: Column) -> Column:
    out = arrays[0]
    for a in arrays[1:]:
        out = BINARY["ADD"](out, a)
    return out


def prelu(a: Column, slopes: Column) -> Column:
    return F.zip_with(a, slopes, lambda x, s: F.when(x > 0, x).otherwise(s * x))


def select(test: Column, a: Column, b: Column) -> Column:
    return F.transform(F.arrays_zip(test.alias("t"), a.alias("a"), b.alias("b")), lambda r: F.when(r["t"], r["a"]).otherwise(r["b"]))


def strided_slice(a: Column, begin: int, end: int, step: int = 1) -> Column:
    return F.filter(a, lambda x, i: (i >= begin) & (i < end) & ((i - begin) % step == 0))


def pad(a: Column, before: int, after: int, value: float = 0.0) -> Column:
    return F.concat(F.array_repeat(F.lit(value), before), a, F.array_repeat(F.lit(value), after))


def mirror_pad(a: Column, before: int, after: int, symmetric: bool = False) -> Column:
    """Reflects without the edge value, or with it if ``symmetric``."""
    skip = 0 if symmetric else 1
    return F.concat(F.reverse(F.slice(a, 1 + skip, before)), a, F.reverse(F.slice(a, F.size(a) - skip - after + 1, after)))


def gather(a: Column, at: Column) -> Column:
    return F.transform(at, lambda i: F.get(a, i))


def split(a: Column, parts: int) -> list[Column]:
    size = (F.size(a) / parts).cast("int")
    return [F.slice(a, size * k + 1, size) for k in range(parts)]


def split_v(a: Column, sizes: list[int]) -> list[Column]:
    starts = [sum(sizes[:k]) + 1 for k in range(len(sizes))]
    return [F.slice(a, s, n) for s, n in zip(starts, sizes, strict=True)]


def reshape(a: Column, width: int) -> Column:
    """Rows of ``width`` values."""
    return F.transform(F.sequence(F.lit(0), (F.size(a) / width).cast("int") - 1), lambda i: F.slice(a, i * width + 1, width))


def transpose(rows: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(rows[0]) - 1), lambda j: F.transform(rows, lambda r: F.get(r, j)))


def fully_connected(a: Column, weights: list[list[float]], bias: list[float]) -> Column:
    return F.array(*[vec.dot(a, F.array(*map(F.lit, w))) + F.lit(b) for w, b in zip(weights, bias, strict=True)])


def cumsum(a: Column, exclusive: bool = False, reverse: bool = False) -> Column:
    """Prefix sums by one fold, for arrays of moderate length: each step copies what there is so far."""
    x = F.reverse(a) if reverse else a
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))
    step = lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.concat(acc["out"], F.array(acc["s"] if exclusive else acc["s"] + v)).alias("out"))
    out = F.aggregate(x, start, step, lambda acc: acc["out"])
    return F.reverse(out) if reverse else out


def pool(rows: Column, size: int, reduce: Callable[[Column], Column]) -> Column:
    """Non-overlapping ``size`` by ``size`` cells of a matrix (array of rows), each reduced to one value."""
    high, wide = (F.size(rows) / size).cast("int"), (F.size(rows[0]) / size).cast("int")
    cell = lambda i, j: F.flatten(F.transform(F.slice(rows, i * size + 1, size), lambda r: F.slice(r, j * size + 1, size)))
    return F.transform(F.sequence(F.lit(0), high - 1), lambda i: F.transform(F.sequence(F.lit(0), wide - 1), lambda j: reduce(cell(i, j))))


def average_pool(rows: Column, size: int) -> Column:
    return pool(rows, size, vec.mean)


def max_pool(rows: Column, size: int) -> Column:
    return pool(rows, size, F.array_max)


def l2_pool(rows: Column, size: int) -> Column:
    return pool(rows, size, vec.rms)


def matmul(a: Column, b: Column) -> Column:
    """Product of two matrices as arrays of rows."""
    return vec.bound(transpose(b), lambda t: F.transform(a, lambda r: F.transform(t, lambda c: vec.dot(r, c))))


def resize_nearest(rows: Column, high: int, wide: int) -> Column:
    at = lambda n, m: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.floor(i * n / m).cast("int"))
    return F.transform(at(F.size(rows), high), lambda i: F.transform(at(F.size(rows[0]), wide), lambda j: F.get(F.get(rows, i), j)))


def conv2d(rows: Column, kernel: list[list[float]]) -> Column:
    """Valid two-dimensional correlation of a matrix with a small kernel."""
    kh, kw = len(kernel), len(kernel[0])
    high, wide = F.size(rows) - (kh - 1), F.size(rows[0]) - (kw - 1)
    term = lambda i, j: sum((F.get(F.get(rows, i + r), j + c) * F.lit(kernel[r][c]) for r in range(kh) for c in range(kw)), F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), high - 1), lambda i: F.transform(F.sequence(F.lit(0), wide - 1), lambda j: term(i, j)))


def space_to_depth(rows: Column, size: int) -> Column:
    return pool(rows, size, lambda cell: cell)


def depth_to_space(cells: Column, size: int) -> Column:
    """Inverse of :func:`space_to_depth`."""
    line = lambda row, k: F.flatten(F.transform(row, lambda cell: F.slice(cell, k * size + 1, size)))
    return F.flatten(F.transform(cells, lambda row: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: line(row, k))))

"""Small models applied to array columns: support vectors, Gaussian Bayes, controllers, recurrent cells, matrix solvers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.functions import vec
from loamgrid.functions.signal import batched, square


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def svm_decision(x: Column, vectors: list[list[float]], weights: list[float], intercept: float, kernel: str = "linear", gamma: float = 1.0, coef0: float = 0.0, degree: int = 3) -> Column:
    """sum weight * kernel(vector, x) + intercept; the class is its sign."""

    def k(v: Column) -> Column:
        if kernel == "rbf":
            return F.exp(-gamma * vec.bound(vec.euclidean(x, v), lambda d: d * d))
        product = vec.dot(x, v)
        if kernel == "linear":
            return product
        scaled = gamma * product + coef0
        return F.pow(scaled, F.lit(float(degree))) if kernel == "polynomial" else F.tanh(scaled)

    return sum((F.lit(float(w)) * k(literal(v)) for v, w in zip(vectors, weights, strict=True)), F.lit(float(intercept)))


def gaussian_bayes(items: DataFrame, label: str, values: str, epsilon: float = 1e-9) -> DataFrame:
    """One row of ``classes``: for each label its prior, means and variances (population, plus ``epsilon``)."""
    long = items.select(label, F.posexplode(values).alias("i", "x"))
    stats = long.groupBy(label, "i").agg(F.avg("x").alias("m"), (F.var_pop("x") + epsilon).alias("v"), F.count("*").alias("n"))
    rows = stats.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("i", "m", "v"))).alias("d"), F.max("n").cast("double").alias("n"))
    return rows.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), F.col("n").alias("n"), F.col("d.m").alias("m"), F.col("d.v").alias("v")))).alias("classes"), F.sum("n").alias("total"))


def bayes_scores(x: Column, classes: Column, total: Column) -> Column:
    """Log-likelihood of each class, in the classes' order."""
    term = lambda a, s: F.aggregate(F.arrays_zip(a.alias("x"), s["m"].alias("m"), s["v"].alias("v")), F.lit(0.0), lambda acc, r: acc - 0.5 * F.ln(2 * np.pi * r["v"]) - (r["x"] - r["m"]) * (r["x"] - r["m"]) / (2 * r["v"]))
    return F.transform(classes, lambda s: F.ln(s["n"] / total) + term(x, s))


def barycenter(points: Column, weights: Column) -> Column:
    """Weighted mean of an array of points."""
    dims = F.sequence(F.lit(0), F.size(points[0]) - 1)
    return F.transform(dims, lambda d: vec.weighted_average(F.transform(points, lambda p: F.get(p, d)), weights))


def pid(errors: np.ndarray, kp: float, ki: float, kd: float) -> np.ndarray:
    """Outputs of an incremental controller from rest."""
    out, y, e1, e2 = np.zeros(len(errors)), 0.0, 0.0, 0.0
    for i, e in enumerate(errors):
        y += (kp + ki + kd) * e - (kp + 2 * kd) * e1 + kd * e2
        e1, e2, out[i] = e, e1, y
    return out


def lstm(inputs: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hidden states of one cell over a sequence; gates in the order input, forget, cell, output."""
    n = u.shape[1]
    h, c, out = np.zeros(n), np.zeros(n), []
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for x in inputs:
        i, f, g, o = np.split(w @ np.atleast_1d(x) + u @ h + b, 4)
        c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
        h = sigmoid(o) * np.tanh(c)
        out.append(h)
    return np.array(out)


def svdf(inputs: np.ndarray, feature: np.ndarray, time: np.ndarray) -> np.ndarray:
    """A feature filter followed by a filter over its last outputs, which start at 0."""
    memory, out = np.zeros(len(time)), []
    for x in inputs:
        memory = np.append(memory[1:], feature @ np.atleast_1d(x))
        out.append(time @ memory)
    return np.array(out)


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through (x, y)."""
    n, h = len(x), np.diff(x)
    a, r = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 3 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    c = np.linalg.solve(a, r)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    d, t = (c[k + 1] - c[k]) / (3 * h[k]), at - x[k]
    b = (y[k + 1] - y[k]) / h[k] - h[k] * (2 * c[k] + c[k + 1]) / 3
    return y[k] + b * t + c[k] * t**2 + d * t**3


def ldlt(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit lower triangle and diagonal of a symmetric matrix."""
    low, diagonal = np.eye(len(a)), np.zeros(len(a))
    for j in range(len(a)):
        diagonal[j] = a[j, j] - (low[j, :j] ** 2) @ diagonal[:j]
        for i in range(j + 1, len(a)):
            low[i, j] = (a[i, j] - (low[i, :j] * low[j, :j]) @ diagonal[:j]) / diagonal[j]
    return low, diagonal


def householder(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Vector and factor of the reflection that maps x to a multiple of the first axis."""
    v = x.astype(float).copy()
    v[0] += np.copysign(np.linalg.norm(x), x[0])
    return v, 2 / (v @ v) if v @ v else 0.0


#: Of a square matrix, row by row, as column functions: R of its QR decomposition, L of its LDL^T.
QR_R = batched(lambda a: np.linalg.qr(square(a))[1])
LDLT_L = batched(lambda a: ldlt(square(a))[0])

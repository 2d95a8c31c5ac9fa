"""Pooling of feature maps: an array of channels, each the array of its positions' values, to one vector."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamgrid.functions import vec

Pool = Callable[[Column], Column]


def average(maps: Column) -> Column:
    return F.transform(maps, vec.mean)


def largest(maps: Column) -> Column:
    return F.transform(maps, lambda c: F.array_max(c))


def generalised(maps: Column, p: float = 3.0, least: float = 1e-6) -> Column:
    return F.transform(maps, lambda c: vec.gem(c, p, least))


def concatenated(maps: Column, p: float = 3.0, least: float = 1e-6) -> Column:
    """The generalised means of the channels, then their maxima."""
    return F.concat(generalised(maps, p, least), largest(maps))


def attention(maps: Column, hidden: Column, hidden_bias: Column, out: Column, out_bias: Column) -> Column:
    """Means over positions, weighed by the softmax of each position's score.

    A position's score is ``out`` times what is positive of ``hidden`` (an array
    of rows, one weight for each channel) times its values, with biases.
    """
    places = F.transform(maps[0], lambda _, i: F.transform(maps, lambda c: F.get(c, i)))
    unit = lambda x: F.zip_with(hidden, hidden_bias, lambda w, b: F.greatest(vec.dot(w, x) + b, F.lit(0.0)))
    scores = F.transform(places, lambda x: vec.dot(out, unit(x)) + out_bias)
    return vec.bound(vec.softmax(scores), lambda weights: F.transform(maps, lambda c: vec.dot(c, weights)))


def pooling(kind: str, channels: int, weights: tuple[Column, Column, Column, Column] | None = None) -> tuple[Pool, int]:
    """The pooling of a name and the length of its vectors."""
    known: dict[str, tuple[Pool, int]] = {"gem": (generalised, channels), "avg": (average, channels), "max": (largest, channels), "concat": (concatenated, 2 * channels)}
    if weights is not None:
        known["attention"] = (lambda maps: attention(maps, *weights), channels)
    if kind not in known:
        raise ValueError(f"no pooling {kind!r}; there are {', '.join(sorted(known))}" + ("" if weights else "; attention needs weights"))
    return known[kind]

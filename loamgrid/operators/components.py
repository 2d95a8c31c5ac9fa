"""Connected components of an edge table, by local contraction and alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.session import durable

#: Edges that one task contracts; its memory, some tens of bytes an edge, is bounded by this number.
CHUNK = 1_000_000


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges that reach a lesser one, and the least that each reaches."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (further := root[root] != root).any():
            root[further] = root[root[further]]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    less = np.flatnonzero(root != np.arange(len(names)))
    return names[less], names[root[less]]


def _contract(edges: DataFrame, parts: int) -> DataFrame:
    """Replace each part's edges by edges from its nodes to the least node they reach within the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if ends:
            node, root = least_reached(*(np.concatenate(x) for x in zip(*ends, strict=True)))
            for k in range(0, len(node), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(node[k : k + 100_000]), pa.array(root[k : k + 100_000])], ["u", "v"])

    return edges.select("u", "v").coalesce(parts).mapInArrow(run, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of u to the least of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the least of these neighbours."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    side = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return side.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", chunk: int = CHUNK, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph ``edges(a, b)`` of integer nodes.

    Returns ``(node, component)`` for every node of an edge between two
    different nodes; the component is its least node. Loops, repeated edges
    and nulls are ignored; an empty edge table gives an empty result. Edges are
    first contracted in parts of bounded size, each to a forest of stars. If
    there is more than one part, rounds of star contraction merge them; a
    round is a fixed number of aggregations and equi-joins whose keys Spark can
    pre-aggregate or split, and ends in the shared checkpoint folder.
    """
    current = durable(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    )
    parts = -(-current.count() // chunk)
    if parts:
        current = durable(_contract(current, parts))
    if parts > 1:
        seen = _fingerprint(current)
        for _ in range(max_rounds):
            current = durable(_small_star(_large_star(current)))
            now = _fingerprint(current)
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

"""Near-duplicate documents by HyperMinHash.

A document's word shingles are hashed into buckets; each bucket keeps the
number of leading zeros of its least hash and some bits after these. Bands of
these compressed registers find candidates, the registers that agree, less
those that agree by chance, estimate the similarity of candidates, and the
full sets of shingles decide. Documents that are linked over any number of
steps form a component, and its document with the least id is kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.common import WordHashes, ascii_words, batch_map, table
from loamgrid.llm.linking import candidate_groups, linked_components, sized, spread
from loamgrid.session import durable

#: Bands and registers in each: documents of similarity 0.8 share a band with a probability of 1 - 3e-6.
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Bits that a register keeps after the leading zeros and the first one.
MANTISSA = 10
#: Estimates from which pairs stay candidates: with a hub, and as links.
LOOSE, STRICT = 0.5, 0.64
#: Shingle hashes in a block of exact comparisons.
BLOCK_WEIGHT = 2_000_000
#: Buckets to take an empty bucket's register from, in this order; then the next bucket that isn't empty.
TRIES = 48


def shingle_hashes(text: str | None, words: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words; all words at once if there are fewer."""
    found = ascii_words(text)
    if not found:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = min(size, len(ids))
    h = ids[: len(ids) - n + 1].copy()
    for k in range(1, n):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k]
    h += np.uint64(n)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(31)))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of REGISTERS 16-bit registers for each sorted set of hashes that isn't empty."""
    least = np.zeros((len(sets), REGISTERS), np.float64)
    edges = np.arange(REGISTERS, dtype=np.uint64)
    for i, s in enumerate(sets):
        scaled = (s >> np.uint64(32)) * np.uint64(REGISTERS)
        bucket = scaled >> np.uint64(32)
        at = np.searchsorted(bucket, edges)
        there = at < len(s)
        there[there] = bucket[at[there]] == edges[there]
        least[i, there] = (scaled[at[there]] & np.uint64(0xFFFFFFFF)).astype(np.float64) + 1.0
    full = least > 0
    fraction, exponent = np.frexp(least)
    kept = ((33 - exponent) << MANTISSA) + ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    row, col = np.nonzero(~full)
    out = kept.copy()
    source = np.random.default_rng(20240).integers(0, REGISTERS, (TRIES, REGISTERS))
    for k in range(TRIES):
        if not len(row):
            break
        taken = full[row, source[k, col]]
        out[row[taken], col[taken]] = kept[row[taken], source[k, col[taken]]]
        row, col = row[~taken], col[~taken]
    for step in range(1, REGISTERS):
        if not len(row):
            break
        near = (col + step) % REGISTERS
        taken = full[row, near]
        out[row[taken], col[taken]] = kept[row[taken], near[taken]]
        row, col = row[~taken], col[~taken]
    return out.astype(">u2")


def chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Probability that registers of two disjoint sets of these sizes agree."""
    ka, kb = np.maximum(a / REGISTERS, 1.0), np.maximum(b / REGISTERS, 1.0)
    s, total = ka + kb, np.zeros(len(ka))
    for zeros in range(33):
        width = 2.0 ** -(zeros + 1 + MANTISSA)
        total += width * ka * kb / s * (np.exp(-s * 2.0 ** -(zeros + 1)) - np.exp(-s * 2.0**-zeros))
    return np.minimum(total, 0.5)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarities from rows of registers and sizes of sets, corrected for registers that agree by chance."""
    e = chance(n.astype(float), m.astype(float))
    return np.maximum(0.0, ((a == b).mean(axis=1) - e) / (1 - e))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sketch); the sketch is null for an empty set."""

    def run(rows: dict) -> dict:
        words = WordHashes()
        sets = [shingle_hashes(t, words, size) for t in rows["text"]]
        some = [s for s in sets if len(s)]
        sketches = iter(registers(some)) if some else iter(())
        weights = [np.bitwise_xor.reduce(s) if len(s) else None for s in sets]
        sums = [np.add.reduce(s * np.uint64(0x9E3779B97F4A7C15) ^ (s >> np.uint64(7))) if len(s) else None for s in sets]
        signed = lambda x: None if x is None else int(np.uint64(x).astype(np.int64))
        return {
            "doc_id": pa.array(rows["doc_id"], pa.int64()),
            "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "set_a": pa.array(map(signed, weights), pa.int64()),
            "set_b": pa.array(map(signed, sums), pa.int64()),
            "sketch": pa.array([next(sketches).tobytes() if len(s) else None for s in sets], pa.binary()),
        }

    return batch_map(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, set_a long, set_b long, sketch binary")


def similar_pairs(pairs: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """The ``pairs(a, b)`` whose sketches in ``known(id, n, sketch)`` estimate at least ``least``."""

    def run(a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        left, right = (np.frombuffer(b"".join(x.to_pylist()), ">u2").reshape(-1, REGISTERS) for x in (a, b))
        return pa.array(estimate(left, right, n.to_numpy(), m.to_numpy()))

    both = pairs.join(known.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a")), "a")
    both = both.join(known.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b")), "b")
    return both.where(F.arrow_udf(run, "double")("s_a", "s_b", "n_a", "n_b") >= least).select("a", "b")


def sketch_link(payloads: list[dict]) -> list[tuple[int, int]]:
    """A spanning forest of the sketches whose estimates are STRICT or more."""
    rows = np.frombuffer(b"".join(p["sketch"] for p in payloads), ">u2").reshape(-1, REGISTERS)
    sizes = np.array([p["n"] for p in payloads])

    def near(i: int, todo: np.ndarray) -> np.ndarray:
        return todo[estimate(rows[todo], rows[i : i + 1], sizes[todo], np.full(len(todo), sizes[i])) >= STRICT]

    return spread(len(payloads), near)


def sketch_elements(payload: dict) -> tuple[np.ndarray, int]:
    """A number for each register and what it holds; estimates of STRICT or more need at least that share of them alike."""
    values = np.frombuffer(payload["sketch"], ">u2").astype(np.int64)
    return values * REGISTERS + np.arange(REGISTERS), REGISTERS - math.ceil(STRICT * REGISTERS) + 1


def sketch_needed(n: Column, m: Column) -> Column:
    return F.lit(math.ceil(STRICT * REGISTERS))


def linker(percent: int) -> Callable[[list], list[tuple[int, int]]]:
    """A spanning forest of the sets (bytes of sorted 64-bit hashes) with 100 * intersection >= percent * union."""

    def link(payloads: list[bytes]) -> list[tuple[int, int]]:
        sets = [np.frombuffer(p, np.uint64) for p in payloads]
        size = np.array([len(s) for s in sets])
        if len(sets) == 2:
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            return [(0, 1)] if 100 * both >= percent * (size.sum() - both) else []
        distinct, at = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        mark = np.zeros(len(distinct), np.int64)

        def near(i: int, todo: np.ndarray) -> np.ndarray:
            own = at[starts[i] : starts[i] + size[i]]
            mark[own] = 1
            both = np.add.reduceat(mark[at], starts)[todo]
            mark[own] = 0
            return todo[100 * both >= percent * (size[todo] + size[i] - both)]

        return spread(len(sets), near)

    return link


def set_elements(percent: int) -> Callable[[bytes], tuple[np.ndarray, int]]:
    """The hashes of a set; linked sets have at least ``percent`` of each one's hashes in common."""

    def found(payload: bytes) -> tuple[np.ndarray, int]:
        hashes = np.frombuffer(payload, np.int64)
        return hashes, len(hashes) - -(-len(hashes) * percent // 100) + 1

    return found


def set_needed(percent: int) -> Callable[[Column, Column], Column]:
    """Elements in common of linked sets of n and m: 100 * both >= percent * (n + m - both)."""
    return lambda n, m: F.ceil((n + m) * percent / (100 + percent) - 1e-9)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose sets of word shingles agree by ``percent``.

    Returns doc_id, n_shingles, component_id (the least doc_id that is
    reachable over links) and kept (doc_id = component_id), a row for each row
    of ``docs``. Null, empty and blank texts have no shingles, are linked with
    nothing and kept. Rows that repeat a doc_id are one document of the graph;
    rows without doc_id are linked with nothing, have a null component_id and
    are kept. Equal sets are linked through their least doc_id, so copies are
    never paired.
    """
    signed = durable(signatures(docs, shingle))
    same = ["set_a", "set_b", "n_shingles"]
    whole = signed.where("n_shingles > 0 and doc_id is not null")
    classes = durable(whole.groupBy(*same).agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch")))
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("sketch", 2 * ROWS * k + 1, 2 * ROWS)) for k in range(BANDS)])
    known = classes.select("id", F.col("n_shingles").alias("n"), "sketch")
    sketched = known.select("id", F.struct("sketch", "n").alias("payload"))
    groups = durable(candidate_groups(classes.select(F.explode(keys).alias("key"), "id"), lambda pairs: similar_pairs(pairs, known, LOOSE), lambda t: t.join(sketched, "id"), sketch_link, sketch_elements, sketch_needed))
    items = groups.join(known.select("id", "n"), F.col("node") == F.col("id")).select("id", F.col("component").alias("gid"), F.col("n").alias("weight"))

    def payloads(wanted: DataFrame) -> DataFrame:
        def run(texts: pa.Array) -> pa.Array:
            words = WordHashes()
            return pa.array([shingle_hashes(t, words, shingle).tobytes() for t in texts.to_pylist()], pa.binary())

        wanted = durable(wanted)
        texts = docs.select(F.col("doc_id").alias("id"), "text").join(sized(wanted), "id")
        return texts.select(*wanted.columns, F.arrow_udf(run, "binary")("text").alias("payload"))

    linked = linked_components(items, payloads, linker(percent), BLOCK_WEIGHT, set_elements(percent), set_needed(percent))
    # copies follow the document that stands for them
    heads = classes.join(linked, F.col("id") == F.col("node"), "left").select(*same, F.coalesce("component", "id").alias("component_id"))
    named = signed.join(heads, same, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)

"""SimHashes and hashed word counts of texts, and correlations of pairs of features, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.operators import hamming
from loamgrid.session import durable

#: Texts whose words are taken up together; words whose digests are held at once; words whose bits are added up in a byte each.
SLICE, KNOWN, LANE = 400, 500_000, 255
#: Items whose features are unfolded at once; pairs whose scores are multiplied at once.
PAIRS, FEW = 20_000, 1_000


def _word_hashes(words: pa.Array) -> np.ndarray:
    """The first eight bytes of each word's md5, cut from the words' buffer without an object for each."""
    ends, whole = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].tolist(), memoryview(words.buffers()[2] or b"")
    parts = []
    for k in range(0, len(words), KNOWN):
        digests = b"".join([md5(whole[a:b]).digest() for a, b in zip(ends[k : k + KNOWN], ends[k + 1 : k + 1 + KNOWN], strict=False)])
        parts.append(np.frombuffer(digests, ">u8")[::2].astype("<u8"))
    return np.concatenate(parts) if parts else np.zeros(0, "<u8")


def fingerprints(rows: DataFrame, text: str, dimensions: int = 64) -> DataFrame:
    """``rows`` without ``text``, but with ``h`` and ``feature``.

    ``h`` is the SimHash of the distinct words between single spaces, as
    :func:`loamgrid.functions.text.simhash` has it; ``feature`` counts all
    words by the last bits of their hashes, ``dimensions`` being a power of 2.
    Both are null without text. Texts are read in one narrow pass.
    """
    others = [c for c in rows.columns if c != text]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                words = pc.split_pattern(part[text], " ")
                n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = words.flatten().cast(pa.binary()).dictionary_encode()
                hashes = _word_hashes(coded.dictionary)
                codes, doc = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(n)), n)
                counts = np.bincount(doc * dimensions + (hashes & np.uint64(dimensions - 1)).astype(np.int64)[codes], minlength=len(n) * dimensions)
                distinct = np.sort(doc * max(len(hashes), 1) + codes)
                owner, code = np.divmod(distinct[np.append(True, distinct[1:] != distinct[:-1])[: len(distinct)]], max(len(hashes), 1))
                size = np.bincount(owner, minlength=len(n))
                there = np.flatnonzero(size)
                h = np.zeros(len(n), np.int64)
                if len(there):
                    # a hash's bits as bytes, eight in a number: sums of LANE of them stay apart
                    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
                    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
                    lanes = np.flatnonzero(place % LANE == 0)
                    sums = np.add.reduceat(bits[code], lanes, axis=0).view(np.uint8)
                    votes = np.add.reduceat(sums, np.flatnonzero(place[lanes] == 0), axis=0, dtype=np.int32)
                    h[there] = np.packbits(2 * votes > size[there][:, None], axis=1, bitorder="little").view("<u8").ravel().view(np.int64)
                none = pa.array(size == 0)
                feature = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * dimensions, pa.array(counts.astype(np.int32)), mask=none)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in others), pa.array(h, mask=size == 0), feature], [*others, "h", "feature"])

    return rows.select(*others, text).mapInArrow(run, f"{kinds}, h long, feature array<int>")


def _packed(rows: DataFrame, feature: str) -> DataFrame:
    """``rows`` that have a feature, with it as bytes, ``p``: small whole numbers as one byte each; the first byte tells which."""
    others = [c for c in rows.columns if c != feature]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != feature)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch[feature]
            values, size = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy()
            start = np.cumsum(size) - size
            small = (values == np.rint(values)) & (values >= 0) & (values <= 255)
            bad = np.concatenate([[0], np.cumsum(~small)])
            plain = bad[start + size] == bad[start]
            whole, small = values.tobytes(), np.where(small, values, 0).astype(np.uint8).tobytes()
            packed = [b"\1" + small[s : s + n] if p else b"\0" + whole[8 * s : 8 * (s + n)] for s, n, p in zip(start.tolist(), size.tolist(), plain.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in others), pa.array(packed, pa.binary())], [*others, "p"])

    there = rows.where(F.col(feature).isNotNull()).withColumn(feature, F.col(feature).cast("array<double>"))
    return there.mapInArrow(run, f"{kinds}, p binary" if kinds else "p binary")


def _scores(packed: pa.Array) -> np.ndarray:
    """The z-scores of packed features of one length, 0 for constant ones."""
    rows = packed.to_pylist()
    plain = np.array([p[0] == 1 for p in rows], bool)
    width = {len(p) - 1 if k else (len(p) - 1) // 8 for p, k in zip(rows, plain.tolist(), strict=True)}
    if len(width) != 1:
        raise ValueError("features have several lengths")
    x = np.empty((len(rows), width.pop()))
    for k, kind in ((True, np.uint8), (False, np.float64)):
        x[plain == k] = np.frombuffer(b"".join([p[1:] for p, q in zip(rows, plain.tolist(), strict=True) if q == k]), kind).reshape(-1, x.shape[1])
    x -= x.mean(axis=1, keepdims=True)
    deviation = np.sqrt((x * x).mean(axis=1, keepdims=True))
    return x / np.where(deviation < 1e-6, 1.0, deviation)


def correlated(pairs: DataFrame, features: DataFrame, least: float, key: str = "id", feature: str = "feature") -> DataFrame:
    """``pairs(a, b)`` with ``r``, Pearson's correlation of both ends' ``feature``, from ``least`` on; 0 if one is constant.

    It is :func:`loamgrid.operators.hamming.confirmed` with that measure, for
    many pairs: what is shuffled with each is a byte for each small whole
    number. Items without a feature pair with nothing.
    """
    packed = durable(_packed(features.select(key, feature), feature))
    met = pairs.join(packed.toDF("a", "_pa"), "a").join(packed.toDF("b", "_pb"), "b").select(*pairs.columns, "_pa", "_pb")
    columns, kinds = pairs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r = (_scores(batch["_pa"]) * _scores(batch["_pb"])).mean(axis=1)
                out = pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(r)], [*columns, "r"])
                yield out.filter(pa.array(r >= least))

    return met.mapInArrow(run, f"{kinds}, r double")


def near_correlated(items: DataFrame, distance: int, least: float, carry: Sequence[str] = (), key: str = "id", h: str = "h", feature: str = "feature", shared: int | None = None) -> DataFrame:
    """(a, b, distance, x_a, x_b, r): near hashes and the correlation of their features, for each ``x`` of ``carry`` what both ends have.

    It is :func:`correlated` of :func:`loamgrid.operators.hamming.near_pairs`;
    but items are shuffled with their features, a few times each, and pairs,
    which may be many more than items, aren't. A task takes up the features of
    the items that have a near one.
    """

    def score(packed: pa.Array, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        # features are unfolded once for all pairs of a task's step, some items at a time: a feature is mostly in many pairs
        some, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        parts = [_scores(packed.take(pa.array(some[k : k + PAIRS]))) for k in range(0, len(some), PAIRS)]
        if len({z.shape[1] for z in parts}) > 1:
            raise ValueError("features have several lengths")
        z, n = np.concatenate(parts), len(x)
        r = np.empty(n)
        for k in range(0, n, FEW):  # of so few pairs the scores stay in the cache
            i, j = at[:n][k : k + FEW], at[n:][k : k + FEW]
            r[k : k + FEW] = (z[i] * z[j]).mean(axis=1)
        return r

    packed = _packed(items.select(key, h, *carry, feature), feature)
    return hamming.near_pairs(packed, distance, key, h, shared, carry, ("p", score, least))

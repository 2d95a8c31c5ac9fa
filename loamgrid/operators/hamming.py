"""Near-duplicates of 64-bit hashes: multi-index hashing join, confirmation and calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.session import durable

#: Blocks of bits that hashes are indexed by.
CHUNKS = 8
#: Hashes of a bucket that are compared in pairs, and of a block of a larger one; rows of a hash and a number that are broadcast.
SMALL, BLOCK, MOST_BROADCAST = 16, 8192, 300_000
#: Hashes of a group whose pairs are met step by step; pairs of hashes that are compared at once; hashes from which one more shared piece saves more than it costs.
STEPS, COMPARED, MANY = 48, 1_000_000, 30_000_000


def chunked(items: DataFrame, h: str = "h") -> DataFrame:
    """A row for each item and byte of its hash: chunk_no, chunk."""
    pieces = F.array(*[F.struct(F.lit(k).alias("chunk_no"), F.shiftright(h, 8 * k).bitwiseAND(F.lit(255)).cast("int").alias("chunk")) for k in range(CHUNKS)])
    return items.select("*", F.explode(pieces).alias("_p")).select("*", "_p.*").drop("_p")


def near_pairs(items: DataFrame, distance: int, key: str = "id", h: str = "h", shared: int | None = None, carry: Sequence[str] = (), scored: tuple[str, Callable, float] | None = None) -> DataFrame:
    """(a, b, distance) of all pairs a < b whose hashes differ in at most ``distance`` bits.

    Hashes are cut into ``distance`` + ``shared`` pieces, of which two such
    hashes agree in at least ``shared``. Hashes that agree in that many pieces
    are a bucket: with 2 of them 21 bits for a distance of 4 and 14 for one of
    7, with 3 of them 27 and 19 bits at the cost of 2 to 3 times as many rows,
    which pays from some MANY hashes on; by default their number decides.
    Only the first of these pieces deal rows to tasks, so that an item has one
    row for each of their choices, 8 and not 36 for a distance of 7; the last
    piece is sorted by within the task, whose Arrow batches compare the hashes
    of a bucket. More than 4 * BLOCK rows of the same first pieces are met in
    two parts at a time. Each pair is emitted by the first pieces it agrees in,
    so no distinct is needed.

    ``carry`` names columns of which a pair gets both ends' values, x_a and
    x_b. ``scored`` is a column, a function of its values in a task and the
    places of pairs' ends, and the least r = function(values, x, y) that a pair needs.
    """
    of, score, least = scored or (None, None, None)
    more = [*carry, *([of] if of else [])]
    rows = durable(items.where(F.col(h).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("a"), F.col(h).alias("ha"), *(F.col(c).alias(f"_{c}") for c in more)))
    if shared is None:
        shared = 2 if rows.count() <= MANY else 3
    pieces, leading = distance + shared, max(shared - 1, 1)
    cuts, _ = _cut(pieces, shared)
    leads = [s for s in combinations(range(pieces), leading) if s[-1] < pieces - (shared - leading)]
    keyed = _keyed(rows, leads, cuts, "a", "ha", [f"_{c}" for c in more])
    sizes = keyed.groupBy("no", "v").agg(F.count("*").alias("n")).where(F.col("n") > 4 * BLOCK)
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / (4 * BLOCK)).cast("int")
    large = keyed.join(_few(durable(sizes)), ["no", "v"], "left").withColumn("own", F.pmod(F.xxhash64("a"), blocks).cast("int"))
    dealt = large.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select("no", "v", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "a", "ha", *(f"_{c}" for c in more))

    def piece(x: np.ndarray, k: int) -> np.ndarray:
        return (x >> np.uint64(cuts[k])) & np.uint64((1 << (cuts[k + 1] - cuts[k])) - 1)

    def buckets(rows: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The last piece of some buckets, and the places of the near hashes in them."""
        hashes, own, two = rows["ha"].to_numpy().view(np.uint64), rows["own"].to_numpy(), rows["p"].to_numpy() != rows["q"].to_numpy()
        first, size = _bounds(rows)
        group, ends = np.repeat(np.arange(len(first)), size), np.array([s[-1] for s in leads])[rows["no"].to_numpy()]
        if shared == leading:
            for x, y in _gathered(_near_places(hashes, own, two, first, size, distance)):
                yield ends[x], x, y
            return
        for k in range(1, pieces):
            at = np.flatnonzero(ends < k)
            if not len(at):
                continue
            bucket = group[at].astype(np.uint64) << np.uint64(cuts[k + 1] - cuts[k]) | piece(hashes[at], k)
            order = np.argsort(bucket, kind="stable")
            at, bucket = at[order], bucket[order]
            begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for x, y in _gathered(_near_places(hashes[at], own[at], two[at], begin, np.diff(np.append(begin, len(at))), distance)):
                yield np.full(len(x), k), at[x], at[y]

    def near(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        hashes, columns = rows["ha"].to_numpy().view(np.uint64), {c: rows[c].combine_chunks() for c in ["a", *(f"_{c}" for c in more)]}
        for last, x, y in buckets(rows):
            differ, upto = hashes[x] ^ hashes[y], np.zeros(len(x), np.int64)
            for k in range(pieces):  # the bucket's own pieces agree; it is the first one if no others before its last do
                upto += (piece(differ, k) == 0) & (k <= last)
            ok = upto == shared
            x, y, differ = x[ok], y[ok], differ[ok]
            a, b = columns["a"].take(pa.array(x)), columns["a"].take(pa.array(y))
            less = pc.less(a, b)
            swapped = ~less.to_numpy(zero_copy_only=False)
            x, y = np.where(swapped, y, x), np.where(swapped, x, y)
            ok = pc.not_equal(a, b)
            out = {"a": pc.if_else(less, a, b), "b": pc.if_else(less, b, a), "distance": pa.array(np.bitwise_count(differ).astype(np.int32))}
            for c in carry:
                out |= {f"{c}_a": columns[f"_{c}"].take(pa.array(x)), f"{c}_b": columns[f"_{c}"].take(pa.array(y))}
            if of:
                r = score(columns[f"_{of}"], x, y) if len(x) else np.zeros(0)
                out["r"] = pa.array(r)
                ok = pc.and_(ok, pa.array(r >= least))
            yield pa.RecordBatch.from_pydict(out).filter(ok)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, GROUP):
            yield from near(rows)

    parts = dealt.repartition("no", "v", "p", "q").sortWithinPartitions("no", "v", "p", "q")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    carried = "".join(f", `{c}_{end}` {kind[f'_{c}']}" for c in carry for end in "ab")
    return parts.mapInArrow(run, f"a {kind['a']}, b {kind['a']}, distance int{carried}{', r double' if of else ''}")


#: What names a group of rows whose hashes are compared: a bucket, and two of its blocks.
GROUP = ("no", "v", "p", "q")


def _bounds(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Where each group's rows begin, and how many they are."""
    keys = np.stack([rows[c].to_numpy().astype(np.int64) for c in GROUP])
    first = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
    return first, np.diff(np.append(first, rows.num_rows))


def _near_places(hashes: np.ndarray, own: np.ndarray, two: np.ndarray, first: np.ndarray, size: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of near hashes of each group, some at a time; where there are ``two`` blocks, only those between them."""
    few, apart = size <= STEPS, two[first]
    left = np.repeat(np.where(few, size, 0), size) - np.arange(len(hashes)) + np.repeat(first, size) - 1  # rows that follow in a small group
    at = np.flatnonzero(left > 0)
    for step in range(1, STEPS):  # pairs of a small group, at one distance in it after the other
        at = at[left[at] >= step]
        if not len(at):
            break
        near = at[np.bitwise_count(hashes[at] ^ hashes[at + step]) <= distance]
        near = near[~two[near] | (own[near] != own[near + step])]
        if len(near):
            yield near, near + step
    for s, n in zip(first[~few & ~apart].tolist(), size[~few & ~apart].tolist(), strict=True):
        rows = max(1, COMPARED // n)
        for k in range(s, s + n, rows):
            found = np.flatnonzero(np.bitwise_count(hashes[k : min(k + rows, s + n), None] ^ hashes[k : s + n]) <= distance)
            if len(found):
                x, y = np.divmod(found, s + n - k)
                if (x < y).any():
                    yield x[x < y] + k, y[x < y] + k
    for s, n in zip(first[~few & apart].tolist(), size[~few & apart].tolist(), strict=True):
        one = own[s : s + n] == own[s : s + n].min()
        some, others = s + np.flatnonzero(one), s + np.flatnonzero(~one)
        for part in np.array_split(some, len(some) * len(others) // COMPARED + 1):
            x, y = np.nonzero(np.bitwise_count(hashes[part][:, None] ^ hashes[others]) <= distance)
            yield part[x], others[y]


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of ``parts``, at least 100,000 at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n > 100_000:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def whole_groups(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of ``batches``, in the order of ``by``, in tables that hold its groups whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        # The last group of a batch may go on in the next one.
        last = np.ones(batch.num_rows, bool)
        for c in by:
            last &= batch[c].to_numpy() == batch[c][batch.num_rows - 1].as_py()
        begin = batch.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if begin:
            yield pa.Table.from_batches([*held, batch.slice(0, begin)])
            held = []
        elif held and any(held[0][c][0].as_py() != batch[c][0].as_py() for c in by):
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _cut(pieces: int, shared: int) -> tuple[list[int], list[tuple]]:
    """Where hashes are cut, and the sets of pieces that a bucket is made of."""
    if pieces > 64:
        raise ValueError("hashes of 64 bits have no more than 64 pieces")
    return [64 * k // pieces for k in range(pieces + 1)], list(combinations(range(pieces), shared))


def _keyed(items: DataFrame, sets: list[tuple], cuts: list[int], key: str, h: str, more: Sequence[str] = ()) -> DataFrame:
    """(a, ha, no, v, more): each item in the buckets of its pieces, those of a set at once."""

    def joined(x: Column, chosen: tuple) -> Column:
        out = F.lit(0).cast("long")
        for k in chosen:
            wide = cuts[k + 1] - cuts[k]
            out = F.shiftleft(out, wide).bitwiseOR(F.shiftrightunsigned(x, cuts[k]).bitwiseAND(F.lit((1 << wide) - 1)))
        return out

    buckets = F.array(*[F.struct(F.lit(n).alias("no"), joined(F.col(h), s).alias("v")) for n, s in enumerate(sets)])
    return items.select(F.col(key).alias("a"), F.col(h).alias("ha"), *more, F.explode(buckets).alias("p")).select("a", "ha", *more, "p.no", "p.v")


def forest(hashes: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect the hashes as all their links of ``distance`` bits or less do: each is met once, breadth first."""
    todo, found = np.ones(len(hashes), bool), []
    for first in range(len(hashes)):
        queue = [first] if todo[first] else []
        todo[first] = False
        while queue:
            i, left = queue.pop(), np.flatnonzero(todo)
            if not len(left):
                return found
            new = left[np.bitwise_count(hashes[left] ^ hashes[i]) <= distance]
            todo[new] = False
            found += [(i, int(j)) for j in new]
            queue += new.tolist()
    return found


def new_links(hashes: np.ndarray, own: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A forest of one block; of two, what connects the parts that each has by itself."""
    if own[0] == own[-1] and (own == own[0]).all():
        return forest(hashes, distance)
    root = list(range(len(hashes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for block in np.unique(own):
        at = np.flatnonzero(own == block)
        for i, j in forest(hashes[at], distance):
            root[find(int(at[j]))] = find(int(at[i]))
    found = []
    for i, j in forest(hashes, distance):
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            found.append((i, j))
    return found


def near_links(items: DataFrame, distance: int, key: str = "id", h: str = "h", shared: int = 2) -> DataFrame:
    """(a, b): links between near hashes that connect items as those of :func:`near_pairs` do, but not all pairs of a group.

    Items of one hash are linked through the least of them, and only that one
    meets others. Hashes of a bucket of few are compared in pairs; those of a
    larger one in blocks, of which each gives a forest, and two at a time what
    connects their parts. Keys are whole numbers; a null hash is linked with
    nothing.
    """
    rows = items.where(F.col(h).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(h).alias("h"))
    heads = durable(rows.groupBy("h").agg(F.min("id").alias("head"), F.count("*").alias("n")))
    several = heads.where("n > 1").select("h", "head")
    same = rows.join(_few(several), "h").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    pieces, sets = _cut(distance + shared, shared)
    keyed = _keyed(heads, sets, pieces, "head", "h")
    sizes = keyed.groupBy("no", "v").agg(F.count("*").alias("n")).where("n > 1")
    met = durable(keyed.join(sizes, ["no", "v"]))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    large = met.withColumn("own", F.pmod(F.xxhash64("a"), blocks).cast("int"))
    dealt = large.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select("no", "v", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "a", "ha")

    def links(rows: pa.Table) -> pa.RecordBatch:
        ids, hashes = rows["a"].to_numpy(), rows["ha"].to_numpy().view(np.uint64)
        cuts, size = _bounds(rows)
        group, few = np.repeat(np.arange(len(cuts)), size), np.repeat(size <= SMALL, size)
        near = [np.zeros((0, 2), np.int64)]
        for step in range(1, min(SMALL, len(ids))):  # pairs of a small group, at one distance in it after the other
            at = np.flatnonzero(few[step:] & (group[step:] == group[:-step]))
            at = at[np.bitwise_count(hashes[at] ^ hashes[at + step]) <= distance]
            near.append(np.stack([ids[at], ids[at + step]], 1))
        own = rows["own"].to_numpy()
        large = np.flatnonzero(size > SMALL)
        found = [(ids[s + i], ids[s + j]) for s, e in zip(cuts[large], (cuts + size)[large]) for i, j in new_links(hashes[s:e], own[s:e], distance)]
        ends = np.concatenate([*near, np.array(found, np.int64).reshape(-1, 2)])
        return pa.RecordBatch.from_pydict({"a": np.ascontiguousarray(ends[:, 0]), "b": np.ascontiguousarray(ends[:, 1])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, GROUP):
            yield links(rows)

    parts = dealt.repartition("no", "v", "p", "q").sortWithinPartitions("no", "v", "p", "q", "a")
    return same.unionByName(parts.mapInArrow(run, "a long, b long"))


def _few(rows: DataFrame) -> DataFrame:
    """``rows`` of two numbers, to be broadcast while they are few; larger tables are joined by shuffle."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def bucket_sizes(items: DataFrame, h: str = "h") -> DataFrame:
    """(chunk_no, chunk, n): how many hashes share each byte."""
    return chunked(items, h).groupBy("chunk_no", "chunk").agg(F.count("*").alias("n"))


def search_report(items: DataFrame, distance: int, cap: int, h: str = "h") -> DataFrame:
    """One row: buckets, those over ``cap``, and whether a search that left these out would still be exhaustive."""
    sizes = bucket_sizes(items, h)
    over = F.when(F.col("n") > cap, F.col("chunk_no"))
    return sizes.agg(
        F.count("*").alias("n_buckets"), F.max("n").alias("largest"), F.count(over).alias("n_over"), ((CHUNKS - distance) > F.countDistinct(over)).alias("exhaustive")
    )


def confirmed(pairs: DataFrame, features: DataFrame, measure, least: float, key: str = "id") -> DataFrame:
    """``pairs(a, b)`` with ``r`` = measure of both ends' ``feature``, from ``least`` on."""
    left = features.select(F.col(key).alias("a"), F.col("feature").alias("fa"))
    right = features.select(F.col(key).alias("b"), F.col("feature").alias("fb"))
    found = pairs.join(left, "a").join(right, "b").withColumn("r", measure(F.col("fa"), F.col("fb")))
    return found.drop("fa", "fb").where(F.col("r") >= least)


def threshold_sweep(scored: DataFrame, thresholds: list[float], score: str, crossing: str) -> DataFrame:
    """(threshold, kept, crossing): pairs kept at each threshold, and those of them between classes."""
    at = F.explode(F.array(*map(F.lit, thresholds)))
    long = scored.select(score, crossing, at.alias("threshold"))
    ok = F.col(score) >= F.col("threshold")
    return long.groupBy("threshold").agg(F.sum(F.when(ok, 1).otherwise(0)).alias("kept"), F.sum(F.when(ok & F.col(crossing), 1).otherwise(0)).alias("crossing"))

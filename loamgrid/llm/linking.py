"""Links between similar items, without pairs of all items of a group.

Items that share a bucket are compared with one item of the bucket, its hub,
not with each other. Linked items form candidate groups; only where a bucket
then holds items of different groups are its items compared with each other,
by sketches. Within candidate groups the exact measure decides. Both of these
work in blocks of bounded size: each block is searched breadth first, so that
an item that has been reached is compared with those not yet reached only.
Blocks of a large group share some hubs. What its blocks leave apart from its
largest part is compared with all of the group if it fits in one block; if not,
the group is dealt anew by its items' rarest elements, of which any two linked
items share one, and only items that share such an element are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.operators.components import connected_components
from loamgrid.session import durable

#: Items in a block; hubs that the blocks of a group share, on average.
BLOCK, HUBS = 256, 8
#: Tables of up to so many bytes are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 24 << 20
#: Rows of a part of a small table.
PART_ROWS = 50_000
#: Elements of items that are handed on at once; items that are compared at once with those not yet reached.
BATCH, WIDE = 100_000, 64

Link = Callable[[list], list[tuple[int, int]]]
#: The elements of a payload, and how many of the rarest of them share one with any linked item.
Elements = Callable[[object], tuple[np.ndarray, int]]
#: How many elements linked items of two sizes have in common at least; it doesn't fall as a size grows.
Needed = Callable[[Column, Column], Column]
#: How often items that can't be linked with any other of their element are left out; each time others may follow.
ROUNDS = 2


def spread(n: int, near: Callable[[int, np.ndarray], np.ndarray], most: int | None = None) -> list[tuple[int, int]] | None:
    """A spanning forest of ``n`` items, breadth first; ``near(i, todo)`` are those of ``todo`` that i is linked with.

    None if it takes more than ``most`` comparisons.
    """
    todo, found, tests = np.ones(n, bool), [], 0
    for first in range(n):
        queue = [first] if todo[first] else []
        todo[first] = False
        while queue:
            left = np.flatnonzero(todo)
            if not len(left):
                return found
            tests += len(left)
            if most is not None and tests > most:
                return None
            i = queue.pop()
            new = near(i, left)
            todo[new] = False
            found += [(i, int(j)) for j in new]
            queue += new.tolist()
    return found


def spread_wide(n: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int) -> list[np.ndarray] | None:
    """Edges, as arrays of two columns, that connect ``n`` items as all their links do, WIDE items at a time.

    ``near(some, todo)`` is a matrix of their links. None if it takes more than
    ``most`` comparisons.
    """
    todo, label, queue, found, tests = np.ones(n, bool), np.arange(n), np.zeros(0, np.int64), [], 0
    while True:
        block, queue = queue[:WIDE], queue[WIDE:]
        if not len(block):
            block = np.flatnonzero(todo)[:WIDE]
            todo[block] = False
            among = near(block, block)
            np.fill_diagonal(among, False)
            some = np.flatnonzero(among.any(1))
            for i, j in spread(len(some), lambda i, left, among=among, some=some: left[among[some[i], some[left]]]) if len(some) else ():
                a, b = block[some[i]], block[some[j]]
                label[b] = label[a]
                found.append(np.array([[a, b]]))
        left = np.flatnonzero(todo)
        if not len(left):
            return found
        tests += len(block) * len(left)
        if tests > most:
            return None
        ok = near(block, left)
        hit = ok.any(0)
        if not hit.any():
            continue
        left, ok = left[hit], ok[:, hit]
        labels = label[block]
        for own in np.unique(labels[ok.any(1)]):
            rows = np.flatnonzero(labels == own)
            at = np.flatnonzero(ok[rows].any(0))
            found.append(np.stack([block[rows[ok[np.ix_(rows, at)].argmax(0)]], left[at]], 1))
            label[left[at]] = own
        todo[left] = False
        queue = np.concatenate([queue, left])


def bytes_of(value: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes in memory."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((bytes_of(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.StructType | T.ArrayType):
            return F.coalesce(F.aggregate(value, F.lit(16).cast("long"), lambda acc, x: acc + bytes_of(x, kind.elementType)), F.lit(16).cast("long"))
        return F.coalesce(F.size(value) * 8, F.lit(0)) + 16
    return F.lit(8)


def sized(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its rows are few bytes in all."""
    row = sum((bytes_of(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


def compact(df: DataFrame) -> DataFrame:
    """Write ``df`` and read it in as few parts as its rows need, so that unions of small tables stay in few parts."""
    written = durable(df)
    return written.coalesce(-(-max(written.count(), 1) // PART_ROWS))


def candidate_groups(buckets: DataFrame, test: Callable[[DataFrame], DataFrame], payloads: Callable[[DataFrame], DataFrame], link: Link, elements: Elements | None = None, needed: Needed | None = None) -> DataFrame:
    """(node, component) of the items of ``buckets(key, id)`` that may be linked.

    ``test(pairs(a, b))`` keeps the pairs that are close in a wide sense; it is
    asked about the items of each bucket and its hub. Buckets whose items are
    then in one component are done. The items of the others are compared with
    each other by ``link``, in blocks, on what ``payloads`` adds to them.
    """
    several = durable(buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1"))
    shared = durable(buckets.join(sized(several), "key").select("key", "id", "hub"))
    edges = compact(test(shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()))
    groups = compact(connected_components(edges))
    named = shared.join(sized(groups), F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("own"))
    mixed = durable(named.groupBy("key").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo < hi").select("key"))
    rest = durable(shared.select("key", "id").join(sized(mixed), "key").select("id", F.col("key").alias("gid"), F.lit(1).alias("weight")))
    if rest.isEmpty():
        return groups
    more = linked_components(rest, payloads, link, 1 << 40, elements, needed).where("node <> component")
    return connected_components(edges.unionByName(more.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def block_edges(rows: DataFrame, link: Link) -> DataFrame:
    """Edges (a, b) that ``link`` finds among the payloads of each block (gid, slot) of ``rows(gid, slot, id, payload)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, payloads = None, [], []
        out: list[tuple[int, int]] = []

        def close() -> None:
            if len(ids) > 1:
                out.extend((ids[i], ids[j]) for i, j in link(payloads))
            ids.clear()
            payloads.clear()

        def batch_of(pairs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

        for batch in batches:
            for gid, slot, item, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (gid, slot) != now:
                    close()
                    now = (gid, slot)
                ids.append(item)
                payloads.append(payload)
            if out:
                yield batch_of(out)
                out.clear()
        close()
        if out:
            yield batch_of(out)

    dealt = rows.select("gid", "slot", "id", "payload").repartition("gid", "slot").sortWithinPartitions("gid", "slot", "id")
    return dealt.mapInArrow(run, "a long, b long")


def in_slots(payloads: Callable[[DataFrame], DataFrame], asked: DataFrame) -> DataFrame:
    """A row (gid, slot, id, payload) for each of the slots of ``asked(id, gid, slots)``."""
    return payloads(asked).select("gid", F.explode("slots").alias("slot"), "id", "payload")


def rare_groups(parts: DataFrame, payloads: Callable[[DataFrame], DataFrame], elements: Elements, needed: Needed | None = None) -> DataFrame:
    """Items (id, gid, weight) of ``parts(id, gid, own, weight)`` in groups that share a rare element but not ``own``.

    Elements are ranked by the items of their group that have them; of each
    item as many of the rarest count as ``elements`` says, so that any two
    linked items share one of these. The first one that they share has before it
    only elements that they don't share: with ``needed``, an item stays with an
    element only if what follows it suffices for a link with the smallest other
    item there. So items that have a template in common, but too much else
    besides, meet nowhere. Groups of the same items count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gid", "id", "element", "take", "size"]
        for batch in batches:
            for gid, item, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found, take = elements(payload)
                for k in range(0, len(found), BATCH):
                    some = found[k : k + BATCH]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), x, np.int64)) for x in (gid, item)] + [pa.array(some)] + [pa.array(np.full(len(some), x, np.int64)) for x in (take, len(found))], names)

    asked = parts.select("id", "gid", F.array().cast("array<int>").alias("slots"))
    every = durable(payloads(asked).select("gid", "id", "payload").mapInArrow(run, "gid long, id long, element long, take long, size long"))
    known = every.groupBy("gid", "element").agg(F.count("*").alias("n")).where("n > 1")
    of_item = Window.partitionBy("gid", "id")
    ranked = every.join(known, ["gid", "element"]).withColumns({"shared": F.count("*").over(of_item), "rank": F.row_number().over(of_item.orderBy("n", "element"))})
    # elements that no other item has come first
    rare = ranked.where(F.col("rank") <= F.col("take") - (F.col("size") - F.col("shared"))).select("gid", "id", "element", "size", (F.col("shared") - F.col("rank") + 1).alias("left"))
    for _ in range(ROUNDS if needed else 0):
        rare = durable(rare)
        least = rare.groupBy("gid", "element").agg(F.min("size").alias("least"), F.count("*").alias("n")).where("n > 1").select("gid", "element", "least")
        rare = rare.join(least, ["gid", "element"]).where(F.col("left") >= needed(F.col("size"), F.col("least"))).drop("least")
    at = durable(rare.select("gid", "id", "element").join(parts, ["gid", "id"]))
    here = at.groupBy("gid", "element").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("items")).where("lo < hi")
    once = here.groupBy("gid", "n", "items").agg(F.min("element").alias("element")).select("gid", "element")
    return at.join(once, ["gid", "element"]).select("id", F.xxhash64("gid", "element").alias("gid"), "weight")


def linked_components(items: DataFrame, payloads: Callable[[DataFrame], DataFrame], link: Link, block_weight: int, elements: Elements | None = None, needed: Needed | None = None) -> DataFrame:
    """(node, component) by the exact measure within candidate groups.

    ``items(id, gid, weight)``; ``payloads(t)`` adds a column ``payload`` to a
    table of id, gid and slots; ``link`` gives a spanning forest of the links
    among a list of payloads. A block holds up to about BLOCK items and
    ``block_weight`` of weight. With ``elements`` no group whose parts are
    large is compared whole, and with ``needed`` items that only have a common
    part too small for a link aren't compared at all.
    """
    items = durable(items)
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("w") / block_weight)).cast("int")
    sizes = items.groupBy("gid").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).withColumn("m", blocks).where("m > 1").select("gid", "n", "m")
    placed = items.join(sized(durable(sizes)), "gid", "left").select("id", "gid", "weight", "n", F.coalesce("m", F.lit(1)).alias("m"))
    own = F.pmod(F.xxhash64("id"), F.col("m")).cast("int")
    hub = (F.col("m") > 1) & (F.pmod(F.xxhash64("id", F.lit("hub")), F.col("n")) < HUBS)
    slots = F.when(hub, F.sequence(F.lit(0), F.col("m") - 1)).otherwise(F.array(own))
    edges = compact(block_edges(in_slots(payloads, placed.select("id", "gid", slots.alias("slots"))), link))
    found = durable(connected_components(edges))
    large = placed.where("m > 1")
    if large.isEmpty():
        return found
    parts = durable(large.join(sized(found), F.col("id") == F.col("node"), "left").select("id", "gid", "weight", "m", F.coalesce("component", "id").alias("own")))
    main = parts.groupBy("gid", "own").count().groupBy("gid").agg(F.max_by("own", F.struct("count", "own")).alias("main"), F.max("count").alias("of_main"), F.sum("count").alias("n"))
    left = durable(main.select("gid", "main", (F.col("n") - F.col("of_main")).alias("t")).where("t > 0"))
    apart = parts.join(sized(left), "gid").withColumn("apart", F.col("own") != F.col("main"))
    whole = apart if elements is None else apart.where(F.col("t") <= BLOCK)
    if not whole.isEmpty():
        # outsiders meet every block of the group's members, a block of outsiders at a time
        o = F.ceil(F.col("t") / BLOCK).cast("int")
        members = F.transform(F.sequence(F.lit(0), o - 1), lambda k: k * F.col("m") + F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
        outer = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: F.pmod(F.xxhash64("id", F.lit("out")), o).cast("int") * F.col("m") + k)
        again = whole.select("id", "gid", F.when(F.col("apart"), F.array_union(members, outer)).otherwise(members).alias("slots"))
        edges = edges.unionByName(compact(block_edges(in_slots(payloads, again), link)))
    many = apart.where(F.col("t") > BLOCK).select("id", "gid", "own", "weight")
    if elements is not None and not many.isEmpty():
        more = linked_components(rare_groups(durable(many), payloads, elements, needed), payloads, link, block_weight)
        edges = edges.unionByName(more.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
    return connected_components(edges)

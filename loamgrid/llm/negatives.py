"""Hard negatives by ball trees, exactly.

The rows of a partition become trees of bounded size, where they lie: each node
is a ball (centre, radius) that holds its rows, so the inner product of an
anchor q with any of them is q.c - |q| r at least and q.c + |q| r at most. A
search leaves out the nodes whose bounds miss the window of wanted scores, and
those strictly beneath the k-th best score so far, which a task carries from one
tree to the next. What is left is compared exactly, in integers.

Anchors are packed into blocks. Blocks of few bytes in all are broadcast to the
trees; more are dealt into cells of one tree and a bounded number of blocks. The
first search finds each anchor's positives over all rows, the second one the
negatives in their score windows; per anchor, only the first few rows of a task
are shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.llm.common import table
from loamgrid.llm.linking import BROADCAST_BYTES
from loamgrid.session import durable

#: Rows of a tree and of its leaves; anchors of a block; blocks of a cell, whose best rows a task carries at once.
TREE, LEAF, BLOCK, CELL = 8192, 48, 512, 32
#: Values of a tree's vectors.
TREE_VALUES = 1 << 21
#: Inner products up to here are exact in doubles.
EXACT = 2.0**53


def participants(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """vec_id, label, vector (as doubles) of rows without nulls and with finite components."""
    found = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return found.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & whole)


def compact_type(values: np.ndarray) -> np.ndarray:
    """Integers in doubles, in the narrowest type that holds them."""
    most = float(np.abs(values).max()) if values.size else 0.0
    for kind, bound in ((np.int16, 2.0**15), (np.int32, 2.0**31)):
        if most < bound:
            return values.astype(kind)
    return values


def split_rows(vectors: np.ndarray) -> np.ndarray:
    """Which rows go left: those nearer to one of two far rows than to the other, or half of them where that leaves a side thin."""
    centre = vectors.mean(axis=0)
    a = vectors[np.argmax(((vectors - centre) ** 2).sum(axis=1))]
    b = vectors[np.argmax(((vectors - a) ** 2).sum(axis=1))]
    along = vectors @ (b - a)
    left = along < (a @ (b - a) + b @ (b - a)) / 2
    if not len(vectors) <= 10 * left.sum() <= 9 * len(vectors):
        left = np.zeros(len(vectors), bool)
        left[np.argsort(along, kind="stable")[: len(vectors) // 2]] = True
    return left


def build_tree(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> bytes:
    """A ball tree: rows in the order of its leaves, and its nodes, parents before children.

    A node has its rows' range, its parent, whether it is a leaf, its centre and
    radius, and its least and greatest label.
    """
    order, nodes, centres = np.arange(len(ids)), [], []
    queue = [(0, len(ids), -1)]
    for first, end, parent in queue:
        own = order[first:end]
        rows = vectors[own]
        centre = rows.mean(axis=0)
        radius = float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max()))
        leaf = end - first <= LEAF
        nodes.append((first, end, parent, leaf, radius, labels[own].min(), labels[own].max()))
        centres.append(centre)
        if not leaf:
            left = split_rows(rows)
            order[first:end] = np.concatenate([own[left], own[~left]])
            middle = first + int(left.sum())
            queue += [(first, middle, len(nodes) - 1), (middle, end, len(nodes) - 1)]
    columns = [np.array(c) for c in zip(*nodes)]
    return pickle.dumps((ids[order], labels[order], compact_type(vectors[order]), np.array(centres), *columns), protocol=5)


def packed(rows: DataFrame, most: int, make) -> DataFrame:
    """Up to ``most`` neighbouring rows of equal dimensions as one row: part, dims, n_rows, body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, waiting = TaskContext.get().partitionId(), 0, {}

        def put(dims: int) -> pa.RecordBatch:
            nonlocal made
            ids, labels, vectors = (np.concatenate(c) for c in zip(*waiting.pop(dims)))
            made += 1
            return pa.RecordBatch.from_pydict({"part": [(task << 33) + made], "dims": pa.array([dims], pa.int32()), "n_rows": pa.array([len(ids)], pa.int32()), "body": [make(ids, labels, vectors)]})

        for batch in batches:
            lengths = np.asarray(pc.list_value_length(batch["vector"]))
            starts = np.concatenate([[0], np.cumsum(lengths)])
            ids, labels, values = batch["vec_id"].to_numpy(), batch["label"].to_numpy(), np.floor(256 * batch["vector"].flatten().to_numpy())
            for dims in np.unique(lengths):
                at = np.flatnonzero(lengths == dims)
                size = min(most, max(1, TREE_VALUES // max(1, int(dims))))
                while len(at):
                    have = waiting.setdefault(int(dims), [])
                    now, at = np.split(at, [size - sum(len(x[0]) for x in have)])
                    have.append((ids[now], labels[now], values[(starts[now][:, None] + np.arange(dims)).ravel()].reshape(len(now), int(dims))))
                    if sum(len(x[0]) for x in have) >= size:
                        yield put(int(dims))
            while sum(len(x[0]) for have in waiting.values() for x in have) > most:
                yield put(max(waiting, key=lambda d: sum(len(x[0]) for x in waiting[d])))
        for dims in sorted(waiting):
            if waiting[dims]:
                yield put(dims)

    return rows.mapInArrow(run, "part long, dims int, n_rows int, body binary")


class Best:
    """The first ``k`` rows found for each of n windows: greater scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def kth(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, windows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(windows)
        held = self.scores[touched].ravel()
        real = held > -np.inf
        windows = np.concatenate([np.repeat(touched, self.k)[real], windows])
        scores, ids = np.concatenate([held[real], scores]), np.concatenate([self.ids[touched].ravel()[real], ids])
        order = np.lexsort((ids, -scores, windows))
        windows, scores, ids = windows[order], scores[order], ids[order]
        rank = np.arange(len(windows)) - np.searchsorted(windows, windows)
        first = rank < self.k
        self.scores[touched] = -np.inf
        self.scores[windows[first], rank[first]], self.ids[windows[first], rank[first]] = scores[first], ids[first]


def search(tree: tuple, anchors: tuple, lowest: np.ndarray, highest: np.ndarray, best: Best, same: bool) -> int:
    """Put the tree's rows with scores in an anchor's windows into ``best``; the number of rows that were compared.

    ``lowest`` and ``highest`` are arrays of anchors by windows. ``same``: rows of
    the anchor's label but for itself, else rows of other labels.
    """
    ids, labels, vectors, centres, first, end, parent, leaf, radius, low_label, high_label = tree
    a_ids, a_labels, a_vectors = anchors
    queries, rows = a_vectors.astype(float), vectors.astype(float)
    lengths = np.sqrt((queries**2).sum(axis=1))
    if len(queries) and len(rows) and lengths.max() * np.sqrt((rows**2).sum(axis=1).max()) >= EXACT:
        raise OverflowError("components are too large for exact scores")
    middle, reach = queries @ centres.T, lengths[:, None] * radius
    slack = 1e-9 * (np.abs(middle) + reach) + 1e-6  # rounding of the bounds; scores are integers
    above, below = middle + reach + slack, middle - reach - slack
    pure = low_label == high_label
    other = pure & (low_label != a_labels[:, None]) if same else pure & (low_label == a_labels[:, None])
    apart = (a_labels[:, None] < low_label) | (a_labels[:, None] > high_label) if same else other
    n_windows = lowest.shape[1]
    window_of = np.arange(len(queries))[:, None] * n_windows + np.arange(n_windows)

    def open_windows(which: np.ndarray, node: int | slice) -> np.ndarray:
        """Whether a row of the node can still count, by anchor (and node)."""
        kth = best.kth()[window_of[which]]
        found = False
        for w in range(n_windows):
            floor = np.maximum(lowest[which, w], kth[:, w])
            if isinstance(node, slice):
                found = found | ((above[which, node] >= floor[:, None]) & (below[which, node] <= highest[which, w][:, None]) & (lowest[which, w] <= highest[which, w])[:, None])
            else:
                found = found | ((above[which, node] >= floor) & (below[which, node] <= highest[which, w]) & (lowest[which, w] <= highest[which, w]))
        return found

    everyone = np.arange(len(queries))
    alive = open_windows(everyone, slice(None)) & ~apart
    for node in range(1, len(first)):  # parents come before their children
        alive[:, node] &= alive[:, parent[node]]
    compared = 0
    for node in sorted(np.flatnonzero(leaf & alive.any(axis=0)), key=lambda x: -above[alive[:, x], x].max()):
        which = np.flatnonzero(alive[:, node])
        which = which[open_windows(which, node)]
        if not len(which):
            continue
        span = slice(first[node], end[node])
        scores = queries[which] @ rows[span].T
        compared += scores.size
        match = labels[span] == a_labels[which][:, None]
        match = match & (ids[span] != a_ids[which][:, None]) if same else ~match
        kth = best.kth()[window_of[which]]
        found = []
        for w in range(n_windows):
            q, r = np.nonzero(match & (scores >= np.maximum(lowest[which, w], kth[:, w])[:, None]) & (scores <= highest[which, w][:, None]))
            found.append((window_of[which[q], w], scores[q, r], ids[span][r]))
        found = [np.concatenate(c) for c in zip(*found)]
        if len(found[0]):
            best.add(*found)
    return compared


def grid(trees: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each tree with each block of anchors of its dimensions; ``blocks`` have more columns than body.

    Blocks of few bytes are broadcast; more are dealt with trees into cells.
    """
    # A block's windows take less than seven times its anchors, of which each has 64 values or so.
    n_blocks, n_bytes = blocks.agg(F.count("*"), F.sum(F.octet_length("body") * 8 + 64)).first()
    if (n_bytes or 0) <= BROADCAST_BYTES:
        return trees.select("dims", F.col("body").alias("tree")).join(F.broadcast(blocks), "dims")
    n_cells, n_trees = -(-n_blocks // CELL), trees.count()
    dealt = lambda n: F.pmod(F.xxhash64("part"), F.lit(n).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long")))
    cut = trees.select("dims", F.col("body").alias("tree"), dealt(max(n_trees, 1)).alias("_tree"), every(n_cells).alias("_cell"))
    copies = blocks.withColumn("_cell", dealt(n_cells)).withColumn("_tree", every(n_trees))
    return cut.join(copies, ["dims", "_cell", "_tree"]).drop("_cell", "_tree")


def first_rows(cells: DataFrame, k: int, same: bool) -> DataFrame:
    """(part, anchor, window, rank, found_id, score): the first ``k`` rows of all trees for each window of each anchor.

    ``cells`` have tree, body and, unless ``same``, windows: (anchor, window,
    lowest, highest) of the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Best, int]] = {}

        def rows() -> pa.RecordBatch:
            names = ("part", "anchor", "window", "found_id", "score")
            found = [[] for _ in names]
            for part, (best, n_windows) in held.items():
                q, r = np.nonzero(best.scores > -np.inf)
                for column, values in zip(found, (np.full(len(q), part), q // n_windows, q % n_windows, best.ids[q, r], best.scores[q, r])):
                    column.append(values.astype(np.int64))
            held.clear()
            return pa.RecordBatch.from_pydict({n: np.concatenate(c) if c else np.zeros(0, np.int64) for n, c in zip(names, found)})

        last: tuple = (None, None)
        for batch in batches:
            for k_row in range(batch.num_rows):
                row = {c: batch[c][k_row] for c in batch.schema.names}
                body = row["tree"].as_buffer()
                if last[0] is None or not last[0].equals(body):
                    last = (body, pickle.loads(body))
                anchors = pickle.loads(row["body"].as_buffer())
                part = row["part"].as_py()
                if part not in held and len(held) >= CELL:
                    yield rows()
                if same:
                    lowest, highest = np.full((len(anchors[0]), 1), -np.inf), np.full((len(anchors[0]), 1), np.inf)
                else:
                    windows = row["windows"].values
                    at, w, low, high = (np.asarray(windows.field(c)) for c in ("anchor", "window", "lowest", "highest"))
                    lowest, highest = np.full((len(anchors[0]), int(w.max()) + 1), np.inf), np.full((len(anchors[0]), int(w.max()) + 1), -np.inf)
                    lowest[at, w], highest[at, w] = low, high
                if part not in held:
                    held[part] = (Best(lowest.size, k), lowest.shape[1])
                search(last[1], anchors, lowest, highest, held[part][0], same)
        yield rows()

    found = cells.select("part", "tree", "body", *([] if same else ["windows"])).mapInArrow(run, "part long, anchor long, window long, found_id long, score long")
    order = Window.partitionBy("part", "anchor", "window").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and vector, without nulls; each component x
    counts as floor(256 * x). An anchor's positives are the first other rows of
    its label, by score and then by smaller vec_id. For each, the negatives are
    the first rows of other labels with low * positive_score <= 100 * score <=
    high * positive_score; a positive of negative score has none, if low < high.
    Rows are scored with rows of equal dimensions only. A row of the anchor's own
    vec_id is no positive; other repeated rows count each, and repeated anchors
    are searched each. Scores over 2 ** 53 raise an error. Other columns are left
    out.
    """
    rows = vectors.select("vec_id", "label", "vector")
    trees = durable(packed(rows, TREE, build_tree))
    chosen = rows.where(is_anchor)
    parts = max(1, -(-chosen.count() // BLOCK))
    body = lambda ids, labels, values: pickle.dumps((ids, labels, compact_type(values)), protocol=5)
    blocks = durable(packed(chosen.repartition(parts), BLOCK, body).select("part", "dims", "body"))
    ids = durable(blocks.select("part", "body").mapInArrow(anchor_ids, "part long, anchor long, anchor_id long"))
    near = durable(first_rows(grid(trees, blocks), positives, True))
    # An integer score is in the window from the least integer that reaches low to the greatest within high.
    least, most = -F.floor(-F.col("score") * low / 100), F.floor(F.col("score") * high / 100)
    windows = near.groupBy("part").agg(F.collect_list(F.struct("anchor", (F.col("rank") - 1).cast("long").alias("window"), least.cast("double").alias("lowest"), most.cast("double").alias("highest"))).alias("windows"))
    found = first_rows(grid(trees, blocks.join(windows, "part")), negatives, False)
    named = near.join(ids, ["part", "anchor"]).select("part", "anchor", (F.col("rank") - 1).cast("long").alias("window"), "anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(found, ["part", "anchor", "window"]).select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def anchor_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids = pickle.loads(batch["body"][k].as_buffer())[0]
            yield pa.RecordBatch.from_pydict({"part": np.full(len(ids), batch["part"][k].as_py()), "anchor": np.arange(len(ids)), "anchor_id": ids})


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows of ``embeddings`` whose vec_id 100 divides.

    Labels of rows whose vec_id 7 divides move on by one, modulo 10. Rows with a
    null id, label, vector or component, or one that isn't finite, take no part.
    """
    rows = participants(table(spark, sf_dir, "embeddings"))
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(moved, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

import math
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import negatives


def brute(rows, positives=5, k=5, is_anchor=lambda i: i % 100 == 0):
    clean = [(i, c, [math.floor(256 * x) for x in v]) for i, c, v in rows if None not in (i, c, v) and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for a, label, q in clean:
        if not is_anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), i, c) for i, c, v in clean if i != a and len(v) == len(q)]
        own = sorted(s[:2] for s in scored if s[2] == label)[:positives]
        # Rows of the anchor's id are no positives, but those of another label can be negatives.
        scored += [(-sum(x * y for x, y in zip(q, v)), i, c) for i, c, v in clean if i == a and c != label and len(v) == len(q)]
        for p, pid in own:
            wanted = sorted(s[:2] for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p)[:k]
            found += [(a, pid, rank + 1, nid, -p, -s) for rank, (s, nid) in enumerate(wanted)]
    return sorted(found)


def rows_of(found):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


def frame(spark, rows, parts=6):
    return negatives.participants(spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").repartition(parts))


def clustered(n, seed, dims=6, labels=4, step=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims))
    at = centres[rng.integers(0, 8, n)] + rng.normal(size=(n, dims)) * rng.choice([0.0, 0.05, 0.4], n)[:, None]
    at /= np.linalg.norm(at, axis=1)[:, None]
    return [(i * step, int(rng.integers(0, labels)), [float(np.float32(x)) for x in v]) for i, v in enumerate(at)]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("TREE", 60), ("LEAF", 5), ("BLOCK", 7), ("CELL", 3)):
        monkeypatch.setattr(negatives, name, value)


@pytest.mark.parametrize("bound", [1 << 24, 0])
def test_clusters_ties_and_repeats_equal_brute_force(spark, small, monkeypatch, bound):
    monkeypatch.setattr(negatives, "BROADCAST_BYTES", bound)
    rows = clustered(700, 3)
    rows += [(1_000_000 + i, i % 3, rows[5][2]) for i in range(60)]  # equal vectors, so ties by id
    rows += [(40, 1, rows[5][2]), (40, 2, rows[6][2]), rows[5], rows[7]]  # repeated ids and rows
    found = rows_of(negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0))
    assert found == brute(rows) and len(found) > 500


def test_nulls_odd_components_and_dimensions(spark, small):
    rows = clustered(200, 4) + [(i * 50, i % 2, v) for i, v in enumerate([[1.0, 2.0], [2.0, 1.0], [1.5, 1.0], [-1.0, -1.0], [0.0, 0.0], [1.0, 1.4], [], [], []])]
    odd = [(100, None, rows[0][2]), (200, 1, None), (None, 1, rows[0][2]), (300, 1, [float("nan")] * 6), (400, 2, [float("inf")] + [0.0] * 5), (500, 2, [None] + [0.0] * 5), (600, 2, [-float("inf")] * 6)]
    found = rows_of(negatives.mine(frame(spark, rows + odd), F.col("vec_id") % 100 == 0))
    assert found == brute(rows) and found


def test_fewer_rows_than_asked_for(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.8, 0.0]), (3, 2, [0.1, 0.0]), (4, 3, [0.95, 0.0])]
    found = rows_of(negatives.mine(frame(spark, rows), F.col("vec_id") == 0))
    assert found == brute(rows, is_anchor=lambda i: i == 0) == [(0, 1, 1, 2, 256 * 230, 256 * 204)]


def test_empty_tables(spark):
    none = negatives.mine(frame(spark, []), F.col("vec_id") % 100 == 0)
    assert none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and none.count() == 0
    assert negatives.mine(frame(spark, [(1, 1, [1.0])]), F.col("vec_id") % 100 == 0).count() == 0


def test_scores_past_exact_doubles_are_errors(spark):
    rows = [(i * 100, 1, [1e9, 1.0]) for i in range(3)]
    with pytest.raises(Exception, match="too large for exact scores"):
        negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0).collect()


def test_the_window_ends_are_whole(spark):
    # 80 * 5 = 400 = 100 * 4: the least score allowed for a positive of 5 is 4, for one of 4 it is 3.2, so 4.
    unit = lambda k: [k / 256]
    rows = [(0, 0, unit(1)), (1, 0, unit(5)), (2, 0, unit(4)), (3, 1, unit(5)), (4, 1, unit(4)), (5, 1, unit(3)), (6, 1, unit(6))]
    found = rows_of(negatives.mine(frame(spark, rows), F.col("vec_id") == 0))
    assert found == brute(rows, is_anchor=lambda i: i == 0) == [(0, 1, 1, 3, 5, 5), (0, 1, 2, 4, 5, 4), (0, 2, 1, 4, 4, 4)]


def test_bounds_hold_and_prune():
    rows = clustered(3000, 9, dims=4)
    ids, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    vectors = np.floor(256 * np.array([r[2] for r in rows]))
    tree = pickle.loads(negatives.build_tree(ids, labels, vectors))
    _, _, held, centres, first, end, parent, leaf, radius, low, high = tree
    for node in range(len(first)):
        inside = held[first[node] : end[node]].astype(float)
        assert np.sqrt(((inside - centres[node]) ** 2).sum(axis=1)).max() <= radius[node] + 1e-9
    assert sorted(zip(first[leaf], end[leaf]))[0][0] == 0 and (end - first)[leaf].sum() == 3000 and (end - first)[leaf].max() <= negatives.LEAF
    anchors = (ids[:20], labels[:20], vectors[:20])
    best = negatives.Best(20, 5)
    compared = negatives.search(tree, anchors, np.full((20, 1), -np.inf), np.full((20, 1), np.inf), best, True)
    assert compared < 20 * 3000 / 3
    again = negatives.search(tree, anchors, np.full((20, 1), -np.inf), np.full((20, 1), np.inf), negatives.Best(20, 5), False)
    assert 0 < again < 20 * 3000


def test_a_pruned_search_carries_the_kth_score_between_trees():
    rows = clustered(2000, 6, dims=4)
    ids, labels, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.floor(256 * np.array([r[2] for r in rows]))
    trees = [pickle.loads(negatives.build_tree(ids[k::2], labels[k::2], vectors[k::2])) for k in (0, 1)]
    anchors, wide = (ids[:9], labels[:9], vectors[:9]), (np.full((9, 1), -np.inf), np.full((9, 1), np.inf))
    carried, fresh = negatives.Best(9, 5), negatives.Best(9, 5)
    negatives.search(trees[0], anchors, *wide, carried, True)
    assert negatives.search(trees[1], anchors, *wide, carried, True) <= negatives.search(trees[1], anchors, *wide, fresh, True)

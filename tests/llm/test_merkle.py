import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loamgrid.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    n = row["n_chars"] if row["n_chars"] is None else row["n_chars"] + more
    values = (row["doc_id"], row["source"], row["lang"], n, row["text"])
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(hashes):
    found = [hashes]
    while len(found[-1]) > 1:
        below = found[-1]
        found.append([digest("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return found


def proof_and_fold(levels, pos, start):
    beside = []
    for level in levels[:-1]:
        run = level[pos - pos % 2 : pos - pos % 2 + 2]
        beside += [h for i, h in enumerate(run) if i != pos % 2]
        start = digest("".join(start if i == pos % 2 else h for i, h in enumerate(run)))
        pos //= 2
    return beside, start


def brute(rows):
    """The contract's columns, by building every tree whole."""
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        groups[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[lang] = levels_of([leaf_of(r) for r in groups[lang]])
    top = levels_of([trees[lang][-1][0] for lang in order])
    found = []
    for k, lang in enumerate(order):
        for pos, r in enumerate(groups[lang]):
            leaf, tampers = leaf_of(r), r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            below, subroot = proof_and_fold(trees[lang], pos, leaf_of(r, 1) if tampers else leaf)
            above, root = proof_and_fold(top, k, subroot)
            found.append((r["doc_id"], leaf, trees[lang][-1][0], top[-1][0], digest("".join(below + above)), root, root == top[-1][0]))
    return found


def run(spark, tmp_path, rows, parts=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    df.withColumn("path", F.lit("x")).withColumn("tree", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    found = merkle.op13_merkle_manifest(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in found.collect()]


def random_rows(n, seed, langs):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "é日😀", "a:b-", "x" * 5000, str(rng.random())])
    return [(rng.choice([None, i, i, i, i % 7, -i]), text(), rng.choice(langs), rng.choice([None, "s", "s1", ""]), rng.choice([None, rng.randrange(99), -1])) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 300])
def test_small_tables_equal_brute_force(spark, tmp_path, n):
    rows = random_rows(n, n, [None, "", "de", "é", "z", "日"])
    assert sorted(run(spark, tmp_path, rows), key=repr) == sorted(brute(rows), key=repr)


def test_three_tiers_and_a_hot_tree_equal_brute_force(spark, tmp_path):
    rows = random_rows(9000, 1, ["en"] * 30 + [None, "fr"]) + [(7, "same", "en", "s", 4)] * 700 + [(1, "alone", "xx", None, None)]
    found = run(spark, tmp_path, rows)
    assert sorted(found, key=repr) == sorted(brute(rows), key=repr)
    assert {r[-1] for r in found} == {True, False}


def test_many_trees_equal_brute_force(spark, tmp_path):
    rows = [(i, "t", f"lang{i % 150}", "s", i) for i in range(400)]
    assert sorted(run(spark, tmp_path, rows)) == sorted(brute(rows))


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_only_tampered_rows_fail(spark):
    found = merkle.op13_merkle_manifest(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == 1000
    for r in found:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)


def test_stored_parents_lead_to_the_subroot(spark):
    rows = [(i, "t", "a" if i % 3 else None, "s", i) for i in range(700)]
    leaves = merkle.document_leaves(spark.createDataFrame(rows, SCHEMA))
    found, below, over = merkle.prove(leaves, "doc_id")
    flat = {(r.tree, r.level, r.k): r.preimage for r in merkle.parents(below).collect()}
    for tree, n in (("=a", 466), ("", 234)):
        level = 1
        while n > 1:
            n = -(-n // 2)
            assert sorted(k for t, lv, k in flat if (t, lv) == (tree, level)) == list(range(n))
            if level > 1:
                for k in range(n):
                    below_it = [flat[tree, level - 1, c] for c in (2 * k, 2 * k + 1) if (tree, level - 1, c) in flat]
                    assert flat[tree, level, k] == "".join(map(digest, below_it))
            level += 1
        top = {r.subroot for r in found.where(F.col("tree") == tree).collect()}
        assert top == {digest(flat[tree, level - 1, 0])}
    assert merkle.parents(over).count() == 1


def test_no_group_or_task_grows_with_a_tree(spark):
    leaves = merkle.document_leaves(spark.range(3000).selectExpr("id AS doc_id", "'t' AS text", "'a' AS lang", "'s' AS source", "id AS n_chars"))
    nodes = merkle.positions(leaves, "doc_id")
    assert nodes.agg(F.max("n"), F.max("pos"), F.countDistinct("pos")).first() == (3000, 2999, 3000)
    blocks = merkle.block_rows(nodes)
    assert blocks.count() == 47 and blocks.agg(F.max(F.size(F.col("levels")[0]))).first()[0] == merkle.WIDTH // merkle.ARITY

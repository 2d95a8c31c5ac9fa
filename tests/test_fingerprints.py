import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.functions import text, vec
from loamgrid.operators import fingerprints, hamming

ROWS = [(0, "a b  c a"), (1, ""), (2, None), (3, " "), (4, "é 漢字 a\nb c"), (5, "x " * 400), (6, None)] + [(10 + k, " ".join(random.Random(k).choices("lorem ipsum dolor sit amet ut enim ad".split(), k=k % 60 + 1))) for k in range(450)]


def test_fingerprints_equal_the_expressions(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "SLICE", 7)
    monkeypatch.setattr(fingerprints, "KNOWN", 3)
    df = spark.createDataFrame(ROWS, "id long, text string").repartition(3)
    tokens = F.split("text", " ")
    spots = F.transform(tokens, lambda t: text.token_hash(t).bitwiseAND(F.lit(15)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda d: F.size(F.filter(spots, lambda s: s == d)))
    want = df.select("id", F.when(F.col("text").isNotNull(), text.simhash(tokens)).alias("h"), F.when(F.col("text").isNotNull(), counts).alias("feature"))
    found = fingerprints.fingerprints(df, "text", 16)
    assert found.columns == ["id", "h", "feature"] and sorted(found.collect()) == sorted(want.collect())


def test_correlations_equal_those_of_the_expression(spark):
    rng, pick = np.random.default_rng(1), random.Random(1)
    kinds = [lambda: rng.integers(0, 9, 12).astype(float).tolist(), lambda: rng.normal(size=12).tolist(), lambda: (rng.integers(0, 3, 12) * 200.0).tolist(), lambda: [4.0] * 12, lambda: None]
    features = spark.createDataFrame([(i, pick.choice(kinds)()) for i in range(80)], "id long, feature array<double>").repartition(4)
    pairs = spark.createDataFrame([(a, b, a * b) for a in range(82) for b in range(a)], "a long, b long, more long")
    found = {(r.a, r.b): r for r in fingerprints.correlated(pairs, features, -0.2).collect()}
    want = {(r.a, r.b): r for r in hamming.confirmed(pairs, features, vec.pearson, -0.2).collect()}
    assert set(found) == set(want)
    assert all(found[k].r == pytest.approx(want[k].r, abs=1e-12) and found[k].more == k[0] * k[1] for k in want)
    assert fingerprints.correlated(pairs.where("false"), features, 0.0).count() == 0


def test_texts_are_not_shuffled(spark, tmp_path):
    from loamgrid.plans import integrity

    docs = [(i, "abc"[i % 3], "s", f"word{i % 40} and more {i % 7}") for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items = integrity.fingerprinted(spark, str(tmp_path))
    assert "text" not in items.columns and items.count() == len({d[3] for d in docs})
    assert "text" not in items._jdf.queryExecution().optimizedPlan().toString()

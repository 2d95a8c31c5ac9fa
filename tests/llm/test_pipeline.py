import random

import pytest
from pyspark.sql import functions as F
from test_llm_operators import DOCS, brute_components, brute_contamination, frame, prose

import corpus_pipeline as pipeline


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    rng = random.Random(21)
    texts = [prose(rng, rng.randrange(40, 120)) for _ in range(120)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(200 + k, texts[k], "en", "s0") for k in range(10)]  # copies
    rows += [(300 + k, " ".join([*texts[k].split()[:-1], "changed"]), "en", "s1") for k in range(10)]  # near copies
    bench = [(1, prose(rng, 40)), (2, prose(rng, 15))]
    rows += [(400 + k, f"{bench[k][1]} {prose(rng, 30)}", "en", "s2") for k in range(2)]
    rows += [(500, None, "en", "s0"), (501, "123 ...", "en", "s0"), (502, "", None, None)]
    folder = str(tmp_path_factory.mktemp("sf"))
    frame(spark, rows).withColumn("found", F.lit("extra")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, bench


def test_stages_follow_each_other(spark, given, tmp_path):
    folder, rows, bench = given
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        assert out.columns == docs.columns
        kept[name], docs = {r["doc_id"]: r["text"] for r in out.collect()}, out
    first = kept["language_id"]
    assert first.keys() == {r[0] for r in rows} - {500, 501, 502}
    assert first.keys() - kept["line_dedup"].keys() >= set(range(200, 210)) and set(range(120)) <= kept["line_dedup"].keys()
    groups = brute_components(list(kept["line_dedup"].items()), 5, 80)
    assert kept["near_dedup"].keys() == {i for i, (_, c) in groups.items() if i == c}
    found = brute_contamination(list(kept["near_dedup"].items()), bench)
    assert kept["decontamination"].keys() == {i for i, f in found.items() if not f[3]} and not {400, 401} & kept["decontamination"].keys()
    assert kept["mixing"] and kept["mixing"].items() <= kept["decontamination"].items()


def test_run_returns_documents(spark, given):
    out = pipeline.run(spark, given[0])
    assert {x.split()[0] for x in DOCS.split(", ")} <= set(out.columns) and out.count() > 0


def test_empty_documents(spark, given, tmp_path):
    none = spark.read.parquet(f"{given[0]}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, given[0]).count() == 0

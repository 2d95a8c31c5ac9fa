import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loamgrid.llm import bytebpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return bytebpe.read_ranks(file)


@pytest.fixture(scope="module")
def brute(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def loaded(spark):
    return bytebpe.load(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def random_texts(n, seed):
    rng = random.Random(seed)
    kinds = ["abcde", "aAbB  \n\t", "éßñ日本語한글", "😀👩‍👩‍👧🏽", "0123٣४Ⅷ", "'s't're   　", "!?=-_*#|", "\x00\x1f\x7f﻿​́", "ababab", "====", "𐀀𝒳"]
    return ["".join(rng.choice(rng.choice(kinds) if rng.random() < 0.5 else kinds[rng.randrange(len(kinds))]) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_texts_of_all_kinds_equal_brute_force(spark, loaded, brute):
    texts = random_texts(3000, 5) + ["", None, " ", "<|endoftext|>", "a" * 40_000, "ab" * 20_000, " " * 30_000, "word " * 40_000, "é" * 9_001, "same", "same"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _text string").repartition(7)
    ids = bytebpe.encode(df, loaded, offsets=True)
    assert ids.columns == ["doc_id", "_text", "_ids", "_starts", "_ends"]
    back = bytebpe.as_text(bytebpe.decode(ids, loaded))
    rows = {r.doc_id: r for r in back.collect()}
    found = {r.doc_id: r for r in ids.collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        text = text or ""
        want, have = brute.encode_ordinary(text), found[i]
        assert have._ids == want, text
        assert bytes(rows[i]._bytes) == text.encode() and rows[i]._text == text
        reach = 0
        for token, start, end in zip(want, have._starts, have._ends):
            piece = brute.decode_single_token_bytes(token)
            assert piece in text[start:end].encode() and start <= reach <= end
            reach = end
        assert reach == len(text)


def test_whole_table_equals_brute_force(spark, brute):
    from loamgrid.llm.common import table

    rows = {r.doc_id: r.text or "" for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    found = bytebpe.op11_byte_bpe(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in found) == sorted(rows)
    for r in found:
        ids = brute.encode_ordinary(rows[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()


def test_tokens_that_cut_characters(spark, loaded, brute):
    ids = brute.encode_ordinary("a日")
    assert len(ids) > 2
    df = spark.createDataFrame([(0, ids), (1, ids[:-1]), (2, ids[-1:]), (3, []), (4, None)], "k int, _ids array<int>")
    found = {r.k: r for r in bytebpe.as_text(bytebpe.decode(df, loaded)).collect()}
    assert found[0]._text == "a日" and found[1]._text.startswith("a�") and set(found[2]._text) == {"�"}
    assert found[3]._text == found[4]._text == ""
    assert b"".join(bytes(found[k]._bytes) for k in (1, 2)) == "a日".encode()


@pytest.mark.parametrize("bad", [50256, -1, None])
def test_unknown_ids_are_errors(spark, loaded, bad):
    with pytest.raises(Exception, match="not in the vocabulary"):
        bytebpe.decode(spark.createDataFrame([(0, [1, bad])], "k int, _ids array<int>"), loaded).collect()


def test_empty_table_and_clashing_names(spark, loaded):
    df = spark.createDataFrame([], "text string, _ids array<int>, _Bytes binary")
    ids = bytebpe.encode(df, loaded)
    assert ids.columns == ["_Bytes", "_ids"] and ids.count() == 0
    assert bytebpe.decode(ids, loaded).columns == ["_bytes"]
    one = spark.createDataFrame([("hi", "x y", 1)], "text string, `a b` string, _IDS int")
    assert bytebpe.encode(one, loaded).select(F.col("`a b`"), "_ids").first()[0] == "x y"


def test_merges_follow_from_ranks(ranks):
    import json

    with open(P.path("byte_bpe_50k.json")) as file:
        known = json.load(file)["model"]
    built = json.loads(bytebpe.tokenizer_json(ranks, P.PATTERN))["model"]
    assert built["merges"] == [list(m) for m in known["merges"]]
    with pytest.raises(ValueError, match="single bytes"):
        bytebpe.tokenizer_json({b"a": 0}, "a")


def test_a_stretch_is_encoded_once_and_cuts_change_no_ids(loaded, brute):
    import pyarrow as pa

    model, asked = bytebpe.opened(loaded.value), []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return model.encode_batch_fast(texts, **options)

    gaps = [" ", "  ", "   ", "\n", " \n", "\n ", "\n\n ", " \t ", " ", "  ", "  ", " 　", "  ", " \u0085", "\x1c ", " \x1f", "  ", "", "'s ", " 's"]
    words = ["a", "Bc", "12", "é", "日本", "…", "'ll", "́", "​", "\x7f", "😀", "«x»", "ã", ""]
    rng = random.Random(8)
    texts = ["", " ", "  ", "a ", " a", "a  ", "\n "] + ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(12))) for _ in range(4000)] + random_texts(1000, 6)
    encoder = bytebpe.Encoder(Counting())
    for part in (pa.array(["dropped ", *texts]).slice(1), pa.array(texts), pa.array([], pa.string()), pa.array([""])):
        assert encoder.ids(part).to_pylist() == [brute.encode_ordinary(t) for t in part.to_pylist()]
    short = [w for w in asked if len(w) <= bytebpe.KNOWN_LENGTH]
    assert len(short) == len(set(short))
    # a text of one word all over was encoded as often as it has words
    asked.clear()
    encoder.ids(pa.array([" stretch" * 50_000]))
    assert asked == [" stretch"]

"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams. The model is trained
by follow-the-regularised-leader with an elastic-net penalty on a bounded
sample; a temperature fitted on a part of the sample that training doesn't see
turns its scores into probabilities. Document frequencies cover all documents
that may be learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.common import fold_of, table

#: Hash buckets of n-grams, and the n-grams' lengths.
BUCKETS, LENGTHS = 1 << 15, (1, 2, 3)
#: Code points hashed at a time, so that memory doesn't follow a text's length.
BLOCK = 1 << 20
#: Expected number of rows of each language in the training sample (its bound).
SAMPLE_PER_LANG = 1000
#: Learning rate, its offset, and the two penalties; passes over the sample.
RATE, OFFSET, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.001, 3
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """For each code point: itself if it is a letter, else a space."""
    return np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), np.uint32, 0x110000)


def ngram_counts(text: str, letters: np.ndarray) -> np.ndarray:
    """Counts of the whole text's n-grams, by bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    text = text.lower()
    overlap = max(LENGTHS) - 1
    for start in range(0, max(len(text), 1), BLOCK):
        first = max(0, start - overlap)
        codes = letters[np.frombuffer(text[first : start + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        fresh = start - first
        hashed = codes.copy()
        for n in range(1, max(LENGTHS) + 1):
            if n > 1:
                hashed = hashed[:-1] * np.uint32(0x9E3779B1) + codes[n - 1 :]
            if n in LENGTHS and len(hashed):
                ends = hashed[max(0, fresh - n + 1) :]
                mixed = (ends ^ (ends >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F)
                counts += np.bincount((mixed ^ (mixed >> np.uint32(13))) >> np.uint32(17), minlength=BUCKETS)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def corpus_counts(docs: DataFrame) -> tuple[np.ndarray, int, dict[str, int]]:
    """Document frequency of each bucket, documents, and documents of each language, over all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, df, langs = letter_table(), np.zeros(BUCKETS, np.int64), {}
        for batch in batches:
            for text, lang in ((t.as_py(), g.as_py()) for t, g in zip(batch.column(0), batch.column(1), strict=True)):
                if has_letter(text):
                    df += ngram_counts(text, letters) > 0
                    langs[lang] = langs.get(lang, 0) + 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at.astype(np.int32)), "lang": pa.nulls(len(at), pa.string()), "n": pa.array(df[at])})
        if langs:
            yield pa.RecordBatch.from_pydict({"bucket": pa.nulls(len(langs), pa.int32()), "lang": pa.array(list(langs), pa.string()), "n": pa.array(list(langs.values()), pa.int64())})

    rows = docs.select("text", "lang").mapInArrow(run, "bucket int, lang string, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS, np.int64)
    for r in rows:
        if r["bucket"] is not None:
            df[r["bucket"]] = r["n"]
    langs = {r["lang"]: r["n"] for r in rows if r["bucket"] is None}
    return df, sum(langs.values()), langs


def bounded_sample(docs: DataFrame, langs: dict[str, int]) -> list[tuple]:
    """About SAMPLE_PER_LANG rows of each language: (order, lang, buckets, counts)."""
    share = F.create_map(*[F.lit(x) for lang, n in langs.items() for x in (lang, min(1.0, SAMPLE_PER_LANG / n))])
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id", "text"), F.lit(1 << 30))
    picked = docs.withColumn("draw", draw).where(F.col("draw") < share[F.col("lang")] * float(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            rows = []
            for text, lang, draw in ((x.as_py() for x in row) for row in zip(*batch.columns, strict=True)):
                if has_letter(text):
                    counts = ngram_counts(text, letters)
                    at = np.flatnonzero(counts)
                    rows.append((draw, lang, at.astype(np.int32), counts[at].astype(np.int32)))
            yield pa.RecordBatch.from_pydict({
                "draw": pa.array([r[0] for r in rows], pa.int64()),
                "lang": pa.array([r[1] for r in rows], pa.string()),
                "at": pa.array([r[2] for r in rows], pa.list_(pa.int32())),
                "n": pa.array([r[3] for r in rows], pa.list_(pa.int32())),
            })

    got = picked.select("text", "lang", "draw").mapInArrow(run, "draw long, lang string, at array<int>, n array<int>").toArrow()
    at, n = got.column("at").combine_chunks(), got.column("n").combine_chunks()
    rows = zip(got.column("draw").to_pylist(), got.column("lang").to_pylist(), ((at[i].values.to_numpy(), n[i].values.to_numpy()) for i in range(len(at))), strict=True)
    return sorted(rows, key=lambda r: (r[0], r[1]))


def tfidf(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    norm = np.sqrt(np.dot(x, x))
    return x / norm if norm else x


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights (BUCKETS + 1, classes), the last row being the intercepts."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((OFFSET + np.sqrt(n)) / RATE + L2))

    for _ in range(EPOCHS):
        for at, x, y in rows:
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            zr, nr = z[at], n[at]
            w = weights(zr, nr)
            error = softmax(x @ w)
            error[y] -= 1.0
            g = x[:, None] * error
            grown = nr + g * g
            z[at] = zr + g - (np.sqrt(grown) - np.sqrt(nr)) / RATE * w
            n[at] = grown
    return weights(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = np.log(np.maximum(softmax(logits / np.exp(t)), 1e-12))
        return -(0.99 * p[np.arange(len(labels)), labels] + 0.01 * p.mean(axis=1)).mean()  # one label in 100 may be wrong

    low, high, ratio = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class LanguageModel:
    """Languages, IDF weights, class weights and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.langs, self.idf, self.weights, self.heat = langs, idf, weights, heat

    def scores(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return tfidf(at, n, self.idf) @ self.weights[at] + self.weights[BUCKETS]

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        counts = ngram_counts(text, letters)
        at = np.flatnonzero(counts)
        p = softmax(self.scores(at, counts[at]) / self.heat)
        return self.langs[int(p.argmax())], float(p.max())


def train(docs: DataFrame) -> LanguageModel:
    """Learn from the text and lang of all rows of ``docs`` whose lang isn't null."""
    known = docs.where("lang is not null and text is not null")
    df, n, langs = corpus_counts(known)
    names = sorted(langs)
    idf = np.log((1 + n) / (1 + df)) + 1
    if not names:
        return LanguageModel([], idf, np.zeros((BUCKETS + 1, 0)), 1.0)
    sample = [(draw, at, tfidf(at, c, idf), names.index(lang)) for draw, lang, (at, c) in bounded_sample(known, langs)]
    learn = [r[1:] for r in sample if r[0] % 5] or [r[1:] for r in sample]
    aside = [r[1:] for r in sample if not r[0] % 5]
    weights = ftrl(learn, len(names))
    logits = np.array([x @ weights[at] + weights[BUCKETS] for at, x, _ in aside]).reshape(-1, len(names))
    heat = temperature(logits, np.array([y for _, _, y in aside], int))
    return LanguageModel(names, idf.astype(np.float32), weights.astype(np.float32), heat)


def language_of(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """struct(lang_pred, score) of a text column."""
    shared = spark.sparkContext.broadcast((model.langs, model.idf, model.weights, model.heat))
    kept: dict = {}

    def run(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.update(letters=letter_table(), model=LanguageModel(*shared.value))
        found = [kept["model"].predict(t.as_py(), kept["letters"]) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang_pred", "score"]
        )

    return F.arrow_udf(run, "lang_pred string, score double")(text)


def identify(docs: DataFrame, learn_from: Column, out: str = "found") -> DataFrame:
    """The language of every row's whole text, learned from the rows where ``learn_from`` holds.

    Adds ``out`` = struct(lang_pred, score) to all columns of ``docs``, in
    place of a column of that name. A text that is null or has no letter gets ``und`` and 0, as does every text
    if no row can be learned from. Repeated rows stay; ties between languages
    go to the first in order of name; an empty table gives an empty result.
    """
    model = train(docs.where(learn_from))
    return docs.withColumn(out, language_of(docs.sparkSession, model, F.col("text")))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_of("doc_id", 4) == 2
    found = identify(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "found.lang_pred", "found.score")

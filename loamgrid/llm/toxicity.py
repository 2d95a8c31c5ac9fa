"""Toxic passages by maximum-scoring segments of token log-odds.

A token's score is its log-odds between toxic and clean text with a Dirichlet
prior taken from the whole corpus. In each text a linear-time scan finds every
maximal segment of positive total; extreme-value statistics of such segments
in clean text say how unlikely each is, and the significant ones together give
the document's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.common import fold_of, table

#: Expected numbers of toxic and of clean rows in the training sample (its bound).
SAMPLE = {1: 4000, 0: 8000}
#: A word's features are itself and its first letters, in these numbers.
PREFIXES = (4, 5, 6)
#: Tokens that the prior weighs as much as.
PRIOR_TOKENS = 2000.0
#: A feature counts if so many toxic rows have it, with so large a z-value, log-odds and likelihood ratio of rows.
LEAST_ROWS, LEAST_Z, LEAST_ODDS, LEAST_RATIO = 4, 2.0, 1.0, 20.0
#: What each token without such a feature takes off a segment.
DRIFT = 0.4
#: Segments up to this p-value are significant.
SIGNIFICANT = 0.05
PIECE = 1 << 20
WORD = re.compile(r"[^\W\d_]+")


def word_lists(text: str | None) -> Iterator[list[str]]:
    """Lower-case words of the whole text, a bounded piece at a time."""
    start, end = 0, 0
    while text and start < len(text):
        end = min(start + PIECE, len(text))
        while end < len(text) and text[end - 1].isalpha() and text[end].isalpha():
            end += 1
        yield WORD.findall(text[start:end].lower())
        start = end


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def sample_counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, n, rows) of the sample; feature null: all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rows = Counter(), Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Counter()
                for x in word_lists(text):
                    words.update(x)
                own = Counter()
                for w, k in words.items():
                    for f in features(w):
                        own[f] += k
                own[None] = sum(words.values())
                for f, k in own.items():
                    n[f, toxic] += k
                    rows[f, toxic] += 1
            yield pa.RecordBatch.from_pydict({
                "feature": pa.array([f for f, _ in n], pa.string()), "toxic": pa.array([t for _, t in n], pa.int32()),
                "n": pa.array(list(n.values()), pa.int64()), "rows": pa.array([rows[x] for x in n], pa.int64()),
            })

    long = sample.select("text", "toxic").mapInArrow(run, "feature string, toxic int, n long, rows long")
    return long.groupBy("feature", "toxic").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))


def background(docs: DataFrame, wanted: frozenset) -> tuple[dict[str, int], int]:
    """Occurrences of the wanted features, and of all tokens, in all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, words, n, total = shared.value, Counter(), Counter(), 0

        def add() -> None:
            for w, k in words.items():
                for f in features(w):
                    if f in wanted:
                        n[f] += k
            words.clear()

        for batch in batches:
            for text in batch.column(0):
                for some in word_lists(text.as_py()):
                    total += len(some)
                    words.update(some)
                if len(words) > 200_000:
                    add()
        add()
        n[None] = total
        yield pa.RecordBatch.from_pydict({"feature": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})

    rows = docs.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    found = {r["feature"]: r["n"] for r in rows}
    return found, found.pop(None, 0)


def row_ratio(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """Log-likelihood ratio (G) of a feature's rows against the same rate in both classes."""
    rate = (toxic + clean) / (all_toxic + all_clean)
    parts = ((toxic, all_toxic * rate), (clean, all_clean * rate), (all_toxic - toxic, all_toxic * (1 - rate)), (all_clean - clean, all_clean * (1 - rate)))
    return 2 * sum(seen * math.log(seen / want) for seen, want in parts if seen > 0)


def log_odds(counts: dict, prior: dict[str, int], all_tokens: int, totals: tuple[int, int, int, int]) -> dict[str, float]:
    """Feature: log-odds, of the features that count.

    ``counts``: feature to tokens in toxic and in clean rows, then such rows;
    ``totals``: the same of all tokens.
    """
    found = {}
    for f, (toxic, clean, toxic_rows, clean_rows) in counts.items():
        if row_ratio(toxic_rows, clean_rows, totals[2], totals[3]) < LEAST_RATIO:
            continue
        a = PRIOR_TOKENS * (prior.get(f, 0) + 0.5) / (all_tokens + 1)
        rest = PRIOR_TOKENS - a
        odds = math.log((toxic + a) / max(totals[0] - toxic + rest, 1)) - math.log((clean + a) / max(totals[1] - clean + rest, 1))
        if odds >= LEAST_ODDS and odds / math.sqrt(1 / (toxic + a) + 1 / (clean + a)) >= LEAST_Z:
            found[f] = odds
    return found


class WordScores(dict):
    """The largest log-odds of a word's features, 0 if none counts."""

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self._odds = odds

    def __missing__(self, word: str) -> float:
        if len(self) >= 400_000:
            self.clear()
        found = self[word] = max((self._odds.get(f, 0.0) for f in features(word)), default=0.0)
        return found


def scored(text: str | None, scores: WordScores) -> tuple[list[tuple[int, float]], int]:
    """Position and score of the tokens that score above 0, and the number of tokens."""
    hits, at = [], 0
    for words in word_lists(text):
        hits += [(i, s) for i, s in enumerate(map(scores.__getitem__, words), at) if s > 0]
        at += len(words)
    return hits, at


def segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of the tokens' scores.

    ``hits``: position and score of the tokens that score above 0, in order;
    each other token scores ``-drift``. Linear in the number of hits: each
    candidate knows the nearest earlier one that begins at a smaller total, and
    where there is none, all earlier ones are final.
    """
    found: list[tuple[int, int, float]] = []
    stack: list[tuple[float, float, int, int, int]] = []  # total before, total after, first, last, nearest smaller
    total, end = 0.0, -1
    for at, score in hits:
        total -= drift * (at - end - 1)
        left, first, end = total, at, at
        total += score
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= total:
                break
            left, first, before = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = before
        if j < 0:
            found += [(a, b, y - x) for x, y, a, b, _ in stack]
            stack.clear()
        stack.append((left, total, first, at, j))
    return found + [(a, b, y - x) for x, y, a, b, _ in stack]


def extreme_rate(scores: list[float], weights: list[float]) -> float:
    """The positive root of E[exp(rate * score)] = 1 for scores with a negative mean."""
    low, high = 0.0, 1.0
    s, w = np.array(scores), np.array(weights) / sum(weights)
    if (s * w).sum() >= 0 or s.max() <= 0:
        return 0.05
    while (w * np.exp(high * s)).sum() < 1:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (w * np.exp(mid * s)).sum() < 1 else (low, mid)
    return max(high, 0.05)


class ToxicityModel:
    """Word log-odds, the segments' extreme-value rate and scale, and the calibration of evidence."""

    def __init__(self, odds: dict[str, float], rate: float = 1.0, scale: float = 1.0, slope: float = 0.0, base: float = -4.0):
        self.odds, self.rate, self.scale, self.slope, self.base = odds, rate, scale, slope, base

    def passages(self, text: str | None, scores: WordScores) -> list[tuple[int, int, float, float]]:
        """Significant passages: first word, last word, score, p-value."""
        hits, at = scored(text, scores)
        found = []
        for first, last, score in segments(hits) if hits else ():
            p = -math.expm1(-self.scale * at * math.exp(-self.rate * score))
            if p <= SIGNIFICANT:
                found.append((first, last, score, max(p, 1e-300)))
        return found

    def evidence(self, found: list) -> float:
        return math.log1p(sum(-math.log10(p) for *_, p in found))

    def score(self, found: list) -> float:
        return 1 / (1 + math.exp(-(self.base + self.slope * self.evidence(found))))


def logistic_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted, slightly ridged logistic regression."""
    design, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - np.array([1e-3, 1e-3]) * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from all rows of ``labels(doc_id, toxic)``; the prior comes from all texts of ``docs``."""
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    there = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(there) < 2:
        return ToxicityModel({})
    share = F.when(F.col("toxic") == 1, SAMPLE[1] / there[1]).otherwise(SAMPLE[0] / there[0])
    draw = F.pmod(F.xxhash64(F.lit("toxicity sample"), "doc_id"), F.lit(1 << 30))
    picked = marked.where(draw < share * float(1 << 30))
    there_too = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    # copies don't count as independent evidence
    sample = there_too.groupBy(F.xxhash64("text"), "toxic").agg(F.min_by("text", "doc_id").alias("text"))
    counted = sample_counts(sample).groupBy("feature").pivot("toxic", [0, 1]).agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).na.fill(0)
    rows = counted.where((F.col("1_rows") >= LEAST_ROWS) | F.col("feature").isNull()).select("feature", "1_n", "0_n", "1_rows", "0_rows").collect()
    counts = {r[0]: tuple(r[1:]) for r in rows}
    totals = counts.pop(None, (0, 0, 0, 0))
    if not totals[2] or not totals[3]:
        return ToxicityModel({})
    prior, all_tokens = background(docs, frozenset(counts))
    model = ToxicityModel(log_odds(counts, prior, all_tokens, totals))
    calibrate(model, sample, there)
    return model


def calibrate(model: ToxicityModel, sample: DataFrame, there: dict[int, int]) -> None:
    """Fit the extreme-value rate and scale on clean texts, then evidence to probability on all of the sample.

    The driver gets the counts of distinct token scores, which are at most as
    many as features, and a few numbers of each of the sample's rows.
    """
    shared = sample.sparkSession.sparkContext.broadcast(model.odds)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, tokens = WordScores(shared.value), Counter()
        for batch in batches:
            rows: list[tuple] = []
            for text, toxic in zip(*batch.columns, strict=True):
                hits, at = scored(text.as_py(), scores)
                tokens.update((toxic.as_py(), s) for _, s in hits)
                rows.append((toxic.as_py(), max((x[2] for x in segments(hits)), default=0.0), at))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.float64(), pa.int64()))] + [pa.nulls(len(rows), pa.int64())], ["toxic", "score", "length", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in tokens], pa.int32()), pa.array([k[1] for k in tokens], pa.float64()), pa.nulls(len(tokens), pa.int64()), pa.array(list(tokens.values()), pa.int64())], ["toxic", "score", "length", "n"])

    found = sample.select("text", "toxic").mapInArrow(measure, "toxic int, score double, length long, n long")
    found = found.groupBy("toxic", "score", "length").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()
    hits = sorted((r["score"], r["n"], r["toxic"]) for r in found if r["length"] is None)
    rows = sorted((r["score"], r["length"], r["rows"]) for r in found if r["length"] is not None and r["toxic"] == 0)
    tokens = sum(n * k for _, n, k in rows) + 1
    seen = np.cumsum([n for _, n, _ in hits])
    typical = hits[int(np.searchsorted(seen, seen[-1] // 2, "right"))][0] if hits else 1.0
    clean = Counter({typical: 1})  # one more hit than seen
    for s, n, toxic in hits:
        if not toxic:
            clean[s] += n
    model.rate = extreme_rate([*clean, -DRIFT], [*map(float, clean.values()), tokens])
    some = [(s, k) for s, _, k in rows if s > 0]
    least = min([typical, *(s for s, _ in some)])
    model.scale = float((sum(k for _, k in some) + 0.5) / max(sum(max(n, 1) * k for _, n, k in rows) * math.exp(-model.rate * least), 1e-12))
    fitted = sample.sparkSession.sparkContext.broadcast((model.odds, model.rate, model.scale))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(*fitted.value)
        scores = WordScores(own.odds)
        for batch in batches:
            x = [own.evidence(own.passages(t.as_py(), scores)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], ["x", "toxic"])

    points = sample.select("text", "toxic").mapInArrow(weigh, "x double, toxic int").groupBy("x", "toxic").count().orderBy("x", "toxic").collect()
    weight = [r["count"] * max(1.0, there[r["toxic"]] / SAMPLE[r["toxic"]]) for r in points]
    model.slope, model.base = logistic_fit(np.array([r["x"] for r in points]), np.array([r["toxic"] for r in points], float), np.array(weight))


def toxicity_of(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    """struct(score, passages) of a text column; passages are (first_word, last_word, score, p)."""
    shared = spark.sparkContext.broadcast((model.odds, model.rate, model.scale, model.slope, model.base))
    kept: dict = {}

    def run(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.update(scores=WordScores(shared.value[0]), model=ToxicityModel(*shared.value))
        found = [kept["model"].passages(t.as_py(), kept["scores"]) for t in texts]
        spans = pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("p", pa.float64())])
        keys = ("first_word", "last_word", "score", "p")
        passages = pa.array([[dict(zip(keys, x, strict=True)) for x in f] for f in found], pa.list_(spans))
        return pa.StructArray.from_arrays([pa.array([kept["model"].score(f) for f in found], pa.float64()), passages], ["score", "passages"])

    return F.arrow_udf(run, "score double, passages array<struct<first_word: long, last_word: long, score: double, p: double>>")(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, out: str = "found") -> DataFrame:
    """Toxicity of every row's whole text, learned from all rows of ``labels``.

    Adds ``out`` = struct(score, passages) to all columns of ``docs``, in
    place of a column of that name. A null or empty text has no passage and the score of such. A document labelled
    more than once is toxic if any label says so; labels other than 0 and 1
    are ignored. Without both kinds of label every score is small and equal.
    """
    model = train(docs, labels)
    return docs.withColumn(out, toxicity_of(docs.sparkSession, model, F.col("text")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of("doc_id", 5) == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    found = score_toxicity(docs, labels)
    return found.select("doc_id", held_out.alias("held_out"), "found.score", (F.col("found.score") >= 0.5).cast("int").alias("predicted"), F.size("found.passages").cast("long").alias("n_passages"))

"""Quality rules with thresholds learned per language and source.

Every document gets exact base counts. Ratios of the counts are summarised in
mergeable quantile sketches, one per language, source and metric: a sketch is
the number of values in each of a row of buckets whose bounds grow by a fixed
factor, so sketches merge by adding counts, in any order and with the same
result. The median of a group's sketch and the median distance from it give its
fences, which are never wider than its language's, and a document is kept if
all its ratios lie within the fences of its own group. Where most documents have
a ratio of 0, that distance is 0 too; then the least count that a document can
have, over the median length of the group's documents, stands for it, or the
median of the ratios over 0 if these are less. So fences follow from the sketches
alone: no ratio has a cutoff of its own.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.llm.common import batch_map, table
from loamgrid.session import durable

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"

#: Relative error of a quantile read from a sketch.
ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Fences stand WIDTH times the median distance from the median apart from it, 8.2 standard deviations of a normal
#: distribution. Junk moves neither median much while it is well under half of a group.
WIDTH = 12.2
#: Documents that a source's language, and all documents for a language, weigh as much as in its median and spread.
PRIOR_DOCS = 200
#: Metric: (numerator, denominator, least numerator over 0 in general, whether low values fail too). A window of three
#: words that comes again covers six of them; a mean has no least step.
METRICS = {
    "mean_word": ("word_chars", "n_words", 0, True),
    "symbols": ("n_symbols", "n_words", 1, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1, False),
    "repeats": ("n_repeat_words", "n_words", 6, False),
}
#: Lengths that have sketches beside the metrics.
LENGTHS = ("n_words", "n_lines")


def repeat_words(words: list) -> int:
    """Words that lie in a window of three found twice or more in ``words``."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pairs = ids[:-2] * len(seen) + ids[1:-1]
    if len(seen) >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    keys = pairs * len(seen) + ids[2:]
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    again = np.isin(keys, np.unique(twice))
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines with a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
    )


def base_stats(docs: DataFrame) -> DataFrame:
    """The exact base counts of every document's whole text."""

    def run(rows: dict) -> dict:
        cols = list(zip(*map(text_stats, rows["text"]), strict=True))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
        import pyarrow as pa

        out = {"doc_id": pa.array(rows["doc_id"], pa.int64()), "lang": pa.array(rows["lang"], pa.string()), "source": pa.array(rows["source"], pa.string())}
        return out | {k: pa.array(v, pa.int64()) for k, v in zip(names, cols, strict=True)}

    return batch_map(docs.select("doc_id", "lang", "source", "text"), run, STATS)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): the sketch of each group and metric. Bucket null: the value 0."""
    ratios = [F.struct(F.lit(m).alias("metric"), (F.col(a) / F.col(b)).alias("x")) for m, (a, b, _, _) in METRICS.items()]
    metrics = F.array(*ratios, *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in LENGTHS])
    bucket = F.when(F.col("m.x") > 0, F.ceil(F.ln("m.x") / math.log(GAMMA)).cast("int"))
    long = stats.where(~base_failed()).select("lang", "source", F.explode(metrics).alias("m"))
    return long.select("lang", "source", "m.metric", bucket.alias("bucket")).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """(keys, metric, n, quantiles) of sketches merged over all columns that aren't keys.

    A key has at most a few thousand buckets, whatever the number of documents.
    """
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    to_here = Window.partitionBy(*keys, "metric").orderBy(F.col("bucket").asc_nulls_first())
    whole = Window.partitionBy(*keys, "metric")
    ranked = merged.withColumns({"upto": F.sum("n").over(to_here), "total": F.sum("n").over(whole)})
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")) * 2 / (1 + GAMMA))
    at = [F.min(F.when(F.col("upto") >= p * F.col("total"), value)).alias(name) for name, p in probs.items()]
    return ranked.groupBy(*keys, "metric").agg(F.first("total").alias("n"), *at)


def spreads(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, n, mid, spread) of sketches merged like those of :func:`quantiles`.

    ``mid`` is the median, ``spread`` the median distance from it, but no less
    than a value is known to, nor than the metric's unit: the median of its
    values over 0, or its least count over the median length if that is less.
    """
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    whole, group = Window.partitionBy(*keys, "metric"), Window.partitionBy(*keys)
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")) * 2 / (1 + GAMMA))
    sums = {"upto": F.sum("n").over(whole.orderBy("value")), "total": F.sum("n").over(whole), "zeros": F.sum(F.when(F.col("value") == 0, F.col("n")).otherwise(0)).over(whole)}
    ranked = merged.withColumn("value", value).withColumns(sums)
    half = ranked.withColumn("mid", F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col("value"))).over(whole))
    apart = half.withColumn("apart", F.abs(F.col("value") - F.col("mid"))).withColumn("within", F.sum("n").over(whole.orderBy("apart")))
    mad = F.min(F.when(2 * F.col("within") >= F.col("total"), F.col("apart")))
    some = F.min(F.when((F.col("value") > 0) & (2 * (F.col("upto") - F.col("zeros")) >= F.col("total") - F.col("zeros")), F.col("value")))
    found = apart.groupBy(*keys, "metric").agg(F.first("total").alias("n"), F.first("mid").alias("mid"), mad.alias("mad"), some.alias("some"))
    # The medians of the lengths, beside each metric of their group.
    lengths = {m: F.max(F.when(F.col("metric") == m, F.col("mid"))).over(group) for m in LENGTHS}
    step = F.coalesce(*[F.when(F.col("metric") == m, F.lit(float(k)) / lengths[b]) for m, (_, b, k, _) in METRICS.items()])
    with_step = found.withColumn("step", step).where(F.col("metric").isin(*METRICS))
    spread = F.greatest("mad", F.least("step", "some"), 2 * ALPHA * F.col("mid"))
    return with_step.select(*keys, "metric", "n", "mid", spread.alias("spread"))


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, and lo_/hi_ of each metric).

    A language's median and spread are drawn towards those of all documents, and
    a source's towards its language's, the more the fewer documents there are,
    in the same way at every size. A source's fences are bounded by those of its
    language.
    """
    own = spreads(sketch, ["lang", "source"]).alias("own")
    lang = spreads(sketch, ["lang"]).alias("lang")
    every = spreads(sketch, []).alias("every")
    joined = own.join(lang, F.col("own.lang").eqNullSafe(F.col("lang.lang")) & (F.col("own.metric") == F.col("lang.metric"))).join(every, F.col("own.metric") == F.col("every.metric"))

    def drawn(name: str, near: str, far: Column) -> Column:
        return (F.col(f"{near}.n") * F.col(f"{near}.{name}") + PRIOR_DOCS * far) / (F.col(f"{near}.n") + PRIOR_DOCS)

    wide = {name: drawn(name, "lang", F.col(f"every.{name}")) for name in ("mid", "spread")}
    tight = {name: drawn(name, "own", wide[name]) for name in ("mid", "spread")}
    hi = F.least(*(x["mid"] + WIDTH * x["spread"] for x in (wide, tight)))
    lo = F.greatest(*(x["mid"] - WIDTH * x["spread"] for x in (wide, tight)))
    flat = joined.select("own.lang", "own.source", "own.metric", lo.alias("lo"), hi.alias("hi"))
    bounds = []
    for m, (_, _, _, both) in METRICS.items():
        here = F.col("metric") == m
        bounds.append(F.max(F.when(here, F.col("hi"))).alias(f"hi_{m}"))
        if both:
            bounds.append(F.max(F.when(here, F.col("lo"))).alias(f"lo_{m}"))
    return flat.groupBy("lang", "source").agg(*bounds)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Base counts, learned fences' verdicts and ``kept`` of every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept and failed_rules (the metrics outside
    their fences). A null or empty text has zero counts and fails the base
    rules. Null languages and sources are groups of their own. Repeated rows
    are returned as often as they come; an empty table gives an empty result;
    further columns are ignored.
    """
    stats = durable(base_stats(docs))
    limits = fences(sketches(stats)).withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    joined = stats.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    rules = []
    for m, (a, b, _, both) in METRICS.items():
        x = F.col(a) / F.when(F.col(b) > 0, F.col(b))
        out = x > F.col(f"hi_{m}")
        rules.append(F.when(out | (x < F.col(f"lo_{m}")) if both else out, F.lit(m)))
    joined = joined.withColumns({"base_failed": base_failed(), "failed_rules": F.array_compact(F.array(*rules))})
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "failed_rules")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))

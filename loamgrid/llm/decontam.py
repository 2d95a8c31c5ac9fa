"""Benchmark decontamination by winnowed fingerprints.

For each span of SPAN words the least hash of its word k-grams is kept, in the
corpus and in the benchmark alike, so any two texts that share SPAN words in a
row share a fingerprint. In the documents that share one, the places of such
k-grams and of the benchmark's give the shift at which document and item lie
upon each other; from there the hits are extended word by word, and runs of
SPAN equal words or more are the words hit. Only DataFrame functions are used.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.common import table
from loamgrid.llm.linking import sized
from loamgrid.session import durable

#: Words in a span; words in a k-gram. A shared span of SPAN words shares SPAN - GRAM + 1 k-grams in a row.
SPAN, GRAM = 13, 6

_OTHER = "".join(chr(c) for c in range(128) if chr(c) not in string.ascii_letters + string.digits + " ")


def words_of(text: Column) -> Column:
    """Words of ASCII letters, digits and all non-ASCII characters, A-Z in lower case; none if null."""
    flat = F.translate(text, string.ascii_uppercase + _OTHER, string.ascii_lowercase + " " * len(_OTHER))
    return F.coalesce(F.array_remove(F.split(flat, " "), ""), F.array().cast("array<string>"))


def bound(value: Column, make) -> Column:
    """``make`` of a lambda's variable that is bound to ``value``, so that the value is computed once."""
    return F.transform(F.array(value), make)[0]


def none_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def grams(hashes: Column, size: int) -> Column:
    """A hash of each run of ``size`` words; empty if there are fewer."""
    n = F.size(hashes)
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(F.lit(size), *[hashes[i + k] for k in range(size)]))).otherwise(none_of("bigint"))


def grams_of(size: int) -> Callable[[Column], Column]:
    return lambda hashes: grams(hashes, size)


def minima(values: Column, width: int) -> Column:
    """The least of each ``width`` values in a row, by doubling; empty if there are fewer."""

    def step(x: Column, had: int) -> Column:
        if had == width:
            return x
        by = min(had, width - had)
        return bound(F.transform(F.sequence(F.lit(0), F.size(x) - 1 - by), lambda i: F.least(x[i], x[i + by])), lambda y: step(y, had + by))

    return F.when(F.size(values) >= width, step(values, 1))


def fingerprints(words: Column, short: list[int]) -> Column:
    """The winnowed hashes of ``words``, and the hashes of all runs of each length in ``short``."""

    def found(h: Column) -> Column:
        least = bound(grams(h, GRAM), lambda g: minima(g, SPAN - GRAM + 1))
        return F.concat(F.coalesce(F.array_distinct(least), none_of("bigint")), *[grams(h, n) for n in short])

    return bound(hashes_of(words), found)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words, n) of the items with words; a window of an item is n words, SPAN or all if it has fewer."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).dropDuplicates()
    return items.where(F.size("words") > 0).select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words", F.least(F.size("words"), F.lit(SPAN)).alias("n"))


def benchmark_seeds(items: DataFrame, short: list[int]) -> DataFrame:
    """(item, at, size, fingerprint): the places of the fingerprints in each item and the item's number of words."""
    size = F.size("words").alias("size")
    longer = items.where(F.col("n") == SPAN).select("item", size, hashes_of(F.col("words")).alias("h"))
    placed = longer.select("item", "size", F.posexplode(grams(F.col("h"), GRAM)).alias("at", "fingerprint"))
    least = longer.select("item", F.explode(F.array_distinct(bound(grams(F.col("h"), GRAM), lambda g: minima(g, SPAN - GRAM + 1)))).alias("fingerprint"))
    seeds = placed.join(least, ["item", "fingerprint"]).select("item", "at", "size", "fingerprint")
    for n in short:
        whole = items.where(F.col("n") == n).select("item", F.lit(0).alias("at"), size, bound(hashes_of(F.col("words")), grams_of(n))[0].alias("fingerprint"))
        seeds = seeds.unionByName(whole)
    return seeds


def equal_spans(words: Column, theirs: Column, lengths: list[int], n: Column) -> Column:
    """Where runs of ``n`` equal words, n being one of ``lengths``, begin in two lists of words that lie upon each other."""
    same = F.zip_with(words, theirs, lambda a, b: (a == b).cast("int"))
    starts = lambda k: lambda x: F.filter(F.transform(minima(x, k), lambda v, i: F.when(v == 1, i)), lambda i: i.isNotNull())
    return F.coalesce(*[F.when(n == k, bound(same, starts(k))) for k in lengths], none_of("int"))


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark spans in each document.

    Returns a row for each row of ``docs``: doc_id, text_hash, n_words, n_hit
    (words inside any occurrence of a benchmark span), item_ids (of the items
    with a span in the document, sorted as strings) and contaminated (at least
    one word in 20 is hit). Rows that repeat a doc_id are each judged by their
    own text. Null and empty texts have no words; items without words are never
    found; null item_ids are left out.
    """
    items = durable(benchmark_items(benchmark))
    short = sorted(r["n"] for r in items.where(F.col("n") < SPAN).select("n").distinct().collect())
    seeds = durable(benchmark_seeds(items, short))
    key = ["doc_id", "text_hash"]
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    wanted = seeds.select("fingerprint").distinct().withColumn("known", F.lit(True))
    read = texts.select(F.monotonically_increasing_id().alias("no"), *key, words_of(F.col("text")).alias("words"))
    prints = read.select("no", *key, F.size("words").cast("long").alias("n_words"), F.explode_outer(fingerprints(F.col("words"), short)).alias("fingerprint"))
    joined = prints.join(sized(wanted), "fingerprint", "left")
    every = durable(joined.groupBy("no", *key).agg(F.max("n_words").alias("n_words"), F.max("known").alias("known")))

    marked = durable(every.where("known").select(*key).distinct())
    words = durable(matching(texts, marked).select(*key, words_of(F.col("text")).alias("words")))
    at_words = words.select(*key, bound(hashes_of(F.col("words")), lambda h: F.array(*[F.struct(grams(h, k).alias("grams")) for k in [GRAM, *(n for n in short if n != GRAM)]])).alias("by_size"))
    places = at_words.select(*key, F.explode("by_size").alias("of")).select(*key, F.posexplode("of.grams").alias("place", "fingerprint"))
    shifts = places.join(sized(seeds), "fingerprint").select(*key, "item", "size", (F.col("place") - F.col("at")).alias("shift")).distinct()
    laid = durable(shifts.groupBy(*key).agg(F.collect_list(F.struct("item", "size", "shift")).alias("laid")))
    found = with_found(words, laid).select(*key, "words", F.explode("laid").alias("l"))
    over = found.select(
        *key, F.col("l.item").alias("item"), F.greatest(F.col("l.shift"), F.lit(0)).alias("place"), F.greatest(-F.col("l.shift"), F.lit(0)).alias("skip"),
        F.slice("words", F.greatest(F.col("l.shift"), F.lit(0)) + 1, F.col("l.size")).alias("part"),
    )
    both = over.join(sized(items), "item")
    theirs = F.slice("words", F.col("skip") + 1, F.size("part"))
    mine = F.slice("part", 1, F.greatest(F.size("words") - F.col("skip"), F.lit(0)))
    spans = both.select(*key, "item_id", "n", "place", F.explode(equal_spans(mine, theirs, [SPAN, *short], F.col("n"))).alias("start"))
    at = F.col("place") + F.col("start")
    hits = spans.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct(at.alias("at"), (at + F.col("n")).alias("end")))).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    start = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))
    merge = lambda a, x: F.struct((a["covered"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["at"], a["end"]))).alias("covered"), F.greatest(a["end"], x["end"]).alias("end"))
    counted = hits.select(*key, F.aggregate("spans", start, merge, lambda a: a["covered"]).cast("long").alias("n_hit"), "item_ids")
    whole = with_found(every, counted, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return whole.select(*key, "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", none_of("string")).alias("item_ids"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def with_found(rows: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``found`` by doc_id and text_hash, nulls matching nulls."""
    side = sized(durable(found.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})))
    return rows.join(side, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), how).drop("d", "h")


def matching(texts: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of ``texts`` with a key in ``marked``, nulls matching nulls."""
    return with_found(texts, marked, "left_semi")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), spans AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS span
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS span
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM spans) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, p, n, item_id FROM places JOIN spans USING (n, span)
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS pos FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked until their
sums over each of the three agree with target shares, and documents are
sampled with the probabilities that turn the cells' tokens into these weights.
Only DataFrame functions are used.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.common import id_text, table
from loamgrid.llm.linking import sized
from loamgrid.session import durable

DIMENSIONS = ("source", "lang", "topic")
#: Default targets: each value's share of tokens to this power, normed to 1; under 1 it lifts rare values.
TEMPER = 0.7
#: Fitting to each of the three in turn ends when no share is corrected by more than TOLERANCE of it. If STALL rounds bring
#: nothing, or after SWEEPS, it ends with a warning: the targets contradict each other, or all but do.
SWEEPS, TOLERANCE, STALL = 200, 1e-9, 10
#: Combinations of languages and topics that the driver combines; more stay in tables.
MOST_CELLS = 10_000
WORD, DIGIT, SYMBOL = "[^\\x20\\x09-\\x0D]+", "[0-9]", "[#*$%&|<>{}=]"


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column, n_tokens: Column) -> Column:
    """A coarse topic from a text's form, for tables that have no column of topics."""
    return (
        F.when(n_tokens == 0, "none")
        .when(F.regexp_count(text, F.lit(SYMBOL)) * 20 >= n_tokens, "markup")
        .when(F.regexp_count(text, F.lit(DIGIT)) * 10 >= n_tokens, "figures")
        .when(n_tokens < 100, "notes")
        .otherwise("prose")
    )


def with_cell(docs: DataFrame, topic: Column | None = None, name: str = "mix") -> DataFrame:
    """``docs`` and struct ``name`` of source, lang, topic and n_tokens; a null value is '', others begin with '='."""
    n = tokens_of(F.col("text"))
    named = lambda x: F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit(""))
    chosen = topic_of(F.col("text"), n) if topic is None else topic
    return docs.withColumn(name, F.struct(named(F.col("source")).alias("source"), named(F.col("lang")).alias("lang"), named(chosen).alias("topic"), n.alias("n_tokens")))


def tempered(totals: dict[str, float]) -> dict[str, float]:
    """Each value's share of tokens to the power TEMPER, normed to 1."""
    powers = {k: v**TEMPER for k, v in totals.items() if v > 0}
    return {k: v / sum(powers.values()) for k, v in powers.items()}


def source_rows(cells: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(source, share, cells): a source's target and its cells (lang, topic, tokens), at most languages times topics."""
    rows = cells.where("tokens > 0").groupBy("source").agg(F.collect_list(F.struct("lang", "topic", F.col("tokens").cast("double").alias("tokens"))).alias("cells"), F.sum("tokens").cast("double").alias("t"))
    if targets is not None:
        return durable(rows.join(targets.withColumnsRenamed({"value": "source"}), "source", "left").select("source", F.coalesce("share", F.lit(0.0)).alias("share"), "cells"))
    rows = durable(rows.withColumn("p", F.pow("t", F.lit(TEMPER))))
    total = rows.agg(F.sum("p")).first()[0] or 1.0
    return rows.select("source", (F.col("p") / total).alias("share"), "cells")


def looked_up(factors: dict[str, float], key: Column) -> Column:
    if not factors:
        return F.lit(0.0)
    return F.coalesce(F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])[key], F.lit(0.0))


def rake(rows: DataFrame, langs: dict[str, float], topics: dict[str, float], sweeps: int = SWEEPS) -> tuple[DataFrame, dict[str, float], dict[str, float]]:
    """Factors of sources (a table source, factor), languages and topics; a cell's weight is its tokens times its three.

    ``rows``: see :func:`source_rows`; ``langs`` and ``topics``: target shares.
    Given the factors of languages and topics, those of sources follow within
    each row. So a sweep is one aggregation over the sources whose result, one
    sum per language and topic, is small; the rest is arithmetic on it.
    A value whose target is missing or 0 gets the factor 0.
    """
    langs, topics = normed(langs), normed(topics)
    of_lang, of_topic = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0)

    def with_factor() -> DataFrame:
        term = lambda acc, c: acc + c["tokens"] * looked_up(of_lang, c["lang"]) * looked_up(of_topic, c["topic"])
        total = F.aggregate("cells", F.lit(0.0), term)
        return rows.withColumn("factor", F.when(total > 0, F.col("share") / total).otherwise(0.0))

    history: list[float] = []
    for _ in range(sweeps):
        fitted = with_factor()
        sums = fitted.select("factor", F.explode("cells").alias("c")).groupBy("c.lang", "c.topic").agg(F.sum(F.col("c.tokens") * F.col("factor")).alias("s"))
        table_ = {(r["lang"], r["topic"]): r["s"] for r in sums.collect()}
        was = {k: v * sum(s * of_topic.get(t, 0.0) for (x, t), s in table_.items() if x == k) for k, v in of_lang.items()}
        off = [abs(was[k] / langs[k] - 1) for k in langs if langs[k] > 0 and was[k] > 0]
        of_lang = {k: v * langs[k] / was[k] if was[k] > 0 else 0.0 for k, v in of_lang.items()}
        was = {k: v * sum(s * of_lang.get(x, 0.0) for (x, t), s in table_.items() if t == k) for k, v in of_topic.items()}
        off += [abs(was[k] / topics[k] - 1) for k in topics if topics[k] > 0 and was[k] > 0]
        of_topic = {k: v * topics[k] / was[k] if was[k] > 0 else 0.0 for k, v in of_topic.items()}
        history.append(max(off, default=0.0))
        if settled(history):
            break
    unsettled(history)
    return fitted, of_lang, of_topic


def normed(shares: dict[str, float]) -> dict[str, float]:
    """Shares that add to 1; targets of the three dimensions must agree in their sum to be met at once."""
    total = sum(shares.values())
    return {k: v / total for k, v in shares.items()} if total > 0 else shares


def settled(history: list[float]) -> bool:
    """Whether the last round corrected next to nothing, or rounds bring no progress."""
    return history[-1] <= TOLERANCE or len(history) > STALL and history[-1] > 0.99 * history[-1 - STALL]


def unsettled(history: list[float]) -> None:
    if history and history[-1] > TOLERANCE:
        warnings.warn(f"the last of {len(history)} rounds corrected a share by {history[-1]:.2g} of it: the targets contradict each other, or need more rounds", stacklevel=3)


def rake_cells(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """(source, lang, topic, ratio): weight over tokens of each cell, for any number of values in each dimension.

    ``cells`` are (source, lang, topic, tokens), ``targets`` (value, share) of
    each dimension, shares that add to 1. A round is a sum and a join for each
    dimension, over the table of cells, and is written to the shared folder.
    """
    now = durable(cells.where("tokens > 0").select(*DIMENSIONS, F.col("tokens").cast("double").alias("tokens"), F.col("tokens").cast("double").alias("w")))
    history: list[float] = []
    for _ in range(sweeps):
        off = []
        for d in DIMENSIONS:
            sums = now.groupBy(d).agg(F.sum("w").alias("_was")).join(targets[d].withColumnRenamed("value", d), d, "left").select(d, "_was", F.coalesce("share", F.lit(0.0)).alias("_share"))
            sums = durable(sums)
            off.append(sums.where("_was > 0 and _share > 0").agg(F.max(F.abs(F.col("_was") / F.col("_share") - 1))).first()[0] or 0.0)
            factor = F.when(F.col("_was") > 0, F.col("_share") / F.col("_was")).otherwise(0.0)
            now = now.join(sums, d).withColumn("w", F.col("w") * factor).drop("_was", "_share")
        now = durable(now)
        history.append(max(off))
        if settled(history):
            break
    unsettled(history)
    return now.select(*DIMENSIONS, (F.col("w") / F.col("tokens")).alias("ratio"))


def cell_targets(cells: DataFrame, given: dict[str, DataFrame | dict[str, float] | None]) -> dict[str, DataFrame]:
    """(value, share) of each dimension: what is given, or tempered shares of tokens; normed."""
    out = {}
    for d in DIMENSIONS:
        want = given[d]
        if want is None:
            raw = cells.where("tokens > 0").groupBy(F.col(d).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(TEMPER)).alias("share"))
        elif isinstance(want, dict):
            raw = cells.sparkSession.createDataFrame(list(want.items()), "value string, share double")
        else:
            raw = want.select("value", "share")
        raw = durable(raw)
        total = raw.agg(F.sum("share")).first()[0] or 1.0
        out[d] = raw.withColumn("share", F.col("share") / F.lit(float(total)))
    return out


def draw() -> Column:
    """A number from 0 to 1 that depends on doc_id only."""
    return F.conv(F.substring(F.md5(F.concat(id_text(), F.lit("|mix"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mix(docs: DataFrame, topic: Column | None = None, sources: DataFrame | None = None, langs: dict[str, float] | None = None, topics: dict[str, float] | None = None, prefix: str = "", sweeps: int = SWEEPS) -> DataFrame:
    """Sampling probabilities that bring the tokens of ``docs`` to the target shares.

    Adds ``mix`` (struct of source, lang, topic, n_tokens), ``p`` and
    ``sampled``, their names after ``prefix``, to all columns of ``docs``, in
    place of columns of these names. Targets are tempered shares unless
    given: ``sources`` as a table (value, share), the others as dicts, with
    values as in ``mix``. The cell that is scarcest by its target has p = 1
    and all others p in proportion, so the expected tokens agree with the
    fitted weights exactly. Texts without tokens (null, empty or blank) have
    p = 0. Null sources and languages are values of their own; repeated rows
    are drawn alike; an empty table gives an empty result.
    """
    cell = f"{prefix}mix"
    given = with_cell(docs, topic, cell)
    cells = durable(given.select(f"{cell}.*").groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    pairs = durable(cells.where("tokens > 0").groupBy("lang", "topic").agg(F.sum("tokens").cast("double").alias("t")))
    if pairs.count() > MOST_CELLS:
        ratios = durable(rake_cells(cells, cell_targets(cells, {"source": sources, "lang": langs, "topic": topics}), sweeps))
        top = ratios.agg(F.max("ratio")).first()[0] or 1.0
        near = sized(ratios.select(*(F.col(d).alias(f"_mix_{d}") for d in DIMENSIONS), (F.col("ratio") / F.lit(float(top))).alias("_mix_p")))
        met = [F.col(f"{cell}.{d}") == F.col(f"_mix_{d}") for d in DIMENSIONS]
        joined = given.join(near, met[0] & met[1] & met[2], "left")
        p = F.when(F.col(f"{cell}.n_tokens") > 0, F.coalesce("_mix_p", F.lit(0.0))).otherwise(0.0)
        return joined.withColumn(f"{prefix}p", p).withColumn(f"{prefix}sampled", draw() < F.col(f"{prefix}p")).drop("_mix_p", *(f"_mix_{d}" for d in DIMENSIONS))
    small = pairs.collect()
    totals: dict[str, dict] = {"lang": {}, "topic": {}}
    for r in small:
        for d, sums in totals.items():
            sums[r[d]] = sums.get(r[d], 0.0) + r["t"]
    fitted, of_lang, of_topic = rake(source_rows(cells, sources), langs or tempered(totals["lang"]), topics or tempered(totals["topic"]), sweeps)
    fitted = durable(fitted)
    ratio = lambda factor, lang, topic_: F.col(factor) * looked_up(of_lang, lang) * looked_up(of_topic, topic_)
    most = fitted.agg(F.max(F.array_max(F.transform("cells", lambda c: ratio("factor", c["lang"], c["topic"])))).alias("m"), F.count("*").alias("n")).first()
    factors = fitted.select(F.col("source").alias("_mix_source"), F.col("factor").alias("_mix_factor"))
    joined = given.join(sized(factors), F.col(f"{cell}.source") == F.col("_mix_source"), "left")
    p = F.when(F.col(f"{cell}.n_tokens") > 0, F.coalesce(ratio("_mix_factor", F.col(f"{cell}.lang"), F.col(f"{cell}.topic")) / F.lit(float(most["m"] or 1.0)), F.lit(0.0))).otherwise(0.0)
    return joined.withColumn(f"{prefix}p", p).withColumn(f"{prefix}sampled", draw() < F.col(f"{prefix}p")).drop("_mix_source", "_mix_factor")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return mixed.select("doc_id", "source", "lang", F.substring("mix.topic", 2, 100).alias("topic"), F.col("mix.n_tokens").alias("n_tokens"), F.round("p", 6).alias("p"), "sampled")


def mixing_sql(docs: str = "documents", sweeps: int = 40) -> str:
    """The same in SQL, one step of fitting after the other."""
    ctes = [
        rf"""mix_t AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM {docs})""",
        """mix_d AS (SELECT *, coalesce('=' || source, '') AS s, coalesce('=' || lang, '') AS l, '=' || CASE
  WHEN n_tokens = 0 THEN 'none'
  WHEN len(regexp_extract_all(text, '[#*$%&|<>{}=]')) * 20 >= n_tokens THEN 'markup'
  WHEN len(regexp_extract_all(text, '[0-9]')) * 10 >= n_tokens THEN 'figures'
  WHEN n_tokens < 100 THEN 'notes' ELSE 'prose' END AS t FROM mix_t)""",
        "mix_0 AS (SELECT s, l, t, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(sum(n_tokens) AS DOUBLE) AS w FROM mix_d GROUP BY s, l, t HAVING sum(n_tokens) > 0)",
    ]
    for d in "slt":
        ctes.append(f"mix_g{d} AS (SELECT {d}, pow(sum(tokens), {TEMPER}) / sum(pow(sum(tokens), {TEMPER})) OVER () AS share FROM mix_0 GROUP BY {d})")
    step = 0
    for _ in range(sweeps):
        for d in "slt":
            ctes.append(f"mix_{step + 1} AS MATERIALIZED (SELECT s, l, t, tokens, w * (share / sum(w) OVER (PARTITION BY c.{d})) AS w FROM mix_{step} c JOIN mix_g{d} USING ({d}))")
            step += 1
    ctes.append(f"mix_r AS (SELECT s, l, t, (w / tokens) / max(w / tokens) OVER () AS p FROM mix_{step})")
    ctes.append("mix_p AS (SELECT mix_d.*, CASE WHEN n_tokens > 0 THEN coalesce(p, 0) ELSE 0 END AS p FROM mix_d LEFT JOIN mix_r USING (s, l, t))")
    ctes.append("mix_s AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix'), 1, 8) AS BIGINT) / 4294967296.0 < p AS sampled FROM mix_p)")
    return ",\n".join(ctes)


OP9_SQL = f"WITH {mixing_sql()}\nSELECT doc_id, source, lang, substr(t, 2) AS topic, n_tokens, round(p, 6) AS p, sampled FROM mix_s"

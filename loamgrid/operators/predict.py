"""Predictions with abstention, status lines and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import vec
from loamgrid.operators.metrics import top_k


def predict(scored: DataFrame, names: list[str], temperature: float, threshold: float, reject: str | None = None, least: float = 0.5, k: int = 3) -> DataFrame:
    """Adds predicted_class, confidence, top_k, energy_score, abstain and abstain_reason to rows with ``logits``.

    Reasons in order: energy over ``threshold``, the reject class, a
    confidence under ``least``. Energy is of the logits as they are.
    """
    named = F.array(*map(F.lit, names))
    out = scored.withColumn("probs", vec.softmax(vec.scaled(F.col("logits"), temperature))).withColumn("energy_score", vec.energy(F.col("logits")))
    out = out.withColumn("top_k", top_k(F.col("probs"), k)).withColumn("predicted_class", F.get(named, F.col("top_k")[0]["cls"])).withColumn("confidence", F.col("top_k")[0]["prob"])
    reason = F.when(F.col("energy_score") > threshold, "energy").when(F.col("predicted_class") == F.lit(reject), "reject class").when(F.col("confidence") < least, "low confidence")
    return out.withColumn("abstain_reason", F.coalesce(reason, F.lit(""))).withColumn("abstain", reason.isNotNull())


def status(abstain: Column, name: Column) -> Column:
    return F.when(abstain, "UNCERTAIN").when(F.lower(name).like("%healthy%"), "HEALTHY").otherwise("PATHOLOGY")


def triage(days: Column, limit: int = 5) -> Column:
    """Treat what is at most ``limit`` days old, prune what is older; stated in documents only, no code decides so."""
    return F.when(days <= limit, "CMD_TREAT").otherwise("CMD_PRUNE")


#: Bounds of the mask rules, in order; the first that fails names the reason.
MASK_RULES = (("area_frac", "<", 0.08, "area too small"), ("area_frac", ">", 0.97, "area too large"), ("largest_cc_frac", "<", 0.80, "fragmented"), ("leak_frac", ">", 0.30, "leaks"))


def quality_reason(rules: tuple = MASK_RULES) -> Column:
    """The first rule that fails; '' if none does. A null value fails none."""
    out = None
    for column, sign, bound, reason in rules:
        fails = F.col(column) < bound if sign == "<" else F.col(column) > bound
        out = F.when(fails, reason) if out is None else out.when(fails, reason)
    return out.otherwise("")


def fallback(*results: Column) -> Column:
    """The first result whose ``ok`` holds; the first of all if none does."""
    out = F.when(results[0]["ok"], results[0])
    for r in results[1:]:
        out = out.when(r["ok"], r)
    return out.otherwise(results[0])


def passes(*checks: Column) -> Column:
    """Whether all checks hold; one that wasn't measured (null) fails."""
    out = F.lit(True)
    for c in checks:
        out = out & F.coalesce(c, F.lit(False))
    return out


def unmeasured(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c.isNull(), name) for name, c in checks.items()]))


def harvest_sources(items: DataFrame, quality: DataFrame | None, key: str, label: str, per_label: int = 40, most: float = 0.01) -> DataFrame:
    """The first ``per_label`` train rows of each label whose mask passed and left little behind; an unmeasured rest fails.

    Without a quality table no row is turned away for its mask.
    """
    from_ = items.where("split = 'train'")
    if quality is not None:
        good = quality.where(F.col("ok") & (F.coalesce("resid_frac", F.lit(1.0)) <= most)).select(key)
        from_ = from_.join(good, key, "left_semi")
    return from_.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(key))).where(F.col("_n") <= per_label).drop("_n")

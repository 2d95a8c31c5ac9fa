"""Classifier evaluation: confusion metrics, probability scores, calibration and out-of-distribution measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import vec
from loamgrid.operators import ranking
from loamgrid.session import durable


def confusion(predicted: DataFrame, truth: str = "label", guess: str = "pred") -> DataFrame:
    """(truth, guess, n, row_share)."""
    counts = predicted.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))
    return counts.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def per_class(matrix: DataFrame) -> DataFrame:
    """One row for each class that is a truth or a guess: tp, fp, fn, tn, precision, recall, specificity, f1, support."""
    sides = F.explode(F.array(F.struct(F.col("truth").alias("cls"), F.lit(True).alias("is_truth")), F.struct(F.col("guess").alias("cls"), F.lit(False).alias("is_truth"))))
    long = matrix.select("truth", "guess", "n", sides.alias("s"))
    sums = long.groupBy("s.cls").agg(
        F.sum(F.when(F.col("s.is_truth") & (F.col("truth") == F.col("guess")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("s.is_truth") & (F.col("truth") != F.col("guess")), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("s.is_truth") & (F.col("truth") != F.col("guess")), F.col("n")).otherwise(0)).alias("fn"),
    )
    everything = matrix.agg(F.sum("n").alias("total"))
    sums = sums.join(F.broadcast(everything), F.lit(True)).withColumn("tn", F.col("total") - F.col("tp") - F.col("fp") - F.col("fn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return sums.select("cls", "tp", "fp", "fn", "tn", (tp + fn).alias("support"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tn, tn + fp).alias("specificity"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def summary(matrix: DataFrame) -> DataFrame:
    """One row of scores over all classes.

    Macro F1 is over the classes that are truths or guesses, balanced accuracy
    over the truths only; kappa and the correlation coefficient (MCC) follow
    from the margins.
    """
    classes = per_class(matrix)
    n = F.sum("support").cast("double")
    truths, guesses = F.col("support").cast("double"), (F.col("tp") + F.col("fp")).cast("double")
    both, s, c = F.sum(truths * guesses), F.sum("support").cast("double"), F.sum("tp").cast("double")
    weigh = lambda m: F.sum(F.col(m) * truths) / n
    return classes.agg(
        (c / s).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        weigh("precision").alias("weighted_precision"),
        weigh("recall").alias("weighted_recall"),
        weigh("f1").alias("weighted_f1"),
        ((c / s - both / (s * s)) / (1 - both / (s * s))).alias("kappa"),
        ((c * s - both) / F.sqrt((s * s - F.sum(guesses * guesses)) * (s * s - F.sum(truths * truths)))).alias("mcc"),
    )


def scores_by(predicted: DataFrame, by: str, truth: str = "label", guess: str = "pred") -> DataFrame:
    """(by, n, accuracy, macro_f1, balanced_accuracy): the scores of :func:`summary` for each value of a column."""
    counts = predicted.groupBy(by, F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))
    hit = F.col("truth") == F.col("guess")
    sides = F.explode(F.array(F.struct(F.col("truth").alias("cls"), hit.alias("hit"), F.lit(True).alias("own")), F.struct(F.col("guess").alias("cls"), hit.alias("hit"), F.lit(False).alias("own"))))
    long = counts.select(by, "n", sides.alias("s"))
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)).cast("double")
    own, right = F.col("s.own"), F.col("s.hit")
    each = long.groupBy(by, "s.cls").agg(count(own & right).alias("tp"), count(~own & ~right).alias("fp"), count(own & ~right).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    return each.groupBy(by).agg(F.sum(tp + fn).cast("long").alias("n"), (F.sum(tp) / F.sum(tp + fn)).alias("accuracy"), F.avg(f1).alias("macro_f1"), F.avg(F.when(tp + fn > 0, tp / (tp + fn))).alias("balanced_accuracy"))


def top_k(probs: Column, k: int) -> Column:
    """(cls, prob) of the k greatest probabilities; ties go to the first class."""
    pairs = F.transform(probs, lambda p, i: F.struct((-p).alias("m"), i.alias("cls")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda x: F.struct(x["cls"].alias("cls"), (-x["m"]).alias("prob")))


def probability_scores(scored: DataFrame, classes: int, probs: str = "probs", label: str = "label") -> DataFrame:
    """One row: Brier score, log-loss, and accuracy within the top 1, 3 and 5."""
    p, y = F.col(probs), F.col(label)
    brier = vec.power(F.zip_with(p, vec.one_hot(y, classes), lambda a, b: a - b))
    rank = F.size(F.filter(p, lambda x: x > F.get(p, y))) + 1
    hits = [F.avg(F.when(rank <= k, 1.0).otherwise(0.0)).alias(f"top{k}") for k in (1, 3, 5)]
    return scored.agg(F.avg(brier).alias("brier"), F.avg(-F.ln(F.greatest(F.get(p, y), F.lit(1e-15)))).alias("log_loss"), *hits)


def calibration_bins(scored: DataFrame, bins: int, confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    """(bin, n, confidence, accuracy) of ``bins`` equal intervals, open on the left; a confidence of 0 is in none.

    Empty bins have n = 0, accuracy 0 and their midpoint as confidence.
    """
    edges = F.array(*[F.lit(k / bins) for k in range(bins)])
    own = F.size(F.filter(edges, lambda e: e < F.col(confidence)))
    found = scored.where(F.col(confidence) > 0).groupBy(own.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    every = scored.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("c", (F.col("bin") - 0.5) / bins).alias("confidence"), F.coalesce("a", F.lit(0.0)).alias("accuracy"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.abs(F.col("confidence") - F.col("accuracy")) * F.col("n")) / F.sum("n")).alias("ece"))


def auroc(scored: DataFrame, score: str, positive: str, slices: int = 4096) -> DataFrame:
    """One row: area under the curve by rank sums, ties ranked by their mean.

    Ranks are counted within slices of the range of scores, which are ordered
    apart from each other; only the slices' sizes are summed in one task.
    """
    span = scored.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    at = F.least(F.floor((F.col(score) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * slices), F.lit(slices - 1))
    counts = scored.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.when(F.col(positive), 1).otherwise(0)).alias("p"))
    sliced = counts.join(F.broadcast(span), F.lit(True)).withColumn("slice", F.coalesce(at, F.lit(0)))
    sizes = sliced.groupBy("slice").agg(F.sum("n").alias("size"))
    earlier = sizes.withColumn("before", F.sum("size").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy("slice").orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sliced.join(F.broadcast(earlier), "slice").withColumn("upto", F.coalesce("before", F.lit(0)) + F.sum("n").over(within))
    ranked = ranked.withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2)
    p, q = F.sum("p").cast("double"), F.sum(F.col("n") - F.col("p")).cast("double")
    return ranked.agg(((F.sum(F.col("rank") * F.col("p")) - p * (p + 1) / 2) / (p * q)).alias("auroc"))


def energy_threshold(scored: DataFrame, energy: str, ood: str, percentile: float = 0.95) -> DataFrame:
    """One row: the percentile of in-distribution energy, and the share of the others at or under it."""
    threshold = ranking.quantiles(scored.where(~F.col(ood)), energy, [percentile]).select(F.col("quantile").alias("threshold"))
    return scored.join(F.broadcast(threshold), F.lit(True)).agg(F.max("threshold").alias("threshold"), F.avg(F.when(F.col(ood), (F.col(energy) <= F.col("threshold")).cast("double"))).alias("fpr"))


def fit_temperature(scored: DataFrame, grid: list[float], logits: str = "logits", label: str = "label") -> DataFrame:
    """One row (temperature, nll): the temperature of ``grid`` with the least mean log-loss, in one pass over the rows."""
    z, y = F.col(logits), F.col(label)
    losses = F.array(*[vec.logsumexp(vec.scaled(z, t)) - F.get(z, y) / t for t in grid])
    means = scored.select(F.posexplode(losses).alias("k", "loss")).groupBy("k").agg(F.avg("loss").alias("nll"))
    named = means.withColumn("temperature", F.get(F.array(*map(F.lit, grid)), F.col("k")))
    return named.agg(F.min_by("temperature", F.struct("nll", "temperature")).alias("temperature"), F.min("nll").alias("nll"))


#: Bounds of a fitted temperature, and the step of 1 / temperature, relative to it, at which the fit ends.
COLDEST, HOTTEST, SETTLED = 0.01, 1000.0, 1e-10


def loss_terms(logits: Column, label: Column, beta: Column | float) -> Column:
    """(loss, slope, bend): a row's log-loss at temperature 1 / beta, and its first two derivatives by beta."""
    apart = lambda m: F.transform(logits, lambda z: z - m)
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"), F.lit(0.0).alias("dd"))
    sums = lambda ds: F.aggregate(ds, start, lambda acc, d: F.struct((acc["n"] + F.exp(beta * d)).alias("n"), (acc["d"] + F.exp(beta * d) * d).alias("d"), (acc["dd"] + F.exp(beta * d) * d * d).alias("dd")))
    own = F.get(logits, label) - F.array_max(logits)
    terms = lambda s: F.struct((F.ln(s["n"]) - beta * own).alias("loss"), (s["d"] / s["n"] - own).alias("slope"), (s["dd"] / s["n"] - (s["d"] / s["n"]) ** 2).alias("bend"))
    return vec.bound(sums(apart(F.array_max(logits))), terms)


def minimised_temperature(scored: DataFrame, logits: str = "logits", label: str = "label", start: float = 1.5, tolerance: float = SETTLED, most: int = 100) -> DataFrame:
    """One row (temperature, nll, slope, steps): the temperature of least mean log-loss.

    The loss is convex in 1 / temperature, so each pass over the rows takes a
    Newton step from the mean slope and bend, or halves the interval that the
    slopes' signs leave where the step would go out of it. The temperature stays
    between COLDEST and HOTTEST, where data have no minimum in between. Rows with
    a null or unusable label, or null, missing or infinite logits, don't count;
    without rows, all columns but steps are null.
    """
    z, y = F.col(logits).cast("array<double>"), F.col(label).cast("int")
    rows = durable(scored.select(z.alias("z"), y.alias("y")).where(F.coalesce(F.forall("z", lambda x: x.isNotNull()) & F.col("y").isNotNull(), F.lit(False))).where(usable_rows("z", "y")))
    low, high, beta, at, steps = 1 / HOTTEST, 1 / COLDEST, 1 / start, None, 0
    while steps < most:
        at = rows.select(loss_terms(F.col("z"), F.col("y"), F.lit(beta)).alias("t")).agg(F.avg("t.loss").alias("loss"), F.avg("t.slope").alias("slope"), F.avg("t.bend").alias("bend")).first()
        steps += 1
        if at["loss"] is None:
            break
        low, high = (beta, high) if at["slope"] < 0 else (low, beta)
        if at["slope"] == 0 or high - low <= tolerance * beta:
            break
        step = beta - at["slope"] / at["bend"] if at["bend"] > 0 else float("nan")
        if not low <= step <= high:
            # The end of the range is the result where the loss falls all the way to it.
            step = (low + high) / 2
        if abs(step - beta) <= tolerance * beta:
            break
        beta = step
    none = at["loss"] is None
    row = (None, None, None, steps) if none else (1 / beta, at["loss"], at["slope"], steps)
    return scored.sparkSession.createDataFrame([row], "temperature double, nll double, slope double, steps int")


def usable_rows(logits: str, label: str) -> Column:
    """Whether a row has a label among its logits, all of them numbers."""
    return F.forall(logits, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.col(label) >= 0) & (F.col(label) < F.size(logits))


def calibrate(val: DataFrame, test: DataFrame, ood: DataFrame, bins: int = 10, percentile: float = 0.95) -> DataFrame:
    """One row: temperature, energy_threshold, uncalibrated_ece, calibrated_ece, ood_auroc, fpr.

    The temperature and the threshold, a percentile of the energy at it, are
    fitted on ``val``; errors of confidence are those of ``test``, and energies
    of ``test`` are held against those of ``ood``. All have logits, the first two
    a label.
    """
    fitted = minimised_temperature(val).select("temperature")
    t = fitted.first()[0]
    scored = lambda rows, by: rows.select(vec.softmax(vec.scaled(F.col("logits"), by)).alias("p"), "label").select(F.array_max("p").alias("confidence"), (vec.argmax(F.col("p")) == F.col("label")).alias("correct"))
    errors = [expected_calibration_error(calibration_bins(scored(test, by), bins)).withColumnRenamed("ece", name) for by, name in ((1.0, "uncalibrated_ece"), (t, "calibrated_ece"))]
    energy = lambda rows: rows.select(vec.energy(F.col("logits"), t).alias("energy"))
    threshold = ranking.quantiles(energy(val), "energy", [percentile]).select(F.col("quantile").alias("energy_threshold"))
    both = durable(energy(test).withColumn("ood", F.lit(False)).unionByName(energy(ood).withColumn("ood", F.lit(True))))
    under = both.where("ood").join(F.broadcast(threshold), F.lit(True)).agg(F.avg((F.col("energy") <= F.col("energy_threshold")).cast("double")).alias("fpr"))
    out = fitted
    for one in (threshold, *errors, auroc(both, "energy", "ood").withColumnRenamed("auroc", "ood_auroc"), under):
        out = out.join(F.broadcast(one), F.lit(True))
    return out

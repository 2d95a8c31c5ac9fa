"""Model evaluation: a centroid head on the embeddings stands for a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.functions import models, vec
from loamgrid.operators import backgrounds, metrics, predict
from loamgrid.plans.registry import query, read
from loamgrid.session import durable

#: Classes, and the factor that sharpens the head's logits.
CLASSES, SHARPNESS = 10, 20.0


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, logits): scaled inner products with the labels' mean vectors, one small row for each label."""
    items = read(spark, sf_dir, "embeddings").select("vec_id", "label", vec.doubles(F.col("embedding")).alias("v"))
    means = items.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    heads = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("m")).select("label", F.col("m.x").alias("m"))
    head = heads.agg(F.sort_array(F.collect_list(F.struct("label", "m"))).alias("h")).select(F.col("h.m").alias("head"))
    joined = items.join(F.broadcast(head), F.lit(True))
    return joined.select("vec_id", "label", F.transform("head", lambda m: SHARPNESS * vec.dot(F.col("v"), m)).alias("logits"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = logits(spark, sf_dir).withColumn("probs", vec.softmax(F.col("logits")))
    out = out.withColumn("pred", vec.argmax(F.col("probs"))).withColumn("confidence", F.array_max("probs"))
    return out.withColumn("correct", F.col("pred") == F.col("label"))


_LOGITS = f"""e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
 hd AS (SELECT label AS c, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(v[i]) AS m FROM e CROSS JOIN range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
 lg AS (SELECT vec_id, e.label, list({SHARPNESS} * list_dot_product(v, m) ORDER BY c) AS z FROM e CROSS JOIN hd GROUP BY vec_id, e.label)"""
_SCORED = f"""{_LOGITS}, ex AS (SELECT *, [exp(x - list_max(z)) FOR x IN z] AS x FROM lg), pr AS (SELECT vec_id, label, z, [y / list_sum(x) FOR y IN x] AS p FROM ex),
 sc AS (SELECT *, list_position(p, list_max(p)) - 1 AS pred, list_max(p) AS confidence, list_position(p, list_max(p)) - 1 = label AS correct FROM pr),
 cm AS (SELECT label AS truth, pred AS guess, count(*) AS n FROM sc GROUP BY ALL),
 cl AS (SELECT cls, coalesce(sum(n) FILTER (truth = cls AND guess = cls), 0) AS tp, coalesce(sum(n) FILTER (guess = cls AND truth <> cls), 0) AS fp, coalesce(sum(n) FILTER (truth = cls AND guess <> cls), 0) AS fn, sum(n) AS total
   FROM cm CROSS JOIN (SELECT truth AS cls FROM cm UNION SELECT guess FROM cm) GROUP BY cls),
 pc AS (SELECT *, total - tp - fp - fn AS tn, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
   CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM cl)"""


@query(f"WITH {_SCORED} SELECT vec_id, round(p[1], 6) AS p0, round(list_max(p), 6) AS top, pred AS top_cls FROM sc")
def q_softmax_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = metrics.top_k(F.col("probs"), 3)
    return scored(spark, sf_dir).select("vec_id", F.round(F.col("probs")[0], 6).alias("p0"), top.alias("t")).select("vec_id", "p0", F.round(F.col("t")[0]["prob"], 6).alias("top"), F.col("t")[0]["cls"].alias("top_cls"))


@query(f"WITH {_LOGITS} SELECT vec_id, round(-(list_max(z) + ln(list_sum([exp(x - list_max(z)) FOR x IN z]))), 6) AS energy, round(-2 * (list_max(z) / 2 + ln(list_sum([exp((x - list_max(z)) / 2) FOR x IN z]))), 6) AS energy_t2 FROM lg")
def q_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("logits")
    return logits(spark, sf_dir).select("vec_id", F.round(vec.energy(z), 6).alias("energy"), F.round(vec.energy(z, 2.0), 6).alias("energy_t2"))


@query(f"WITH {_LOGITS}, x AS (SELECT vec_id, [exp((x - list_max(z)) / 0.5) FOR x IN z] AS x FROM lg) SELECT vec_id, round(list_max(x) / list_sum(x), 6) AS confidence FROM x")
def q_temperature_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits(spark, sf_dir).select("vec_id", F.round(F.array_max(vec.softmax(vec.scaled(F.col("logits"), 0.5))), 6).alias("confidence"))


_BINS = f"{_SCORED}, bn AS (SELECT b.b AS bin, count(sc.vec_id) AS n, coalesce(avg(confidence), (b.b - 0.5) / 10) AS confidence, coalesce(avg(CAST(correct AS INTEGER)), 0) AS accuracy FROM range(1, 11) b(b) LEFT JOIN sc ON confidence > (b.b - 1) / 10.0 AND confidence <= b.b / 10.0 GROUP BY b.b)"


@query(f"WITH {_BINS} SELECT CAST(bin AS INTEGER) AS bin, n, round(confidence, 6) AS confidence, round(CAST(accuracy AS DOUBLE), 6) AS accuracy FROM bn")
def q_ece_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = metrics.calibration_bins(scored(spark, sf_dir), 10)
    return bins.select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


@query(f"WITH {_BINS} SELECT round(sum(abs(confidence - accuracy) * n) / sum(n), 6) AS ece FROM bn")
def q_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.expected_calibration_error(metrics.calibration_bins(scored(spark, sf_dir), 10)).select(F.round("ece", 6).alias("ece"))


@query(f"WITH {_SCORED} SELECT truth, guess, n, round(n / sum(n) OVER (PARTITION BY truth), 6) AS row_share FROM cm")
def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(scored(spark, sf_dir)).withColumn("row_share", F.round("row_share", 6))


@query(f"WITH {_SCORED} SELECT cls, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round(f1, 6) AS f1 FROM pc")
def q_per_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.per_class(metrics.confusion(scored(spark, sf_dir)))
    return rows.select("cls", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "specificity", "f1")])


@query(f"""WITH {_SCORED} SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
 round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy, round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM pc""")
def q_macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.summary(metrics.confusion(scored(spark, sf_dir)))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns if c not in ("kappa", "mcc")])


@query(f"""WITH {_SCORED}, m AS (SELECT sum(CAST(support AS DOUBLE) * (tp + fp)) AS b, sum(CAST(support AS DOUBLE)) AS s, sum(CAST(tp AS DOUBLE)) AS c, sum(CAST(support AS DOUBLE) * support) AS tt, sum(CAST(tp + fp AS DOUBLE) * (tp + fp)) AS gg FROM pc)
SELECT round((c / s - b / (s * s)) / (1 - b / (s * s)), 6) AS kappa, round((c * s - b) / sqrt((s * s - gg) * (s * s - tt)), 6) AS mcc FROM m""")
def q_kappa_mcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(metrics.confusion(scored(spark, sf_dir))).select(F.round("kappa", 6).alias("kappa"), F.round("mcc", 6).alias("mcc"))


@query(f"WITH {_SCORED} SELECT round(avg(list_sum([x * x FOR x IN p]) - 2 * p[label + 1] + 1), 6) AS brier, round(avg(-ln(greatest(p[label + 1], 1e-15))), 6) AS log_loss FROM sc")
def q_brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.probability_scores(scored(spark, sf_dir), CLASSES).select(F.round("brier", 6).alias("brier"), F.round("log_loss", 6).alias("log_loss"))


@query(f"WITH {_SCORED}, r AS (SELECT len([x FOR x IN p IF x > p[label + 1]]) + 1 AS r FROM sc) SELECT round(avg(CAST(r <= 1 AS INTEGER)), 6) AS top1, round(avg(CAST(r <= 3 AS INTEGER)), 6) AS top3, round(avg(CAST(r <= 5 AS INTEGER)), 6) AS top5 FROM r")
def q_topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.probability_scores(scored(spark, sf_dir), CLASSES)
    return out.select(*[F.round(f"top{k}", 6).alias(f"top{k}") for k in (1, 3, 5)])


#: Labels from here on count as out of distribution.
OOD_FROM = 8
_OOD = f"{_LOGITS}, en AS (SELECT vec_id, label >= {OOD_FROM} AS ood, round(-(list_max(z) + ln(list_sum([exp(x - list_max(z)) FOR x IN z]))), 6) AS energy FROM lg)"


def energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits(spark, sf_dir).select("vec_id", (F.col("label") >= OOD_FROM).alias("ood"), F.round(vec.energy(F.col("logits")), 6).alias("energy"))


@query(f"WITH {_OOD}, r AS (SELECT ood, rank() OVER (ORDER BY energy) + (count(*) OVER (PARTITION BY energy) - 1) / 2.0 AS r FROM en) SELECT round((sum(r) FILTER (ood) - count(*) FILTER (ood) * (count(*) FILTER (ood) + 1) / 2.0) / (count(*) FILTER (ood) * count(*) FILTER (NOT ood)), 6) AS auroc FROM r")
def q_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auroc(energies(spark, sf_dir), "energy", "ood").select(F.round("auroc", 6).alias("auroc"))


@query(f"WITH {_OOD}, t AS (SELECT quantile_cont(energy, 0.95) AS t FROM en WHERE NOT ood) SELECT round(max(t), 6) AS threshold, round(avg(CAST(energy <= t AS INTEGER)) FILTER (ood), 6) AS fpr FROM en, t")
def q_fpr95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.energy_threshold(energies(spark, sf_dir), "energy", "ood").select(F.round("threshold", 6).alias("threshold"), F.round("fpr", 6).alias("fpr"))


GRID = [0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 5.0]


@query(f"""WITH {_LOGITS}, g(t) AS (VALUES {", ".join(f"(CAST({t} AS DOUBLE))" for t in GRID)}), l AS (SELECT t, avg(list_max(z) / t + ln(list_sum([exp((x - list_max(z)) / t) FOR x IN z])) - z[label + 1] / t) AS nll FROM lg CROSS JOIN g GROUP BY t)
SELECT arg_min(t, nll) AS temperature, round(min(nll), 6) AS nll FROM l""")
def q_temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fit_temperature(logits(spark, sf_dir), GRID).select("temperature", F.round("nll", 6).alias("nll"))


#: A logit's distance from the greatest, and the sums of a row's weights at the inverse temperature b, of which the loss and its derivatives are made.
_D = "[x - list_max(z) FOR x IN z]"
_STEPS = f"""st(k, b) AS (SELECT 0, CAST(1 / 1.5 AS DOUBLE) UNION ALL SELECT k + 1, max(b) - avg(d1 - o) / avg(d2 - d1 * d1) FROM
 (SELECT k, b, list_dot_product(w, d) / list_sum(w) AS d1, list_dot_product(w, [x * x FOR x IN d]) / list_sum(w) AS d2, o FROM (SELECT k, b, d, [exp(b * x) FOR x IN d] AS w, o FROM st CROSS JOIN fit WHERE k < 25)) GROUP BY k)"""
_FIT = f"WITH RECURSIVE {_LOGITS}, fit AS (SELECT {_D} AS d, z[label + 1] - list_max(z) AS o FROM lg %s), {_STEPS}, best AS (SELECT 1 / b AS t FROM st WHERE k = 25)"


@query(f"{_FIT % ''} SELECT round(t, 5) AS temperature, round(avg(ln(list_sum([exp(x / t) FOR x IN d])) - o / t), 6) AS nll FROM best CROSS JOIN fit GROUP BY t")
def q_temperature_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temperature of least loss, by Newton steps."""
    return metrics.minimised_temperature(logits(spark, sf_dir)).select(F.round("temperature", 5).alias("temperature"), F.round("nll", 6).alias("nll"))


_ECE = "(SELECT round(sum(abs(c - a) * n) / sum(n), 6) FROM (SELECT ceil(c * 10) AS b, avg(c) AS c, avg(CAST(o AS INTEGER)) AS a, count(*) AS n FROM (SELECT list_max(z) / %s AS m, 1 / list_sum([exp((x - list_max(z)) / %s) FOR x IN z]) AS c, list_position(z, list_max(z)) - 1 = label AS o FROM test CROSS JOIN best) GROUP BY 1))"


@query(f"""{_FIT % f"WHERE label < {OOD_FROM} AND vec_id % 3 = 0"}, test AS (SELECT * FROM lg WHERE label < {OOD_FROM} AND vec_id % 3 = 1),
 en AS (SELECT label, vec_id % 3 AS part, -t * (list_max(z) / t + ln(list_sum([exp((x - list_max(z)) / t) FOR x IN z]))) AS energy FROM lg CROSS JOIN best),
 th AS (SELECT quantile_cont(energy, 0.95) AS th FROM en WHERE label < {OOD_FROM} AND part = 0), both_ AS (SELECT energy, label >= {OOD_FROM} AS ood FROM en WHERE label >= {OOD_FROM} OR part = 1),
 rk AS (SELECT ood, rank() OVER (ORDER BY energy) + (count(*) OVER (PARTITION BY energy) - 1) / 2.0 AS r FROM both_)
SELECT round(t, 5) AS temperature, round(th, 5) AS energy_threshold, {_ECE % ('1', '1')} AS uncalibrated_ece, {_ECE % ('t', 't')} AS calibrated_ece,
 (SELECT round((sum(r) FILTER (ood) - count(*) FILTER (ood) * (count(*) FILTER (ood) + 1) / 2.0) / (count(*) FILTER (ood) * count(*) FILTER (NOT ood)), 6) FROM rk) AS ood_auroc,
 (SELECT round(avg(CAST(energy <= th AS INTEGER)), 6) FROM both_ WHERE ood) AS fpr FROM best CROSS JOIN th""")
def q_calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature and energy threshold fitted on a part of the known classes, and what they do on another part and on the others."""
    rows = durable(logits(spark, sf_dir))
    known = rows.where(F.col("label") < OOD_FROM)
    out = metrics.calibrate(known.where("vec_id % 3 = 0"), known.where("vec_id % 3 = 1"), rows.where(F.col("label") >= OOD_FROM))
    digits = {"temperature": 5, "energy_threshold": 5}
    return out.select(*(F.round(c, digits.get(c, 6)).alias(c) for c in out.columns))


NAMES = [f"class_{k}" for k in range(CLASSES)]
_ENERGY = "-(list_max(z) + ln(list_sum([exp(x - list_max(z)) FOR x IN z])))"


@query(f"""WITH {_SCORED} SELECT vec_id, 'class_' || pred AS predicted_class, round(confidence, 6) AS confidence, {_ENERGY} > -4 OR pred = 9 OR confidence < 0.2 AS abstain,
 CASE WHEN {_ENERGY} > -4 THEN 'energy' WHEN pred = 9 THEN 'reject class' WHEN confidence < 0.2 THEN 'low confidence' ELSE '' END AS abstain_reason FROM sc""")
def q_abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = predict.predict(logits(spark, sf_dir), NAMES, 1.0, threshold=-4.0, reject="class_9", least=0.2)
    return out.select("vec_id", "predicted_class", F.round("confidence", 6).alias("confidence"), "abstain", "abstain_reason")


@query(f"""WITH {_LOGITS}, q AS (SELECT z, [greatest(-128, least(127, round_even(x / 0.25, 0) + 3)) FOR x IN z] AS q FROM lg), d AS (SELECT z, [(x - 3) * 0.25 FOR x IN q] AS d FROM q)
SELECT round(avg(CAST(list_position(z, list_max(z)) = list_position(d, list_max(d)) AS INTEGER)), 6) AS top1_agreement, round(max(list_max([abs(z[i] - d[i]) FOR i IN range(1, 11)])), 6) AS max_diff FROM d""")
def q_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = logits(spark, sf_dir).withColumn("d", vec.dequantize(vec.quantize(F.col("logits"), 0.25, 3), 0.25, 3))
    same = (vec.argmax(F.col("logits")) == vec.argmax(F.col("d"))).cast("int")
    return back.agg(F.round(F.avg(same), 6).alias("top1_agreement"), F.round(F.max(vec.chebyshev(F.col("logits"), F.col("d"))), 6).alias("max_diff"))


@query("""WITH q AS (SELECT vec_id, [greatest(-128, least(127, CAST(round_even(CAST(x AS DOUBLE) / 0.01, 0) AS INTEGER))) FOR x IN embedding] AS q FROM embeddings)
SELECT vec_id, CAST(list_sum(q) AS BIGINT) AS total, round(list_sum([x * CAST(0.01 AS DOUBLE) * x * CAST(0.01 AS DOUBLE) FOR x IN q]), 6) AS power FROM q""")
def q_quantize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of each vector as an 8-bit number: their sum, and the power of the vector that they give back."""
    items = read(spark, sf_dir, "embeddings").select("vec_id", vec.quantize(vec.doubles(F.col("embedding")), 0.01).alias("q"))
    back = vec.dequantize(F.col("q"), 0.01)
    return items.select("vec_id", vec.total(F.col("q").cast("array<double>")).cast("long").alias("total"), F.round(vec.dot(back, back), 6).alias("power"))


@query("""WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), q AS (SELECT vec_id, v, [greatest(-128, least(127, CAST(round_even(x / 0.01, 0) AS INTEGER))) FOR x IN v] AS q FROM v)
SELECT vec_id, array_to_string(q, ',') AS q, round(list_max([abs(v[i] - q[i] * CAST(0.01 AS DOUBLE)) FOR i IN range(1, len(v) + 1)]), 6) AS max_error FROM q""")
def q_quantize_roundtrip_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of each vector as an 8-bit number, and the largest error of the vector that these give back."""
    items = read(spark, sf_dir, "embeddings").select("vec_id", vec.doubles(F.col("embedding")).alias("v")).withColumn("q", vec.quantize(F.col("v"), 0.01))
    return items.select("vec_id", F.array_join("q", ",").alias("q"), F.round(vec.chebyshev(F.col("v"), vec.dequantize(F.col("q"), 0.01)), 6).alias("max_error"))


_QC = "qc AS (SELECT d.doc_id, d.lang, d.n_chars / 4000.0 AS area_frac, l.quality AS quality, l.toxic AS toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
_REASON = "CASE WHEN area_frac < 0.08 THEN 'area too small' WHEN area_frac > 0.97 THEN 'area too large' WHEN quality < 0.8 THEN 'fragmented' WHEN toxic > 0.3 THEN 'leaks' ELSE '' END"


def quality_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as masks: their length is the area, labels the other measures, null where there is no label."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") / 4000.0).alias("area_frac"))
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("largest_cc_frac"), F.col("toxic").cast("double").alias("leak_frac"))
    return docs.join(labels, "doc_id", "left").withColumn("reason", predict.quality_reason()).withColumn("ok", F.col("reason") == "")


@query(f"WITH {_QC} SELECT {_REASON} AS reason, count(*) AS n FROM qc GROUP BY 1")
def q_qc_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_table(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {_QC}, r AS (SELECT lang, {_REASON} = '' AS ok FROM qc), f AS (SELECT lang, count(*) FILTER (NOT ok) AS bad FROM r GROUP BY lang)
SELECT (SELECT round(avg(CAST(ok AS INTEGER)), 6) FROM r) AS pass_rate, CAST(sum(bad) AS BIGINT) AS failures, round(max(bad) / sum(bad), 6) AS top_share FROM f""")
def q_qc_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = quality_table(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum((~F.col("ok")).cast("int")).alias("bad"))
    return sums.agg(F.round(1 - F.sum("bad") / F.sum("n"), 6).alias("pass_rate"), F.sum("bad").alias("failures"), F.round(F.max("bad") / F.sum("bad"), 6).alias("top_share"))


@query(f"WITH {_QC}, r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM qc WHERE {_REASON} = '' AND coalesce(toxic, 1) <= 0.01 AND doc_id % 10 < 7) SELECT doc_id, lang FROM r WHERE n <= 5")
def q_harvest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = quality_table(spark, sf_dir)
    items = table.select("doc_id", "lang", F.when(F.col("doc_id") % 10 < 7, "train").otherwise("val").alias("split"))
    return predict.harvest_sources(items, table.select("doc_id", "ok", F.col("leak_frac").alias("resid_frac")), "doc_id", "lang", per_label=5).select("doc_id", "lang")


@query("""SELECT p_partkey, p_retailprice <= 1500 AND coalesce(p_size % 7 <> 0 AND p_size >= 10, false) AS passed, CASE WHEN p_size % 7 = 0 THEN 'npu' ELSE '' END AS unmeasured FROM part""")
def q_gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts through a gate: one with a bound exceeded fails, and so does one with a value that wasn't measured."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("sram"), F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("npu"))
    checks = {"sram": F.col("sram") <= 1500, "npu": F.col("npu") >= 10}
    return rows.select("p_partkey", predict.passes(*checks.values()).alias("passed"), F.array_join(predict.unmeasured(checks), ",").alias("unmeasured"))


@query("SELECT doc_id, CASE WHEN doc_id % 11 <= 5 THEN 'CMD_TREAT' ELSE 'CMD_PRUNE' END AS command, CASE WHEN doc_id % 3 = 0 THEN 'UNCERTAIN' WHEN lang = 'en' THEN 'HEALTHY' ELSE 'PATHOLOGY' END AS status FROM documents")
def q_triage_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    name = F.when(F.col("lang") == "en", "Leaf___Healthy").otherwise("Leaf___Blight")
    return docs.select("doc_id", predict.triage(F.col("doc_id") % 11).alias("command"), predict.status(F.col("doc_id") % 3 == 0, name).alias("status"))


@query("""WITH e AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings CROSS JOIN range(1, 65) r(i)),
 s AS (SELECT label AS c, i, avg(x) AS m, var_pop(x) + 1e-9 AS v, count(*) AS n FROM e GROUP BY label, i),
 l AS (SELECT vec_id, c, ln(max(n) / (SELECT count(*) FROM embeddings)) + sum(-0.5 * ln(2 * pi() * v) - (x - m) * (x - m) / (2 * v)) AS score FROM e JOIN s ON s.i = e.i GROUP BY vec_id, c)
SELECT vec_id, arg_max(c, score) AS pred, round(max(score), 4) AS score FROM l GROUP BY vec_id""")
def q_gaussian_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "embeddings").select("vec_id", "label", vec.doubles(F.col("embedding")).alias("v"))
    model = models.gaussian_bayes(items, "label", "v")
    found = items.join(F.broadcast(model), F.lit(True)).select("vec_id", "classes", models.bayes_scores(F.col("v"), F.col("classes"), F.col("total")).alias("s"))
    return found.select("vec_id", F.get("classes", vec.argmax(F.col("s")))["label"].alias("pred"), F.round(F.array_max("s"), 4).alias("score"))


def _u(seed: int, key: str = "id") -> str:
    return f"CAST('0x' || substr(md5({key} || '|{seed}'), 1, 8) AS BIGINT) / 4294967296.0"


@query(f"""WITH {_QC}, hb AS (SELECT lang AS label, CAST(doc_id AS VARCHAR) AS file, doc_id % 17 <> 0 AS readable, row_number() OVER (ORDER BY lang NULLS FIRST, CAST(doc_id AS VARCHAR)) - 1 AS place FROM qc WHERE {_REASON} = '' AND coalesce(toxic, 1) <= 0.01),
 iv AS (SELECT label, min(place) AS first, count(*) AS held FROM hb GROUP BY label), nh AS (SELECT count(*) AS n FROM hb),
 fb AS (SELECT CAST(item_id AS VARCHAR) AS file, item_id % 5 <> 0 AS readable, row_number() OVER (ORDER BY CAST(item_id AS VARCHAR)) - 1 AS place FROM benchmark), nf AS (SELECT count(*) AS n FROM fb),
 it AS (SELECT doc_id AS id, lang, nf.n AS nf, nh.n AS nh, coalesce(CASE WHEN held < nh.n THEN held END, 0) AS held, coalesce(first, 0) AS first FROM documents LEFT JOIN iv ON label IS NOT DISTINCT FROM lang CROSS JOIN nh CROSS JOIN nf),
 dr AS (SELECT *, CASE WHEN {_u(11)} < 0.3 AND nf > 0 THEN CAST(floor({_u(12)} * nf) AS BIGINT) END AS f, CASE WHEN {_u(13)} >= 0.4 AND nh > 0 THEN CAST(floor({_u(14)} * (nh - held)) AS BIGINT) END AS h FROM it),
 fd AS (SELECT id, lang, fb.file AS ff, hb.file AS hf FROM dr LEFT JOIN fb ON fb.readable AND fb.place = f LEFT JOIN hb ON hb.readable AND hb.place = CASE WHEN h >= first THEN h + held ELSE h END)
SELECT id AS doc_id, lang, CASE WHEN ff IS NOT NULL THEN 'field' WHEN hf IS NOT NULL THEN 'harvested' ELSE 'procedural' END AS source, coalesce(ff, hf) AS file,
 CASE WHEN ff IS NULL AND hf IS NULL THEN {list(backgrounds.KINDS)}[CAST(floor({_u(15)} * {len(backgrounds.KINDS)}) AS INTEGER) + 1] END AS kind FROM fd""")
def q_background_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backdrop for every document: a benchmark item, a sound document of another language, or a made one."""
    table = quality_table(spark, sf_dir).where(F.col("ok") & (F.coalesce("leak_frac", F.lit(1.0)) <= 0.01))
    harvested = backgrounds.bank(table.select("lang", F.col("doc_id").cast("string").alias("file"), (F.col("doc_id") % 17 != 0).alias("can")), "lang", readable="can")
    field = backgrounds.bank(read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("file"), (F.col("item_id") % 5 != 0).alias("can")), readable="can")
    items = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return backgrounds.draw_backdrops(items, "doc_id", "lang", harvested, field, 11, p_field=0.3, p_procedural=0.4)

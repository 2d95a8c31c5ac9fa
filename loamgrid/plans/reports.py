"""Samples, reports, training statistics and mask operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.functions import masks, pooling, vec
from loamgrid.operators import metrics, predict, ranking, sampling, splits
from loamgrid.operators.components import connected_components
from loamgrid.plans.evaluation import _SCORED, scored
from loamgrid.plans.integrity import _FILES, files, kept
from loamgrid.plans.registry import query, read
from loamgrid.session import durable

SEED = 1337
_U = "CAST('0x' || substr(md5(CAST({0} AS VARCHAR) || '|{1}'), 1, 8) AS BIGINT) / 4294967296.0"


@query(f"WITH {_FILES}, u AS (SELECT id, cls, {_U.format('id', SEED)} AS u FROM k) SELECT id, cls, CAST(row_number() OVER (ORDER BY u, id) AS INTEGER) AS place FROM u ORDER BY u, id LIMIT 200")
def q_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.seeded_sample(kept(spark, sf_dir).select("id", "cls"), 200, SEED)


@query(f"WITH {_FILES}, p AS (SELECT id AS a, lead(id) OVER (PARTITION BY cls, site, length(text) % 50 ORDER BY id) AS b FROM k WHERE text IS NOT NULL) SELECT a, b FROM p WHERE b IS NOT NULL")
def q_positive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = kept(spark, sf_dir).select("id", "cls", "site", (F.length("text") % 50).alias("shot"))
    return sampling.same_key_pairs(items, ["cls", "site", "shot"])


@query(f"""WITH {_FILES}, l AS (SELECT id AS a, cls AS la, row_number() OVER (ORDER BY {_U.format('id', SEED)}, id) AS place FROM k), r AS (SELECT id AS b, cls AS lb, row_number() OVER (ORDER BY {_U.format('id', SEED + 1)}, id) AS place FROM k)
SELECT a, b FROM l JOIN r USING (place) WHERE place <= 12000 AND la <> lb ORDER BY place LIMIT 3000""")
def q_negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.cross_class_pairs(kept(spark, sf_dir).select("id", "cls"), "cls", 3000, SEED)


@query(f"""WITH {_FILES}, c AS (SELECT cls, pow(1.0 / count(*), 0.5) AS w FROM k GROUP BY cls), i AS (SELECT id, w FROM k JOIN c USING (cls)),
 x AS (SELECT id, w, sum(w) OVER (ORDER BY id) / sum(w) OVER () AS hi, sum(w) OVER () AS t FROM i), d AS (SELECT i AS draw, {_U.format('i', SEED)} AS u FROM range(0, 500) r(i))
SELECT draw, id FROM d JOIN x ON u >= hi - w / t AND u < hi""")
def q_weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = kept(spark, sf_dir).select("id", "cls")
    weights = items.groupBy("cls").agg(F.pow(1.0 / F.count("*"), 0.5).alias("w"))
    return sampling.weighted_draws(items.join(weights, "cls"), "w", 500, SEED)


@query("""WITH b AS (SELECT l_returnflag, l_linestatus, l_shipdate::DATE AS d, avg(l_discount) AS loss, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(sum(loss * n) / greatest(1, sum(n)), 8) AS weighted, round(avg(loss), 8) AS of_batches FROM b GROUP BY l_returnflag""")
def q_weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over rows and the mean of batches' means, which differ."""
    batches = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("d")).agg(F.avg("l_discount").alias("loss"), F.count("*").alias("n"))
    rows = F.sum(F.col("loss") * F.col("n")) / F.greatest(F.lit(1), F.sum("n"))
    return batches.groupBy("l_returnflag").agg(F.round(rows, 8).alias("weighted"), F.round(F.avg("loss"), 8).alias("of_batches"))


@query("SELECT event_type, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC, event_type) AS INTEGER) AS place FROM events GROUP BY event_type")
def q_value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"), "event_type")))


ALLOWED = ("click", "view", "purchase")


@query(f"SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS outside FROM events WHERE event_type NOT IN {ALLOWED} GROUP BY user_id")
def q_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of event that a user has and the allow-list has not."""
    own = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    outside = F.sort_array(F.array_except("kinds", F.array(*map(F.lit, ALLOWED))))
    return own.select("user_id", F.array_join(outside, ",").alias("outside")).where("outside <> ''")


@query(f"""WITH {_FILES}, s AS (SELECT site, list_sort(list(DISTINCT cls)) AS c FROM k GROUP BY site), head AS (SELECT c AS first FROM s ORDER BY site LIMIT 1)
SELECT site, len(list_filter(c, lambda x: NOT list_contains(first, x))) AS only_here, len(list_filter(c, lambda x: list_contains(first, x))) AS shared, len(list_filter(first, lambda x: NOT list_contains(c, x))) = 0 AS holds_all FROM s CROSS JOIN head""")
def q_class_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference, intersection and subset test of each site's classes with the first site's."""
    own = kept(spark, sf_dir).groupBy("site").agg(F.collect_set("cls").alias("c"))
    first = own.orderBy("site").limit(1).select(F.col("c").alias("first"))
    both = own.join(F.broadcast(first), F.lit(True))
    return both.select("site", F.size(F.array_except("c", "first")).cast("long").alias("only_here"), F.size(F.array_intersect("c", "first")).cast("long").alias("shared"), (F.size(F.array_except("first", "c")) == 0).alias("holds_all"))


@query(f"WITH {_SCORED} SELECT label, count(*) FILTER (confidence < 0.5) AS below_50, count(*) FILTER (confidence < 0.9) AS below_90, count(*) AS n FROM sc GROUP BY label")
def q_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each of two cut-offs would exclude."""
    below = lambda x: F.count(F.when(F.col("confidence") < x, 1))
    return scored(spark, sf_dir).groupBy("label").agg(below(0.5).alias("below_50"), below(0.9).alias("below_90"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS epoch, round(avg(value), 3) AS score FROM events GROUP BY ALL)
SELECT user_id, epoch, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, epoch) AS r FROM e) WHERE r = 1""")
def q_best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first epoch with the best score: the least by (-score, epoch), which tasks can find before the shuffle."""
    scores = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("epoch")).agg(F.round(F.avg("value"), 3).alias("score"))
    best = scores.groupBy("user_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "epoch", "score")).alias("b"))
    return best.select("user_id", "b.epoch", "b.score")


@query("""WITH RECURSIVE e AS (SELECT 2 * o_custkey AS a, 2 * o_orderkey + 1 AS b FROM orders), w AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
 r(node, other) AS (SELECT x, x FROM w UNION SELECT r.node, y FROM r JOIN w ON other = x), c AS (SELECT node, min(other) AS component FROM r GROUP BY node), s AS (SELECT component, count(*) AS area FROM c GROUP BY component)
SELECT count(*) AS components, max(area) AS largest, round(max(area) / sum(area), 6) AS share FROM s""")
def q_component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their orders as nodes: even and odd numbers."""
    orders = read(spark, sf_dir, "orders")
    found = connected_components(orders.select((2 * F.col("o_custkey")).alias("a"), (2 * F.col("o_orderkey") + 1).alias("b")))
    areas = found.groupBy("component").agg(F.count("*").alias("area"))
    return areas.agg(F.count("*").alias("components"), F.max("area").alias("largest"), F.round(F.max("area") / F.sum("area"), 6).alias("share"))


DECAY = 0.999


@query(f"""WITH s AS (SELECT label, embedding AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT label, CAST(i AS INTEGER) AS i, round(sum(CAST(v[i + 1] AS DOUBLE) * pow({DECAY}, n - k) * CASE WHEN k = 1 THEN 1 ELSE 1 - {DECAY} END), 6) AS average FROM s CROSS JOIN range(64) r(i) GROUP BY label, i""")
def q_parameter_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A moving average over updates of whole vectors, as a sum: the weight of an update follows from how many come after it."""
    placed = ranking.ranked(read(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), ["label"], ["vec_id"])
    weight = F.pow(F.lit(DECAY), F.col("n") - F.col("rank") - 1) * F.when(F.col("rank") == 0, 1.0).otherwise(1 - DECAY)
    steps = placed.select("label", weight.alias("weight"), F.posexplode("embedding").alias("i", "x"))
    return steps.groupBy("label", "i").agg(F.round(F.sum(F.col("x").cast("double") * F.col("weight")), 6).alias("average"))


_EPOCH = "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))"


@query(f"SELECT event_id, round(CASE WHEN e < 5 THEN (e + 1) / 5.0 ELSE 0.01 + 0.99 * 0.5 * (1 + cos({math.pi} * (e - 5) / 55.0)) END, 8) AS factor FROM (SELECT event_id, {_EPOCH} AS e FROM events)")
def q_rate_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learning rate's factor on each event's day, days being epochs."""
    epoch = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return read(spark, sf_dir, "events").select("event_id", F.round(masks.warmup_cosine(epoch, 5, 60, 0.01), 8).alias("factor"))


@query("""WITH p AS (SELECT l_returnflag AS g, l_linenumber % 3 = 0 AS mask, l_quantity > 20 AS leaf, l_linenumber = 1 AS edge FROM lineitem)
SELECT g, round(avg(CAST(mask AS INTEGER)), 6) AS area, round(avg(CAST(mask AND edge AS INTEGER)), 6) AS border, round(CASE WHEN count(*) FILTER (leaf) > 0 THEN count(*) FILTER (leaf AND NOT mask) / count(*) FILTER (leaf) ELSE 1.0 END, 6) AS leak FROM p GROUP BY g""")
def q_mask_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_linenumber") % 3 == 0).alias("mask"), (F.col("l_quantity") > 20).alias("leaf"), (F.col("l_linenumber") == 1).alias("edge"))
    share = lambda x: F.round(F.avg(x.cast("int")), 6)
    leak = F.when(F.count_if("leaf") > 0, F.count_if(F.col("leaf") & ~F.col("mask")) / F.count_if("leaf")).otherwise(1.0)
    return p.groupBy("g").agg(share(F.col("mask")).alias("area"), share(F.col("mask") & F.col("edge")).alias("border"), F.round(leak, 6).alias("leak"))


@query("""WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) * 100 FOR x IN embedding] AS v FROM embeddings)
SELECT vec_id, round(sqrt(pow(0.5 * (v[1] - v[4]), 2) + pow(1.5 * (v[2] - v[5]), 2) + pow(1.5 * (v[3] - v[6]), 2)), 5) AS distance, round(sqrt(v[2] * v[2] + v[3] * v[3]), 5) AS chroma, round((v[1] / 255.0 - 0.485) / 0.229, 6) AS normal FROM v""")
def q_colour_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = [F.col("embedding")[k].cast("double") * 100 for k in range(6)]
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(masks.lab_distance(v[:3], v[3:]), 5).alias("distance"), F.round(masks.chroma(v[1], v[2]), 5).alias("chroma"), F.round(masks.normalised(v[0], 0.485, 0.229), 6).alias("normal"))


@query("""WITH v AS (SELECT vec_id, [abs(CAST(x AS DOUBLE)) * 500 FOR x IN embedding] AS p, [CASE WHEN vec_id % 3 = 0 THEN 0 WHEN i % 4 = 0 THEN 255 ELSE vec_id % 256 END FOR i IN range(0, 64)] AS m FROM embeddings),
 b AS (SELECT vec_id, p, m, list_sum(m) / 64.0 AS level FROM v)
SELECT vec_id, round(list_sum(CASE WHEN level BETWEEN 2 AND 253 THEN [greatest(0, least(255, p[i] * m[i] / 255.0 + 128 * (1 - m[i] / 255.0))) FOR i IN range(1, 65)] ELSE p END), 4) AS total FROM b""")
def q_mask_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double")) * 500).alias("p"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.col("vec_id") % 3 == 0, 0).when(i % 4 == 0, 255).otherwise(F.col("vec_id") % 256).cast("double"))
    return rows.select("vec_id", F.round(F.aggregate(masks.blended(F.col("p"), mask, 128.0), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""WITH v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v, (vec_id % 10) / 10.0 AS s FROM embeddings), j AS (SELECT a.vec_id, a.s, a.v AS x, b.v AS y, a.label AS la, b.label AS lb FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_sum([s * x[i] + (1 - s) * y[i] FOR i IN range(1, 65)]), 5) AS mixed, round(list_sum([CASE WHEN i > 16 AND i <= 48 THEN y[i] ELSE x[i] END FOR i IN range(1, 65)]), 5) AS cut,
 round(list_sum([s * CASE WHEN c = la THEN 1 ELSE 0 END + (1 - s) * CASE WHEN c = lb THEN 1 ELSE 0 END FOR c IN range(0, 10)]), 6) AS target FROM j""")
def q_mixed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and targets mixed with the next row's; targets still sum to one."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", vec.doubles(F.col("embedding")).alias("v"))
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"), F.col("label").alias("other")), "vec_id").withColumn("s", (F.col("vec_id") % 10) / 10.0)
    one_hot = lambda c: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col(c), 1.0).otherwise(0.0))
    total = lambda x, d: F.round(F.aggregate(x, F.lit(0.0), lambda a, y: a + y), d)
    return pairs.select(
        "vec_id", total(masks.mixed_up(F.col("v"), F.col("w"), F.col("s")), 5).alias("mixed"), total(masks.cut_mixed(F.col("v"), F.col("w"), F.lit(16), F.lit(48)), 5).alias("cut"),
        total(masks.mixed_up(one_hot("label"), one_hot("other"), F.col("s")), 6).alias("target"),
    )


@query("""WITH h AS (SELECT lang, n_chars % 256 AS level, CAST(count(*) AS DOUBLE) AS n FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL GROUP BY ALL),
 c AS (SELECT lang, level, sum(n) OVER w AS n0, sum(n * level) OVER w AS s0, sum(n) OVER (PARTITION BY lang) AS n, sum(n * level) OVER (PARTITION BY lang) AS s FROM h WINDOW w AS (PARTITION BY lang ORDER BY level)),
 b AS (SELECT lang, level, CASE WHEN n > n0 THEN round(n0 * (n - n0) * pow(s0 / n0 - (s - s0) / (n - n0), 2) / (n * n), 9) ELSE 0.0 END AS v FROM c)
SELECT lang, level AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY v DESC, level) AS r FROM b) WHERE r = 1""")
def q_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = read(spark, sf_dir, "documents").where("lang is not null and n_chars is not null").select("lang", (F.col("n_chars") % 256).alias("level"))
    return masks.otsu(levels, ["lang"]).select("lang", "threshold")


#: Ablations: which halves of a vector a mode keeps.
MODES = {"whole": (1, 64), "first": (1, 32), "last": (33, 64)}
_MODES = ", ".join(f"('{m}', {a}, {b})" for m, (a, b) in MODES.items())


@query(f"""WITH e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), hd AS (SELECT label AS c, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(v[i]) AS m FROM e CROSS JOIN range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
 md(mode, a, b) AS (VALUES {_MODES}), z AS (SELECT mode, vec_id, e.label, c, list_dot_product(v[a:b], m[a:b]) AS z FROM e CROSS JOIN hd CROSS JOIN md),
 p AS (SELECT mode, vec_id, label, c FROM (SELECT *, row_number() OVER (PARTITION BY mode, vec_id ORDER BY z DESC, c) AS r FROM z) WHERE r = 1)
SELECT mode, vec_id % 5 = 4 AS held_site, count(*) AS n, round(avg(CAST(c = label AS INTEGER)), 6) AS accuracy FROM p GROUP BY ALL""")
def q_ablation_and_cross_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy with parts of the input blanked out, on the sites that were held out and on the others."""
    items = read(spark, sf_dir, "embeddings").select("vec_id", "label", vec.doubles(F.col("embedding")).alias("v"))
    means = items.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    heads = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("m")).select("label", F.col("m.x").alias("m"))
    head = heads.agg(F.sort_array(F.collect_list(F.struct("label", "m"))).alias("h"))
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(a).alias("a"), F.lit(b - a + 1).alias("n")) for m, (a, b) in MODES.items()]))
    rows = items.join(F.broadcast(head), F.lit(True)).select("vec_id", "label", "v", "h", modes.alias("k"))
    part = lambda x: F.slice(x, F.col("k.a"), F.col("k.n"))
    best = F.array_max(F.transform("h", lambda c: F.struct(vec.dot(part(F.col("v")), part(c["m"])).alias("z"), (-c["label"]).alias("c"))))
    guessed = rows.select(F.col("k.mode").alias("mode"), (F.col("vec_id") % 5 == 4).alias("held_site"), (-best["c"] == F.col("label")).cast("int").alias("ok"))
    return guessed.groupBy("mode", "held_site").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("accuracy"))


#: Weights of two hidden units over eight channels, and of the score.
_HIDDEN = [[(3 * h + c) % 5 - 2 for c in range(8)] for h in range(2)]


@query(f"""WITH m AS (SELECT vec_id, c, q, CAST(embedding[8 * c + q + 1] AS DOUBLE) AS x FROM embeddings CROSS JOIN range(8) r(c) CROSS JOIN range(8) s(q)),
 u AS (SELECT vec_id, q, greatest(sum(x * list_extract({_HIDDEN[0]}, c + 1)) + CAST(0.1 AS DOUBLE), 0) AS u0, greatest(sum(x * list_extract({_HIDDEN[1]}, c + 1)) - CAST(0.1 AS DOUBLE), 0) AS u1 FROM m GROUP BY ALL),
 a AS (SELECT vec_id, q, exp(2 * u0 - u1) AS e FROM u), w AS (SELECT vec_id, q, e / sum(e) OVER (PARTITION BY vec_id) AS w FROM a),
 p AS (SELECT vec_id, c, sum(x * w) AS att, pow(avg(pow(greatest(x, 1e-6), 3)), 1 / CAST(3 AS DOUBLE)) AS gem, max(x) AS top FROM m JOIN w USING (vec_id, q) GROUP BY ALL)
SELECT vec_id, round(sum((c + 1) * att), 5) AS attention, round(sum((c + 1) * gem + (c + 9) * top), 5) AS concat FROM p GROUP BY vec_id""")
def q_attention_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as eight channels of eight positions, pooled by attention, and by means and maxima: the sums of all values, each times its number."""
    maps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.slice("v", c * 8 + 1, F.lit(8)))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", vec.doubles(F.col("embedding")).alias("v")).select("vec_id", maps.alias("m"))
    lit = lambda a: F.array(*[F.lit(float(x)) for x in a])
    attention, _ = pooling.pooling("attention", 8, (F.array(*map(lit, _HIDDEN)), lit((0.1, -0.1)), lit((2, -1)), F.lit(0.0)))
    concat, _ = pooling.pooling("concat", 8)
    weighed = lambda x: F.round(vec.total(F.transform(x, lambda v, i: v * (i + 1))), 5)
    return rows.select("vec_id", weighed(attention(F.col("m"))).alias("attention"), weighed(concat(F.col("m"))).alias("concat"))


@query(f"""WITH {_SCORED.replace('cm AS (SELECT label AS truth, pred AS guess, count(*) AS n FROM sc GROUP BY ALL)', 'cm AS (SELECT vec_id % 5 = 4 AS held, label AS truth, pred AS guess, count(*) AS n FROM sc GROUP BY ALL)').split(' cl AS (')[0].rstrip().rstrip(',')},
 cl AS (SELECT c.held, cls, coalesce(sum(n) FILTER (truth = cls AND guess = cls), 0) AS tp, coalesce(sum(n) FILTER (guess = cls AND truth <> cls), 0) AS fp, coalesce(sum(n) FILTER (truth = cls AND guess <> cls), 0) AS fn
   FROM cm JOIN (SELECT held, truth AS cls FROM cm UNION SELECT held, guess FROM cm) c ON c.held = cm.held GROUP BY ALL)
SELECT held, CAST(sum(tp + fn) AS BIGINT) AS n, round(sum(tp) / sum(tp + fn), 6) AS accuracy, round(avg(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS macro_f1, round(avg(tp / (tp + fn)) FILTER (tp + fn > 0), 6) AS balanced_accuracy FROM cl GROUP BY held""")
def q_cross_site_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, macro F1 and balanced accuracy on the sites that were held out and on the others."""
    rows = scored(spark, sf_dir).withColumn("held", F.col("vec_id") % 5 == 4)
    found = metrics.scores_by(rows, "held", "label", "pred")
    return found.select("held", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "balanced_accuracy")])


@query(f"""WITH {_FILES}, s AS (SELECT cls, site, id, id % 7 AS grp, CASE WHEN id % 3 = 0 THEN 'train' WHEN id % 3 = 1 THEN 'val' ELSE 'test' END AS split FROM k WHERE cls <> 'fr' OR id % 3 = 0)
SELECT 'grp in several splits' AS problem, CAST(grp AS VARCHAR) AS item FROM s GROUP BY grp HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'label missing in ' || x, c.cls FROM (SELECT DISTINCT cls FROM s) c CROSS JOIN (VALUES ('train'), ('val'), ('test')) t(x) LEFT JOIN (SELECT DISTINCT cls AS l, split AS p FROM s) h ON h.l = c.cls AND h.p = x WHERE h.l IS NULL
UNION ALL SELECT DISTINCT 'held site in train or val', cls || '/' || site FROM s WHERE split IN ('train', 'val') AND site IN ('src0', 'src1')""")
def q_verify_broken_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a split that parts groups, lacks a class and uses held-out sites."""
    items = kept(spark, sf_dir).drop("text").where("cls <> 'fr' or id % 3 = 0").withColumn("grp", F.col("id") % 7)
    broken = durable(items.withColumn("split", F.element_at(F.array(*map(F.lit, splits.SPLITS)), (F.col("id") % 3 + 1).cast("int"))))
    held = broken.where(F.col("site").isin("src0", "src1")).select("cls", "site").distinct()
    return splits.verify_splits(broken, "cls", "site", ["grp"], held).select("problem", "item")


@query("""WITH m AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END AS sram, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE (s_suppkey % 10) / 10.0 END AS npu FROM supplier)
SELECT s_suppkey, coalesce(sram <= 2048, false) AND coalesce(npu >= 0.9, false) AS passed, concat_ws(',', CASE WHEN sram IS NULL THEN 'sram' END, CASE WHEN npu IS NULL THEN 'npu' END) AS unmeasured FROM m""")
def q_gate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates over measured values, some of which are missing."""
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("sram"), F.when(F.col("s_suppkey") % 5 != 0, (F.col("s_suppkey") % 10) / 10.0).alias("npu"))
    checks = {"sram": F.col("sram") <= 2048, "npu": F.col("npu") >= 0.9}
    return rows.select("s_suppkey", predict.passes(*checks.values()).alias("passed"), F.array_join(predict.unmeasured(checks), ",").alias("unmeasured"))


@query(f"""WITH {_FILES}, c AS (SELECT cls, count(*) AS n_files, count(*) FILTER (copy_no = 1) AS n_kept, count(DISTINCT site) AS n_sites, min(length(text)) AS shortest, max(length(text)) AS longest FROM f GROUP BY cls)
SELECT cls, n_files, n_kept, n_sites, shortest, longest, round(n_kept / sum(n_kept) OVER (), 6) AS share FROM c""")
def q_dataset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of a dataset report: files, kept files, sites, lengths and share of each class."""
    marked = files(spark, sf_dir)
    counts = marked.groupBy("cls").agg(F.count("*").alias("n_files"), F.count_if(F.col("copy_no") == 1).alias("n_kept"), F.countDistinct("site").alias("n_sites"), F.min("length").alias("shortest"), F.max("length").alias("longest"))
    whole = counts.agg(F.sum("n_kept").alias("all"))
    return counts.join(F.broadcast(whole), F.lit(True)).select("cls", "n_files", "n_kept", "n_sites", "shortest", "longest", F.round(F.col("n_kept") / F.col("all"), 6).alias("share"))

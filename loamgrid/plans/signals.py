"""Vector, tensor and signal functions on the embeddings, and ordered logic on the events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.functions import signal, tensor, vec
from loamgrid.plans.registry import query, read
from loamgrid.session import checkpoint_dir
from loamgrid.streaming import batch, sinks, variables


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, a, b): each embedding and the same one in reverse."""
    items = read(spark, sf_dir, "embeddings").select("vec_id", vec.doubles(F.col("embedding")).alias("a"))
    return items.select("vec_id", "a", F.reverse("a").alias("b"))


_V = "v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS a, list_reverse([CAST(x AS DOUBLE) FOR x IN embedding]) AS b FROM embeddings), x AS (SELECT vec_id, i, a[i] AS a, b[i] AS b FROM v CROSS JOIN range(1, 65) r(i))"


def rounded(**columns) -> list:
    return [F.round(c, 5).alias(n) for n, c in columns.items()]


@query(f"""WITH {_V} SELECT vec_id, round(sqrt(sum((a - b) * (a - b))), 5) AS euclidean, round(sum(abs(a - b)), 5) AS cityblock, round(max(abs(a - b)), 5) AS chebyshev,
 round(sum(CASE WHEN a = 0 AND b = 0 THEN 0 ELSE abs(a - b) / (abs(a) + abs(b)) END), 5) AS canberra, round(sum(abs(a - b)) / sum(abs(a + b)), 5) AS braycurtis, round(1 - sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 5) AS cosine,
 round(pow(sum(pow(abs(a - b), 3)), 1.0 / 3), 5) AS minkowski3, round(1 - corr(a, b), 5) AS correlation FROM x GROUP BY vec_id""")
def q_vec_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return vectors(spark, sf_dir).select("vec_id", *rounded(euclidean=vec.euclidean(a, b), cityblock=vec.cityblock(a, b), chebyshev=vec.chebyshev(a, b), canberra=vec.canberra(a, b), braycurtis=vec.braycurtis(a, b), cosine=vec.cosine(a, b), minkowski3=vec.minkowski(a, b, 3.0), correlation=vec.correlation_distance(a, b)))


@query(f"""WITH {_V}, s AS (SELECT vec_id, i, abs(a) / sum(abs(a)) OVER (PARTITION BY vec_id) AS p, abs(b) / sum(abs(b)) OVER (PARTITION BY vec_id) AS q FROM x)
SELECT vec_id, round(sqrt((sum(p * ln(2 * p / (p + q))) + sum(q * ln(2 * q / (p + q)))) / 2), 5) AS jensen_shannon, round(sum(p * ln(p / q)), 5) AS kl, round(-sum(p * ln(p)), 5) AS entropy FROM s GROUP BY vec_id""")
def q_vec_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: vec.bound(F.transform(F.col(c), lambda x: F.abs(x)), lambda m: vec.bound(vec.total(m), lambda t: F.transform(m, lambda x: x / t)))
    p, q = F.col("p"), F.col("q")
    given = vectors(spark, sf_dir).select("vec_id", share("a").alias("p"), share("b").alias("q"))
    return given.select("vec_id", *rounded(jensen_shannon=vec.jensen_shannon(p, q), kl=vec.kullback_leibler(p, q), entropy=vec.entropy(p)))


@query(f"""WITH {_V}, c AS (SELECT vec_id, CAST(count(*) FILTER (a > 0 AND b > 0) AS DOUBLE) AS tt, CAST(count(*) FILTER (a > 0 AND NOT b > 0) AS DOUBLE) AS tf, CAST(count(*) FILTER (NOT a > 0 AND b > 0) AS DOUBLE) AS ft, CAST(count(*) FILTER (NOT a > 0 AND NOT b > 0) AS DOUBLE) AS ff FROM x GROUP BY vec_id)
SELECT vec_id, round((tf + ft) / (2 * tt + tf + ft), 5) AS dice, round((tf + ft) / 64, 5) AS hamming, round((tf + ft) / (tt + tf + ft), 5) AS jaccard, round((tf + ft - tt + 64) / (tf + ft + 64), 5) AS kulsinski,
 round(2 * (tf + ft) / (2 * (tf + ft) + tt + ff), 5) AS rogerstanimoto, round((64 - tt) / 64, 5) AS russellrao, round(2 * (tf + ft) / (tt + ff + 2 * (tf + ft)), 5) AS sokalmichener, round(2 * (tf + ft) / (2 * (tf + ft) + tt), 5) AS sokalsneath, round(2 * tf * ft / (tf * ft + tt * ff), 5) AS yule FROM c""")
def q_bool_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda c: F.transform(c, lambda x: x > 0)
    counts = vectors(spark, sf_dir).select("vec_id", *[c.alias(n) for n, c in vec.contingency(flag("a"), flag("b")).items()])
    return counts.select("vec_id", *rounded(**vec.boolean_distances(*[F.col(c) for c in ("tt", "tf", "ft", "ff")])))


@query(f"""WITH {_V} SELECT vec_id, round(avg(a), 5) AS mean, round(var_samp(a), 5) AS var, round(stddev_samp(a), 5) AS std, round(sqrt(avg(a * a)), 5) AS rms, round(sum(a * a), 5) AS power, round(max(a), 5) AS hi, round(min(a), 5) AS lo,
 CAST(arg_max(i, (a, -i)) - 1 AS INTEGER) AS at_hi, round(max(abs(a)), 5) AS absmax, round(avg((a - b) * (a - b)), 5) AS mse, round(ln(sum(exp(a))), 5) AS logsumexp FROM x GROUP BY vec_id""")
def q_vec_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    found = rounded(mean=vec.mean(a), var=vec.var_samp(a), std=vec.std_samp(a), rms=vec.rms(a), power=vec.power(a), hi=F.array_max(a), lo=F.array_min(a), absmax=F.array_max(F.transform(a, lambda x: F.abs(x))), mse=vec.mean(tensor.BINARY["SQUARED_DIFFERENCE"](a, b)), logsumexp=vec.logsumexp(a))
    return vectors(spark, sf_dir).select("vec_id", vec.argmax(a).alias("at_hi"), *found)


@query(f"WITH {_V} SELECT vec_id, round(sum(abs(a)), 5) AS \"ABS\", round(sum(cos(a)), 5) AS \"COS\", round(sum(CASE WHEN a < 0 THEN exp(a) - 1 ELSE a END), 5) AS \"ELU\", round(sum(exp(a)), 5) AS \"EXP\", round(sum(floor(a)), 5) AS \"FLOOR\", round(sum(ceil(a)), 5) AS \"CEIL\", round(sum(a * least(greatest(a + 3, 0), 6) / 6), 5) AS \"HARD_SWISH\", round(sum(CASE WHEN a > 0 THEN a ELSE 0.01 * a END), 5) AS \"LEAKY_RELU\", round(sum(1 / (1 + exp(-a))), 5) AS \"LOGISTIC\", round(sum(greatest(a, 0)), 5) AS \"RELU\", round(sum(least(greatest(a, 0), 6)), 5) AS \"RELU6\", round(sum(sin(a)), 5) AS \"SIN\", round(sum(a * a), 5) AS \"SQUARE\", round(sum(tanh(a)), 5) AS \"TANH\" FROM x GROUP BY vec_id")
def q_tensor_elementwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("ABS", "COS", "ELU", "EXP", "FLOOR", "CEIL", "HARD_SWISH", "LEAKY_RELU", "LOGISTIC", "RELU", "RELU6", "SIN", "SQUARE", "TANH")
    return vectors(spark, sf_dir).select("vec_id", *[F.round(vec.total(tensor.UNARY[n](F.col("a"))), 5).alias(n) for n in names])


@query(f"WITH {_V} SELECT vec_id, round(sum(a + b), 5) AS \"ADD\", round(sum(a * b), 5) AS \"MUL\", round(sum(a - b), 5) AS \"SUB\", round(sum(greatest(a, b)), 5) AS \"MAXIMUM\", round(sum(least(a, b)), 5) AS \"MINIMUM\", count(*) FILTER (a > b) AS \"GREATER\", count(*) FILTER (a <= b) AS \"LESS_EQUAL\" FROM x GROUP BY vec_id")
def q_tensor_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    sums = [F.round(vec.total(tensor.BINARY[n](a, b)), 5).alias(n) for n in ("ADD", "MUL", "SUB", "MAXIMUM", "MINIMUM")]
    counts = [F.size(F.filter(tensor.BINARY[n](a, b), lambda x: x)).cast("long").alias(n) for n in ("GREATER", "LESS_EQUAL")]
    return vectors(spark, sf_dir).select("vec_id", *sums, *counts)


TAPS = [0.5, 0.25, 0.125, -0.125]


@query(f"WITH {_V}, f AS (SELECT vec_id, i, a * 0.5 + coalesce(lag(a, 1) OVER w, 0) * 0.25 + coalesce(lag(a, 2) OVER w, 0) * 0.125 - coalesce(lag(a, 3) OVER w, 0) * 0.125 AS y FROM x WINDOW w AS (PARTITION BY vec_id ORDER BY i)) SELECT vec_id, round(sum(y * i), 5) AS weighted, round(max(y), 5) AS top FROM f GROUP BY vec_id")
def q_fir(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors(spark, sf_dir).select("vec_id", signal.fir(F.col("a"), TAPS).alias("y"))
    return out.select("vec_id", F.round(vec.total(F.transform("y", lambda y, i: y * (i + 1))), 5).alias("weighted"), F.round(F.array_max("y"), 5).alias("top"))


@query(f"WITH {_V}, l AS (SELECT vec_id, a * lead(a, 3) OVER (PARTITION BY vec_id ORDER BY i) AS p, a * a AS s FROM x) SELECT vec_id, round(sum(p), 5) AS lag3, round(sum(s), 5) AS lag0 FROM l GROUP BY vec_id")
def q_autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors(spark, sf_dir).select("vec_id", signal.correlate(F.col("a"), F.col("a")).alias("r"))
    return out.select("vec_id", F.round(F.col("r")[66], 5).alias("lag3"), F.round(F.col("r")[63], 5).alias("lag0"))


@query(f"""WITH {_V}, w AS (SELECT vec_id, a * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 64)) AS hanning, a * (0.54 - 0.46 * cos(2 * pi() * (i - 1) / 64)) AS hamming, a * (1 - pow((i - 1) / 32.0 - 1, 2)) AS welch FROM x)
SELECT vec_id, round(sum(hanning * hanning), 5) AS hanning, round(sum(hamming * hamming), 5) AS hamming, round(sum(welch * welch), 5) AS welch FROM w GROUP BY vec_id""")
def q_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each window leaves of a vector's power."""
    power = lambda n: vec.total(F.zip_with("a", signal.window(n, 64), lambda x, w: (x * w) * (x * w)))
    return vectors(spark, sf_dir).select("vec_id", *[F.round(power(n), 5).alias(n) for n in ("hanning", "hamming", "welch")])


@query(f"WITH {_V}, c AS (SELECT vec_id, i, sum(a) OVER (PARTITION BY vec_id ORDER BY i) AS s FROM x) SELECT vec_id, round(max(s), 5) AS top, round(arg_max(s, i), 5) AS total FROM c GROUP BY vec_id")
def q_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors(spark, sf_dir).select("vec_id", tensor.cumsum(F.col("a")).alias("s"))
    return out.select("vec_id", F.round(F.array_max("s"), 5).alias("top"), F.round(F.element_at("s", -1), 5).alias("total"))


@query(f"WITH {_V}, m AS (SELECT vec_id, (i - 1) // 16 AS p, (i - 1) % 8 // 2 AS q, avg(a) AS m, max(a) AS t FROM x GROUP BY ALL) SELECT vec_id, round(sum(m * (p * 4 + q + 1)), 5) AS pooled, round(sum(t), 5) AS tops FROM m GROUP BY vec_id")
def q_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors(spark, sf_dir).select("vec_id", tensor.reshape(F.col("a"), 8).alias("rows"))
    flat = out.select("vec_id", F.flatten(tensor.average_pool(F.col("rows"), 2)).alias("m"), F.flatten(tensor.max_pool(F.col("rows"), 2)).alias("t"))
    return flat.select("vec_id", F.round(vec.total(F.transform("m", lambda x, i: x * (i + 1))), 5).alias("pooled"), F.round(vec.total(F.col("t")), 5).alias("tops"))


@query(f"""WITH RECURSIVE {_V}, k AS (SELECT CAST(k AS INTEGER) AS k FROM range(0, 64) r(k)),
 ft AS (SELECT vec_id, k, sum(a * cos(2 * pi() * k * (i - 1) / 64)) AS re, -sum(a * sin(2 * pi() * k * (i - 1) / 64)) AS im FROM x CROSS JOIN k WHERE k <= 32 GROUP BY ALL),
 dc AS (SELECT vec_id, k, sqrt(2.0 / 64) * sum(a * cos(pi() / 64 * (k + 0.5) * (i - 0.5))) AS c FROM x CROSS JOIN k GROUP BY ALL),
 bq(vec_id, i, x1, x2, y1, y2, total) AS (SELECT vec_id, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM v
   UNION ALL SELECT vec_id, i, a, x1, y, y1, total + i * y FROM (SELECT bq.vec_id, x.i, x.a, x1, y1, total, CAST(0.2 AS DOUBLE) * x.a + CAST(0.4 AS DOUBLE) * x1 + CAST(0.2 AS DOUBLE) * x2 + CAST(0.3 AS DOUBLE) * y1 - CAST(0.1 AS DOUBLE) * y2 AS y FROM bq JOIN x ON x.vec_id = bq.vec_id AND x.i = bq.i + 1))
SELECT vec_id, (SELECT round(sum((2 * k + 1) * re + (2 * k + 2) * im), 4) FROM ft WHERE ft.vec_id = bq.vec_id) AS rfft, (SELECT round(sum((k + 1) * c), 4) FROM dc WHERE dc.vec_id = bq.vec_id) AS dct4, round(total, 4) AS biquad FROM bq WHERE i = 64""")
def q_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real FFT, DCT-IV and a biquad section of each embedding, in Arrow batches: the sums of all values, each times its number."""
    a = F.col("a")
    section = signal.biquad_cascade([(0.2, 0.4, 0.2, 0.3, -0.1)])
    weighed = lambda x: F.round(vec.total(F.transform(x, lambda v, i: v * (i + 1))), 4)
    found = vectors(spark, sf_dir).select("vec_id", signal.RFFT(a).alias("rfft"), signal.DCT4(a).alias("dct4"), section(a).alias("biquad"))
    return found.select("vec_id", *[weighed(F.col(c)).alias(c) for c in ("rfft", "dct4", "biquad")])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
 f(user_id, r, ema) AS (SELECT user_id, r, value FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.r, 0.9 * ema + 0.1 * value FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1)
SELECT user_id, round(arg_max(ema, r), 6) AS ema FROM f GROUP BY user_id""")
def q_ema_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.ema(events(spark, sf_dir), "user_id", ["ts", "event_id"], "value", 0.9).select("user_id", F.round("ema", 6).alias("ema"))


@query("SELECT event_id, CAST(greatest(coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 0), 100) AS BIGINT) AS dt_us FROM events")
def q_frame_dt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.frame_gaps(events(spark, sf_dir), "user_id", "ts", "event_id", 1e-4).select("event_id", F.round(F.col("dt") * 1e6).cast("long").alias("dt_us"))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
SELECT event_id, len(list(value) OVER w) AS n, round(avg(value) OVER w, 6) AS mean FROM o WINDOW w AS (PARTITION BY user_id ORDER BY r ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) QUALIFY r % 4 = 0""")
def q_circular_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = batch.sliding_frames(events(spark, sf_dir), "user_id", ["ts", "event_id"], "value", size=8, every=4)
    return frames.select("event_id", F.size("frame").cast("long").alias("n"), F.round(vec.mean(F.col("frame")), 6).alias("mean"))


@query("""WITH RECURSIVE o AS (SELECT user_id AS key, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
 f(key, r, free, waiting, served, dropped) AS (SELECT DISTINCT key, CAST(0 AS BIGINT), CAST('-infinity' AS DOUBLE), false, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM o
   UNION ALL SELECT key, r, CASE WHEN t >= free AND NOT waiting THEN t + 3600.0 ELSE free END, NOT (t >= free AND NOT waiting), served + CASE WHEN waiting THEN 0 ELSE 1 END, dropped + CASE WHEN waiting THEN 1 ELSE 0 END FROM (
     SELECT f.key, o.r, o.t, CASE WHEN waiting AND t >= free THEN free + 3600.0 ELSE free END AS free, waiting AND t < free AS waiting, served, dropped FROM f JOIN o ON o.key = f.key AND o.r = f.r + 1))
SELECT key, arg_max(served, r) AS served, arg_max(dropped, r) AS dropped FROM f GROUP BY key""")
def q_coalesced_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.coalesced(events(spark, sf_dir), "user_id", "ts", "event_id", service_seconds=3600.0)


@query("SELECT event_id, (40 + 5 * (event_id + 1)) % 100 AS moisture FROM events")
def q_simulated_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sensor's reading at each event."""
    return events(spark, sf_dir).select("event_id", batch.sensor_value(F.col("event_id")).alias("moisture"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events) SELECT user_id, CAST(sum(fresh) AS BIGINT) AS sessions FROM g GROUP BY user_id")
def q_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "30 minutes")).count()
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY start")
def q_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def q_orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def q_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT a.event_id, max_by(b.value, (b.ts, b.event_id)) AS last_purchase FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts <= a.ts WHERE a.event_type = 'click' GROUP BY a.event_id")
def q_asof_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join by one ordered pass per user, not by comparing all pairs."""
    both = events(spark, sf_dir).where("event_type in ('click', 'purchase')")
    so_far = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.max(F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id", "value"))).over(so_far)
    return both.withColumn("seen", seen).where("event_type = 'click'").select("event_id", F.col("seen.value").alias("last_purchase"))


#: Half a day without an event ends what a user's variables hold.
IDLE = 43_200
_ACT = "CASE WHEN event_id % 40 = 0 THEN 'reset' WHEN event_id % 4 = 0 THEN 'assign' WHEN event_id % 4 = 1 THEN 'add' ELSE 'read' END"


@query(f"""WITH e AS (SELECT user_id AS key, ts AS tm, event_id AS seq, {_ACT} AS act, event_type AS name, round(value, 3) AS v, epoch_us(ts) AS us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
 g AS (SELECT *, lag(us) OVER o AS before, coalesce(us - lag(us) OVER o > CAST({IDLE} AS BIGINT) * 1000000, false) AS gap FROM e WINDOW o AS (PARTITION BY key ORDER BY tm, seq)),
 l AS (SELECT *, sum(CAST(gap OR act = 'reset' AS INTEGER)) OVER (PARTITION BY key ORDER BY tm, seq) AS life FROM g),
 r AS (SELECT *, sum(CAST(act = 'assign' AS INTEGER)) OVER (PARTITION BY key, life, name ORDER BY tm, seq) AS run FROM l),
 n AS (SELECT *, sum(CASE WHEN act IN ('assign', 'add') THEN v END) OVER (PARTITION BY key, life, name, run ORDER BY tm, seq) AS now FROM r)
SELECT key, seq, act, name, round(now, 3) AS value, us FROM n WHERE act = 'read' UNION ALL SELECT key, -1, 'expired', NULL, NULL, before + CAST({IDLE} AS BIGINT) * 1000000 FROM g WHERE gap""")
def q_state_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each reading event finds in its user's variables, and when these expired."""
    act = F.when(F.col("event_id") % 40 == 0, "reset").when(F.col("event_id") % 4 == 0, "assign").when(F.col("event_id") % 4 == 1, "add").otherwise("read")
    events = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", act.alias("act"), "event_type", F.round("value", 3).alias("value"))
    found = variables.batch_variables(events, IDLE, "user_id", "ts", "event_id", "act", "event_type", "value")
    return found.select("key", "seq", "act", "name", F.round("value", 3).alias("value"), F.unix_micros(F.col("at").cast("timestamp")).alias("us"))


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def q_stream_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, read as a stream into a sink that takes each micro-batch once."""
    schema = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value").schema
    folder = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    # The pattern takes the table as a file and as a folder of files.
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{sf_dir}/events.parque[t]")
    done = sinks.start(events, sinks.keep_newest(f"{folder}/rows", ["user_id"], ["ts", "event_id"]), f"{folder}/state")
    done.awaitTermination()
    found = sinks.current(spark, f"{folder}/rows", schema, ["user_id"], ["ts", "event_id"])
    return found.select("user_id", "event_id", "event_type", "value")

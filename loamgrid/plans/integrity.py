"""Dataset integrity: duplicates, near-duplicates, groups, splits and profiles.

Documents stand for items: the language is the class, the source the site, the
md5 of the text the file digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.functions import text
from loamgrid.operators import calibration, dedupe, fingerprints, hamming, ranking, splits
from loamgrid.operators.components import connected_components
from loamgrid.plans.registry import query, read
from loamgrid.session import durable


#: Buckets of hashed word counts that stand for a picture's thumbnail.
DIMENSIONS = 64


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("cls"), F.col("source").alias("site"), "text", F.md5("text").alias("digest"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files without their texts, copies numbered."""
    docs = scanned(spark, sf_dir).withColumn("length", F.length("text").cast("long")).drop("text")
    return dedupe.mark_duplicates(docs, "digest", ["cls", "id"])


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.keep_first(scanned(spark, sf_dir), "digest", ["cls", "id"])


_FILES = "f AS (SELECT doc_id AS id, lang AS cls, source AS site, text, md5(text) AS digest, row_number() OVER (PARTITION BY md5(text) ORDER BY lang, doc_id) AS copy_no FROM documents), k AS (SELECT * FROM f WHERE copy_no = 1)"


@query(f"""WITH {_FILES}, s AS (SELECT cls, site, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY cls) AS share FROM k GROUP BY cls, site),
 t AS (SELECT cls, site, share, row_number() OVER (PARTITION BY cls ORDER BY n DESC, site) AS r, count(*) OVER (PARTITION BY cls) AS sites FROM s)
SELECT c.cls, c.n_files, c.n_kept, c.n_copies, t.sites, t.site AS top_site, round(t.share, 6) AS top_share
FROM (SELECT cls, count(*) AS n_files, count(*) FILTER (copy_no = 1) AS n_kept, count(*) FILTER (copy_no > 1) AS n_copies FROM f GROUP BY cls) c JOIN t ON t.cls = c.cls AND r = 1""")
def q_exact_dedup_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = files(spark, sf_dir)
    counts = marked.groupBy("cls").agg(F.count("*").alias("n_files"), F.count(F.when(F.col("copy_no") == 1, 1)).alias("n_kept"), F.count(F.when(F.col("copy_no") > 1, 1)).alias("n_copies"))
    top = dedupe.dominant(marked.where("copy_no = 1"), "cls", "site")
    return counts.join(top, "cls").select("cls", "n_files", "n_kept", "n_copies", F.col("distinct").alias("sites"), F.col("top").alias("top_site"), F.round("share", 6).alias("top_share"))


@query(f"WITH {_FILES} SELECT f.id, f.site, k.site AS kept_label, k.id AS kept_key FROM f JOIN k ON f.digest = k.digest WHERE f.copy_no > 1 AND f.site <> k.site")
def q_dup_label_conflict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.label_conflicts(files(spark, sf_dir), "digest", "site", "id").select("id", "site", "kept_label", "kept_key")


#: A file name for each document, in all forms of names and suffixes by turns.
_NAMES = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN hex || '-x___' || site || ' ' || doc_id || '.JPG' WHEN 1 THEN hex || '-x___' || site || ' Leaf ' || doc_id || '.' || (doc_id % 9) || '.JPG' WHEN 2 THEN hex || '-x___' || site || ' Leaf ' || doc_id || ' Day ' || (doc_id % 30) || '.jpeg'
 WHEN 3 THEN 'x___' || site || ' Leaf ' || (doc_id % 50) || '.' || (doc_id % 3) || ' Day ' || (doc_id % 20) || '.JPG' WHEN 4 THEN 'svn-r' || hex || '.JPG' ELSE 'v___' || site || ' Leaf ' || doc_id || ' day ' || (doc_id % 7) || '.JPG' END AS name
 FROM (SELECT doc_id, substr(md5(CAST(doc_id AS TEXT_TYPE)), 1, 8) AS hex, coalesce(source, 'x') AS site FROM documents)"""


@query(rf"""WITH n AS ({_NAMES.replace('TEXT_TYPE', 'VARCHAR')}), s AS (SELECT name, regexp_replace(name, '\.[^.]*$', '') AS stem FROM n),
 d AS (SELECT name, CASE WHEN contains(stem, '___') THEN trim(split_part(stem, '___', 1)) ELSE '' END AS uuid, trim(CASE WHEN contains(stem, '___') THEN substr(stem, instr(stem, '___') + 3) ELSE stem END) AS descriptor FROM s),
 e AS (SELECT *, coalesce(regexp_extract(descriptor, '(?i)\s+Day\s+(\d+)\s*$', 1), '') AS day, trim(regexp_replace(descriptor, '(?i)\s+Day\s+(\d+)\s*$', '')) AS dayless FROM d),
 c AS (SELECT *, coalesce(regexp_extract(dayless, '\.(\d+)$', 1), '') AS shot, trim(regexp_replace(dayless, '\.(\d+)$', '')) AS core FROM e)
SELECT name, uuid, split_part(core, ' ', 1) AS site, core AS leaf_core, shot, day FROM c""")
def q_parse_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.sql(_NAMES.replace("FROM documents", "FROM {documents}").replace("TEXT_TYPE", "STRING"), documents=read(spark, sf_dir, "documents"))
    return names.withColumn("p", text.parse_filename(F.col("name"))).select("name", "p.uuid", "p.site", "p.leaf_core", "p.shot", "p.day")


def simhashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(spark, sf_dir).drop("feature")


def fingerprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept files without their texts: their lengths, SimHashes and features. Texts are read once and not shuffled."""
    read_ = spread(scanned(spark, sf_dir)).withColumns({"length": F.length("text").cast("long"), "text": F.lower("text")})
    return dedupe.keep_first(durable(fingerprints.fingerprints(read_, "text", DIMENSIONS)), "digest", ["cls", "id"])


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, dealt to all cores if they are read from fewer files than that; rows of many files stay where they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


_SIM = f"""{_FILES}, tok AS (SELECT DISTINCT id, unnest(string_split(lower(text), ' ')) AS t FROM k),
 th AS (SELECT id, CAST('0x' || substr(md5(t), 1, 16) AS UBIGINT) AS h FROM tok),
 vote AS (SELECT id, b, 2 * sum(CAST((h >> b) & 1 AS BIGINT)) > count(*) AS one FROM th, range(0, 64) r(b) GROUP BY id, b),
 sim AS (SELECT id, CAST(sum(CASE WHEN one THEN CAST(1 AS UBIGINT) << b ELSE 0 END) AS UBIGINT) AS h FROM vote GROUP BY id)"""


@query(f"WITH {_SIM} SELECT id, lpad(lower(to_hex(h)), 16, '0') AS hex FROM sim")
def q_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhashes(spark, sf_dir).where("h is not null").select("id", text.hash_to_hex(F.col("h")).alias("hex"))


_PAIRS = f"{_SIM}, pairs AS (SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM sim a JOIN sim b ON a.id < b.id WHERE bit_count(xor(a.h, b.h)) <= %d)"


@query(f"WITH {_PAIRS % 4} SELECT a, b, distance FROM pairs")
def q_neardup_pairs_d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.near_pairs(simhashes(spark, sf_dir), 4)


@query(f"WITH {_PAIRS % 7} SELECT a, b, distance FROM pairs")
def q_neardup_pairs_d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.near_pairs(simhashes(spark, sf_dir), 7)


@query(f"""WITH {_SIM}, c AS (SELECT j, CAST((h >> (8 * j)) & 255 AS INTEGER) AS v, count(*) AS n FROM sim, range(0, 8) r(j) GROUP BY ALL)
SELECT count(*) AS n_buckets, max(n) AS largest, count(*) FILTER (n > 8) AS n_over, 4 > count(DISTINCT j) FILTER (n > 8) AS exhaustive FROM c""")
def q_neardup_bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.search_report(simhashes(spark, sf_dir).where("h is not null"), distance=4, cap=8)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(spark, sf_dir).where("feature is not null").select("id", "cls", "site", F.col("feature").cast("array<double>").alias("feature"))


_FEATURES = f"""tc AS (SELECT id, CAST(CAST('0x' || substr(md5(t), 1, 16) AS UBIGINT) & {DIMENSIONS - 1} AS INTEGER) AS d, count(*) AS n FROM (SELECT id, unnest(string_split(lower(text), ' ')) AS t FROM k) GROUP BY ALL),
 fv AS (SELECT k.id, r.d, coalesce(n, 0) AS x FROM k CROSS JOIN range(0, {DIMENSIONS}) r(d) LEFT JOIN tc ON tc.id = k.id AND tc.d = r.d)"""
_CORR = f"{_FEATURES}, scored AS (SELECT a, b, corr(x.x, y.x) AS r FROM pairs JOIN fv x ON x.id = a JOIN fv y ON y.id = b AND y.d = x.d GROUP BY a, b)"


@query(f"WITH {_PAIRS % 7}, {_CORR} SELECT a, b, round(r, 5) AS r FROM scored WHERE r >= 0.9")
def q_confirmed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_correlated(fingerprinted(spark, sf_dir), 7, 0.9).select("a", "b", F.round("r", 5).alias("r"))


THRESHOLDS = [0.80, 0.85, 0.90, 0.92, 0.95, 0.98]


@query(f"""WITH {_PAIRS % 7}, {_CORR}, t(threshold) AS (VALUES {", ".join(f"(CAST({x} AS DOUBLE))" for x in THRESHOLDS)})
SELECT threshold, count(*) FILTER (r >= threshold) AS kept, count(*) FILTER (r >= threshold AND x.site <> y.site) AS crossing
FROM scored JOIN k x ON x.id = a JOIN k y ON y.id = b CROSS JOIN t GROUP BY threshold""")
def q_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.near_correlated(fingerprinted(spark, sf_dir), 7, -1.0, ["site"]).withColumn("crosses", F.col("site_a") != F.col("site_b"))
    return hamming.threshold_sweep(pairs, THRESHOLDS, "r", "crosses")


@query(f"""WITH {_PAIRS % 7}, {_CORR}
SELECT count(*) AS n, round(quantile_cont(r, 0.05), 5) AS p05, round(median(r), 5) AS p50, round(quantile_cont(r, 0.95), 5) AS p95, round(min(r), 5) AS lo, round(max(r), 5) AS hi FROM scored""")
def q_dup_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = durable(fingerprints.near_correlated(fingerprinted(spark, sf_dir), 7, -1.0).select("r"))
    marks = {0.05: "p05", 0.5: "p50", 0.95: "p95"}
    at = ranking.quantiles(pairs, "r", list(marks)).groupBy().agg(*(F.round(F.max(F.when(F.col("fraction") == f, F.col("quantile"))), 5).alias(name) for f, name in marks.items()))
    ends = pairs.agg(F.count("*").alias("n"), F.round(F.min("r"), 5).alias("lo"), F.round(F.max("r"), 5).alias("hi"))
    return ends.join(F.broadcast(at), F.lit(True)).select("n", *marks.values(), "lo", "hi")


_NEGATIVE = f"""ln_ AS (SELECT id AS a, site AS la, row_number() OVER (ORDER BY {{u}}, id) AS place FROM k), rn_ AS (SELECT id AS b, site AS lb, row_number() OVER (ORDER BY {{v}}, id) AS place FROM k),
 neg AS (SELECT a, b FROM ln_ JOIN rn_ USING (place) WHERE place <= 12000 AND la <> lb ORDER BY place LIMIT 3000)""".format(u="CAST('0x' || substr(md5(id || '|0'), 1, 8) AS BIGINT) / 4294967296.0", v="CAST('0x' || substr(md5(id || '|1'), 1, 8) AS BIGINT) / 4294967296.0")
_POPULATIONS = f"""{_PAIRS % 7}, {_FEATURES}, {_NEGATIVE},
 pop AS (SELECT 'same key' AS population, x.id AS a, y.id AS b FROM k x JOIN k y ON x.cls = y.cls AND x.site = y.site AND length(x.text) % 50 = length(y.text) % 50 AND x.id < y.id UNION ALL SELECT 'cross class', a, b FROM neg UNION ALL SELECT 'candidates', a, b FROM pairs),
 val AS (SELECT population, a, b, round(corr(x.x, y.x), 5) AS r FROM pop JOIN fv x ON x.id = a JOIN fv y ON y.id = b AND y.d = x.d GROUP BY ALL)"""


def calibrated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The files as pictures: those of a class, a site and a remainder of the length are likely copies, and sites are the labels."""
    items = fingerprinted(spark, sf_dir).where("feature is not null").withColumn("shot", F.col("length") % 50)
    return calibration.calibrate_duplicates(items, ["cls", "site", "shot"], "site", "h", "feature", THRESHOLDS, distance=7)


@query(f"""WITH {_POPULATIONS} SELECT population, count(r) AS n, round(min(r), 4) AS lo, round(max(r), 4) AS hi, round(quantile_cont(r, 0.05), 4) AS p05, round(quantile_cont(r, 0.5), 4) AS p50, round(quantile_cont(r, 0.99), 4) AS p99
FROM val WHERE NOT isnan(r) GROUP BY population""")
def q_threshold_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of likely copies, of unlike files and of candidates."""
    measured, _ = calibrated(spark, sf_dir)
    return measured.select("population", "n", *(F.round(c, 4).alias(c) for c in ("lo", "hi", "p05", "p50", "p99")))


_COMP = f"{_PAIRS % 7}, both_ways AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs), reach(node, other) AS (SELECT x, x FROM both_ways UNION SELECT reach.node, y FROM reach JOIN both_ways ON other = x), comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"


@query(f"WITH RECURSIVE {_COMP} SELECT node, component FROM comp")
def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(hamming.near_links(durable(simhashes(spark, sf_dir)), 7))


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept files with the group of their near-duplicates; the site stands for the class, so that groups can conflict."""
    hashed = durable(simhashes(spark, sf_dir))
    pairs = hamming.near_links(hashed, 7)
    return splits.assign_groups(hashed.select("id", "cls", "site"), pairs, ["id"])


_GROUPED = f"{_COMP}, g AS (SELECT k.id, cls, site, coalesce(component, k.id) AS group_id FROM k LEFT JOIN comp ON node = k.id)"


@query(f"""WITH RECURSIVE {_GROUPED}, c AS (SELECT group_id, site, count(*) AS n FROM g GROUP BY ALL)
SELECT group_id, CAST(sum(n) AS BIGINT) AS size, arg_max(site, (n, -ascii_rank)) AS site FROM (SELECT *, row_number() OVER (ORDER BY site) AS ascii_rank FROM c) GROUP BY group_id""")
def q_group_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.majority(grouped(spark, sf_dir), "group_id", "site")


@query(f"""WITH RECURSIVE {_GROUPED}, multi AS (SELECT group_id FROM g GROUP BY group_id HAVING count(DISTINCT site) > 1),
 m AS (SELECT g.* FROM g JOIN multi USING (group_id)), n AS (SELECT cls, site, count(*) AS n FROM g GROUP BY ALL),
 aff AS (SELECT a.group_id, b.site, sum(coalesce(n.n, 0)) AS affinity, min(b.first) AS first FROM (SELECT DISTINCT group_id, cls FROM m) a JOIN (SELECT group_id, site, min(id) AS first FROM m GROUP BY ALL) b USING (group_id) LEFT JOIN n ON n.cls = a.cls AND n.site = b.site GROUP BY a.group_id, b.site),
 w AS (SELECT group_id, site AS winner FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY affinity DESC, first) AS r FROM aff) WHERE r = 1)
SELECT id, m.group_id, site, winner FROM m JOIN w USING (group_id) WHERE site <> winner""")
def q_label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.flag_conflicts(durable(grouped(spark, sf_dir)), "site", "cls")


@query(f"WITH {_FILES} SELECT site, cls, count(*) AS n FROM k GROUP BY ALL")
def q_class_site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir).groupBy("site", "cls").agg(F.count("*").alias("n"))


@query(f"WITH {_FILES} SELECT round(sum(m) / sum(t), 6) AS site_accuracy, CAST(sum(t) AS BIGINT) AS n FROM (SELECT site, max(n) AS m, sum(n) AS t FROM (SELECT site, cls, count(*) AS n FROM k GROUP BY ALL) GROUP BY site)")
def q_site_shortcut_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = kept(spark, sf_dir).groupBy("site", "cls").count().groupBy("site").agg(F.max("count").alias("m"), F.sum("count").alias("t"))
    return sites.agg(F.round(F.sum("m") / F.sum("t"), 6).alias("site_accuracy"), F.sum("t").alias("n"))


@query(f"""WITH {_FILES}, c AS (SELECT cls, site, count(*) AS n FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY n DESC, site) AS r FROM c)
SELECT cls, string_agg(site || ' (' || n || ')', ', ' ORDER BY r) FILTER (r <= 4) || CASE WHEN count(*) > 4 THEN ' +' || (count(*) - 4) || ' more' ELSE '' END AS sites FROM r GROUP BY cls""")
def q_top4_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = kept(spark, sf_dir).groupBy("cls", "site").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("n"), "site")))
    shown = F.when(F.col("r") <= 4, F.struct("r", F.concat("site", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("s")))
    listed = ranked.groupBy("cls").agg(F.sort_array(F.collect_list(shown)).alias("top"), F.count("*").alias("all"))
    more = F.when(F.col("all") > 4, F.concat(F.lit(" +"), (F.col("all") - 4).cast("string"), F.lit(" more"))).otherwise("")
    return listed.select("cls", F.concat(F.array_join(F.col("top.s"), ", "), more).alias("sites"))


@query(f"WITH {_FILES}, s AS (SELECT cls, count(*) / sum(count(*)) OVER (PARTITION BY cls) AS share FROM k GROUP BY cls, site), t AS (SELECT cls, max(share) AS share FROM s GROUP BY cls) SELECT count(*) FILTER (share >= 0.999) AS n_single, count(*) AS n_classes FROM t")
def q_single_site_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = dedupe.shares(kept(spark, sf_dir), ["cls"], "site").groupBy("cls").agg(F.max("share").alias("share"))
    return top.agg(F.count(F.when(F.col("share") >= 0.999, 1)).alias("n_single"), F.count("*").alias("n_classes"))


_HOLD = "hc AS (SELECT cls, site, count(*) AS n, min(id) AS first FROM g GROUP BY ALL), hr AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY n DESC, first) AS r FROM hc), held AS (SELECT cls, site, n FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY n, r) AS q FROM hr WHERE r > 1 AND n >= 5) WHERE q = 1)"


@query(f"WITH {_FILES}, g AS (SELECT * FROM k), {_HOLD} SELECT cls, site, n FROM held")
def q_holdout_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.holdout_sites(kept(spark, sf_dir).drop("text"), "cls", "site", 5)


_SEED = 1337
#: Groups whose rows are in no held-out site, by size and a seeded hash, go one by one to the split furthest below its share.
_ALLOCATED = f"""{_HOLD}, drag AS (SELECT DISTINCT group_id FROM g JOIN held USING (cls, site)), rc AS (SELECT group_id, cls, count(*) AS n FROM g WHERE group_id NOT IN (SELECT group_id FROM drag) GROUP BY ALL),
 sz AS (SELECT group_id, CAST(sum(n) OVER (PARTITION BY group_id) AS BIGINT) AS size, cls FROM rc QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY n DESC, cls NULLS FIRST) = 1),
 sq AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY size DESC, md5('{_SEED}:' || group_id), group_id) AS i, CAST(sum(size) OVER (PARTITION BY cls) AS DOUBLE) AS total FROM sz),
 al(cls, i, group_id, split, h0, h1, h2) AS (SELECT DISTINCT cls, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM sq
   UNION ALL SELECT cls, i, group_id, pick, h0 + CASE WHEN pick = 'train' THEN size ELSE 0 END, h1 + CASE WHEN pick = 'val' THEN size ELSE 0 END, h2 + CASE WHEN pick = 'test' THEN size ELSE 0 END FROM (
     SELECT al.cls, sq.i, sq.group_id, size, h0, h1, h2, list_sort([(h0 - CAST(0.70 AS DOUBLE) * total, h0, 0, 'train'), (h1 - CAST(0.15 AS DOUBLE) * total, h1, 1, 'val'), (h2 - CAST(0.15 AS DOUBLE) * total, h2, 2, 'test')])[1][4] AS pick
     FROM al JOIN sq ON sq.cls IS NOT DISTINCT FROM al.cls AND sq.i = al.i + 1)),
 made AS (SELECT group_id, split FROM al WHERE split IS NOT NULL UNION ALL SELECT group_id, 'test_site' FROM drag)"""


@query(f"WITH RECURSIVE {_GROUPED}, {_ALLOCATED} SELECT id, group_id, cls, site, split FROM g JOIN made USING (group_id)")
def q_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.build_splits(durable(grouped(spark, sf_dir)), "cls", "site", least=5).select("id", "group_id", "cls", "site", "split")


@query("SELECT CAST(NULL AS VARCHAR) AS problem, CAST(NULL AS VARCHAR) AS item WHERE false")
def q_verify_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split that keeps groups whole has nothing wrong, on any data."""
    items = durable(grouped(spark, sf_dir))
    made = splits.build_splits(items, "cls", "site", least=5)
    held = splits.holdout_sites(items, "cls", "site", 5).select("cls", "site")
    return splits.verify_splits(durable(made), "cls", "site", ["group_id", "id"], held).select("problem", "item")


FRACTIONS = {"train": 0.70, "val": 0.15, "test": 0.15}
_HASHED = f"{_GROUPED}, u AS (SELECT *, CAST('0x' || substr(md5(CAST(group_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM g), hs AS (SELECT *, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'test' END AS split FROM u)"


@query(f"WITH RECURSIVE {_HASHED} SELECT cls, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM hs GROUP BY cls")
def q_split_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = splits.hashed_splits(grouped(spark, sf_dir), FRACTIONS)
    return made.groupBy("cls").pivot("split", list(FRACTIONS)).count().na.fill(0)


@query(f"WITH RECURSIVE {_HASHED} SELECT split, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM hs GROUP BY split")
def q_split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = splits.hashed_splits(grouped(spark, sf_dir), FRACTIONS).groupBy("split").agg(F.count("*").alias("n"))
    return made.join(F.broadcast(made.agg(F.sum("n").alias("t"))), F.lit(True)).select("split", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


#: Classes in their fixed order; one of them has no rows.
CLASSES = ("de", "en", "es", "fr", "it")


@query(f"""WITH {_FILES}, d(cls) AS (VALUES {", ".join(f"('{c}')" for c in CLASSES)}), w AS (SELECT d.cls, pow(1.0 / greatest(count(k.id), 1), 0.5) AS w FROM d LEFT JOIN k USING (cls) GROUP BY d.cls)
SELECT cls, round(w / avg(w) OVER (), 6) AS weight FROM w""")
def q_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = spark.range(1).select(F.explode(F.array(*map(F.lit, CLASSES))).alias("cls"))
    counts = kept(spark, sf_dir).groupBy("cls").count()
    raw = domain.join(counts, "cls", "left").select("cls", F.pow(1 / F.greatest(F.coalesce("count", F.lit(1)), F.lit(1)), 0.5).alias("w"))
    return raw.join(F.broadcast(raw.agg(F.avg("w").alias("m"))), F.lit(True)).select("cls", F.round(F.col("w") / F.col("m"), 6).alias("weight"))


@query(f"WITH {_FILES} SELECT id, round(pow(1.0 / count(*) OVER (PARTITION BY cls), 0.5), 8) AS weight FROM k")
def q_sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = kept(spark, sf_dir).select("id", "cls")
    weights = items.groupBy("cls").agg(F.pow(1.0 / F.count("*"), 0.5).alias("w"))
    return items.join(weights, "cls").select("id", F.round("w", 8).alias("weight"))

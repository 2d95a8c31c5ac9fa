"""Masks of small images: each vector of embeddings is a picture of eight rows of eight pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.functions import text
from loamgrid.operators import resize, segment
from loamgrid.plans.registry import query, read

#: Rows and columns of a picture; its frame; sizes of its opening and closing, and of the closing and dilation of a generous mask.
SIDE, BORDER, SIZES, WIDE = 8, 1, {"open_size": 3, "close_size": 3, "times": 1}, {"close": 3, "grow": 3}


def whole(i: Column) -> Column:
    """The rounded value at ``i``, counted around the vector."""
    return F.rint(F.get(F.col("v"), (i % (SIDE * SIDE)).cast("int")) * 256)


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, y, w, l, a, b, grey) of every vector; the colour axes are the same values from other places on."""
    items = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.col("embedding").cast("array<double>").alias("v"))
    rows = items.select("image", "v", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("y"))
    line = lambda by: F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda x: 128.0 + whole(F.col("y") * SIDE + x + by))
    return rows.select("image", "y", F.lit(SIDE).alias("w"), line(0).alias("l"), line(21).alias("a"), line(43).alias("b"), line(0).alias("grey"))


def bright(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masks of the pixels over the middle level."""
    rows = pictures(spark, sf_dir).withColumn("spans", segment.runs_of(F.transform("l", lambda v: v > 128.0)))
    return rows.select("image", "y", "w", "spans").repartition("image")


_PX = f"""px AS (SELECT vec_id AS image, p // {SIDE} AS y, p % {SIDE} AS x, 128 + round_even(256 * CAST(embedding[p + 1] AS DOUBLE), 0) AS l, 128 + round_even(256 * CAST(embedding[(p + 21) % 64 + 1] AS DOUBLE), 0) AS a,
 128 + round_even(256 * CAST(embedding[(p + 43) % 64 + 1] AS DOUBLE), 0) AS b FROM embeddings CROSS JOIN range(64) r(p)), bright AS (SELECT image, y, x, l > 128 AS m FROM px)"""


def _kernel(size: int) -> str:
    r = size // 2
    return ", ".join(f"({dy}, {dx})" for dy, reach in zip(range(-r, r + 1), segment.ellipse(size)) for dx in range(-reach, reach + 1))


def _near(name: str, source: str, size: int, any_or_all: str) -> str:
    return f"""{name} AS (SELECT p.image, p.y, p.x, bool_{any_or_all}(q.m) AS m FROM {source} p CROSS JOIN (VALUES {_kernel(size)}) k(dy, dx) JOIN {source} q ON q.image = p.image AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY ALL)"""


def _dilate(name: str, source: str, size: int) -> str:
    return _near(name, source, size, "or")


def _erode(name: str, source: str, size: int) -> str:
    return _near(name, source, size, "and")


def _open(name: str, source: str, size: int) -> str:
    return f"{_erode(name + '_e', source, size)}, {_dilate(name, name + '_e', size)}"


def _close(name: str, source: str, size: int) -> str:
    return f"{_dilate(name + '_d', source, size)}, {_erode(name, name + '_d', size)}"


def _label(name: str, source: str, value: str, corners: bool) -> str:
    """name(image, p, c): the least pixel that each pixel of this value reaches."""
    near = "abs(s.y - r.b // 8) <= 1 AND abs(s.x - r.b % 8) <= 1" if corners else "abs(s.y - r.b // 8) + abs(s.x - r.b % 8) = 1"
    return f"""{name}_r AS (SELECT image, y * 8 + x AS a, y * 8 + x AS b FROM {source} WHERE m = {value} UNION SELECT r.image, r.a, s.y * 8 + s.x FROM {name}_r r JOIN {source} s ON s.image = r.image AND s.m = {value} AND {near}),
 {name} AS (SELECT image, a AS p, min(b) AS c FROM {name}_r GROUP BY ALL)"""


def _fill(name: str, source: str) -> str:
    outer = f"SELECT DISTINCT image, c FROM {name}_l WHERE p // 8 IN (0, 7) OR p % 8 IN (0, 7)"
    return f"""{_label(name + '_l', source, 'false', False)}, {name} AS (SELECT s.image, y, x, m OR o.c IS NULL AS m FROM {source} s LEFT JOIN {name}_l l ON l.image = s.image AND l.p = y * 8 + x LEFT JOIN ({outer}) o ON o.image = s.image AND o.c = l.c)"""


def _large(name: str, source: str) -> str:
    """name and name_s(image, share): the mask without small components, and the largest one's share."""
    return f"""{_label(name + '_l', source, 'true', True)}, {name}_a AS (SELECT image, c, count(*) AS area FROM {name}_l GROUP BY ALL),
 {name}_b AS (SELECT image, max(area) AS largest, sum(area) AS total, arg_min(c, -area * 64 + c) AS first, greatest(0.1 * max(area), 0.005 * 64) AS floor FROM {name}_a GROUP BY image),
 {name}_k AS (SELECT a.image, c FROM {name}_a a JOIN {name}_b b ON a.image = b.image WHERE area >= floor OR largest < floor AND c = first),
 {name} AS (SELECT s.image, y, x, k.c IS NOT NULL AS m FROM {source} s LEFT JOIN {name}_l l ON l.image = s.image AND l.p = y * 8 + x LEFT JOIN {name}_k k ON k.image = s.image AND k.c = l.c),
 {name}_s AS (SELECT i.image, coalesce(largest / total, 1.0) AS share FROM (SELECT DISTINCT image FROM {source}) i LEFT JOIN {name}_b b ON b.image = i.image)"""


def _bits(source: str) -> str:
    return f"(SELECT image, string_agg(CASE WHEN m THEN '#' ELSE '.' END, '' ORDER BY y, x) AS picture, count(*) FILTER (m) AS area FROM {source} GROUP BY image)"


def drawn(rows: DataFrame, name: str) -> DataFrame:
    """(image, name): the masks as text, row by row."""
    line = rows.select("image", "y", F.array_join(F.transform(segment.pixels_of(F.col("spans"), F.col("w")), lambda m: F.when(m, "#").otherwise(".")), "").alias("line"))
    return line.groupBy("image").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "line"))), lambda r: r["line"]), "").alias(name))


@query(f"""WITH {_PX}, {_dilate('d', 'bright', 5)}, {_erode('e', 'bright', 3)}, {_open('o', 'bright', 3)}, {_close('c', 'o', 3)}
SELECT d.image, d.picture AS dilated, e.picture AS eroded, c.picture AS smooth FROM {_bits('d')} d JOIN {_bits('e')} e ON d.image = e.image JOIN {_bits('c')} c ON d.image = c.image""")
def q_mask_morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bright(spark, sf_dir)
    found = drawn(segment.dilate(rows, 5), "dilated").join(drawn(segment.erode(rows, 3), "eroded"), "image")
    return found.join(drawn(segment.closed(segment.opened(rows, 3), 3), "smooth"), "image")


@query(f"""WITH RECURSIVE {_PX}, {_label('l', 'bright', 'true', True)}, {_label('g', 'bright', 'false', False)}
SELECT image, 'set' AS side, c AS component, count(*) AS area FROM l GROUP BY ALL UNION ALL SELECT image, 'unset', c, count(*) FROM g GROUP BY ALL""")
def q_mask_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of each mask, and of what it leaves out."""
    rows = bright(spark, sf_dir)
    runs = segment.components(rows, corners=True).withColumn("side", F.lit("set")).unionByName(segment.components(segment.inverted(rows), corners=False).withColumn("side", F.lit("unset")))
    first = F.col("component") - F.shiftleft(F.col("image"), 24)
    return runs.groupBy("image", "side", first.alias("component")).agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))


@query(f"""WITH RECURSIVE {_PX}, {_fill('f', 'bright')}, {_close('gc', 'bright', 3)}, {_fill('gf', 'gc')}, {_dilate('w', 'gf', 3)}
SELECT f.image, f.picture AS filled, w.picture AS generous FROM {_bits('f')} f JOIN {_bits('w')} w ON f.image = w.image""")
def q_mask_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mask without holes, and its generous form."""
    rows = bright(spark, sf_dir)
    return drawn(segment.fill_holes(rows), "filled").join(drawn(segment.generous(rows, **WIDE), "generous"), "image")


_FRAME = "(y IN (0, 7) OR x IN (0, 7))"


def _mask(name: str) -> str:
    """name, the finished mask of name_d(image, y, x, d), name_t, its threshold map, and name_q, its measures and reason."""
    return f"""{name}_v AS (SELECT image, y, x, CAST(floor((d - lo) * coalesce(255.0::DOUBLE / nullif(hi - lo, 0), 0)) AS INTEGER) AS v FROM {name}_d JOIN (SELECT image, min(d) AS lo, max(d) AS hi FROM {name}_d GROUP BY image) USING (image)),
 {name}_h AS (SELECT image, v, CAST(count(*) AS DOUBLE) AS n, CAST(sum(v) AS DOUBLE) AS s FROM {name}_v GROUP BY ALL),
 {name}_u AS (SELECT image, v, sum(n) OVER u AS n0, sum(s) OVER u AS s0, sum(n) OVER w AS n, sum(s) OVER w AS s FROM {name}_h WINDOW u AS (PARTITION BY image ORDER BY v), w AS (PARTITION BY image)),
 {name}_x AS (SELECT image, v FROM {name}_u QUALIFY row_number() OVER (PARTITION BY image ORDER BY CASE WHEN n > n0 THEN round(n0 * (n - n0) * (s0 / n0 - (s - s0) / (n - n0)) * (s0 / n0 - (s - s0) / (n - n0)) / (n * n), 9) ELSE 0 END DESC, v) = 1),
 {name}_t AS (SELECT image, y, x, p.v > t.v AS m FROM {name}_v p JOIN {name}_x t USING (image)),
 {_open(name + '_o', name + '_t', 3)}, {_close(name + '_c', name + '_o', 3)}, {_large(name + '_k', name + '_c')}, {_fill(name, name + '_k')},
 {name}_m AS (SELECT image, y, x, f.m, t.m AS u, sqrt((a - 128) * (a - 128) + (b - 128) * (b - 128)) AS c FROM {name} f JOIN {name}_t t USING (image, y, x) JOIN px USING (image, y, x)),
 {name}_p AS (SELECT image, count(*) FILTER (m) / 64 AS area_frac, count(*) FILTER (m AND {_FRAME}) / 28 AS border_frac, coalesce(count(*) FILTER (u AND NOT m) / nullif(count(*) FILTER (u), 0), 1) AS leak_frac,
   coalesce(avg(c) FILTER (m), 0) AS chroma_inside, coalesce(avg(c) FILTER (NOT m), 0) AS chroma_outside FROM {name}_m GROUP BY image),
 {name}_q AS (SELECT *, CASE WHEN area_frac < 0.08 THEN 'area too small' WHEN area_frac > 0.97 THEN 'area too large' WHEN share < 0.8 THEN 'fragmented' WHEN leak_frac > 0.3 THEN 'leaks' ELSE '' END AS reason FROM {name}_p JOIN {name}_k_s USING (image))"""


_DIST = "sqrt((l - rl) * 0.5 * ((l - rl) * 0.5) + (a - ra) * 1.5 * ((a - ra) * 1.5) + (b - rb) * 1.5 * ((b - rb) * 1.5))"


@query(f"""WITH RECURSIVE {_PX}, ref AS (SELECT image, median(l) AS rl, median(a) AS ra, median(b) AS rb FROM px WHERE {_FRAME} GROUP BY image),
 bm_d AS (SELECT image, y, x, {_DIST} AS d FROM px JOIN ref USING (image)), {_mask('bm')},
 cm_d AS (SELECT image, y, x, sqrt((a - 128) * (a - 128) + (b - 128) * (b - 128)) AS d FROM px WHERE image IN (SELECT image FROM bm_q WHERE reason <> '')), {_mask('cm')},
 won AS (SELECT image FROM cm_q WHERE reason = ''),
 mask AS (SELECT image, y, x, m FROM bm WHERE image NOT IN (SELECT image FROM won) UNION ALL SELECT image, y, x, m FROM cm WHERE image IN (SELECT image FROM won)),
 found AS (SELECT *, 'border' AS method FROM bm_q WHERE image NOT IN (SELECT image FROM won) UNION ALL SELECT *, 'chroma' FROM cm_q WHERE image IN (SELECT image FROM won)),
 {_close('wc', 'mask', 3)}, {_fill('wf', 'wc')}, {_dilate('wide', 'wf', 3)},
 beyond AS (SELECT image, y, x, l, a, b, {_FRAME} AS f FROM px JOIN wide USING (image, y, x) WHERE NOT m),
 ref2 AS (SELECT image, CASE WHEN count(*) FILTER (f) >= 50 THEN median(l) FILTER (f) ELSE median(l) END AS rl, CASE WHEN count(*) FILTER (f) >= 50 THEN median(a) FILTER (f) ELSE median(a) END AS ra,
   CASE WHEN count(*) FILTER (f) >= 50 THEN median(b) FILTER (f) ELSE median(b) END AS rb FROM beyond GROUP BY image),
 hot AS (SELECT image, y, x, NOT m AND {_DIST} > 20 AS m FROM px JOIN wide USING (image, y, x) JOIN ref2 USING (image)), {_open('patch', 'hot', 5)}, {_label('pl', 'patch', 'true', True)},
 lap AS (SELECT p.image, p.y * 8 + p.x AS p, sum(q.l) - 4 * any_value(p.l) AS v FROM px p CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) k(dy, dx) JOIN px q ON q.image = p.image
   AND q.y = CASE WHEN p.y + dy BETWEEN 0 AND 7 THEN p.y + dy ELSE p.y - dy END AND q.x = CASE WHEN p.x + dx BETWEEN 0 AND 7 THEN p.x + dx ELSE p.x - dx END GROUP BY ALL),
 rough AS (SELECT image, c, count(*) / 64 AS share FROM pl JOIN lap USING (image, p) GROUP BY ALL HAVING avg(v * v) - avg(v) * avg(v) >= 300),
 rest AS (SELECT image, max(share) AS share FROM rough WHERE share > 0.002 GROUP BY image)
SELECT image, round(area_frac, 6) AS area_frac, round(f.share, 6) AS largest_cc_frac, round(border_frac, 6) AS border_frac, round(leak_frac, 6) AS leak_frac, round(coalesce(rest.share, 0), 6) AS resid_frac,
 round(chroma_inside, 5) AS chroma_inside, round(chroma_outside, 5) AS chroma_outside, reason = '' AS ok, reason, method, picture FROM found f LEFT JOIN rest USING (image) JOIN {_bits('mask')} USING (image)""")
def q_build_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of all pictures with their measures: the backdrop's distance first, colourfulness where that fails."""
    rows, stats = segment.build_masks(pictures(spark, sf_dir), BORDER, SIZES, WIDE)
    measures = ["area_frac", "largest_cc_frac", "border_frac", "leak_frac", "resid_frac"]
    tidy = stats.select("image", *(F.round(c, 6).alias(c) for c in measures), F.round("chroma_inside", 5).alias("chroma_inside"), F.round("chroma_outside", 5).alias("chroma_outside"), "ok", "reason", "method")
    return tidy.join(drawn(rows, "picture"), "image")


#: Vectors that make one larger picture of rows of sixteen pixels; the last one has fewer rows, if it has fewer vectors.
TILES, WIDTH = 4, 16


def large_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, y, v): the vectors of TILES neighbouring ids on top of each other, as levels from 0 to 255."""
    items = read(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), 128.0 + F.rint(x * 256)))).alias("v"))
    rows = items.select((F.col("vec_id") - F.col("vec_id") % TILES).alias("image"), (F.col("vec_id") % TILES * 4).alias("_top"), "v", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("_y"))
    return rows.select("image", (F.col("_top") + F.col("_y")).cast("int").alias("y"), F.slice("v", F.col("_y") * WIDTH + 1, F.lit(WIDTH)).alias("v"))


def _band(name: str, sizes: str, to: int) -> str:
    """name(size, k, i, w): whole weights of old pixel i for new pixel k."""
    return f"""{name}_c AS (SELECT size, k, greatest(size / {to}, 1.0) AS wide, (k + 0.5) * (size / {to}) AS c FROM ({sizes}) CROSS JOIN range({to}) r(k)),
 {name}_x AS (SELECT size, k, i, pi() * (i - c + 0.5) / wide AS a FROM {name}_c CROSS JOIN range(4096) q(i) WHERE i >= greatest(0, floor(c - wide * {resize.LOBES} + 0.5)) AND i < least(size, floor(c + wide * {resize.LOBES} + 0.5))),
 {name}_l AS (SELECT size, k, i, CASE WHEN abs(a) >= pi() * {resize.LOBES} THEN 0 WHEN a = 0 THEN 1 ELSE {resize.LOBES} * sin(a) * sin(a / {resize.LOBES}) / (a * a) END AS w FROM {name}_x),
 {name} AS (SELECT size, k, i, CAST(floor(w / sum(w) OVER (PARTITION BY size, k) * {2**resize.DIGITS} + 0.5) AS BIGINT) AS w FROM {name}_l)"""


def _level(total: str) -> str:
    return f"greatest(0, least(255, (CAST({total} AS BIGINT) + {2 ** (resize.DIGITS - 1)}) >> {resize.DIGITS}))"


def _resized(name: str, height: int, width: int) -> str:
    """name(image, y, x, v): the large pictures in another size."""
    return f"""{_band(name + '_a', f'SELECT {WIDTH} AS size', width)}, {name}_n AS (SELECT image, y, k AS x, {_level('sum(w * v)')} AS v FROM lp JOIN {name}_a ON i = x GROUP BY ALL),
 {name}_h AS (SELECT image, max(y) + 1 AS size FROM lp GROUP BY image), {_band(name + '_d', f'SELECT DISTINCT size FROM {name}_h', height)},
 {name} AS (SELECT image, k AS y, x, {_level('sum(w * v)')} AS v FROM {name}_n JOIN {name}_h USING (image) JOIN {name}_d d ON d.size = {name}_h.size AND i = y GROUP BY ALL)"""


_LP = f"""lp AS (SELECT vec_id - vec_id % {TILES} AS image, vec_id % {TILES} * 4 + p // {WIDTH} AS y, p % {WIDTH} AS x, CAST(greatest(0, least(255, 128 + round_even(256 * CAST(embedding[p + 1] AS DOUBLE), 0))) AS BIGINT) AS v FROM embeddings CROSS JOIN range(64) r(p))"""


@query(f"""WITH {_LP}, {_resized('s', 8, 9)}, {_resized('t', 6, 6)}, b AS (SELECT l.image, string_agg(CASE WHEN r.v > l.v THEN '1' ELSE '0' END, '' ORDER BY l.y, l.x) AS bits FROM s l JOIN s r ON r.image = l.image AND r.y = l.y AND r.x = l.x + 1 GROUP BY l.image)
SELECT b.image, lower(string_agg(printf('%x', CAST(CAST(substr(bits, CAST(4 * g + 1 AS INTEGER), 4) AS BIT) AS INTEGER)), '' ORDER BY g)) AS hex, any_value(thumb) AS thumb
FROM b CROSS JOIN range(16) q(g) JOIN (SELECT image, string_agg(v, ' ' ORDER BY y, x) AS thumb FROM t GROUP BY image) USING (image) GROUP BY b.image""")
def q_picture_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference hash of each larger picture, and a thumbnail of it."""
    rows = large_pictures(spark, sf_dir)
    hashes = resize.dhash(rows).select("image", text.hash_to_hex(F.col("h")).alias("hex"))
    return hashes.join(resize.thumbnails(rows, 6).select("image", F.array_join(F.col("thumb").cast("array<string>"), " ").alias("thumb")), "image")

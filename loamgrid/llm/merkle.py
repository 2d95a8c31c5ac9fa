"""A Merkle manifest of a table, with a proof for every row.

Rows are leaves; each tree of the forest (a language, here) takes its leaves in
order, and every ARITY neighbours become a parent, whose preimage is the hashes
of its children joined. What is stored are preimages: a leaf that is joined with
its ancestors' has its siblings when it cuts its own 64 characters out of each,
and checks another hash in its place by putting it there and hashing upwards.

A tree is built and read in tiers of LEVELS levels. A tier's blocks hold
ARITY ** LEVELS nodes at most, one row each, so no group grows with the data and
a tree of any size takes log(n) / LEVELS shuffles, the next one 64 times smaller
than the last. A block is joined with its ancestors' before leaves are joined
with their block: only one join is as large as the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.llm.common import table
from loamgrid.session import durable

#: Children of a parent, levels of a tier, characters of a hash.
ARITY, LEVELS, SLOT = 2, 6, 64
WIDTH = ARITY**LEVELS
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that neighbours can't be taken for each other; - if null."""
    return F.coalesce(F.concat(F.octet_length(value.cast("string")).cast("string"), F.lit(":"), value.cast("string")), F.lit("-"))


def hash_of(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields.values())), 256)


def tree_key(value: Column) -> Column:
    """A text that is never null and sorts as ``value`` does, null first."""
    return F.coalesce(F.concat(F.lit("="), value), F.lit(""))


def positions(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` (with tree and hash) with pos, from 0 within the tree, and n, the tree's nodes; ties go by hash.

    Rows are sorted over all partitions, so that no tree has to fit in a task;
    equal rows are spread by their place in the input, which changes no hash.
    """
    keys = ["tree", *order, "hash", "_place"]
    placed = nodes.withColumn("_place", F.monotonically_increasing_id())
    rows = durable(placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_place").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    runs = rows.groupBy("tree", part.alias("_part")).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(Window.partitionBy("tree")).alias("n"))
    return rows.withColumn("_part", part).join(runs, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def block_rows(nodes: DataFrame) -> DataFrame:
    """tree, block, n, levels (the preimages of each level, from below), top (the hash above the last), of each run of WIDTH nodes."""
    grown = nodes.groupBy("tree", F.expr(f"pos div {WIDTH}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("_nodes"), F.max("n").alias("n"))
    joined = lambda hashes: F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / ARITY).cast("int")), lambda i: F.array_join(F.slice(hashes, i * ARITY + 1, ARITY), ""))
    # A level is due while several nodes remain: powers of ARITY below n, as far as the tier goes.
    due = F.filter(F.array(*(F.lit(ARITY**k).cast("long") for k in range(LEVELS))), lambda power: power < F.col("n"))
    start = F.struct(F.array().cast("array<array<string>>").alias("levels"), F.transform("_nodes", lambda x: x["hash"]).alias("hashes"))
    step = lambda acc, _: F.struct(F.concat(acc["levels"], F.array(joined(acc["hashes"]))).alias("levels"), F.transform(joined(acc["hashes"]), lambda x: F.sha2(x, 256)).alias("hashes"))
    return grown.withColumn("_built", F.aggregate(due, start, step)).select("tree", "block", "n", F.col("_built.levels").alias("levels"), F.col("_built.hashes")[0].alias("top"))


@dataclass
class Forest:
    """tiers: block rows from below; tops: tree and hash of each tree's last node."""

    tiers: list[DataFrame]
    tops: DataFrame


def grow(nodes: DataFrame) -> Forest:
    """The trees over ``nodes`` (tree, pos, n, hash), each tier written to the shared folder."""
    tiers, level = [], nodes.select("tree", "pos", "n", "hash")
    most = level.agg(F.max("n")).first()[0] or 0
    while most > 1:
        tiers.append(durable(block_rows(level)))
        level = tiers[-1].select("tree", F.col("block").alias("pos"), F.expr(f"(n + {WIDTH - 1}) div {WIDTH}").alias("n"), F.col("top").alias("hash"))
        most = -(-most // WIDTH)
    return Forest(tiers, level.select("tree", "hash"))


def path_in(levels: Column, pos: Column) -> Column:
    """(preimage, slot) of the ancestors of the node at ``pos`` in its block, from below; its own hash or ancestor fills the slot."""
    step = lambda exponent: F.pow(F.lit(ARITY), exponent).cast("long")
    floor = lambda value, by: F.floor(value / by).cast("long")
    inside = pos % WIDTH
    return F.transform(levels, lambda preimages, k: F.struct(F.get(preimages, floor(inside, step(k + 1)).cast("int")).alias("preimage"), (floor(inside, step(k)) % ARITY).cast("int").alias("slot")))


def with_paths(nodes: DataFrame, forest: Forest, above: DataFrame) -> DataFrame:
    """``nodes`` with path, the ancestors' preimages up to the top, then those of ``above`` (tree, path, others) over the tree's own top."""
    others = [c for c in above.columns if c not in ("tree", "path")]
    carried = above.select("tree", F.lit(0).cast("long").alias("block"), F.array().cast("array<array<string>>").alias("levels"), "path", *others)
    for tier in reversed(forest.tiers):
        own = tier.select("tree", "block", "levels")
        upper = carried.select("tree", F.col("block").alias("_block"), F.col("levels").alias("_upper"), F.col("path").alias("_path"), *others)
        met = own.withColumn("_block", F.expr(f"block div {WIDTH}")).join(upper, ["tree", "_block"])
        carried = met.select("tree", "block", "levels", F.concat(path_in(F.col("_upper"), F.col("block")), F.col("_path")).alias("path"), *others)
    upper = carried.select("tree", F.col("block").alias("_block"), F.col("levels").alias("_upper"), F.col("path").alias("_path"), *others)
    met = nodes.withColumn("_block", F.expr(f"pos div {WIDTH}")).join(upper, ["tree", "_block"])
    return met.withColumn("path", F.concat(path_in(F.col("_upper"), F.col("pos")), F.col("_path"))).drop("_block", "_upper", "_path")


def left_of(step: Column) -> Column:
    return F.substr(step["preimage"], F.lit(1), step["slot"] * SLOT)


def right_of(step: Column) -> Column:
    return F.substr(step["preimage"], (step["slot"] + 1) * SLOT + 1)


def siblings(path: Column) -> Column:
    """The hashes beside a leaf's path, joined: each preimage without the 64 characters of the path's own node."""
    return F.array_join(F.transform(path, lambda step: F.concat(left_of(step), right_of(step))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to: it replaces its slot, and the hash of that the slot above."""
    return F.aggregate(path, leaf, lambda below, step: F.sha2(F.concat(left_of(step), below, right_of(step)), 256))


def parents(forest: Forest) -> DataFrame:
    """The stored manifest as a flat table: tree, level from 1, k within the level, preimage."""
    found = None
    for t, tier in enumerate(forest.tiers):
        each = tier.select("tree", "block", F.posexplode("levels").alias("_level", "_preimages")).select("tree", "block", "_level", F.posexplode("_preimages").alias("_k", "preimage"))
        # A whole block has WIDTH / ARITY ** level parents on a level; only a tree's last block has fewer.
        k = F.col("block") * F.floor(F.lit(WIDTH) / F.pow(F.lit(ARITY), F.col("_level") + 1)).cast("long") + F.col("_k")
        flat = each.select("tree", (F.col("_level") + 1 + t * LEVELS).alias("level"), k.alias("k"), "preimage")
        found = flat if found is None else found.unionByName(flat)
    return found if found is not None else forest.tops.where("false").select("tree", F.lit(1).alias("level"), F.lit(0).cast("long").alias("k"), F.col("hash").alias("preimage"))


def prove(leaves: DataFrame, *order: str) -> tuple[DataFrame, Forest, Forest]:
    """``leaves`` (tree, hash, ``order``, others) with path, subroot and root, and the forests under and over the subroots.

    The subroots, in the order of their trees, are the leaves of one more tree,
    whose top is the root. A table without rows has no root and no paths.
    Columns named pos, n, path, subroot, root or with a leading underscore are
    replaced.
    """
    placed = positions(leaves, *order)
    below = grow(placed)
    tops = below.tops.select(F.lit("").alias("tree"), F.col("tree").alias("_tree"), "hash")
    ranked = positions(tops, "_tree")
    over = grow(ranked)
    root = (over.tops.first() or (None, None))[1]
    empty = F.array().cast("array<struct<preimage:string,slot:int>>")
    start = over.tops.select("tree", empty.alias("path"))
    upper = with_paths(ranked, over, start).select(F.col("_tree").alias("tree"), "path", F.col("hash").alias("subroot"))
    return with_paths(placed, below, upper).withColumn("root", F.lit(root).cast("string")), below, over


def document_leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, hash and tampered, the hash after n_chars grew by 1 where 7 divides crc32 of the id, else null."""
    fields = {name: F.col(name) for name in FIELDS}
    changed = fields | {"n_chars": (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")}
    tampers = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return docs.select(tree_key(F.col("lang")).alias("tree"), "doc_id", hash_of(fields).alias("hash"), F.when(tampers, hash_of(changed)).alias("tampered"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``documents``.

    Null ids come first in their tree and are never tampered with; rows of equal
    ids go by their leaf, and equal rows have equal leaves at places of their own.
    """
    leaves = durable(document_leaves(table(spark, sf_dir, "documents")))
    found, _, _ = prove(leaves, "doc_id")
    done = found.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.coalesce("tampered", "hash"), F.col("path")).alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The checksum of the decimal id, bit by bit: fixed values of the polynomial and of the first and last exclusive or.
CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda acc, byte: list_reduce([xor(acc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda crc, bit: CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END)), 4294967295)"""


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(n_chars if name == "n_chars" else name) for name in FIELDS) + ")"


OP13_SQL = f"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS id, doc_id, lang, leaf, begun,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf, CASE WHEN {CRC32} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} ELSE {_leaf_sql('n_chars')} END AS begun FROM documents)
), up AS (
  SELECT lang, 0 AS level, pos, leaf AS h, n FROM base
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY lang, level, pos // 2
), subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, h, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2
), beside AS (
  SELECT id, level, s.h, 0 AS part FROM base JOIN up s ON s.lang IS NOT DISTINCT FROM base.lang AND s.n > 1 AND s.pos = xor(base.pos >> s.level, 1)
  UNION ALL
  SELECT id, level, s.h, 1 FROM base JOIN subroots r ON r.lang IS NOT DISTINCT FROM base.lang JOIN top s ON s.n > 1 AND s.pos = xor(r.pos >> s.level, 1)
), proofs AS (
  SELECT id, sha256(string_agg(h, '' ORDER BY part, level)) AS proof FROM beside GROUP BY id
), fold AS (
  SELECT id, lang, 0 AS level, pos, begun AS h, n FROM base
  UNION ALL
  SELECT f.id, f.lang, f.level + 1, f.pos // 2, sha256(CASE WHEN f.pos % 2 = 0 THEN f.h || coalesce(s.h, '') ELSE s.h || f.h END), (f.n + 1) // 2
  FROM fold f LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.n > 1
), fold_top AS (
  SELECT f.id, 0 AS level, r.pos, f.h, r.n FROM fold f JOIN subroots r ON r.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1
  UNION ALL
  SELECT f.id, f.level + 1, f.pos // 2, sha256(CASE WHEN f.pos % 2 = 0 THEN f.h || coalesce(s.h, '') ELSE s.h || f.h END), (f.n + 1) // 2
  FROM fold_top f LEFT JOIN top s ON s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.n > 1
)
SELECT doc_id, leaf, r.h AS subroot, t.h AS root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM base JOIN subroots r ON r.lang IS NOT DISTINCT FROM base.lang JOIN fold_top f ON f.id = base.id AND f.n = 1 LEFT JOIN proofs ON proofs.id = base.id CROSS JOIN (SELECT h FROM top WHERE n = 1) t
"""

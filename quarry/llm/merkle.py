"""Operator 12: Merkle manifest of a data set, checked by a recursive query that climbs it.

Every row is a leaf. Per tree (language) leaves ascend by id; every 8 consecutive nodes
become one node of the next level until one remains, the tree's subroot. Subroots, by tree
name (null first), are the leaves of one more tree, whose last node is the root.

Stored: the leaves, and of every built level its inner nodes as rows linked to their parent
(up_tree, up_level, up_idx: the parent's key; up_slot: place among its children), each
with the digests of its children end to end. A level is one aggregation of 8 rows a group, so a tree
that holds a third of all rows is built by all tasks; levels grow with the logarithm.

Checked: ``WITH RECURSIVE`` starts from every leaf's digest as recomputed from the rows
in hand, joins the parent's row, puts the digest in its slot between the stored siblings, hashes,
appends a row with the siblings met and goes on to the parent's parent; where no parent is left the folded
digest is compared with the stored root. The proof is a leaf's siblings end to end in the order of its steps, at most 7 a level.

H is the lowercase hex SHA-256 of its inputs end to end, digests as hex text; between steps
digests are kept as 32 bytes.

Edge cases: a null field hashes as ``-``; a null id comes first in its tree and is never tampered with; repeated ids
are ordered by leaf, equal rows are leaves of their own; a null language is a tree of its own, apart from the empty one; a
single tree's subroot is the root; a single leaf has the empty proof; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.ranges import positions, ranged
from quarry.llm import common

FAN = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOP = "top"
#: Rows that Spark lets a recursive query make by default; a climb makes (levels + 1) rows a leaf.
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def h(col: Column) -> Column:
    """H of a text, or of digests as 32 bytes each."""
    return F.sha2(col, 256)


def h_bytes(digests: Column) -> Column:
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def field(col: Column) -> Column:
    s = col.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(*cols: Column) -> Column:
    return h(F.concat(*[field(c) for c in cols]))


@dataclass
class Manifest:
    """``leaves`` (the given columns, leaf_no, tree, idx and the link to the parent), ``nodes`` (inner nodes),
    ``subroots`` (tree, subroot) and ``root``."""
    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None
    levels: int


def tree_key(col: Column) -> Column:
    """Orders null first, then by UTF-8 bytes, and never equals the name of the top tree."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(""))


def _level(cur: DataFrame, level: int, trees: int) -> DataFrame:
    """Parents (level + 1) of the nodes (tree, ord, n, idx, hash) of trees with more than one node."""
    runs = (cur.where("n > 1").groupBy("tree", "ord", "n", F.expr(f"idx div {FAN}").alias("idx"))
               .agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), "hash"))).alias("run")))
    runs = runs.withColumn("text", F.array_join(F.transform("run", lambda x: x["hash"]), ""))
    return linked(runs.select("tree", "ord", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), "idx", h(F.col("text")).alias("hash"),
                              F.unhex("text").alias("children"), F.lit(level + 1).alias("level")), trees)


def linked(nodes: DataFrame, trees: int) -> DataFrame:
    """The parent's key of each node (null for the root) and the node's place among its children."""
    top = F.lit(_TOP)
    last = F.col("n") == 1
    sub = last & (F.col("tree") != top)
    root = last & ((F.col("tree") == top) | F.lit(trees == 1))
    place = F.when(sub, F.col("ord")).otherwise(F.col("idx"))
    return nodes.withColumns({
        "up_tree": F.when(~root, F.when(sub, top).otherwise(F.col("tree"))),
        "up_level": F.when(~root, F.when(sub, F.lit(1)).otherwise(F.col("level") + 1)),
        "up_idx": F.when(~root, F.floor(place / FAN).cast("long")),
        "up_slot": F.when(~root, F.pmod(place, F.lit(FAN)).cast("int"))})


def build(rows: DataFrame) -> Manifest:
    """Manifest of ``rows(tree, id, leaf, tie, ...)``; other columns ride with the leaves."""
    spark = rows.sparkSession
    keep = lambda df: common.stored(df, "merkle")
    placed = positions(ranged(rows, ["tree", "id", "leaf", "tie"], keep), ["tree"], "idx")
    count = placed.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    # one row per tree
    count = keep(count.withColumn("ord", F.row_number().over(Window.orderBy("tree")).cast("long") - 1))
    seen = count.agg(F.count(F.lit(1)), F.max("n")).first()
    trees, most = seen[0], seen[1] or 0
    leaves = placed.join(count, "tree").withColumns({"level": F.lit(0), "hash": F.col("leaf")})
    leaves = leaves.withColumn("leaf_no", F.shiftleft(F.col("_part").cast("long"), 33) + F.col("_row"))
    leaves = keep(linked(leaves, trees).drop("_part", "_row"))
    cols = ["tree", "ord", "n", "idx", "hash"]
    cur, level, made, subs = leaves.select(*cols), 0, [], []
    while True:
        subs.append(cur.where("n = 1"))
        if most <= 1:
            break
        made.append(keep(_level(cur, level, trees)))
        cur, level, most = made[-1].select(*cols), level + 1, -(-most // FAN)
    depth = level
    # the tree of subroots
    subs = keep(reduce(DataFrame.unionByName, subs))
    cur = subs.select(F.lit(_TOP).alias("tree"), F.lit(0).cast("long").alias("ord"),
                                                     F.lit(trees).cast("long").alias("n"), F.col("ord").alias("idx"), "hash")
    level, left = 0, trees
    while left > 1:
        made.append(keep(_level(cur, level, trees)))
        cur, level, left = made[-1].select(*cols), level + 1, -(-left // FAN)
    found = cur.first()
    node_cols = ["tree", "level", "idx", "children", "up_tree", "up_level", "up_idx", "up_slot"]
    none = leaves.limit(0).withColumn("children", F.unhex("hash"))
    nodes = reduce(DataFrame.unionByName, [x.select(*node_cols) for x in made or [none]])
    return Manifest(leaves, nodes, subs.select("tree", F.col("hash").alias("subroot")), found["hash"] if found else None, depth + level)


@contextmanager
def recursion_rows(spark: SparkSession):
    """No limit on the rows of a recursive query inside."""
    was = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.set(_ROW_LIMIT, was)


# A row a leaf and step: what is folded so far, the siblings met in this step, and the next parent. Only the leaf's number,
# the digest and the parent's key go into the next join; what a leaf carries stays in its first row.
CLIMB = """
WITH RECURSIVE climb(leaf_no, step, up_tree, up_level, up_idx, up_slot, folded, siblings, carried) AS (
  SELECT leaf_no, 0, up_tree, up_level, up_idx, up_slot, folded, CAST('' AS BINARY), carried FROM {leaves}
  UNION ALL
  SELECT c.leaf_no, c.step + 1, n.up_tree, n.up_level, n.up_idx, n.up_slot,
         unhex(sha2(lower(hex(concat(substring(n.children, 1, 32 * c.up_slot), c.folded, substring(n.children, 32 * c.up_slot + 33)))), 256)),
         concat(substring(n.children, 1, 32 * c.up_slot), substring(n.children, 32 * c.up_slot + 33)), NULL
  FROM climb c JOIN {nodes} n ON n.tree = c.up_tree AND n.level = c.up_level AND n.idx = c.up_idx)
SELECT leaf_no, step, folded, siblings, carried FROM climb
"""
#: Leaves whose steps come to one task together: neighbours share most siblings, so their rows compress well.
_BLOCK_BITS = 9


def climb(manifest: Manifest, found: Column) -> DataFrame:
    """The leaves' columns with ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` (climbed from ``found``, the
    hex digest of a leaf as recomputed now) and ``verified``."""
    spark = manifest.leaves.sparkSession
    start = manifest.leaves.withColumns({"folded": F.unhex(found), "carried": F.struct("tree", "id", F.unhex("leaf").alias("leaf"))})
    steps = spark.sql(CLIMB, leaves=start.select("leaf_no", "up_tree", "up_level", "up_idx", "up_slot", "folded", "carried"),
                      nodes=manifest.nodes)
    steps = steps.withColumn("block", F.shiftright("leaf_no", _BLOCK_BITS)).repartition("block")
    ascent = F.array_sort(F.collect_list(F.struct("step", "siblings")))
    got = steps.groupBy("block", "leaf_no").agg(ascent.alias("ascent"), F.max_by("folded", "step").alias("folded"),
                                                F.first("carried", ignorenulls=True).alias("carried"))
    proof = F.aggregate("ascent", F.unhex(F.lit("")), lambda p, s: F.concat(p, s["siblings"]))
    text = lambda c: F.lower(F.hex(c))
    got = got.select("carried.tree", "carried.id", text("carried.leaf").alias("leaf"), F.lit(manifest.root).alias("root"),
                     h(text(proof)).alias("proof_sha256"), text("folded").alias("folded_root"))
    got = got.join(manifest.subroots, "tree").withColumn("verified", F.col("folded_root") == F.col("root"))
    with recursion_rows(spark):
        return common.stored(got, "merkle")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    cols = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    leaf = leaf_digest(*cols, F.col("text"))
    other = F.when(changed & (F.translate("text", _UPPER, _LOWER) != F.col("text")), leaf_digest(*cols, F.translate("text", _UPPER, _LOWER)))
    rows = docs.select(tree_key(F.col("lang")).alias("tree"), F.col("doc_id").alias("id"), leaf.alias("leaf"),
                       other.alias("other"), F.monotonically_increasing_id().alias("tie"))
    m = build(common.stored(rows, "merkle"))
    return climb(m, F.coalesce("other", "leaf")).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


# Levels by a recursive query with grouping, proofs by joining every leaf with the runs above it, the fold by a second recursion;
# crc32 of an id by its polynomial, a table of 256 entries made from it.
OP12_SQL = """
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM range(256) s(i))),
raw AS (
  SELECT row_number() OVER () AS r, *, lang IS NULL AS no_lang,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 3 = 0 AS hit
  FROM documents, tab),
fields AS (
  SELECT *, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
         CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now
  FROM raw),
digests AS (
  SELECT r, doc_id, coalesce('=' || lang, '') AS tree, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(octet_length(encode(now)) || ':' || now, '-')) AS other FROM fields),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM digests),
inner_levels(tree, level, idx, hash, n) AS (
  SELECT tree, 0, idx, leaf, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 8, sha256(string_agg(hash, '' ORDER BY idx)), (any_value(n) + 7) // 8
  FROM inner_levels WHERE n > 1 GROUP BY tree, level, idx // 8),
subs AS MATERIALIZED (SELECT tree, hash, level AS height, row_number() OVER (ORDER BY tree) - 1 AS ord, count(*) OVER () AS n FROM inner_levels WHERE n = 1),
top_levels(level, idx, hash, n) AS (
  SELECT 0, ord, hash, n FROM subs
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(hash, '' ORDER BY idx)), (any_value(n) + 7) // 8 FROM top_levels WHERE n > 1 GROUP BY level, idx // 8),
nodes AS MATERIALIZED (
  SELECT tree, level, idx, hash, n FROM inner_levels UNION ALL SELECT 'top', level, idx, hash, n FROM top_levels),
root AS (SELECT hash AS root FROM top_levels WHERE n = 1),
sibs AS (
  SELECT l.r, 0 AS part, x.level, x.idx, x.hash FROM leaves l JOIN nodes x
    ON x.tree = l.tree AND x.n > 1 AND x.idx // 8 = l.idx // (8::BIGINT ** (x.level + 1))::BIGINT AND x.idx <> l.idx // (8::BIGINT ** x.level)::BIGINT
  UNION ALL
  SELECT l.r, 1, x.level, x.idx, x.hash FROM leaves l JOIN subs s USING (tree) JOIN nodes x
    ON x.tree = 'top' AND x.n > 1 AND x.idx // 8 = s.ord // (8::BIGINT ** (x.level + 1))::BIGINT AND x.idx <> s.ord // (8::BIGINT ** x.level)::BIGINT),
proofs AS (SELECT r, sha256(string_agg(hash, '' ORDER BY part, level, idx)) AS proof_sha256 FROM sibs GROUP BY r),
fold(r, tree, level, idx, x) AS (
  SELECT r, tree, 0, idx, other FROM leaves
  UNION ALL
  SELECT f.r, f.tree, f.level + 1, f.idx // 8, sha256(string_agg(CASE WHEN n.idx = f.idx THEN f.x ELSE n.hash END, '' ORDER BY n.idx))
  FROM fold f JOIN nodes n ON n.tree = f.tree AND n.level = f.level AND n.idx // 8 = f.idx // 8 WHERE n.n > 1 GROUP BY f.r, f.tree, f.level, f.idx, f.x),
top_fold(r, level, idx, x) AS (
  SELECT f.r, 0, s.ord, f.x FROM fold f JOIN subs s ON s.tree = f.tree AND s.height = f.level
  UNION ALL
  SELECT f.r, f.level + 1, f.idx // 8, sha256(string_agg(CASE WHEN n.idx = f.idx THEN f.x ELSE n.hash END, '' ORDER BY n.idx))
  FROM top_fold f JOIN nodes n ON n.tree = 'top' AND n.level = f.level AND n.idx // 8 = f.idx // 8 WHERE n.n > 1 GROUP BY f.r, f.level, f.idx, f.x)
SELECT l.doc_id, l.leaf, s.hash AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, t.x AS folded_root, t.x = root AS verified
FROM leaves l JOIN subs s USING (tree) CROSS JOIN root LEFT JOIN proofs p USING (r)
JOIN (SELECT r, arg_max(x, level) AS x FROM top_fold GROUP BY r) t USING (r)
"""

"""Merkle manifest of a dataset: digests of rows, trees per group, proofs.

A tree's level is pivoted by slot: one aggregation per run of consecutive nodes
has a conditional aggregate per slot (``max(when(slot = j, node))``), which
spreads the run's children into columns.  Concatenating the columns in order
hashes the parent; omitting a child's own column gives its siblings.  One pivot
covers ``LEVELS`` levels: its ``fanout ** LEVELS`` columns hold a whole subtree,
the levels in between are plain expressions over them, so a tree of n leaves
takes log(n) / LEVELS shuffles, each smaller by that width.  Proofs go the other
way: a pivot row receives the path above its subtree (one join per pivot, on the
subtree's place) and hands every slot its own.

Everything is DataFrame expressions, written to the shared folder between
pivots.  Places are found by a range partitioning (equal rows are spread by a
salt) and a prefix sum over partitions, so a group that holds most rows is never
one window.

Defined results: null columns are ``-`` in a leaf; rows without id come first in
their group, rows of equal id are ordered by their leaf; equal rows are leaves
each.  A null group (lang) is a group of its own, before all others.  An empty
table gives no row.  Columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import documents, saved, scratch_dir

FANOUT = 2
#: levels of a tree that one pivot covers
LEVELS = 4
#: the query tampers with rows whose id's crc32 this divides
TAMPERED = 7

PATH = "array<struct<before: string, after: string>>"


def digest(*texts: Column | str) -> Column:
    """H: lowercase hex sha256 of the concatenated texts (nulls left out)."""
    return F.sha2(F.concat_ws("", *texts), 256)


def field(value: Column) -> Column:
    """``-`` if null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


# ------------------------------------------------------------------- places
def ordered_places(rows: DataFrame, tree: str, order: Sequence[str], folder: str,
                   name: str) -> DataFrame:
    """Add ``pos`` (from 0, gapless, by ``order``) and ``size`` within each value
    of ``tree``.  ``rows`` must be a written table (it is read twice)."""
    keys = [tree, *order, "_salt"]
    ranged = (rows.withColumn("_salt", F.monotonically_increasing_id())
              .repartitionByRange(*keys).sortWithinPartitions(*keys)
              .drop("_salt")
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_row", F.monotonically_increasing_id()))
    ranged = saved(ranged, folder, f"{name}-ordered")
    parts = ranged.groupBy(tree, "_part").agg(F.min("_row").alias("_first"),
                                              F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(tree)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        tree, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
        .alias("_shift"), F.sum("_n").over(group).alias("size"))
    return (ranged.join(parts, [tree, "_part"])
            .withColumn("pos", F.col("_row") + F.col("_shift"))
            .drop("_part", "_row", "_shift"))


# -------------------------------------------------------------------- trees
def _count(level: int, fanout: int) -> Column:
    """Nodes of a tree at a level above the pivot's first."""
    return F.ceil(F.col("size") / F.lit(float(fanout ** level))).cast("long")


def pivot(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """One row per subtree: columns ``n0_*`` are its children (structs with a
    ``digest``), ``n1_*`` ... the levels above, ``n{levels}_0`` its top.  A level
    above a tree's last one repeats it."""
    width = fanout ** levels
    slot = F.pmod("pos", F.lit(width))
    out = nodes.groupBy("tree", F.floor(F.col("pos") / F.lit(width)).cast("long").alias("run")).agg(
        F.max("size").alias("size"),
        *[F.max(F.when(slot == j, F.col("node"))).alias(f"n0_{j}") for j in range(width)])
    for level in range(1, levels + 1):
        more = _count(level - 1, fanout) > 1
        made = {}
        for j in range(fanout ** (levels - level)):
            below = _level(level - 1, range(j * fanout, (j + 1) * fanout))
            made[f"n{level}_{j}"] = F.when(
                below[0].isNotNull(), F.when(more, digest(*below)).otherwise(below[0]))
        out = out.withColumns(made)
    return out


def _level(level: int, places) -> list[Column]:
    return [F.col(f"n0_{i}.digest" if level == 0 else f"n{level}_{i}") for i in places]


def grow(nodes: DataFrame, folder: str, name: str, fanout: int = FANOUT,
         levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The pivots of all trees, lowest first, and their roots (tree, digest).

    ``nodes``: tree, pos, size, node (a struct with ``digest``; its other fields
    ride along to the proofs)."""
    most = nodes.agg(F.max("size").alias("n")).first()["n"] or 0
    width, pivots = fanout ** levels, []
    while True:
        pivots.append(saved(pivot(nodes, fanout, levels), folder, f"{name}-{len(pivots)}"))
        top = F.col(f"n{levels}_0")
        if most <= width ** len(pivots):
            return pivots, pivots[-1].select("tree", top.alias("digest"))
        nodes = pivots[-1].select("tree", F.col("run").alias("pos"),
                                  _count(levels, fanout).alias("size"),
                                  F.struct(top.alias("digest")).alias("node"))


def proofs(pivots: list[DataFrame], roots: DataFrame, fanout: int = FANOUT,
           levels: int = LEVELS) -> DataFrame:
    """Every leaf's node with its ``path``: per level, upwards, the siblings
    before and after it in its run.  ``roots``: tree, path (what lies above the
    tree's root), and columns that are handed down."""
    handed = [c for c in roots.columns if c not in ("tree", "path")]
    above = roots.withColumn("run", F.lit(0).cast("long"))
    for table in reversed(pivots):
        own = F.lit(0)  # levels of this pivot that the tree has
        for level in range(levels):
            own = own + (_count(level, fanout) > 1).cast("int")
        slots = []
        for j in range(fanout ** levels):
            path = []
            for level in range(levels):
                at = j // fanout ** level
                run = at - at % fanout
                path.append(F.struct(
                    F.concat_ws("", *_level(level, range(run, at))).alias("before"),
                    F.concat_ws("", *_level(level, range(at + 1, run + fanout))).alias("after")))
            slots.append(F.struct(
                (F.col("run") * fanout ** levels + j).alias("pos"), F.col(f"n0_{j}").alias("node"),
                F.concat(F.slice(F.array(*path), F.lit(1), F.col("_own")), F.col("path"))
                .alias("path")))
        below = (table.withColumn("_own", own).join(above, ["tree", "run"])
                 .select("tree", *handed, F.explode(F.array(*slots)).alias("s"))
                 .where("s.node IS NOT NULL"))
        above = below.select("tree", *handed, F.col("s.pos").alias("run"), "s.path", "s.node")
        leaves, above = above, above.drop("node")
    return leaves.withColumnRenamed("run", "pos")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, x: digest(x["before"], node, x["after"]))


def proof_digest(path: Column) -> Column:
    return digest(F.transform(path, lambda x: F.concat(x["before"], x["after"])))


# ----------------------------------------------------------------- manifest
def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (``=`` and the lang; empty for null), leaf, and the leaf of
    the row as tampered with (null if it isn't)."""
    c = {n: F.col(n) for n in ("doc_id", "source", "lang", "n_chars", "text")}
    more = {**c, "n_chars": c["n_chars"].cast("decimal(20,0)") + 1}
    leaf, changed = [F.sha2(F.concat(*[field(v) for v in row.values()]), 256) for row in (c, more)]
    hit = F.crc32(c["doc_id"].cast("string")) % TAMPERED == 0
    return docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"),
        leaf.alias("leaf"), F.when(hit & c["n_chars"].isNotNull(), changed).alias("tampered"))


def manifest(rows: DataFrame, folder: str, fanout: int = FANOUT) -> DataFrame:
    """Proof of every row.  ``rows``: tree (string), doc_id, leaf, and columns
    that ride along.  Result: these, ``subroot`` (of its tree), ``root`` (over the
    trees, ordered by name) and ``path`` (siblings from the leaf to the root)."""
    rows = saved(rows, folder, "leaves")
    ride = [c for c in rows.columns if c not in ("tree", "leaf")]
    placed = ordered_places(rows, "tree", ["doc_id", "leaf"], folder, "leaves")
    pivots, subroots = grow(placed.select(
        "tree", "pos", "size", F.struct(F.col("leaf").alias("digest"), *ride).alias("node")),
        folder, "tree", fanout)
    named = saved(subroots.select(F.lit("").alias("all"), F.col("tree").alias("name"), "digest"),
                  folder, "subroots")
    top = ordered_places(named, "all", ["name"], folder, "subroots").select(
        F.col("all").alias("tree"), "pos", "size", F.struct("digest", "name").alias("node"))
    top_pivots, root = grow(top, folder, "top", fanout)
    start = root.select("tree", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    of_tree = saved(proofs(top_pivots, start, fanout).select(
        F.col("node.name").alias("tree"), F.col("node.digest").alias("subroot"), "root", "path"),
        folder, "subroot-proofs")
    return proofs(pivots, of_tree, fanout).select(
        "tree", F.col("node.digest").alias("leaf"), *[F.col(f"node.{c}").alias(c) for c in ride],
        "subroot", "root", "path")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "source", "lang", "n_chars", "text")
    proved = manifest(leaves(docs), scratch_dir(spark, "merkle"))
    folded = proved.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC_DOC = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform("
            "string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), "
            "lambda b: ((ascii(c) >> b) & 1)::BIGINT)))), lambda a, x: xor(a >> 1, "
            "CASE WHEN (xor(a, x) & 1) = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)))")


def _sql_field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


_LEAF = " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", "{n}", "text"))

OP13_SQL = f"""
WITH RECURSIVE made AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS g,
         sha256({_LEAF.format(n='n_chars')}) AS leaf,
         CASE WHEN n_chars IS NOT NULL AND {_CRC_DOC} % 7 = 0
              THEN sha256({_LEAF.format(n='(n_chars::HUGEINT + 1)')}) END AS tampered
  FROM documents
), leaf AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY g) AS n
  FROM made
), nodes AS (
  SELECT g, 0 AS lvl, pos, n, leaf AS h FROM leaf
  UNION ALL
  SELECT g, lvl + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY g, lvl, pos // 2
), subroots AS (
  SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lvl, pos, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM tops WHERE n > 1 GROUP BY lvl, pos // 2
), climb AS (
  SELECT rid, g, 0 AS lvl, pos, n, '' AS proof, coalesce(tampered, leaf) AS f FROM leaf
  UNION ALL
  SELECT c.rid, c.g, c.lvl + 1, c.pos // 2, (c.n + 1) // 2, c.proof || coalesce(s.h, ''),
         sha256(CASE WHEN c.pos % 2 = 0 THEN c.f || coalesce(s.h, '') ELSE s.h || c.f END)
  FROM climb c LEFT JOIN nodes s ON s.g = c.g AND s.lvl = c.lvl AND s.pos = xor(c.pos, 1)
  WHERE c.n > 1
), upper AS (
  SELECT c.rid, 0 AS lvl, r.pos, r.n, c.proof, c.f, r.h AS subroot
  FROM climb c JOIN subroots r ON r.g = c.g WHERE c.n = 1
  UNION ALL
  SELECT c.rid, c.lvl + 1, c.pos // 2, (c.n + 1) // 2, c.proof || coalesce(s.h, ''),
         sha256(CASE WHEN c.pos % 2 = 0 THEN c.f || coalesce(s.h, '') ELSE s.h || c.f END), c.subroot
  FROM upper c LEFT JOIN tops s ON s.lvl = c.lvl AND s.pos = xor(c.pos, 1)
  WHERE c.n > 1
)
SELECT l.doc_id, l.leaf, u.subroot, t.h AS root, sha256(u.proof) AS proof_sha256,
       u.f AS folded_root, u.f = t.h AS verified
FROM leaf l JOIN upper u ON u.rid = l.rid AND u.n = 1, (SELECT h FROM tops WHERE n = 1) t
"""

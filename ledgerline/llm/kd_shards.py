"""Shards by a k-d tree over document metadata, split at weighted medians.

A document weighs its UTF-8 bytes plus ``OVERHEAD``.  Equal texts form one
atom with one weight and one place (first source and language, log size).
Sources and languages are placed by their rank among the distinct values, so
values that begin alike are told apart.  Starting from one node with all
shards, every node with several shards left is cut across its widest dimension
(relative to the whole table) at the weight that its half of the shards should
hold, until every leaf holds the target bytes.

A text with a large part of a shard's bytes or rows would push a cut off its
median, so such texts (a bounded number) are given whole to the shards with
the least bytes, heaviest first, and the tree cuts all others to the room that
is left.  Copies of a text stay together whenever a shard can hold them; a text
whose copies outweigh a shard is divided evenly by doc_id into as few parts as
fit.

All nodes of a level are cut together.  The weighted median comes from
histograms over the node's key range, refined around the cut until the bin
that holds it is light: each pass is one aggregation to at most ``BINS`` rows a
node.  Only one row per node (at most the number of shards) reaches the driver.
Keys are a 30-bit place in the dimension and 32 bits of the text's hash, so a
source that holds a third of all rows is cut inside as well.

Law: ``bytes``, shard sizes near equal.  Slots are gapless ranks within the
shard, counted in hash buckets.

Defined cases: null text weighs the overhead only and is equal to other nulls,
not to empty texts; null source or language sorts first; repeated rows are
documents of their own; an empty table gives no row; more shards than texts
leave shards empty; only doc_id, text, source and lang are read.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import (documents, gapless_rank, rank_buckets, saved, scratch_dir)

SHARDS = 40
OVERHEAD = 16
BINS = 1 << 12
#: a text above this part of a shard's bytes or rows is given out before the
#: tree: at most 2 * shards / PINNED_PART texts
PINNED_PART = 1 / 16
#: a cut is fine enough when its bin holds at most this part of a shard
CUT_PART = 1 / 1000
_PLACE = (1 << 30) - 1
_DIMENSIONS = ("v0", "v1", "v2")


def _ranks(docs: DataFrame, name: str, folder: str) -> DataFrame:
    """(name, place): the distinct values spread over the places in their order,
    null first.  Ranked by range partitions and a running sum over these."""
    values = docs.select(F.col(name).alias("value")).distinct()
    cut = saved(values.repartitionByRange("value").withColumn("part", F.spark_partition_id()),
                folder, f"{name}-values")
    counts = cut.groupBy("part").agg(F.count("*").alias("n"))  # one row per partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    ranked = cut.withColumn("within", within).join(
        counts.select("part", before.alias("before")), "part")
    steps = max(1, cut.count() - 1)
    place = F.floor((F.col("before") + F.col("within")) * F.lit(_PLACE) / F.lit(steps))
    return saved(ranked.select(F.col("value").alias(f"_{name}"), place.cast("long").alias("place")),
                 folder, f"{name}-places")


def weighted(docs: DataFrame, folder: str) -> DataFrame:
    """A row per document without its text: size, hashes and places."""
    text = F.col("text")
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2"),
        "source", "lang")
    for name, out in (("source", "v0"), ("lang", "v1")):
        places = _ranks(docs, name, folder)  # one row per value: AQE broadcasts or splits
        rows = rows.join(places, F.col(name).eqNullSafe(F.col(f"_{name}"))) \
            .withColumnRenamed("place", out).drop(name, f"_{name}")
    return saved(rows, folder, "rows")


def spread(texts: list[tuple], shards: int, target: float) -> list[tuple]:
    """(h1, h2, shard of every part) of the heavy ``texts`` (h1, h2, bytes,
    rows): the heaviest part goes to the shard with the least bytes.  Copies
    are divided only where they outweigh a shard."""
    parts = []
    for h1, h2, w, n in texts:
        count = min(n, max(1, math.ceil(w / target)))
        parts.extend((-w / count, h1, h2) for _ in range(count))
    held = [(0.0, shard) for shard in range(shards)]
    given: dict[tuple, list[int]] = {}
    for w, h1, h2 in sorted(parts):
        load, shard = heapq.heappop(held)
        given.setdefault((h1, h2), []).append(shard)
        heapq.heappush(held, (load - w, shard))
    return [(h1, h2, to) for (h1, h2), to in sorted(given.items())]


def _atoms(rows: DataFrame, shards: int, folder: str):
    """(rows with the shard of heavy texts, the other texts with weight and
    places, bytes left in each shard, all bytes)."""
    spark = rows.sparkSession
    whole = saved(rows.groupBy("h1", "h2").agg(
        F.sum("size").alias("w"), F.count("*").alias("n"), F.min("v0").alias("v0"),
        F.min("v1").alias("v1"), F.min(F.log2("size")).alias("scale")), folder, "texts")
    total = whole.agg(F.sum("w").alias("w"), F.sum("n").alias("n"),
                      F.max("scale").alias("scale")).first()
    if total["w"] is None:
        return rows, whole, [], 0
    target = total["w"] / shards
    is_heavy = ((F.col("w") > F.lit(target * PINNED_PART))
                | (F.col("n") > F.lit(total["n"] / shards * PINNED_PART)))
    heavy = [tuple(r) for r in whole.where(is_heavy).select("h1", "h2", "w", "n").collect()]
    pinned = spark.createDataFrame(spread(heavy, shards, target),
                                   "_a long, _b long, _shards array<int>")
    named = rows.join(F.broadcast(pinned), (F.col("h1") == F.col("_a"))
                      & (F.col("h2") == F.col("_b")), "left").drop("_a", "_b")
    once = F.coalesce(F.size("_shards"), F.lit(0)) <= 1
    # a divided text is dealt out by gapless ranks: its parts differ by one row at most
    dealt = gapless_rank(named.where(~once), ["h1", "h2"], F.col("doc_id"), [F.col("doc_id")],
                         "_rank", rank_buckets(total["n"]))
    rows = saved(named.where(once).select(*rows.columns, F.get("_shards", F.lit(0)).alias("shard"))
                 .unionAll(dealt.select(*rows.columns, F.get(
                     "_shards", (F.col("_rank") % F.size("_shards")).cast("int")))),
                 folder, "pinned")
    loads = {r["shard"]: r["w"] for r in rows.where("shard IS NOT NULL").groupBy("shard").agg(
        F.sum("size").alias("w")).collect()}
    room = [max(0.0, target - loads.get(shard, 0)) for shard in range(shards)]
    low, high = math.log2(OVERHEAD), max(total["scale"], math.log2(OVERHEAD) + 0.1)
    atoms = whole.where(~is_heavy).select(
        "h1", "h2", "w", "v0", "v1",
        F.floor((F.col("scale") - low) / (high - low) * _PLACE).cast("long").alias("v2"),
        F.shiftrightunsigned(F.xxhash64("h1", "h2"), 32).alias("tie"), F.lit(0).alias("node"))
    return rows, saved(atoms, folder, "atoms"), room, total["w"]


def _left_part(room: list[float], node: int, k: int) -> float:
    """The part of a node's weight that its first half of shards has room for."""
    left, both = sum(room[node:node + k // 2]), sum(room[node:node + k])
    return left / both if both > 0 else (k // 2) / k


def _cuts(atoms: DataFrame, nodes: dict[int, int], room: list[float], target: float) -> list[tuple]:
    """(node, dimension, key): keys up to the cut go left.  ``nodes`` maps a
    node (its first shard) to the shards it must fill."""
    spark = atoms.sparkSession
    open_ = {n: k for n, k in nodes.items() if k > 1}
    spans = atoms.groupBy("node").agg(
        F.sum("w").alias("w"), *[F.min(v).alias(f"a{v}") for v in _DIMENSIONS],
        *[F.max(v).alias(f"b{v}") for v in _DIMENSIONS]).collect()
    state = {}
    for row in spans:
        if row["node"] in open_:
            widths = [row[f"b{v}"] - row[f"a{v}"] for v in _DIMENSIONS]
            d = max(range(len(widths)), key=lambda i: widths[i])
            v = _DIMENSIONS[d]
            k = open_[row["node"]]
            # dimension, key range, weight wanted left of the cut
            state[row["node"]] = [d, row[f"a{v}"] << 32, ((row[f"b{v}"] + 1) << 32) - 1,
                                  row["w"] * _left_part(room, row["node"], k)]
    cuts = {}
    key = F.element_at(F.array(*_DIMENSIONS), F.col("_d") + 1) * (1 << 32) + F.col("tie")
    while state:
        table = spark.createDataFrame(
            [(n, d, lo, hi, max(1, -(-(hi - lo + 1) // BINS)), want)
             for n, (d, lo, hi, want) in state.items()],
            "_n int, _d int, _lo long, _hi long, _step long, _want double")
        keyed = atoms.join(F.broadcast(table), F.col("node") == F.col("_n")) \
            .withColumn("_key", key)
        inside = keyed.where(F.col("_key").between(F.col("_lo"), F.col("_hi")))
        bins = inside.groupBy("node", "_lo", "_hi", "_step", "_want", F.floor(
            (F.col("_key") - F.col("_lo")) / F.col("_step")).cast("long").alias("bin")).agg(
            F.sum("w").alias("w"))
        before = F.coalesce(F.sum("w").over(Window.partitionBy("node").orderBy("bin").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))
        at = bins.withColumn("before", before).where(
            (F.col("before") <= F.col("_want")) & (F.col("before") + F.col("w") >= F.col("_want"))
        ).groupBy("node").agg(F.min(F.struct("bin", "w", "before", "_lo", "_hi", "_step")).alias("b"))
        found = {r["node"]: r["b"] for r in at.collect()}
        for n in list(state):
            d, lo, hi, want = state[n]
            b = found.get(n)
            if b is None:  # nothing in the range: cut at its start
                cuts[n] = (n, d, lo - 1)
                del state[n]
                continue
            start = lo + b["bin"] * b["_step"]
            end = min(hi, start + b["_step"] - 1)
            left, rest = b["before"], want - b["before"]
            if b["w"] <= target * CUT_PART or start == end:
                cuts[n] = (n, d, end if rest * 2 >= b["w"] else start - 1)
                del state[n]
            else:
                state[n] = [d, start, end, want - left]
    return list(cuts.values())


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot)."""
    spark = docs.sparkSession
    folder = scratch_dir(spark, "kd")
    rows, atoms, room, total = _atoms(weighted(docs, folder), shards, folder)
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"),
                           F.lit(0).cast("long").alias("slot"))
    nodes, level = {0: shards}, 0
    while any(k > 1 for k in nodes.values()):
        level += 1
        cuts = [(n, d, key, n + nodes[n] // 2) for n, d, key in _cuts(
            atoms, nodes, room, total / shards)]
        table = spark.createDataFrame(cuts, "_n int, _d int, _cut long, _right int")
        key = F.element_at(F.array(*_DIMENSIONS), F.col("_d") + 1) * (1 << 32) + F.col("tie")
        moved = atoms.join(F.broadcast(table), F.col("node") == F.col("_n"), "left").withColumn(
            "node", F.when(F.col("_cut").isNotNull() & (key > F.col("_cut")), F.col("_right"))
            .otherwise(F.col("node")))
        atoms = saved(moved.drop("_n", "_d", "_cut", "_right"), folder, f"level-{level}")
        parts = {}
        for n, k in nodes.items():
            parts.update({n: k // 2, n + k // 2: k - k // 2} if k > 1 else {n: k})
        nodes = parts
    # no text with many rows takes part in this join
    light = rows.where("shard IS NULL").drop("shard").join(
        atoms.select("h1", "h2", F.col("node").alias("shard")), ["h1", "h2"])
    placed = rows.where("shard IS NOT NULL").select(*light.columns).unionAll(light)
    buckets = rank_buckets(rows.count())
    return gapless_rank(placed, ["shard"], F.struct("h1", "doc_id"),
                        [F.col("h1"), F.col("doc_id")], "slot", buckets).select(
        "doc_id", "size", "text_crc32", "shard", "slot")


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "source", "lang")
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))

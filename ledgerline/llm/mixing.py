"""Mix sources to target weights by subset-sum budget fitting.

Every source gets a share of all words by its weight; a target stops at
``MAX_EPOCHS`` times the source's words and the excess goes to the others by
weight.  A source is taken whole ``floor(target / words)`` times; the rest of
its budget is filled with documents chosen by their exact word count:

1. the histogram (word count -> documents) of each source is aggregated;
2. a proportional part of every count is taken, then single documents from the
   longest down, until a budget of at most ``DP_BUDGET`` words is left;
3. a bounded-knapsack dynamic program over the counts that remain fills that
   budget as exactly as they allow;
4. within a word count, the documents with the smallest seeded rank are taken;
5. a gap that whole documents leave (a source of few, long ones) is filled the
   same way with repeats, as long as none is taken more than ``MAX_EPOCHS`` times.

A histogram has at most one row per distinct length, however large the source;
documents are ranked in hash buckets, so a length (or a group of copies) that
holds a third of all rows is ranked by many tasks.

Defined cases: null or empty texts have size 0, cost nothing and are taken with
their source's whole epochs; null is a source of its own, ranked last; repeated
rows are documents of their own; an empty table gives an empty mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import (WORD_RE, documents, gapless_rank, quoted, rank_buckets, saved,
                                   scratch_dir)

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
DP_BUDGET = 1 << 16
SEED = 20240229
#: rows of a per-source or per-length table that are shipped to all tasks
SHIPPED_ROWS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


# ------------------------------------------------------------ budget fitting
def knapsack(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each size (at most its count) sum closest to ``budget`` from
    below.  Reachable sums are bits of one integer; the item that first reaches
    a sum is kept for the way back."""
    taken = [0] * len(sizes)
    if budget <= 0:
        return taken
    items: list[tuple[int, int, int]] = []  # (index, copies, words): counts in powers of two
    for i, (size, count) in enumerate(zip(sizes, counts)):
        left = min(count, budget // size) if size else 0
        copies = 1
        while left > 0:
            copies = min(copies, left)
            items.append((i, copies, copies * size))
            left -= copies
            copies *= 2
    reach, mask = 1, (1 << (budget + 1)) - 1
    first = np.full(budget + 1, -1, dtype=np.int32)
    width = budget // 8 + 1
    for k, (_, _, words) in enumerate(items):
        fresh = (reach << words) & mask & ~reach
        if fresh:
            bits = np.unpackbits(np.frombuffer(fresh.to_bytes(width, "little"), np.uint8),
                                 bitorder="little")
            first[np.flatnonzero(bits)] = k
            reach |= fresh
            if reach >> budget:
                break
    at = reach.bit_length() - 1
    while at > 0:
        i, copies, words = items[first[at]]
        taken[i] += copies
        at -= words
    return taken


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents to take of each size so that their words come to ``budget``."""
    total = int((sizes * counts).sum())
    budget = min(int(budget), total)
    if budget <= 0:
        return np.zeros(len(sizes), dtype=np.int64)
    if budget == total:
        return counts.copy()
    taken = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    left = budget - int((taken * sizes).sum())
    order = np.argsort(-sizes, kind="stable")
    while left > DP_BUDGET:
        before = left
        for i in order:
            if left <= DP_BUDGET:
                break
            if 0 < sizes[i] <= left and taken[i] < counts[i]:
                taken[i] += 1
                left -= int(sizes[i])
        if left == before:
            break
    room = counts - taken
    usable = [int(i) for i in order[::-1] if 0 < sizes[i] <= left and room[i] > 0]
    extra = knapsack([int(sizes[i]) for i in usable], [int(room[i]) for i in usable],
                     min(left, DP_BUDGET))
    for i, n in zip(usable, extra):
        taken[i] += n
    return taken


# ---------------------------------------------------------------- source level
def source_targets(totals: DataFrame, weights=WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size); only sums come
    to the driver.  A source is full when weight * level passes its cap, so the
    level rises until the full ones' excess is shared out."""
    spark = totals.sparkSession
    order = totals.orderBy(F.col("source").asc_nulls_last())
    kinds = {f.name: f.dataType for f in totals.schema.fields}
    from pyspark.sql.types import LongType, StructType
    schema = (StructType().add("source", kinds["source"])
              .add("source_size", LongType()).add("place", LongType()))
    placed = spark.createDataFrame(
        order.select("source", "source_size").rdd.zipWithIndex()
        .map(lambda p: (p[0][0], p[0][1], p[1])), schema)
    cases = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                         (F.col("place") % len(weights) + 1).cast("int"))
    shares = saved(placed.withColumn("weight", cases).drop("place"),
                   scratch_dir(spark, "mix"), "shares")
    cap = F.lit(float(epochs)) * F.col("source_size")
    level, full = 0.0, -1
    while True:
        is_full = F.col("weight") * F.lit(level) >= cap
        row = shares.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(is_full, F.col("source_size"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0)).alias("w"),
            F.count(F.when(is_full, 1)).alias("n")).first()
        if row["all"] is None or not row["w"] or row["n"] == full:
            break
        full = row["n"]
        level = (row["all"] - epochs * row["capped"]) / row["w"]
    target = F.least(F.col("weight") * F.lit(level), cap)
    return shares.select("source", "source_size", target.alias("target"))


def _shipped(df: DataFrame) -> DataFrame:
    """A broadcast hint only for a counted, small table; else AQE decides."""
    return F.broadcast(df) if df.count() <= SHIPPED_ROWS else df


def mix(docs: DataFrame, size: Column, weights=WEIGHTS, epochs: int = MAX_EPOCHS,
        seed: int = SEED) -> DataFrame:
    """``docs`` with size, source_size, target and times (how often the mix
    takes the row); these replace columns of the same names."""
    own = ("size", "source_size", "target", "times")
    names = [quoted(c) for c in docs.columns if c.lower() not in own]
    return _taken(docs, size, weights, epochs, seed).select(*[f"doc.{c}" for c in names], *own)


def _taken(docs: DataFrame, size: Column, weights=WEIGHTS, epochs: int = MAX_EPOCHS,
           seed: int = SEED) -> DataFrame:
    """(doc, size, source_size, target, times): the whole row is the struct
    ``doc``, so that no column of it meets a name used here."""
    spark = docs.sparkSession
    folder = scratch_dir(spark, "mix")
    sized = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("doc"),
                        "doc_id", "source", size.alias("size"))
    lengths = saved(sized.groupBy("source", "size").agg(F.count("*").alias("n")),
                    folder, "lengths")
    totals = lengths.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    targets = source_targets(totals, weights, epochs)

    kind = docs.schema["source"].dataType.simpleString()

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        words, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        whole = int(target / words + 1e-9) if words else 0
        sizes, counts = frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
        place = np.argsort(sizes, kind="stable")
        extra = np.zeros(len(frame), dtype=np.int64)
        budget = round(target - whole * words)
        extra[place] = fit_budget(sizes[place], counts[place], budget)
        more = np.zeros(len(frame), dtype=np.int64)
        gap = budget - int((extra * sizes).sum())
        if gap > 0 and whole + 2 <= epochs:
            more[place] = fit_budget(sizes[place], counts[place], gap)
        return frame.assign(whole=np.int64(whole), extra=extra, more=more)[
            ["source", "size", "source_size", "target", "whole", "extra", "more"]]

    joined = lengths.alias("l").join(
        _shipped(targets).alias("t"), F.col("l.source").eqNullSafe(F.col("t.source"))).select(
        "l.source", "l.size", "l.n", "t.source_size", "t.target")
    plan = saved(joined.groupBy("source").applyInPandas(
        choose, f"source {kind}, size long, source_size long, target double, "
                "whole long, extra long, more long"), folder, "plan")
    plan = plan.select(F.col("source").alias("_s"), F.col("size").alias("_z"),
                       F.col("source_size").alias("_words"), F.col("target").alias("_target"),
                       F.col("whole").alias("_whole"), F.col("extra").alias("_extra"),
                       F.col("more").alias("_more"))
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"))
    buckets = rank_buckets(lengths.agg(F.sum("n")).first()[0] or 0)
    ranked = gapless_rank(sized.withColumn("_draw", draw), ["source", "size"], F.col("_draw"),
                          [F.col("_draw"), F.col("doc_id")], "_rank", buckets)
    times = (F.col("_whole") + (F.col("_rank") < F.col("_extra")).cast("long")
             + (F.col("_rank") < F.col("_more")).cast("long"))
    on = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    return ranked.join(_shipped(plan), on).select(
        "doc", "size", F.col("_words").alias("source_size"), F.col("_target").alias("target"),
        times.alias("times"))


def mixed_rows(docs: DataFrame, size: Column, **options) -> DataFrame:
    """The mix itself: the columns of ``docs`` unchanged, each row as often as
    it is taken."""
    taken = _taken(docs, size, **options).where("times > 0")
    copies = taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return copies.select("doc.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        "doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(docs, F.col("size")).select(
        "doc_id", "size", "source_size", "target",
        (F.col("times") * F.col("size")).cast("long").alias("taken"))

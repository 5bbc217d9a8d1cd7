"""Filter interaction audit: what each of a chain of filters removes, in every order.

A document fails each filter or not, whatever the order, so a part of the
corpus (a language) is described by one count per *mask cell*: the set of
filters that its documents fail.  The survivors of every subset of filters
follow from the cells by a Gray-code walk: successive subsets differ by one
filter; toggling it adds or takes one from the active-failure counter of the
cells that fail it, and a cell leaves or joins the running survivors as its
counter leaves or reaches zero.  The 2**k states are stored; every step of
every order is a difference of two of them.

Texts are read once.  What is shuffled is narrow (text digest, id, mask), the
counts are combined before their shuffle, and the walk sees at most 2**k cells
of a part, so a hot language, source or group of copies adds no load.

Defined results: null text is empty, null lang is the part ``''`` (as an empty
lang).  Equal rows count each.  A row without id has no smaller id, so it never
fails the copies filter and has no labels; rows of the smallest id of a text all
pass it.  Where labels repeat a doc_id, any row of quality 1 (toxic 1) counts.
An empty table has no part, so no row.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import UPPER, documents, saved, scratch_dir

#: the query's filters, in the order of their bits
FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 3
SIGNS = r"[#$%&*|]"


def words(text: Column) -> Column:
    """Maximal runs without ASCII white space."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def text_failures(text: Column) -> list[Column]:
    """Failure conditions A to D of a text that isn't null."""
    w = words(text)
    n = F.size(w)
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return [n < MIN_WORDS,
            F.size(F.array_distinct(w)) * 100 < n * MIN_DISTINCT_PERCENT,
            upper * 100 > F.length(text) * MAX_UPPER_PERCENT,
            text.rlike(SIGNS)]


def bits(flags: Sequence[Column]) -> Column:
    total = F.lit(0)
    for i, flag in enumerate(flags):
        total = total + F.when(flag, F.lit(1 << i)).otherwise(F.lit(0))
    return total


def mask_cells(docs: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the set of filters
    they fail, and how many of them are labelled good or toxic."""
    text = F.coalesce(F.col("text"), F.lit(""))
    measured = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("text_id"), bits(text_failures(text)).alias("mask"))
    # equal rows collapse before the shuffle
    rows = saved(measured.groupBy("doc_id", "part", "text_id", "mask").agg(
        F.count(F.lit(1)).alias("n")), folder, "rows")
    named = rows.where("doc_id IS NOT NULL")
    # the copies filter: only rows of a text's smallest id pass.  The join is on
    # (text, id), so the many copies of a text don't meet in one task
    first = named.groupBy("text_id").agg(F.min("doc_id").alias("doc_id")).withColumn(
        "passes", F.lit(True))
    flags = labels.where("doc_id IS NOT NULL").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.when(F.col("passes").isNull(), F.lit(1 << 4)).otherwise(F.lit(0))
    judged = named.join(first, ["text_id", "doc_id"], "left").withColumn(
        "mask", F.col("mask") + copy).join(flags, "doc_id", "left")
    zero = F.lit(0)
    return (judged.select("part", "mask", "n", "good", "toxic")
            .union(rows.where("doc_id IS NULL").select("part", "mask", "n", zero, zero))
            .groupBy("part", "mask").agg(
                F.sum("n").alias("n"),
                F.sum(F.col("n") * F.coalesce("good", zero)).alias("good"),
                F.sum(F.col("n") * F.coalesce("toxic", zero)).alias("toxic")))


# ------------------------------------------------------------- Gray-code walk
def gray_walk(cells: dict[int, tuple[int, ...]], k: int) -> list[tuple[int, ...]]:
    """Survivors of each subset of ``k`` filters, indexed by the subset's bits;
    ``cells`` has a tuple of counts per mask."""
    width = len(next(iter(cells.values()))) if cells else 1
    failures = dict.fromkeys(cells, 0)  # filters now active that a cell fails
    alive = [sum(c[i] for c in cells.values()) for i in range(width)]
    states: list[tuple[int, ...]] = [()] * (1 << k)
    states[0], active = tuple(alive), 0
    for step in range(1, 1 << k):
        toggled = step & -step  # bit that the next Gray code changes
        active ^= toggled
        change = 1 if active & toggled else -1
        for mask, counts in cells.items():
            if mask & toggled:
                before = failures[mask]
                failures[mask] = before + change
                if before == 0 or failures[mask] == 0:
                    alive = [a - change * c for a, c in zip(alive, counts)]
        states[active] = tuple(alive)
    return states


def subset_states(cells: DataFrame, k: int) -> DataFrame:
    """(part, state, kept, good, toxic): survivors of each of the 2**k subsets.
    A group has at most 2**k cells."""
    def walk(group: pd.DataFrame) -> pd.DataFrame:
        found = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(
            group["mask"], group["n"], group["good"], group["toxic"])}
        states = pd.DataFrame(gray_walk(found, k), columns=["kept", "good", "toxic"])
        states.insert(0, "state", range(len(states)))
        states.insert(0, "part", group["part"].iloc[0])
        return states

    return cells.groupBy("part").applyInPandas(
        walk, "part string, state int, kept long, good long, toxic long")


def order_steps(spark: SparkSession, filters: str) -> DataFrame:
    """k! * k rows: the active subset before and after each step of each order."""
    rows = []
    for order in permutations(range(len(filters))):
        active = 0
        for step, i in enumerate(order, 1):
            rows.append(("".join(filters[j] for j in order), step, 1 << i, active,
                         active | 1 << i))
            active |= 1 << i
    return spark.createDataFrame(
        rows, "filter_order string, step int, bit int, before int, after int")


def audit(states: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every step of every order of ``filters``, from the stored states.

    With K(S) the survivors of subset S: a step removes K(before) - K(after); a
    filter fails K({}) - K({f}) documents, and alone K(all but f) - K(all).
    """
    whole = (1 << len(filters)) - 1
    # k! * k rows, fixed by the number of filters
    steps = F.broadcast(order_steps(states.sparkSession, filters))
    after = states.join(steps, F.col("state") == F.col("after")).drop("state", "after")

    def others(prefix: str, state: str) -> DataFrame:
        return states.select("part", F.col("state").alias(state), *[
            F.col(c).alias(f"{prefix}_{c}") for c in ("kept", "good", "toxic")])

    f = (after.withColumn("one", F.col("bit"))
         .withColumn("rest", F.lit(whole) - F.col("bit"))
         .join(others("was", "before"), ["part", "before"])
         .join(others("one", "one").select("part", "one", "one_kept"), ["part", "one"])
         .join(others("rest", "rest").select("part", "rest", "rest_kept"), ["part", "rest"]))
    ends = states.groupBy("part").agg(
        F.max(F.when(F.col("state") == 0, F.col("kept"))).alias("all_kept"),
        F.max(F.when(F.col("state") == whole, F.col("kept"))).alias("end_kept"))
    removed = F.col("was_kept") - F.col("kept")
    per_filter = Window.partitionBy("part", "bit")
    return f.join(ends, "part").select(
        "part", "filter_order", "step", "kept", removed.alias("removed"),
        (F.col("all_kept") - F.col("one_kept") - removed).alias("redundant"),
        (F.col("rest_kept") - F.col("end_kept")).alias("unique_fails"),
        (F.col("was_good") - F.col("good")).alias("good_lost"),
        (F.col("was_toxic") - F.col("toxic")).alias("toxic_lost"),
        F.sum(removed).over(per_filter).alias("shapley"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "audit")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    cells = mask_cells(documents(spark, sf_dir, "doc_id", "lang", "text"), labels, folder)
    return audit(saved(subset_states(cells, len(FILTERS)), folder, "states"))


OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts
), flags AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, doc_id,
         (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t)
            THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask
  FROM split
), cells AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM judged LEFT JOIN flags USING (doc_id) GROUP BY part, mask
), letters(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bs
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.b + q.b + r.b + s.b + t.b = 31 AND (p.b | q.b | r.b | s.b | t.b) = 31
), steps AS (
  SELECT filter_order, step, bs[step] AS b, coalesce(list_sum(bs[1:step - 1]), 0)::BIGINT AS earlier
  FROM orders, range(1, 6) AS x(step)
), counted AS (
  SELECT part, filter_order, step, b,
         sum(CASE WHEN (mask & (earlier | b)) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN (mask & earlier) = 0 AND (mask & b) <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN (mask & earlier) <> 0 AND (mask & b) <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = b THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN (mask & earlier) = 0 AND (mask & b) <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN (mask & earlier) = 0 AND (mask & b) <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, b
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley
FROM counted
"""

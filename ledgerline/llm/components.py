"""Connected components by alternating large-star and small-star rounds.

Edges stay distributed; each half round is one aggregation and one join, and
every round's edges are written to the shared folder, which cuts lineage.  The
minimum of each node is written before it is joined back, so that a node with
very many neighbours is split over tasks by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import saved


def components(edges: DataFrame, folder: str, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge to another node; component
    is the smallest node reachable.  Loops and repeated edges don't matter."""
    now = saved(_down(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), folder, "cc-0")
    state, step = _state(now), 0
    while state[0]:
        step += 1
        both = now.union(now.select("v", "u"))
        low = saved(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")),
                    folder, f"cc-{step}-low")
        # large star: every larger neighbour of u is hung on u's minimum
        now = saved(_down(both.join(low, "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v"))), folder, f"cc-{step}-large")
        low = saved(now.groupBy("u").agg(F.min("v").alias("m")), folder, f"cc-{step}-least")
        # small star: u and its smaller neighbours are hung on their minimum
        now = saved(_down(now.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                          .union(low)), folder, f"cc-{step}")
        before, state = state, _state(now)
        if state == before:
            break
    return now.groupBy("u").agg(F.min("v").alias("v")).select(
        F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select("v", "v").distinct())


def _down(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return (edges.where("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"),
                    F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]

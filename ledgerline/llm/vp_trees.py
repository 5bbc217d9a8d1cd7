"""Approximate nearest neighbours by cosine: vantage-point trees per shard.

*Space.*  Vectors are scaled to length one; the distance of two is their chord,
``sqrt(2 - 2 cos)``, which orders as the cosine and obeys the triangle inequality.

*Shards.*  A sample of pivots (at most ``MAX_PIVOTS`` vectors, the smallest id
hashes) cuts the space into cells of the nearest pivot; every vector is indexed.
A cell's bounds are the least and greatest distance from its pivot.  Cells
heavier than ``SHARD_BYTES`` are split by id hash, so a cell that holds a third
of all rows (copies) is many shards, each one task's bounded group.

*Trees.*  A shard is one vantage-point tree, written as rows: the points in tree
order, an inner node's vantage point first, then its nearer half and its farther
half, with the least and greatest distance of either from the vantage point.

*Search.*  A query at distance d from a vantage point or pivot can be no nearer
than ``max(lo - d, d - hi)`` to what lies in [lo, hi].  With t the distance of its
k-th best so far, a branch, and a whole cell, is left out when ``factor`` times
that bound exceeds t.  Factor 1 is exact; a larger one visits less.  First each
query searches a shard of its own cell, which sets t; then it goes to the shards
that the bounds don't rule out.  Queries meet a shard's tree in blocks.

Defined results: a vector that is null, empty, zero or has a null or non-finite
component takes no part, nor does a row without id.  Vectors of different
lengths aren't compared.  Of several vectors with one id the least (as an array)
counts, so repeated rows are one.  Ties of a score go to the smaller id.  A query
isn't its own neighbour (its id is left out); with fewer candidates than k all
are returned, and with none no row.  Columns of other names are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import saved, scratch_dir, short_batches

#: bound of the sampled pivots, and the rows a cell should have below it
MAX_PIVOTS = 4096
CELL_ROWS = 1024
#: bytes of a shard's vectors (a tree is built and searched in one task)
SHARD_BYTES = 4 << 20
#: points in a leaf, which are compared at once
LEAF_ROWS = 128
#: queries that meet a shard's tree in one group, and those compared at a time
BLOCK_QUERIES = 2048
CHUNK_QUERIES = 256
#: float error of a chord near zero, allowed for in every bound
SLACK = 1e-6
#: cells of this many rows (32 bytes each) are sent to every task; more are joined
MAX_SENT_CELLS = 100_000

_POINT = ("cell long, part int, dim int, pos int, vec_id long, unit array<double>, "
          "ring array<double>")
_FOUND = "query_id long, vec_id long, score double"


# ------------------------------------------------------------------- vectors
def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def unit_vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, dim, unit) of the rows that take part."""
    def run(batches):
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            keep, units = [], []
            sizes = np.diff(np.asarray(vectors.offsets))
            flat = vectors.flatten()  # leaves out what null rows may hold
            sizes = np.where(np.asarray(vectors.is_null()), 0, sizes)
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == dim)
                v = values[starts[rows][:, None] + np.arange(dim)]
                top = np.abs(v).max(axis=1)
                good = np.isfinite(v).all(axis=1) & (top > 0)
                v = v[good] / top[good][:, None]
                keep.append(rows[good])
                units.append((v / np.sqrt((v * v).sum(axis=1))[:, None], int(dim)))
            for rows, (u, dim) in zip(keep, units):
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array(np.full(len(rows), dim, np.int32)),
                     _lists(u)], names=["vec_id", "dim", "unit"])

    narrow = df.select(F.col(id_column).cast("long").alias("vec_id"),
                       F.col(vector_column).cast("array<double>").alias("v"))
    return narrow.where("vec_id IS NOT NULL AND v IS NOT NULL").mapInArrow(
        run, "vec_id long, dim int, unit array<double>")


def _lists(u: np.ndarray) -> pa.Array:
    offsets = np.arange(len(u) + 1, dtype=np.int32) * (u.shape[1] if u.ndim == 2 else 0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                    pa.array(np.ascontiguousarray(u).reshape(-1), pa.float64()))


def one_per_id(vectors: DataFrame) -> DataFrame:
    """Of several vectors with one id the least.  Ids alone are counted; only
    rows of repeated ids are aggregated."""
    repeated = vectors.groupBy("vec_id").count().where("count > 1").select("vec_id")
    if repeated.isEmpty():
        return vectors
    least = vectors.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(
        F.min("unit").alias("unit"))
    return vectors.join(repeated, "vec_id", "left_anti").unionByName(
        least.select("vec_id", F.size("unit").alias("dim"), "unit"))


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


# --------------------------------------------------------------------- trees
def _halves(lo: int, hi: int) -> int:
    """First point of the farther half of the node [lo, hi)."""
    return lo + 1 + (hi - lo) // 2


def build_tree(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tree order of the points, and per place the rings of an inner node (NaN
    elsewhere): least and greatest distance of its nearer and farther half.

    The vantage point is the node's point farthest from its mean."""
    order = np.arange(len(units))
    rings = np.full((len(units), 4), np.nan)
    todo = [(0, len(units))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= LEAF_ROWS:
            continue
        here = units[order[lo:hi]]
        far = lo + int(np.argmin(here @ here.mean(axis=0)))
        order[[lo, far]] = order[[far, lo]]
        d = chord(units[order[lo + 1:hi]] @ units[order[lo]])
        by = np.argsort(d, kind="stable")
        order[lo + 1:hi] = order[lo + 1:hi][by]
        mid = _halves(lo, hi)
        d, n = d[by], mid - lo - 1
        rings[lo] = d[0], d[n - 1], d[n], d[-1]
        todo += [(lo + 1, mid), (mid, hi)]
    return order, rings


class Search:
    """k best points of one tree for a chunk of queries."""

    def __init__(self, ids, units, rings, query_ids, queries, floors, k: int, factor: float):
        self.ids, self.units, self.rings, self.k, self.factor = ids, units, rings, k, factor
        self.query_ids, self.queries = query_ids, queries
        self.best = np.repeat(floors[:, None], k, axis=1)  # scores that the k best must reach
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.compared = 0

    def offer(self, active: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Compare queries with the points [lo, hi); returns the cosines."""
        self.compared += len(active) * (hi - lo)
        cosines = self.queries[active] @ self.units[lo:hi].T
        own = self.query_ids[active][:, None] == self.ids[lo:hi]
        scores = np.where(own, -np.inf, cosines)
        worth = scores >= self.best[active].min(axis=1)[:, None] - SLACK
        worth &= ~own
        q, p = np.nonzero(worth)
        if len(q):
            self.found.append((active[q], lo + p, scores[q, p]))
            merged = np.concatenate([self.best[active], scores], axis=1)
            self.best[active] = -np.partition(-merged, self.k - 1, axis=1)[:, :self.k]
        return cosines

    def near(self, active: np.ndarray, d: np.ndarray, lo: float, hi: float) -> np.ndarray:
        """Which queries can't leave out points at [lo, hi] from a centre at d."""
        bound = np.maximum(np.maximum(lo - d, d - hi), 0.0)
        return self.factor * bound <= reach(self.best[active].min(axis=1)) + SLACK

    def visit(self, lo: int, hi: int, active: np.ndarray) -> None:
        if not len(active):
            return
        if hi - lo <= LEAF_ROWS:
            self.offer(active, lo, hi)
            return
        d, mid = chord(self.offer(active, lo, lo + 1)[:, 0]), _halves(lo, hi)
        ring = self.rings[lo]
        halves = [(lo + 1, mid, ring[0], ring[1]), (mid, hi, ring[2], ring[3])]
        nearer = d <= (ring[1] + ring[2]) / 2
        for at, order in ((nearer, halves), (~nearer, halves[::-1])):
            some, dist = active[at], d[at]
            for start, stop, least, most in order:  # the likelier half first: t shrinks
                self.visit(start, stop, some[self.near(some, dist, least, most)])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, score), at most k per query by score and smaller id.
        Scores are sums of one row each, so equal vectors get equal scores."""
        if not self.found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(0)
        q, p, s = (np.concatenate(x) for x in zip(*self.found))
        worth = s >= self.best.min(axis=1)[q] - SLACK
        q, p = q[worth], p[worth]
        s = np.empty(len(q))
        for i in range(0, len(q), 4096):
            s[i:i + 4096] = (self.queries[q[i:i + 4096]] * self.units[p[i:i + 4096]]).sum(axis=1)
        by = np.lexsort((self.ids[p], -s, q))
        q, p, s = q[by], p[by], s[by]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        return q[place < self.k], p[place < self.k], s[place < self.k]


def reach(score: np.ndarray) -> np.ndarray:
    """Distance within which a better point than ``score`` lies."""
    return np.where(np.isfinite(score), chord(np.maximum(score, -1.0)), np.inf)


# --------------------------------------------------------------------- index
@dataclass
class Forest:
    """An index in the shared folder: points in tree order, shards, cells."""
    spark: SparkSession
    points: DataFrame   # _POINT
    shards: DataFrame   # cell, part, parts
    cells: DataFrame    # cell, dim, lo, hi: bounds from the cell's pivot
    pivots: dict        # dim -> (cell ids, unit vectors); at most MAX_PIVOTS vectors
    folder: str


def build(vectors: DataFrame, folder: str, id_column: str = "vec_id",
          vector_column: str = "embedding") -> Forest:
    spark = vectors.sparkSession
    short_batches(spark)
    units = saved(one_per_id(saved(unit_vectors(vectors, id_column, vector_column),
                                   folder, "all")), folder, "units")
    pivots = _pivots(units)
    located = saved(_located(units, pivots), folder, "located")
    cells = saved(located.groupBy("cell", "dim").agg(
        F.count(F.lit(1)).alias("n"), F.min("away").alias("lo"), F.max("away").alias("hi")),
        folder, "cells")
    parts = cells.select("cell", F.greatest(F.lit(1), F.ceil(
        F.col("n") * F.col("dim") * F.lit(8.0 / SHARD_BYTES))).cast("int").alias("parts"))
    side = F.broadcast(parts) if cells.count() <= MAX_SENT_CELLS else parts

    def plant(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        table = table.sort_by("vec_id")  # the tree doesn't depend on the rows' arrival
        u = _matrix(table["unit"], dim)
        order, rings = build_tree(u)
        flat = pa.array(rings.reshape(-1), pa.float64())
        return pa.table({
            "cell": table["cell"], "part": table["part"], "dim": table["dim"],
            "pos": pa.array(np.arange(len(u), dtype=np.int32)),
            "vec_id": table["vec_id"].take(pa.array(order)), "unit": _lists(u[order]),
            "ring": pa.ListArray.from_arrays(
                pa.array(np.arange(len(u) + 1, dtype=np.int32) * 4), flat,
                mask=pa.array(np.isnan(rings[:, 0])))})

    points = located.join(side, "cell").select(
        "cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"),
        "dim", "vec_id", "unit").groupBy("cell", "part").applyInArrow(plant, _POINT)
    points = saved(points, folder, "points")
    shards = points.where("pos = 0").select("cell", "part").join(side, "cell")
    return Forest(spark, points, saved(shards, folder, "shards"),
                  cells.select("cell", "dim", "lo", "hi"), pivots, folder)


def _pivots(units: DataFrame) -> dict:
    """A sample of fixed bound: ids with the smallest hashes."""
    wanted = min(MAX_PIVOTS, units.count() // CELL_ROWS + 1)
    rows = units.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()
    out: dict = {}
    for cell, row in enumerate(rows):
        cells, vectors = out.setdefault(row["dim"], ([], []))
        cells.append(cell)
        vectors.append(row["unit"])
    return {d: (np.array(c, dtype=np.int64), np.array(v)) for d, (c, v) in out.items()}


def _located(units: DataFrame, pivots: dict) -> DataFrame:
    """Each vector's cell and distance from its pivot.  Vectors of a length that
    no pivot has share a cell of their own, at distance one from the origin."""
    sent = units.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                cell = np.full(len(rows), -1 - int(dim), dtype=np.int64)
                away = np.ones(len(rows))
                if int(dim) in sent.value:
                    cells, p = sent.value[int(dim)]
                    d = chord(_matrix(rows.column(2), int(dim)) @ p.T)
                    nearest = d.argmin(axis=1)
                    cell, away = cells[nearest], d[np.arange(len(d)), nearest]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(cell), pa.array(away)],
                    names=["vec_id", "dim", "unit", "cell", "away"])

    return units.mapInArrow(run, "vec_id long, dim int, unit array<double>, cell long, away double")


# -------------------------------------------------------------------- search
def _met(forest: Forest, queries: DataFrame, sent: DataFrame, k: int,
         factor: float) -> DataFrame:
    """Search the shards that queries were sent to.  ``queries``: query_id, unit,
    floor (score to reach, or null); ``sent``: a written table of query_id, cell,
    part.  Vectors are put to the pairs on their way to the shards only."""
    blocks = sent.groupBy("cell", "part").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK_QUERIES))).cast("int").alias("blocks"))
    blocks = saved(blocks, forest.folder, f"blocks-{_next(forest)}")
    points = forest.points.join(blocks, ["cell", "part"]).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asked = sent.join(blocks, ["cell", "part"]).withColumn(
        "block", F.pmod(F.xxhash64("query_id", F.lit(3)), F.col("blocks")).cast("int")).join(
        queries.select("query_id", "unit", "floor"), "query_id")
    keys = ["cell", "part", "block"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            left, dim = left.sort_by("pos"), left["dim"][0].as_py()
            rings = np.array([r or [np.nan] * 4 for r in left["ring"].to_pylist()])
            ids, units = left["vec_id"].to_numpy(), _matrix(left["unit"], dim)
            right = right.sort_by("query_id")
            q_ids, q = right["query_id"].to_numpy(), _matrix(right["unit"], dim)
            floors = np.array([-np.inf if f is None else f for f in right["floor"].to_pylist()])
            for i in range(0, len(q), CHUNK_QUERIES):
                s = slice(i, i + CHUNK_QUERIES)
                search = Search(ids, units, rings, q_ids[s], q[s], floors[s], k, factor)
                search.visit(0, len(ids), np.arange(len(q[s])))
                at, point, score = search.result()
                out.append((q_ids[s][at], ids[point], score))
        parts = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0)] * 3
        return pa.table({"query_id": pa.array(parts[0], pa.int64()),
                         "vec_id": pa.array(parts[1], pa.int64()),
                         "score": pa.array(parts[2], pa.float64())})

    return points.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, _FOUND)


def _next(forest: Forest) -> int:
    forest.step = getattr(forest, "step", 0) + 1
    return forest.step


def _reachable(forest: Forest, queries: DataFrame, factor: float) -> DataFrame:
    """(query_id, cell) of the cells that the bounds don't rule out; ``floor`` is
    the score to reach.  Cells are at most one per pivot and vector length."""
    cells = [tuple(r) for r in forest.cells.collect()]
    table: dict = {}
    for cell, dim, lo, hi in cells:
        table.setdefault(dim, []).append((cell, lo, hi))
    sent = queries.sparkSession.sparkContext.broadcast(
        (table, {d: dict(zip(c.tolist(), v)) for d, (c, v) in forest.pivots.items()}))

    def run(batches):
        bounds, pivots = sent.value
        for batch in batches:
            dims = batch.column(1).to_numpy()
            floors = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                held = bounds.get(int(dim), [])
                if not held:
                    continue
                u = _matrix(batch.column(2).take(pa.array(rows)), int(dim))
                centre = np.array([pivots.get(int(dim), {}).get(c, np.zeros(int(dim)))
                                   for c, _, _ in held])
                lo, hi = (np.array([x[i] for x in held]) for i in (1, 2))
                d = np.where([c < 0 for c, _, _ in held], 1.0, chord(u @ centre.T))
                bound = np.maximum(np.maximum(lo - d, d - hi), 0.0)
                floor = np.where(np.isnan(floors[rows]), -np.inf, floors[rows])
                q, c = np.nonzero(factor * bound <= reach(floor)[:, None] + SLACK)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows[q])),
                     pa.array(np.array([x[0] for x in held], dtype=np.int64)[c])],
                    names=["query_id", "cell"])

    return queries.select("query_id", "dim", "unit", "floor").mapInArrow(
        run, "query_id long, cell long")


def search(forest: Forest, queries: DataFrame, k: int, factor: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query.
    ``queries``: vec_id, dim, unit, as ``unit_vectors`` and ``one_per_id`` give."""
    queries = saved(_located(queries, forest.pivots).withColumnRenamed("vec_id", "query_id"),
                    forest.folder, f"queries-{_next(forest)}")
    # home: one shard of the query's own cell gives a score to reach
    home = forest.shards.select("cell", "part", "parts")
    sent = queries.join(home, "cell").where(
        F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int") == F.col("part")).select(
        "query_id", "cell", "part")
    sent = saved(sent, forest.folder, f"home-{_next(forest)}")
    first = _met(forest, queries.withColumn("floor", F.lit(None).cast("double")), sent, k, factor)
    first = saved(first, forest.folder, f"first-{_next(forest)}")
    floors = first.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    asking = saved(queries.join(floors, "query_id", "left"), forest.folder,
                   f"asking-{_next(forest)}")
    visited = _reachable(forest, asking, factor).join(home, "cell").join(
        sent, ["query_id", "cell", "part"], "left_anti").select("query_id", "cell", "part")
    rest = saved(visited, forest.folder, f"rest-{_next(forest)}")
    found = first.unionByName(_met(forest, asking, rest, k, factor))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


#: factor of the query; its recall and the share compared are in the README
RELAXED = 5.0
QUERY_STEP = 50
NEIGHBOURS = 5


def op11_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    folder = scratch_dir(spark, "vp-trees")
    forest = build(vectors, folder)
    queries = spark.read.parquet(f"{folder}/units").where(F.col("vec_id") % QUERY_STEP == 0)
    return search(forest, queries, NEIGHBOURS, RELAXED)

"""Helpers shared by the text operators: scratch tables in the cluster's shared
folder, gapless ranks without one hot window, and numpy hashing of the words
of an Arrow string column."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.session import work_root

#: ASCII separators of words (fixed by the data contract): space, \t \n \v \f \r
SPACES = " \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: rows of an Arrow batch handed to Python; texts are long, so batches are short
ARROW_ROWS = 400
#: bytes of text hashed at a time inside a task (a longer text is one chunk)
CHUNK_BYTES = 1 << 20


# --------------------------------------------------------------- scratch data
def short_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: few (long) rows in an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint directory."""
    return f"{work_root(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a
    lost executor costs no recomputation of what came before."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def fresh(name: str, columns: Sequence[str]) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# ------------------------------------------------------------- gapless ranks
def rank_buckets(n_rows: int, rows_per_bucket: int = 20_000) -> int:
    """Hash buckets into which a group is split for ranking, so that a group
    holding a third of ``n_rows`` still has small buckets."""
    return int(max(64, min(1 << 16, n_rows // rows_per_bucket)))


def gapless_rank(df: DataFrame, keys: Sequence[str], spread: Column,
                 order: Sequence[Column], out: str, buckets: int) -> DataFrame:
    """0-based gapless rank within ``keys``, ordered by hash bucket of
    ``spread`` and then by ``order``.

    A plain row_number over ``keys`` puts a hot key into one task.  Here each
    key is split into ``buckets`` parts: their counts give each part's base by
    a running sum over at most ``buckets`` rows, and rows are numbered within
    the part.
    """
    part = F.pmod(F.xxhash64(spread, F.lit(7919)), F.lit(buckets)).cast("int")
    df = df.withColumn("_part", part)
    counts = df.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_base"))
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    ranked = df.withColumn("_row", F.row_number().over(within) - 1)
    return (ranked.join(bases, on)
            .withColumn(out, (F.col("_base") + F.col("_row")).cast("long"))
            .drop("_part", "_p", "_base", "_row", *[f"_k{i}" for i in range(len(keys))]))


# ------------------------------------------------------------ numpy hashing
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (xor-shift-multiply), so that every bit of a sum of
    products reaches every bit of the hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse_odd(p: int) -> int:
    return pow(p, -1, 1 << 64)


class WordHasher:
    """Hashes of words and of k consecutive words, whole chunks at a time.

    A word's hash is a polynomial of random per-byte values modulo 2**64, read
    off a running sum, then mixed; a k-gram's is a sum of its words' hashes
    with random odd multipliers, mixed again.  Equal words give equal hashes on
    every machine (fixed seeds).
    """

    def __init__(self, seed: int, fold_case: bool):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if fold_case:
            self.table = self.table[_FOLD]
        self.base = int(rng.integers(1, 1 << 62)) * 2 + 1
        self.steps = rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._up = self._down = np.ones(0, dtype=np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, CHUNK_BYTES + 1)
            with np.errstate(over="ignore"):
                for name, base in (("_up", self.base), ("_down", _inverse_odd(self.base))):
                    p = np.full(size, np.uint64(base), dtype=np.uint64)
                    p[0] = 1
                    setattr(self, name, np.multiply.accumulate(p))
        return self._up[:n], self._down[:n]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self._powers(len(data) + 1)
        with np.errstate(over="ignore"):
            run = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(self.table[data] * up[:-1], out=run[1:])
            return mix((run[ends] - run[starts]) * down[starts]
                       + (ends - starts).astype(np.uint64))

    def grams(self, words: np.ndarray, k: int) -> np.ndarray:
        """Hash of words[i:i+k] for every i (the caller masks text borders)."""
        n = len(words) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            total = np.zeros(n, dtype=np.uint64)
            for i in range(k):
                total += words[i:i + n] * self.steps[i]
            return mix(total)

    def runs(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of words[s:e] for runs of any length."""
        up, down = self._powers(len(words) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(words) + 1, dtype=np.uint64)
            np.cumsum(words * up[:-1], out=total[1:])
            return mix((total[ends] - total[starts]) * down[starts]
                       + (ends - starts).astype(np.uint64))


def text_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into them) of about CHUNK_BYTES each; a
    null text has no bytes."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[
        column.offset:column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield row, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words of a chunk, and the number
    of words before each row (len(rows) + 1 values)."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    after = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = False
        before[1:] = solid[:-1]
        after[-1] = False
        after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))

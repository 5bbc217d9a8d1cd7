"""Pack token sequences by cutting-stock column generation.

Every document is tokenised and ended by ``END``; it is cut into whole
sequences of ``capacity`` ids and one remainder.  How many remainders there are
of each length (at most ``capacity - 1`` lengths, so a table of bounded size)
is all the optimiser sees:

* the linear program "as few sequences as possible, every length covered" is
  solved by column generation: a knapsack dynamic program over the capacity,
  with the duals as prices, finds the pattern to add, until none improves,
  the bound on the optimum is within ``GAP``, or 60 pivots are made;
* pattern counts are rounded down; what is left over (less than one sequence a
  basis pattern) is packed one sequence at a time by the same knapsack;
* pieces are ranked within their length, and rank ranges map them to patterns,
  sequences and offsets by integer arithmetic.

Token ids never leave the task that made them.  Ranking is split by hash
buckets, so a length that a third of all pieces share is no hot group.

Defined cases: null text is empty text (one piece with the end id alone);
strings of special tokens in a text (``<|endoftext|>``) are ordinary text;
repeated rows are documents of their own and are all packed; an empty table
gives no piece; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import (documents, gapless_rank, rank_buckets, saved, scratch_dir,
                                   short_batches)
from ledgerline.llm.mixing import knapsack

CAPACITY = 1024
END = 0
GAP = 1e-3
#: vocabulary file (ranks) of the byte-level BPE with 50,257 ids
TOKENIZER = "byte_bpe_50k.tiktoken"
CACHED_UNITS = 200_000
CACHED_LENGTH = 40
_BREAK_IN_SPACE = re.compile(r"\s ")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class UnitTokens(dict):
    """Ids (little-endian uint32 bytes) of a space and what follows it up to the
    next space.  No token spans the border before a space that ends a run of
    other characters, so a text's ids are its units' ids joined."""

    def __init__(self, path: str):
        super().__init__()
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                          mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        return np.asarray(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def __missing__(self, unit: str) -> bytes:
        ids = self.encode(" " + unit)
        if len(self) < CACHED_UNITS and len(unit) <= CACHED_LENGTH:
            self[unit] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if _BREAK_IN_SPACE.search(text):
            return self.encode(text)
        units = text.split(" ")
        return self.encode(units[0]) + b"".join(map(self.__getitem__, units[1:]))


def unit_tokens(path: str) -> UnitTokens:
    """One vocabulary per worker process, kept between tasks."""
    kept = sys.modules.setdefault("_unit_tokens", type(sys)("_unit_tokens"))
    if getattr(kept, "path", None) != path:
        kept.tokens, kept.path = UnitTokens(path), path
    return kept.tokens


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): whole sequences and one
    remainder of every row."""
    short_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tokens = unit_tokens(path)
        end = np.asarray([END], dtype="<u4").tobytes()
        for batch in batches:
            row, start, length, crc, whole = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = (tokens.ids(text) if text else b"") + end
                n = len(data) // 4
                for at in range(0, n, capacity):
                    part = data[4 * at:4 * (at + capacity)]
                    row.append(i)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    whole.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64()))]
                + [pa.array(v, pa.int64()) for v in (start, length, crc, whole)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


# ------------------------------------------------------------ column generation
def price(lengths: np.ndarray, duals: np.ndarray, limits: np.ndarray,
          capacity: int) -> tuple[float, np.ndarray]:
    """Best pattern for the duals: a bounded knapsack over 0..capacity, each
    length at most ``limits`` times (copies in powers of two)."""
    items: list[tuple[int, int]] = []
    for i in np.flatnonzero(duals > 1e-12):
        left = min(int(limits[i]), capacity // int(lengths[i]))
        copies = 1
        while left > 0:
            copies = min(copies, left)
            items.append((int(i), copies))
            left -= copies
            copies *= 2
    best = np.zeros(capacity + 1)
    take = np.zeros((len(items), capacity + 1), dtype=bool)
    for j, (i, copies) in enumerate(items):
        words = copies * int(lengths[i])
        values = best[:-words] + copies * duals[i]
        better = values > best[words:] + 1e-12
        take[j, words:] = better
        best[words:] = np.where(better, values, best[words:])
    pattern = np.zeros(len(lengths), dtype=np.int64)
    c = capacity
    for j in range(len(items) - 1, -1, -1):
        if take[j, c]:
            i, copies = items[j]
            pattern[i] += copies
            c -= copies * int(lengths[i])
    return float(best[capacity]), pattern


def starting_basis(lengths: np.ndarray, demand: np.ndarray,
                   capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A feasible basis, its inverse and its uses: again and again the longest length left, its sequence
    filled up by a knapsack of what is left, used until a length runs out.  Every
    column exhausts one length, so the columns are triangular in that order."""
    m = len(lengths)
    left = demand.astype(float)
    columns, uses = [], []
    place = {int(n): i for i, n in enumerate(lengths)}
    while len(columns) < m:
        open_ = [i for i in range(m - 1, -1, -1) if left[i] > 0]
        top = open_[0]
        counts = [max(1, int(left[i])) - (i == top) for i in open_]
        sizes = [int(lengths[i]) for i in open_]
        pattern = np.zeros(m)
        pattern[top] = 1
        for size, n in zip(sizes, knapsack(sizes, counts, capacity - sizes[0])):
            pattern[place[size]] += n
        inside = pattern > 0
        ratio = np.where(inside, left / np.where(inside, pattern, 1.0), np.inf)
        out = int(ratio.argmin())
        left = left - ratio[out] * pattern
        left[out] = 0.0
        left[(left < 1e-9) & ~inside] = 0.0
        # two lengths that run out at once: the second gets an (unused) column later
        left[inside & (left < 1e-9) & (np.arange(m) != out)] = 1e-9
        columns.append((out, pattern))
        uses.append((out, float(ratio[out])))
    basis, inverse, amounts = np.zeros((m, m)), np.zeros((m, m)), np.zeros(m)
    for (out, pattern), (_, use) in zip(reversed(columns), reversed(uses)):
        basis[:, out], amounts[out] = pattern, use
        column = np.zeros(m)  # of the inverse: later columns are solved already
        column[out] = 1.0
        for j in np.flatnonzero(pattern):
            if j != out:
                column -= pattern[j] * inverse[:, j]
        inverse[:, out] = column / pattern[out]
    return basis, inverse, amounts


def generate_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int,
                      gap: float = GAP, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, fractional uses) of the covering program, after at
    most ``rounds`` pivots from the starting basis."""
    basis, inverse, uses = starting_basis(lengths, demand, capacity)
    floor = float((lengths * demand).sum()) / capacity
    bound = floor
    for _ in range(rounds):
        total = float(uses.sum())
        if total <= max(bound * (1 + gap), bound + 1.0):
            break
        duals = inverse.sum(axis=0)
        value, pattern = price(lengths, duals, demand, capacity)
        bound = max(bound, total / max(value, 1e-12))
        worth = float(duals @ pattern)
        if worth <= 1 + 1e-9 or total <= max(bound * (1 + gap), bound + 1.0):
            break
        inside = np.flatnonzero(pattern)
        column = (inverse[:, inside] * pattern[inside]).sum(axis=1)
        positive = column > 1e-9
        if not positive.any():
            break
        ratio = np.where(positive, uses / np.where(positive, column, 1.0), np.inf)
        out = int(ratio.argmin())
        t = max(0.0, float(ratio[out]))
        uses = uses - t * column
        uses[out] = t
        pivot = inverse[out] / column[out]
        inverse -= np.outer(column, pivot)
        inverse[out] = pivot
        basis[:, out] = pattern
    return basis, uses


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict, int]]:
    """[(pieces of each length in a sequence, sequences)] that use up the
    histogram exactly."""
    left = {int(k): int(n) for k, n in histogram.items() if n > 0}
    plan: list[tuple[dict, int]] = []
    whole = left.pop(capacity, 0)
    if whole:
        plan.append(({capacity: 1}, whole))
    if not left:
        return plan
    lengths = np.array(sorted(left), dtype=np.int64)
    demand = np.array([left[int(k)] for k in lengths], dtype=np.int64)
    basis, uses = generate_patterns(lengths, demand, capacity)
    rest = demand.copy()
    for j in np.argsort(-uses, kind="stable"):
        pattern = np.rint(basis[:, j]).astype(np.int64)
        inside = pattern > 0
        if not inside.any():
            continue
        n = min(int(uses[j] + 1e-6), int((rest[inside] // pattern[inside]).min()))
        if n > 0:
            rest -= n * pattern
            plan.append(({int(lengths[i]): int(pattern[i]) for i in np.flatnonzero(inside)}, n))
    # leftovers: less than a sequence per basis pattern
    rest_counts = {int(k): int(n) for k, n in zip(lengths, rest) if n > 0}
    while rest_counts:
        longest = max(rest_counts)
        one = {longest: 1}
        _use(rest_counts, longest, 1)
        sizes = sorted(rest_counts, reverse=True)
        for size, n in zip(sizes, knapsack(sizes, [rest_counts[s] for s in sizes],
                                           capacity - longest)):
            if n:
                one[size] = one.get(size, 0) + n
                _use(rest_counts, size, n)
        plan.append((one, 1))
    return plan


def _use(counts: dict, key: int, n: int) -> None:
    counts[key] -= n
    if not counts[key]:
        del counts[key]


def rank_ranges(plan: list[tuple[dict, int]]) -> list[tuple]:
    """(length, first rank, last rank, pieces a sequence, first sequence, first
    offset): where the ranked pieces of a length go."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            a = pattern[length]
            lo = used.get(length, 0)
            used[length] = lo + a * n
            rows.append((length, lo, lo + a * n - 1, a, sequence, offset))
            offset += a * length
        sequence += n
    return rows


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence_id and offset."""
    spark = docs.sparkSession
    folder = scratch_dir(spark, "pack")
    cut = saved(pieces(docs, path or tokenizer_path(), capacity), folder, "pieces")
    histogram = {r["length"]: r["n"] for r in  # at most ``capacity`` rows
                 cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranges = spark.createDataFrame(
        rank_ranges(packing_plan(histogram, capacity)),
        "_length long, _lo long, _hi long, _a long, _sequence long, _offset long")
    ranked = gapless_rank(cut, ["length"], F.struct("doc_id", "start"),
                          [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], "_rank",
                          rank_buckets(sum(histogram.values())))
    on = ((F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo"))
          & (F.col("_rank") <= F.col("_hi")))
    within = F.col("_rank") - F.col("_lo")
    return (ranked.join(F.broadcast(ranges), on)  # bounded by the capacity, not the data
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                    (F.col("_sequence") + F.floor(within / F.col("_a"))).cast("long")
                    .alias("sequence_id"),
                    (F.col("_offset") + F.pmod(within, F.col("_a")) * F.col("length"))
                    .cast("long").alias("offset")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir, "doc_id", "text"))

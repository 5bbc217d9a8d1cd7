"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text is cut into paragraphs (lines, and within a line after words whose hash
is a multiple of ``BREAK``, so that an edit changes few of them); each distinct
paragraph has a 64-bit digest.  The sketch has three parts of ``cells`` cells;
a digest is counted and xor-ed into one cell of each part, beside the xor of a
check value.  Equal texts have equal sketches.

Two versions are compared by subtracting their sketches cell by cell: what
both hold cancels out.  Cells that hold one digest are peeled off until nothing
is left, which yields the digests that only one side has.  If peeling gets
stuck, the sketch was too small for the difference and is tried again four
times as large, until it succeeds; so the likeness, shared paragraphs over all
paragraphs, is exact.

``sketches`` gives a version's sketches as a table to keep; ``subtract`` peels
the digests out of two such tables, and says which rows need larger sketches;
``difference`` makes these for the rows that need them, until all are decoded.

The next document (descending doc_id, the last one's is the first) is met
without a global sort: quantiles of doc_id cut the table into buckets, the top
row of every bucket is also sent to the bucket before it, and rows are sorted
within their bucket.

Defined cases: null text is empty; texts without a word have no paragraph and
are alike (1.0); equal doc_ids are ordered by their text's hash; null doc_ids
come last; a lone document is its own next one.  In tables of sketches null
doc_ids take no part, of rows that repeat a doc_id the one with the smallest
text hash counts, and a document that only one version has differs by all its
paragraphs.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import (WordHasher, documents, list_array, mix, saved, scratch_dir,
                                   short_batches, text_chunks, word_bounds)

CELLS = 8
PARTS = 3
BREAK = 8
_SEED = 20250611
_CHECK = np.uint64(0xA0761D6478BD642F)
_PART_SEEDS = np.array([0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
#: digests sketched at a time inside a task
_ITEMS = 400_000


def paragraphs(hasher: WordHasher, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, digest) of the distinct paragraphs of every text, by row."""
    rows, digests = [], []
    for first, data, offsets in text_chunks(column):
        starts, ends, before = word_bounds(data, offsets)
        if not len(starts):
            continue
        words = hasher.words(data, starts, ends)
        lines = np.cumsum(data == 10)
        last = np.zeros(len(words), dtype=bool)  # words that end a paragraph
        last[:-1] = lines[starts[1:]] != lines[starts[:-1]]
        last |= (words % np.uint64(BREAK)) == 0
        counts = np.diff(before)
        last[before[1:][counts > 0] - 1] = True
        stop = np.flatnonzero(last) + 1
        start = np.r_[0, stop[:-1]]
        owner = np.repeat(np.arange(len(counts)), counts)[start]
        own = hasher.runs(words, start, stop)
        order = np.lexsort((own, owner))
        owner, own = owner[order], own[order]
        new = np.r_[True, (owner[1:] != owner[:-1]) | (own[1:] != own[:-1])]
        rows.append(owner[new] + first)
        digests.append(own[new])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(digests)


class Sketch:
    """Sketches of many rows side by side: cells of shape (rows, parts * cells)."""

    def __init__(self, n_rows: int, cells: int):
        self.cells = cells
        size = n_rows * PARTS * cells
        self.count = np.zeros(size, dtype=np.int64)
        self.key = np.zeros(size, dtype=np.uint64)
        self.check = np.zeros(size, dtype=np.uint64)

    def places(self, rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
        base = rows.astype(np.int64) * (PARTS * self.cells)
        mask = np.uint64(self.cells - 1)
        return np.stack([base + p * self.cells + (mix(keys ^ _PART_SEEDS[p]) & mask).astype(np.int64)
                         for p in range(PARTS)])

    def add(self, rows: np.ndarray, keys: np.ndarray, signs) -> None:
        if not len(keys):
            return
        checks = mix(keys ^ _CHECK)
        for place in self.places(rows, keys):
            np.add.at(self.count, place, signs)
            np.bitwise_xor.at(self.key, place, keys)
            np.bitwise_xor.at(self.check, place, checks)

    def minus(self, other: "Sketch") -> "Sketch":
        out = Sketch(0, self.cells)
        out.count = self.count - other.count
        out.key, out.check = self.key ^ other.key, self.check ^ other.check
        return out

    def text(self, row: int, n: int) -> str:
        part = slice(row * PARTS * self.cells, (row + 1) * PARTS * self.cells)
        data = (self.count[part].astype("<i4").tobytes() + self.key[part].astype("<u8").tobytes()
                + (self.check[part] >> np.uint64(32)).astype("<u4").tobytes())
        return f"{n}:{base64.b64encode(data).decode()}"

    def dump(self, row: int) -> bytes:
        part = slice(row * PARTS * self.cells, (row + 1) * PARTS * self.cells)
        return (self.count[part].astype("<i8").tobytes() + self.key[part].astype("<u8").tobytes()
                + self.check[part].astype("<u8").tobytes())

    @classmethod
    def load(cls, dumps: list[bytes | None], cells: int) -> "Sketch":
        """Sketches side by side; None is an empty one."""
        out = cls(len(dumps), cells)
        width = PARTS * cells
        for row, data in enumerate(dumps):
            if data is not None:
                part = slice(row * width, (row + 1) * width)
                out.count[part], out.key[part], out.check[part] = (
                    np.frombuffer(data, kind, width, at * 8 * width)
                    for at, kind in enumerate(("<i8", "<u8", "<u8")))
        return out

    def peel(self, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(decoded, digests only left, digests only right) of every row."""
        done, rows, _, signs = self.recover(n_rows)
        return (done, np.bincount(rows[signs > 0], minlength=n_rows),
                np.bincount(rows[signs < 0], minlength=n_rows))

    def recover(self, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(decoded, by row; row, digest and side of the differing digests: 1
        for the left version only, -1 for the right one only)."""
        width = PARTS * self.cells
        found = []
        while True:
            pure = np.flatnonzero((np.abs(self.count) == 1) & (self.check == mix(self.key ^ _CHECK)))
            if not len(pure):
                break
            rows, keys, signs = pure // width, self.key[pure], self.count[pure]
            order = np.lexsort((keys, rows))
            rows, keys, signs = rows[order], keys[order], signs[order]
            one = np.r_[True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])]
            rows, keys, signs = rows[one], keys[one], signs[one]
            found.append((rows, keys, signs))
            self.add(rows, keys, -signs)
        dirty = (self.count != 0) | (self.key != 0) | (self.check != 0)
        rows, keys, signs = (np.concatenate([f[i] for f in found]) if found else
                             np.zeros(0, kind) for i, kind in enumerate(
                                 (np.int64, np.uint64, np.int64)))
        return ~dirty.reshape(n_rows, width).any(axis=1), rows, keys, signs


def likeness(rows_a, keys_a, rows_b, keys_b, n_rows: int, first: Sketch | None = None) -> np.ndarray:
    """Shared over all paragraphs of each row's two texts, by subtraction and
    peeling; rows that don't decode are tried again with larger sketches."""
    na, nb = np.bincount(rows_a, minlength=n_rows), np.bincount(rows_b, minlength=n_rows)
    only_a = np.zeros(n_rows, np.int64)
    open_ = np.arange(n_rows)
    cells = CELLS
    while len(open_):
        if first is not None:
            diff, first = first, None
        else:
            place = np.full(n_rows, -1)
            place[open_] = np.arange(len(open_))
            diff = Sketch(len(open_), cells)
            for rows, keys, sign in ((rows_a, keys_a, 1), (rows_b, keys_b, -1)):
                mine = place[rows] >= 0
                diff.add(place[rows[mine]], keys[mine], sign)
        done, left, _ = diff.peel(len(open_))
        only_a[open_[done]] = left[done]
        open_ = open_[~done]
        cells *= 4
    shared = na - only_a
    union = nb + only_a
    return np.where(union > 0, shared / np.maximum(union, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the following text's start."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


# ------------------------------------------------------------- kept sketches
def _blocks(n_rows: int, cells: int):
    """Row ranges whose sketches fit a task's memory together."""
    step = max(1, _ITEMS // (PARTS * cells))
    return [(at, min(n_rows, at + step)) for at in range(0, n_rows, step)]


def sketches(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """(doc_id, cells, n_paragraphs, sketch) of a version, a row per doc_id;
    ``cells`` is a power of two."""
    short_batches(docs.sparkSession)

    def run(batches):
        hasher = WordHasher(_SEED, fold_case=False)
        for batch in batches:
            for lo, hi in _blocks(len(batch.column(0)), cells):
                part = batch.slice(lo, hi - lo)
                rows, keys = paragraphs(hasher, part.column(1))
                sketch = Sketch(hi - lo, cells)
                sketch.add(rows, keys, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2),
                     pa.array(np.bincount(rows, minlength=hi - lo), pa.int64()),
                     pa.array([sketch.dump(i) for i in range(hi - lo)], pa.binary())],
                    names=["doc_id", "th", "n_paragraphs", "sketch"])

    rows = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    made = rows.mapInArrow(run, "doc_id long, th long, n_paragraphs long, sketch binary")
    one = made.groupBy("doc_id").agg(F.min(F.struct("th", "n_paragraphs", "sketch")).alias("s"))
    return one.select("doc_id", F.lit(cells).alias("cells"), "s.n_paragraphs", "s.sketch")


def subtract(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, decoded, removed, added) of two tables of sketches with equal
    cells: the digests that only the old or the new version has, ascending;
    null where the sketches are too small for the difference."""
    left = old.select("doc_id", F.col("cells").alias("c1"), F.col("sketch").alias("s1"))
    right = new.select("doc_id", F.col("cells").alias("c2"), F.col("sketch").alias("s2"))
    pairs = left.join(right, "doc_id", "full").select("doc_id", "c1", "c2", "s1", "s2")

    def run(batches):
        for batch in batches:
            ids, c1, c2, s1, s2 = (column.to_pylist() for column in batch.columns)
            widths = {c for c in c1 + c2 if c is not None}
            if len(widths) > 1:
                raise ValueError(f"sketches of different sizes: {sorted(widths)}")
            for lo, hi in _blocks(len(ids), max(widths, default=1)):
                n, cells = hi - lo, max(widths)
                diff = Sketch.load(s1[lo:hi], cells).minus(Sketch.load(s2[lo:hi], cells))
                done, rows, keys, signs = diff.recover(n)
                out = [pa.array(ids[lo:hi], pa.int64()), pa.array(done)]
                digests = keys.view(np.int64)
                for side in (1, -1):
                    mine = (signs == side) & done[rows]
                    order = np.lexsort((digests[mine], rows[mine]))
                    counts = np.bincount(rows[mine], minlength=n)
                    lists = list_array(digests[mine][order], counts, pa.int64())
                    out.append(pc.if_else(pa.array(done), lists, pa.scalar(None, lists.type)))
                yield pa.RecordBatch.from_arrays(
                    out, names=["doc_id", "decoded", "removed", "added"])

    return pairs.mapInArrow(
        run, "doc_id long, decoded boolean, removed array<long>, added array<long>")


def difference(old: DataFrame, new: DataFrame, cells: int = CELLS) -> DataFrame:
    """(doc_id, removed, added): digests of the paragraphs in which two versions
    of the documents differ.  Rows that don't decode are sketched again four
    times as large; each round only reads these rows' texts."""
    folder = scratch_dir(old.sparkSession, "difference")
    found = None
    while True:
        diff = saved(subtract(sketches(old, cells), sketches(new, cells)), folder, f"cells-{cells}")
        done = diff.where("decoded").select("doc_id", "removed", "added")
        found = done if found is None else found.unionAll(done)
        open_ = diff.where("NOT decoded").select(F.col("doc_id").alias("open_id"))
        if not open_.limit(1).count():
            return found
        old, new = (docs.select("doc_id", "text").join(
            open_, F.col("doc_id").cast("long") == F.col("open_id"), "left_semi")
            for docs in (old, new))
        cells *= 4


# --------------------------------------------------------------- row neighbours
def _bucketed(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows with their bucket of doc_id; the top row of each bucket once more
    (``extra``) in the bucket above it, the overall top in the lowest."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = 4 * parts
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.xxhash64("text").alias("th"))
    bounds = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"),
                                          [i / wanted for i in range(1, wanted)], 10_000)
                      .alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)] or [[0]]
    table = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups])
    heads = F.array(*[F.lit(g[-1]).cast("long") for g in groups])
    coarse = F.size(F.filter(heads, lambda x: x < F.col("doc_id")))
    fine = F.size(F.filter(F.coalesce(F.get(table, coarse), F.array().cast("array<long>")),
                           lambda x: x < F.col("doc_id")))
    rows = rows.withColumn("bucket", (coarse * step + fine).cast("int"))
    tops = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "th")).alias("t")) \
        .orderBy("bucket").collect()  # at most ``wanted`` rows
    sent = [(low["t"]["doc_id"], low["t"]["th"], high["bucket"])
            for low, high in zip(tops, tops[1:])]
    if tops:
        sent.append((tops[-1]["t"]["doc_id"], tops[-1]["t"]["th"], tops[0]["bucket"]))
    tops_table = spark.createDataFrame(sent, "_id long, _th long, _to int")
    joined = rows.join(F.broadcast(tops_table), (F.col("doc_id") == F.col("_id"))
                       & (F.col("th") == F.col("_th")), "left")
    places = F.when(F.col("_to").isNull(), F.array(F.struct(
        F.col("bucket").alias("bucket"), F.lit(0).alias("extra")))).otherwise(F.array(
            F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("extra")),
            F.struct(F.col("_to").alias("bucket"), F.lit(1).alias("extra"))))
    out = joined.select("doc_id", "text", "th", F.explode(places).alias("at")).select(
        F.col("at.bucket").alias("bucket"), F.col("at.extra").alias("extra"), "doc_id", "text", "th")
    return out, parts


def compare_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and both likenesses."""
    spark = docs.sparkSession
    short_batches(spark)
    rows, parts = _bucketed(docs)
    ordered = (rows.repartition(parts, "bucket")
               .sortWithinPartitions("bucket", "extra", F.desc_nulls_last("doc_id"), F.desc("th"))
               .select("bucket", "extra", "doc_id", "text"))

    def run(batches):
        hasher = WordHasher(_SEED, fold_case=False)
        held = None  # the last row of the batch before: its next row is to come
        for batch in batches:
            rows = list(zip(*[batch.column(i).to_pylist() for i in range(4)]))
            if held is not None:
                rows.insert(0, held)
            held = rows[-1] if rows else held
            pairs = [(r[2], r[3] or "", (n[3] if n[0] == r[0] else r[3]) or "")
                     for r, n in zip(rows, rows[1:]) if not r[1]]
            yield from _compared(hasher, pairs)
        if held is not None and not held[1]:
            yield from _compared(hasher, [(held[2], held[3] or "", held[3] or "")])

    return ordered.mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")


def _compared(hasher: WordHasher, pairs: list[tuple]):
    size = 0
    block: list[tuple] = []
    for pair in pairs:  # bounded blocks: sketches of long texts are wide
        block.append(pair)
        size += len(pair[1]) + len(pair[2])
        if size > 8 * _ITEMS:
            yield _compared_block(hasher, block)
            block, size = [], 0
    if block:
        yield _compared_block(hasher, block)


def _compared_block(hasher: WordHasher, pairs: list[tuple]) -> pa.RecordBatch:
    n = len(pairs)
    changed = [edited(text, following) for _, text, following in pairs]
    sides = [paragraphs(hasher, pa.array(texts, pa.large_string()))
             for texts in ([p[1] for p in pairs], changed, [p[2] for p in pairs])]
    sketches = []
    for rows, keys in sides:
        sketch = Sketch(n, CELLS)
        sketch.add(rows, keys, 1)
        sketches.append(sketch)
    own, other, following = sides
    counts = [np.bincount(rows, minlength=n) for rows, _ in sides]
    near_edited = likeness(*own, *other, n, sketches[0].minus(sketches[1]))
    near_next = likeness(*own, *following, n, sketches[0].minus(sketches[2]))
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in pairs], pa.int64()),
         pa.array([len(p[1]) for p in pairs], pa.int64()),
         pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
         pa.array([sketches[0].text(i, int(counts[0][i])) for i in range(n)], pa.string()),
         pa.array([sketches[1].text(i, int(counts[1][i])) for i in range(n)], pa.string()),
         pa.array(near_edited, pa.float64()), pa.array(near_next, pa.float64())],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
               "near_edited", "near_next"])


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(documents(spark, sf_dir, "doc_id", "text"))

"""Substring dedup: join documents on winnowed anchors, compare windows, cut repeats.

Seed: of every ``window`` consecutive words the smallest ``k``-gram hash is the
window's anchor, so two documents that share ``window`` words share an anchor
at the same place in them.  Anchors that only one document holds end there.

In place of an extension word by word: around an anchor shared with another
document a repeat reaches the threshold length only through one of the windows whose anchor it is, to the
left or to the right of it.  These windows are compared across documents by
the 64-bit hash of all their words (not verified on the words); the smallest doc_id that holds a window keeps it.
Neighbouring windows that match join to maximal repeats (at least ``window``
words), whose words are removed.  No pair of documents is ever formed: a
passage in a third of all documents costs one row per window and document.

Whole texts that repeat (same words in the same order) are settled first by
their digest where these are few enough to ship; else they go the way above.

Defined cases: null or empty text has no word; fewer words than a window are
never cut; a null doc_id neither cuts nor is cut; rows that repeat a doc_id are
one document (each row is cut alike); only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import (WordHasher, documents, list_array, saved, scratch_dir,
                                   short_batches, text_chunks, word_bounds)

WINDOW = 13
SEED_WORDS = 4
_SEED = 20250507
#: shared anchors are shipped to the second scan up to this many (8 bytes each)
SHIPPED_ANCHORS = 8_000_000
#: digests of repeated whole texts are shipped up to this many (16 bytes each)
SHIPPED_TEXTS = 2_000_000


def text_digest(text: bytes | None) -> bytes:
    """128 bits over the text's words."""
    return xxhash.xxh3_128_digest(b" ".join((text or b"").split()))


def _rows(column: pa.Array, hasher: WordHasher, window: int, k: int, whole: bool):
    """(row, anchors of its windows, window hashes or None) of the rows that
    have a window."""
    span = window - k + 1
    for first, data, offsets in text_chunks(column):
        starts, ends, before = word_bounds(data, offsets)
        words = hasher.words(data, starts, ends)
        grams = hasher.grams(words, k)
        if len(grams) < span:
            continue
        places = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1)
        anchors = grams[places + np.arange(len(places))]
        hashes = hasher.grams(words, window) if whole else None
        for i in range(len(offsets) - 1):
            lo, hi = int(before[i]), int(before[i + 1]) - window + 1
            if hi > lo:
                yield first + i, anchors[lo:hi], hashes[lo:hi] if whole else None


def anchors_of(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(doc_id, digest, anchors): winnowed anchors, each once per row."""
    def run(batches):
        hasher = WordHasher(_SEED, fold_case=False)
        for batch in batches:
            size = len(batch.column(0))
            counts, kept = np.zeros(size, dtype=np.int64), []
            for row, anchors, _ in _rows(batch.column(1), hasher, window, k, whole=False):
                own = np.unique(anchors)
                counts[row] = len(own)
                kept.append(own)
            values = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
            digests = [text_digest(t) for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()),
                 list_array(values.view(np.int64), counts, pa.int64())],
                names=["doc_id", "digest", "anchors"])
    return docs.mapInArrow(run, "doc_id long, digest binary, anchors array<long>")


def windows_of(docs: DataFrame, window: int, k: int, shared, copies) -> DataFrame:
    """(doc_id, h): hashes of the windows whose anchor is shared.  ``shared`` is
    a shipped sorted array, or None where each row carries its own anchors."""
    def run(batches):
        hasher = WordHasher(_SEED, fold_case=False)
        known = shared.value if shared is not None else None
        first = copies.value if copies is not None else {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.large_binary()).to_pylist() if first else None
            own = batch.column(2) if known is None else None
            rows, counts, kept = [], [], []
            for row, anchors, hashes in _rows(batch.column(1), hasher, window, k, whole=True):
                if first and first.get(text_digest(texts[row]), ids[row]) != ids[row]:
                    continue  # a copy: settled by its digest
                held = known if known is not None else np.sort(
                    own[row].values.to_numpy(zero_copy_only=False).view(np.uint64))
                names, back = np.unique(anchors, return_inverse=True)
                at = np.minimum(np.searchsorted(held, names), max(0, len(held) - 1))
                hit = (held[at] == names) if len(held) else np.zeros(len(names), bool)
                wanted = np.unique(hashes[hit[back]])
                if len(wanted):
                    rows.append(row)
                    counts.append(len(wanted))
                    kept.append(wanted)
            values = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array([ids[r] for r in rows], np.int64),
                                    np.array(counts, np.int64)), pa.int64()),
                 pa.array(values.view(np.int64))], names=["doc_id", "h"])
    return docs.mapInArrow(run, "doc_id long, h long")


def cut_repeats(docs: DataFrame, window: int = WINDOW, k: int = SEED_WORDS) -> DataFrame:
    """``docs`` (doc_id, text) with the kept words joined by a space as
    ``kept_text``, n_words and n_removed."""
    spark = docs.sparkSession
    short_batches(spark)
    folder = scratch_dir(spark, "repeats")
    docs = docs.select("doc_id", "text")
    keyed = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    rows = saved(anchors_of(keyed, window, k), folder, "anchors")

    # whole texts that repeat: digest -> smallest doc_id
    texts = saved(rows.groupBy("digest").agg(F.min("doc_id").alias("first"),
                                             F.max("doc_id").alias("last"))
                  .where("first < last"), folder, "texts")
    copies = None
    if texts.count() <= SHIPPED_TEXTS:
        copies = spark.sparkContext.broadcast(
            {bytes(r["digest"]): r["first"] for r in texts.select("digest", "first").collect()})
        rows = rows.join(F.broadcast(texts), "digest", "left").where(
            "first IS NULL OR doc_id = first").select("doc_id", "anchors")

    postings = rows.select("doc_id", F.explode("anchors").alias("anchor"))
    shared = saved(postings.groupBy("anchor").agg(F.min("doc_id").alias("lo"),
                                                  F.max("doc_id").alias("hi"))
                   .where("lo < hi").select("anchor"), folder, "shared")
    if shared.count() <= SHIPPED_ANCHORS:
        held = np.sort(shared.toArrow().column(0).to_numpy().view(np.uint64))
        known, source = spark.sparkContext.broadcast(held), keyed
    else:
        lists = postings.join(shared, "anchor").groupBy("doc_id").agg(
            F.collect_set("anchor").alias("anchors"))
        known, source = None, keyed.join(lists, "doc_id")
    windows = saved(windows_of(source, window, k, known, copies), folder, "windows")
    repeated = saved(windows.groupBy("h").agg(F.min("doc_id").alias("lo"),
                                              F.max("doc_id").alias("hi"))
                     .where("lo < hi").select("h", "lo"), folder, "repeated")
    cuts = saved(windows.join(repeated, "h").where("doc_id > lo").groupBy("doc_id")
                 .agg(F.collect_set("h").alias("cut")), folder, "cuts")
    return _cut(docs, cuts, copies, window)


def _cut(docs: DataFrame, cuts: DataFrame, copies, window: int) -> DataFrame:
    named = cuts.select(F.col("doc_id").alias("_id"), "cut")
    joined = docs.join(named.hint("shuffle_hash"), docs["doc_id"].cast("long") == F.col("_id"),
                       "left").select(docs["doc_id"], "text", "cut")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        hasher = WordHasher(_SEED, fold_case=False)
        first = copies.value if copies is not None else {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            cut = batch.column(2)
            n_words, n_removed, kept = [], [], []
            for i, text in enumerate(texts):
                words = (text or b"").split()
                n = len(words)
                gone = 0
                if n >= window and ids[i] is not None:
                    if first and first.get(text_digest(text), ids[i]) < ids[i]:
                        words, gone = [], n
                    elif cut[i].is_valid:
                        words = _left(hasher, text, words, cut[i], window)
                        gone = n - len(words)
                n_words.append(n)
                n_removed.append(gone)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()),
                 pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                names=["doc_id", "kept_text", "n_words", "n_removed"])

    return joined.mapInArrow(
        run, f"doc_id {kind}, kept_text string, n_words long, n_removed long")


def _left(hasher: WordHasher, text: bytes, words: list, cut: pa.ListScalar, window: int) -> list:
    """The words outside the maximal repeats: the union of the cut windows."""
    data = np.frombuffer(text, dtype=np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
    hashes = hasher.grams(hasher.words(data, starts, ends), window)
    gone = np.isin(hashes, cut.values.to_numpy(zero_copy_only=False).view(np.uint64))
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(gone)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return [w for w, c in zip(words, covered.tolist()) if not c]


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cut_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed",
                       F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                             lambda x: x <> '') AS w
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), first_holder AS (
  SELECT g, min(doc_id) AS lo FROM win GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p
  FROM (SELECT win.doc_id, win.i, unnest(range(0, 13)) AS j
        FROM win JOIN first_holder f ON win.g = f.g WHERE f.lo < win.doc_id)
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p
  WHERE gone.p IS NULL GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
       CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

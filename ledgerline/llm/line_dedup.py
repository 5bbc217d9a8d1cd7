"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

A line's key is the line without ASCII space at both ends, A-Z lower-cased;
keys of at least ``min_chars`` code points count.  ``LineIndex`` keeps, in a
folder of the shared storage,

* a log of references (key, doc_id, +1 or -1): the exact table.  Its sums say
  which documents hold a key, so an insertion can be undone by a deletion and
  the keeper (largest live doc_id) is found again;
* one cuckoo filter per key shard with the fingerprints of all live keys.  On
  an insertion a key that its filter doesn't know is new for sure; only keys
  that the filter may know are looked up in the exact table.  Keys leave the
  filter when their last reference goes, which a Bloom filter can't do.

``apply`` removes every line whose key at least ``min_docs`` documents hold,
except in the keeper.  Filters of the droppable keys (their total size is
checked before they are shipped) spare all other references the shuffle; the
exact table decides about the rest, so false positives have no effect.

Keys are compared by 128-bit hashes.  Counts are aggregated before they are
shuffled, so one line held by a third of all documents is a handful of rows.

Defined cases: null or empty text is one empty line and holds no key; a null
doc_id holds nothing and keeps all its lines; rows that repeat a doc_id count
as one document and are each cut alike; other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import fs
from ledgerline.llm.common import (SPACES, documents, fresh, quoted, saved, scratch_dir,
                                   short_batches)

MIN_CHARS = 20
MIN_DOCS = 3
KEYS_PER_SHARD = 200_000
#: droppable keys' filters are shipped to all tasks up to this many bytes
SHIPPED_BYTES = 32 << 20
_STRIP = SPACES.encode()
_SLOTS = 4


def line_key(line: bytes) -> bytes:
    return line.strip(_STRIP).lower()  # bytes.lower changes A-Z only


def key_hash(key: bytes) -> tuple[int, int]:
    """128-bit hash as two signed 64-bit integers."""
    digest = xxhash.xxh3_128_digest(key)
    return (int.from_bytes(digest[:8], "big", signed=True),
            int.from_bytes(digest[8:], "big", signed=True))


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (
        len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


# --------------------------------------------------------------- cuckoo filter
class CuckooFilter:
    """16-bit fingerprints, 4 slots a bucket, two buckets a key; whole arrays
    of (h1, h2) keys are inserted, looked up and deleted at a time."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> "CuckooFilter":
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / (_SLOTS * 0.7)))))
        return cls(np.zeros((buckets, _SLOTS), dtype=np.uint16))

    @classmethod
    def load(cls, data: bytes) -> "CuckooFilter":
        return cls(np.frombuffer(data, dtype=np.uint16).reshape(-1, _SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, h1: np.ndarray, h2: np.ndarray):
        prints = (h1.astype(np.uint64) >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (h2.astype(np.uint64) & np.uint64(len(self.table) - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        jump = (prints.astype(np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(3)
        return bucket ^ (jump & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(h1, h2)
        mine = prints[:, None]
        return (self.table[a] == mine).any(axis=1) | (self.table[b] == mine).any(axis=1)

    def insert(self, h1: np.ndarray, h2: np.ndarray, rounds: int = 500) -> bool:
        """False if the filter is too full; it must then be rebuilt larger."""
        prints, here, _ = self._places(h1, h2)
        rng = np.random.Generator(np.random.PCG64(11))
        for _ in range(rounds):
            if not len(prints):
                return True
            order = np.argsort(here, kind="stable")
            prints, here = prints[order], here[order]
            first = np.r_[True, here[1:] != here[:-1]]
            rank = np.arange(len(here)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            rows = self.table[here]
            free_order = np.argsort(rows != 0, axis=1, kind="stable")  # free slots first
            n_free = (rows == 0).sum(axis=1)
            fits = rank < n_free
            slot = free_order[np.arange(len(here)), np.minimum(rank, _SLOTS - 1)]
            self.table[here[fits], slot[fits]] = prints[fits]
            # one newcomer a full bucket pushes a random resident to its other bucket
            push = (n_free == 0) & (rank == 0)
            victim = rng.integers(0, _SLOTS, int(push.sum()))
            out = self.table[here[push], victim].copy()
            self.table[here[push], victim] = prints[push]
            wait = ~fits & ~push
            here = np.r_[self._other(here[push], out), self._other(here[wait], prints[wait])]
            prints = np.r_[out, prints[wait]]
        return not len(prints)

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Each key must have been inserted; one of its fingerprints goes."""
        prints, a, b = self._places(h1, h2)
        for p, i, j in zip(prints, a, b):
            for bucket in (i, j):
                at = np.flatnonzero(self.table[bucket] == p)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break


# ------------------------------------------------------------------- postings
def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, h1, h2): each long key once per row."""
    short_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids, first, second = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(),
                                 batch.column(1).cast(pa.large_binary()).to_pylist()):
                if not text:
                    continue
                keys = {line_key(line) for line in text.split(b"\n")}
                for key in keys:
                    if long_enough(key, min_chars):
                        a, b = key_hash(key)
                        ids.append(doc)
                        first.append(a)
                        second.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(first, pa.int64()),
                 pa.array(second, pa.int64())], names=["doc_id", "h1", "h2"])

    return (docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(run, "doc_id long, h1 long, h2 long"))


class LineIndex:
    """Reference log and filters in ``folder`` (shared storage).

    insert(docs), delete(docs) and apply(docs) may be called in any order; each
    insert or delete adds one file set to the log and a new generation of the
    filters that it touched.
    """

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = MIN_DOCS,
                 min_chars: int = MIN_CHARS, keys_per_shard: int = KEYS_PER_SHARD):
        self.spark, self.folder = spark, folder
        self.min_docs, self.min_chars = min_docs, min_chars
        self.keys_per_shard = keys_per_shard
        self.step = 0
        self.shards = 0

    # ------------------------------------------------------------ exact table
    def _log(self) -> DataFrame | None:
        if not self.step:
            return None
        return self.spark.read.parquet(f"{self.folder}/log").select("doc_id", "h1", "h2", "sign")

    def live(self) -> DataFrame:
        """(doc_id, h1, h2): current references."""
        log = self._log()
        if self.step == 1:
            return log.select("doc_id", "h1", "h2")  # first insertion: already distinct
        return (log.groupBy("h1", "h2", "doc_id").agg(F.sum("sign").alias("n"))
                .where("n > 0").select("doc_id", "h1", "h2"))

    def counts(self) -> DataFrame:
        """(h1, h2, n_docs, keeper): the exact reference counts."""
        return self.live().groupBy("h1", "h2").agg(
            F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))

    def _append(self, refs: DataFrame, sign: int) -> DataFrame:
        self.step += 1
        path = f"{self.folder}/log/step={self.step}"
        refs.select("doc_id", "h1", "h2", F.lit(sign).alias("sign")).write.parquet(path)
        return self.spark.read.parquet(path).select("doc_id", "h1", "h2")

    # ---------------------------------------------------------------- filters
    def _filters(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/filters-{self.step}")

    def _shard(self):
        return F.pmod(F.col("h1"), F.lit(self.shards)).cast("int")

    def _build(self, keys: DataFrame) -> DataFrame:
        """(shard, cells): a filter per shard, sized for its keys."""
        def build(frame: pd.DataFrame) -> pd.DataFrame:
            h1, h2 = frame["h1"].to_numpy(), frame["h2"].to_numpy()
            size = len(h1)
            while True:
                cuckoo = CuckooFilter.sized(size)
                if cuckoo.insert(h1, h2):
                    return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])],
                                         "cells": [cuckoo.dump()]})
                size *= 2
        return (keys.select(self._shard().alias("shard"), "h1", "h2")
                .groupBy("shard").applyInPandas(build, "shard int, cells binary"))

    def maybe_known(self, keys: DataFrame) -> DataFrame:
        """The keys (h1, h2) that their shard's filter may hold."""
        def probe(cells: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
            if not len(cells) or not len(frame):
                return pd.DataFrame({"h1": [], "h2": []}, dtype="int64")
            cuckoo = CuckooFilter.load(cells["cells"].iloc[0])
            seen = cuckoo.contains(frame["h1"].to_numpy(), frame["h2"].to_numpy())
            return frame.loc[seen, ["h1", "h2"]]
        return (self._filters().groupBy("shard").cogroup(
            keys.select(self._shard().alias("shard"), "h1", "h2").groupBy("shard"))
            .applyInPandas(probe, "h1 long, h2 long"))

    def _change_filters(self, before: DataFrame, keys: DataFrame, adding: bool) -> DataFrame:
        """New generation: ``keys`` enter or leave; a shard that gets too full
        is doubled and rebuilt from the exact table."""
        def change(cells: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
            shard = int((cells if len(cells) else frame)["shard"].iloc[0])
            h1, h2 = frame["h1"].to_numpy(), frame["h2"].to_numpy()
            cuckoo = (CuckooFilter.load(cells["cells"].iloc[0]) if len(cells)
                      else CuckooFilter.sized(len(frame)))
            if len(frame) and adding:
                room = cuckoo.table.size - int((cuckoo.table != 0).sum())
                if len(frame) > 0.9 * room or not cuckoo.insert(h1, h2):
                    return pd.DataFrame({"shard": [shard], "cells": [b""]})
            elif len(frame):
                cuckoo.delete(h1, h2)
            return pd.DataFrame({"shard": [shard], "cells": [cuckoo.dump()]})
        return before.groupBy("shard").cogroup(
            keys.select(self._shard().alias("shard"), "h1", "h2").groupBy("shard")
        ).applyInPandas(change, "shard int, cells binary")

    # ------------------------------------------------------------- operations
    def insert(self, docs: DataFrame) -> None:
        """Add the documents' references; ids already in the index add only
        lines that they don't hold yet."""
        refs = references(docs, self.min_chars).distinct()
        if not self.step:
            self._append(refs, 1)
            keys = saved(self.counts(), self.folder, "counts-1").select("h1", "h2")
            self.shards = max(1, -(-keys.count() // self.keys_per_shard))
            self._build(keys).write.parquet(f"{self.folder}/filters-{self.step}")
            return
        before = self._filters()
        held = self.live()
        refs = saved(refs.join(held, ["doc_id", "h1", "h2"], "left_anti"),
                     self.folder, f"incoming-{self.step + 1}")
        keys = refs.select("h1", "h2").distinct()
        # the filter gates the exact table: only keys it may know are looked up
        maybe = saved(self.maybe_known(keys), self.folder, f"maybe-{self.step + 1}")
        known = held.join(maybe, ["h1", "h2"], "left_semi").select("h1", "h2").distinct()
        fresh = saved(keys.join(known, ["h1", "h2"], "left_anti"), self.folder,
                      f"fresh-{self.step + 1}")
        self._append(refs, 1)
        self._write_filters(self._change_filters(before, fresh, adding=True))

    def delete(self, docs: DataFrame) -> None:
        """Take back all references of the ids in ``docs``."""
        if not self.step:
            return
        before = self._filters()
        ids = docs.select(F.col("doc_id").cast("long")).distinct()
        gone = saved(self.live().join(ids, "doc_id", "left_semi"), self.folder,
                     f"outgoing-{self.step + 1}")
        self._append(gone, -1)
        touched = gone.select("h1", "h2").distinct()
        dead = touched.join(self.live().select("h1", "h2"), ["h1", "h2"], "left_anti")
        self._write_filters(self._change_filters(before, dead, adding=False))

    def _write_filters(self, changed: DataFrame) -> None:
        changed = saved(changed, self.folder, f"changed-{self.step}")
        full = changed.where(F.length("cells") == 0).select("shard")
        rebuilt = self._build(self.counts().withColumn("shard", self._shard())
                              .join(full, "shard", "left_semi").select("h1", "h2"))
        (changed.where(F.length("cells") > 0).unionByName(rebuilt)
         .write.parquet(f"{self.folder}/filters-{self.step}"))

    def droppable(self) -> DataFrame:
        counts = (self.spark.read.parquet(f"{self.folder}/counts-1") if self.step == 1
                  else self.counts())
        return counts.where(F.col("n_docs") >= self.min_docs)

    def drops(self) -> DataFrame:
        """(doc_id, drop): hashes (h1) of the lines each document loses."""
        shared = saved(self.droppable().select("h1", "h2", "keeper"), self.folder,
                       f"shared-{self.step}")
        refs = self._screened(self.live(), shared)
        return (refs.join(shared, ["h1", "h2"])
                .where(F.col("doc_id") != F.col("keeper"))
                .groupBy("doc_id").agg(F.collect_set("h1").alias("drop")))

    def _screened(self, refs: DataFrame, shared: DataFrame) -> DataFrame:
        """References whose key is in the droppable keys' filters, where these
        are small enough to ship; else all of them (the join decides alike)."""
        filters = saved(self._build(shared), self.folder, f"shared-filters-{self.step}")
        if (filters.agg(F.sum(F.length("cells"))).first()[0] or 0) > SHIPPED_BYTES:
            return refs
        shipped = self.spark.sparkContext.broadcast(
            {r["shard"]: bytes(r["cells"]) for r in filters.collect()})
        shards = self.shards

        def run(batches):
            loaded = {s: CuckooFilter.load(c) for s, c in shipped.value.items()}
            for batch in batches:
                h1 = batch.column(1).to_numpy()
                h2 = batch.column(2).to_numpy()
                shard = h1 % shards if shards else h1
                keep = np.zeros(len(h1), dtype=bool)
                for s in np.unique(shard):
                    if int(s) in loaded:
                        at = shard == s
                        keep[at] = loaded[int(s)].contains(h1[at], h2[at])
                yield batch.filter(pa.array(keep))

        return refs.mapInArrow(run, refs.schema)

    def apply(self, docs: DataFrame, counts: bool = True) -> DataFrame:
        """``docs`` with text cut, plus n_lines, n_dropped and kept_sha256, which
        replace columns of these names; without ``counts``, only the text changes."""
        short_batches(self.spark)
        drops = saved(self.drops(), self.folder, f"drops-{self.step}")
        own = {"n_lines", "n_dropped", "kept_sha256"} if counts else set()
        names = [c for c in docs.columns if c.lower() not in own]
        drop_doc, drop = fresh("_drop_doc", docs.columns), fresh("_drop", docs.columns)
        renamed = drops.select(F.col("doc_id").alias(drop_doc), F.col("drop").alias(drop))
        joined = docs.join(renamed.hint("shuffle_hash"),
                           docs["doc_id"].cast("long") == F.col(drop_doc), "left")
        joined = joined.select(*[docs[quoted(c)] for c in names], drop)
        at = [c.lower() for c in names].index("text")
        wide = len(names)
        from pyspark.sql.types import LongType, StringType, StructType
        out = StructType(joined.schema.fields[:wide])
        if counts:
            out = out.add("n_lines", LongType()).add("n_dropped", LongType()).add(
                "kept_sha256", StringType())

        def run(batches):
            for batch in batches:
                texts = batch.column(at).cast(pa.large_binary()).to_pylist()
                drops = batch.column(wide).to_pylist()
                kept, n_lines, n_dropped, sha = [], [], [], []
                for text, drop in zip(texts, drops):
                    n = (text or b"").count(b"\n") + 1
                    gone = 0
                    if drop and text:
                        drop = set(drop)
                        lines = text.split(b"\n")
                        left = [line for line in lines
                                if key_hash(line_key(line))[0] not in drop]
                        gone = len(lines) - len(left)
                        text = b"\n".join(left)
                    kept.append(text)
                    n_lines.append(n)
                    n_dropped.append(gone)
                    sha.append(hashlib.sha256(text or b"").hexdigest())
                columns = [batch.column(i) for i in range(wide)]
                columns[at] = pa.array(kept, pa.binary()).cast(batch.column(at).type)
                if counts:
                    columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                                pa.array(sha, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

        return joined.mapInArrow(run, out)

    def clear(self) -> None:
        fs.delete(self.spark, self.folder)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    index = LineIndex(spark, scratch_dir(spark, "lines"))
    index.insert(docs)
    return index.apply(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.pos, u.line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) u
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), flagged AS (
  SELECT l.doc_id, l.pos, l.line, c.k IS NOT NULL AND c.keeper <> l.doc_id AS gone
  FROM keyed l LEFT JOIN common c ON l.k = c.k
)
SELECT doc_id, count(*) AS n_lines,
       CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""

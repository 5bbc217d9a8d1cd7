"""N-gram Jaccard join by grouped prefixes; every link found is exact.

1. Shingles are ordered globally, rare before frequent, ties by hash; any fixed
   order is right, this one keeps passages that many documents share out of the
   prefixes.  A bounded sketch counts how many documents hold the shingles of
   each hash bucket, over all documents, and so finds the very frequent ones;
   then the shingles of the prefixes in that order are counted exactly, and
   those in ``FREQUENT`` documents or more go to the end of the order.
2. A set of n shingles that links with another shares one of its first
   n - ceil(t n) + 1 shingles with it: its prefix.  Equal sets are one class;
   classes with the same prefix and size are one group, and only groups are
   joined on prefix shingles.
3. Candidates are screened by the places of the shared shingle and by their
   whole prefixes, then verified on their whole sets.  First every class against
   its group's head, then in each list of a prefix shingle (by size band) every
   group's head against the list's first and last one: a number of pairs that
   grows with the lists' lengths, not with their squares.  Their links are
   joined into components.
4. What is left is done in full: all pairs of groups that share a prefix
   shingle, pass the screens and aren't in one component already are expanded
   into pairs of their members in different components and verified.  Pairs
   inside a component change nothing, so the components are exact.

The result is one row per document with its component; class members aren't
expanded into pairs.

Defined cases: null, empty or blank text has no shingle and is its own
component; fewer words than a shingle make one shingle of all words; rows that
repeat a doc_id are one document; a null doc_id links with nothing and has a
null component; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import fs
from ledgerline.llm.common import (WordHasher, documents, fresh, list_array, mix, saved,
                                   scratch_dir, short_batches, text_chunks, word_bounds)
from ledgerline.llm.components import components

WORDS = 4
PERCENT = 85
SKETCH_BITS = 20
_BLOCK = 1 << 12
_SEED = 20250301
#: prefix shingles in so many documents are ordered last
FREQUENT = 10
#: such shingles are shipped to the second scan up to this many (8 bytes each);
#: beyond it the order stays as the sketch has it
SHIPPED_FREQUENT = 4_000_000
#: doc_ids of candidates are shipped to the scan of their texts up to this many
SHIPPED_IDS = 1_000_000
_SIGN = np.uint64(1 << 63)
_LAST = np.uint64(15 << 60)
_OTHER = np.uint64(0xD1B54A32D192ED03)


def shingle_sets(hasher: WordHasher, column: pa.Array, k: int):
    """(row, sorted distinct 64-bit shingle hashes) of every row with a word."""
    for first, data, offsets in text_chunks(column):
        starts, ends, before = word_bounds(data, offsets)
        words = hasher.words(data, starts, ends)
        grams = hasher.grams(words, k)
        for i in range(len(offsets) - 1):
            lo, hi = int(before[i]), int(before[i + 1])
            n = hi - lo
            if n >= k:
                yield first + i, np.unique(grams[lo:hi - k + 1])
            elif n:
                with np.errstate(over="ignore"):
                    yield first + i, mix(hasher.grams(words[lo:hi], n) + np.uint64(n))


def frequency_levels(docs: DataFrame, k: int, bits: int, folder: str) -> np.ndarray:
    """Level 0..15 of every hash bucket: how far the number of documents that
    hold its shingles lies above the mean.  One table of 2**bits counters per
    task, summed block by block in a tree; the sum's size doesn't depend on the
    data."""
    from pyspark import TaskContext

    def count(batches):
        hasher = WordHasher(_SEED, fold_case=True)
        counters = np.zeros(1 << bits, dtype=np.uint32)
        shift = np.uint64(64 - bits)
        for batch in batches:
            for _, unique in shingle_sets(hasher, batch.column(0), k):
                counters[(unique >> shift).astype(np.int64)] += 1
        blocks = counters.reshape(-1, min(_BLOCK, 1 << bits))
        used = np.flatnonzero(blocks.any(axis=1))
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(np.full(len(used), part), pa.int64()),
             pa.array([blocks[b].tobytes() for b in used], pa.binary())],
            names=["block", "part", "counts"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(frame["counts"].iloc[0]) // 4, dtype=np.uint64)
        for c in frame["counts"]:
            total += np.frombuffer(c, dtype=np.uint32)
        return pd.DataFrame({
            "block": frame["block"].iloc[:1], "part": frame["part"].iloc[:1],
            "counts": [np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()]})

    schema = "block int, part long, counts binary"
    tables = saved(docs.select("text").mapInArrow(count, schema), folder, "sketch-0")
    parts = (tables.agg(F.max("part")).first()[0] or 0) + 1
    step = 0
    while parts > 1:
        step += 1
        parts = -(-parts // 32)
        tables = saved(
            tables.withColumn("part", F.floor(F.col("part") / 32).cast("long"))
            .groupBy("block", "part").applyInPandas(merge, schema), folder, f"sketch-{step}")
    counts = np.zeros(1 << bits, dtype=np.int64)
    for row in tables.collect():
        block = np.frombuffer(row["counts"], dtype=np.uint32)
        counts[row["block"] * len(block):(row["block"] + 1) * len(block)] += block
    mean = counts.mean()
    usual = mean + 4.0 * np.sqrt(mean) + 8.0
    levels = np.floor(np.log2(np.maximum(counts, 1) / usual)) + 1
    return np.clip(levels, 0, 15).astype(np.uint8)


def frequent_keys(docs: DataFrame, levels: np.ndarray, k: int, percent: int, bits: int,
                  folder: str) -> np.ndarray | None:
    """Sorted order keys that at least FREQUENT documents have in their
    prefixes; None if there are too many to ship."""
    keys = prefixes(docs, levels, None, k, percent, bits).select(
        F.explode("prefix").alias("key"))
    found = saved(keys.groupBy("key").agg(F.count("*").alias("n"))
                  .where(F.col("n") >= FREQUENT).select("key"), folder, "frequent")
    if found.count() > SHIPPED_FREQUENT:
        return None
    return np.sort(found.toArrow().column(0).to_numpy().view(np.uint64) ^ _SIGN)


def prefixes(docs: DataFrame, levels: np.ndarray, frequent: np.ndarray | None, k: int,
             percent: int, bits: int) -> DataFrame:
    """(doc_id, n, s1, s2, p, prefix): set size, 128-bit digest of the set, hash
    of the prefix, and the prefix's order keys."""
    shipped = docs.sparkSession.sparkContext.broadcast((levels, frequent))

    def run(batches):
        hasher = WordHasher(_SEED, fold_case=True)
        order = shipped.value[0].astype(np.uint64) << np.uint64(60)
        last = shipped.value[1]
        shift = np.uint64(64 - bits)
        for batch in batches:
            size = len(batch.column(0))
            n = np.zeros(size, dtype=np.int64)
            digest = np.zeros((3, size), dtype=np.uint64)
            counts = np.zeros(size, dtype=np.int64)
            kept = []
            with np.errstate(over="ignore"):
                for row, unique in shingle_sets(hasher, batch.column(1), k):
                    m = len(unique)
                    keys = order[(unique >> shift).astype(np.int64)] | (unique >> np.uint64(4))
                    if last is not None and len(last):
                        at = np.minimum(np.searchsorted(last, keys), len(last) - 1)
                        keys = np.where(last[at] == keys, keys | _LAST, keys)
                    p = m - (percent * m + 99) // 100 + 1
                    prefix = np.sort(np.partition(keys, p - 1)[:p])
                    n[row], counts[row] = m, p
                    digest[0, row] = mix(unique).sum()
                    digest[1, row] = mix(unique ^ _OTHER).sum()
                    digest[2, row] = mix(prefix + _OTHER).sum()
                    kept.append(prefix ^ _SIGN)  # signed order is then the keys' order
            values = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n)]
                + [pa.array(d.view(np.int64)) for d in digest]
                + [list_array(values.view(np.int64), counts, pa.int64())],
                names=["doc_id", "n", "s1", "s2", "p", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, s1 long, s2 long, p long, prefix array<long>")


def _only(df: DataFrame, pairs: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows of ``df`` (key ``id``) that occur in a pair; the ids are shipped
    where they are few, so that the others' rows aren't shuffled."""
    ids = saved(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(),
                folder, name)
    return df.join(F.broadcast(ids) if ids.count() <= SHIPPED_IDS else ids, "id", "left_semi")


def possible(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs that their prefixes don't rule out.  Up to the smaller of the
    two prefixes' ends both sets are known in full; beyond it at most the
    smaller rest is shared.  Loses no link; costs prefixes, not whole sets."""
    left = heads.select(F.col("id").alias("a"), F.col("n").alias("na"),
                        F.col("prefix").alias("pa"))
    right = heads.select(F.col("id").alias("b"), F.col("n").alias("nb"),
                         F.col("prefix").alias("pb"))
    both = pairs.join(left, "a").join(right, "b").where(
        100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    end = F.least(F.element_at("pa", -1), F.element_at("pb", -1))
    known = both.withColumn("end", end).select(
        "a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("c"),
        F.size(F.filter("pa", lambda x: x <= F.col("end"))).alias("ka"),
        F.size(F.filter("pb", lambda x: x <= F.col("end"))).alias("kb"))
    most = F.col("c") + F.least(F.col("na") - F.col("ka"), F.col("nb") - F.col("kb"))
    return known.where(100 * most >= percent * (F.col("na") + F.col("nb") - most)).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def in_reach(n, place, other_n, other_place, percent: int):
    """Whether two sets can be similar enough if the shingle at these (0-based)
    places is the first that they share; true for the first one of every link."""
    most = F.least(n - place, other_n - other_place)  # this one and all behind it
    return ((100 * F.least(n, other_n) >= percent * F.greatest(n, other_n))
            & ((100 + percent) * most >= percent * (n + other_n)))


def screened(pairs: DataFrame, sets: DataFrame, percent: int, folder: str,
             name: str) -> DataFrame:
    """Distinct pairs that their prefixes don't rule out."""
    pairs = saved(_ordered(pairs), folder, f"pairs-{name}")
    heads = _only(sets.select(F.col("doc_id").alias("id"), "n", "prefix"), pairs, folder,
                  f"met-{name}")
    return saved(possible(pairs, heads, percent).distinct(), folder, f"possible-{name}")


def verified(pairs: DataFrame, docs: DataFrame, k: int, folder: str, name: str,
             percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough.  Only their
    own texts are hashed again, and only their sets are shuffled."""
    spark = docs.sparkSession

    def run(batches):
        hasher = WordHasher(_SEED, fold_case=True)
        for batch in batches:
            rows, counts, kept = [], [], []
            for row, unique in shingle_sets(hasher, batch.column(1), k):
                rows.append(row)
                counts.append(len(unique))
                kept.append(unique)
            values = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())).cast(pa.int64()),
                 list_array(values.view(np.int64), np.array(counts, np.int64), pa.int64())],
                names=["id", "grams"])

    texts = _only(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), pairs, folder,
                  f"ids-{name}")
    sets = saved(texts.mapInArrow(run, "id long, grams array<long>"), folder, f"sets-{name}")
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("gb"))
    shared = F.size(F.array_intersect("ga", "gb"))
    joined = pairs.join(left, "a").join(right, "b").select(
        "a", "b", shared.alias("i"), (F.size("ga") + F.size("gb")).alias("total"))
    links = saved(joined.where(100 * F.col("i") >= percent * (F.col("total") - F.col("i")))
                  .select("a", "b"), folder, f"links-{name}")
    fs.delete(spark, f"{folder}/sets-{name}")
    return links


def link_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT,
                    bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    spark = docs.sparkSession
    short_batches(spark)
    folder = scratch_dir(spark, "jaccard")
    docs = docs.select("doc_id", "text")
    levels = frequency_levels(docs, k, bits, folder)
    frequent = frequent_keys(docs, levels, k, percent, bits, folder)
    rows = saved(prefixes(docs, levels, frequent, k, percent, bits), folder, "rows")
    sets = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = saved(sets.groupBy("s1", "s2").agg(
        F.min("doc_id").alias("id"), F.min("n").alias("n"), F.min("p").alias("p")),
        folder, "classes")
    groups = saved(classes.groupBy("n", "p").agg(F.min("id").alias("head")), folder, "groups")
    members = saved(classes.join(groups, ["n", "p"]).select("head", "id", "n"),
                    folder, "members")

    # lists of the prefix shingles that at least two groups hold
    heads = groups.select(F.col("head").alias("doc_id"), "n", "p")
    held = (sets.select("doc_id", "n", "p", "prefix").join(heads, ["doc_id", "n", "p"], "left_semi")
            .select(F.posexplode("prefix").alias("place", "token"),
                    F.col("doc_id").alias("head"), "n"))
    shared = saved(held.groupBy("token").agg(F.min("head").alias("lo"), F.max("head").alias("hi"))
                   .where("lo < hi").select("token"), folder, "shared")
    lists = saved(held.join(shared, "token", "left_semi"), folder, "lists")

    # linear candidates: class against its group's head, head against leaders
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100.0 / percent)))
    banded = lists.withColumn("band", band)
    one = F.struct("head", "n", "place")
    leaders = saved(banded.groupBy("token", "band").agg(
        F.min(one).alias("first"), F.max(one).alias("last")), folder, "leaders")
    stars = banded.join(leaders, ["token", "band"])
    pairs = members.select(F.col("head").alias("a"), F.col("id").alias("b"))
    for end in ("first", "last"):
        pairs = pairs.union(stars.where(in_reach(
            F.col("n"), F.col("place"), F.col(f"{end}.n"), F.col(f"{end}.place"), percent))
            .select(f"{end}.head", "head"))
    links = verified(screened(pairs, sets, percent, folder, "stars"), docs, k, folder,
                     "stars", percent)
    joined = components(links, folder)
    placed = saved(
        members.join(joined.withColumnRenamed("node", "id"), "id", "left")
        .select("head", "id", "n", F.coalesce("component", "id").alias("c")), folder, "placed")

    # the rest in full: groups that aren't in one component yet
    spread = placed.groupBy("head").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    known = saved(lists.join(spread, "head"), folder, "known")
    mixed = saved(known.groupBy("token").agg(F.min("lo").alias("low"), F.max("hi").alias("high"))
                  .where("low < high").select("token"), folder, "mixed")
    open_ = saved(known.join(mixed, "token", "left_semi"), folder, "open")
    left, right = (open_.select("token", *[F.col(c).alias(f"{c}_{side}") for c in
                                           ("head", "n", "place", "lo", "hi")]) for side in "ab")
    met = left.join(right, "token").where(
        (F.col("head_a") < F.col("head_b"))
        & (F.least("lo_a", "lo_b") < F.greatest("hi_a", "hi_b"))
        & in_reach(F.col("n_a"), F.col("place_a"), F.col("n_b"), F.col("place_b"), percent)) \
        .select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    groups_left = screened(met, sets, percent, folder, "rest")
    own = placed.select("head", "id", "c")
    between = groups_left.join(own.select(F.col("head").alias("a"), F.col("id").alias("ia"),
                                          F.col("c").alias("ca")), "a").join(
        own.select(F.col("head").alias("b"), F.col("id").alias("ib"), F.col("c").alias("cb")), "b"
    ).where(F.col("ca") != F.col("cb")).select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    split = own.join(spread.where("lo < hi").select("head"), "head", "left_semi")
    within = split.select("head", F.col("id").alias("a"), F.col("c").alias("ca")).join(
        split.select("head", F.col("id").alias("b"), F.col("c").alias("cb")), "head").where(
        F.col("ca") < F.col("cb")).select("a", "b")
    members_left = saved(_ordered(between.union(within)), folder, "pairs-members")
    more = verified(members_left, docs, k, folder, "rest", percent)
    if more.limit(1).count():
        # components of the first round are single nodes of the second
        at = placed.select("id", "c")
        lifted = (more.join(at.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a")
                  .join(at.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
                  .select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        top = components(lifted, f"{folder}/again").select(
            F.col("node").alias("c"), F.col("component").alias("to"))
        placed = saved(placed.join(top, "c", "left").select(
            "head", "id", "n", F.coalesce("to", "c").alias("c")), folder, "placed-again")

    found = saved(classes.select("s1", "s2", "id").join(placed.select("id", "n", "c").distinct(), "id")
                  .groupBy("s1", "s2").agg(F.min("c").alias("component")), folder, "found")
    out = rows.select("doc_id", "n", "s1", "s2").join(found, ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(
        F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      component.cast("long").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows of documents that a smaller doc_id of their
    component stands for; all columns kept.  Rows without doc_id stay."""
    other = fresh("_id", docs.columns)
    others = link_components(docs, k, percent).where("doc_id <> component_id").select(
        F.col("doc_id").alias(other)).distinct()
    return docs.join(others, docs["doc_id"].cast("long") == F.col(other), "left_anti")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(documents(spark, sf_dir, "doc_id", "text"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
           WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 2),
                  lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3])) END AS s
  FROM d
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS i
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM common WHERE 100 * i >= 85 * (nx + ny - i)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  WITH RECURSIVE r(a, b) AS (
    SELECT doc_id, doc_id FROM sets
    UNION
    SELECT r.a, e.y FROM r JOIN both_ways e ON r.b = e.x
  ) SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, reach.component_id
FROM sets s JOIN reach ON reach.a = s.doc_id
"""

"""Toxicity by a weighted lexicon and an Aho-Corasick matcher.

* ``fit`` learns the lexicon from labelled rows: for every folded word and word
  beginning, its weight is a lower confidence bound of the log ratio of its
  document rates in toxic and clean rows; phrases of a lexicon word and a
  neighbour seen only in clean rows become exceptions.  The fit uses at most
  ``FIT_ROWS`` labelled rows (smallest hash of doc_id), the only sampled part.
* ``score`` folds each whole text (homoglyphs to Latin letters, digits and
  signs inside words to the letters they stand for), runs one automaton over
  it, adds the best pattern's weight per word, drops exception phrases,
  divides by a length norm and maps to 0..1 by a logistic curve.

Defined cases: null or empty text scores as a text without a match; a null
label is no label; doc_id twice among the labels is toxic if any row says so;
without any labels, or with one class only, the lexicon is empty and every
score is the prior (0 without labels).  Columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import documents, short_batches

#: labelled rows used to fit, at most (documented bound of the fit)
FIT_ROWS = 12_000
MIN_WEIGHT = 2.75
MAX_PATTERNS = 5_000
BEGINNINGS = range(4, 9)
THRESHOLD = 0.3

# Look-alike letters and the Latin letters they imitate
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k",
    "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
# Digits and signs written for letters
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b",
               "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}

_ODD = re.compile("[" + "".join(HOMOGLYPHS) + "​-‏⁠﻿­！-～"
                  "\U0001d400-\U0001d7ff]")
_HIDDEN = re.compile("[​-‏⁠﻿­]")
_MIXED = re.compile(r"(?=[^\s]*[^\W\d_])[^\W_]+(?:[@$!|]+[^\W_]+)+|(?=\w*\d)(?=\w*[^\W\d_])\w+")
_HAS_MIXED = re.compile(r"[^\W\d_][0-9@$!|]|[0-9@$!|][^\W\d_]")
_LOOKALIKE = str.maketrans(HOMOGLYPHS)
_STANDS_FOR = str.maketrans(SUBSTITUTES)
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower-case, look-alikes and substitutes replaced; plain texts pass with
    two scans."""
    text = text.lower()
    if _ODD.search(text):
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text)).lower().translate(_LOOKALIKE)
    if _HAS_MIXED.search(text):
        text = _MIXED.sub(lambda m: m.group().translate(_STANDS_FOR), text)
    return text


@dataclass
class Lexicon:
    """Patterns with weights, exception phrases and the score curve."""

    weights: dict[str, float] = field(default_factory=dict)   # "word" or "beginning*"
    exceptions: frozenset[tuple[str, str]] = frozenset()
    slope: float = 1.0
    offset: float = -30.0

    def matcher(self) -> "Matcher":
        return Matcher(self)


class Matcher:
    """One automaton for all patterns; built once per task."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for pattern, weight in lexicon.weights.items():
            text = pattern.rstrip("*")
            known = self.automaton.get(text, None)
            whole, begins = known[1:] if known else (0.0, 0.0)
            if pattern.endswith("*"):
                begins = weight
            else:
                whole = weight
            self.automaton.add_word(text, (len(text), whole, begins))
        if lexicon.weights:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(word start, best weight) of each matched word."""
        if not self.lexicon.weights:
            return []
        best: dict[int, float] = {}
        size = len(folded)
        for end, (length, whole, begins) in self.automaton.iter(folded):
            start = end - length + 1
            if start and folded[start - 1].isalnum():
                continue
            weight = begins
            if whole > weight and (end + 1 == size or not folded[end + 1].isalnum()):
                weight = whole
            if weight > best.get(start, 0.0):
                best[start] = weight
        return sorted(best.items())

    def raw(self, folded: str) -> float:
        total = 0.0
        for start, weight in self.hits(folded):
            if self.lexicon.exceptions and any(
                    p in self.lexicon.exceptions for p in phrases(folded, start)):
                continue
            total += weight
        return total

    def normalised(self, text: str | None) -> float:
        folded = fold(text or "")
        raw = self.raw(folded)
        if not raw:
            return 0.0
        return raw / (1.0 + math.log2(1.0 + folded.count(" ") / 32.0))

    def score(self, text: str | None) -> float:
        return probability(self.normalised(text), self.lexicon)


def probability(value: float, lexicon: Lexicon) -> float:
    return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, lexicon.slope * value + lexicon.offset))))


def phrases(folded: str, start: int) -> list[tuple[str, str]]:
    """The word at ``start`` with the word before and the word after it."""
    word = _WORD.match(folded, start)
    if not word:
        return []
    out = []
    before = _WORD.findall(folded[max(0, start - 64):start])
    if before:
        out.append((before[-1], word.group()))
    after = _WORD.search(folded, word.end(), word.end() + 64)
    if after:
        out.append((word.group(), after.group()))
    return out


def features(text: str | None) -> set[str]:
    """Folded words and their beginnings, once per document."""
    words = set(_WORD.findall(fold(text or "")))
    out = {w for w in words if len(w) >= 3}
    for n in BEGINNINGS:
        out.update([w[:n] + "*" for w in words if len(w) >= n])
    return out


# ------------------------------------------------------------------- training
def training_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled rows, equal texts once.  The
    id list is bounded by ``rows``, hence the broadcast: no text is shuffled."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    ids = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held)
           .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
            .select("text", "toxic"))


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush():
        names = list(set(counts[0]) | set(counts[1]))
        out = pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string())]
            + [pa.array([counts[c][n] for n in names], pa.int64()) for c in (0, 1)],
            names=["feature", "clean", "toxic"])
        counts[0].clear()
        counts[1].clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[1 if toxic else 0].update(features(text))
        if len(counts[0]) + len(counts[1]) > 300_000:  # bounded memory; sums meet later
            yield flush()
    yield flush()


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Lexicon:
    """Learn the lexicon and the score curve; only bounded tables (patterns,
    score histogram) come to the driver."""
    short_batches(docs.sparkSession)
    train = training_rows(docs, labels, rows)
    totals = {r["toxic"]: r["n"] for r in
              train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = totals.get(0, 0), totals.get(1, 0)
    if not n_clean or not n_toxic:
        seen = n_clean + n_toxic
        prior = (n_toxic + 0.0) / seen if seen else 0.0
        return Lexicon(offset=30.0 if prior > 0.5 else -30.0)
    counted = (train.mapInArrow(_count_features, "feature string, clean long, toxic long")
               .groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
               .where(F.col("t") >= 3))
    ratio = F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / (n_clean + 1.0))
    bound = ratio - F.sqrt(1.0 / (F.col("t") + 0.5) + 1.0 / (F.col("c") + 0.5))
    chosen = (counted.select("feature", bound.alias("w")).where(F.col("w") >= MIN_WEIGHT)
              .orderBy(F.desc("w"), "feature").limit(MAX_PATTERNS).collect())
    lexicon = Lexicon(weights={r["feature"]: round(r["w"], 6) for r in chosen})
    lexicon.exceptions = _clean_phrases(train, lexicon)
    return _calibrated(train, lexicon)


def _clean_phrases(train: DataFrame, lexicon: Lexicon) -> frozenset[tuple[str, str]]:
    """Phrases around a lexicon word in at least 3 clean rows and no toxic one."""
    def gather(batches):
        matcher = lexicon.matcher()
        for batch in batches:
            left, right, toxic = [], [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded = fold(text or "")
                found = {p for start, _ in matcher.hits(folded) for p in phrases(folded, start)}
                for a, b in found:
                    left.append(a)
                    right.append(b)
                    toxic.append(label)
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.string()), pa.array(right, pa.string()),
                 pa.array(toxic, pa.int64())], names=["a", "b", "toxic"])

    found = (train.mapInArrow(gather, "a string, b string, toxic long")
             .groupBy("a", "b").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
             .where((F.col("t") == 0) & (F.col("n") >= 3))
             .orderBy(F.desc("n"), "a", "b").limit(MAX_PATTERNS).collect())
    return frozenset((r["a"], r["b"]) for r in found)


def _calibrated(train: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Logistic curve over the normalised sums, fitted on their histogram."""
    def value(batches):
        matcher = lexicon.matcher()
        for batch in batches:
            bins = [int(min(4000.0, matcher.normalised(t) * 20.0))
                    for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bins, pa.int32()), batch.column(1).cast(pa.int32())],
                names=["bin", "toxic"])

    rows = (train.mapInArrow(value, "bin int, toxic int").groupBy("bin")
            .agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect())
    rows.sort(key=lambda r: r["bin"])
    x = np.array([r["bin"] / 20.0 for r in rows])
    n = np.array([r["n"] for r in rows], dtype=float)
    t = np.array([r["t"] for r in rows], dtype=float)
    a, b = 1.0, -2.0
    for _ in range(100):  # Newton steps of a ridge-regularised logistic fit
        p = 1.0 / (1.0 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([np.sum((p * n - t) * x) + 0.5 * a, np.sum(p * n - t) + 0.01 * b])
        w = p * (1 - p) * n
        h = np.array([[np.sum(w * x * x) + 0.5, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if float(np.abs(step).max()) < 1e-9:
            break
    lexicon.slope, lexicon.offset = max(1e-3, round(float(a), 9)), round(float(b), 9)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score of every row (one scan, no shuffle)."""
    short_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        matcher = lexicon.matcher()
        for batch in batches:
            scores = [matcher.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def reject_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, all columns kept.  The
    score is computed next to each row, so repeated ids need no join."""
    short_batches(docs.sparkSession)
    names = docs.columns
    at = [c.lower() for c in names].index("text")

    def run(batches):
        matcher = lexicon.matcher()
        for batch in batches:
            keep = [matcher.score(t) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    return score(docs, fit(docs, labels)).select(
        "doc_id", held.alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

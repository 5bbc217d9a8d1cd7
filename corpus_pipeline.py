"""Corpus pipeline: five stages over ``documents``.

Each stage reads what the one before it wrote, works on all of it, and is
written as Parquet in the cluster's shared folder.  All but the last return the
columns of documents; the last returns the packed pieces.

1. toxicity: documents scored at or above the threshold go.
2. line dedup: lines that many documents share stay in one of them.
3. n-gram Jaccard join: one document of each group of near copies stays
   (shingles of ``NEAR_WORDS`` words, similarity ``NEAR_PERCENT`` percent).
4. mixing: sources are drawn to their target weights, rows repeated as taken.
5. packing: token sequences of bounded length with little padding.

Empty tables pass through; null texts are clean, empty documents.  Other columns
keep their values in the first four stages, whatever their names (but for names
with a dot, which Spark's Arrow maps refuse).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import toxicity
from ledgerline.llm.common import saved, scratch_dir
from ledgerline.llm.jaccard_join import one_of_each
from ledgerline.llm.line_dedup import LineIndex
from ledgerline.llm.mixing import mixed_rows, word_count
from ledgerline.llm.packing import pack


#: near copies of the stage; op3's own figures bind its query only
NEAR_WORDS = 5
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The lexicon is learned from the labelled rows of ``documents``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.reject_toxic(docs, toxicity.fit(docs, labels))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = LineIndex(spark, scratch_dir(spark, "pipeline-lines"))
    index.insert(docs)
    return with_length(index.apply(docs, counts=False))


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that was cut."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, k=NEAR_WORDS, percent=NEAR_PERCENT)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs, word_count(F.col("text")))


def to_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", one_per_group),
    ("mixing", to_weights),
    ("packing", to_sequences),
]

#: learned scores, knapsack choices and token ids have no SQL form; tested
#: against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), folder, name)
    return docs

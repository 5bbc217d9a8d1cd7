"""Atomic publication of the ``debtors`` and ``entities`` tables.

Each import writes both tables into a fresh version folder; only when both
writes have committed is a small commit marker created for the version.
Readers resolve the newest committed version once per query, so they see
either the previous pair of tables or the new pair, never an empty or
half-written one ("latest file wins", without a truncate window).
``debtors`` is stored once per read pattern, as an index would be: by
identification number (lookups, pages), by situation (filtered lists and their
pages) and by total (top n).  Files are range partitioned and sorted, bounded in
rows, and a small rank index notes how many rows lie before each file, so a page
or a top n opens the files it needs and no others.  Keys carry Parquet Bloom
filters, so a missing key reads no row group.  That keys are unique is checked by
the sorted write itself; a repeated key fails it, and nothing is committed.

Commits are numbered; the highest is current.  Versions before the last
``keep`` are removed once they have been superseded for a grace period, which
bounds how long a query may go on reading the version it resolved.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline import fs
from ledgerline import layout as L

COMMITS = "_commits"
VERSIONS = "versions"
#: how long a superseded version, or an attempt without commit, stays on disk
GRACE_HOURS = 24.0

SCHEMAS = {"debtors": L.DEBTORS_SCHEMA, "entities": L.ENTITIES_SCHEMA}
KEYS = {"debtors": "identification_number", "entities": "entity_code"}
#: rows of a published file at most (a page sorts at most about two files)
FILE_ROWS = 1 << 20
#: bytes of a key's Bloom filter at most, per row group; small ones are chosen smaller
BLOOM_BYTES = 4 << 20

BY_KEY, BY_SITUATION, BY_TOTAL = "debtors", "debtors_by_situation", "debtors_by_total"
INDEX = "debtors_index"
INDEX_SCHEMA = "layout string, situation string, file string, n long, before long"


def _orders() -> dict:
    """Sort order of each copy of ``debtors``; range partitioning on it makes
    Parquet statistics serve the reads.  ``entities`` holds one row per lending
    entity (hundreds): its aggregation output is one small file."""
    return {BY_KEY: [F.col("identification_number")],
            BY_SITUATION: [F.col("max_situation"), F.col("identification_number")],
            BY_TOTAL: [F.col("total_loan_amount").desc(), F.col("identification_number")]}


def new_version() -> str:
    """Unique folder name of a version; it says nothing about the order."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def version_dir(root: str, version: str) -> str:
    return f"{root}/{VERSIONS}/{version}"


def committed_versions(spark: SparkSession, root: str) -> list[str]:
    """Versions in commit order: the marker ``<number>`` holds the name."""
    names = fs.list_names(spark, f"{root}/{COMMITS}")
    versions = [fs.read_text(spark, f"{root}/{COMMITS}/{n}") for n in names]
    return [v for v in versions if v]


def current_version(spark: SparkSession, root: str) -> str | None:
    for name in reversed(fs.list_names(spark, f"{root}/{COMMITS}")):
        version = fs.read_text(spark, f"{root}/{COMMITS}/{name}")
        if version:
            return version
    return None


def commit(spark: SparkSession, root: str, version: str) -> int:
    """Take the next commit number.  Markers are named ``<number>-<random>``: of
    two commits at a time both may take a number, and both stay, ordered by name
    for every reader, also on a store that would overwrite a file silently.
    Clocks of drivers play no part in which version is current."""
    taken = fs.list_names(spark, f"{root}/{COMMITS}")
    number = int(taken[-1].split("-")[0]) + 1 if taken else 1
    fs.write_marker(spark, f"{root}/{COMMITS}/{number:012d}-{uuid.uuid4().hex}", version)
    return number


def remove_old(spark: SparkSession, root: str, keep: int, grace_hours: float) -> None:
    """Drop committed versions before the last ``keep``, and folders of attempts
    that never committed, once they are older than the grace period: a reader
    that resolved a version, or a writer still at work, keeps its files."""
    now = time.time() * 1000
    limit = now - grace_hours * 3_600_000
    markers = fs.list_names(spark, f"{root}/{COMMITS}")
    held = {n: fs.read_text(spark, f"{root}/{COMMITS}/{n}") for n in markers}
    for name in markers[:-keep] if keep else markers[:-1]:
        # superseded when the next marker was written
        after = markers[markers.index(name) + 1]
        if fs.modified_ms(spark, f"{root}/{COMMITS}/{after}") <= limit:
            fs.delete(spark, version_dir(root, held[name]))
            fs.delete(spark, f"{root}/{COMMITS}/{name}")
    known = set(held.values())
    for name in fs.list_names(spark, f"{root}/{VERSIONS}"):
        if name not in known and fs.modified_ms(spark, version_dir(root, name)) <= limit:
            fs.delete(spark, version_dir(root, name))


def unique_keys(df: DataFrame, key: str) -> DataFrame:
    """``df`` with an error for a repeated key.  Equal keys are neighbours in what
    is range partitioned and sorted by the key, so this adds neither a shuffle
    nor a sort."""
    alike = F.count(F.lit(1)).over(Window.partitionBy(key))
    repeated = F.raise_error(F.concat(F.lit(f"repeated {key}: "), F.col(key))).cast("string")
    return df.withColumn("_alike", alike).withColumn(
        key, F.when(F.col("_alike") == 1, F.col(key)).otherwise(repeated)).drop("_alike")


def _write(df: DataFrame, path: str, file_rows: int, key: str | None = None) -> None:
    writer = df.write.mode("error").option("maxRecordsPerFile", file_rows)
    if key:
        # the writer's smallest choice is a 16th of the most: four bytes a key
        most = min(BLOOM_BYTES, file_rows * 64)
        writer = (writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
                  .option("parquet.bloom.filter.adaptive.enabled", "true")
                  .option("parquet.bloom.filter.max.bytes", most))
    writer.parquet(path)


def _rank_index(spark: SparkSession, target: str) -> DataFrame:
    """Rows per file (and situation) of every layout, and the rows before them in
    its order.  One row per file and situation; the listing's size, not the data's."""
    out = None
    for layout, order in _orders().items():
        rows = spark.read.schema(L.DEBTORS_SCHEMA).parquet(f"{target}/{layout}")
        first = F.struct(F.col("identification_number")) if layout != BY_TOTAL else F.struct(
            -F.col("total_loan_amount"), F.col("identification_number"))
        situation = F.col("max_situation") if layout == BY_SITUATION else F.lit(None).cast("string")
        stats = rows.groupBy(F.col("_metadata.file_name").alias("file"),
                             situation.alias("situation")).agg(
            F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))
        before = Window.partitionBy("situation").orderBy("first").rowsBetween(
            Window.unboundedPreceding, -1)
        one = stats.select(F.lit(layout).alias("layout"), "situation", "file", "n",
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        out = one if out is None else out.union(one)
    return out


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame],
            keep: int = 2, version: str | None = None,
            grace_hours: float = GRACE_HOURS, file_rows: int = FILE_ROWS) -> str:
    """Write every table of a version, then commit it with one marker."""
    version = version or new_version()
    target = version_dir(root, version)

    def write(name: str) -> None:
        df = tables[name]
        if name == "debtors":
            order = _orders()[BY_KEY]
            df = df.repartitionByRange(*order).sortWithinPartitions(*order)
        _write(unique_keys(df, KEYS[name]), f"{target}/{name}", file_rows, KEYS[name])
        if name == "debtors":
            _write_copies(spark, target, file_rows)

    together(spark, [partial(write, name) for name in tables])
    commit(spark, root, version)
    remove_old(spark, root, keep, grace_hours)
    return version


def together(spark: SparkSession, jobs: Sequence[Callable[[], object]]) -> list:
    """Independent jobs at the same time (small ones, one after another, only
    wait); their results, or the first error after all have ended."""
    with ThreadPoolExecutor(max(1, len(jobs))) as pool:
        ends = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    return [end.result() for end in ends]


def _write_copies(spark: SparkSession, target: str, file_rows: int) -> None:
    """The other layouts of ``debtors``, from the written one, and the index."""
    def copy(layout: str) -> None:
        df = spark.read.schema(L.DEBTORS_SCHEMA).parquet(f"{target}/{BY_KEY}")
        order = _orders()[layout]
        _write(df.repartitionByRange(*order).sortWithinPartitions(*order),
               f"{target}/{layout}", file_rows)

    together(spark, [partial(copy, layout) for layout in (BY_SITUATION, BY_TOTAL)])
    _rank_index(spark, target).coalesce(1).write.mode("error").parquet(f"{target}/{INDEX}")


def files_holding(spark: SparkSession, root: str, version: str, layout: str, skip: int, n: int,
                  situation: str | None = None) -> list[tuple[str, int]]:
    """(path, rows before it) of the files that hold rows ``skip + 1 .. skip + n``
    of a layout, in order.  Only these few index rows come to the driver."""
    target = version_dir(root, version)
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{target}/{INDEX}")
    hit = index.where((F.col("layout") == layout) & F.col("situation").eqNullSafe(situation)
                      & (F.col("before") < skip + n) & (F.col("before") + F.col("n") > skip))
    return [(f"{target}/{layout}/{r['file']}", r["before"])
            for r in hit.orderBy("before").collect()]


def count_of(spark: SparkSession, root: str, version: str, situation: str | None = None) -> DataFrame:
    """``total``: the rows of the whole table or of one situation, from the index."""
    layout = BY_KEY if situation is None else BY_SITUATION
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{version_dir(root, version)}/{INDEX}")
    return index.where((F.col("layout") == layout) & F.col("situation").eqNullSafe(situation)).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def read_published(spark: SparkSession, root: str, name: str,
                   version: str | None = None) -> DataFrame:
    """A published table of the current (or a given) committed version."""
    version = version or current_version(spark, root)
    if version is None:
        return spark.createDataFrame([], SCHEMAS[name])
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{version_dir(root, version)}/{name}")
    return df


def published_pair(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Both tables of one version (resolved once, so they are consistent)."""
    version = current_version(spark, root)
    return (read_published(spark, root, "debtors", version),
            read_published(spark, root, "entities", version))


def row_count(df: DataFrame) -> int:
    return df.select(F.lit(1)).count()

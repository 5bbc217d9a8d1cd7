"""Read queries over the published ``debtors`` / ``entities`` tables.

Arguments are checked on the driver before any plan is built (same rules
as the reference's request validation), then each query is one small
declarative plan: point lookups push an equality filter into the Parquet
scan (row-group statistics of the range-laid-out table skip the rest),
top-n plans as ``TakeOrderedAndProject`` (a bounded per-task heap), and
pages use ``ORDER BY identification_number`` with ``OFFSET``/``LIMIT``.
Every ordering ends with ``identification_number`` so ties are stable.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline import layout as L
from ledgerline.operators import publish as P

# Tables that weren't published (no rank index): pages ending within this many rows use ORDER BY + OFFSET/LIMIT (a bounded
# per-task heap merged in one task); deeper pages number rows in a sorted
# copy, so no task ever holds more than its own share.
DEEP_PAGE_ROWS = 10_000
# A partition table of this many rows is a few MB; beyond it the join shuffles.
MAX_BROADCAST_PARTITIONS = 200_000

_CUIT = re.compile(r"[0-9]{11}", re.ASCII)
_ENTITY = re.compile(r"[0-9]{1,5}", re.ASCII)

DEBTOR_COLUMNS = ["identification_number", "max_situation", "total_loan_amount"]
ENTITY_COLUMNS = ["entity_code", "total_loan_amount"]


# -- argument checks ---------------------------------------------------------

def check_cuit(cuit: str) -> str:
    if not isinstance(cuit, str) or not _CUIT.fullmatch(cuit):
        raise ValueError(f"identification number must be 11 digits: {cuit!r}")
    return cuit


def check_entity_code(code: str) -> str:
    if not isinstance(code, str) or not _ENTITY.fullmatch(code):
        raise ValueError(f"entity code must be 1 to 5 digits: {code!r}")
    return code


def check_top_n(n: int) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or not L.TOP_N_MIN <= n <= L.TOP_N_MAX:
        raise ValueError(f"n must be an integer in {L.TOP_N_MIN}..{L.TOP_N_MAX}: {n!r}")
    return n


def check_situation(situation: str | None) -> str | None:
    if situation is not None and situation not in L.SITUATION_CODES:
        raise ValueError(f"situation must be one of {L.SITUATION_CODES}: {situation!r}")
    return situation


def check_per_page(per_page: int | None) -> int:
    if per_page is None:
        return L.PER_PAGE_DEFAULT
    if (isinstance(per_page, bool) or not isinstance(per_page, int)
            or not L.PER_PAGE_MIN <= per_page <= L.PER_PAGE_MAX):
        raise ValueError(f"per_page must be in {L.PER_PAGE_MIN}..{L.PER_PAGE_MAX}: {per_page!r}")
    return per_page


def check_page(page: int | None) -> int:
    if page is None:
        return 1
    if isinstance(page, bool) or not isinstance(page, int) or page < 1:
        raise ValueError(f"page must be a positive integer: {page!r}")
    return page


# -- queries -----------------------------------------------------------------

def debtor_by_cuit(debtors: DataFrame, cuit: str) -> DataFrame:
    """At most one row; an empty result means "not found"."""
    cuit = check_cuit(cuit)
    return debtors.where(F.col("identification_number") == F.lit(cuit)).select(
        *DEBTOR_COLUMNS).limit(1)


def entity_by_code(entities: DataFrame, code: str) -> DataFrame:
    """Exact string match (``1`` does not match ``00001``)."""
    code = check_entity_code(code)
    return entities.where(F.col("entity_code") == F.lit(code)).select(*ENTITY_COLUMNS).limit(1)


def top_debtors(debtors: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest totals, ties by identification number."""
    n = check_top_n(n)
    return (debtors.select(*DEBTOR_COLUMNS)
            .orderBy(F.col("total_loan_amount").desc(), F.col("identification_number").asc())
            .limit(n))


def with_position(limited: DataFrame, order_cols: list) -> DataFrame:
    """1-based position inside an already limited (≤ 1000 rows) result."""
    return limited.withColumn("position", F.row_number().over(Window.orderBy(*order_cols)))


def top_debtors_ranked(debtors: DataFrame, n: int) -> DataFrame:
    order = [F.col("total_loan_amount").desc(), F.col("identification_number").asc()]
    return with_position(top_debtors(debtors, n), order)


def top_debtors_meta(debtors: DataFrame, n: int) -> DataFrame:
    """``count`` of the top-n result (fewer than n when the table is small)."""
    top = top_debtors(debtors, n)
    return top.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit(n).alias("n_requested"), "count")


def debtors_filtered(debtors: DataFrame, situation: str | None = None) -> DataFrame:
    situation = check_situation(situation)
    out = debtors.select(*DEBTOR_COLUMNS)
    if situation is not None:
        out = out.where(F.col("max_situation") == F.lit(situation))
    return out


def positioned_slice(df: DataFrame, key: str, skip: int, n: int) -> DataFrame:
    """Rows ``skip+1 .. skip+n`` of ``df`` ordered by the unique ``key``, with
    their 1-based ``position``, computed without a global window.

    The sorted copy is range partitioned and checkpointed (stable partition
    ids and order); each partition reports its first row id and row count,
    a prefix sum over that small table (one row per partition) gives the
    rows before each partition, and a join puts positions back.
    """
    ordered = df.orderBy(key).checkpoint(eager=True)
    tagged = ordered.select("*", F.spark_partition_id().alias("_part"),
                            F.monotonically_increasing_id().alias("_row"))
    stats = tagged.groupBy("_part").agg(F.min("_row").alias("_first"),
                                        F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.select("_part", "_first",
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    n_parts = ordered.rdd.getNumPartitions()
    side = F.broadcast(stats) if n_parts <= MAX_BROADCAST_PARTITIONS else stats
    pos = F.col("_before") + (F.col("_row") - F.col("_first")) + F.lit(1)
    out = tagged.join(side, "_part").withColumn("position", pos)
    return (out.where((F.col("position") > skip) & (F.col("position") <= skip + n))
            .drop("_part", "_row", "_first", "_before"))


def debtors_page(debtors: DataFrame, situation: str | None = None, page: int | None = None,
                 per_page: int | None = None) -> DataFrame:
    """Page ``page`` (1-based) of ``per_page`` rows, ordered by identification
    number, with each row's ``position`` in the filtered list."""
    per_page = check_per_page(per_page)
    page = check_page(page)
    skip = (page - 1) * per_page
    filtered = debtors_filtered(debtors, situation)
    if skip + per_page > DEEP_PAGE_ROWS:
        return positioned_slice(filtered, "identification_number", skip, per_page)
    rows = filtered.orderBy("identification_number").offset(skip).limit(per_page)
    return rows.withColumn(
        "position",
        (F.row_number().over(Window.orderBy("identification_number")) + F.lit(skip)).cast("long"))


def page_meta(debtors: DataFrame, situation: str | None = None, page: int | None = None,
              per_page: int | None = None) -> DataFrame:
    """``total, per_page, current_page, last_page`` of the filtered list."""
    per_page = check_per_page(per_page)
    page = check_page(page)
    total = debtors_filtered(debtors, situation).agg(F.count(F.lit(1)).alias("total"))
    return _meta(total, page, per_page)


def _meta(total: DataFrame, page: int, per_page: int) -> DataFrame:
    return total.select(
        "total",
        F.lit(per_page).alias("per_page"),
        F.lit(page).alias("current_page"),
        F.greatest(F.ceil(F.col("total") / F.lit(per_page)), F.lit(1)).cast("long")
        .alias("last_page"),
    )


# -- published tables: layouts and rank index ---------------------------------
# The same results as above, reading only the files that can hold them.

def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], L.DEBTORS_SCHEMA)
    return spark.read.schema(L.DEBTORS_SCHEMA).parquet(*paths)


def published_page(spark: SparkSession, root: str, situation: str | None = None,
                   page: int | None = None, per_page: int | None = None,
                   version: str | None = None) -> DataFrame:
    """``debtors_page`` of a published version, at any depth: the rank index names
    the files that hold the page, and the rows before the first of them.  The
    files of a layout are consecutive ranges, so the page lies in the sorted rows
    of one file or of two (more only where files are smaller than a page)."""
    situation, per_page, page = check_situation(situation), check_per_page(per_page), check_page(page)
    version = version or P.current_version(spark, root)
    skip = (page - 1) * per_page
    layout = P.BY_KEY if situation is None else P.BY_SITUATION
    found = P.files_holding(spark, root, version, layout, skip, per_page, situation) if version else []
    rows = debtors_filtered(_files(spark, [path for path, _ in found]), situation)
    before = found[0][1] if found else 0
    return with_position(
        rows.orderBy("identification_number").offset(skip - before if found else 0).limit(per_page),
        [F.col("identification_number")]).withColumn(
        "position", (F.col("position") + F.lit(skip)).cast("long"))


def published_page_meta(spark: SparkSession, root: str, situation: str | None = None,
                        page: int | None = None, per_page: int | None = None,
                        version: str | None = None) -> DataFrame:
    """``page_meta`` from the rank index alone."""
    situation, per_page, page = check_situation(situation), check_per_page(per_page), check_page(page)
    version = version or P.current_version(spark, root)
    total = P.count_of(spark, root, version, situation) if version else \
        spark.range(1).select(F.lit(0).cast("long").alias("total"))
    return _meta(total, page, per_page)


def published_top(spark: SparkSession, root: str, n: int, version: str | None = None) -> DataFrame:
    """``top_debtors_ranked`` of a published version: files are ordered by total, so
    the walk ends at the file that completes ``n`` rows; no later one can hold a
    better row."""
    n = check_top_n(n)
    version = version or P.current_version(spark, root)
    found = P.files_holding(spark, root, version, P.BY_TOTAL, 0, n) if version else []
    return top_debtors_ranked(_files(spark, [path for path, _ in found]), n)


def published_by_situation(spark: SparkSession, root: str, situation: str,
                           version: str | None = None) -> DataFrame:
    """``debtors_filtered`` by a situation, from the files that hold it."""
    situation = check_situation(situation)
    version = version or P.current_version(spark, root)
    found = P.files_holding(spark, root, version, P.BY_SITUATION, 0, 1 << 62, situation) \
        if version else []
    return debtors_filtered(_files(spark, [path for path, _ in found]), situation)

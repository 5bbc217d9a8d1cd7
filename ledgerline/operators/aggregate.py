"""Per-debtor and per-entity aggregates over staged records.

Both are one hash aggregation each: partial aggregation runs map-side in
the scan stage, so a hot key (one debtor or one lending entity holding a
large share of all rows) collapses to one small row per task before the
shuffle; no salting is needed for these algebraic aggregates.  The worst
situation is a MAX over an integer severity rank mapped back to its code,
which keeps a fixed-width aggregation buffer (HashAggregate, not
SortAggregate) and orders by severity rather than alphabetically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline import layout as L
from ledgerline.functions import exprs as X


def debtors(staged: DataFrame) -> DataFrame:
    """``identification_number, max_situation, total_loan_amount``."""
    return staged.groupBy("identification_number").agg(
        X.code_of_rank(F.max(X.severity("situation"))).alias("max_situation"),
        F.sum("loans").cast(L.MONEY).alias("total_loan_amount"),
    )


def entities(staged: DataFrame) -> DataFrame:
    """``entity_code, total_loan_amount``."""
    return staged.groupBy("entity_code").agg(
        F.sum("loans").cast(L.MONEY).alias("total_loan_amount"),
    )


# Partial aggregates of a part of the input.  Sums are kept wide: only the sum
# over all parts has to fit the published type.
DEBTOR_PARTIAL = "identification_number string, worst int, total decimal(38,2)"
ENTITY_PARTIAL = "entity_code string, total decimal(38,2)"


def debtor_partials(staged: DataFrame) -> DataFrame:
    return staged.groupBy("identification_number").agg(
        F.max(X.severity("situation")).alias("worst"),
        F.sum("loans").cast("decimal(38,2)").alias("total"))


def entity_partials(staged: DataFrame) -> DataFrame:
    return staged.groupBy("entity_code").agg(
        F.sum("loans").cast("decimal(38,2)").alias("total"))


def merge_debtors(partials: DataFrame) -> DataFrame:
    """The ``debtors`` of all rows, from the partials of disjoint parts."""
    return partials.groupBy("identification_number").agg(
        X.code_of_rank(F.max("worst")).alias("max_situation"),
        F.sum("total").cast(L.MONEY).alias("total_loan_amount"))


def merge_entities(partials: DataFrame) -> DataFrame:
    return partials.groupBy("entity_code").agg(
        F.sum("total").cast(L.MONEY).alias("total_loan_amount"))


def with_loaded_at(df: DataFrame, loaded_at) -> DataFrame:
    """One load timestamp literal per run (not a per-row clock)."""
    return df.withColumn("loaded_at", X.instant(loaded_at))


def key_uniqueness(table: DataFrame, key: str, table_name: str) -> DataFrame:
    """One row: number of keys and of keys seen more than once (must be 0)."""
    per_key = table.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("n") > 1).alias("n_duplicate_keys"),
    ).select(F.lit(table_name).alias("table_name"), "n_keys", "n_duplicate_keys")

"""Every registry query against its DuckDB oracle on the smallest test data.

Queries of optional parts that SQL cannot express are held to a named
brute-force test where those parts are tested."""

import os

import pytest

from oracle_check import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(f"{SF}/lineitem.parquet"), reason="no test data")
def test_all_queries_match_oracles(spark):
    from ledgerline.plans.driver_queries import QUERIES
    res = compare(spark, SF, sorted(QUERIES), verbose=False)
    bad = {k: v for k, v in res.items() if v != "OK"}
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["identification_number", "max_situation", "total_loan_amount"]
    assert df.count() > 0
    from ledgerline.plans.driver_queries import QUERIES
    assert set(QUERIES) <= set(E.queries()) and set(QUERIES) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())

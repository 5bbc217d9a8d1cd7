"""Published layouts: rank index, pages and top n by few files, Bloom filters, unique keys."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline import fs
from ledgerline import layout as L
from ledgerline.operators import publish as P
from ledgerline.operators import reads as Q
from ledgerline.plans import driver_queries as D

N = 2000


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """2,000 debtors with many ties in totals, in files of 150 rows."""
    rows = [(f"{20000000000 + 2 * i}", L.SITUATION_CODES[i * i % 7], Decimal(i * 37 % 60), None)
            for i in range(N)]
    df = spark.createDataFrame(rows, L.DEBTORS_SCHEMA).repartition(7)
    entities = spark.createDataFrame([(f"E{i}", Decimal(i), None) for i in range(9)],
                                     L.ENTITIES_SCHEMA)
    path = str(tmp_path_factory.mktemp("published") / "p")
    P.publish(spark, path, {"debtors": df, "entities": entities}, file_rows=150)
    return path


def result(df):
    return sorted((tuple(r) for r in df.select("position", *Q.DEBTOR_COLUMNS).collect()))


@pytest.mark.parametrize("situation", [None, "01", "05", "23"])
@pytest.mark.parametrize("page,per_page", [(1, 50), (2, 200), (3, 7), (7, 50), (10, 200), (40, 50),
                                           (9999, 50)])
def test_pages_match_and_read_few_files(spark, root, situation, page, per_page):
    debtors = P.read_published(spark, root, "debtors")
    got = Q.published_page(spark, root, situation, page, per_page)
    assert result(got) == result(Q.debtors_page(debtors, situation, page, per_page))
    assert len(got.inputFiles()) <= (2 if per_page <= 150 else 3)
    assert [tuple(r) for r in Q.published_page_meta(spark, root, situation, page, per_page).collect()] \
        == [tuple(r) for r in Q.page_meta(debtors, situation, page, per_page).collect()]


@pytest.mark.parametrize("n", [1, 10, 149, 150, 151, 1000])
def test_top_reads_the_files_that_can_hold_it(spark, root, n):
    debtors = P.read_published(spark, root, "debtors")
    got = Q.published_top(spark, root, n)
    assert result(got) == result(Q.top_debtors_ranked(debtors, n))
    whole = len(debtors.inputFiles())
    assert whole >= N // 150 and len(got.inputFiles()) <= n // 150 + 2


def test_situation_list_reads_its_files(spark, root):
    debtors = P.read_published(spark, root, "debtors")
    for code in L.SITUATION_CODES:
        want = sorted(map(tuple, Q.debtors_filtered(debtors, code).collect()))
        got = Q.published_by_situation(spark, root, code)
        assert sorted(map(tuple, got.collect())) == want
        assert len(got.inputFiles()) <= len(want) // 150 + 3


def test_a_missing_key_reads_no_row_group(spark, root):
    """The key lies inside the files' min and max; the Bloom filter excludes it."""
    def rows_scanned(key):
        q = Q.debtor_by_cuit(P.read_published(spark, root, "debtors"), key)
        found = q.collect()
        scan = q._jdf.queryExecution().executedPlan().collectLeaves().head()
        return len(found), scan.metrics().get("numOutputRows").get().value()
    assert rows_scanned(str(20000000000 + 2 * 777 + 1)) == (0, 0)
    found, scanned = rows_scanned(str(20000000000 + 2 * 777))
    assert found == 1 and 0 < scanned <= 150


def test_a_repeated_key_stops_the_commit(spark, tmp_path):
    path = str(tmp_path / "p")
    good = spark.createDataFrame([("1", "01", Decimal(1), None)], L.DEBTORS_SCHEMA)
    first = P.publish(spark, path, {"debtors": good})
    rows = [(str(i), "01", Decimal(i), None) for i in range(50)]
    twice = spark.createDataFrame([*rows, ("17", "05", Decimal(1), None)], L.DEBTORS_SCHEMA)
    with pytest.raises(Exception, match="repeated identification_number: 17"):
        P.publish(spark, path, {"debtors": twice.repartition(4)})
    entities = spark.createDataFrame([("E", Decimal(1), None)] * 2, L.ENTITIES_SCHEMA)
    with pytest.raises(Exception, match="repeated entity_code: E"):
        P.publish(spark, path, {"debtors": good, "entities": entities})
    assert P.committed_versions(spark, path) == [first]


def test_unique_check_adds_no_shuffle_or_sort(spark):
    key = "identification_number"
    df = spark.range(100).select(F.col("id").cast("string").alias(key))
    laid = P.unique_keys(df.repartitionByRange(key).sortWithinPartitions(key), key)
    plan = laid._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and "Window" in plan


def test_nothing_published(spark, tmp_path):
    path = str(tmp_path / "none")
    assert Q.published_page(spark, path).collect() == []
    assert Q.published_top(spark, path, 5).collect() == []
    assert Q.published_by_situation(spark, path, "01").collect() == []
    assert tuple(Q.published_page_meta(spark, path).first()) == (0, 50, 1, 1)


def test_small_files_have_small_bloom_filters(spark, root):
    """A file is as large as its rows need: 150 keys, not the filter's upper bound."""
    whole = f"{P.version_dir(root, P.current_version(spark, root))}/{P.BY_KEY}"
    sizes = [length for _, length, _ in fs.files_below(spark, whole)]
    assert len(sizes) >= N // 150 and max(sizes) < 20_000


def test_indexed_files_are_bounded_in_number():
    assert D.indexed_file_rows(15_000) == D.INDEXED_FILE_ROWS
    for n in (900_000, 5_400_000, 10 ** 9):
        assert n / D.indexed_file_rows(n) <= D.INDEXED_FILES

from decimal import Decimal

import pytest

from ledgerline import layout as L
from ledgerline.operators import reads as Q


@pytest.fixture()
def debtors(spark):
    rows = [(f"2000000{i:04d}", "03" if i % 3 == 0 else "01", Decimal(1000 * (i % 7)), None)
            for i in range(60)]
    rows += [("20345123458", "05", Decimal("5000"), None)]
    return spark.createDataFrame(rows, L.DEBTORS_SCHEMA)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup(debtors):
    assert [r.max_situation for r in Q.debtor_by_cuit(debtors, "20345123458").collect()] == ["05"]
    assert Q.debtor_by_cuit(debtors, "20999999999").count() == 0
    for bad in ["12345", "2034512345A", "203451234580", " 20345123458"]:
        with pytest.raises(ValueError):
            Q.debtor_by_cuit(debtors, bad)


def test_top_n_order_and_meta(spark):
    d = spark.createDataFrame([("20000000001", "01", Decimal("1000"), None),
                               ("20000000002", "01", Decimal("5000"), None),
                               ("20000000003", "01", Decimal("3000"), None)], L.DEBTORS_SCHEMA)
    assert [r.total_loan_amount for r in Q.top_debtors(d, 2).collect()] == [
        Decimal("5000.00"), Decimal("3000.00")]
    assert Q.top_debtors_meta(d, 2).first()["count"] == 2
    assert Q.top_debtors_meta(d, 10).first()["count"] == 3
    for bad in [0, -1, 1001, "5", True]:
        with pytest.raises(ValueError):
            Q.top_debtors(d, bad)
    assert "TakeOrderedAndProject" in _plan(Q.top_debtors(d, 2))


def test_top_ties_broken_by_id(spark):
    d = spark.createDataFrame([("20000000009", "01", Decimal("7"), None),
                               ("20000000001", "01", Decimal("7"), None)], L.DEBTORS_SCHEMA)
    assert [r.identification_number for r in Q.top_debtors_ranked(d, 2).collect()] == [
        "20000000001", "20000000009"]


def test_pages_and_filter(debtors):
    assert Q.debtors_page(debtors).count() == 50           # default page size
    assert Q.debtors_page(debtors, page=2).count() == 11
    meta = Q.page_meta(debtors).first()
    assert (meta.total, meta.per_page, meta.current_page, meta.last_page) == (61, 50, 1, 2)
    assert Q.debtors_filtered(debtors, "03").count() == 20
    page = Q.debtors_page(debtors, "03", page=2, per_page=7).collect()
    assert [r.position for r in page] == list(range(8, 15))
    ids = [r.identification_number for r in page]
    assert ids == sorted(ids)
    with pytest.raises(ValueError):
        Q.debtors_filtered(debtors, "99")
    for bad in [0, 201]:
        with pytest.raises(ValueError):
            Q.debtors_page(debtors, per_page=bad)
    assert Q.page_meta(debtors, "23").first().last_page == 1


def test_entity_exact_match(spark):
    e = spark.createDataFrame([("00001", Decimal("1"), None), ("1", Decimal("2"), None)],
                              L.ENTITIES_SCHEMA)
    assert [r.total_loan_amount for r in Q.entity_by_code(e, "00001").collect()] == [Decimal("1.00")]
    assert [r.total_loan_amount for r in Q.entity_by_code(e, "1").collect()] == [Decimal("2.00")]
    assert Q.entity_by_code(e, "99999").count() == 0
    with pytest.raises(ValueError):
        Q.entity_by_code(e, "123456")


def test_lookup_filter_reaches_parquet_scan(spark, debtors, tmp_path):
    p = str(tmp_path / "d")
    debtors.write.parquet(p)
    plan = _plan(Q.debtor_by_cuit(spark.read.schema(L.DEBTORS_SCHEMA).parquet(p), "20345123458"))
    assert "PushedFilters" in plan and "EqualTo(identification_number,20345123458)" in plan


def test_deep_page_path_equals_shallow(spark, monkeypatch):
    rows = [(f"2{i:010d}", "03" if i % 4 else "01", Decimal(i), None) for i in range(0, 5000, 3)]
    d = spark.createDataFrame(rows, L.DEBTORS_SCHEMA).repartition(7)
    shallow = [tuple(r) for r in Q.debtors_page(d, "03", page=9, per_page=37).collect()]
    monkeypatch.setattr(Q, "DEEP_PAGE_ROWS", 10)
    deep = Q.debtors_page(d, "03", page=9, per_page=37)
    got = sorted(tuple(r) for r in deep.select(*shallow_cols(deep)).collect())
    assert got == sorted(shallow) and len(got) == 37
    assert [r[-1] for r in sorted(shallow, key=lambda r: r[-1])] == list(range(297, 334))
    # past the end: empty, same in both paths
    assert Q.debtors_page(d, "03", page=200, per_page=37).count() == 0


def shallow_cols(df):
    return ["identification_number", "max_situation", "total_loan_amount", "position"]

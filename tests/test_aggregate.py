from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline import layout as L
from ledgerline.operators import aggregate as A

SCHEMA = "identification_number string, entity_code string, situation string, loans decimal(18,2)"


def _debtors(spark, rows):
    df = spark.createDataFrame([("20345123458", "BCO01", s, Decimal(v)) for s, v in rows], SCHEMA)
    return [(r.max_situation, r.total_loan_amount) for r in A.debtors(df).collect()]


def test_severity_not_alphabet(spark):
    assert _debtors(spark, [("05", "100"), ("23", "200")]) == [("05", Decimal("300.00"))]
    assert _debtors(spark, [("23", "200"), ("05", "100")]) == [("05", Decimal("300.00"))]
    assert _debtors(spark, [("23", "150"), ("21", "100")]) == [("23", Decimal("250.00"))]
    assert _debtors(spark, [("01", "500")]) == [("01", Decimal("500.00"))]
    assert _debtors(spark, [("23", "100"), ("03", "100")])[0][0] == "03"
    assert _debtors(spark, [("01", "100"), ("11", "200"), ("21", "300")]) == [
        ("21", Decimal("600.00"))]


def test_entities_independent(spark):
    rows = [("1", "BCO01", "01", Decimal("100")), ("2", "BCO01", "01", Decimal("50")),
            ("3", "BCO02", "01", Decimal("200")), ("4", "BCO03", "01", Decimal("300")),
            ("5", "BCO03", "05", Decimal("700"))]
    got = {r.entity_code: r.total_loan_amount
           for r in A.entities(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"BCO01": Decimal("150.00"), "BCO02": Decimal("200.00"),
                   "BCO03": Decimal("1000.00")}


def test_key_uniqueness(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    r = A.key_uniqueness(df, "k", "t").first()
    assert (r.table_name, r.n_keys, r.n_duplicate_keys) == ("t", 2, 1)


def test_debtors_plan_is_hash_aggregate(spark):
    df = spark.createDataFrame([("1", "E", "01", Decimal("1"))], SCHEMA)
    plan = A.debtors(df)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


row = st.tuples(st.sampled_from(["a", "b", "c", "d"]), st.sampled_from(["E1", "E2", "E3"]),
                st.sampled_from(L.SITUATION_CODES),
                st.decimals(min_value=0, max_value=10**6, places=2, allow_nan=False))


@settings(max_examples=15, deadline=None)
@given(st.lists(row, min_size=1, max_size=30), st.randoms())
def test_properties(spark, rows, rnd):
    """Order independence, severity max, and sum consistency."""
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    a = spark.createDataFrame(rows, SCHEMA)
    b = spark.createDataFrame(shuffled, SCHEMA)
    da = sorted(tuple(r) for r in A.debtors(a).collect())
    assert da == sorted(tuple(r) for r in A.debtors(b).collect())
    for ident, worst, total in da:
        mine = [r for r in rows if r[0] == ident]
        assert worst == max((r[2] for r in mine), key=L.SITUATION_CODES.index)
        assert total == sum(r[3] for r in mine)
    ents = A.entities(a).collect()
    assert sum(r.total_loan_amount for r in ents) == sum(t for _, _, t in da) == sum(
        r[3] for r in rows)

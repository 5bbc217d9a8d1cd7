from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline import layout as L
from ledgerline.functions import exprs as X


def _eval(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


AMOUNTS = [
    ("0000001500,5", Decimal("1500.50")),
    ("000000001500", Decimal("1500.00")),      # no comma: whole units
    ("00000001500,", Decimal("1500.00")),      # no decimal digit
    ("1,0" + " " * 9, Decimal("1.00")),
    (",0" + " " * 10, Decimal("0.00")),
    (" " * 12, Decimal("0.00")),
    ("", Decimal("0.00")),
    ("000000011,1", Decimal("11.10")),
    ("12345678901,5", Decimal("12345678901.50")),
    ("00000000000,0", Decimal("0.00")),
    ("99999999999,9", Decimal("99999999999.90")),
    ("12abc", Decimal("12.00")),
    ("1e3", Decimal("1000.00")),
    ("00000000,125", Decimal("0.13")),         # half-up at two decimals
    ("-00000000017", Decimal("-17.00")),
    ("00 000000017", Decimal("17.00")),        # zeros dropped first, then blanks allowed
    ("abc", Decimal("0.00")),
    (",", Decimal("0.00")),
    ("17,5" + " " * 8, Decimal("17.50")),     # trailing blanks
    (",3" + " " * 10, Decimal("0.30")),
    ("0 0", Decimal("0.00")),
    (" 1", Decimal("1.00")),                  # leading blank after no zeros
    ("0000,5,3", Decimal("0.50")),            # second separator ends the number
    ("1.5", Decimal("1.50")),                 # a point is not the registry's separator, still numeric
]


def test_parse_amount(spark):
    got = _eval(spark, [a for a, _ in AMOUNTS], X.parse_amount)
    assert got == [b for _, b in AMOUNTS]


def test_amount_add(spark):
    df = spark.createDataFrame([(Decimal("10.5"), Decimal("20.3")), (Decimal("10.5"), Decimal("0"))],
                               "a decimal(18,2), b decimal(18,2)")
    assert [r[0] for r in df.select(X.amount_add("a", "b")).collect()] == [
        Decimal("30.80"), Decimal("10.50")]


def test_lenient_int(spark):
    got = _eval(spark, ["0000", "0042", "  17", "17xx", "ab12", "1e2", "", "-003"], X.lenient_int)
    assert got == [0, 42, 17, 17, 0, 100, 0, -3]


def test_normalize_situation(spark):
    raw = ["1 ", "2 ", "3 ", "4 ", "5 ", "01", "23", "99", "  ", " 1", "\t5"]
    assert _eval(spark, raw, X.normalize_situation) == [
        "01", "21", "03", "04", "05", "01", "23", "99", "", "01", "05"]


def test_severity_chain_and_unknown(spark):
    codes = L.SITUATION_CODES + ["99", ""]
    assert _eval(spark, codes, X.severity) == [0, 1, 2, 3, 4, 5, 6, None, None]
    # an unknown rank never becomes the worst code
    df = spark.createDataFrame([(None,), (7,), (6,), (0,)], "r int")
    assert [r[0] for r in df.select(X.code_of_rank("r")).collect()] == [None, None, "05", "01"]


def test_is_worse_than(spark):
    pairs = [("05", "23", True), ("23", "21", True), ("03", "23", True), ("01", "01", False),
             ("21", "23", False), ("05", "05", False)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    assert [r[0] for r in df.select(X.is_worse_than("a", "b")).collect()] == [
        w for _, _, w in pairs]


@pytest.mark.parametrize("ident,ok", [
    ("20345123458", True), ("  20345123458  ", True), ("", False), ("     ", False),
    ("2034512345", False), ("203451234580", False), ("203451234AB", False), (None, False),
])
def test_valid_cuit(spark, ident, ok):
    assert _eval(spark, [ident], X.is_valid_cuit) == [ok]


def test_trim_set(spark):
    assert _eval(spark, [" \t\x00\x0bab\r\n"], X.registry_trim) == ["ab"]


def test_run_slug_and_basename(spark):
    assert _eval(spark, ["aabbccdd-1122-3344-5566-778899aabbcc"], X.run_slug) == ["aabbccdd1122"]
    assert _eval(spark, ["s3a://bucket/in/debtors.txt", "/x/y/", "plain"], X.basename) == [
        "debtors.txt", "y", "plain"]


def test_iso_utc(spark):
    df = spark.sql("SELECT TIMESTAMP '2026-06-08 12:00:00' AS ts")
    assert df.select(X.iso_utc("ts")).first()[0] == "2026-06-08T12:00:00Z"


def test_situation_check_matches_normalization(spark):
    """The raw-text validity check equals 'normalize, then look up'."""
    from ledgerline.operators import classify as C
    raws = ["01", "11", "21", "23", "03", "04", "05", "1 ", " 2", "3\t", "4", "5 ", "6 ", "02",
            "99", "  ", "", "0", "1\x00", "Ñ1"]
    df = spark.createDataFrame([(r.encode("latin-1").ljust(2, b" ") if r else b"  ",)
                                for r in raws], "b binary")
    df = df.select(F.concat(F.lit(bytearray(b"x" * 27)), "b").alias("raw"))
    got = df.select(C.situation_is_valid("raw").alias("a"),
                    X.is_valid_situation(C.field("situation")).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]
    assert sum(r.a for r in got) == 13


def test_iso_utc_in_another_session_zone(spark):
    from datetime import datetime, timezone
    epoch = int(datetime(2026, 6, 8, 12, 0, 0, tzinfo=timezone.utc).timestamp())
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Argentina/Buenos_Aires")
        df = spark.range(1).select(F.timestamp_seconds(F.lit(epoch)).alias("ts"))
        assert df.select(F.date_format("ts", "HH").alias("h")).first()[0] == "09"  # local
        assert df.select(X.iso_utc("ts")).first()[0] == "2026-06-08T12:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)

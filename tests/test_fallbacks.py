"""The shuffle-join branches taken beyond each broadcast bound give the same
answers as the broadcast branches."""

from decimal import Decimal

from pyspark.sql import functions as F

from conftest import make_line
from ledgerline import layout as L
from ledgerline.operators import reads as Q
from ledgerline.operators import staging as S
from ledgerline.sources import registry_text as RT


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_numbers_without_broadcast(spark, write_file):
    path = write_file([f"line {i}" for i in range(500)])
    lines = RT.read_lines(spark, path)
    a = sorted(tuple(r) for r in RT.with_line_numbers(lines).select("line_number", "line").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = RT.with_line_numbers(lines, max_broadcast_bytes=0)
        assert "BroadcastHashJoin" not in _plan(df)
        b = sorted(tuple(r) for r in df.select("line_number", "line").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert a == b and a[0] == (1, "line 0") and a[-1] == (500, "line 499")


def test_resume_without_broadcast(spark, write_file, workspace, monkeypatch):
    path = write_file([make_line(ident=f"{20000000000 + i}") for i in range(300)])
    lines = RT.with_line_numbers(RT.read_lines(spark, path))
    S.stage(S.staged_rows(lines.where(F.col("line_number") <= 120)), workspace.staging, "r1")
    monkeypatch.setattr(S, "MAX_BROADCAST_FILES", 0)
    S.load_with_resume(spark, path, workspace.staging, "r1")
    got = S.staged(spark, workspace.staging, "r1", [L.KIND_VALID]).select("line_number")
    assert sorted(r[0] for r in got.collect()) == list(range(1, 301))


def test_deep_page_without_broadcast(spark, monkeypatch):
    rows = [(f"2{i:010d}", "03", Decimal(i), None) for i in range(400)]
    d = spark.createDataFrame(rows, L.DEBTORS_SCHEMA).repartition(5)
    monkeypatch.setattr(Q, "DEEP_PAGE_ROWS", 0)
    monkeypatch.setattr(Q, "MAX_BROADCAST_PARTITIONS", -1)
    page = Q.debtors_page(d, "03", page=3, per_page=50).collect()
    assert sorted(r.position for r in page) == list(range(101, 151))
    assert sorted(r.identification_number for r in page) == [f"2{i:010d}" for i in range(100, 150)]

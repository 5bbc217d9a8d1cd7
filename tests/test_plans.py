"""Plan shapes the design relies on."""

import re

from conftest import make_line
from ledgerline import layout as L
from ledgerline.operators import aggregate as A
from ledgerline.operators import staging as S
from ledgerline.sources import registry_text as RT


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_staging_is_one_text_scan_without_shuffle(spark, write_file):
    rows = S.staged_rows(RT.read_lines(spark, write_file([make_line()] * 3)))
    plan = _plan(rows)
    assert plan.count("FileScan text") == 1
    assert "Exchange" not in plan and "Python" not in plan


def test_aggregates_read_only_needed_staged_columns(spark, write_file, workspace):
    path = write_file([make_line(), make_line(situation="05")])
    S.stage(S.staged_rows(RT.read_lines(spark, path)), workspace.staging, "p1")
    valid = S.staged(spark, workspace.staging, "p1", [L.KIND_VALID])
    qe = A.debtors(valid)._jdf.queryExecution()
    plan = qe.executedPlan().toString()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", qe.simpleString()).group(1)
    cols = set(re.findall(r"(\w+):", schema))
    assert cols == {"identification_number", "situation", "loans", "kind"}
    assert "PushedFilters: [IsNotNull(kind), EqualTo(kind,valid)]" in plan or \
        "EqualTo(kind,valid)" in plan
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_full_parse_methods_can_be_compiled(spark, write_file):
    """Every generated method of the 24-field parse is under 8,000 bytes."""
    import contextlib
    import io
    import re

    from ledgerline.operators import classify as C
    from ledgerline.sources import registry_text as RT
    df = C.valid_records(RT.read_lines(spark, write_file([make_line()]))).select(*L.FIELD_NAMES)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
    assert sizes and max(sizes) < 8000
    assert len(df.collect()) == 1

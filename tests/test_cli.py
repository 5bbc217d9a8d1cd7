import io
import json

from conftest import make_line
from ledgerline.__main__ import main


def _run(spark, ws, *argv):
    out = io.StringIO()
    code = main(["--workspace", ws.root, *argv], spark=spark, out=out)
    return code, [json.loads(x) for x in out.getvalue().splitlines()]


def test_cli_import_and_queries(spark, write_file, workspace):
    path = write_file([make_line(ident="20000000001", loans="0000001000,0", situation="03"),
                       make_line(ident="20000000002", loans="0000005000,0", situation="05"),
                       make_line(ident="20000000003", loans="0000003000,0", entity="00002"),
                       "short"])
    code, rows = _run(spark, workspace, "import", path)
    assert code == 0 and rows[0]["total_debtors"] == 3 and rows[0]["total_entities"] == 2

    code, rows = _run(spark, workspace, "debtor", "20000000002")
    assert code == 0 and rows == [{"identification_number": "20000000002",
                                   "max_situation": "05", "total_loan_amount": 5000.0}]
    assert _run(spark, workspace, "debtor", "20999999999")[0] == 2          # not found
    assert _run(spark, workspace, "debtor", "12345")[0] == 1                # bad argument

    code, rows = _run(spark, workspace, "top", "2")
    assert [r["identification_number"] for r in rows] == ["20000000002", "20000000003"]

    code, rows = _run(spark, workspace, "debtors", "--situation", "03")
    assert rows[0]["total"] == 1 and rows[1]["identification_number"] == "20000000001"

    code, rows = _run(spark, workspace, "entity", "00002")
    assert rows[0]["total_loan_amount"] == 3000.0

    code, rows = _run(spark, workspace, "runs")
    assert rows[0]["status"] == "completed" and rows[0]["invalid_records"] == 1
    assert _run(spark, workspace, "runs", "--active")[1] == []


def test_cli_refuses_while_a_run_is_active(spark, write_file, workspace):
    from datetime import datetime
    from ledgerline.operators import runs as R
    R.append_event(spark, workspace.runs, "busy-run", datetime(2026, 1, 1), status="processing")
    path = write_file([make_line()])
    code, rows = _run(spark, workspace, "import", path)
    assert code == 3 and rows[0]["run_id"] == "busy-run"
    assert _run(spark, workspace, "import", path, "--force")[0] == 0

"""Command line: import a registry delivery and run the read queries.

    python -m ledgerline [--workspace DIR] import PATH [--run-id ID] [--force]
    python -m ledgerline [--workspace DIR] debtor CUIT
    python -m ledgerline [--workspace DIR] entity CODE
    python -m ledgerline [--workspace DIR] top N
    python -m ledgerline [--workspace DIR] debtors [--situation S] [--page P] [--per-page N]
    python -m ledgerline [--workspace DIR] runs [--active]

Results print as JSON lines.  Only bounded results are printed (a lookup,
at most 1000 top rows, one page of at most 200 rows, the run list).
Without ``--workspace`` the default workspace under the session's
``spark.checkpoint.dir`` is used.  The master and other settings come from
``spark-submit`` / the environment, as for any Spark application.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from ledgerline.operators import publish as P
from ledgerline.operators import reads as Q
from ledgerline.operators import runs as R
from ledgerline.plans.import_job import Workspace, run_import
from ledgerline.session import ensure_checkpoint_dir


def _print(df: DataFrame, out=sys.stdout) -> int:
    n = 0
    for line in df.toJSON().collect():
        print(line, file=out)
        n += 1
    return n


def parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="python -m ledgerline")
    ap.add_argument("--workspace", help="workspace folder (any Hadoop path)")
    sub = ap.add_subparsers(dest="cmd", required=True)
    imp = sub.add_parser("import", help="import a registry file or folder")
    imp.add_argument("path")
    imp.add_argument("--run-id")
    imp.add_argument("--part-bytes", type=int, help="commit after every so many bytes of text")
    imp.add_argument("--force", action="store_true",
                     help="import even if another run is pending or processing")
    sub.add_parser("debtor").add_argument("cuit")
    sub.add_parser("entity").add_argument("code")
    sub.add_parser("top").add_argument("n", type=int)
    lst = sub.add_parser("debtors")
    lst.add_argument("--situation")
    lst.add_argument("--page", type=int, default=1)
    lst.add_argument("--per-page", type=int, default=None)
    runs = sub.add_parser("runs")
    runs.add_argument("--active", action="store_true")
    return ap


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("ledgerline").getOrCreate()
    ensure_checkpoint_dir(spark)
    ws = Workspace(args.workspace) if args.workspace else Workspace.default(spark)
    try:
        if args.cmd == "import":
            active = R.active_runs(R.run_state(R.read_events(spark, ws.runs), ["status"]))
            blocking = active.select("run_id").limit(1).collect()
            if blocking and not args.force:
                print(json.dumps({"error": "an import is already active",
                                  "run_id": blocking[0].run_id}), file=out)
                return 3
            res = run_import(spark, args.path, ws, run_id=args.run_id,
                             part_bytes=args.part_bytes)
            _print(res.summary, out)
            return 0
        if args.cmd == "runs":
            states = R.run_state(R.read_events(spark, ws.runs))
            _print(R.active_runs(states) if args.active else states.orderBy("created_at"), out)
            return 0
        debtors, entities = P.published_pair(spark, ws.published)
        if args.cmd == "debtor":
            found = _print(Q.debtor_by_cuit(debtors, args.cuit), out)
        elif args.cmd == "entity":
            found = _print(Q.entity_by_code(entities, args.code), out)
        elif args.cmd == "top":
            _print(Q.published_top(spark, ws.published, args.n).orderBy("position"), out)
            found = 1
        else:
            asked = (spark, ws.published, args.situation, args.page, args.per_page)
            _print(Q.published_page_meta(*asked), out)
            _print(Q.published_page(*asked).orderBy("position"), out)
            found = 1
        return 0 if found else 2  # 2: not found
    except ValueError as exc:  # argument checks
        print(json.dumps({"error": str(exc)}), file=out)
        return 1


if __name__ == "__main__":
    sys.exit(main())

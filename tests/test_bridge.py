"""The rendered registry files have the shapes the oracles rely on."""

import datetime
import glob
import os
import time

import pytest

from ledgerline.plans import bridge
from ledgerline.streaming import ingest as J

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(f"{SF}/lineitem.parquet"), reason="no test data")
def test_rendered_files(spark):
    root = bridge.registry_path(spark, SF)
    files = sorted(glob.glob(f"{root}/delivery=*/file_no=*/part-*"))
    folders = {os.path.dirname(f) for f in files}
    assert len(files) == len(folders) > 2          # one file per (delivery, file number)
    seen = {"d1": False, "crlf": False, "blank": False, "short": False}
    for f in files:
        data = open(f, "rb").read()
        lines = data.split(b"\n")[:-1]
        assert lines[0].startswith(b"# registry extract ")   # comment first
        assert len(lines) < 4 * bridge.FILE_ORDERS * 2      # bounded per file
        seen["d1"] |= b"\xd1" in data
        seen["crlf"] |= any(ln.endswith(b"\r") for ln in lines)
        seen["blank"] |= any(ln == b"" for ln in lines)
        seen["short"] |= any(0 < len(ln.rstrip(b"\r")) < 171 and not ln.startswith(b"#")
                             for ln in lines)
        assert b"\xc3" not in data                   # Latin-1 bytes, not UTF-8
    assert all(seen.values()), seen


def _tables(spark, folder, orders):
    """Orders of the given keys (twice where repeated), three lines each."""
    spark.createDataFrame([(k, k % 17, 100.5 + k) for k in orders],
                          "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(
        f"{folder}/orders.parquet")
    lines = [(k, k % 31, k % 7, n, float(n * 3), 900.0 + k, 0.05, "ARN"[n % 3], "FO"[k % 2],
              datetime.datetime(1997, 1 + n, 2))
             for k in sorted(set(orders)) for n in (1, 2, 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, "
                          "l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_returnflag string, l_linestatus string, "
                          "l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")


def test_rendering_shuffles_each_table_once(spark, tmp_path):
    """One join, never broadcast, and no shuffle of the text: what is moved grows
    with the input alike at every size."""
    _tables(spark, str(tmp_path), range(50))
    plan = bridge.rendered_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Broadcast" not in plan
    assert plan.count("FileScan") == 2 and plan.count("Join") == 1


def test_rendering_tasks_are_sized_by_their_text(spark):
    """Few large tasks keep most cores waiting for the last ones: a caller's size
    of shuffle partitions is lowered to the rendering's own, never raised."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    try:
        for size, expected in (("64MB", 16 << 20), ("1g", 16 << 20), ("16k", 16 << 10),
                               ("4194304", 4 << 20), ("20b", 20)):
            spark.conf.set(name, size)
            assert bridge.rendering_session(spark).conf.get(name) == f"{expected}b"
            assert spark.conf.get(name) == size
    finally:
        spark.conf.set(name, before)


def test_rendering_leaves_no_shuffle_files(spark, tmp_path):
    """They would lie beside the text until the driver's garbage is collected."""
    _tables(spark, str(tmp_path), range(50))

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(
            ).getAllFiles().mkString("\n").split("\n")
        return {f for f in files if os.path.basename(f).startswith("shuffle_")}

    before = shuffled()
    bridge.render(spark, str(tmp_path), str(tmp_path / "out"))
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before


def test_rendered_order_and_delivered_lines(spark, tmp_path):
    """Files hold their lines in the oracle's order, copies and blank lines
    included; a delivery written straight away holds the same lines."""
    orders = [0, 1, 53, 53, 97, 4096, 4097, 3 * 4096 + 5]
    _tables(spark, str(tmp_path), orders)
    out = str(tmp_path / "out")
    bridge.render(spark, str(tmp_path), out)
    first = glob.glob(f"{out}/delivery=O/file_no=0/part-*")
    assert len(first) == 1
    lines = open(first[0], "rb").read().split(b"\n")[:-1]
    assert lines[0] == b"# registry extract O 00000"
    # orders 1, 53 (each line twice, its first ones followed by two blank lines), 97 (cut short)
    assert [len(x) for x in lines[1:]] == [171] * 5 + [0, 0] + [171] * 4 + [170] * 3
    for delivery in "FO":
        J.deliver(spark, bridge.rendered_lines(spark, str(tmp_path), delivery),
                  f"{out}/landing-{delivery}")
        kept, landed = ([line for f in glob.glob(f"{out}/{folder}/**/part-*", recursive=True)
                         for line in open(f, "rb").read().split(b"\n")[:-1]]
                        for folder in (f"delivery={delivery}", f"landing-{delivery}"))
        assert sorted(kept) == sorted(landed) and len(kept) > 3

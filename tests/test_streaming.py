from conftest import make_line
from ledgerline.operators import publish as P
from ledgerline.streaming import ingest as J


def _drop(tmp_path, folder, lines, part=0, complete=True):
    d = tmp_path / "landing" / folder
    d.mkdir(parents=True, exist_ok=True)
    (d / f"part-{part}.txt").write_bytes(("\n".join(lines) + "\n").encode("latin-1"))
    if complete:
        (d / "_SUCCESS").write_bytes(b"")


def test_half_a_delivery_publishes_nothing(spark, tmp_path):
    from ledgerline.plans.import_job import Workspace
    landing, ws = str(tmp_path / "landing" / "*"), Workspace(str(tmp_path / "ws"))
    ckpt = str(tmp_path / "ck")
    _drop(tmp_path, "d1", [make_line(ident="20000000001")], part=0, complete=False)
    J.stream_latest_delivery(spark, landing, ws, ckpt)
    assert P.current_version(spark, ws.published) is None
    _drop(tmp_path, "d1", [make_line(ident="20000000002")], part=1)
    J.stream_latest_delivery(spark, landing, ws, ckpt)
    d = P.read_published(spark, ws.published, "debtors").collect()
    assert sorted(r.identification_number for r in d) == ["20000000001", "20000000002"]
    before = P.current_version(spark, ws.published)
    J.stream_latest_delivery(spark, landing, ws, ckpt)  # nothing new
    assert P.current_version(spark, ws.published) == before


def test_stream_ingest_is_incremental(spark, tmp_path):
    _drop(tmp_path, "d1", [make_line(ident="20000000001"), "bad"])
    landing, sink, ckpt = str(tmp_path / "landing" / "*"), str(tmp_path / "sink"), str(tmp_path / "ck")
    J.stream_valid_rows(spark, landing, sink, ckpt)
    assert spark.read.parquet(sink).count() == 1
    J.stream_valid_rows(spark, landing, sink, ckpt)          # rerun: nothing new
    assert spark.read.parquet(sink).count() == 1
    _drop(tmp_path, "d2", [make_line(ident="20000000002"), make_line(ident="20000000003")])
    J.stream_valid_rows(spark, landing, sink, ckpt)          # only the new file's rows
    assert sorted(r.identification_number for r in spark.read.parquet(sink).collect()) == [
        "20000000001", "20000000002", "20000000003"]


def test_stream_latest_delivery_wins(spark, tmp_path):
    from ledgerline.operators import runs as R
    from ledgerline.plans.import_job import Workspace
    landing = str(tmp_path / "landing" / "*")
    ws, ckpt = Workspace(str(tmp_path / "ws")), str(tmp_path / "ck")
    _drop(tmp_path, "d1", [make_line(ident="20000000001")])
    J.stream_latest_delivery(spark, landing, ws, ckpt)
    _drop(tmp_path, "d2", [make_line(ident="20000000002"), "short"])
    J.stream_latest_delivery(spark, landing, ws, ckpt)
    d = P.read_published(spark, ws.published, "debtors").collect()
    assert [r.identification_number for r in d] == ["20000000002"]
    # each delivery is a run in the log, with its counts
    states = sorted((r.filename, r.status, r.valid_records, r.invalid_records)
                    for r in R.run_state(R.read_events(spark, ws.runs)).collect())
    assert states == [("d1", "completed", 1, 0), ("d2", "completed", 1, 1)]

"""Byte ranges, loads that commit inside a file, and streams within files."""

import hashlib
import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import make_line
from ledgerline import fs
from ledgerline import layout as L
from ledgerline.operators import parts as PT
from ledgerline.operators import publish as P
from ledgerline.operators import runs as R
from ledgerline.operators import staging as S
from ledgerline.plans.import_job import rejects_of, run_import
from ledgerline.sources import byte_ranges as BR
from ledgerline.sources import registry_text as RT
from ledgerline.streaming import ingest as J


def lines_of(n, first=0):
    out = []
    for i in range(first, first + n):
        out.append("short" if i % 11 == 3 else "" if i % 13 == 5 else
                   make_line(ident=f"{20000000000 + i % 89}", situation=L.SITUATION_CODES[i % 7]))
    return out


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("end", [b"", b"\n", b"\n\n\n"])
@pytest.mark.parametrize("size", [1, 2, 7, 64, 10_000])
def test_ranges_neither_share_nor_lose_lines(tmp_path, end, size):
    rnd = random.Random(size)
    text = b"\n".join(b"x" * rnd.choice([0, 0, 1, 3, 20, 90]) + (b"\r" if rnd.random() < .2 else b"")
                      for _ in range(150)) + end
    path = str(tmp_path / "f.txt")
    open(path, "wb").write(text)
    got = [line for r in BR.cut(path, 0, len(text), size) for b in BR.read_range(r)
           for line in b.column("raw").to_pylist()]
    want = text[:-1].split(b"\n") if text.endswith(b"\n") else text.split(b"\n")
    assert got == want


def test_range_rows_match_the_text_reader(spark, write_file):
    path = write_file(lines_of(400))
    a = RT.with_line_numbers(RT.read_lines(spark, path, split_bytes=5000))
    b = RT.with_line_numbers(BR.read_ranges(spark, BR.ranges_of(spark, path, 3000)))
    assert rows(a, "line_number", "line") == rows(b, "line_number", "line")
    assert a.agg(F.max("split_start")).first()[0] > 0
    assert BR.read_ranges(spark, []).count() == 0


def test_line_numbers_store_no_text(spark, write_file):
    """Two scans over pinned splits; only the split table is materialized."""
    path = write_file(lines_of(3000))
    numbered = RT.with_line_numbers(RT.read_lines(spark, path, split_bytes=20_000))
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [value") == 1 and plan.count("LogicalRDD") == 1
    assert "n_lines" in plan.split("LogicalRDD")[1].splitlines()[0]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # plays no part any more
    try:
        got = numbered.select("line_number", "line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r[0], r[1]) for r in got) == list(enumerate(lines_of(3000), 1))
    assert numbered.agg(F.count_distinct("split_start")).first()[0] > 20


def load(spark, path, ws, **more):
    return PT.load(spark, path, ws.staging, "r1", part_bytes=9000, range_bytes=2500, **more)


def test_resume_reads_only_unread_ranges(spark, write_file, workspace):
    path = write_file(lines_of(300))
    size = os.path.getsize(path)
    first = load(spark, path, workspace, max_parts=2)
    assert not S.exists(spark, workspace.staging, "r1")
    at = PT.progress(spark, workspace.staging, "r1").first()
    assert at.bytes_loaded == at.last_byte == sum(r.end - r.start for r in first) < size
    # a part staged without a manifest is not there
    S.staged_rows(RT.read_lines(spark, path), F.lit("").alias("range_digest")).write.parquet(
        f"{S.run_dir(workspace.staging, 'r1')}/part=000002")
    second = load(spark, path, workspace)
    assert sum(r.end - r.start for r in first + second) == size
    assert not {r.start for r in first} & {r.start for r in second}
    assert load(spark, path, workspace) == []
    S.stage(S.staged_rows(RT.read_lines(spark, path)), workspace.staging, "whole")
    columns = ["identification_number", "entity_code", "situation", "loans", "kind", "detail"]
    assert rows(S.staged(spark, workspace.staging, "r1"), *columns) == rows(
        S.staged(spark, workspace.staging, "whole"), *columns)
    assert rows(S.staged_rejects(spark, workspace.staging, "r1"), "line_number", "reason") == rows(
        S.staged_rejects(spark, workspace.staging, "whole"), "line_number", "reason")


def test_touched_files_are_kept_changed_ranges_are_not(spark, write_file, workspace):
    path = write_file(lines_of(300))
    load(spark, path, workspace)
    os.utime(path, (1, 1))  # same bytes, other time: hashed, nothing loaded
    assert load(spark, path, workspace) == []
    text = bytearray(open(path, "rb").read())
    at = len(text) // 2
    text[at:at + 171] = make_line(ident="29999999999").encode()
    open(path, "wb").write(bytes(text))
    again = load(spark, path, workspace)
    assert 0 < sum(r.end - r.start for r in again) < len(text)
    S.stage(S.staged_rows(RT.read_lines(spark, path)), workspace.staging, "whole")
    columns = ["identification_number", "situation", "loans", "kind"]
    assert rows(S.staged(spark, workspace.staging, "r1"), *columns) == rows(
        S.staged(spark, workspace.staging, "whole"), *columns)
    # a shorter file: its last range differs, later ones are gone
    open(path, "wb").write(bytes(text[:9100]))
    load(spark, path, workspace)
    S.stage(S.staged_rows(RT.read_lines(spark, path)), workspace.staging, "short")
    assert rows(S.staged(spark, workspace.staging, "r1"), *columns) == rows(
        S.staged(spark, workspace.staging, "short"), *columns)


def test_import_in_parts_resumes_and_merges(spark, write_file, workspace, monkeypatch):
    path = write_file(lines_of(400))
    whole = run_import(spark, path, workspace, run_id="whole")
    want = [rows(t, *t.columns[:-1]) for t in P.published_pair(spark, workspace.published)]
    aggregated = []
    made = PT.A.debtor_partials
    monkeypatch.setattr(PT.A, "debtor_partials", lambda v: aggregated.append(1) or made(v))
    publish = P.publish
    monkeypatch.setattr(P, "publish", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run_import(spark, path, workspace, run_id="in/parts", part_bytes=20_000)
    parts = len(aggregated)
    assert parts > 2
    monkeypatch.setattr(P, "publish", publish)
    res = run_import(spark, path, workspace, run_id="in/parts", part_bytes=20_000)
    assert len(aggregated) == parts  # nothing is aggregated again
    assert res.counts == whole.counts
    assert [rows(t, *t.columns[:-1]) for t in P.published_pair(spark, workspace.published)] == want
    log = [rows(rejects_of(spark, workspace, r), "line_number", "reason", "detail")
           for r in ("whole", "in/parts")]
    assert log[0] == log[1] and log[0]
    states = {r.run_id: r.last_loaded_line for r in R.run_state(
        R.read_events(spark, workspace.runs)).collect()}
    assert states["in/parts"] == states["whole"]
    assert fs.list_names(spark, workspace.staging) == []


def test_missing_input_fails(spark, workspace):
    with pytest.raises(FileNotFoundError):
        run_import(spark, f"{workspace.root}/nothing", workspace, part_bytes=1000)


def test_stream_stops_and_goes_on_within_a_file(spark, write_file, tmp_path):
    path = write_file(lines_of(500))
    size = os.path.getsize(path)
    sink, ckpt = str(tmp_path / "sink"), str(tmp_path / "ckpt")
    taken = []
    for batches in (2, 1, None, None):
        J.stream_within_files(spark, path, sink, ckpt, size // 5 + 1, 4000, max_batches=batches)
        taken.append(sum(BR.reached(spark, ckpt).values()))
    assert taken == [2 * (size // 5 + 1), 3 * (size // 5 + 1), size, size]
    S.stage(S.staged_rows(RT.read_lines(spark, path)), str(tmp_path / "st"), "whole")
    columns = ["identification_number", "entity_code", "situation", "loans"]
    assert rows(spark.read.parquet(sink), *columns) == rows(
        S.staged(spark, str(tmp_path / "st"), "whole", [L.KIND_VALID]), *columns)


def test_stream_repeats_a_planned_batch_once(spark, write_file, tmp_path):
    """The driver is lost after a batch was written but before it was committed."""
    path = write_file(lines_of(300))
    size = os.path.getsize(path)
    sink, ckpt = str(tmp_path / "sink"), str(tmp_path / "ckpt")
    J.stream_within_files(spark, path, sink, ckpt, size // 3 + 1, 4000, max_batches=2)
    for name in ("1", ".1.crc"):
        if os.path.exists(f"{ckpt}/commits/{name}"):
            os.remove(f"{ckpt}/commits/{name}")
    J.stream_within_files(spark, path, sink, ckpt, size // 3 + 1, 4000)
    valid = sum(len(line) == 171 for line in lines_of(300))
    out = spark.read.parquet(sink)
    assert out.count() == valid == out.select("split_start", "row_id").distinct().count()


def test_many_splits_share_tasks(spark, write_file, monkeypatch):
    """Splits of a stated size don't each take a task; they and the numbers stay."""
    path = write_file([f"line {i}" for i in range(3000)])
    monkeypatch.setattr(RT, "SPLIT_TASKS", 7)
    lines = RT.read_lines(spark, path, split_bytes=400)
    assert lines.rdd.getNumPartitions() <= 8
    got = RT.with_line_numbers(lines).select("split_start", "line_number", "line").collect()
    at, want = 0, set()
    for i in range(3000):  # a line is in the split that holds the byte before its first
        want.add((max(at - 1, 0) // 400 * 400, i + 1, f"line {i}"))
        at += len(f"line {i}") + 1
    assert len(got) == 3000 and set(map(tuple, got)) == want
    assert len({r[0] for r in got}) > 50


def test_short_ranges_share_tasks(spark, tmp_path):
    """Sixty short files are read by about as many tasks as there are cores, not by
    one each; lines, places and digests are those of each range by itself."""
    texts = [b"", b"\n", b"a\n\nb", b"\r\n\n", b"x" * 90 + b"\nlast"]
    for i in range(60):
        (tmp_path / f"f{i:02d}").write_bytes(texts[i % 5])
    ranges = BR.ranges_of(spark, str(tmp_path), 40)
    df = BR.read_ranges(spark, ranges)
    cores = spark.sparkContext.defaultParallelism
    assert df.rdd.getNumPartitions() <= 3 * cores < len(ranges)
    want = []
    for r in ranges:
        text = BR.range_text(r.path, r.start, r.end)
        lines = (text[:-1] if text.endswith(b"\n") else text).split(b"\n") if text else []
        digest = hashlib.sha256(text).hexdigest()
        want += [(r.path, r.start, i, digest, line) for i, line in enumerate(lines)]
    got = df.select("source_file", "split_start", "row_id", "range_digest", "raw").collect()
    assert sorted((*r[:4], bytes(r[4])) for r in got) == sorted(want) and len(want) == 96
    assert sum(len(t.ranges) for t in BR.tasks_of(ranges, 100)) == len(ranges)


def test_folders_are_listed_by_few_tasks(spark, tmp_path, monkeypatch):
    """The registry has a folder per file; listing them is not a task per folder."""
    monkeypatch.setattr(RT, "LISTING_TASKS", 8)
    for n in range(40):
        folder = tmp_path / f"in/file_no={n}"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_bytes(make_line().encode() + b"\n")
    sc = spark.sparkContext
    sc.setJobGroup("listing", "folders of one path")
    try:
        lines = RT.read_lines(spark, str(tmp_path / "in"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(stage) for job in tracker.getJobIdsForGroup("listing")
              for stage in tracker.getJobInfo(job).stageIds]
    assert [stage.numTasks for stage in stages] == [8]
    assert lines.count() == 40 and lines.select("source_file").distinct().count() == 40

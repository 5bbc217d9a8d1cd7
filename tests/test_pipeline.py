"""Staging, resume, retention, publish, run log and the end-to-end import."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import make_line
from ledgerline import layout as L
from ledgerline.operators import publish as P
from ledgerline.operators import runs as R
from ledgerline.operators import staging as S
from ledgerline.plans.import_job import run_import, rejects_of
from ledgerline.sources import registry_text as RT


def _numbered_file(write_file, n, start=0):
    return write_file([make_line(ident=f"{20000000000 + (start + i) % 97}",
                                 situation=L.SITUATION_CODES[i % 7]) for i in range(n)])


def _valid(spark, ws, slug):
    return S.staged(spark, ws.staging, slug, [L.KIND_VALID])


def test_stage_counts_and_checkpoint(spark, write_file, workspace):
    path = _numbered_file(write_file, 12001)
    S.load_with_resume(spark, path, workspace.staging, "r1")
    v = _valid(spark, workspace, "r1")
    assert v.count() == 12001
    assert S.checkpoints(v).first().last_loaded_line == 12001


def test_resume_appends_only_the_rest(spark, write_file, workspace):
    path = _numbered_file(write_file, 5000)
    lines = RT.with_line_numbers(RT.read_lines(spark, path))
    S.stage(S.staged_rows(lines.where(F.col("line_number") <= 3000)), workspace.staging, "r1")
    assert _valid(spark, workspace, "r1").count() == 3000
    S.load_with_resume(spark, path, workspace.staging, "r1")
    v = _valid(spark, workspace, "r1")
    assert v.count() == 5000
    assert v.select("line_number").distinct().count() == 5000
    assert S.checkpoints(v).first().last_loaded_line == 5000


def test_resume_with_zero_checkpoint_starts_clean(spark, write_file, workspace):
    stale = _numbered_file(write_file, 10, start=500)
    S.load_with_resume(spark, stale, workspace.staging, "r1")
    fresh = _numbered_file(write_file, 4000)
    S.load_with_resume(spark, fresh, workspace.staging, "r1", last_loaded_line=0)
    assert _valid(spark, workspace, "r1").count() == 4000


def test_resume_with_explicit_checkpoint(spark, write_file, workspace):
    path = _numbered_file(write_file, 50)
    lines = RT.with_line_numbers(RT.read_lines(spark, path))
    S.stage(S.staged_rows(lines.where(F.col("line_number") <= 20)), workspace.staging, "r1")
    S.load_with_resume(spark, path, workspace.staging, "r1", last_loaded_line=20)
    assert _valid(spark, workspace, "r1").count() == 50


def test_retention_rules(spark):
    now = datetime(2026, 6, 10, 12, 0, 0)
    states = spark.createDataFrame([
        ("aaaaaaaa-0000-0000-0000-000000000001", "completed", now - timedelta(hours=25)),
        ("bbbbbbbb-0000-0000-0000-000000000002", "completed", now - timedelta(hours=1)),
        ("cccccccc-0000-0000-0000-000000000003", "processing", now - timedelta(days=30)),
        ("dddddddd-0000-0000-0000-000000000004", "failed", now - timedelta(hours=24)),
    ], "run_id string, status string, updated_at timestamp")
    slugs = spark.createDataFrame([(s,) for s in ["aaaaaaaa0000", "bbbbbbbb0000", "cccccccc0000",
                                                  "dddddddd0000", "eeeeeeee0000"]], "slug string")
    got = {r.slug: r.reason for r in S.stale_staging(slugs, states, now).collect()}
    assert got == {"aaaaaaaa0000": "expired", "dddddddd0000": "expired",
                   "eeeeeeee0000": "orphan"}


def test_publish_is_versioned_and_atomic(spark, tmp_path):
    root = str(tmp_path / "pub")
    assert P.read_published(spark, root, "debtors").count() == 0
    d1 = spark.createDataFrame([("1", "01", Decimal("1"), None)], L.DEBTORS_SCHEMA)
    e1 = spark.createDataFrame([("E1", Decimal("1"), None)], L.ENTITIES_SCHEMA)
    v1 = P.publish(spark, root, {"debtors": d1, "entities": e1})
    # a failing publish leaves the committed version in place
    bad = spark.createDataFrame([("2", "05", Decimal("9"), None)], L.DEBTORS_SCHEMA).withColumn(
        "total_loan_amount", F.raise_error(F.lit("boom")))
    with pytest.raises(Exception):
        P.publish(spark, root, {"debtors": bad, "entities": e1})
    assert P.current_version(spark, root) == v1
    assert [r.identification_number for r in P.read_published(spark, root, "debtors").collect()] == ["1"]
    d2 = spark.createDataFrame([("2", "05", Decimal("2"), None)], L.DEBTORS_SCHEMA)
    v2 = P.publish(spark, root, {"debtors": d2, "entities": e1})
    assert v2 > v1 and P.current_version(spark, root) == v2
    assert [r.identification_number for r in P.read_published(spark, root, "debtors").collect()] == ["2"]


def test_abandoned_version_is_removed(spark, tmp_path):
    root = str(tmp_path / "pub")
    e = spark.createDataFrame([("E1", Decimal("1"), None)], L.ENTITIES_SCHEMA)
    d = spark.createDataFrame([("1", "01", Decimal("1"), None)], L.DEBTORS_SCHEMA)
    v0 = P.new_version()
    d.write.parquet(f"{P.version_dir(root, v0)}/debtors")  # written, never committed
    assert P.current_version(spark, root) is None
    v1 = P.publish(spark, root, {"debtors": d, "entities": e})
    assert P.current_version(spark, root) == v1
    # within the grace period it may be a writer still at work
    assert sorted(P.fs.list_names(spark, f"{root}/{P.VERSIONS}")) == sorted([v0, v1])
    P.remove_old(spark, root, keep=2, grace_hours=0)
    assert P.fs.list_names(spark, f"{root}/{P.VERSIONS}") == [v1]


def test_commit_order_not_name_decides(spark, tmp_path):
    root = str(tmp_path / "pub")
    e = spark.createDataFrame([("E1", Decimal("1"), None)], L.ENTITIES_SCHEMA)
    held = None
    for i, name in enumerate(["v3", "v2", "v1", "v0"]):
        d = spark.createDataFrame([(str(i), "01", Decimal("1"), None)], L.DEBTORS_SCHEMA)
        P.publish(spark, root, {"debtors": d, "entities": e}, version=name)
        assert P.current_version(spark, root) == name
        held = held or P.read_published(spark, root, "debtors")
    # a reader that resolved the first version outlives three publishes
    assert [r.identification_number for r in held.collect()] == ["0"]
    P.remove_old(spark, root, keep=2, grace_hours=0)
    assert P.committed_versions(spark, root) == ["v1", "v0"]
    assert sorted(P.fs.list_names(spark, f"{root}/{P.VERSIONS}")) == ["v0", "v1"]


def test_staging_of_another_run_or_path_is_not_taken(spark, write_file, workspace, monkeypatch):
    old, new = write_file([make_line(ident="20111111111")]), write_file([make_line(ident="20222222222")])
    publish = P.publish

    def boom(*a, **k):
        raise RuntimeError("disk full")
    monkeypatch.setattr(P, "publish", boom)
    for run_id in ("aabbccddeeff-1111", "aabbccddeeff-2222"):
        with pytest.raises(RuntimeError):
            run_import(spark, old, workspace, run_id=run_id)
    monkeypatch.setattr(P, "publish", publish)
    run_import(spark, new, workspace, run_id="aabbccddeeff-2222")  # same run, other path
    d, _ = P.published_pair(spark, workspace.published)
    assert [r.identification_number for r in d.collect()] == ["20222222222"]
    assert S.exists(spark, workspace.staging, S.run_key("aabbccddeeff-1111"))
    run_import(spark, old, workspace, run_id="aabbccddeeff-1111")  # resumes its own
    d, _ = P.published_pair(spark, workspace.published)
    assert [r.identification_number for r in d.collect()] == ["20111111111"]


def test_import_resumes_a_partial_staging(spark, write_file, workspace):
    path = write_file([make_line(ident="20000000001"), "short", make_line(ident="20000000002")])
    run_id = "cccccccc-0000-4000-8000-000000000001"
    lines = RT.with_line_numbers(RT.read_lines(spark, path).drop("line"))
    S.stage(S.staged_rows(lines.where("line_number = 1")), workspace.staging, S.run_key(run_id))
    S.write_input(spark, workspace.staging, S.run_key(run_id), S.PARTIAL + path)
    R.append_event(spark, workspace.runs, run_id, datetime(2026, 1, 1), status="processing")
    res = run_import(spark, path, workspace, run_id=run_id)
    assert res.counts == {"valid": 2, "invalid": 1, "total": 3}
    d, _ = P.published_pair(spark, workspace.published)
    assert sorted(r.identification_number for r in d.collect()) == ["20000000001", "20000000002"]
    assert [(r.line_number, r.reason) for r in rejects_of(spark, workspace, run_id).collect()] == [
        (2, "short_line")]
    assert R.run_state(R.read_events(spark, workspace.runs)).first().last_loaded_line == 3


def test_resume_of_a_replaced_file_starts_clean(spark, write_file, workspace):
    path = write_file([make_line(ident=f"2000000000{i}") for i in range(4)])
    run_id = "my_run/1.x"
    lines = RT.with_line_numbers(RT.read_lines(spark, path).drop("line"))
    S.stage(S.staged_rows(lines.where("line_number <= 2")), workspace.staging, S.run_key(run_id))
    S.write_input(spark, workspace.staging, S.run_key(run_id), S.PARTIAL + path)
    R.append_event(spark, workspace.runs, run_id, datetime(2026, 1, 1), status="processing")
    with open(path, "w") as f:
        f.write("".join(make_line(ident=f"3000000000{i}") + "\n" for i in range(4)))
    res = run_import(spark, path, workspace, run_id=run_id)
    assert res.counts["valid"] == 4
    d, _ = P.published_pair(spark, workspace.published)
    assert sorted(r.identification_number for r in d.collect()) == [f"3000000000{i}" for i in range(4)]


ODD_IDS = ["my_run.1", "a/b", "~x y", "50%", "100*", "e+f", "ñandú", "a_b", "a.b", "%5f", "..", "a=b,c"]


def test_run_keys_agree_and_differ(spark):
    from ledgerline.functions import exprs as X
    df = spark.createDataFrame([(i,) for i in ODD_IDS], "run_id string")
    got = {r.run_id: r.k for r in df.select("run_id", X.run_key("run_id").alias("k")).collect()}
    assert got == {i: S.run_key(i) for i in ODD_IDS}
    assert len(set(got.values())) == len(ODD_IDS)
    assert not any(set("/*?{}[] ") & set(k) for k in got.values())


def test_retention_keeps_running_imports_of_any_id(spark, write_file, workspace):
    path, now = write_file([make_line()]), datetime(2026, 6, 8, 12)
    for i in ODD_IDS:
        S.stage(S.staged_rows(RT.read_lines(spark, path)), workspace.staging, S.run_key(i))
        R.append_event(spark, workspace.runs, i, now - timedelta(days=9),
                       status="processing" if i != "a_b" else "failed")
    S.stage(S.staged_rows(RT.read_lines(spark, path)), workspace.staging, "nobody")
    states = R.run_state(R.read_events(spark, workspace.runs), ["status"])
    removed = S.gc_staging(spark, workspace.staging, states, now)
    assert sorted(removed) == ["a_b", "nobody"]
    assert all(S.exists(spark, workspace.staging, S.run_key(i)) for i in ODD_IDS if i != "a_b")


def test_overflowing_amount_is_a_parse_error(spark, write_file, workspace):
    path = write_file([make_line(), make_line(loans="9999999999e9"),
                       make_line(rest=["000000000000"] * 6 + ["        1e17"])])
    res = run_import(spark, path, workspace)
    assert res.counts == {"valid": 1, "invalid": 2, "total": 3}
    got = sorted((r.line_number, r.reason, r.detail.strip())
                 for r in rejects_of(spark, workspace, res.run_id).collect())
    assert got == [(2, "parse_error", "9999999999e9"), (3, "parse_error", "1e17")]


@pytest.mark.parametrize("zone", ["UTC", "America/Argentina/Buenos_Aires", "Asia/Tokyo"])
def test_retention_compares_instants(spark, tmp_path, zone):
    root, now = str(tmp_path / "runs"), datetime(2026, 6, 8, 12)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for hours in (22, 24, 25):
            R.append_event(spark, root, f"r{hours}", now - timedelta(hours=hours), status="failed")
        states = R.run_state(R.read_events(spark, root), ["status"])
        slugs = spark.createDataFrame([("r22",), ("r24",), ("r25",)], "slug string")
        got = sorted(r.slug for r in S.stale_staging(slugs, states, now).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["r24", "r25"]


def test_writer_never_cuts(spark):
    from ledgerline.sources.registry_text import fitted, format_amount
    one = spark.createDataFrame([(Decimal("12345678901.25"), "12345")], "a decimal(18,2), d string")
    for column in (format_amount(F.col("a")), fitted(F.lpad, F.col("d"), 4, "0", "days_overdue")):
        with pytest.raises(Exception, match="does not fit"):
            one.select(column).collect()


def test_work_folder_must_be_set_off_local_mode():
    from ledgerline.session import check_local
    for master in ("local", "local[4]", "local[*]"):
        check_local(master)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            check_local(master)


def test_latest_file_replaces_old_rows(spark, write_file, workspace):
    first = write_file([make_line(ident="20111111111", entity="OLD01")])
    second = write_file([make_line(ident="20222222222", entity="NEW01")])
    run_import(spark, first, workspace)
    run_import(spark, second, workspace)
    d, e = P.published_pair(spark, workspace.published)
    assert [r.identification_number for r in d.collect()] == ["20222222222"]
    assert [r.entity_code for r in e.collect()] == ["NEW01"]


def test_import_counts_rejects_and_summary(spark, write_file, workspace):
    # reject, valid, blank, reject, valid: counts must not depend on positions
    path = write_file(["short", make_line(situation="05"), "", make_line(idtype="99"),
                       make_line(ident="20999999999")])
    clock = datetime(2026, 6, 8, 12, 0, 0)
    res = run_import(spark, path, workspace, run_id="aabbccdd-1122-3344-5566-778899aabbcc",
                     clock=lambda: clock)
    assert res.counts == {"valid": 2, "invalid": 2, "total": 4}
    s = res.summary.first()
    assert (s.import_id, s.filename, s.total_debtors, s.total_entities, s.completed_at) == (
        "aabbccdd-1122-3344-5566-778899aabbcc", "debtors.txt", 2, 1, "2026-06-08T12:00:00Z")
    rej = sorted((r.line_number, r.reason) for r in rejects_of(spark, workspace, res.run_id).collect())
    assert rej == [(1, "short_line"), (4, "id_type")]
    # staging is dropped after success; the run is completed
    assert not S.exists(spark, workspace.staging, S.run_key(res.run_id))
    st = R.run_state(R.read_events(spark, workspace.runs)).first()
    assert (st.status, st.valid_records, st.invalid_records, st.total_records, st.filename) == (
        "completed", 2, 2, 4, "debtors.txt")
    js = spark.read.text(f"{workspace.summaries}/run={S.run_key(res.run_id)}").first()[0]
    assert js.startswith('{"import_id":"aabbccdd-1122-3344-5566-778899aabbcc"')


def test_failed_import_keeps_staging_and_tables(spark, write_file, workspace, monkeypatch):
    good = write_file([make_line()])
    run_import(spark, good, workspace)
    before = P.current_version(spark, workspace.published)

    def boom(*a, **k):
        raise RuntimeError("disk full")
    monkeypatch.setattr(P, "publish", boom)
    with pytest.raises(RuntimeError):
        run_import(spark, write_file([make_line(ident="20000000001")]), workspace, run_id="f" * 32)
    assert P.current_version(spark, workspace.published) == before
    assert S.exists(spark, workspace.staging, S.run_key("f" * 32))
    states = {r.run_id: (r.status, r.error_message)
              for r in R.run_state(R.read_events(spark, workspace.runs)).collect()}
    assert states["f" * 32] == ("failed", "RuntimeError: disk full")


def test_run_state_latest_non_null_and_active(spark, tmp_path):
    root = str(tmp_path / "runs")
    t = datetime(2026, 1, 1)
    R.append_event(spark, root, "r1", t, status="pending", filename="a.txt")
    R.append_event(spark, root, "r1", t + timedelta(seconds=1), status="processing")
    R.append_event(spark, root, "r2", t, status="pending", filename="b.txt")
    R.append_event(spark, root, "r2", t + timedelta(seconds=5), status="failed",
                   error_message="bad")
    states = R.run_state(R.read_events(spark, root))
    got = {r.run_id: (r.status, r.filename, r.error_message, r.n_events) for r in states.collect()}
    assert got == {"r1": ("processing", "a.txt", None, 2), "r2": ("failed", "b.txt", "bad", 2)}
    assert [r.run_id for r in R.active_runs(states).collect()] == ["r1"]
    assert [r.status for r in R.find_run(states, "r2").collect()] == ["failed"]
    assert R.find_run(states, "missing").count() == 0
    with pytest.raises(ValueError):
        R.append_event(spark, root, "r3", t, colour="red")


def test_summary_json_both_spellings(spark):
    s = R.summary(spark, "id-1", "f.txt", {"valid": 1, "invalid": 0, "total": 1}, 1, 1, 5,
                  datetime(2026, 6, 8, 12, 0, 0))
    snake = R.summary_json(s).first()[0]
    camel = R.summary_json(s, camel_case=True).first()[0]
    assert snake == ('{"import_id":"id-1","filename":"f.txt","total_debtors":1,'
                     '"total_entities":1,"duration_ms":5,"completed_at":"2026-06-08T12:00:00Z"}')
    assert '"importId":"id-1"' in camel and '"completedAt":"2026-06-08T12:00:00Z"' in camel


def test_retry_resumes_from_committed_staging(spark, write_file, workspace, monkeypatch):
    """A run that failed after staging is retried without reading the text."""
    import os
    path = write_file([make_line(ident="20000000007", loans="0000000042,0"), "short"])
    real_publish = P.publish

    def boom(*a, **k):
        raise RuntimeError("lost the driver")
    monkeypatch.setattr(P, "publish", boom)
    with pytest.raises(RuntimeError):
        run_import(spark, path, workspace, run_id="r" * 32)
    monkeypatch.setattr(P, "publish", real_publish)
    os.remove(path)                                    # the text is gone
    res = run_import(spark, path, workspace, run_id="r" * 32)
    assert res.counts == {"valid": 1, "invalid": 1, "total": 2}
    d = P.read_published(spark, workspace.published, "debtors").collect()
    assert [(r.identification_number, r.total_loan_amount) for r in d] == [
        ("20000000007", Decimal("42.00"))]
    st = {r.run_id: r.status for r in R.run_state(R.read_events(spark, workspace.runs)).collect()}
    assert st["r" * 32] == "completed"


def test_run_log_compaction_keeps_state(spark, tmp_path):
    root = str(tmp_path / "runs")
    t = datetime(2026, 1, 1)
    for i in range(6):
        R.append_event(spark, root, f"r{i % 2}", t + timedelta(seconds=i),
                       status=["pending", "processing", "completed"][i // 2],
                       error_message=None)
    before = sorted(tuple(r) for r in R.run_state(R.read_events(spark, root)).collect())
    assert R.compact_events(spark, root) == 6
    files = [n for n in P.fs.list_names(spark, R.events_dir(root)) if n.endswith(".parquet")]
    assert 1 <= len(files) < 6
    after = sorted(tuple(r) for r in R.run_state(R.read_events(spark, root)).collect())
    assert after == before

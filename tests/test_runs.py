"""Run log: versions, refused changes, bounded files, checkpoints per file."""

import threading
from datetime import datetime, timedelta

import pytest

from conftest import make_line
from ledgerline import fs
from ledgerline.operators import publish as P
from ledgerline.operators import runs as R
from ledgerline.plans.import_job import run_import

T = datetime(2026, 1, 1, 12, 0, 0, 123456)


def states(spark, root):
    return {r.run_id: r.asDict() for r in R.run_state(R.read_events(spark, root)).collect()}


def test_a_completed_run_stays_completed(spark, tmp_path):
    root = str(tmp_path / "runs")
    assert [R.append_event(spark, root, "a.b/1", T + timedelta(seconds=i), status=s)
            for i, s in enumerate(["pending", "processing", "completed"])] == [1, 2, 3]
    for change in ({"status": "processing"}, {"status": "failed"}, {"filename": "x"}):
        with pytest.raises(R.IllegalTransition):
            R.append_event(spark, root, "a.b/1", T, **change)
    with pytest.raises(ValueError):
        R.append_event(spark, root, "r2", T, status="done")
    R.compact_events(spark, root)  # the snapshot knows it as well
    with pytest.raises(R.IllegalTransition):
        R.append_event(spark, root, "a.b/1", T, status="processing")
    state = states(spark, root)["a.b/1"]
    assert (state["status"], state["n_events"]) == ("completed", 3)
    assert state["created_at"] == T


def test_a_failed_run_can_be_retried(spark, tmp_path):
    root = str(tmp_path / "runs")
    for i, s in enumerate(["processing", "failed", "pending", "processing", "completed"]):
        R.append_event(spark, root, "r", T + timedelta(seconds=i), status=s)
        if s == "failed":
            R.append_event(spark, root, "q", T, status="failed")
            assert R.compact_events(spark, root) == 3
    assert states(spark, root)["r"]["status"] == "completed"
    assert states(spark, root)["r"]["n_events"] == 5


def test_ids_that_start_alike_are_kept_apart(spark, tmp_path):
    root = str(tmp_path / "runs")
    R.append_event(spark, root, "r", T, status="completed")
    for other in ("r.000001", "r.x", "rr", "r-"):
        assert R.append_event(spark, root, other, T, status="processing") == 1
    assert len(states(spark, root)) == 5


def test_changes_at_a_time_get_versions_of_their_own(spark, tmp_path):
    root, got = str(tmp_path / "runs"), []
    R.append_event(spark, root, "r", T, status="processing")

    def change(i):
        got.append(R.append_event(spark, root, "r", T + timedelta(seconds=i), last_loaded_line=i))
    threads = [threading.Thread(target=change, args=(i,)) for i in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(got) == list(range(2, 10))
    assert states(spark, root)["r"]["last_loaded_line"] == 7


def test_the_log_stays_a_few_files(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "runs")
    monkeypatch.setattr(R, "TAIL_FILES", 60)
    monkeypatch.setattr(R, "GRACE_HOURS", 0.0)
    most = 0
    for i in range(300):  # 900 events
        for s in ("pending", "processing", "completed" if i % 3 else "failed"):
            R.append_event(spark, root, f"run-{i}", T + timedelta(minutes=i), new=s == "pending",
                           status=s)
        if i % 10 == 9:
            most = max(most, len(fs.list_names(spark, R.events_dir(root))))
    assert most <= 60 + 3 + 3
    got = states(spark, root)
    assert len(got) == 300 and {s["n_events"] for s in got.values()} == {3}
    assert all(s["status"] == ("completed" if int(r[4:]) % 3 else "failed") for r, s in got.items())


def test_checkpoints_per_file(spark, write_file, workspace, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, lines in (("a.txt", [make_line(), "short", make_line(), "x"]),
                        ("b.txt", ["short"]), ("c.txt", [make_line()])):
        (folder / name).write_text("".join(f"{line}\n" for line in lines))
    res = run_import(spark, str(folder), workspace)
    got = {r.source_file.rsplit("/", 1)[1]: r.last_loaded_line
           for r in R.file_checkpoints(spark, workspace.runs, res.run_id).collect()}
    assert got == {"a.txt": 3, "b.txt": None, "c.txt": 1}
    assert states(spark, workspace.runs)[res.run_id]["last_loaded_line"] == 3


def test_two_commits_on_a_store_that_overwrites(spark, tmp_path, monkeypatch):
    """A store without exclusive create: a later write silently replaces a file."""
    root = str(tmp_path / "p")

    def put(spark, path, text):
        fs.delete(spark, path)
        real(spark, path, text)
    real = fs.write_marker
    monkeypatch.setattr(fs, "write_marker", put)
    P.commit(spark, root, "first")
    listing = fs.list_names(spark, f"{root}/{P.COMMITS}")
    seen = fs.list_names
    monkeypatch.setattr(fs, "list_names", lambda s, p: listing)  # both looked before either wrote
    assert P.commit(spark, root, "x") == P.commit(spark, root, "y") == 2
    monkeypatch.setattr(fs, "list_names", seen)
    order = P.committed_versions(spark, root)
    assert order[0] == "first" and sorted(order[1:]) == ["x", "y"]
    assert P.current_version(spark, root) == order[-1]
    assert P.commit(spark, root, "z") == 3 and P.current_version(spark, root) == "z"

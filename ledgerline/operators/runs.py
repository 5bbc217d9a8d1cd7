"""Run log: append-only state changes of import runs, current state per run,
active runs, checkpoints per file, and the completion summary.

Nothing is updated in place: creating a run and each status change append
one event; the current state of a run is, per field, the latest non-null
value by ``(event_at, seq)``.  An event is a small file named by its run and the
run's next version, created without overwrite, so a change that was decided on
an outdated state fails and is decided again; a change that the run's status
doesn't allow is refused.  Older events are folded into a Parquet snapshot, so
the log stays a few files however many imports it has seen.
"""

from __future__ import annotations

import json
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import fs
from ledgerline import layout as L
from ledgerline.functions import exprs as X
from ledgerline.operators.staging import run_key

STATE_FIELDS = ["status", "filename", "last_loaded_line", "total_records", "valid_records",
                "invalid_records", "duration_ms", "error_message", "started_at", "finished_at"]


def as_utc(at: datetime) -> datetime:
    """Aware UTC datetime; a naive one is taken as UTC.  (Spark would read a
    naive one in the time zone of the Python process.)"""
    return at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at


# Keys of the completion event, in both spellings.
EVENT_KEYS = {"import_id": "importId", "filename": "filename", "total_debtors": "totalDebtors",
              "total_entities": "totalEntities", "duration_ms": "durationMs",
              "completed_at": "completedAt"}


def events_dir(root: str) -> str:
    return f"{root}/run_events"


#: statuses a run may change to; a run without a status may take any
TRANSITIONS = {
    None: {L.STATUS_PENDING, L.STATUS_PROCESSING, L.STATUS_COMPLETED, L.STATUS_FAILED},
    L.STATUS_PENDING: {L.STATUS_PENDING, L.STATUS_PROCESSING, L.STATUS_COMPLETED, L.STATUS_FAILED},
    L.STATUS_PROCESSING: {L.STATUS_PENDING, L.STATUS_PROCESSING, L.STATUS_COMPLETED,
                          L.STATUS_FAILED},  # pending again: the retry of a run that was lost
    L.STATUS_FAILED: {L.STATUS_PENDING, L.STATUS_PROCESSING, L.STATUS_FAILED},
    L.STATUS_COMPLETED: set(),
}
#: event files beyond which a finished run folds those older than the grace period
TAIL_FILES = 256
GRACE_HOURS = 1.0


class IllegalTransition(ValueError):
    """A change that the run's status doesn't allow."""


def _tail(names: list[str], run_id: str) -> list[str]:
    """Event files of a run, oldest version first."""
    start = f"event-{run_key(run_id)}."
    return sorted(n for n in names if n.startswith(start) and n.count(".") == start.count(".") + 1)


def _version_and_status(spark: SparkSession, root: str, run_id: str,
                        names: list[str]) -> tuple[int, str | None]:
    """A run's number of events and its status, from its event files; from the
    snapshot where those have no status."""
    mine = _tail(names, run_id)
    version = int(mine[-1].rsplit(".", 2)[1]) if mine else 0
    for name in reversed(mine):
        event = json.loads(fs.read_text(spark, f"{events_dir(root)}/{name}") or "{}")
        if event.get("status"):
            return version, event["status"]
    if any(n.endswith(".parquet") for n in names):
        held = run_state(_snapshot(spark, root).where(F.col("run_id") == run_id), ["status"]).first()
        if held:
            return max(version, held["n_events"]), held["status"]
    return version, None


def append_event(spark: SparkSession, root: str, run_id: str, event_at: datetime,
                 new: bool = False, **fields) -> int:
    """Append one state change (K1 create / K2 update); returns the run's version.

    The file of the version is created without overwrite: if another writer took
    it, the change is checked against the new state and tried as the next one.
    ``new`` says that no run of this id can exist (its id was just made up)."""
    unknown = set(fields) - set(STATE_FIELDS)
    if unknown:
        raise ValueError(f"unknown run fields: {sorted(unknown)}")
    event = {k: as_utc(v).isoformat() if isinstance(v, datetime) else v
             for k, v in fields.items() if v is not None}
    for name in ("last_loaded_line", "total_records", "valid_records", "invalid_records",
                 "duration_ms"):
        if name in event:
            event[name] = int(event[name])
    event.update(run_id=run_id, event_at=as_utc(event_at).isoformat())
    folder, status = events_dir(root), fields.get("status")
    while True:
        names = [] if new else fs.list_names(spark, folder)
        version, current = (0, None) if new else _version_and_status(spark, root, run_id, names)
        if current == L.STATUS_COMPLETED or status and status not in TRANSITIONS[current]:
            raise IllegalTransition(f"run {run_id} is {current}, it can't become {status}")
        event["seq"] = time.time_ns()
        path = f"{folder}/event-{run_key(run_id)}.{version + 1:06d}.json"
        try:
            fs.write_marker(spark, path, json.dumps(event))
            break
        except Exception:  # noqa: BLE001 - another writer took the version
            if not fs.exists(spark, path):
                raise
            new = False
    if status in L.TERMINAL_STATUSES and sum(n.endswith(".json") for n in names) >= TAIL_FILES:
        compact_events(spark, root, GRACE_HOURS)
    return version + 1


def _snapshot(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(L.RUN_EVENT_SCHEMA).option("pathGlobFilter", "*.parquet").parquet(
        events_dir(root))


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """Snapshot and event files together."""
    if not fs.exists(spark, events_dir(root)):
        return spark.createDataFrame([], L.RUN_EVENT_SCHEMA)
    tail = spark.read.schema(L.RUN_EVENT_SCHEMA).option("pathGlobFilter", "event-*.json").json(
        events_dir(root))
    return _snapshot(spark, root).union(tail)


def compact_events(spark: SparkSession, root: str, grace_hours: float = 0.0) -> int:
    """Fold the log's files into a new snapshot; returns the number replaced.

    The current files are listed, their rows written once more (duplicates
    by ``(run_id, seq)`` dropped), then the listed files are deleted.  Files
    younger than ``grace_hours`` are left alone, so a reader that listed the
    folder has that long to read it.  In the short window events may be seen
    twice, which changes no field of ``run_state`` (the latest value per field
    is the same row); only ``n_events`` is briefly higher.
    """
    folder = events_dir(root)
    limit = time.time() * 1000 - grace_hours * 3_600_000
    old = [n for n in fs.list_names(spark, folder) if n.endswith((".parquet", ".json"))
           and fs.modified_ms(spark, f"{folder}/{n}") <= limit]
    if len(old) < 2:
        return 0
    rows = None
    for kind, read in ((".parquet", spark.read.schema(L.RUN_EVENT_SCHEMA).parquet),
                       (".json", spark.read.schema(L.RUN_EVENT_SCHEMA).json)):
        paths = [f"{folder}/{n}" for n in old if n.endswith(kind)]
        if paths:
            some = read(*paths) if kind == ".parquet" else read(paths)
            rows = some if rows is None else rows.union(some)
    (rows.dropDuplicates(["run_id", "seq"]).coalesce(1).write.mode("append").parquet(folder))
    for n in old:
        fs.delete(spark, f"{folder}/{n}")
    return len(old)


def checkpoints_dir(root: str, run_id: str) -> str:
    return f"{root}/file_checkpoints/run={run_key(run_id)}"


def write_checkpoints(lines: DataFrame, root: str, run_id: str) -> None:
    """Keep the last loaded line of every file of a run (one row per file)."""
    lines.select("source_file", "last_loaded_line").write.mode("overwrite").parquet(
        checkpoints_dir(root, run_id))


def file_checkpoints(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    return spark.read.schema("source_file string, last_loaded_line long").parquet(
        checkpoints_dir(root, run_id))


def _latest(col: str) -> F.Column:
    return F.expr(f"max_by({col}, struct(event_at, seq)) FILTER (WHERE {col} IS NOT NULL)")


def run_state(events: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Current state per run (K3): latest non-null value of each field, plus
    ``created_at`` / ``updated_at`` / ``n_events``.  One group per run; the
    aggregation is partial map-side, so a run with very many events still
    reduces to one row per task before the shuffle."""
    fields = fields or STATE_FIELDS
    return events.groupBy("run_id").agg(
        *[_latest(f).alias(f) for f in fields],
        F.min("event_at").alias("created_at"),
        F.max("event_at").alias("updated_at"),
        F.count(F.lit(1)).alias("n_events"),
    )


def active_runs(states: DataFrame) -> DataFrame:
    """Runs whose current status is pending or processing (C12)."""
    return states.where(F.col("status").isin(L.ACTIVE_STATUSES)).select("run_id", "status")


def find_run(states: DataFrame, run_id: str) -> DataFrame:
    return states.where(F.col("run_id") == F.lit(run_id))


def summary(spark: SparkSession, run_id: str, filename: str, counts: dict, total_debtors: int,
            total_entities: int, duration_ms: int, completed_at: datetime) -> DataFrame:
    """Completion record (A9) in snake_case, plus the line counts (E5, E6).
    ``filename`` may be a path; its last component is kept.  ``completed_at`` is
    rendered ``yyyy-MM-ddTHH:mm:ssZ`` (a naive datetime is UTC)."""
    row = [(run_id, filename, int(counts["total"]), int(counts["valid"]), int(counts["invalid"]),
            int(total_debtors), int(total_entities), int(duration_ms))]
    made = spark.createDataFrame(
        row,
        "import_id string, filename string, total_records long, valid_records long, "
        "invalid_records long, total_debtors long, total_entities long, duration_ms long")
    return made.withColumn("filename", X.basename("filename")).withColumn(
        "completed_at", X.iso_utc(X.instant(completed_at)))


def summary_json(df: DataFrame, camel_case: bool = False) -> DataFrame:
    """The event as one JSON string, snake_case or camelCase keys (I13)."""
    cols = [F.col(k).alias(v if camel_case else k) for k, v in EVENT_KEYS.items()]
    return df.select(F.to_json(F.struct(*cols)).alias("event"))

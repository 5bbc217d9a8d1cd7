"""End-to-end import of one registry delivery.

    read text ─► classify (scan stage, no shuffle) ─► staging (Parquet, by kind)
    staging ─► debtors  (one hash aggregation) ┐
    staging ─► entities (one hash aggregation) ┴─► publish version ─► commit marker
    staging ─► reject log with line numbers, checkpoint per file (columnar pass
               over positions, while the tables are published)
    run events: processing → completed | failed;  summary JSON

The raw text is scanned once.  Counts come from the staged Parquet; line
numbers of rejects from the staged positions.  On failure the run is
marked failed and its staging kept; published tables are untouched.
"""

from __future__ import annotations

import time
import traceback
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerline import layout as L
from ledgerline.operators import aggregate as A
from ledgerline.operators import parts as PT
from ledgerline.operators import publish as P
from ledgerline.operators import runs as R
from ledgerline.operators import staging as S
from ledgerline import fs
from ledgerline.session import job_description, workspace_root
from ledgerline.sources import byte_ranges as BR
from ledgerline.sources import registry_text as RT


@dataclass
class Workspace:
    """Folders of one deployment (all under the shared work folder)."""
    root: str

    @property
    def staging(self) -> str:
        return f"{self.root}/staging"

    @property
    def published(self) -> str:
        return f"{self.root}/published"

    @property
    def runs(self) -> str:
        return f"{self.root}/runs"

    @property
    def rejects(self) -> str:
        return f"{self.root}/rejects"

    @property
    def summaries(self) -> str:
        return f"{self.root}/summaries"

    @classmethod
    def default(cls, spark: SparkSession, name: str = "default") -> "Workspace":
        return cls(f"{workspace_root(spark)}/workspaces/{name}")


@dataclass
class ImportResult:
    run_id: str
    version: str
    counts: dict
    summary: DataFrame | None  # None when it could not be made


def _utc_now() -> datetime:
    return datetime.now(timezone.utc)


def _count_exprs() -> list:
    return [F.count_if(F.col("kind") == L.KIND_VALID).alias("valid"),
            F.count_if(F.col("kind").isin(L.REJECT_REASONS)).alias("invalid")]


def _counts(valid: int, invalid: int) -> dict:
    return {"valid": valid, "invalid": invalid, "total": valid + invalid}


def line_counts(staged_all: DataFrame) -> dict:
    """valid / invalid / total over counted lines (blank and comment lines
    are not counted; total = valid + invalid)."""
    row = staged_all.agg(*_count_exprs()).first()
    return _counts(row["valid"], row["invalid"])


def stage_and_count(rows: DataFrame, ws: Workspace, slug: str) -> dict:
    """Write the staging and collect the line counts in the same pass (an
    ``Observation`` on the write: metrics of a result stage are applied once
    per successful task, so a retried task is not counted twice)."""
    obs = Observation(f"line_counts_{slug}")
    S.stage(rows.observe(obs, *_count_exprs()), ws.staging, slug)
    m = obs.get
    return _counts(int(m.get("valid") or 0), int(m.get("invalid") or 0))


def run_import(spark: SparkSession, path: str, ws: Workspace, run_id: str | None = None,
               clock: Callable[[], datetime] = _utc_now,
               filename: str | None = None, part_bytes: int | None = None,
               range_bytes: int = BR.RANGE_BYTES) -> ImportResult:
    """Import the registry file(s) at ``path`` (file, folder or glob).

    With ``part_bytes`` the load commits after every so many bytes of text, inside
    files too, and a retry of the same run goes on from there (``parts``)."""
    return import_lines(spark, lambda: RT.read_lines(spark, path), ws, filename or path,
                        run_id=run_id, clock=clock, inputs=[path], part_bytes=part_bytes,
                        range_bytes=range_bytes)


def import_lines(spark: SparkSession, lines: Callable[[], DataFrame], ws: Workspace,
                 filename: str, run_id: str | None = None,
                 clock: Callable[[], datetime] = _utc_now,
                 inputs: list[str] | None = None,
                 part_bytes: int | None = None,
                 range_bytes: int = BR.RANGE_BYTES) -> ImportResult:
    """Import lines shaped like ``read_lines`` (``source_file, split_start,
    row_id, raw, n_chars``): a batch read or a streaming micro-batch.
    ``lines`` is called once, inside the run, so that a failure while
    reading is recorded against the run.  ``inputs`` are the paths read; a
    retry reuses a staging only if their files are unchanged."""
    new, run_id = run_id is None, run_id or str(uuid.uuid4())
    slug = S.run_key(run_id)
    started = clock()
    t0 = time.monotonic()
    R.append_event(spark, ws.runs, run_id, started, new=new, status=L.STATUS_PENDING,
                   filename=filename.rstrip("/").rsplit("/", 1)[-1])
    R.append_event(spark, ws.runs, run_id, started, status=L.STATUS_PROCESSING,
                   started_at=started)
    try:
        with job_description(spark, f"ledgerline import {slug}: staging retention"):
            states = R.run_state(R.read_events(spark, ws.runs), ["status"])
            S.gc_staging(spark, ws.staging, states, started)

        # 1. one pass over the text: classify, stage and count every line.
        # A retry of the same run on the same files resumes: from its staging
        # if that is whole (the files may be gone by then), else after the
        # staged lines.  Anything else (another path, changed files) starts clean.
        source = "\n".join(inputs or [str(uuid.uuid4())])
        print_ = fs.fingerprint(spark, inputs or [])
        whole = S.made_from(spark, ws.staging, slug)
        if part_bytes:
            with job_description(spark, f"ledgerline import {slug}: stage in parts"):
                PT.load(spark, inputs[0], ws.staging, slug, part_bytes,
                        min(part_bytes, range_bytes))
                counts = line_counts(S.staged(spark, ws.staging, slug))
        elif S.exists(spark, ws.staging, slug) and S.same_input(whole, source, print_):
            counts = line_counts(S.staged(spark, ws.staging, slug))
        elif inputs and S.is_partial_of(spark, ws.staging, slug, source):
            with job_description(spark, f"ledgerline import {slug}: resume staging"):
                S.load_with_resume(spark, inputs[0], ws.staging, slug)
                S.write_input(spark, ws.staging, slug, source, print_)
                counts = line_counts(S.staged(spark, ws.staging, slug))
        else:
            S.drop_staging(spark, ws.staging, slug)
            with job_description(spark, f"ledgerline import {slug}: scan, classify, stage"):
                counts = stage_and_count(S.staged_rows(lines()), ws, slug)
            S.write_input(spark, ws.staging, slug, source, print_)
        # 2. aggregate and publish both tables as one version; meanwhile, from the
        # staged positions, the reject log and the files' checkpoints
        ends = Observation(f"last_lines_{slug}")

        def publish() -> str:
            loaded_at = clock()
            if part_bytes:
                debtors, entities = PT.merged(spark, ws.staging, slug)
            else:
                valid = S.staged(spark, ws.staging, slug, [L.KIND_VALID])
                debtors, entities = A.debtors(valid), A.entities(valid)
            return P.publish(spark, ws.published, {
                "debtors": A.with_loaded_at(debtors, loaded_at),
                "entities": A.with_loaded_at(entities, loaded_at),
            })

        def logs() -> None:
            splits = S.split_table(spark, ws.staging, slug)
            (S.staged_rejects(spark, ws.staging, slug, splits)
             .withColumn("run_id", F.lit(run_id))
             .write.mode("overwrite").parquet(f"{ws.rejects}/run={slug}"))
            R.write_checkpoints(S.last_loaded_lines(splits).observe(
                ends, F.max("last_loaded_line").alias("n")), ws.runs, run_id)

        with job_description(spark, f"ledgerline import {slug}: publish, reject log"):
            version, _ = P.together(spark, [publish, logs])
        last_line = ends.get.get("n")

        # 3. the staging is no longer needed
        S.drop_staging(spark, ws.staging, slug)
    except Exception as exc:  # the run is marked failed; staging is kept
        R.append_event(spark, ws.runs, run_id, clock(), status=L.STATUS_FAILED,
                       finished_at=clock(),
                       error_message=f"{type(exc).__name__}: {exc}")
        raise

    finished = clock()
    duration_ms = int((finished - started).total_seconds() * 1000) if clock is not _utc_now \
        else int((time.monotonic() - t0) * 1000)
    R.append_event(spark, ws.runs, run_id, finished, status=L.STATUS_COMPLETED,
                   finished_at=finished, total_records=counts["total"],
                   valid_records=counts["valid"], invalid_records=counts["invalid"],
                   last_loaded_line=last_line, duration_ms=duration_ms)

    # 4. summary: a failure here does not change the data outcome
    summary = None
    try:
        made = [P.row_count(P.read_published(spark, ws.published, table, version))
                for table in ("debtors", "entities")]
        summary = R.summary(spark, run_id, filename, counts, *made, duration_ms, finished)
        (R.summary_json(summary).union(R.summary_json(summary, camel_case=True))
         .write.mode("overwrite").text(f"{ws.summaries}/run={slug}"))
    except Exception:  # noqa: BLE001 - logged, never fails the published import
        traceback.print_exc()
    return ImportResult(run_id, version, counts, summary)


def rejects_of(spark: SparkSession, ws: Workspace, run_id: str) -> DataFrame:
    return spark.read.parquet(f"{ws.rejects}/run={S.run_key(run_id)}")


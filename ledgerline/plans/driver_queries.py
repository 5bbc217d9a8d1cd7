"""Queries registered with the driver, and the DuckDB oracle for each.

Every query reads the driver's tables: the registry is rendered from
``lineitem ⋈ orders`` (see ``bridge``), the run log from ``events``, the
retention inputs from ``orders`` and ``lineitem``.  Each oracle computes the
expected answer straight from the table columns.
"""

from __future__ import annotations

import hashlib
import uuid
from datetime import datetime
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline import fs
from ledgerline import layout as L
from ledgerline.functions import exprs as X
from ledgerline.operators import aggregate as A
from ledgerline.operators import classify as C
from ledgerline.operators import parts as PT
from ledgerline.operators import publish as P
from ledgerline.operators import reads as Q
from ledgerline.operators import runs as R
from ledgerline.operators import staging as S
from ledgerline.plans import bridge
from ledgerline.plans.import_job import Workspace, run_import
from ledgerline.session import work_root
from ledgerline.sources import byte_ranges as BR
from ledgerline.sources import registry_text as RT
from ledgerline.streaming import ingest as J

# Parameters of the registered read queries.
LOOKUP_CUIT = "20000000042"
LOOKUP_ENTITY = "00042"
TOP_N = 10
PAGE_SITUATION = "03"
PAGE = 2
PER_PAGE = 50
INDEXED_FILE_ROWS = 100
#: files of a layout beyond which they get more rows each, so that opening and
#: committing files doesn't outgrow the table
INDEXED_FILES = 1000
RESUME_AFTER_LINE = 3000
SPLIT_BYTES = 100_000
#: parts into which the loads that stop and go on inside files cut their input
PARTS = 5
SUMMARY_RUN_ID = "aabbccdd-1122-3344-5566-778899aabbcc"
SUMMARY_CLOCK = datetime(2026, 6, 8, 12, 0, 0)
RETENTION_AS_OF = "1998-06-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 12:00:00"
TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

RECORD_COLUMNS = L.FIELD_NAMES
STAGING_COLUMNS = ["identification_number", "entity_code", "situation", "loans"]


# ---------------------------------------------------------------------------
# shared inputs
# ---------------------------------------------------------------------------

def registry(spark: SparkSession, sf_dir: str) -> str:
    return bridge.registry_path(spark, sf_dir)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RT.read_lines(spark, registry(spark, sf_dir))


def data_lines(df: DataFrame) -> DataFrame:
    """Lines that are neither blank nor comments (the counted ones)."""
    return df.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def fresh_workspace(spark: SparkSession, name: str) -> Workspace:
    return Workspace(f"{work_root(spark)}/queries/{name}-{uuid.uuid4().hex[:10]}")


def serving_workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """A workspace with the full registry imported once per application (read
    queries); the registry's path names its input files' fingerprint."""
    path = registry(spark, sf_dir)
    app = spark.sparkContext.applicationId
    key = hashlib.sha1(f"{app}|{path}".encode()).hexdigest()[:12]
    ws = Workspace(f"{work_root(spark)}/serving/{key}")
    if P.current_version(spark, ws.published) is None:
        run_import(spark, path, ws)
    return ws


def published_debtors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.read_published(spark, serving_workspace(spark, sf_dir).published, "debtors")


def published_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.read_published(spark, serving_workspace(spark, sf_dir).published, "entities")


def run_events_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table read as a run log: a user is a run, event types
    map to statuses, ``(ts, event_id)`` orders the changes and the props of
    error events are the error messages."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    run_id = F.concat(
        F.lpad(F.col("user_id").cast("string"), 8, "0"), F.lit("-"),
        F.lpad((F.col("user_id") % 10000).cast("string"), 4, "0"), F.lit("-4000-8000-"),
        F.lpad((F.col("user_id") * 7919).cast("string"), 12, "0"))
    status = (F.when(F.col("event_type") == "signup", F.lit(L.STATUS_PENDING))
              .when(F.col("event_type").isin("click", "view"), F.lit(L.STATUS_PROCESSING))
              .when(F.col("event_type") == "purchase", F.lit(L.STATUS_COMPLETED))
              .when(F.col("event_type") == "error", F.lit(L.STATUS_FAILED)))
    return ev.select(
        run_id.alias("run_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("event_at"),
        status.alias("status"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error_message"),
    )


# ---------------------------------------------------------------------------
# queries
# ---------------------------------------------------------------------------

def q_debtors(spark, sf_dir):
    return A.debtors(C.staging_projection(lines(spark, sf_dir)))


def q_entities(spark, sf_dir):
    return A.entities(C.staging_projection(lines(spark, sf_dir)))


def q_key_uniqueness(spark, sf_dir):
    d = published_debtors(spark, sf_dir)
    e = published_entities(spark, sf_dir)
    return A.key_uniqueness(d, "identification_number", "debtors").unionByName(
        A.key_uniqueness(e, "entity_code", "entities"))


def q_parse_records(spark, sf_dir):
    numbered = RT.with_line_numbers(lines(spark, sf_dir).drop("line"))
    return C.valid_records(numbered).select(*RECORD_COLUMNS, "line_number")


def q_decode_latin1(spark, sf_dir):
    d = data_lines(lines(spark, sf_dir))
    return d.groupBy(
        X.field_slice("line", 25, 3).alias("activity"),
        F.length("line").cast("long").alias("n_chars"),
    ).agg(F.count(F.lit(1)).alias("n_lines"))


def q_line_numbers(spark, sf_dir):
    return RT.with_line_numbers(lines(spark, sf_dir)).select("line_number", "line")


def q_split_numbers(spark, sf_dir):
    """Line numbers over files of many splits, with the split each line is in."""
    many = RT.read_lines(spark, registry(spark, sf_dir), split_bytes=SPLIT_BYTES)
    return RT.with_line_numbers(many).select("split_start", "line_number", "line")


def q_skip_blank_comment(spark, sf_dir):
    k = C.line_kind()
    return lines(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(k == L.KIND_BLANK).alias("n_blank"),
        F.count_if(k == L.KIND_COMMENT).alias("n_comment"),
        F.count_if(~k.isin(L.KIND_BLANK, L.KIND_COMMENT)).alias("n_data"),
        F.count_if(k == L.KIND_VALID).alias("n_valid"),
        F.count_if(k.isin(L.REJECT_REASONS)).alias("n_rejected"),
    )


def q_normalize_situation(spark, sf_dir):
    d = data_lines(lines(spark, sf_dir))
    raw = X.field_slice("line", 28, 2)
    return d.groupBy(raw.alias("raw_situation"),
                     X.normalize_situation(raw).alias("situation")).agg(
        F.count(F.lit(1)).alias("n_lines"))


def q_parse_amount(spark, sf_dir):
    d = data_lines(lines(spark, sf_dir))
    slices = d.select(*[X.field_slice("line", pos, ln).alias(name)
                        for name, pos, ln, kind in L.FIELDS if kind == "amount"])
    long = slices.unpivot([], L.AMOUNT_FIELDS, "field", "raw")
    counted = long.groupBy("field", "raw").agg(F.count(F.lit(1)).alias("n_lines"))
    return counted.select("field", "raw", X.parse_amount("raw").alias("amount"), "n_lines")


def q_days_overdue(spark, sf_dir):
    d = data_lines(lines(spark, sf_dir)).where(F.length("line") >= L.LINE_LENGTH)
    raw = X.field_slice("line", 168, 4)
    return d.groupBy(raw.alias("raw_days"), X.lenient_int(raw).alias("days_overdue")).agg(
        F.count(F.lit(1)).alias("n_lines"))


def q_reject_reasons(spark, sf_dir):
    return C.reject_counts(lines(spark, sf_dir))


def q_reject_rows(spark, sf_dir):
    numbered = RT.with_line_numbers(lines(spark, sf_dir).drop("line"))
    return C.rejects(numbered).select("line_number", "reason", "detail")


def _staged_valid_numbered(spark, ws, slug):
    every = S.staged(spark, ws.staging, slug)
    valid = S.staged(spark, ws.staging, slug, [L.KIND_VALID]).drop("line_number")
    return RT.with_line_numbers(every, valid)


def q_staging_rows(spark, sf_dir):
    ws = fresh_workspace(spark, "staging_rows")
    S.stage(S.staged_rows(lines(spark, sf_dir)), ws.staging, "run1")
    return _staged_valid_numbered(spark, ws, "run1").select(*STAGING_COLUMNS, "line_number")


def q_resume_append(spark, sf_dir):
    ws = fresh_workspace(spark, "resume_append")
    path = registry(spark, sf_dir)
    # an interrupted load: only lines up to RESUME_AFTER_LINE of each file
    numbered = RT.with_line_numbers(RT.read_lines(spark, path).drop("line"))
    first = numbered.where(F.col("line_number") <= RESUME_AFTER_LINE)
    S.stage(S.staged_rows(first), ws.staging, "run1")
    # resume from the checkpoint
    S.load_with_resume(spark, path, ws.staging, "run1")
    return S.staged(spark, ws.staging, "run1", [L.KIND_VALID]).select(
        *STAGING_COLUMNS, "line_number")


def q_debtor_by_cuit(spark, sf_dir):
    return Q.debtor_by_cuit(published_debtors(spark, sf_dir), LOOKUP_CUIT)


def q_entity_by_code(spark, sf_dir):
    return Q.entity_by_code(published_entities(spark, sf_dir), LOOKUP_ENTITY)


def q_top_debtors(spark, sf_dir):
    out = Q.top_debtors_ranked(published_debtors(spark, sf_dir), TOP_N)
    return out.withColumn("position", F.col("position").cast("long"))


def q_top_debtors_meta(spark, sf_dir):
    return Q.top_debtors_meta(published_debtors(spark, sf_dir), TOP_N)


def q_debtors_by_situation(spark, sf_dir):
    return Q.debtors_filtered(published_debtors(spark, sf_dir), PAGE_SITUATION)


def q_debtors_page(spark, sf_dir):
    out = Q.debtors_page(published_debtors(spark, sf_dir), PAGE_SITUATION, PAGE, PER_PAGE)
    return out.withColumn("position", F.col("position").cast("long"))


def q_page_meta(spark, sf_dir):
    return Q.page_meta(published_debtors(spark, sf_dir), PAGE_SITUATION, PAGE, PER_PAGE)


def indexed_file_rows(n_rows: int) -> int:
    return max(INDEXED_FILE_ROWS, -(-n_rows // INDEXED_FILES))


def indexed_workspace(spark, sf_dir) -> Workspace:
    """The registry published in files of few rows, so that pages and top n have
    files to leave out."""
    app = spark.sparkContext.applicationId
    key = hashlib.sha1(f"{app}|{registry(spark, sf_dir)}|indexed".encode()).hexdigest()[:12]
    ws = Workspace(f"{work_root(spark)}/serving/{key}")
    if P.current_version(spark, ws.published) is None:
        made = f"{ws.root}/aggregated"
        aggregated = q_debtors(spark, sf_dir)
        aggregated.write.mode("overwrite").parquet(made)
        debtors = spark.read.schema(aggregated.schema).parquet(made)
        P.publish(spark, ws.published, {"debtors": A.with_loaded_at(debtors, SUMMARY_CLOCK)},
                  file_rows=indexed_file_rows(P.row_count(debtors)))
    return ws


def few_files(df: DataFrame, most: int) -> DataFrame:
    """``df``, which may read this many files at most."""
    if len(df.inputFiles()) > most:
        raise AssertionError(f"{len(df.inputFiles())} files read")
    return df


def q_deep_page(spark, sf_dir):
    """The last page of the whole table, found by the rank index."""
    root = indexed_workspace(spark, sf_dir).published
    last = Q.published_page_meta(spark, root, None, 1, PER_PAGE).first()["last_page"]
    return few_files(Q.published_page(spark, root, None, last, PER_PAGE), 2)


def q_situation_page(spark, sf_dir):
    """A filtered page by the index of the situation layout, with its metadata."""
    root = indexed_workspace(spark, sf_dir).published
    page = few_files(Q.published_page(spark, root, PAGE_SITUATION, PAGE, PER_PAGE), 2)
    meta = Q.published_page_meta(spark, root, PAGE_SITUATION, PAGE, PER_PAGE).first()
    return page.select("*", F.lit(meta["total"]).alias("total"),
                       F.lit(meta["last_page"]).alias("last_page"))


def q_top_by_total(spark, sf_dir):
    """The top n from the files that can hold it."""
    root = indexed_workspace(spark, sf_dir).published
    out = few_files(Q.published_top(spark, root, TOP_N), 1)
    return out.withColumn("position", F.col("position").cast("long"))


def q_list_by_situation(spark, sf_dir):
    root = indexed_workspace(spark, sf_dir).published
    return Q.published_by_situation(spark, root, PAGE_SITUATION)


def q_valid_cuit(spark, sf_dir):
    d = published_debtors(spark, sf_dir)
    return d.select("identification_number",
                    X.is_valid_cuit("identification_number").alias("is_valid_cuit"))


def q_severity(spark, sf_dir):
    d = data_lines(lines(spark, sf_dir))
    sit = C.field("situation")
    return d.groupBy(sit.alias("situation"), X.severity(sit).alias("severity")).agg(
        F.count(F.lit(1)).alias("n_lines"))


def q_is_worse_than(spark, sf_dir):
    rows = C.staging_projection(lines(spark, sf_dir))
    # at most seven rows per debtor, so a debtor with a huge share of all lines
    # adds no skew to the window; one scan, no join
    per_code = rows.groupBy("identification_number", "situation").agg(
        F.count(F.lit(1)).alias("n"))
    worst = F.max(X.severity("situation")).over(Window.partitionBy("identification_number"))
    j = per_code.withColumn("max_situation", X.code_of_rank(worst))
    return j.groupBy(
        "situation", "max_situation",
        X.is_worse_than("situation", "max_situation").alias("row_is_worse"),
        X.is_worse_than("max_situation", "situation").alias("max_is_worse"),
    ).agg(F.sum("n").alias("n_lines"))


def q_amount_add(spark, sf_dir):
    rows = C.valid_records(lines(spark, sf_dir), ["entity_code", "loans", "guarantees"])
    return rows.groupBy("entity_code").agg(
        F.sum(X.amount_add("loans", "guarantees")).cast(L.MONEY)
        .alias("total_loans_and_guarantees"))


def q_run_slug(spark, sf_dir):
    ev = run_events_from_events(spark, sf_dir)
    return ev.select("run_id").distinct().select("run_id", X.run_slug("run_id").alias("slug"))


def _run_states(spark, sf_dir):
    return R.run_state(run_events_from_events(spark, sf_dir), ["status", "error_message"])


def q_run_state(spark, sf_dir):
    st = _run_states(spark, sf_dir)
    return st.select("run_id", "status", "error_message", "n_events",
                     F.date_format("created_at", TS_FORMAT).alias("created_at"),
                     F.date_format("updated_at", TS_FORMAT).alias("updated_at"))


def q_active_runs(spark, sf_dir):
    return R.active_runs(_run_states(spark, sf_dir))


def q_run_summary(spark, sf_dir):
    ws = fresh_workspace(spark, "run_summary")
    res = run_import(spark, registry(spark, sf_dir), ws, run_id=SUMMARY_RUN_ID,
                     clock=lambda: SUMMARY_CLOCK)
    return res.summary


def q_staging_retention(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    states = orders.select(
        F.concat(F.lpad(F.col("o_orderkey").cast("string"), 12, "0"),
                 F.lit("-0000-4000-8000-000000000000")).alias("run_id"),
        (F.when(F.col("o_orderstatus") == "F", F.lit(L.STATUS_COMPLETED))
         .when(F.col("o_orderstatus") == "P", F.lit(L.STATUS_FAILED))
         .when(F.col("o_orderstatus") == "O", F.lit(L.STATUS_PROCESSING))).alias("status"),
        F.col("o_orderdate").alias("updated_at"))
    key = F.when(F.col("l_orderkey") % 50 == 0, F.col("l_orderkey") + 1000000000).otherwise(
        F.col("l_orderkey"))
    staged_slugs = li.select(F.lpad(key.cast("string"), 12, "0").alias("slug")).distinct()
    return S.stale_staging(staged_slugs, states, datetime.fromisoformat(RETENTION_AS_OF))


def q_retention_odd_ids(spark, sf_dir):
    """Retention by the import's own folder keys, for run ids with dots,
    slashes, blanks and other signs: folders of known runs are never orphans."""
    states = _run_states(spark, sf_dir).select(
        F.concat(F.lit("imp_"), F.regexp_replace("run_id", "-", "./ *~"), F.lit("é")).alias("run_id"),
        "status", "updated_at")
    folders = states.select(X.run_key("run_id").alias("slug"))
    return S.stale_staging(folders, states, datetime.fromisoformat(EVENTS_AS_OF), key=X.run_key)


def _two_deliveries_published(spark, sf_dir, ws):
    root = registry(spark, sf_dir)
    for delivery in ("F", "O"):
        run_import(spark, bridge.delivery_path(root, delivery), ws)
    return P.read_published(spark, ws.published, "debtors")


def q_latest_file_wins(spark, sf_dir):
    ws = fresh_workspace(spark, "latest_file_wins")
    return _two_deliveries_published(spark, sf_dir, ws).select(*Q.DEBTOR_COLUMNS)


def q_publish_out_of_order(spark, sf_dir):
    """Three versions whose names fall (skewed clocks): the last commit wins."""
    ws = fresh_workspace(spark, "publish_out_of_order")
    root = registry(spark, sf_dir)
    for name, delivery in (("v3", "F"), ("v2", "F"), ("v1", "O")):
        rows = C.staging_projection(RT.read_lines(spark, bridge.delivery_path(root, delivery)))
        P.publish(spark, ws.published, {"debtors": A.with_loaded_at(A.debtors(rows), SUMMARY_CLOCK)},
                  version=name)
    return P.read_published(spark, ws.published, "debtors").select(*Q.DEBTOR_COLUMNS)


def q_rerun_other_file(spark, sf_dir):
    """A staging left by a failed run is not taken by a run whose id starts
    alike, nor by the same run on another path."""
    ws = fresh_workspace(spark, "rerun_other_file")
    root = registry(spark, sf_dir)
    first, second = (bridge.delivery_path(root, d) for d in ("F", "O"))
    left, other = "aabbccddeeff-1111", "aabbccddeeff-2222"
    for run_id in (left, other):
        S.stage(S.staged_rows(RT.read_lines(spark, first)), ws.staging, S.run_key(run_id))
        S.write_input(spark, ws.staging, S.run_key(run_id), first,
                      fs.fingerprint(spark, [first]))
        R.append_event(spark, ws.runs, run_id, SUMMARY_CLOCK, status=L.STATUS_FAILED)
    run_import(spark, second, ws, run_id=other)
    return P.read_published(spark, ws.published, "debtors").select(*Q.DEBTOR_COLUMNS)


def q_import_resume(spark, sf_dir):
    """A load cut short after some lines of each file, then the import of the
    same run: the whole registry's debtors."""
    ws = fresh_workspace(spark, "import_resume")
    path = registry(spark, sf_dir)
    key = S.run_key(SUMMARY_RUN_ID)
    numbered = RT.with_line_numbers(RT.read_lines(spark, path).drop("line"))
    S.stage(S.staged_rows(numbered.where(F.col("line_number") <= RESUME_AFTER_LINE)),
            ws.staging, key)
    S.write_input(spark, ws.staging, key, S.PARTIAL + path)
    R.append_event(spark, ws.runs, SUMMARY_RUN_ID, SUMMARY_CLOCK, status=L.STATUS_PROCESSING)
    run_import(spark, path, ws, run_id=SUMMARY_RUN_ID, clock=lambda: SUMMARY_CLOCK)
    return P.read_published(spark, ws.published, "debtors").select(*Q.DEBTOR_COLUMNS)


def q_resume_changed_file(spark, sf_dir):
    """A load of delivery F cut short, its files replaced by those of O, then
    the import of the same run on the same path: O's debtors only."""
    ws = fresh_workspace(spark, "resume_changed_file")
    path, key = f"{ws.root}/arriving", S.run_key("changed_file/1")
    J.deliver(spark, bridge.rendered_lines(spark, sf_dir, "F"), path)
    numbered = RT.with_line_numbers(RT.read_lines(spark, path).drop("line"))
    S.stage(S.staged_rows(numbered.where(F.col("line_number") <= RESUME_AFTER_LINE)),
            ws.staging, key)
    S.write_input(spark, ws.staging, key, S.PARTIAL + path)
    R.append_event(spark, ws.runs, "changed_file/1", SUMMARY_CLOCK, status=L.STATUS_PROCESSING)
    fs.delete(spark, path)
    J.deliver(spark, bridge.rendered_lines(spark, sf_dir, "O"), path)
    run_import(spark, path, ws, run_id="changed_file/1", clock=lambda: SUMMARY_CLOCK)
    return P.read_published(spark, ws.published, "debtors").select(*Q.DEBTOR_COLUMNS)


def part_sizes(spark, path) -> dict[str, int]:
    """Bytes of a part and of a range, for ``PARTS`` parts of several ranges."""
    part = sum(length for _, length in BR.files_of(spark, path)) // PARTS + 1
    return {"part_bytes": part, "range_bytes": max(1, min(BR.RANGE_BYTES, part // 8))}


def q_import_in_parts(spark, sf_dir):
    """A load stopped inside a file after two of five parts, then the import of
    the same run: it reads the other ranges and merges the parts' aggregates."""
    ws = fresh_workspace(spark, "import_in_parts")
    path = registry(spark, sf_dir)
    sizes = part_sizes(spark, path)
    key = S.run_key(SUMMARY_RUN_ID)
    R.append_event(spark, ws.runs, SUMMARY_RUN_ID, SUMMARY_CLOCK, status=L.STATUS_PROCESSING)
    before = PT.load(spark, path, ws.staging, key, **sizes, max_parts=2)
    after = PT.load(spark, path, ws.staging, key, **sizes)
    if {(r.path, r.start) for r in before} & {(r.path, r.start) for r in after}:
        raise AssertionError("a committed range was read again")
    run_import(spark, path, ws, run_id=SUMMARY_RUN_ID, clock=lambda: SUMMARY_CLOCK,
               part_bytes=sizes["part_bytes"], range_bytes=sizes["range_bytes"])
    return P.read_published(spark, ws.published, "debtors").select(*Q.DEBTOR_COLUMNS)


def q_parts_changed_file(spark, sf_dir):
    """A load of F in parts cut short, its files replaced by O's, then the rest of
    the run: O's debtors only, from the parts' aggregates."""
    ws = fresh_workspace(spark, "parts_changed_file")
    path = f"{ws.root}/arriving"
    J.deliver(spark, bridge.rendered_lines(spark, sf_dir, "F"), path)
    sizes = part_sizes(spark, path)
    PT.load(spark, path, ws.staging, "changed", **sizes, max_parts=3)
    fs.delete(spark, path)
    J.deliver(spark, bridge.rendered_lines(spark, sf_dir, "O"), path)
    PT.load(spark, path, ws.staging, "changed", **sizes)
    return PT.merged(spark, ws.staging, "changed")[0]


def q_staged_rejects(spark, sf_dir):
    """The reject log as the import writes it: from the staged positions, of a
    staging made in parts."""
    ws = fresh_workspace(spark, "staged_rejects")
    path = registry(spark, sf_dir)
    PT.load(spark, path, ws.staging, "run1", **part_sizes(spark, path))
    return S.staged_rejects(spark, ws.staging, "run1").select("line_number", "reason", "detail")


def q_stream_within_file(spark, sf_dir):
    """A stream over files cut into five batches, stopped after the second and
    again after the third, then run to the end: as one shot."""
    ws = fresh_workspace(spark, "stream_within_file")
    path = registry(spark, sf_dir)
    sizes = part_sizes(spark, path)
    for batches in (2, 1, None):
        J.stream_within_files(spark, path, f"{ws.root}/sink", f"{ws.root}/checkpoint",
                              sizes["part_bytes"], sizes["range_bytes"], max_batches=batches)
    return spark.read.parquet(f"{ws.root}/sink").select(*STAGING_COLUMNS)


def _imported(spark, sf_dir, name):
    ws = fresh_workspace(spark, name)
    run_import(spark, registry(spark, sf_dir), ws, run_id=SUMMARY_RUN_ID,
               clock=lambda: SUMMARY_CLOCK)
    return ws


def q_run_log_written(spark, sf_dir):
    """The log that an import wrote, and the staging folders it left."""
    ws = _imported(spark, sf_dir, "run_log_written")
    states = R.run_state(R.read_events(spark, ws.runs))
    left = S.list_staging(spark, ws.staging).agg(F.count(F.lit(1)).alias("n_staging"))
    return states.select(
        "run_id", "status", "filename", "total_records", "valid_records", "invalid_records",
        "last_loaded_line", "n_events",
        X.iso_utc("started_at").alias("started_at")).crossJoin(F.broadcast(left))


def q_file_checkpoints(spark, sf_dir):
    """The last loaded line of every file of an import, with the run's state."""
    ws = _imported(spark, sf_dir, "file_checkpoints")
    at = R.file_checkpoints(spark, ws.runs, SUMMARY_RUN_ID)
    return at.select(F.regexp_extract("source_file", "delivery=([^/]+)", 1).alias("delivery"),
                     F.regexp_extract("source_file", "file_no=([0-9]+)", 1).cast("long")
                     .alias("file_no"), "last_loaded_line")


def q_completion_event(spark, sf_dir):
    """The completion record read back from its JSON, in both spellings."""
    ws = _imported(spark, sf_dir, "completion_event")
    names = list(R.EVENT_KEYS.items())
    written = spark.read.text(f"{ws.summaries}/run={S.run_key(SUMMARY_RUN_ID)}")
    kinds = {"total_debtors": "long", "total_entities": "long", "duration_ms": "long"}
    out = None
    for spelling in ("snake", "camel"):
        keys = {k: k if spelling == "snake" else v for k, v in names}
        schema = ", ".join(f"{v} {kinds.get(k, 'string')}" for k, v in keys.items())
        one = written.select(F.from_json("value", schema).alias("e")).where(
            F.col(f"e.{keys['import_id']}").isNotNull()).select(
            F.lit(spelling).alias("spelling"), *[F.col(f"e.{v}").alias(k) for k, v in keys.items()])
        out = one if out is None else out.unionByName(one)
    return out


def q_load_timestamp(spark, sf_dir):
    """Distinct load times of each published table: one."""
    ws = _imported(spark, sf_dir, "load_timestamp")
    out = None
    for table in ("debtors", "entities"):
        one = P.read_published(spark, ws.published, table).agg(
            F.count_distinct("loaded_at").alias("n_times"),
            X.iso_utc(F.min("loaded_at")).alias("loaded_at")).select(
            F.lit(table).alias("table_name"), "n_times", "loaded_at")
        out = one if out is None else out.unionByName(one)
    return out


def q_stream_ingest(spark, sf_dir):
    ws = fresh_workspace(spark, "stream_ingest")
    root = registry(spark, sf_dir)
    sink, ckpt = f"{ws.root}/sink", f"{ws.root}/checkpoint"
    J.stream_valid_rows(spark, f"{root}/*/*", sink, ckpt)
    J.stream_valid_rows(spark, f"{root}/*/*", sink, ckpt)  # rerun: adds nothing
    return spark.read.parquet(sink).select(*STAGING_COLUMNS)


def q_stream_latest_file(spark, sf_dir):
    ws = fresh_workspace(spark, "stream_latest_file")
    landing, ckpt = f"{ws.root}/landing", f"{ws.root}/checkpoint"
    for n, delivery in enumerate(("F", "O"), start=1):
        J.deliver(spark, bridge.rendered_lines(spark, sf_dir, delivery),
                  f"{landing}/delivery-{n:04d}")
        J.stream_latest_delivery(spark, f"{landing}/*", ws, ckpt)
    return P.read_published(spark, ws.published, "debtors").select(*Q.DEBTOR_COLUMNS)


def q_roundtrip(spark, sf_dir):
    ws = fresh_workspace(spark, "roundtrip")
    recs = C.valid_records(lines(spark, sf_dir)).select(*RECORD_COLUMNS)
    # the registry's whole text a second time, so kept compressed
    RT.write_fixed_width(recs, f"{ws.root}/written", compressed=True)
    back = RT.read_lines(spark, f"{ws.root}/written")
    return C.valid_records(back).select(*RECORD_COLUMNS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "debtors": q_debtors,
    "entities": q_entities,
    "key_uniqueness": q_key_uniqueness,
    "parse_records": q_parse_records,
    "decode_latin1": q_decode_latin1,
    "line_numbers": q_line_numbers,
    "split_numbers": q_split_numbers,
    "skip_blank_comment": q_skip_blank_comment,
    "normalize_situation": q_normalize_situation,
    "parse_amount": q_parse_amount,
    "days_overdue": q_days_overdue,
    "reject_reasons": q_reject_reasons,
    "reject_rows": q_reject_rows,
    "staging_rows": q_staging_rows,
    "resume_append": q_resume_append,
    "debtor_by_cuit": q_debtor_by_cuit,
    "entity_by_code": q_entity_by_code,
    "top_debtors": q_top_debtors,
    "top_debtors_meta": q_top_debtors_meta,
    "debtors_by_situation": q_debtors_by_situation,
    "debtors_page": q_debtors_page,
    "page_meta": q_page_meta,
    "deep_page": q_deep_page,
    "situation_page": q_situation_page,
    "top_by_total": q_top_by_total,
    "list_by_situation": q_list_by_situation,
    "valid_cuit": q_valid_cuit,
    "severity": q_severity,
    "is_worse_than": q_is_worse_than,
    "amount_add": q_amount_add,
    "run_slug": q_run_slug,
    "run_state": q_run_state,
    "active_runs": q_active_runs,
    "run_summary": q_run_summary,
    "staging_retention": q_staging_retention,
    "retention_odd_ids": q_retention_odd_ids,
    "latest_file_wins": q_latest_file_wins,
    "publish_out_of_order": q_publish_out_of_order,
    "rerun_other_file": q_rerun_other_file,
    "import_resume": q_import_resume,
    "resume_changed_file": q_resume_changed_file,
    "import_in_parts": q_import_in_parts,
    "parts_changed_file": q_parts_changed_file,
    "staged_rejects": q_staged_rejects,
    "stream_within_file": q_stream_within_file,
    "run_log_written": q_run_log_written,
    "file_checkpoints": q_file_checkpoints,
    "completion_event": q_completion_event,
    "load_timestamp": q_load_timestamp,
    "stream_ingest": q_stream_ingest,
    "stream_latest_file": q_stream_latest_file,
    "roundtrip": q_roundtrip,
}

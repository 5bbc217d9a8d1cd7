"""Staging of one import run, resume, and staging retention.

A run's staging is one Parquet dataset ``<staging_root>/run=<slug>`` with
one row per line and its ``kind``: valid rows carry the four aggregate
columns, rejects their reason detail, and every row (blank and comment
lines too) its position columns, so line numbers can be derived later from
the staged copy with a cheap columnar scan instead of a second pass over
the raw text.  ``kind`` is a plain column, not a folder partition: a
partitioned write would sort every task's rows by kind, while a filter on
the (dictionary-encoded) column is pushed into the Parquet scan for free.  Writes go through Spark's commit protocol: a task lost midway
is retried and only committed files become visible.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from urllib.parse import quote_plus

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import fs
from ledgerline import layout as L
from ledgerline.functions import exprs as X
from ledgerline.operators import classify as C
from ledgerline.sources import registry_text as RT

STAGED_COLUMNS = ["source_file", "split_start", "row_id", "line_number",
                  "identification_number", "entity_code", "situation", "loans", "detail", "kind"]


def run_dir(staging_root: str, slug: str) -> str:
    return f"{staging_root}/run={slug}"


def run_key(run_id: str) -> str:
    """Folder key of a run: its whole id, URL-encoded, so that no two runs share
    one (``exprs.run_key`` is the column form of the same key)."""
    return quote_plus(run_id, safe="").replace("~", "%7E")


#: note of a staging that line-level loading may still add to
PARTIAL = "partial:"


def write_input(spark: SparkSession, staging_root: str, key: str, source: str,
                fingerprint: str = "") -> None:
    """Note beside a committed staging which input it was made from.  The note
    of a partial staging always has the fingerprint its input has now."""
    if source.startswith(PARTIAL) and not fingerprint:
        fingerprint = fs.fingerprint(spark, [source[len(PARTIAL):]])
    path = f"{staging_root}/input-{key}"
    fs.delete(spark, path)
    fs.write_marker(spark, path, f"{source}\n{fingerprint}" if fingerprint else source)


def same_input(note: str | None, source: str, fingerprint: str) -> bool:
    """Whether a staging's note names this source, unchanged or gone by now."""
    if not note or not note.startswith(source + "\n"):
        return False
    return not fingerprint or note == f"{source}\n{fingerprint}"


def made_from(spark: SparkSession, staging_root: str, key: str) -> str | None:
    return fs.read_text(spark, f"{staging_root}/input-{key}")


def staged_rows(lines: DataFrame, *more: str) -> DataFrame:
    """Classify lines into the staged shape (one pass, no shuffle), keeping the
    columns ``more``.

    ``lines`` has ``line`` and the position columns; ``line_number`` is kept
    when present (resume mode) and NULL otherwise.  ``kind`` is computed
    once as its own column (Catalyst keeps it in a separate projection
    instead of inlining it into every field that depends on it).
    """
    has_number = "line_number" in lines.columns
    classified = lines.withColumn("kind", C.line_kind())
    valid = F.col("kind") == L.KIND_VALID
    return classified.select(
        "source_file", "split_start", "row_id",
        (F.col("line_number") if has_number else F.lit(None).cast("long")).alias("line_number"),
        F.when(valid, C.field("identification_number")).alias("identification_number"),
        F.when(valid, C.field("entity_code")).alias("entity_code"),
        F.when(valid, C.field("situation")).alias("situation"),
        F.when(valid, C.field("loans")).alias("loans"),
        C.reject_detail(F.col("kind")).alias("detail"),
        "kind",
        *more,
    )


def stage(rows: DataFrame, staging_root: str, slug: str, mode: str = "overwrite") -> str:
    """Write staged rows for a run (``mode='append'`` adds to it)."""
    out = run_dir(staging_root, slug)
    rows.select(*STAGED_COLUMNS).write.mode(mode).parquet(out)
    return out


_STAGED_SCHEMA = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("split_start", T.LongType()),
    T.StructField("row_id", T.LongType()),
    T.StructField("line_number", T.LongType()),
    T.StructField("identification_number", T.StringType()),
    T.StructField("entity_code", T.StringType()),
    T.StructField("situation", T.StringType()),
    T.StructField("loans", L.MONEY),
    T.StructField("detail", T.StringType()),
    T.StructField("kind", T.StringType()),
])


def staged(spark: SparkSession, staging_root: str, slug: str,
           kinds: list[str] | None = None) -> DataFrame:
    """Read a run's staging; ``kinds`` filters lines (pushed to the scan)."""
    df = spark.read.schema(_STAGED_SCHEMA).parquet(run_dir(staging_root, slug)).select(
        *STAGED_COLUMNS)  # a staging made in parts has their number as well
    if kinds is not None:
        df = df.where(F.col("kind").isin(kinds))
    return df


def split_table(spark: SparkSession, staging_root: str, slug: str) -> DataFrame:
    """The staging's splits (one row each) with the place of their last valid
    line; written beside it, as both the reject log and the checkpoints use it."""
    splits = RT.split_offsets(
        staged(spark, staging_root, slug).select(*RT.POSITION_COLUMNS, "line_number", "kind"),
        F.max(F.when(F.col("kind") == L.KIND_VALID, F.col("row_id"))).alias("last_valid"),
        F.max(F.when(F.col("kind") == L.KIND_VALID, F.col("line_number"))).alias("last_number"),
        F.count("line_number").alias("n_numbered"),
    )
    path = f"{staging_root}/splits-{slug}"
    splits.write.mode("overwrite").parquet(path)
    return spark.read.schema(splits.schema).parquet(path)


def staged_rejects(spark: SparkSession, staging_root: str, slug: str,
                   splits: DataFrame | None = None) -> DataFrame:
    """Rejects of a staged run with line numbers derived from the staged
    positions (the raw text is not read again)."""
    splits = split_table(spark, staging_root, slug) if splits is None else splits
    rej = staged(spark, staging_root, slug, L.REJECT_REASONS)
    if not splits.where("n_numbered > 0").isEmpty():
        # resumed: numbered when staged (positions of two scans don't mix)
        return rej.select("source_file", "line_number", F.col("kind").alias("reason"), "detail")
    numbered = RT.with_line_numbers(None, rej.drop("line_number"), splits=splits)
    return numbered.select("source_file", "line_number", F.col("kind").alias("reason"), "detail")


def drop_staging(spark: SparkSession, staging_root: str, slug: str) -> None:
    """The note goes first: without it nothing else of a staging is believed."""
    for name in (f"input-{slug}", f"manifest-{slug}", f"partials-{slug}", f"splits-{slug}",
                 f"run={slug}"):
        fs.delete(spark, f"{staging_root}/{name}")


def exists(spark: SparkSession, staging_root: str, slug: str) -> bool:
    return fs.exists(spark, run_dir(staging_root, slug) + "/_SUCCESS")


def list_staging(spark: SparkSession, staging_root: str) -> DataFrame:
    """Slugs that have a staging folder (one row each; folder metadata only)."""
    slugs = [n.split("=", 1)[1] for n in fs.list_names(spark, staging_root)
             if n.startswith("run=")]
    return spark.createDataFrame([(s,) for s in slugs], "slug string")


# -- resume (line-level checkpoint) ------------------------------------------

def checkpoints(staged_valid_rows: DataFrame) -> DataFrame:
    """Last loaded line per source file (one row per file)."""
    return staged_valid_rows.groupBy("source_file").agg(
        F.max("line_number").alias("last_loaded_line"))


# One row per source file; a table of this many rows is a few MB.
MAX_BROADCAST_FILES = 200_000


def remaining_lines(numbered_lines: DataFrame, last_lines: DataFrame) -> DataFrame:
    """Lines after each file's checkpoint (all of a file without one).

    The checkpoint table has one row per source file.  It is materialized
    and counted, then broadcast when within the bound, so a file holding a
    large share of all lines is never shuffled into one task; beyond the
    bound the join shuffles (with AQE skew splitting).
    """
    last = last_lines.checkpoint(eager=True)
    side = F.broadcast(last) if last.count() <= MAX_BROADCAST_FILES else last
    joined = numbered_lines.join(side, "source_file", "left")
    return joined.where(
        F.col("line_number") > F.coalesce(F.col("last_loaded_line"), F.lit(0))
    ).drop("last_loaded_line")


def is_partial_of(spark: SparkSession, staging_root: str, key: str, path: str) -> bool:
    """Whether this staging is a load of ``path`` that was cut short, and the
    path's files are still those it was made from."""
    if not exists(spark, staging_root, key):
        return False
    note = made_from(spark, staging_root, key)
    return note == f"{PARTIAL}{path}\n{fs.fingerprint(spark, [path])}"


def last_loaded_lines(splits: DataFrame) -> DataFrame:
    """Per file the largest line number of a staged valid line (null without
    one), from the split table alone."""
    return splits.groupBy("source_file").agg(F.max(F.coalesce(
        "last_number", F.col("lines_before") + F.col("last_valid") - F.col("first_row_id") + 1))
        .alias("last_loaded_line"))


def load_with_resume(spark: SparkSession, path: str, staging_root: str, slug: str,
                     last_loaded_line: int | None = None) -> str:
    """Stage a file, resuming after the checkpoint.

    ``last_loaded_line`` is the run's checkpoint: ``0`` (or a missing
    staging) starts clean, replacing whatever is staged; a positive value
    skips lines up to it; ``None`` derives it per source file from the
    staged rows.  An interrupted load followed by a resume leaves exactly
    what a one-shot load leaves.
    """
    # only what staging needs is materialized for numbering (not the decoded text)
    lines = RT.with_line_numbers(RT.read_lines(spark, path).drop("line"))
    write_input(spark, staging_root, slug, PARTIAL + path)  # until the import has it whole
    if last_loaded_line == 0 or not exists(spark, staging_root, slug):
        return stage(staged_rows(lines), staging_root, slug, mode="overwrite")
    if last_loaded_line is None:
        rest = remaining_lines(lines, checkpoints(staged(spark, staging_root, slug)))
    else:
        rest = lines.where(F.col("line_number") > F.lit(int(last_loaded_line)))
    return stage(staged_rows(rest), staging_root, slug, mode="append")


# -- retention ---------------------------------------------------------------

def stale_staging(staging_slugs: DataFrame, run_states: DataFrame, as_of: datetime,
                  ttl_hours: int = L.STAGING_TTL_HOURS, key=X.run_slug) -> DataFrame:
    """Staging folders to remove: no matching run, or a terminal run last
    updated at least ``ttl_hours`` before ``as_of``.  ``run_states`` needs
    ``run_id, status, updated_at``; ``key`` maps a run id to its folder key.
    Instants are compared (a naive ``as_of`` is UTC), so the session's time
    zone plays no part."""
    runs = run_states.select(key("run_id").alias("slug"), "status", "updated_at")
    cutoff = X.instant(as_of - timedelta(hours=ttl_hours))
    joined = staging_slugs.join(runs, "slug", "left")
    orphan = F.col("status").isNull()
    expired = F.col("status").isin(L.TERMINAL_STATUSES) & (F.col("updated_at") <= cutoff)
    return joined.where(orphan | expired).select(
        "slug", F.when(orphan, F.lit("orphan")).otherwise(F.lit("expired")).alias("reason"))


def gc_staging(spark: SparkSession, staging_root: str, run_states: DataFrame,
               as_of: datetime) -> list[str]:
    """Remove stale staging folders; returns the removed slugs.  The list of
    folders is bounded by the number of runs kept on disk."""
    present = list_staging(spark, staging_root)
    if present.isEmpty():
        return []
    stale = stale_staging(present, run_states, as_of, key=X.run_key)
    removed = []
    for row in stale.toLocalIterator():
        drop_staging(spark, staging_root, row.slug)
        removed.append(row.slug)
    return removed

"""Structured Streaming ingest of registry deliveries.

``stream_valid_rows`` (J1): every new file in a landing folder is parsed and
its valid rows appended to a Parquet sink; the checkpoint records which
files are done, so a rerun adds nothing and a new file adds only its rows.

``stream_within_files`` (J1 inside a file): the same for long files, committed
every so many bytes of text, so a stopped load goes on inside the file.

``stream_latest_delivery`` (J2): arriving files trigger the batch import (stage
→ aggregate → publish) of the newest complete delivery, a folder with a
``_SUCCESS``, so the newest delivery replaces the published tables.

The first and last use ``trigger(availableNow=True)``: process what has arrived, then stop
— the bounded, restartable form of the reference's file-at-a-time ingest.
A file replaced under the same name is not re-read by the file source;
each delivery must arrive under a new name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import fs
from ledgerline.operators import classify as C
from ledgerline.sources import byte_ranges as BR
from ledgerline.sources.registry_text import line_columns

TEXT_SCHEMA = "value string"


def stream_lines(spark: SparkSession, landing: str,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(TEXT_SCHEMA).option("lineSep", "\n")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.text(landing)
    return raw.select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        *line_columns(F.col("value")),
    )


def stream_valid_rows(spark: SparkSession, landing: str, sink: str, checkpoint: str,
                      max_files_per_trigger: int = 1000) -> None:
    """J1: append the valid rows of newly arrived files to ``sink``.  A large
    backlog is taken ``max_files_per_trigger`` files per micro-batch (each
    batch commits on its own, so a restart resumes after the last one)."""
    lines = stream_lines(spark, landing, max_files_per_trigger)
    rows = C.staging_projection(lines).select(
        "source_file", "identification_number", "entity_code", "situation", "loans")
    q = (rows.writeStream.format("parquet")
         .option("path", sink)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()


def stream_within_files(spark: SparkSession, path: str, sink: str, checkpoint: str,
                        batch_bytes: int, range_bytes: int = BR.RANGE_BYTES,
                        max_batches: int | None = None) -> None:
    """J1 inside a file: append the valid rows of ``path``, with their range and
    place, to ``sink``, committing after every ``batch_bytes`` of text.  A stream that
    stopped goes on at the byte its last committed batch ended at; a batch that
    was planned but not committed is done again, and the sink's own log keeps
    it from being added twice.  ``max_batches`` stops after that many.

    For few, long files that don't change while they are read; many files that
    keep arriving are ``stream_valid_rows``'s case.
    """
    lines = BR.stream_ranges(spark, path, checkpoint, batch_bytes, range_bytes, max_batches)
    rows = C.valid_records(lines, ["identification_number", "entity_code", "situation", "loans"])
    q = (rows.select("source_file", "split_start", "row_id", "identification_number",
                     "entity_code", "situation", "loans")
         .writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def newest_complete(spark: SparkSession, landing: str) -> str | None:
    """Name of the delivery folder whose ``_SUCCESS`` is the newest (ties:
    larger name).  A folder without one is still arriving."""
    done = [(fs.modified_ms(spark, f"{landing}/{name}/_SUCCESS"), name)
            for name in fs.list_names(spark, landing)
            if fs.exists(spark, f"{landing}/{name}/_SUCCESS")]
    return max(done)[1] if done else None


def import_newest(spark: SparkSession, landing: str, ws, clock=None) -> str | None:
    """Import the newest complete delivery, all its files, unless that was done
    before; returns its name if it was imported now."""
    from ledgerline.plans.import_job import run_import  # avoid an import cycle

    name = newest_complete(spark, landing)
    noted = f"{ws.root}/deliveries/{name}"
    if name is None or fs.exists(spark, noted):
        return None
    kwargs = {"clock": clock} if clock else {}
    result = run_import(spark, f"{landing}/{name}", ws, **kwargs)
    fs.write_marker(spark, noted, result.run_id)
    return name


def stream_latest_delivery(spark: SparkSession, landing: str, ws, checkpoint: str,
                           clock=None) -> None:
    """J2: arriving files trigger the import (stage, aggregate, publish, reject
    log, run log, summary) of the newest complete delivery under ``landing``,
    which replaces the published tables.

    The stream only says that something arrived; which delivery to import is
    read from the folders, so a delivery whose files come in several batches
    is imported once, whole, and older ones are not read.  The folders are
    looked at once more at the end, as a ``_SUCCESS`` alone triggers nothing.
    """
    root = landing[:-2] if landing.endswith("/*") else landing.rstrip("/")

    def handle(batch: DataFrame, epoch_id: int) -> None:
        import_newest(spark, root, ws, clock)

    q = (stream_lines(spark, f"{root}/*").select("source_file").writeStream
         .foreachBatch(handle)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    import_newest(spark, root, ws, clock)


def deliver(spark: SparkSession, source: str | DataFrame, landing_folder: str) -> None:
    """Write a delivery's lines into the landing area as a Spark job (bytes
    are kept as they are; nothing passes through the driver).  ``source`` is a
    path to copy, or lines (``value``) that aren't stored anywhere yet."""
    lines = spark.read.option("lineSep", "\n").text(source) if isinstance(source, str) else source
    lines.select("value").write.option("lineSep", "\n").text(landing_folder)

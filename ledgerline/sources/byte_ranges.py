"""Registry text by byte ranges, as a Spark data source.

``spark.read.text`` reads whole files.  This source reads stated ranges of them,
so that a load can commit, and go on, inside a file:

* batch: ``read_ranges(spark, ranges)`` reads just these ranges;
* streaming: ``stream_ranges`` has the bytes read per file as its offset and takes
  at most ``batch_bytes`` of text per micro-batch.

A file is cut at multiples of ``range_bytes``.  A line belongs to the range in
which its first byte lies, so ranges neither share nor lose lines, and the line's
place within its range (``row_id``, from 0) doesn't depend on how the job is cut
into tasks.  Every row carries the digest of its range's lines (sha256), which
tells whether staged bytes are still those of the file.

Tasks open files through Arrow's file systems (local, HDFS, S3, GCS ...); a path
that only Spark's readers can open must be read with ``read_lines``.  Files are
listed on the driver through Hadoop, names and lengths only.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader,
                                    InputPartition)

from ledgerline import fs
from ledgerline.sources.registry_text import line_columns

# executors need no installed copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "registry_ranges"
SCHEMA = "source_file string, split_start long, row_id long, range_digest string, raw binary"
#: bytes of text in one range, which a task reads and holds at once
RANGE_BYTES = 32 << 20
#: bytes read beyond a range at a time to end its last line
TAIL_BYTES = 1 << 16
#: lines in an Arrow batch
BATCH_LINES = 50_000


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end

    def __repr__(self) -> str:
        return f"Range({self.path}, {self.start}, {self.end})"


class Task(InputPartition):
    """Ranges that one task reads, one after another."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


def tasks_of(ranges: Sequence[Range], task_bytes: int) -> list[Task]:
    """Consecutive ranges packed into tasks of about so many bytes (a longer range
    is a task of its own): many short files don't start a task each."""
    packed, size = [], 0
    for r in ranges:
        length = r.end - r.start
        if not packed or size + length > task_bytes:
            packed.append([])
            size = 0
        packed[-1].append(r)
        size += length
    return [Task(some) for some in packed]


def cut(path: str, start: int, end: int, range_bytes: int) -> list[Range]:
    """[start, end) of a file, cut at multiples of ``range_bytes``."""
    edges = [start, *range(start - start % range_bytes + range_bytes, end, range_bytes), end]
    return [Range(path, a, b) for a, b in zip(edges, edges[1:]) if a < b]


def _open(path: str):
    from pyarrow import fs as arrow_fs
    scheme, colon, rest = path.partition(":")
    if not colon:
        return arrow_fs.LocalFileSystem().open_input_file(path)
    if scheme == "file":  # Hadoop writes file:/x, Arrow reads file:///x
        path = "file:///" + rest.lstrip("/")
    system, name = arrow_fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def range_text(path: str, start: int, end: int) -> bytes:
    """The bytes of the lines that start in [start, end)."""
    with _open(path) as f:
        # one byte before: a line starts at ``start`` if that is a newline
        at = max(0, start - 1)
        f.seek(at)
        text = f.read(end - at)
        if start:
            first = text.find(b"\n") + 1
            if not first or at + first >= end:
                return b""  # inside one line
            text = text[first:]
        while text and not text.endswith(b"\n"):
            more = f.read(TAIL_BYTES)
            if not more:
                break
            stop = more.find(b"\n") + 1
            text += more[:stop] if stop else more
            if stop:
                break
    return text


def read_range(part: Range | None) -> Iterator[pa.RecordBatch]:
    if part is None:  # Spark's one partition of a read without ranges
        return
    text = range_text(part.path, part.start, part.end)
    if not text:
        return
    digest = hashlib.sha256(text).hexdigest()
    data = np.frombuffer(text, np.uint8)
    is_end = data == 10
    ends = np.flatnonzero(is_end)
    if not text.endswith(b"\n"):
        ends = np.append(ends, len(data))
    bare = data[~is_end]
    # places in ``bare`` at which lines start, and its end
    edges = np.concatenate([[0], ends - np.arange(len(ends))])
    for i in range(0, len(ends), BATCH_LINES):
        some = edges[i:i + BATCH_LINES + 1]
        n = len(some) - 1
        raw = pa.Array.from_buffers(pa.binary(), n, [
            None, pa.py_buffer((some - some[0]).astype(np.int32)),
            pa.py_buffer(bare[some[0]:some[-1]])])
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(part.path), n), pa.repeat(pa.scalar(part.start, pa.int64()), n),
             pa.array(np.arange(i, i + n, dtype=np.int64)), pa.repeat(pa.scalar(digest), n), raw],
            names=["source_file", "split_start", "row_id", "range_digest", "raw"])


def read_task(task: Task | None) -> Iterator[pa.RecordBatch]:
    for part in task.ranges if task else [None]:
        yield from read_range(part)


class RangeReader(DataSourceReader):
    def __init__(self, options):
        self.ranges = json.loads(options["ranges"])
        self.task_bytes = int(options["task_bytes"])

    def partitions(self):
        return tasks_of([Range(*r) for r in self.ranges], self.task_bytes)

    def read(self, partition):
        return read_task(partition)


class RangeStreamReader(DataSourceStreamReader):
    """Offsets are the bytes taken of each file; ``latestOffset`` goes on by
    ``batch_bytes`` each time it is asked, in file order, from the offset that the
    stream had reached when it was started."""

    def __init__(self, options):
        self.files = json.loads(options["files"])  # [path, length], in order
        self.at = json.loads(options.get("reached", "{}"))
        self.batch_bytes = int(options["batch_bytes"])
        self.range_bytes = int(options["range_bytes"])
        self.batches = int(options.get("max_batches", "0")) or None

    def initialOffset(self):
        return {}

    def latestOffset(self):
        budget = self.batch_bytes if self.batches != 0 else 0
        now = dict(self.at)
        for path, length in self.files:
            done = now.get(path, 0)
            step = min(budget, length - done)
            if step > 0:
                now[path] = done + step
                budget -= step
        if now != self.at and self.batches:
            self.batches -= 1
        self.at = now
        return now

    def partitions(self, start, end):
        return [r for path, stop in end.items() if stop > start.get(path, 0)
                for r in cut(path, start.get(path, 0), stop, self.range_bytes)]

    def read(self, partition):
        return read_range(partition)


class RegistryRanges(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return RangeReader(self.options)

    def streamReader(self, schema):
        return RangeStreamReader(self.options)


def _typed(raw: DataFrame) -> DataFrame:
    return raw.select("source_file", "split_start", "row_id", "range_digest",
                      *line_columns(F.col("raw")))


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, length) of every file of an input, in name order."""
    return sorted((name, length) for name, length, _ in fs.files_below(spark, path))


def ranges_of(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> list[Range]:
    return [r for name, length in files_of(spark, path)
            for r in cut(name, 0, length, range_bytes)]


def read_ranges(spark: SparkSession, ranges: list[Range]) -> DataFrame:
    """The lines of these ranges, shaped like ``read_lines`` with their range's
    digest; nothing else of the files is read.  Short ranges share tasks, of
    ``RANGE_BYTES`` or of as many as the cores take at once."""
    spark.dataSource.register(RegistryRanges)
    cores = max(1, spark.sparkContext.defaultParallelism)
    total = sum(r.end - r.start for r in ranges)
    return _typed(
        spark.read.format(FORMAT).option("ranges", json.dumps(
            [(r.path, r.start, r.end) for r in ranges]))
        .option("task_bytes", max(1, min(RANGE_BYTES, -(-total // cores)))).load())


def stream_ranges(spark: SparkSession, path: str, checkpoint: str, batch_bytes: int,
                  range_bytes: int = RANGE_BYTES, max_batches: int | None = None) -> DataFrame:
    """Streaming lines of ``path``, at most ``batch_bytes`` per micro-batch, after
    what the stream of ``checkpoint`` had planned when it stopped."""
    spark.dataSource.register(RegistryRanges)
    return _typed(
        spark.readStream.format(FORMAT).option("files", json.dumps(files_of(spark, path)))
        .option("reached", json.dumps(reached(spark, checkpoint)))
        .option("batch_bytes", batch_bytes).option("range_bytes", range_bytes)
        .option("max_batches", max_batches or 0).load())


def reached(spark: SparkSession, checkpoint: str) -> dict[str, int]:
    """Bytes per file that the stream's last planned batch ends at: the last line
    of the newest entry of its offset log."""
    names = [n for n in fs.list_names(spark, f"{checkpoint}/offsets") if n.isdigit()]
    if not names:
        return {}
    entry = fs.read_text(spark, f"{checkpoint}/offsets/{max(names, key=int)}")
    return json.loads(entry.strip().splitlines()[-1])

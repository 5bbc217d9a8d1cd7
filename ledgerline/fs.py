"""Small file-system operations through Hadoop's FileSystem API, so that the
same code works on local disk, HDFS or an object store.  Only metadata and
tiny marker files go through the driver; table data never does."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True))


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the direct children of a folder ([] when it is missing)."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(str(s.getPath().getName()) for s in fs.listStatus(p))


def read_text(spark: SparkSession, path: str) -> str | None:
    """Content of a tiny marker file; None when it is missing."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def modified_ms(spark: SparkSession, path: str) -> int:
    """Modification time of a file or folder (0 when it is gone)."""
    fs, p = _fs(spark, path)
    return int(fs.getFileStatus(p).getModificationTime()) if fs.exists(p) else 0


def files_below(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, modification time) of every file below a path or glob;
    files of hidden names are left out, as readers do."""
    fs, p = _fs(spark, path)
    found, stack = [], list(fs.globStatus(p) or [])
    while stack:
        status = stack.pop()
        if str(status.getPath().getName()).startswith(("_", ".")):
            continue
        if status.isDirectory():
            stack.extend(fs.listStatus(status.getPath()))
        else:
            found.append((str(status.getPath()), int(status.getLen()),
                          int(status.getModificationTime())))
    return found


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Identity of a set of inputs: path, length and modification time of every
    file below them; empty when there is no file."""
    found = [f"{name}|{length}|{at}" for path in paths
             for name, length, at in files_below(spark, path)]
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest() if found else ""


def write_marker(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file; fails if it already exists (create, no overwrite)."""
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()

"""Staging in parts: a load that commits inside a file and resumes by manifest.

The input is cut into byte ranges (``byte_ranges``); consecutive ranges up to
``part_bytes`` make a part.  A part is staged as ``run=<key>/part=<n>`` with its
partial aggregates (per debtor and per entity), and is committed by its manifest:
the ranges it holds, their line counts and content digests.  A part without a
manifest does not exist: it is written again, over whatever was left.

A resume reads only ranges that no manifest has.  If the input's fingerprint
(names, lengths, times) is still the one noted, manifests are believed; if not,
the ranges they name are hashed again, parts whose bytes are unchanged are kept
and the others are dropped and loaded anew, so a replaced file never mixes with
what was staged of its predecessor.

Line numbers, rejects and checkpoints come from the staged positions as for any
staging (a range is a split).  The tables are merged from the parts' partial
aggregates: a resumed import aggregates only what it loads.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import fs
from ledgerline import layout as L
from ledgerline.operators import aggregate as A
from ledgerline.operators import staging as S
from ledgerline.sources import byte_ranges as BR

#: note of a staging that is made in parts
NOTE = "parts:"
#: bytes of text in a part
PART_BYTES = 64 << 30


@dataclass(frozen=True)
class Loaded:
    """A range as its manifest has it."""
    path: str
    start: int
    end: int
    n_lines: int
    digest: str | None  # None: no line starts in it

    @property
    def range(self) -> tuple[str, int, int]:
        return self.path, self.start, self.end


def manifest_dir(staging_root: str, slug: str) -> str:
    return f"{staging_root}/manifest-{slug}"


def partials_dir(staging_root: str, slug: str, table: str) -> str:
    return f"{staging_root}/partials-{slug}/{table}"


def _part(n: int) -> str:
    return f"part={n:06d}"


def manifests(spark: SparkSession, staging_root: str, slug: str) -> dict[int, list[Loaded]]:
    """Committed parts: one entry per range, as many as the file listing has splits."""
    folder = manifest_dir(staging_root, slug)
    return {int(name): [Loaded(*r) for r in json.loads(fs.read_text(spark, f"{folder}/{name}"))]
            for name in fs.list_names(spark, folder) if name.isdigit()}


def progress(spark: SparkSession, staging_root: str, slug: str) -> DataFrame:
    """Per file: bytes and lines committed so far, and the bytes' end."""
    rows = [(r.path, r.end - r.start, r.n_lines, r.end)
            for part in manifests(spark, staging_root, slug).values() for r in part]
    return spark.createDataFrame(
        rows, "source_file string, n_bytes long, n_lines long, end long").groupBy(
        "source_file").agg(F.sum("n_bytes").alias("bytes_loaded"),
                           F.sum("n_lines").alias("lines_loaded"), F.max("end").alias("last_byte"))


def digests(spark: SparkSession, ranges: Sequence[BR.Range]) -> dict[tuple, str]:
    """Content digest of each range that holds lines, read from the files now."""
    rows = BR.read_ranges(spark, list(ranges)).where("row_id = 0").select(
        "source_file", "split_start", "range_digest")
    return {(r[0], r[1]): r[2] for r in rows.collect()}


def _drop_part(spark: SparkSession, staging_root: str, slug: str, n: int) -> None:
    fs.delete(spark, f"{manifest_dir(staging_root, slug)}/{n:06d}")  # uncommits it first
    fs.delete(spark, f"{S.run_dir(staging_root, slug)}/{_part(n)}")
    for table in ("debtors", "entities"):
        fs.delete(spark, f"{partials_dir(staging_root, slug, table)}/{_part(n)}")


def _kept(spark: SparkSession, path: str, staging_root: str, slug: str, planned: list[BR.Range],
          print_: str) -> dict[int, list[Loaded]]:
    """Committed parts that still hold what their files hold; others are dropped."""
    note = S.made_from(spark, staging_root, slug) or ""
    if not note.startswith(f"{NOTE}{path}\n"):
        S.drop_staging(spark, staging_root, slug)
        return {}
    parts = manifests(spark, staging_root, slug)
    if note != f"{NOTE}{path}\n{print_}":
        wanted = {(r.path, r.start, r.end) for r in planned}
        held = [r for part in parts.values() for r in part if r.range in wanted]
        now = digests(spark, [BR.Range(*r.range) for r in held])
        for n, part in list(parts.items()):
            if any(r.range not in wanted or now.get((r.path, r.start)) != r.digest for r in part):
                _drop_part(spark, staging_root, slug, n)
                del parts[n]
    # a part cut short before its manifest was written
    for name in fs.list_names(spark, S.run_dir(staging_root, slug)):
        if name.startswith("part=") and int(name[5:]) not in parts:
            _drop_part(spark, staging_root, slug, int(name[5:]))
    return parts


def load(spark: SparkSession, path: str, staging_root: str, slug: str,
         part_bytes: int = PART_BYTES, range_bytes: int = BR.RANGE_BYTES,
         max_parts: int | None = None) -> list[BR.Range]:
    """Stage ``path`` in parts, after those that are committed; returns the ranges
    read now.  ``max_parts`` stops after so many (the staging stays partial)."""
    print_ = fs.fingerprint(spark, [path])
    if not print_:
        raise FileNotFoundError(f"no files at {path}")
    planned = BR.ranges_of(spark, path, range_bytes)
    parts = _kept(spark, path, staging_root, slug, planned, print_)
    S.write_input(spark, staging_root, slug, NOTE + path, print_)
    done = {r.range for part in parts.values() for r in part}
    rest = [r for r in planned if (r.path, r.start, r.end) not in done]
    read: list[BR.Range] = []
    n = max(parts, default=-1)
    while rest and (max_parts is None or max_parts > 0):
        some, size = [], 0
        while rest and (not some or size + rest[0].end - rest[0].start <= part_bytes):
            size += rest[0].end - rest[0].start
            some.append(rest.pop(0))
        n += 1
        _load_part(spark, staging_root, slug, n, some)
        read += some
        max_parts = max_parts and max_parts - 1
    success = f"{S.run_dir(staging_root, slug)}/_SUCCESS"
    if not rest and not fs.exists(spark, success):
        fs.write_marker(spark, success, "")
    return read


def _load_part(spark: SparkSession, staging_root: str, slug: str, n: int,
               ranges: list[BR.Range]) -> None:
    rows = S.staged_rows(BR.read_ranges(spark, ranges), "range_digest")
    out = f"{S.run_dir(staging_root, slug)}/{_part(n)}"
    rows.write.mode("overwrite").parquet(out)
    staged = spark.read.schema(rows.schema).parquet(out)
    valid = staged.where(F.col("kind") == L.KIND_VALID)
    for table, made in (("debtors", A.debtor_partials(valid)),
                        ("entities", A.entity_partials(valid))):
        made.write.mode("overwrite").parquet(
            f"{partials_dir(staging_root, slug, table)}/{_part(n)}")
    held = {(r[0], r[1]): (r[2], r[3]) for r in staged.groupBy("source_file", "split_start").agg(
        F.count(F.lit(1)), F.min("range_digest")).collect()}
    lines = [(r.path, r.start, r.end, *held.get((r.path, r.start), (0, None))) for r in ranges]
    fs.write_marker(spark, f"{manifest_dir(staging_root, slug)}/{n:06d}", json.dumps(lines))


def merged(spark: SparkSession, staging_root: str, slug: str) -> tuple[DataFrame, DataFrame]:
    """Debtors and entities from the committed parts' partial aggregates."""
    names = [_part(n) for n in sorted(manifests(spark, staging_root, slug))]

    def read(table: str, schema: str) -> DataFrame:
        paths = [f"{partials_dir(staging_root, slug, table)}/{n}" for n in names]
        return spark.read.schema(schema).parquet(*paths) if paths else \
            spark.createDataFrame([], schema)

    return (A.merge_debtors(read("debtors", A.DEBTOR_PARTIAL)),
            A.merge_entities(read("entities", A.ENTITY_PARTIAL)))

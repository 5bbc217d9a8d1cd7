"""Fixed-width registry text: reading, line numbering and writing.

Reading is a plain distributed text scan.  The text source does not decode
content: each line is kept as raw bytes (``raw``) and decoded as Latin-1
only where text is needed (``line``, output fields).
Line numbers restart per file and are computed without a global window:
each input split reports ``(first row id, line count)``, a prefix sum over
the (small) split table gives the lines before each split, and a join puts
the offset back on every row.  The text is never stored for it: it is scanned
once for the split table and once for the rows, over the same splits, because
``read_lines`` pins the split layout of what it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline import layout as L

# The split table is broadcast up to this many bytes (paths and numbers);
# beyond it the numbering join shuffles instead.
MAX_BROADCAST_BYTES = 32 << 20

POSITION_COLUMNS = ["source_file", "split_start", "row_id"]


def line_columns(value: Column) -> list[Column]:
    """``raw`` (the line's bytes), ``n_chars`` (its length without a trailing
    CR — in Latin-1 one byte is one character) and ``line`` (decoded, CR
    dropped).  Classification and field slicing work on ``raw`` with byte
    positions, so the whole-line decode runs only when ``line`` is used."""
    raw = value.cast("binary")
    has_cr = F.endswith(raw, F.lit(bytearray(b"\r")))
    n_chars = (F.octet_length(raw) - has_cr.cast("int")).alias("n_chars")
    line = F.decode(raw, "ISO-8859-1")
    line = F.when(has_cr, line.substr(F.lit(1), F.octet_length(raw) - 1)).otherwise(line)
    return [raw.alias("raw"), n_chars, line.alias("line")]


# Settings that decide how files are cut into splits and packed into tasks.
_LAYOUT = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
_MIN_TASKS = "spark.sql.files.minPartitionNum"
_MAX_TASKS = "spark.sql.files.maxPartitionNum"
#: tasks at most into which splits of a stated size are packed (or as many as are
#: aimed at): each task reports to the driver, each split needs none of its own
SPLIT_TASKS = 1000
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: tasks at most that list the folders of a path together (Spark's own bound is
#: 10,000, mostly one per folder, each started and reported through the driver)
LISTING_TASKS = 64
_pinned: dict[tuple, SparkSession] = {}


def pinned_session(spark: SparkSession, split_bytes: int | None = None) -> SparkSession:
    """A session of the same application whose split layout doesn't change.

    Spark plans a scan with the settings of the session that made the relation,
    and sizes small inputs by the cores present when a job is planned.  Here the
    settings are copied and the number of tasks aimed at is fixed, so every job
    over one relation cuts and packs its files alike.  Folders are listed by
    ``LISTING_TASKS`` tasks at most.
    """
    values = [str(split_bytes)] if split_bytes else [spark.conf.get(_LAYOUT[0])]
    values += [spark.conf.get(_LAYOUT[1]),
               spark.conf.get(_MIN_TASKS, None) or str(spark.sparkContext.defaultParallelism),
               str(min(LISTING_TASKS, int(spark.conf.get(_LISTING))))]
    names = [*_LAYOUT, _MIN_TASKS, _LISTING]
    if split_bytes:
        names.append(_MAX_TASKS)
        values.append(str(max(SPLIT_TASKS, int(values[2]))))
    key = (spark.sparkContext.applicationId, *values)
    if key not in _pinned:
        session = spark.newSession()
        for name, value in zip(names, values):
            session.conf.set(name, value)
        _pinned[key] = session
    return _pinned[key]


def read_lines(spark: SparkSession, path: str | list[str],
               split_bytes: int | None = None) -> DataFrame:
    """One row per physical line: ``source_file, split_start, row_id, raw,
    n_chars, line``.

    ``path`` is anything ``spark.read.text`` takes (a file, a folder, a glob,
    on any Hadoop file system).  Lines split on ``\\n`` only; a lone ``\\r``
    stays inside a line.  The split layout is pinned (``split_bytes`` at most, by
    default the session's), so ``split_start`` and ``row_id`` of a line are the
    same in every job over the result.
    """
    paths = [path] if isinstance(path, str) else list(path)
    raw = pinned_session(spark, split_bytes).read.option("lineSep", "\n").text(paths)
    rows = raw.select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("row_id"),
        *line_columns(F.col("value")),
    )
    # back into the caller's session: the optimizer drops the side without rows
    none = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name)
                                   for f in rows.schema]).where(F.lit(False))
    return none.union(rows)


def split_offsets(lines: DataFrame, *more) -> DataFrame:
    """Per input split: the first row id, the number of lines and the number of
    lines before it in its file, and ``more`` aggregates.  One row per split, so
    its size is bounded by the file listing, not by the data."""
    stats = lines.groupBy("source_file", "split_start").agg(
        F.min("row_id").alias("first_row_id"),
        F.count(F.lit(1)).alias("n_lines"),
        *more,
    )
    before = Window.partitionBy("source_file").orderBy("split_start").rowsBetween(
        Window.unboundedPreceding, -1)
    return stats.withColumn(
        "lines_before", F.coalesce(F.sum("n_lines").over(before), F.lit(0)))


def with_line_numbers(lines: DataFrame, rows: DataFrame | None = None, *,
                      splits: DataFrame | None = None,
                      max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Add ``line_number`` (1-based, per file, counting every physical line).

    ``lines`` holds every line of its files with the position columns of
    ``read_lines``.  ``rows`` (optional) are the rows to number, taken from
    an already materialized copy of ``lines``, such as the rejects of a
    staging; ``splits`` its split table where the caller has it.

    Without ``rows`` the lines themselves are numbered, in two scans: one counts
    lines per split, which reads the text but keeps only the split table, the
    other numbers the rows.  Both see the splits that ``read_lines`` pinned.
    Every row's place is checked against its split's range, so a row of another
    layout is an error, never a wrong number.

    The split table is materialized once and measured; it is broadcast only
    when its bytes are within the bound.
    """
    if splits is None:
        splits = split_offsets(lines.select(*POSITION_COLUMNS)).checkpoint(eager=True)
    offsets = splits.select("source_file", "split_start", "first_row_id", "n_lines",
                            "lines_before")
    size = offsets.agg(F.sum(F.length("source_file") + F.lit(96))).first()[0] or 0
    side = F.broadcast(offsets) if size <= max_broadcast_bytes else offsets
    target = lines if rows is None else rows
    joined = target.join(side, ["source_file", "split_start"], "left")
    place = F.col("row_id") - F.col("first_row_id")
    fits = F.coalesce((place >= 0) & (place < F.col("n_lines")), F.lit(False))
    return joined.withColumn(
        "line_number",
        F.when(fits, F.col("lines_before") + place + F.lit(1)).otherwise(
            F.raise_error("rows of another scan can't be numbered").cast("long")),
    ).drop("first_row_id", "lines_before", "n_lines")


# ---------------------------------------------------------------------------
# Writer
# ---------------------------------------------------------------------------

def amount_digits(x: Column) -> Column:
    return F.abs(x).cast(L.MONEY).cast("string")              # e.g. 1500.50


def amount_body(digits: Column) -> Column:
    """Decimal comma, and one decimal when that is exact."""
    short = F.when(digits.endswith("0"), F.substring(digits, F.lit(1), F.length(digits) - 1)
                   ).otherwise(digits)
    return F.translate(short, ".", ",")


def amount_text(x: Column, body: Column) -> Column:
    return F.when(x < 0, F.concat(F.lit("-"), fitted(F.lpad, body, 11, "0", "amount"))).otherwise(
        fitted(F.lpad, body, 12, "0", "amount"))


def format_amount(x: Column) -> Column:
    """decimal(18,2) → 12-character registry amount with a decimal comma:
    one decimal when that is exact, else two; zero-padded after the sign."""
    return amount_text(x, amount_body(amount_digits(x)))


def fitted(pad, value: Column, length: int, fill: str, name: str) -> Column:
    """``value`` padded to ``length``; a longer value is an error, never cut."""
    problem = F.raise_error(F.concat(F.lit(f"{name}: value does not fit {length} characters: "),
                                     value))
    return F.when(F.length(value) <= length, pad(value, length, fill)).otherwise(
        problem.cast("string"))


def render_line(amounts: Column | None = None) -> Column:
    """Fixed-width line (171 characters) from the typed record columns;
    ``amounts`` are the texts of the amount fields where they were made before."""
    parts = []
    for name, _, length, kind in L.FIELDS:
        c = F.col(name)
        if kind == "amount":
            parts.append(format_amount(c) if amounts is None
                         else F.get(amounts, L.AMOUNT_FIELDS.index(name)))
        elif kind == "int":
            parts.append(fitted(F.lpad, c.cast("string"), length, "0", name))
        else:
            parts.append(fitted(F.rpad, F.coalesce(c, F.lit("")), length, " ", name))
    return F.concat(*parts)


#: lines of a compressed file at most (90 MB of text), as one task reads it whole
COMPRESSED_FILE_LINES = 1 << 19


def write_fixed_width(records: DataFrame, path: str, mode: str = "error",
                      compressed: bool = False) -> None:
    """Write typed records as Latin-1 fixed-width lines (one per record).

    ``compressed`` files are gzip at its fastest level, about a quarter of the text;
    ``read_lines`` knows them by their suffix.

    The amounts are formatted as arrays, a step of ``format_amount`` at a time, so
    that each step runs once per amount: written out field by field they make a
    generated method that the JVM never compiles (as parsing would, see
    ``classify.parse_fields``)."""
    amounts = F.array(*L.AMOUNT_FIELDS)
    texts = F.zip_with(amounts, F.transform(F.transform(amounts, amount_digits), amount_body),
                       amount_text)
    out = records.withColumn("_amounts", texts).select(
        F.encode(render_line(F.col("_amounts")), "ISO-8859-1").cast("string").alias("value"))
    writer = out.write.mode(mode).option("lineSep", "\n")
    if compressed:
        writer = (writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
                  .option("maxRecordsPerFile", COMPRESSED_FILE_LINES))
    writer.text(path)

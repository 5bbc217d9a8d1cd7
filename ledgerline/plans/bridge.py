"""Bridge from the driver's tables to registry files.

The test data has no registry file, so one is rendered from
``lineitem ⋈ orders``: one fixed-width line per lineitem row, split into
two deliveries (by ``l_linestatus``) and, within each, into files of at
most ``FILE_ORDERS`` orders, so the file count grows with the data while
every file stays bounded.  Each file starts with a ``#`` comment; some
lines are followed by a blank line, some end in CRLF, some are cut short,
some carry a Latin-1 ``Ñ``, a foreign identification type or a bad
situation, and the amounts use every spelling the registry uses.

The rendering SQL below is plain SQL accepted by both Spark and DuckDB.
Spark runs it to write the files; the DuckDB oracle runs the same text
and reads the expected typed values (``e_*``) straight from the table
columns, so it never parses the rendered text and checks the parser too.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline import fs
from ledgerline.session import work_root

RENDER_VERSION = "r2"
FILE_ORDERS = 4096  # orders per rendered file

# Rendered raw text of each field (r_*), the file it goes to, and the value
# the parser must produce for it (e_*).
_JOIN_SQL = """
j AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_returnflag,
         l_linestatus, l_shipdate, o_custkey,
         CAST(floor(l_quantity) AS BIGINT) AS q,
         CAST(floor(l_extendedprice) AS BIGINT) AS p,
         CAST(floor(o_totalprice) AS BIGINT) AS tp,
         l_linestatus AS delivery,
         CAST(floor(l_orderkey / {file_orders}) AS BIGINT) AS file_no
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
)"""
_LINES_SQL = """
f AS (
  SELECT *,
    lpad(CAST(l_suppkey % 100000 AS STRING), 5, '0') AS r_entity,
    lpad(CAST(year(l_shipdate) * 100 + month(l_shipdate) AS STRING), 6, '0') AS r_date,
    CASE WHEN l_returnflag = 'A' AND l_linenumber = 7 THEN '96'
         WHEN l_returnflag = 'R' AND l_linenumber = 6 THEN '80'
         ELSE '11' END AS r_idtype,
    CASE WHEN o_custkey % 50 = 7 THEN rpad(CAST(o_custkey AS STRING), 11, ' ')
         WHEN o_custkey % 50 = 8 THEN lpad(CAST(o_custkey AS STRING), 11, ' ')
         ELSE CAST(20000000000 + o_custkey AS STRING) END AS r_id,
    CASE WHEN l_partkey % 13 = 0 THEN 'Ñ' || lpad(CAST(l_partkey % 100 AS STRING), 2, '0')
         ELSE lpad(CAST(l_partkey % 1000 AS STRING), 3, '0') END AS r_activity,
    CASE (l_orderkey + l_linenumber) % (2 + o_custkey % 12)
         WHEN 0 THEN '01' WHEN 1 THEN '1 ' WHEN 2 THEN '11' WHEN 3 THEN '21' WHEN 4 THEN '2 '
         WHEN 5 THEN '23' WHEN 6 THEN '03' WHEN 7 THEN '3 ' WHEN 8 THEN '04' WHEN 9 THEN '4 '
         WHEN 10 THEN '05' WHEN 11 THEN '99' ELSE '  ' END AS r_situation,
    lpad(CAST(p AS STRING), 10, '0') || ',' || CAST(q % 10 AS STRING) AS r_loans,
    lpad(CAST(q * 100 AS STRING), 12, '0') AS r_unused,
    lpad(CAST(o_custkey % 1000 AS STRING), 11, '0') || ',' AS r_guarantees,
    CASE WHEN l_linenumber = 1 THEN rpad(CAST(q AS STRING) || ',5', 12, ' ')
         ELSE '000000000000' END AS r_other,
    rpad(',' || CAST(l_linenumber AS STRING), 12, ' ') AS r_pga,
    '            ' AS r_pgb,
    lpad(CAST(l_partkey % 1000 AS STRING) || 'abc', 12, '0') AS r_npg,
    CASE WHEN l_orderkey % 7 = 0 THEN '00000000,125'
         WHEN l_orderkey % 7 = 1 THEN '00000000,135'
         ELSE '000000000000' END AS r_cga,
    CASE WHEN l_linenumber = 3 AND l_orderkey % 31 = 0 THEN '9999999999e9'
         WHEN l_linenumber = 2 THEN rpad(CAST(l_linenumber AS STRING) || 'e3', 12, ' ')
         ELSE '000000000000' END AS r_cgb,
    lpad(CAST(tp AS STRING), 10, '0') || ',' || CAST(l_linenumber AS STRING) AS r_ncg,
    CASE WHEN l_discount >= 0.05 THEN '-' || lpad(CAST(q AS STRING), 11, '0')
         ELSE '00 ' || lpad(CAST(q AS STRING), 9, '0') END AS r_prov,
    CAST(l_linenumber % 2 AS STRING) AS r_f1,
    CAST(o_custkey % 3 AS STRING) AS r_f2,
    CASE l_returnflag WHEN 'R' THEN '1' WHEN 'N' THEN '0' ELSE '9' END AS r_f3,
    CAST(l_orderkey % 2 AS STRING) AS r_f4,
    CASE l_linestatus WHEN 'O' THEN '0' ELSE '9' END AS r_f5,
    CAST(l_partkey % 2 AS STRING) AS r_f6,
    CASE WHEN l_linenumber = 4 THEN lpad(CAST(q AS STRING), 4, ' ')
         WHEN l_linenumber = 5 THEN rpad(CAST(q AS STRING), 4, 'x')
         ELSE lpad(CAST(q * 7 AS STRING), 4, '0') END AS r_days,
    l_orderkey % 97 = 0 AS is_short,
    l_orderkey % 89 = 0 AS is_crlf,
    l_orderkey % 53 = 0 AND l_linenumber = 1 AS blank_after
  FROM {joined}
),
d AS (
  SELECT *,
    CASE WHEN is_short THEN substr(full_line, 1, 170) ELSE full_line END AS text,
    CASE trim(r_situation) WHEN '1' THEN '01' WHEN '2' THEN '21' WHEN '3' THEN '03'
         WHEN '4' THEN '04' WHEN '5' THEN '05' ELSE trim(r_situation) END AS e_situation
  FROM (
    SELECT *,
      r_entity || r_date || r_idtype || r_id || r_activity || r_situation || r_loans
        || r_unused || r_guarantees || r_other || r_pga || r_pgb || r_npg || r_cga
        || r_cgb || r_ncg || r_prov || r_f1 || r_f2 || r_f3 || r_f4 || r_f5 || r_f6
        || r_days AS full_line
    FROM f
  ) x
),
data AS (
  SELECT *,
    CASE WHEN is_short THEN 'short_line'
         WHEN r_idtype <> '11' THEN 'id_type'
         WHEN e_situation NOT IN ('01', '11', '21', '23', '03', '04', '05') THEN 'situation'
         WHEN r_cgb = '9999999999e9' THEN 'parse_error'
         ELSE 'valid' END AS e_kind,
    CASE e_situation WHEN '01' THEN 0 WHEN '11' THEN 1 WHEN '21' THEN 2 WHEN '23' THEN 3
         WHEN '03' THEN 4 WHEN '04' THEN 5 WHEN '05' THEN 6 END AS e_rank,
    trim(r_id) AS e_id,
    CAST(CAST(p AS STRING) || '.' || CAST(q % 10 AS STRING) AS DECIMAL(18,2)) AS e_loans,
    CAST(q * 100 AS DECIMAL(18,2)) AS e_unused,
    CAST(o_custkey % 1000 AS DECIMAL(18,2)) AS e_guarantees,
    CASE WHEN l_linenumber = 1 THEN CAST(CAST(q AS STRING) || '.5' AS DECIMAL(18,2))
         ELSE CAST(0 AS DECIMAL(18,2)) END AS e_other,
    CAST('0.' || CAST(l_linenumber AS STRING) AS DECIMAL(18,2)) AS e_pga,
    CAST(0 AS DECIMAL(18,2)) AS e_pgb,
    CAST(l_partkey % 1000 AS DECIMAL(18,2)) AS e_npg,
    CASE WHEN l_orderkey % 7 = 0 THEN CAST('0.13' AS DECIMAL(18,2))
         WHEN l_orderkey % 7 = 1 THEN CAST('0.14' AS DECIMAL(18,2))
         ELSE CAST(0 AS DECIMAL(18,2)) END AS e_cga,
    CASE WHEN r_cgb = '9999999999e9' THEN CAST(NULL AS DECIMAL(18,2))
         WHEN l_linenumber = 2 THEN CAST(l_linenumber * 1000 AS DECIMAL(18,2))
         ELSE CAST(0 AS DECIMAL(18,2)) END AS e_cgb,
    CAST(CAST(tp AS STRING) || '.' || CAST(l_linenumber AS STRING) AS DECIMAL(18,2)) AS e_ncg,
    CASE WHEN l_discount >= 0.05 THEN CAST(-q AS DECIMAL(18,2))
         ELSE CAST(q AS DECIMAL(18,2)) END AS e_prov,
    CASE WHEN l_linenumber IN (4, 5) THEN CAST(q AS INT) ELSE CAST(q * 7 AS INT) END AS e_days
  FROM d
)"""
_ALL_LINES_SQL = """
all_lines AS (
  SELECT delivery, file_no, l_orderkey AS k1, l_linenumber AS k2, text AS sort_text,
         0 AS sub, text, is_crlf
  FROM data
  UNION ALL
  SELECT delivery, file_no, l_orderkey, l_linenumber, text, 1, '', false
  FROM data WHERE blank_after
  UNION ALL
  SELECT DISTINCT delivery, file_no, -1, 0, '', 0,
         '# registry extract ' || delivery || ' ' || lpad(CAST(file_no AS STRING), 5, '0'),
         false
  FROM data
)"""


def data_ctes(lineitem: str = "lineitem", orders: str = "orders") -> str:
    """``WITH`` body defining ``data`` (one row per data line, raw ``r_*`` and
    expected ``e_*`` columns) and ``all_lines`` (data, blank and comment
    lines with their file and sort key)."""
    return ",".join([
        _JOIN_SQL.format(lineitem=lineitem, orders=orders, file_orders=FILE_ORDERS),
        _LINES_SQL.format(joined="j"), _ALL_LINES_SQL])


# Line number of each physical line within its file, for oracles.
NUMBERED_SQL = """
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY delivery, file_no
                               ORDER BY k1, k2, sort_text, sub) AS line_number
  FROM all_lines
)"""


def oracle_prefix() -> str:
    """``WITH`` clause for DuckDB oracles over the pre-registered views."""
    return "WITH " + data_ctes() + "," + NUMBERED_SQL + "\n"


# Rows dealt by a part of a join's keys stay where they are.
_DEAL_ONCE = {"spark.sql.requireAllClusterKeysForCoPartition": "false",
              "spark.sql.requireAllClusterKeysForDistribution": "false"}
# A rendering's shuffled rows leave the disk with its write, not when the driver's
# garbage is next collected.
_CLEAN_UP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: shuffled bytes that one task renders at most where Spark merges partitions; the
#: text it sorts and writes is about four times that
RENDER_TASK_BYTES = 16 << 20
_sessions: dict[tuple, SparkSession] = {}


def _bytes(size: str) -> int:
    """A size setting (``64MB``, ``16m``, ``16384b``) in bytes."""
    number, unit = re.fullmatch(r"([0-9]+) *([kmgtp]?)(?:b|ib)?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def rendering_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the caller's SQL settings, in which
    a join on file number and order key keeps rows that are dealt by file,
    partitions are merged by the text they become, not by what is shuffled, and
    shuffle files go when the write that read them ends."""
    values = {r["key"]: r["value"] for r in spark.sql("SET").collect()
              if r["key"].startswith("spark.sql.") and spark.conf.isModifiable(r["key"])}
    values.update(_DEAL_ONCE | _CLEAN_UP)
    values[_TASK_BYTES] = f"{min(RENDER_TASK_BYTES, _bytes(spark.conf.get(_TASK_BYTES)))}b"
    key = (spark.sparkContext.applicationId, *sorted(values.items()))
    if key not in _sessions:
        session = spark.newSession()
        for name, value in values.items():
            session.conf.set(name, value)
        _sessions[key] = session
    return _sessions[key]


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    od = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return li, od


def joined_rows(spark: SparkSession, sf_dir: str, delivery: str | None = None) -> DataFrame:
    """``j`` of the rendering SQL, its rows dealt by file: both tables are shuffled
    once, as the few typed columns the text is made of, to the task that writes
    their file.  A file's orders lie together, so the join on the order key is
    within the file number and moves nothing more; it is never broadcast, as
    that would leave the lines where they were read."""
    li, od = _tables(rendering_session(spark), sf_dir)
    if delivery is not None:
        li = li.where(F.col("l_linestatus") == delivery)

    def by_file(df: DataFrame, key: str, name: str) -> DataFrame:
        file_no = F.floor(F.col(key) / FILE_ORDERS).cast("long")
        return df.where(F.col(key).isNotNull()).withColumn(name, file_no).repartition(name)

    lines = by_file(li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_returnflag",
        "l_linestatus", "l_shipdate",
        F.floor("l_quantity").cast("long").alias("q"),
        F.floor("l_extendedprice").cast("long").alias("p")), "l_orderkey", "file_no")
    orders = by_file(od.select(
        "o_orderkey", "o_custkey", F.floor("o_totalprice").cast("long").alias("tp")),
        "o_orderkey", "o_file_no")
    return lines.join(orders.hint("merge"), (F.col("file_no") == F.col("o_file_no"))
                      & (F.col("l_orderkey") == F.col("o_orderkey"))).drop(
        "o_orderkey", "o_file_no").withColumn("delivery", F.col("l_linestatus"))


def rendered_lines(spark: SparkSession, sf_dir: str, delivery: str | None = None) -> DataFrame:
    """The text to write of every file (of one delivery): ``delivery, file_no,
    value``, in the order of its lines.  A value is a data or a blank line; the
    file's first one begins with its comment line.  Each file is in one task."""
    sql = f"WITH {_LINES_SQL.format(joined='{joined}')}\nSELECT * FROM data"
    joined = joined_rows(spark, sf_dir, delivery)
    data = joined.sparkSession.sql(sql, joined=joined)
    lines = data.select(
        "delivery", "file_no", F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"),
        F.col("text").alias("sort_text"), "is_crlf",
        F.explode(F.when(F.col("blank_after"), F.array(F.lit(0), F.lit(1)))
                  .otherwise(F.array(F.lit(0)))).alias("sub"))
    at = F.row_number().over(Window.partitionBy("delivery", "file_no").orderBy(
        "k1", "k2", "sort_text", "sub"))
    comment = F.concat(F.lit("# registry extract "), F.col("delivery"), F.lit(" "),
                       F.lpad(F.col("file_no").cast("string"), 5, "0"))
    line = F.when(F.col("sub") == 1, F.lit("")).otherwise(F.concat(
        F.col("sort_text"), F.when(F.col("is_crlf"), F.lit("\r")).otherwise(F.lit(""))))
    # a line without text (a field of it is null) is written as a blank one
    value = F.when(at == 1, F.concat(F.coalesce(comment, F.lit("")), F.lit("\n"),
                                     F.coalesce(line, F.lit("")))).otherwise(line)
    return lines.select("delivery", "file_no",
                        F.encode(value, "ISO-8859-1").cast("string").alias("value"))


def render(spark: SparkSession, sf_dir: str, out: str) -> None:
    """Write the registry files: ``out/delivery=X/file_no=N/part-*.txt``.

    Each file is written by exactly one task (hash partitioning on the file
    number), sorted by the file's line order, encoded as Latin-1 bytes.
    """
    (rendered_lines(spark, sf_dir).write.mode("overwrite").option("lineSep", "\n")
     .partitionBy("delivery", "file_no").text(out))


def registry_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the rendered registry for ``sf_dir`` (rendered once and
    reused; lives in the shared work folder)."""
    inputs = fs.fingerprint(spark, [f"{sf_dir}/lineitem.parquet", f"{sf_dir}/orders.parquet"])
    key = hashlib.sha1(f"{RENDER_VERSION}|{inputs}|{FILE_ORDERS}".encode()).hexdigest()[:12]
    out = f"{work_root(spark)}/rendered/{key}/registry"
    if not fs.exists(spark, out + "/_SUCCESS"):
        render(spark, sf_dir, out)
    return out


def delivery_path(root: str, delivery: str) -> str:
    return f"{root}/delivery={delivery}"

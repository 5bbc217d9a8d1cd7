"""DuckDB oracle SQL for each registered query.

The oracles read the pre-registered views (``lineitem``, ``orders``,
``events``) and take expected values from the bridge's ``e_*`` columns,
which come straight from table columns; they never parse rendered text.
"""

from __future__ import annotations

from ledgerline.plans import bridge
from ledgerline.plans import driver_queries as D

_RANK_TO_CODE = ("CASE {r} WHEN 0 THEN '01' WHEN 1 THEN '11' WHEN 2 THEN '21' WHEN 3 THEN '23' "
                 "WHEN 4 THEN '03' WHEN 5 THEN '04' WHEN 6 THEN '05' END")
_CODE_TO_RANK = ("CASE {c} WHEN '01' THEN 0 WHEN '11' THEN 1 WHEN '21' THEN 2 WHEN '23' THEN 3 "
                 "WHEN '03' THEN 4 WHEN '04' THEN 5 WHEN '05' THEN 6 END")

_EXTRA_CTES = """,
dnum AS (
  SELECT *, CAST(1
    + row_number() OVER (PARTITION BY delivery, file_no ORDER BY l_orderkey, l_linenumber, text)
    + sum(CASE WHEN blank_after THEN 1 ELSE 0 END)
        OVER (PARTITION BY delivery, file_no ORDER BY l_orderkey, l_linenumber, text)
    - sum(CASE WHEN blank_after THEN 1 ELSE 0 END)
        OVER (PARTITION BY delivery, file_no, l_orderkey, l_linenumber, text)
    AS BIGINT) AS line_number
  FROM data
),
valid AS (SELECT * FROM data WHERE e_kind = 'valid'),
odebtors AS (
  SELECT e_id AS identification_number, """ + _RANK_TO_CODE.format(r="max(e_rank)") + """ AS max_situation,
         CAST(sum(e_loans) AS DECIMAL(18,2)) AS total_loan_amount
  FROM valid GROUP BY e_id
),
oentities AS (
  SELECT r_entity AS entity_code, CAST(sum(e_loans) AS DECIMAL(18,2)) AS total_loan_amount
  FROM valid GROUP BY r_entity
),
odebtors_o AS (
  SELECT e_id AS identification_number, """ + _RANK_TO_CODE.format(r="max(e_rank)") + """ AS max_situation,
         CAST(sum(e_loans) AS DECIMAL(18,2)) AS total_loan_amount
  FROM valid WHERE delivery = 'O' GROUP BY e_id
)
"""


def _with(body: str) -> str:
    return bridge.oracle_prefix().rstrip() + _EXTRA_CTES + body


_RECORD_SELECT = """
  r_entity AS entity_code, r_date AS info_date, r_idtype AS identification_type,
  e_id AS identification_number, r_activity AS activity, e_situation AS situation,
  e_loans AS loans, e_unused AS unused, e_guarantees AS guarantees, e_other AS other_concepts,
  e_pga AS preferred_guarantees_a, e_pgb AS preferred_guarantees_b,
  e_npg AS no_preferred_guarantees, e_cga AS counter_guarantees_a,
  e_cgb AS counter_guarantees_b, e_ncg AS no_counter_guarantees, e_prov AS provisions,
  r_f1 AS debt_covered, r_f2 AS judicial_process, r_f3 AS refinancing,
  r_f4 AS mandatory_recat, r_f5 AS legal_situation, r_f6 AS technical_irrecoverable,
  e_days AS days_overdue"""

_AMOUNT_PAIRS = [
    ("loans", "r_loans", "e_loans"), ("unused", "r_unused", "e_unused"),
    ("guarantees", "r_guarantees", "e_guarantees"), ("other_concepts", "r_other", "e_other"),
    ("preferred_guarantees_a", "r_pga", "e_pga"), ("preferred_guarantees_b", "r_pgb", "e_pgb"),
    ("no_preferred_guarantees", "r_npg", "e_npg"), ("counter_guarantees_a", "r_cga", "e_cga"),
    ("counter_guarantees_b", "r_cgb", "e_cgb"), ("no_counter_guarantees", "r_ncg", "e_ncg"),
    ("provisions", "r_prov", "e_prov"),
]

_RUN_EVENTS = """
WITH ev AS (
  SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') || '-'
           || lpad(CAST(user_id % 10000 AS VARCHAR), 4, '0') || '-4000-8000-'
           || lpad(CAST(user_id * 7919 AS VARCHAR), 12, '0') AS run_id,
         event_id AS seq, ts AS event_at,
         CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'processing'
              WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed'
              WHEN 'error' THEN 'failed' END AS status,
         CASE WHEN event_type = 'error' THEN props END AS error_message
  FROM events
),
s AS (
  SELECT run_id, status,
         row_number() OVER (PARTITION BY run_id ORDER BY event_at DESC, seq DESC) AS rn
  FROM ev WHERE status IS NOT NULL
),
e AS (
  SELECT run_id, error_message,
         row_number() OVER (PARTITION BY run_id ORDER BY event_at DESC, seq DESC) AS rn
  FROM ev WHERE error_message IS NOT NULL
),
g AS (
  SELECT run_id, count(*) AS n_events, min(event_at) AS created_at, max(event_at) AS updated_at
  FROM ev GROUP BY run_id
),
st AS (
  SELECT g.run_id, s.status, e.error_message, g.n_events, g.created_at, g.updated_at
  FROM g LEFT JOIN s ON s.run_id = g.run_id AND s.rn = 1
         LEFT JOIN e ON e.run_id = g.run_id AND e.rn = 1
)
"""

_REJECTS = """
SELECT line_number, e_kind AS reason,
       CASE e_kind WHEN 'short_line' THEN CAST(length(text) AS VARCHAR)
                   WHEN 'id_type' THEN r_idtype WHEN 'parse_error' THEN r_cgb
                   ELSE e_situation END AS detail
FROM dnum WHERE e_kind <> 'valid'"""

_TS = "'%Y-%m-%d %H:%M:%S.%f'"


def oracle_sql() -> dict[str, str]:
    clock = D.SUMMARY_CLOCK.strftime('%Y-%m-%dT%H:%M:%SZ')
    staged_cols = ("e_id AS identification_number, r_entity AS entity_code, "
                   "e_situation AS situation, e_loans AS loans")
    amount_union = "\n  UNION ALL ".join(
        f"SELECT '{f}' AS field, {r} AS raw, {e} AS amount FROM data" for f, r, e in _AMOUNT_PAIRS)
    rank_v = _CODE_TO_RANK.format(c="v.e_situation")
    rank_d = _CODE_TO_RANK.format(c="d.max_situation")
    top_order = "total_loan_amount DESC, identification_number"
    return {
        "debtors": _with("SELECT identification_number, max_situation, total_loan_amount "
                         "FROM odebtors"),
        "entities": _with("SELECT entity_code, total_loan_amount FROM oentities"),
        "key_uniqueness": _with("""
SELECT 'debtors' AS table_name, count(*) AS n_keys, count(*) FILTER (WHERE n > 1) AS n_duplicate_keys
FROM (SELECT identification_number, count(*) AS n FROM odebtors GROUP BY 1) t
UNION ALL
SELECT 'entities', count(*), count(*) FILTER (WHERE n > 1)
FROM (SELECT entity_code, count(*) AS n FROM oentities GROUP BY 1) t"""),
        "parse_records": _with(f"SELECT {_RECORD_SELECT}, line_number FROM dnum "
                               "WHERE e_kind = 'valid'"),
        "decode_latin1": _with("SELECT r_activity AS activity, CAST(length(text) AS BIGINT) "
                               "AS n_chars, count(*) AS n_lines FROM data GROUP BY 1, 2"),
        "line_numbers": _with("SELECT CAST(line_number AS BIGINT) AS line_number, text AS line "
                              "FROM numbered"),
        # a line is in the split that holds the byte before its first one
        "split_numbers": _with(f"""
SELECT CAST(greatest(byte_at - 1, 0) // {D.SPLIT_BYTES} * {D.SPLIT_BYTES} AS BIGINT) AS split_start,
       CAST(line_number AS BIGINT) AS line_number, text AS line
FROM (SELECT line_number, text,
             coalesce(sum(length(text) + 1 + CASE WHEN is_crlf THEN 1 ELSE 0 END)
               OVER (PARTITION BY delivery, file_no ORDER BY line_number
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS byte_at
      FROM numbered) t"""),
        "skip_blank_comment": _with("""
SELECT count(*) AS n_lines,
       count(*) FILTER (WHERE sub = 1) AS n_blank,
       count(*) FILTER (WHERE k1 = -1) AS n_comment,
       count(*) FILTER (WHERE sub = 0 AND k1 >= 0) AS n_data,
       (SELECT count(*) FROM data WHERE e_kind = 'valid') AS n_valid,
       (SELECT count(*) FROM data WHERE e_kind <> 'valid') AS n_rejected
FROM numbered"""),
        "normalize_situation": _with("SELECT r_situation AS raw_situation, e_situation AS "
                                     "situation, count(*) AS n_lines FROM data GROUP BY 1, 2"),
        "parse_amount": _with(f"""
SELECT field, raw, amount, count(*) AS n_lines FROM (
  {amount_union}
) t GROUP BY 1, 2, 3"""),
        "days_overdue": _with("SELECT r_days AS raw_days, e_days AS days_overdue, "
                              "count(*) AS n_lines FROM data WHERE NOT is_short GROUP BY 1, 2"),
        "reject_reasons": _with("SELECT e_kind AS reason, count(*) AS n_lines FROM data "
                                "WHERE e_kind <> 'valid' GROUP BY 1"),
        "reject_rows": _with(_REJECTS),
        "staged_rejects": _with(_REJECTS),
        "import_in_parts": _with("SELECT * FROM odebtors"),
        "parts_changed_file": _with("SELECT * FROM odebtors_o"),
        "stream_within_file": _with(f"SELECT {staged_cols} FROM valid"),
        "staging_rows": _with(f"SELECT {staged_cols}, line_number FROM dnum "
                              "WHERE e_kind = 'valid'"),
        "resume_append": _with(f"SELECT {staged_cols}, line_number FROM dnum "
                               "WHERE e_kind = 'valid'"),
        "debtor_by_cuit": _with(f"SELECT * FROM odebtors WHERE identification_number = "
                                f"'{D.LOOKUP_CUIT}'"),
        "entity_by_code": _with(f"SELECT * FROM oentities WHERE entity_code = "
                                f"'{D.LOOKUP_ENTITY}'"),
        "top_debtors": _with(f"""
SELECT identification_number, max_situation, total_loan_amount,
       CAST(row_number() OVER (ORDER BY {top_order}) AS BIGINT) AS position
FROM odebtors ORDER BY {top_order} LIMIT {D.TOP_N}"""),
        "top_debtors_meta": _with(f"""
SELECT {D.TOP_N} AS n_requested, count(*) AS count
FROM (SELECT * FROM odebtors ORDER BY {top_order} LIMIT {D.TOP_N}) t"""),
        "debtors_by_situation": _with(f"SELECT * FROM odebtors WHERE max_situation = "
                                      f"'{D.PAGE_SITUATION}'"),
        "debtors_page": _with(f"""
SELECT identification_number, max_situation, total_loan_amount,
       CAST(row_number() OVER (ORDER BY identification_number) AS BIGINT) AS position
FROM odebtors WHERE max_situation = '{D.PAGE_SITUATION}'
ORDER BY identification_number LIMIT {D.PER_PAGE} OFFSET {(D.PAGE - 1) * D.PER_PAGE}"""),
        "page_meta": _with(f"""
SELECT count(*) AS total, {D.PER_PAGE} AS per_page, {D.PAGE} AS current_page,
       CAST(greatest(ceil(count(*) / {D.PER_PAGE}), 1) AS BIGINT) AS last_page
FROM odebtors WHERE max_situation = '{D.PAGE_SITUATION}'"""),
        "deep_page": _with(f"""
SELECT identification_number, max_situation, total_loan_amount, position FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY identification_number) AS BIGINT) AS position,
         count(*) OVER () AS n FROM odebtors) t
WHERE position > (ceil(n / {D.PER_PAGE}) - 1) * {D.PER_PAGE}"""),
        "situation_page": _with(f"""
SELECT identification_number, max_situation, total_loan_amount, position, n AS total,
       CAST(greatest(ceil(n / {D.PER_PAGE}), 1) AS BIGINT) AS last_page
FROM (SELECT *, CAST(row_number() OVER (ORDER BY identification_number) AS BIGINT) AS position,
             count(*) OVER () AS n
      FROM odebtors WHERE max_situation = '{D.PAGE_SITUATION}') t
WHERE position > {(D.PAGE - 1) * D.PER_PAGE} AND position <= {D.PAGE * D.PER_PAGE}"""),
        "top_by_total": _with(f"""
SELECT identification_number, max_situation, total_loan_amount,
       CAST(row_number() OVER (ORDER BY {top_order}) AS BIGINT) AS position
FROM odebtors ORDER BY {top_order} LIMIT {D.TOP_N}"""),
        "list_by_situation": _with(f"SELECT * FROM odebtors WHERE max_situation = "
                                   f"'{D.PAGE_SITUATION}'"),
        "valid_cuit": _with("SELECT identification_number, regexp_full_match("
                            "trim(identification_number), '[0-9]{11}') AS is_valid_cuit "
                            "FROM odebtors"),
        "severity": _with("SELECT e_situation AS situation, e_rank AS severity, "
                          "count(*) AS n_lines FROM data GROUP BY 1, 2"),
        "is_worse_than": _with(f"""
SELECT v.e_situation AS situation, d.max_situation,
       ({rank_v}) > ({rank_d}) AS row_is_worse,
       ({rank_d}) > ({rank_v}) AS max_is_worse,
       count(*) AS n_lines
FROM valid v JOIN odebtors d ON v.e_id = d.identification_number
GROUP BY 1, 2, 3, 4"""),
        "amount_add": _with("SELECT r_entity AS entity_code, CAST(sum(e_loans + e_guarantees) "
                            "AS DECIMAL(18,2)) AS total_loans_and_guarantees FROM valid "
                            "GROUP BY 1"),
        "run_slug": _RUN_EVENTS + "SELECT DISTINCT run_id, substr(replace(run_id, '-', ''), "
                                  "1, 12) AS slug FROM ev",
        "run_state": _RUN_EVENTS + f"""
SELECT run_id, status, error_message, n_events,
       strftime(created_at, {_TS}) AS created_at, strftime(updated_at, {_TS}) AS updated_at
FROM st""",
        "active_runs": _RUN_EVENTS + "SELECT run_id, status FROM st "
                                     "WHERE status IN ('pending', 'processing')",
        "run_summary": _with(f"""
SELECT '{D.SUMMARY_RUN_ID}' AS import_id, 'registry' AS filename,
       count(*) AS total_records,
       count(*) FILTER (WHERE e_kind = 'valid') AS valid_records,
       count(*) FILTER (WHERE e_kind <> 'valid') AS invalid_records,
       (SELECT count(*) FROM odebtors) AS total_debtors,
       (SELECT count(*) FROM oentities) AS total_entities,
       CAST(0 AS BIGINT) AS duration_ms,
       '{clock}' AS completed_at
FROM data"""),
        "staging_retention": f"""
WITH runs AS (
  SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS slug,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed'
              WHEN 'O' THEN 'processing' END AS status,
         o_orderdate AS updated_at
  FROM orders
),
st AS (
  SELECT DISTINCT lpad(CAST(CASE WHEN l_orderkey % 50 = 0 THEN l_orderkey + 1000000000
                                 ELSE l_orderkey END AS VARCHAR), 12, '0') AS slug
  FROM lineitem
)
SELECT st.slug, CASE WHEN r.status IS NULL THEN 'orphan' ELSE 'expired' END AS reason
FROM st LEFT JOIN runs r ON st.slug = r.slug
WHERE r.status IS NULL
   OR (r.status IN ('completed', 'failed')
       AND r.updated_at <= TIMESTAMP '{D.RETENTION_AS_OF}' - INTERVAL 24 HOUR)""",
        "retention_odd_ids": _RUN_EVENTS + f"""
SELECT replace(replace(replace(replace(replace(replace(
         'imp_' || replace(run_id, '-', './ *~') || 'é',
         '/', '%2F'), ' ', '+'), '*', '%2A'), '~', '%7E'), 'é', '%C3%A9'), ',', '%2C') AS slug,
       'expired' AS reason
FROM st WHERE status IN ('completed', 'failed')
  AND updated_at <= TIMESTAMP '{D.EVENTS_AS_OF}' - INTERVAL 24 HOUR""",
        "resume_changed_file": _with("SELECT * FROM odebtors_o"),
        "latest_file_wins": _with("SELECT * FROM odebtors_o"),
        "publish_out_of_order": _with("SELECT * FROM odebtors_o"),
        "rerun_other_file": _with("SELECT * FROM odebtors_o"),
        "import_resume": _with("SELECT * FROM odebtors"),
        "run_log_written": _with(f"""
SELECT '{D.SUMMARY_RUN_ID}' AS run_id, 'completed' AS status, 'registry' AS filename,
       count(*) AS total_records,
       count(*) FILTER (WHERE e_kind = 'valid') AS valid_records,
       count(*) FILTER (WHERE e_kind <> 'valid') AS invalid_records,
       (SELECT max(line_number) FROM dnum WHERE e_kind = 'valid') AS last_loaded_line,
       CAST(3 AS BIGINT) AS n_events, '{clock}' AS started_at, CAST(0 AS BIGINT) AS n_staging
FROM data"""),
        "file_checkpoints": _with("""
SELECT delivery, CAST(file_no AS BIGINT) AS file_no,
       CAST(max(CASE WHEN e_kind = 'valid' THEN line_number END) AS BIGINT) AS last_loaded_line
FROM dnum GROUP BY delivery, file_no"""),
        "completion_event": _with(f"""
SELECT spelling, '{D.SUMMARY_RUN_ID}' AS import_id, 'registry' AS filename,
       (SELECT count(*) FROM odebtors) AS total_debtors,
       (SELECT count(*) FROM oentities) AS total_entities,
       CAST(0 AS BIGINT) AS duration_ms, '{clock}' AS completed_at
FROM (VALUES ('snake'), ('camel')) t(spelling)"""),
        "load_timestamp": f"""
SELECT table_name, CAST(1 AS BIGINT) AS n_times, '{clock}' AS loaded_at
FROM (VALUES ('debtors'), ('entities')) t(table_name)""",
        "stream_ingest": _with(f"SELECT {staged_cols} FROM valid"),
        "stream_latest_file": _with("SELECT * FROM odebtors_o"),
        "roundtrip": _with(f"SELECT {_RECORD_SELECT} FROM valid"),
    }

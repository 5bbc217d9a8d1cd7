"""Record layout, domain codes and table schemas of the debtor registry.

Everything here is declared, never inferred.  The values under the
"fixed values" banners must equal the official registry layout for the
results to be right; they are stated plainly and in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Record layout (1-based position, length) of one registry line.
# name, position, length, kind  (kind: str | trimmed | situation | amount |
# flag | int)
# ---------------------------------------------------------------------------
FIELDS: list[tuple[str, int, int, str]] = [
    ("entity_code", 1, 5, "str"),
    ("info_date", 6, 6, "str"),
    ("identification_type", 12, 2, "str"),
    ("identification_number", 14, 11, "trimmed"),
    ("activity", 25, 3, "str"),
    ("situation", 28, 2, "situation"),
    ("loans", 30, 12, "amount"),
    ("unused", 42, 12, "amount"),
    ("guarantees", 54, 12, "amount"),
    ("other_concepts", 66, 12, "amount"),
    ("preferred_guarantees_a", 78, 12, "amount"),
    ("preferred_guarantees_b", 90, 12, "amount"),
    ("no_preferred_guarantees", 102, 12, "amount"),
    ("counter_guarantees_a", 114, 12, "amount"),
    ("counter_guarantees_b", 126, 12, "amount"),
    ("no_counter_guarantees", 138, 12, "amount"),
    ("provisions", 150, 12, "amount"),
    ("debt_covered", 162, 1, "flag"),
    ("judicial_process", 163, 1, "flag"),
    ("refinancing", 164, 1, "flag"),
    ("mandatory_recat", 165, 1, "flag"),
    ("legal_situation", 166, 1, "flag"),
    ("technical_irrecoverable", 167, 1, "flag"),
    ("days_overdue", 168, 4, "int"),
]

# Minimum line length; the only identification type kept.
LINE_LENGTH = 171
CUIT_ID_TYPE = "11"

# Situation codes ordered from least to most severe.
# The severity rank of a code is its 0-based index in this list.
SITUATION_CODES: list[str] = ["01", "11", "21", "23", "03", "04", "05"]
WORST_SITUATION = SITUATION_CODES[-1]

# Single-digit situation levels and the codes they stand for.
SINGLE_DIGIT_SITUATIONS: dict[str, str] = {
    "1": "01",
    "2": "21",
    "3": "03",
    "4": "04",
    "5": "05",
}

# Characters removed by the registry's trim (space, tab, line
# feed, carriage return, NUL, vertical tab).
TRIM_CHARS = " \t\n\r\x00\x0b"

# Reject reasons, in the order the line checks apply.
REJECT_SHORT_LINE = "short_line"
REJECT_ID_TYPE = "id_type"
REJECT_SITUATION = "situation"
REJECT_PARSE_ERROR = "parse_error"  # an amount that does not fit its type
REJECT_REASONS = [REJECT_SHORT_LINE, REJECT_ID_TYPE, REJECT_SITUATION, REJECT_PARSE_ERROR]

# Line kinds produced by classification (rejects plus these three).
KIND_VALID = "valid"
KIND_BLANK = "blank"
KIND_COMMENT = "comment"

# Run statuses and retention.
STATUS_PENDING = "pending"
STATUS_PROCESSING = "processing"
STATUS_COMPLETED = "completed"
STATUS_FAILED = "failed"
ACTIVE_STATUSES = [STATUS_PENDING, STATUS_PROCESSING]
TERMINAL_STATUSES = [STATUS_COMPLETED, STATUS_FAILED]
STAGING_TTL_HOURS = 24
SLUG_LENGTH = 12

# Read-side argument limits.
TOP_N_MIN, TOP_N_MAX = 1, 1000
PER_PAGE_MIN, PER_PAGE_MAX, PER_PAGE_DEFAULT = 1, 200, 50

MONEY = T.DecimalType(18, 2)

AMOUNT_FIELDS = [name for name, _, _, kind in FIELDS if kind == "amount"]
FIELD_NAMES = [name for name, _, _, _ in FIELDS]

DEBTORS_SCHEMA = T.StructType(
    [
        T.StructField("identification_number", T.StringType(), False),
        T.StructField("max_situation", T.StringType(), True),
        T.StructField("total_loan_amount", MONEY, True),
        T.StructField("loaded_at", T.TimestampType(), True),
    ]
)

ENTITIES_SCHEMA = T.StructType(
    [
        T.StructField("entity_code", T.StringType(), False),
        T.StructField("total_loan_amount", MONEY, True),
        T.StructField("loaded_at", T.TimestampType(), True),
    ]
)

# One row per state change of an import run (append-only log).
RUN_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("event_at", T.TimestampType(), False),
        T.StructField("status", T.StringType(), True),
        T.StructField("filename", T.StringType(), True),
        T.StructField("last_loaded_line", T.LongType(), True),
        T.StructField("total_records", T.LongType(), True),
        T.StructField("valid_records", T.LongType(), True),
        T.StructField("invalid_records", T.LongType(), True),
        T.StructField("duration_ms", T.LongType(), True),
        T.StructField("error_message", T.StringType(), True),
        T.StructField("started_at", T.TimestampType(), True),
        T.StructField("finished_at", T.TimestampType(), True),
    ]
)

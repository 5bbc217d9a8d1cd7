"""Line classification and field projection.

Checks apply in order and the first match names the line's kind:
blank → comment → short_line → id_type → situation → parse_error → valid.  Blank and
comment lines are dropped without being counted; the four reject kinds are
counted and logged with a detail value.

Everything works on the line's raw bytes (``raw``) and its character count
(``n_chars``, see ``registry_text.line_columns``): the registry is Latin-1,
so byte positions are character positions, slices are cheap binary
substrings, and only the slices that become output fields are decoded.  Each
check is a column expression, so classification runs in the scan stage
with no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import layout as L
from ledgerline.functions import exprs as X

_FIELD = {name: (pos, length, kind) for name, pos, length, kind in L.FIELDS}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def byte_slice(raw: Column | str, position: int, length: int) -> Column:
    return F.substring(_c(raw), position, length)


def text_slice(raw: Column | str, position: int, length: int) -> Column:
    """Characters ``position .. position+length-1`` (1-based) as text."""
    return F.decode(byte_slice(raw, position, length), "ISO-8859-1")


def ascii_slice(raw: Column | str, position: int, length: int) -> Column:
    """A slice as text without charset decoding, for numeric fields: every
    character a number can contain is ASCII, and a non-ASCII byte ends the
    numeric prefix whether it is decoded or not."""
    return byte_slice(raw, position, length).cast("string")


def field(name: str, raw: Column | str = "raw") -> Column:
    """Typed value of one layout field sliced out of the line bytes."""
    pos, length, kind = _FIELD[name]
    if kind == "amount":
        return X.parse_amount(ascii_slice(raw, pos, length))
    if kind == "int":
        return X.lenient_int(ascii_slice(raw, pos, length))
    text = text_slice(raw, pos, length)
    if kind == "trimmed":
        return X.registry_trim(text)
    if kind == "situation":
        return X.normalize_situation(text)
    return text


# Trimmed raw situation texts that normalize to a valid code: the codes
# themselves and the single-digit levels (same set as normalizing first).
_VALID_RAW_SITUATIONS = L.SITUATION_CODES + list(L.SINGLE_DIGIT_SITUATIONS)


def situation_is_valid(raw: Column | str = "raw") -> Column:
    """Whether the situation field normalizes to a valid code, checked on the
    trimmed raw text (no decoding, no normalization per line)."""
    pos, length, _ = _FIELD["situation"]
    return X.registry_trim(ascii_slice(raw, pos, length)).isin(_VALID_RAW_SITUATIONS)


_AMOUNTS = [(pos, length) for name, pos, length, kind in L.FIELDS if kind == "amount"]
_AMOUNTS_START = _AMOUNTS[0][0]
_AMOUNTS_LENGTH = _AMOUNTS[-1][0] + _AMOUNTS[-1][1] - _AMOUNTS_START


def overflowing_amounts(raw: Column | str = "raw") -> Column:
    """The amount texts of a line that do not fit their type (usually none).
    Twelve characters overflow only with an exponent, so the amounts are
    parsed here only where their bytes hold an ``e``."""
    r = _c(raw)
    region = ascii_slice(r, _AMOUNTS_START, _AMOUNTS_LENGTH)
    texts = F.array(*[ascii_slice(r, pos, length) for pos, length in _AMOUNTS])
    return F.when(region.rlike("[eE]"), F.filter(texts, lambda x: X.parse_amount(x).isNull()))


def line_kind(raw: Column | str = "raw", n_chars: Column | str = "n_chars") -> Column:
    r, n = _c(raw), _c(n_chars)
    pos, length, _ = _FIELD["identification_type"]
    # An ASCII literal equals the bytes cast to text only if the bytes are
    # that ASCII text, so the cheap cast is exact for these two checks.
    return (
        F.when(n == 0, F.lit(L.KIND_BLANK))
        .when(byte_slice(r, 1, 1).cast("string") == "#", F.lit(L.KIND_COMMENT))
        .when(n < L.LINE_LENGTH, F.lit(L.REJECT_SHORT_LINE))
        .when(byte_slice(r, pos, length).cast("string") != L.CUIT_ID_TYPE, F.lit(L.REJECT_ID_TYPE))
        .when(~situation_is_valid(r), F.lit(L.REJECT_SITUATION))
        .when(F.size(overflowing_amounts(r)) > 0, F.lit(L.REJECT_PARSE_ERROR))
        .otherwise(F.lit(L.KIND_VALID))
    )


def reject_detail(kind: Column, raw: Column | str = "raw",
                  n_chars: Column | str = "n_chars") -> Column:
    """The offending value of a rejected line (length, type, situation or the
    first amount that does not fit)."""
    return (
        F.when(kind == L.REJECT_SHORT_LINE, _c(n_chars).cast("string"))
        .when(kind == L.REJECT_ID_TYPE, field("identification_type", raw))
        .when(kind == L.REJECT_SITUATION, field("situation", raw))
        .when(kind == L.REJECT_PARSE_ERROR, F.get(overflowing_amounts(raw), 0))
    )


def classify(lines: DataFrame) -> DataFrame:
    """Add ``kind`` to every line (keeps all other columns)."""
    return lines.withColumn("kind", line_kind())


def parse_fields(lines: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Add the typed layout fields (all 24 unless ``names`` narrows them).

    Many amounts are parsed as one array by one expression: written out field
    by field they make a generated method over the JVM's 8,000-byte limit,
    which is then never compiled.  The array is used by several fields, so the
    optimizer keeps its projection apart.
    """
    names = names or L.FIELD_NAMES
    amounts = [n for n in names if n in L.AMOUNT_FIELDS]
    if len(amounts) <= 2:
        return lines.select("*", *[field(n).alias(n) for n in names])
    texts = F.array(*[ascii_slice("raw", *_FIELD[n][:2]) for n in amounts])
    wide = lines.withColumn("_amounts", F.transform(texts, lambda x: X.parse_amount(x)))
    return wide.select(*lines.columns, *[
        (F.get("_amounts", amounts.index(n)) if n in amounts else field(n)).alias(n)
        for n in names])


def valid_records(lines: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Valid lines with their typed fields; the classification runs inline."""
    kept = lines.where(line_kind() == L.KIND_VALID)
    return parse_fields(kept, names)


def staging_projection(lines: DataFrame) -> DataFrame:
    """The four columns the aggregates need, from valid lines."""
    return valid_records(lines, ["identification_number", "entity_code", "situation", "loans"])


def rejects(lines: DataFrame) -> DataFrame:
    """Counted rejects with ``reason`` and ``detail`` (blank/comment excluded)."""
    out = lines.withColumn("reason", line_kind()).where(F.col("reason").isin(L.REJECT_REASONS))
    return out.withColumn("detail", reject_detail(F.col("reason")))


def reject_counts(lines: DataFrame) -> DataFrame:
    return rejects(lines).groupBy("reason").agg(F.count(F.lit(1)).alias("n_lines"))

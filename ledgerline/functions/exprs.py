"""Column builders for the registry's scalar rules.

All of these are built-in Spark expressions: they stay inside whole-stage
codegen and never raise on malformed input (ANSI mode is on in Spark 4, so
every lenient conversion goes through ``try_cast``).
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline import layout as L

# Numeric prefix accepted by a lenient string → number conversion: optional
# leading whitespace, sign, digits with an optional fraction (or a bare
# fraction), optional exponent.  Anything after the prefix is ignored.
_NUMERIC_PREFIX = r"^[ \t\n\r\x0B\f]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


# Fast-path amount text (after comma → point): an optional sign, digits with
# an optional fraction or a bare fraction, then optional trailing blanks.
_SIMPLE_AMOUNT = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+) *$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def registry_trim(c: Column | str) -> Column:
    """Trim the registry's whitespace set from both ends (plain ``trim`` only
    strips spaces)."""
    return F.btrim(_col(c), F.lit(L.TRIM_CHARS))


def field_slice(line: Column | str, position: int, length: int) -> Column:
    """Characters ``position .. position+length-1`` (1-based) of a line."""
    return F.substring(_col(line), position, length)


def normalize_situation(raw: Column | str) -> Column:
    """Trim, then map a single-digit level (``1``..``5``) to its code;
    anything else passes through unchanged."""
    t = registry_trim(raw)
    out = None
    for digit, code in L.SINGLE_DIGIT_SITUATIONS.items():
        out = (F.when(t == digit, F.lit(code)) if out is None
               else out.when(t == digit, F.lit(code)))
    return out.otherwise(t)


def _prefix(text: Column) -> Column:
    """The numeric prefix of ``text`` (empty when there is none)."""
    return F.regexp_extract(text, _NUMERIC_PREFIX, 1)


def parse_amount(raw: Column | str) -> Column:
    """Registry amount text → decimal(18,2).

    Leading zeros are dropped, the decimal comma becomes a point, and the
    longest numeric prefix is taken (no prefix → 0).  Digits without a comma
    are whole units.  Rounds half-up to two decimals.

    The branches only choose the text to convert; one cast at the end does
    the conversion (small generated code keeps wide projections compact).
    Digits with an optional comma and decimals, or a bare decimal part,
    optionally followed by blanks — every well-formed registry amount,
    zeros included — are cast as they are (the cast ignores the trailing
    blanks, as the prefix rule does); zeros and blanks alone are 0; any
    other spelling goes through the regular-expression prefix.
    The cast only ever sees text that parses, so it never costs an
    exception.  A number that does not fit (only an exponent can do that)
    yields NULL; classification rejects its line as ``parse_error``.
    """
    text = _col(raw)
    canonical = F.replace(text, F.lit(","), F.lit("."))
    stripped = F.replace(F.ltrim(text, F.lit("0")), F.lit(","), F.lit("."))
    number = (F.when(canonical.rlike(_SIMPLE_AMOUNT), canonical)
              .when(text.rlike(r"^[0 ]*$"), F.lit("0"))
              .otherwise(F.coalesce(F.nullif(_prefix(stripped), F.lit("")), F.lit("0"))))
    return number.try_cast(L.MONEY)


def lenient_int(raw: Column | str) -> Column:
    """Integer value of the numeric prefix of a text, truncated toward zero;
    0 when there is none or it does not fit an int.  Plain digits are cast
    directly; anything else goes through the prefix."""
    c = _col(raw)
    value = F.when(c.rlike(r"^ *[0-9]{1,9} *$"), c.try_cast("int")).otherwise(
        F.nullif(_prefix(c), F.lit("")).try_cast("double").try_cast("int"))
    return F.coalesce(value, F.lit(0))


def severity(code: Column | str) -> Column:
    """0-based severity rank of a situation code; NULL for unknown codes."""
    c = _col(code)
    out = None
    for rank, s in enumerate(L.SITUATION_CODES):
        out = F.when(c == s, F.lit(rank)) if out is None else out.when(c == s, F.lit(rank))
    return out


def code_of_rank(rank: Column | str) -> Column:
    """Situation code of a 0-based rank; NULL for NULL or out-of-range ranks.

    ``get`` (not ``element_at``) so that a NULL rank can never turn into the
    last code.
    """
    return F.get(F.array(*[F.lit(s) for s in L.SITUATION_CODES]), _col(rank))


def is_worse_than(a: Column | str, b: Column | str) -> Column:
    """Strictly more severe; NULL when either code is unknown."""
    return severity(a) > severity(b)


def is_valid_situation(code: Column | str) -> Column:
    return _col(code).isin(L.SITUATION_CODES)


def is_valid_cuit(ident: Column | str) -> Column:
    """Trimmed, exactly 11 ASCII digits (no check digit)."""
    return F.coalesce(registry_trim(ident).rlike(r"^[0-9]{11}$"), F.lit(False))


def amount_add(a: Column | str, b: Column | str) -> Column:
    return (_col(a) + _col(b)).cast(L.MONEY)


def run_slug(run_id: Column | str) -> Column:
    """Staging key of a run: dashes removed, first 12 characters."""
    return F.substring(F.replace(_col(run_id), F.lit("-"), F.lit("")), 1, L.SLUG_LENGTH)


def run_key(run_id: Column | str) -> Column:
    """Folder key of a run: its whole id, URL-encoded (the column form of
    ``staging.run_key``; an asterisk would be a glob)."""
    return F.replace(F.url_encode(_col(run_id)), F.lit("*"), F.lit("%2A"))


def instant(at) -> Column:
    """A literal point in time from a datetime (naive ones are UTC), whatever
    the time zones of the session and of Python."""
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    micros = (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros))


def basename(path: Column | str) -> Column:
    """Last path component (a trailing slash is ignored)."""
    return F.regexp_extract(_col(path), r"([^/]*)/*$", 1)


def iso_utc(ts: Column | str) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` in UTC, whatever the session time zone."""
    utc = F.to_utc_timestamp(_col(ts), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")

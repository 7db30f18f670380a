"""Row rules that produce reject reasons (B6-B10) and the reason array.

Each rule returns a string Column that is NULL when the row passes. SQL
three-valued logic is kept: a CHECK fails only on FALSE, so NULL passes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME_PATTERN = r"^(\d{1,2}):(\d{2})(:(\d{2}))?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def required(c, reason: str) -> Column:
    """B6: '' (or NULL) -> reason."""
    x = _col(c)
    return F.when(x.isNull() | (x == F.lit("")), F.lit(reason))


def in_domain(c, values: Iterable, reason: str) -> Column:
    """Value outside the list -> reason; NULL passes."""
    x = _col(c)
    return F.when(~x.isin(list(values)), F.lit(reason))


def check(cond: Column, reason: str) -> Column:
    """Reason when ``cond`` is FALSE (NULL passes)."""
    return F.when(~cond, F.lit(reason))


def not_null(c, reason: str) -> Column:
    """NOT NULL column."""
    return F.when(_col(c).isNull(), F.lit(reason))


def max_len(c, n: int, reason: str) -> Column:
    """VARCHAR(n) counts characters, not bytes."""
    return F.when(F.char_length(_col(c)) > n, F.lit(reason))


def _given(x: Column) -> Column:
    return x.isNotNull() & (x != F.lit(""))


def to_int(c) -> Column:
    """Text -> int, NULL when not an integer."""
    return _col(c).try_cast("int")


def to_decimal(c, precision: int, scale: int) -> Column:
    """Text -> decimal(p,s) rounded to scale; NULL on junk or overflow."""
    return _col(c).try_cast(f"decimal({precision},{scale})")


def to_bool(c) -> Column:
    """The CSV contract spells booleans ``true``/``false`` (any case)."""
    x = F.lower(_col(c))
    return F.when(x == F.lit("true"), F.lit(True)).when(x == F.lit("false"), F.lit(False))


def to_seconds(c) -> Column:
    """``H:mm[:ss]`` -> seconds of day; NULL outside 00:00:00..23:59:59."""
    x = _col(c)
    h = F.regexp_extract(x, TIME_PATTERN, 1).try_cast("int")
    m = F.regexp_extract(x, TIME_PATTERN, 2).try_cast("int")
    s = F.coalesce(F.nullif(F.regexp_extract(x, TIME_PATTERN, 4), F.lit("")).try_cast("int"), F.lit(0))
    ok = x.rlike(TIME_PATTERN) & (h <= 23) & (m <= 59) & (s <= 59)
    return F.when(ok, h * 3600 + m * 60 + s)


def cast_reason(raw, typed: Column, reason: str) -> Column:
    """Non-empty input whose cast came out NULL -> reason."""
    return F.when(_given(_col(raw)) & typed.isNull(), F.lit(reason))


def reasons(*rules: Column) -> Column:
    """Array of the non-NULL reasons, in rule order."""
    return F.filter(F.array(*rules), lambda r: r.isNotNull())

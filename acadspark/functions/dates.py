"""Multi-format date normalisation with reject reasons.

Order matters and shape is tested before value: a string that matches a
shape but names no real day (``31-02-2024``, ``08/15/2024``) is a *bad date*,
never retried under another format. Day-first always beats month-first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted input shapes, in the order they are tried.
SHAPE_DMY_DASH = r"^(\d{1,2})-(\d{1,2})-(\d{4})$"      # d-m-yyyy
SHAPE_DMY_SLASH = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"     # d/m/yyyy
SHAPE_YMD = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"           # yyyy-m-d
# Fallbacks standing in for a general engine date parser (UTC):
SHAPE_ISO_INSTANT = r"^(\d{4})-(\d{2})-(\d{2})[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?Z?$"  # no zone: taken as UTC
SHAPE_MONTH_NAME = r"^([A-Za-z]{3})[A-Za-z]*\.? (\d{1,2}),? (\d{4})$"   # Oct 3, 1998 / October 3 1998
SHAPE_YMD_SLASH = r"^(\d{4})/(\d{1,2})/(\d{1,2})$"   # yyyy/m/d
SHAPE_DAY_MONTH = r"^(\d{1,2}) ([A-Za-z]{3})[A-Za-z]*\.?,? (\d{4})$"   # 3 Oct 1998
SHAPE_ISO_OFFSET = r"^\d{4}-\d{2}-\d{2}T(\d{2}):(\d{2})(?::\d{2}(?:\.\d{1,9})?)?([+-])(\d{2}):?(\d{2})$"   # the UTC day
# English month abbreviations, January first.
MONTH_ABBR = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

BAD_FORMAT = "bad_format"
BAD_DATE = "bad_date"


def ymd_date(y: Column, m: Column, d: Column) -> Column:
    """Strict calendar date from digit strings; NULL when the day does not exist."""
    text = F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))
    return F.when(y != F.lit("0000"), F.try_to_date(text, "yyyy-MM-dd"))


def _month(s: Column, shape: str, group: int) -> Column:
    """The number of an English month name, 0 for none."""
    return F.array_position(F.array(*[F.lit(m) for m in MONTH_ABBR]), F.lower(F.regexp_extract(s, shape, group)))


def date_shape(s: Column) -> Column:
    """Index of the first matching input shape (1..8), 0 when none matches.

    The first characters leave one or a few shapes: a letter, a separator behind one or two characters, or one behind
    four; only the regular expressions of these are tried, in order.
    """
    none = F.lit(0)
    second, third = F.substring(s, 2, 1), F.substring(s, 3, 1)
    near = F.when(second.isin("-", "/", " "), second).otherwise(third)
    far = F.substring(s, 5, 1)
    letter = F.upper(F.substring(s, 1, 1)).between("A", "Z")
    return (F.when(letter, F.when(s.rlike(SHAPE_MONTH_NAME) & (_month(s, SHAPE_MONTH_NAME, 1) > 0), F.lit(5)).otherwise(none))
            .when(near == "-", F.when(s.rlike(SHAPE_DMY_DASH), F.lit(1)).otherwise(none))
            .when(near == "/", F.when(s.rlike(SHAPE_DMY_SLASH), F.lit(2)).otherwise(none))
            .when(near == " ", F.when(s.rlike(SHAPE_DAY_MONTH) & (_month(s, SHAPE_DAY_MONTH, 2) > 0), F.lit(7)).otherwise(none))
            .when(far == "-", F.when(s.rlike(SHAPE_YMD), F.lit(3)).when(s.rlike(SHAPE_ISO_INSTANT), F.lit(4))
                  .when(s.rlike(SHAPE_ISO_OFFSET), F.lit(8)).otherwise(none))
            .when(far == "/", F.when(s.rlike(SHAPE_YMD_SLASH), F.lit(6)).otherwise(none))
            .otherwise(none))


def _utc_day(s: Column) -> Column:
    """The UTC day of a time with an offset; NULL when the time does not exist."""
    h, m, oh, om = (F.regexp_extract(s, SHAPE_ISO_OFFSET, g).try_cast("int") for g in (1, 2, 4, 5))
    sign = F.when(F.regexp_extract(s, SHAPE_ISO_OFFSET, 3) == "-", F.lit(-1)).otherwise(F.lit(1))
    minutes = h * 60 + m - sign * (oh * 60 + om)
    return F.when((h <= 23) & (m <= 59) & (oh <= 23) & (om <= 59),
                  F.date_add(F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"), F.floor(minutes / 1440).cast("int")))


def parse_shaped(s: Column, shape: Column) -> Column:
    """The date of ``s`` given its shape; NULL when the day does not exist (or year 0)."""
    not_year0 = ~s.rlike(r"(^|[-/ ])0000($|[-/T])")
    return F.when(not_year0, (
        F.when(shape == 1, F.try_to_date(s, "d-M-yyyy"))
        .when(shape == 2, F.try_to_date(s, "d/M/yyyy"))
        .when(shape == 3, F.try_to_date(s, "yyyy-M-d"))
        .when(shape == 4, F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))
        .when(shape == 5, ymd_date(F.regexp_extract(s, SHAPE_MONTH_NAME, 3), _month(s, SHAPE_MONTH_NAME, 1).cast("string"),
                                   F.regexp_extract(s, SHAPE_MONTH_NAME, 2)))
        .when(shape == 6, F.try_to_date(s, "yyyy/M/d"))
        .when(shape == 7, ymd_date(F.regexp_extract(s, SHAPE_DAY_MONTH, 3), _month(s, SHAPE_DAY_MONTH, 2).cast("string"),
                                   F.regexp_extract(s, SHAPE_DAY_MONTH, 1)))
        .when(shape == 8, _utc_day(s))))


def date_reason(s: Column, shape: Column, parsed: Column) -> Column:
    empty = s.isNull() | (s == F.lit(""))
    return (F.when(empty, F.lit(None).cast("string"))
            .when(shape == 0, F.lit(BAD_FORMAT))
            .when(parsed.isNull(), F.lit(BAD_DATE)))


def norm_date(c) -> tuple[Column, Column]:
    """Return ``(date, reason)``; reason is NULL on success and for empty input.

    The shapes are tested once, in order, giving a shape index; the value is
    then parsed by a strict ``try_to_date`` with that shape's pattern
    (impossible days give NULL). Callers that can stage columns (the contract
    projection) materialise the shape first, so each regex runs once per row.
    """
    s = F.col(c) if isinstance(c, str) else c
    shape = date_shape(s)
    parsed = parse_shaped(s, shape)
    return parsed, date_reason(s, shape, parsed)


def with_date(df: DataFrame, column: str, date: str, reason: str) -> DataFrame:
    """Adds the date and the reason of a text column in stages: the shape once a row, then the date by its shape, then the
    reason. Catalyst keeps the stages apart, as the next one uses a costly value more than once."""
    staged = df.withColumn("_shape", date_shape(F.col(column)))
    staged = staged.withColumn(date, parse_shaped(F.col(column), F.col("_shape")))
    return staged.withColumn(reason, date_reason(F.col(column), F.col("_shape"), F.col(date))).drop("_shape")

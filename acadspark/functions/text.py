"""String expressions (B1 pick, B2 trim, B4 code derivation, B12 lists, B14 accounts, B17 slot text).

All are built-in Catalyst expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters the upload code's trim() removes (ECMAScript
# WhiteSpace and LineTerminator): U+0009-U+000D, U+0020, U+00A0, U+1680,
# U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000, U+FEFF.
WHITESPACE_CHARS = ("\t\n\u000b\u000c\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                    + "\u2028\u2029\u202f\u205f\u3000\ufeff")
# The same set as a regex class (Java and RE2 syntax), for SQL engines without a set trim.
WHITESPACE_CLASS = (r"\t\n\x{000B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
                    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}")
TRIM_PATTERN = rf"^[{WHITESPACE_CLASS}]+|[{WHITESPACE_CLASS}]+$"

# Weekday names for day_of_week 1..7 (1 = Monday).
WEEKDAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c) -> Column:
    """B2: strip Unicode whitespace at both ends. Plain ``F.trim`` strips only
    U+0020; trimming by an explicit character set is codegen'd, no regex."""
    return F.trim(_col(c), F.lit(WHITESPACE_CHARS))


def header_map(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Rename raw CSV columns by position and map each exact header to its column.

    Header matching is case-sensitive (``Code`` and ``code`` are different
    aliases), while Spark resolves names case-insensitively by default, so the
    columns are addressed by position. A repeated header keeps its last value,
    as a key assigned twice in a JS object does.
    """
    pos = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return pos, {name: F.col(f"_c{i}") for i, name in enumerate(df.columns)}


def pick(cols: Mapping[str, Column], *names: str, default: str = "") -> Column:
    """B1: first *non-empty* value among the header aliases present.

    Spark reads an empty CSV cell as NULL, the upload code as ''; both count as
    missing. A cell of blanks is not empty, so it wins and trims to '' later.
    """
    present = [F.nullif(cols[n], F.lit("")) for n in names if n in cols]
    return F.coalesce(*present, F.lit(default)) if present else F.lit(default)


def derive_code(name, n: int = 6) -> Column:
    """Keep A-Z/a-z of the name, first ``n`` letters, upper-cased."""
    return F.upper(F.substring(F.regexp_replace(_col(name), "[^A-Za-z]", ""), 1, n))


def split_list(c, sep: str = ";") -> Column:
    """``a; b;;c`` -> [a, b, c] (trimmed, empties dropped). NULL stays NULL."""
    parts = F.split(_col(c), F.lit(sep), -1)
    return F.filter(F.transform(parts, utrim), lambda x: x != F.lit(""))


def account_role(email) -> Column:
    """Faculty when the address contains 'faculty', else student."""
    return F.when(F.instr(_col(email), "faculty") > 0, F.lit("faculty")).otherwise(F.lit("student"))


def display_name(email) -> Column:
    """Local part of the address with its first '.' turned into a space."""
    local = F.substring_index(_col(email), "@", 1)
    return F.regexp_replace(local, r"^([^.]*)\.", "$1 ")


def hhmm(seconds) -> Column:
    """Seconds of day -> ``HH:mm``."""
    s = _col(seconds)
    return F.format_string("%02d:%02d", (s / 3600).cast("int"), ((s % 3600) / 60).cast("int"))


def slot_text(start_sec, end_sec) -> Column:
    """``HH:mm-HH:mm``."""
    return F.concat(hhmm(start_sec), F.lit("-"), hhmm(end_sec))


def weekday_name(dow) -> Column:
    """1..7 -> Monday..Sunday, NULL outside the range."""
    d = _col(dow)
    return F.when(d.between(1, 7), F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), d.cast("int")))

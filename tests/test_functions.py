"""Unit tests of the scalar rules (B1-B17) on the upload templates and edge rows."""

import datetime as dt

from pyspark.sql import functions as F

from acadspark.functions import checks as C
from acadspark.functions.dates import norm_date
from acadspark.functions.text import (account_role, derive_code, display_name, header_map, pick, slot_text,
                                      split_list, utrim, weekday_name)


def one(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_utrim_strips_unicode_whitespace(spark):
    df = one(spark, [(" \tCSE 　",), ("  ",), ("a b",), ("﻿X ",)], "s string")
    got = [r[0] for r in df.select(utrim("s")).collect()]
    assert got == ["CSE", "", "a b", "X"]


def test_pick_first_non_empty_alias_before_trim(spark):
    # 'Code' of blanks wins over 'code' and trims to '' (so the code is then derived)
    df = one(spark, [("  ", "xyz"), (None, "abc"), ("", "")], "Code string, code string")
    pos, cols = header_map(df)
    got = [r[0] for r in pos.select(utrim(pick(cols, "Code", "code"))).collect()]
    assert got == ["", "abc", ""]


def test_header_match_is_case_sensitive(spark):
    df = one(spark, [("upper", "lower")], "Name string, name string")
    pos, cols = header_map(df)
    assert pos.select(pick(cols, "name")).first()[0] == "lower"
    assert pos.select(pick(cols, "Department")).first()[0] == ""


def test_derive_code(spark):
    df = one(spark, [("Computer Science and Engineering",), ("Electrical",), ("Electronics",), ("123",),
                     ("B.Tech-IT",)], "n string")
    got = [r[0] for r in df.select(derive_code("n")).collect()]
    assert got == ["COMPUT", "ELECTR", "ELECTR", "", "BTECHI"]


def test_norm_date_shapes_and_reasons(spark):
    vals = ["1-2-2024", "01/02/2024", "2024-2-1", "05/06/2024", "31-02-2024", "08/15/2024", "n/a",
            "2024-02-01T23:59:59Z", "Feb 1, 2024", "", None, "2023-02-29"]
    df = one(spark, [(v,) for v in vals], "s string")
    d, r = norm_date("s")
    got = [(x[0], x[1]) for x in df.select(d, r).collect()]
    feb1 = dt.date(2024, 2, 1)
    assert got == [(feb1, None), (feb1, None), (feb1, None), (dt.date(2024, 6, 5), None),
                   (None, "bad_date"), (None, "bad_date"), (None, "bad_format"), (feb1, None), (feb1, None),
                   (None, None), (None, None), (None, "bad_date")]


def test_norm_date_other_texts(spark):
    vals = ["2024/08/15", "15 Aug 2024", "15 August, 2024", "Aug 15 2024", "2024-08-15T00:30:00+05:30", "2024-08-15T23:30-0100",
            "2024-08-15T10:00:00", "2024-08-15 10:00", "2024/02/30", "31 Feb 2024", "15 Foo 2024", "2024-08-15T25:00:00+01:00"]
    d, r = norm_date("s")
    got = [(x[0], x[1]) for x in one(spark, [(v,) for v in vals], "s string").select(d, r).collect()]
    day = lambda n: (dt.date(2024, 8, n), None)
    assert got == [day(15), day(15), day(15), day(15), day(14), day(16), day(15), day(15), (None, "bad_date"),
                   (None, "bad_date"), (None, "bad_format"), (None, "bad_date")]


def test_casts_with_reasons(spark):
    df = one(spark, [("12", "3.25", "TRUE", "09:00:00"), ("x", "100", "yes", "24:00"), ("", "", "", "9:5")],
             "i string, d string, b string, t string")
    out = df.select(C.to_int("i").alias("i"), C.to_decimal("d", 3, 1).alias("d"), C.to_bool("b").alias("b"),
                    C.to_seconds("t").alias("t")).collect()
    assert out[0] == (12, __import__("decimal").Decimal("3.3"), True, 32400)
    assert out[1] == (None, None, None, None)
    assert out[2] == (None, None, None, None)


def test_domain_and_null_pass(spark):
    df = one(spark, [("active",), ("done",), (None,)], "s string")
    got = [r[0] for r in df.select(C.in_domain("s", ["active", "upcoming"], "bad_status")).collect()]
    assert got == [None, "bad_status", None]


def test_split_list(spark):
    df = one(spark, [("Projector; Whiteboard;;AC ",), (None,), ("",)], "s string")
    got = [r[0] for r in df.select(split_list("s")).collect()]
    assert got == [["Projector", "Whiteboard", "AC"], None, []]


def test_account_attributes(spark):
    df = one(spark, [("john.smith.jr@univ.edu",), ("faculty.x@univ.edu",), ("plain@u.edu",)], "e string")
    got = df.select(account_role("e"), display_name("e")).collect()
    assert [tuple(r) for r in got] == [("student", "john smith.jr"), ("faculty", "faculty x"),
                                       ("student", "plain")]


def test_slot_text(spark):
    df = one(spark, [(1, 32400, 36000), (7, 45000, 48600), (8, 0, 60)], "d int, s int, e int")
    got = df.select(weekday_name("d"), slot_text("s", "e")).collect()
    assert [tuple(r) for r in got] == [("Monday", "09:00-10:00"), ("Sunday", "12:30-13:30"), (None, "00:00-00:01")]


def test_shapes_by_first_characters_are_those_of_all_patterns(spark):
    """The shape of a text is that of the first pattern, whatever its first characters are."""
    import re
    from pyspark.sql import functions as F
    from acadspark.functions import dates as D
    patterns = [D.SHAPE_DMY_DASH, D.SHAPE_DMY_SLASH, D.SHAPE_YMD, D.SHAPE_ISO_INSTANT, D.SHAPE_MONTH_NAME, D.SHAPE_YMD_SLASH,
                D.SHAPE_DAY_MONTH, D.SHAPE_ISO_OFFSET]
    seeds = ["1-2-1998", "01/12/1998", "1998-1-2", "1998-01-02T10:30:00Z", "1998-01-02 10:30", "Oct 3, 1998", "October 3 1998", "1998/1/2",
             "3 Oct 1998", "13 october, 1998", "1998-01-02T10:30+05:30", "x", "", "1", "12", "Foo 3, 1998", "3 Foo 1998", "12-3-1998"]
    texts = sorted({t for s in seeds for i in range(len(s) + 1) for t in (s, s[:i] + s[i + 1:], s[:i] + "-" + s[i:], s[:i] + "/" + s[i + 1:],
                                                                          s[:i] + " " + s[i:], s[:i] + "1" + s[i:])})

    def shape(t):
        for i, p in enumerate(patterns):
            m = re.search(p, t)
            if m and not (i in (4, 6) and m[1 if i == 4 else 2].lower() not in D.MONTH_ABBR):
                return i + 1
        return 0
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.s for r in df.select("t", D.date_shape(F.col("t")).alias("s")).collect()}
    assert got == {t: shape(t) for t in texts}

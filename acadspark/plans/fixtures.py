"""Record tables derived from the harness tables (whole tables, no sampling).

The harness holds TPC-H-like tables; the records engine needs departments,
uploads, timetable entries and so on. Each derivation here is written once
with DataFrame expressions, and the same text appears in the oracle SQL of
the query catalogue (plans/catalog.py). Damage such as blank codes or junk
dates is decided per row from its key, so every row of every table flows
through every query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Tables

RUN_TS = "2025-01-01 00:00:00"       # the fixed run timestamp of the catalogue's loads
SEED_TS = "2024-01-01 00:00:00"      # created_at/updated_at of the seeded target rows


def _s(c: Column) -> Column:
    return c.cast("string")


def raw_departments(t: Tables) -> DataFrame:
    """A departments upload (all-string CSV rows) built from ``customer``."""
    k = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    code = (F.when(k % 6 == 0, F.lit(None).cast("string"))
            .when(k % 6 == 1, F.lit(""))
            .when(k % 6 == 2, F.lit("   "))
            .when(k % 6 == 3, F.concat(F.lit("\u00a0D"), _s(F.col("c_nationkey")), F.lit("\t")))
            .when(k % 6 == 4, F.concat(F.lit("DEPT"), _s(k % 40)))
            .otherwise(F.concat(F.lit("CODE_TOO_LONG_"), _s(k))))
    code_alias = F.when(k % 4 == 0, F.concat(F.lit("alt"), _s(F.col("c_nationkey"))))
    name = (F.when(k % 9 == 0, F.lit(""))
            .when(k % 9 == 1, F.lit(None).cast("string"))
            .when(k % 9 == 2, F.concat(F.lit(" "), seg, F.lit(" Engineering"), F.lit("\u3000")))
            .when(k % 9 == 3, F.lit("123 456"))
            .otherwise(F.concat(seg, F.lit(" "), F.col("c_name"))))
    name_alias = F.when((k % 9 == 0) & (k % 2 == 0), F.concat(F.lit("Lower "), seg))
    dept = F.when(k % 9 == 1, F.concat(F.lit("Dept of "), seg))
    desc = F.when(k % 5 != 0, F.concat(F.lit("Segment "), seg, F.lit(" of nation "), _s(F.col("c_nationkey"))))
    email = F.concat(F.lit("hod"), _s(k), F.lit("@university.edu"))
    return t.customer.select(
        (k + 2).alias("row_no"), code.alias("Code"), code_alias.alias("code"), name.alias("Name"),
        name_alias.alias("name"), dept.alias("Department"), desc.alias("Description"),
        email.alias("Head of Department Email"))


def seed_departments(t: Tables) -> DataFrame:
    """Stored departments before the load: one per nation, codes ``D<nationkey>``."""
    return t.nation.select(
        (F.col("n_nationkey") + 1).cast("long").alias("id"),
        F.concat(F.lit("D"), _s(F.col("n_nationkey"))).alias("code"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("Region "), _s(F.col("n_regionkey"))).alias("description"),
        F.lit(None).cast("long").alias("head_of_department"),
        F.lit(SEED_TS).cast("timestamp_ntz").alias("created_at"),
        F.lit(SEED_TS).cast("timestamp_ntz").alias("updated_at"))


def date_text(d: Column, key: Column) -> Column:
    """A date as users type it: one of fourteen shapes chosen by the key."""
    day, mon, yr = _s(F.dayofmonth(d)), _s(F.month(d)), _s(F.year(d))
    k = key % 14
    ymd = F.date_format(d, "yyyy-MM-dd")
    return (F.when(k == 0, F.concat(day, F.lit("-"), mon, F.lit("-"), yr))
            .when(k == 1, F.concat(F.lpad(day, 2, "0"), F.lit("/"), F.lpad(mon, 2, "0"), F.lit("/"), yr))
            .when(k == 2, F.concat(yr, F.lit("-"), mon, F.lit("-"), day))
            .when(k == 3, F.lit("n/a"))
            .when(k == 4, F.concat(F.lit("31-02-"), yr))
            .when(k == 5, F.concat(F.lpad(mon, 2, "0"), F.lit("/"), F.lpad(day, 2, "0"), F.lit("/"), yr))
            .when(k == 6, F.concat(ymd, F.lit("T10:30:00Z")))
            .when(k == 8, F.concat(yr, F.lit("/"), mon, F.lit("/"), day))
            .when(k == 9, F.concat(day, F.lit(" "), F.date_format(d, "MMM"), F.lit(" "), yr))
            .when(k == 10, F.concat(F.date_format(d, "MMM"), F.lit(" "), day, F.lit(" "), yr))
            .when(k == 11, F.concat(ymd, F.lit("T02:30:00+05:30")))
            .when(k == 12, F.concat(ymd, F.lit("T23:30-0100")))
            .when(k == 13, F.concat(ymd, F.lit(" 23:59:59")))
            .otherwise(F.concat(F.date_format(d, "MMM"), F.lit(" "), day, F.lit(", "), yr)))


def raw_dates(t: Tables) -> DataFrame:
    """Term dates as users type them: every order date printed in one of fourteen shapes."""
    return t.orders.select("o_orderkey", date_text(F.col("o_orderdate"), F.col("o_orderkey")).alias("raw"))


def raw_terms(t: Tables) -> DataFrame:
    """An academic-terms upload from ``orders``: 400 term names (so later rows overwrite
    earlier ones), start dates in fourteen shapes, statuses with blanks and junk."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    y = F.year(d)
    return t.orders.select(
        (k + 2).alias("row_no"),
        F.concat(F.lit("Term "), _s(k % 400)).alias("Name"),
        date_text(d, k).alias("Start Date"),
        F.date_format(F.date_add(d, 120), "dd-MM-yyyy").alias("End Date"),
        F.concat(_s(y), F.lit("-"), F.lpad(_s((y + 1) % 100), 2, "0")).alias("Academic Year"),
        F.when(k % 5 == 0, "").when(k % 5 == 1, "active").when(k % 5 == 2, "completed")
         .when(k % 5 == 3, "  ").otherwise("done").alias("Status"))


def raw_courses(t: Tables) -> DataFrame:
    """A courses upload built from ``part`` (headers as in the courses contract)."""
    k = F.col("p_partkey")
    return t.part.select(
        (k + 2).alias("row_no"),
        F.when(k % 97 == 0, F.lit("")).otherwise(F.concat(F.lit("C"), _s(k))).alias("Course Code"),
        F.col("p_name").alias("Title"),
        F.when(k % 13 == 0, F.lit("x")).otherwise(_s(F.col("p_size") % 8 + 1)).alias("Semester"),
        F.when(k % 5 == 0, "4").when(k % 5 == 1, "3.5").when(k % 5 == 2, "2.25")
         .when(k % 5 == 3, "100").otherwise("").alias("Credits"),
        _s(F.col("p_size") % 6 + 1).alias("Hours Per Week"),
        F.when(k % 7 == 0, "lab").when(k % 7 == 1, "project").when(k % 7 == 2, "Theory")
         .when(k % 7 == 3, "").otherwise("theory").alias("Course Type"),
        F.when(k % 4 == 0, "true").when(k % 4 == 1, "false").when(k % 4 == 2, "TRUE")
         .otherwise("yes").alias("Is Elective"),
        F.col("p_type").alias("Description"))


def raw_slots(t: Tables) -> DataFrame:
    """A time-slots upload built from ``orders``; some hours run past 23, some ends are malformed."""
    k = F.col("o_orderkey")
    minute = F.lpad(_s(k % 60), 2, "0")
    start = F.concat(_s(F.floor((k % 1500) / 60)), F.lit(":"), minute)
    end = F.when(k % 11 == 0, F.lit("12:3")).otherwise(
        F.concat(F.lpad(_s((F.floor((k % 1500) / 60) + 1) % 24), 2, "0"), F.lit(":"), minute, F.lit(":00")))
    return t.orders.select(
        (k + 2).alias("row_no"),
        F.concat(F.lit("Slot "), _s(k)).alias("Slot Name"),
        start.alias("Start Time"), end.alias("End Time"), F.lit("60").alias("Duration Minutes"),
        F.when(k % 5 == 0, "lecture").when(k % 5 == 1, "lab").when(k % 5 == 2, "lunch")
         .when(k % 5 == 3, "Break").otherwise("").alias("Slot Type"),
        F.when(k % 3 == 0, "true").when(k % 3 == 1, "").otherwise("no").alias("Is Active"))


def timetable_entries(t: Tables) -> DataFrame:
    """Timetable entries from every distinct lineitem (order, part, supplier, line).

    timetable = (order div 20) mod 4, weekday = order mod 7 + 1, room = supplier,
    teacher = part div 10, course = part, section A/B by line parity, start on
    the half hour from 08:00, 1 h lectures or 3 h labs (every third line).
    """
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").distinct()
    o, p, s, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    lab = n % 3 == 0
    start = ((F.lit(480) + (p % 24) * 30) * 60).cast("int")
    return li.select(
        F.concat_ws(":", _s(o), _s(n), _s(p), _s(s)).alias("entry_id"),
        (F.floor(o / 20) % 4).cast("long").alias("timetable_id"),
        (o % 7 + 1).cast("int").alias("dow"),
        s.alias("room_id"),
        F.floor(p / 10).cast("long").alias("faculty_id"),
        p.alias("course_id"),
        F.when(n % 2 == 0, F.lit("A")).otherwise(F.lit("B")).alias("section"),
        start.alias("start_sec"),
        (start + F.when(lab, F.lit(180 * 60)).otherwise(F.lit(60 * 60))).cast("int").alias("end_sec"),
        F.when(lab, F.lit("lab")).otherwise(F.lit("lecture")).alias("entry_type"),
        (F.lit(20) + p % 41).cast("int").alias("max_students"))


def classrooms(t: Tables) -> DataFrame:
    """One classroom per supplier: capacity 20..79, every fifth a lab, every 17th unavailable."""
    s = F.col("s_suppkey")
    return t.supplier.select(
        s.alias("room_id"), F.concat(F.lit("R"), _s(s)).alias("room_code"),
        (F.lit(20) + s % 60).cast("int").alias("capacity"),
        F.when(s % 5 == 0, F.lit("lab")).otherwise(F.lit("class")).alias("type"),
        (s % 17 != 0).alias("is_available"))


def _order_lines(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))


def _term(d: Column) -> tuple[Column, Column]:
    return _s(F.year(d)).alias("academic_year"), F.when(F.month(d) <= 6, F.lit(2)).otherwise(F.lit(1)).alias("semester")


def enrolment_rows(t: Tables) -> DataFrame:
    """Raw enrolments: one per order line (student = customer, course = part)."""
    year, sem = _term(F.col("o_orderdate"))
    status = (F.when(F.col("l_returnflag") == "R", F.lit("dropped"))
              .when(F.col("l_returnflag") == "A", F.lit("completed")).otherwise(F.lit("enrolled")))
    return _order_lines(t).select(
        F.col("o_custkey").alias("student_id"), F.col("l_partkey").alias("course_id"), year, sem,
        status.alias("status"), F.col("o_orderdate").alias("enrollment_date"),
        "o_orderkey", "l_linenumber", "l_suppkey")


def enrollments(t: Tables) -> DataFrame:
    """Stored enrolments: unique on (student, course, academic_year), the latest line wins (D3)."""
    from ..operators.upsert import last_wins
    return last_wins(enrolment_rows(t), ["student_id", "course_id", "academic_year"],
                     ["enrollment_date", "o_orderkey", "l_linenumber", "l_suppkey"]) \
        .select("student_id", "course_id", "academic_year", "semester", "status", "enrollment_date")


def courses(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("course_id"), F.concat(F.lit("C"), _s(F.col("p_partkey"))).alias("course_code"),
        F.col("p_name").alias("title"), F.col("p_type").alias("kind"),
        (F.col("p_size") % 5 + 1).cast("decimal(3,1)").alias("credits"),
        (F.col("p_size") % 4 + 2).cast("int").alias("hours_per_week"))


def assignments(t: Tables) -> DataFrame:
    """Course assignments: distinct (course, teacher = supplier, term, section) of the order lines."""
    year, sem = _term(F.col("o_orderdate"))
    return _order_lines(t).select(
        F.col("l_partkey").alias("course_id"), F.col("l_suppkey").alias("faculty_id"), sem, year,
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("A")).otherwise(F.lit("B")).alias("section")).distinct()


def faculty(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("faculty_id"),
                             (F.lit(16) + F.col("s_suppkey") % 10).cast("int").alias("working_hours_per_week"))


def students(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("student_id"), F.col("c_nationkey").cast("long").alias("program_id"))


def raw_classrooms(t: Tables) -> DataFrame:
    """A classrooms upload built from ``supplier``: ';' equipment lists, booleans, a few bad cells."""
    k = F.col("s_suppkey")
    return t.supplier.select(
        (k + 2).alias("row_no"),
        F.when(k % 23 == 0, F.lit("")).otherwise(F.concat(F.lit("R"), _s(k))).alias("Room Code"),
        F.concat(F.lit("Block "), _s(F.col("s_nationkey") % 5)).alias("Building"),
        F.when(k % 19 == 0, F.lit("G")).otherwise(_s(k % 6)).alias("Floor"),
        _s(F.lit(20) + k % 60).alias("Capacity"),
        F.when(k % 5 == 0, F.lit("Lab")).otherwise(F.lit("Class")).alias("Type"),
        F.when(k % 4 == 0, "Projector;Whiteboard;AC").when(k % 4 == 1, " Computers ; Projector;;AC")
         .when(k % 4 == 2, "").otherwise("Audio System").alias("Equipment"),
        F.when(k % 3 == 0, "true").when(k % 3 == 1, "false").otherwise("").alias("Is Available"))


def raw_enrollments(t: Tables) -> DataFrame:
    """A student-enrolments upload: one row per order line, codes instead of ids."""
    d = F.col("o_orderdate")
    y = F.year(d)
    cust, part = F.col("o_custkey"), F.col("l_partkey")
    return _order_lines(t).select(
        F.when(cust % 41 == 0, F.concat(F.lit("X"), _s(cust))).otherwise(F.concat(F.lit("S"), _s(cust)))
         .alias("Student ID"),
        F.when(part % 53 == 0, F.concat(F.lit("c"), _s(part))).otherwise(F.concat(F.lit("C"), _s(part)))
         .alias("Course Code"),
        F.concat(_s(y), F.lit("-"), F.lpad(_s((y + 1) % 100), 2, "0")).alias("Academic Year"),
        F.when(F.month(d) <= 6, F.lit("2")).otherwise(F.lit("1")).alias("Semester"),
        F.date_format(d, "yyyy-MM-dd").alias("Enrollment Date"),
        F.when(F.col("l_returnflag") == "R", "dropped").when(F.col("l_returnflag") == "A", "completed")
         .otherwise("").alias("Status"))


def student_codes(t: Tables) -> DataFrame:
    return t.customer.select((F.col("c_custkey") + 1).alias("id"),
                             F.concat(F.lit("S"), _s(F.col("c_custkey"))).alias("student_id"))


def course_codes(t: Tables) -> DataFrame:
    return t.part.select((F.col("p_partkey") + 1).alias("id"),
                         F.concat(F.lit("C"), _s(F.col("p_partkey"))).alias("course_code"))

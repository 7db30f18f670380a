"""Catalogue: timetable analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timetable as tt
from ..session import stored
from . import fixtures as fx
from . import sql_fixtures as sq
from .catalog import query

_BASE = sq.with_(sq.ENTRIES, sq.ROOMS)


@query("clash_pairs", sq.with_(sq.ENTRIES, sq.PAIRS_SQL) + " SELECT * FROM pairs")
def clash_pairs(spark, t):
    """Room, teacher and section clash pairs (half-open overlap, a < b)."""
    return tt.clash_pairs(fx.timetable_entries(t))


@query("clash_flags", sq.with_(sq.ENTRIES, sq.PAIRS_SQL) + """
SELECT kind, timetable_id, dow, resource, entry_a AS entry_id FROM pairs
UNION
SELECT kind, timetable_id, dow, resource, entry_b FROM pairs""")
def clash_flags(spark, t):
    """The clashing entries of every kind by a sweep window (no pairs); G2 id set of C5."""
    return tt.clash_flags(fx.timetable_entries(t))


@query("timetable_quality", sq.with_(sq.ENTRIES, sq.PAIRS_SQL) + """,
n AS (SELECT timetable_id, count(*) AS entries FROM entries GROUP BY timetable_id),
c AS (SELECT timetable_id, count(*) FILTER (WHERE kind = 'room') AS room_clashes,
        count(*) FILTER (WHERE kind = 'faculty') AS faculty_clashes,
        count(*) FILTER (WHERE kind = 'section') AS section_clashes, count(*) AS clashes
      FROM pairs GROUP BY timetable_id)
SELECT n.timetable_id, n.entries, coalesce(room_clashes, 0) AS room_clashes,
  coalesce(faculty_clashes, 0) AS faculty_clashes, coalesce(section_clashes, 0) AS section_clashes,
  coalesce(clashes, 0) AS clashes,
  CAST(n.entries / (n.entries + coalesce(clashes, 0)) AS DECIMAL(10,4)) AS fitness_score
FROM n LEFT JOIN c USING (timetable_id)""")
def timetable_quality(spark, t):
    """Entries, clash counts by kind and a decimal(10,4) fitness score per timetable
    (counts from start/end histograms; the oracle counts the pairs themselves)."""
    return tt.quality(fx.timetable_entries(t))


@query("capacity_clash", _BASE + """
SELECT e.entry_id, e.room_id, 'over_capacity' AS kind, e.max_students AS need, r.capacity
FROM entries e JOIN rooms r USING (room_id) WHERE e.max_students > r.capacity
UNION ALL
SELECT e.entry_id, e.room_id, 'lab_in_non_lab_room', e.max_students, r.capacity
FROM entries e JOIN rooms r USING (room_id) WHERE e.entry_type = 'lab' AND r.type <> 'lab'""")
def capacity_clash(spark, t):
    """Over-capacity classes and labs in non-lab rooms."""
    return tt.capacity_clashes(fx.timetable_entries(t), fx.classrooms(t))


_FREE = """,
used AS (SELECT t.timetable_id, r.room_id FROM (SELECT DISTINCT timetable_id FROM entries) t
         CROSS JOIN (SELECT room_id FROM rooms WHERE is_available) r),
free AS (
  SELECT u.timetable_id, u.room_id, g.dow, g.slot_name, g.slot_start, g.slot_end, g.slot_type
  FROM used u JOIN grid g ON true
  WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.timetable_id = u.timetable_id AND e.dow = g.dow
                    AND e.room_id = u.room_id AND g.slot_start < e.end_sec AND e.start_sec < g.slot_end)
)"""


@query("free_slots", sq.with_(sq.ENTRIES, sq.ROOMS, sq.SLOTS) + _FREE + " SELECT * FROM free")
def free_slots(spark, t):
    """Free standard teaching slots of every available room per timetable, idle rooms included."""
    return tt.free_slots(fx.timetable_entries(t), fx.classrooms(t))


@query("suggest_slots", sq.with_(sq.ENTRIES, sq.ROOMS, sq.SLOTS, sq.PAIRS_SQL) + _FREE + """,
clashing AS (SELECT entry_a AS entry_id FROM pairs WHERE kind = 'room'
             UNION SELECT entry_b FROM pairs WHERE kind = 'room'),
f AS (SELECT free.*, r.capacity, r.type AS room_type FROM free JOIN rooms r USING (room_id)),
moving AS (
  SELECT entry_id, timetable_id, dow AS cur_dow, faculty_id, max_students, end_sec - start_sec AS length,
    CASE WHEN entry_type = 'lab' THEN 'lab' ELSE 'any' END AS fit
  FROM entries WHERE entry_id IN (SELECT entry_id FROM clashing)
),
cand AS (
  SELECT m.entry_id, m.cur_dow, m.faculty_id, f.* FROM moving m JOIN f
    ON f.timetable_id = m.timetable_id AND f.capacity >= m.max_students
      AND f.slot_end - f.slot_start >= m.length AND (m.fit = 'any' OR f.room_type = 'lab')
),
ok AS (
  SELECT * FROM cand c WHERE NOT EXISTS (
    SELECT 1 FROM entries o WHERE o.timetable_id = c.timetable_id AND o.dow = c.dow AND o.faculty_id = c.faculty_id
      AND o.entry_id <> c.entry_id AND c.slot_start < o.end_sec AND o.start_sec < c.slot_end)
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY (dow <> cur_dow), dow, slot_start,
    capacity DESC, room_id, slot_name) AS INTEGER) AS rank FROM ok
)
SELECT entry_id, rank, dow, slot_name, slot_start, slot_end, room_id, capacity FROM ranked WHERE rank <= 2""")
def suggest_slots(spark, t):
    """Two ranked moves (day, slot, room) for every entry in a room clash."""
    e = fx.timetable_entries(t).checkpoint(eager=True)   # read by five branches below
    rooms = fx.classrooms(t)
    clashing = tt.clash_flags(e, kinds=("room",)).select("entry_id")   # one room per entry: already unique
    return tt.suggest_slots(e, clashing, rooms, tt.free_slots(e, rooms), k=2)


def _hhmm(x):
    return f"lpad(CAST({x} // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({x} % 3600) // 60 AS VARCHAR), 2, '0')"


_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


@query("weekly_grid", sq.with_(sq.ENTRIES) + f"""
SELECT timetable_id, room_id, {_hhmm('start_sec')} || '-' || {_hhmm('end_sec')} AS time, start_sec,
  {", ".join(f"coalesce(string_agg(DISTINCT label, ' / ' ORDER BY label) FILTER (WHERE dow = {i + 1}), '') AS {d}"
             for i, d in enumerate(_DAYS))}
FROM (SELECT *, 'P' || CAST(course_id AS VARCHAR) || '-' || section AS label FROM entries)
GROUP BY timetable_id, room_id, start_sec, end_sec""")
def weekly_grid(spark, t):
    """D11 + B17: per room and timetable, a time x weekday grid of course-section labels."""
    e = fx.timetable_entries(t)
    label = F.concat(F.lit("P"), F.col("course_id").cast("string"), F.lit("-"), F.col("section"))
    return tt.weekly_grid(e, ["timetable_id", "room_id"], label)


@query("weekly_grid_long", sq.with_(sq.ENTRIES) + f"""
SELECT DISTINCT timetable_id, room_id, {_hhmm('start_sec')} || '-' || {_hhmm('end_sec')} AS time, start_sec, dow,
  CASE dow {" ".join(f"WHEN {i + 1} THEN '{d.capitalize()}'" for i, d in enumerate(_DAYS))} END AS weekday,
  'P' || CAST(course_id AS VARCHAR) || '-' || section AS label
FROM entries""")
def weekly_grid_long(spark, t):
    """D11 in long form: a row per room, time range, weekday and course-section label."""
    label = F.concat(F.lit("P"), F.col("course_id").cast("string"), F.lit("-"), F.col("section"))
    return tt.weekly_grid_long(fx.timetable_entries(t), ["timetable_id", "room_id"], label)


@query("overlap_runs", sq.with_(sq.ENTRIES, sq.PAIRS_SQL) + """,
uses AS (
  SELECT 'room' AS kind, timetable_id, dow, CAST(room_id AS VARCHAR) AS resource, entry_id, start_sec, end_sec FROM entries
  UNION ALL SELECT 'faculty', timetable_id, dow, CAST(faculty_id AS VARCHAR), entry_id, start_sec, end_sec FROM entries
  UNION ALL SELECT 'section', timetable_id, dow, CAST(course_id AS VARCHAR) || '/' || section, entry_id, start_sec, end_sec FROM entries),
marked AS (
  SELECT *, CASE WHEN start_sec < max(end_sec) OVER (PARTITION BY kind, timetable_id, dow, resource ORDER BY start_sec, entry_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS begins FROM uses),
islands AS (SELECT *, sum(begins) OVER (PARTITION BY kind, timetable_id, dow, resource ORDER BY start_sec, entry_id
    ROWS UNBOUNDED PRECEDING) AS run FROM marked),
met AS (SELECT i.kind, i.timetable_id, i.dow, i.resource, i.run, count(*) AS pairs
  FROM pairs p JOIN islands i ON i.kind = p.kind AND i.entry_id = p.entry_a GROUP BY ALL),
depth AS (SELECT kind, timetable_id, dow, resource, run, max(deep) AS deepest FROM (
  SELECT a.kind, a.timetable_id, a.dow, a.resource, a.run, a.start_sec, count(*) AS deep FROM
    (SELECT DISTINCT kind, timetable_id, dow, resource, run, start_sec FROM islands) a
    JOIN islands b USING (kind, timetable_id, dow, resource, run) WHERE b.start_sec <= a.start_sec AND a.start_sec < b.end_sec
  GROUP BY ALL) GROUP BY ALL)
SELECT kind, timetable_id, dow, resource, min(start_sec) AS start_sec, max(end_sec) AS end_sec, count(*) AS entries,
  any_value(pairs) AS pairs, any_value(deepest) AS deepest
FROM islands JOIN met USING (kind, timetable_id, dow, resource, run) JOIN depth USING (kind, timetable_id, dow, resource, run)
GROUP BY kind, timetable_id, dow, resource, run""")
def overlap_runs(spark, t):
    """C5 as runs: maximal stretches of overlapping entries a resource, with their pairs and greatest depth."""
    return tt.overlap_runs(fx.timetable_entries(t))


def _student_rows(t):
    """Live enrolments with the timetable of the student's program."""
    from ..operators.enrolment import live_enrolments
    own = fx.students(t).select("student_id", (F.col("program_id") % 4).alias("timetable_id"))
    return live_enrolments(fx.enrollments(t)).join(own, "student_id")


@query("student_timetable", sq.with_(sq.ENTRIES, sq.ENROLMENTS) + f""",
seats AS (
  SELECT e.student_id, e.course_id, e.academic_year, e.semester, CAST(c.c_nationkey % 4 AS BIGINT) AS timetable_id,
    s.sections[CAST(e.student_id % len(s.sections) AS INTEGER) + 1] AS section
  FROM (SELECT DISTINCT student_id, course_id, academic_year, semester FROM live) e
  JOIN customer c ON c.c_custkey = e.student_id
  JOIN (SELECT course_id, academic_year, semester, list_sort(list(DISTINCT section)) AS sections FROM assignments GROUP BY ALL) s
    USING (course_id, academic_year, semester)),
cells AS (
  SELECT DISTINCT seats.student_id, academic_year, semester, start_sec, end_sec, dow,
    'P' || CAST(course_id AS VARCHAR) || '-' || section || ' R' || CAST(room_id AS VARCHAR) AS label
  FROM seats JOIN entries USING (timetable_id, course_id, section))
SELECT student_id, academic_year, semester, {_hhmm('start_sec')} || '-' || {_hhmm('end_sec')} AS time, start_sec,
  {", ".join(f"coalesce(string_agg(label, ' / ' ORDER BY label) FILTER (WHERE dow = {i + 1}), '') AS {d}"
             for i, d in enumerate(_DAYS))}
FROM cells GROUP BY student_id, academic_year, semester, start_sec, end_sec""")
def student_timetable(spark, t):
    """D11 for students: every student's week in every term, cells of course, section and room."""
    entries = fx.timetable_entries(t).select("timetable_id", "dow", "room_id", "course_id", "section", "start_sec", "end_sec")
    e = tt.student_entries(_student_rows(t), fx.assignments(t), stored(entries, "entries"))
    label = F.concat(F.lit("P"), F.col("course_id").cast("string"), F.lit("-"), F.col("section"), F.lit(" R"),
                     F.col("room_id").cast("string"))
    return tt.weekly_grid(e, ["student_id", "academic_year", "semester"], label)


@query("entry_checks", """
WITH raw AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_orderkey % 9 AS INTEGER) AS dow,
    CAST((480 + (l_partkey % 24) * 30) * 60 AS INTEGER) AS start_sec,
    CAST((480 + (l_partkey % 24) * 30) * 60 + CASE WHEN l_linenumber % 4 = 0 THEN -1800 ELSE 3600 END AS INTEGER) AS end_sec,
    CASE l_linenumber % 5 WHEN 0 THEN 'lab' WHEN 1 THEN 'lecture' WHEN 2 THEN 'tutorial' WHEN 3 THEN 'break'
      ELSE 'seminar' END AS entry_type,
    CASE WHEN l_partkey % 50 = 0 THEN 'SECTION-TOO-LONG' ELSE 'A' END AS section
  FROM lineitem
)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, dow, start_sec, end_sec, entry_type, section,
  concat_ws(',',
    CASE WHEN NOT (dow BETWEEN 1 AND 7) THEN 'bad_dow' END,
    CASE WHEN NOT (start_sec < end_sec) THEN 'bad_time_range' END,
    CASE WHEN entry_type NOT IN ('lecture', 'lab', 'tutorial', 'break') THEN 'bad_entry_type' END,
    CASE WHEN length(section) > 10 THEN 'too_long_section' END) AS reasons
FROM raw""")
def entry_checks(spark, t):
    """B7 entry-type domain, B8 weekday range and start < end, B9 section length on raw timetable rows."""
    from ..contracts import ENTRY_TYPES
    from ..functions import checks as C
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    start = ((F.lit(480) + (p % 24) * 30) * 60).cast("int")
    raw = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_orderkey") % 9).cast("int").alias("dow"),
        start.alias("start_sec"),
        (start + F.when(n % 4 == 0, F.lit(-1800)).otherwise(F.lit(3600))).cast("int").alias("end_sec"),
        F.when(n % 5 == 0, "lab").when(n % 5 == 1, "lecture").when(n % 5 == 2, "tutorial").when(n % 5 == 3, "break")
        .otherwise("seminar").alias("entry_type"),
        F.when(p % 50 == 0, F.lit("SECTION-TOO-LONG")).otherwise(F.lit("A")).alias("section"))
    rules = C.reasons(
        C.check(F.col("dow").between(1, 7), "bad_dow"),
        C.check(F.col("start_sec") < F.col("end_sec"), "bad_time_range"),
        C.in_domain("entry_type", ENTRY_TYPES, "bad_entry_type"),
        C.max_len("section", 10, "too_long_section"))
    return raw.select("*", F.array_join(rules, ",").alias("reasons"))

"""Catalogue: enrolment analytics."""

from __future__ import annotations

from ..operators import enrolment as en
from . import fixtures as fx
from . import sql_fixtures as sq
from .catalog import query

_E = sq.with_(sq.ENROLMENTS)


@query("student_load", _E + """
SELECT student_id, academic_year, count(*) AS courses, CAST(sum(credits) AS DECIMAL(10,1)) AS credits
FROM live JOIN courses USING (course_id) GROUP BY student_id, academic_year""")
def student_load(spark, t):
    """Courses and credits per student and year over deduplicated, live enrolments."""
    return en.student_load(fx.enrollments(t), fx.courses(t))


@query("faculty_load", _E + """
SELECT a.faculty_id, a.academic_year, a.semester, count(*) AS sections, CAST(sum(c.hours_per_week) AS BIGINT) AS weekly_hours,
  CAST(16 + a.faculty_id % 10 AS INTEGER) AS hours_limit,
  sum(c.hours_per_week) > 16 + a.faculty_id % 10 AS over_limit,
  CASE WHEN sum(c.hours_per_week) > 16 + a.faculty_id % 10 THEN 'over'
       WHEN sum(c.hours_per_week) < 16 + a.faculty_id % 10 THEN 'under' ELSE 'at' END AS load_status
FROM assignments a JOIN courses c USING (course_id)
GROUP BY a.faculty_id, a.academic_year, a.semester""")
def faculty_load(spark, t):
    """Sections and weekly hours per teacher and term against the teacher's limit."""
    return en.faculty_load(fx.assignments(t), fx.courses(t), fx.faculty(t))


@query("roster", _E + """
SELECT DISTINCT a.faculty_id, l.student_id, l.course_id, l.academic_year, l.semester
FROM live l JOIN assignments a ON a.course_id = l.course_id AND a.semester = l.semester
  AND a.academic_year = l.academic_year""")
def roster(spark, t):
    """(teacher, student, course, term) rows without section fan-out."""
    return en.roster(fx.enrollments(t), fx.assignments(t))


@query("course_signature", _E + """
SELECT student_id, academic_year, semester, string_agg(code, '|' ORDER BY code) AS signature, count(*) AS kinds
FROM (SELECT DISTINCT student_id, academic_year, semester, 'C' || CAST(course_id AS VARCHAR) AS code FROM live)
GROUP BY student_id, academic_year, semester""")
def course_signature(spark, t):
    """Per student, year and semester, the sorted set of courses."""
    return en.course_signatures(fx.enrollments(t), fx.courses(t), "course_code")


def _assigned(t):
    sigs = en.course_signatures(fx.enrollments(t), fx.courses(t), "kind")
    return en.assign_batches(sigs, fx.students(t))


@query("assign_batches", _E + sq.SIGNATURES + " SELECT * FROM assigned")
def assign_batches(spark, t):
    """Batches of 20..60 students with equal program, year, semester and signature (here of course kinds)."""
    return _assigned(t)


@query("batch_rollup", _E + sq.SIGNATURES + """
SELECT program_id, academic_year, semester, pool, batch_no, count(*) AS total_students,
  CAST(academic_year AS INTEGER) AS start_year, CAST(academic_year AS INTEGER) + 4 AS end_year
FROM assigned GROUP BY program_id, academic_year, semester, pool, batch_no""")
def batch_rollup(spark, t):
    """Size and start/end year of every batch."""
    return en.batch_rollup(_assigned(t))


@query("batch_analysis", _E + sq.SIGNATURES + """
SELECT program_id, academic_year, semester, count(*) AS students, count(DISTINCT signature) AS signatures,
  count(*) FILTER (WHERE pool <> '*') AS full_group_students,
  count(DISTINCT (pool, batch_no)) AS batches,
  CAST(count(*) FILTER (WHERE pool <> '*') / count(*) AS DECIMAL(5,4)) AS full_group_share
FROM assigned GROUP BY program_id, academic_year, semester""")
def batch_analysis(spark, t):
    """Per program, year and semester, students, signatures, share in full-size groups, batches."""
    return en.batch_analysis(_assigned(t))

"""Enrolment analytics: C8 roster, D6 student load, D7 teacher load, D8 course signatures,
E1 batch assignment, D9 batch roll-up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

BATCH_MIN, BATCH_MAX = 20, 60


def live_enrolments(enrollments: DataFrame) -> DataFrame:
    """Enrolments that count: status other than 'dropped' (NULL counts, as in SQL)."""
    return enrollments.where(~F.coalesce(F.col("status") == "dropped", F.lit(False)))


def student_load(enrollments: DataFrame, courses: DataFrame) -> DataFrame:
    """Per student and academic year, courses taken and total credits (enrolments deduplicated
    on their key beforehand, so a course taught in two sections counts once)."""
    c = courses.select("course_id", "credits")
    return (live_enrolments(enrollments).join(c, "course_id")
            .groupBy("student_id", "academic_year")
            .agg(F.count(F.lit(1)).alias("courses"), F.sum("credits").cast("decimal(10,1)").alias("credits")))


def faculty_load(assignments: DataFrame, courses: DataFrame, faculty: DataFrame) -> DataFrame:
    """Per teacher and term, sections taught, weekly hours, the limit, an over-limit flag
    and the load status (over / under / at the limit)."""
    c = courses.select("course_id", "hours_per_week")
    load = (assignments.join(c, "course_id")
            .groupBy("faculty_id", "academic_year", "semester")
            .agg(F.count(F.lit(1)).alias("sections"), F.sum("hours_per_week").cast("long").alias("weekly_hours")))
    f = faculty.select("faculty_id", F.col("working_hours_per_week").alias("hours_limit"))
    return (load.join(f, "faculty_id", "left")
            .withColumn("over_limit", F.col("weekly_hours") > F.col("hours_limit"))
            .withColumn("load_status", F.when(F.col("weekly_hours") > F.col("hours_limit"), F.lit("over"))
                        .when(F.col("weekly_hours") < F.col("hours_limit"), F.lit("under"))
                        .when(F.col("hours_limit").isNotNull(), F.lit("at"))))


def roster(enrollments: DataFrame, assignments: DataFrame) -> DataFrame:
    """Who teaches whom: live enrolments x teachers of the course in the same term.

    Enrolments carry no section, so teachers are reduced to distinct
    (course, term, teacher) *before* the join; the join output is then the
    roster itself, with no section fan-out to remove afterwards.
    """
    teachers = assignments.select("course_id", "semester", "academic_year", "faculty_id").distinct()
    return (live_enrolments(enrollments).select("student_id", "course_id", "semester", "academic_year")
            .join(teachers, ["course_id", "semester", "academic_year"])
            .select("faculty_id", "student_id", "course_id", "academic_year", "semester"))


def course_signatures(enrollments: DataFrame, course_kind: DataFrame, kind_col: str) -> DataFrame:
    """Per (student, year, semester) the sorted distinct set of courses, joined by '|'.

    ``kind_col`` is what stands for a course: its code, or a coarser kind.
    Distinct rows first, so the collected set is bounded by the courses of one
    student and term, never by the number of enrolments.
    """
    kinds = (live_enrolments(enrollments).join(course_kind.select("course_id", kind_col), "course_id")
             .select("student_id", "academic_year", "semester", kind_col).distinct())
    return (kinds.groupBy("student_id", "academic_year", "semester")
            .agg(F.array_join(F.array_sort(F.collect_list(kind_col)), "|").alias("signature"),
                 F.count(F.lit(1)).alias("kinds")))


def ordinal_in_group(df: DataFrame, group: Sequence[str], order_col: str, parts: int | None = None) -> DataFrame:
    """1-based position of each row in its group ordered by ``order_col`` (unique), plus the group size.

    Rows are range-partitioned by (group, order), so a hot group lies in many
    partitions, whatever its ids look like (sparse, hashed, text). Each
    partition numbers its part of a group and adds the rows of the group in
    earlier partitions, from a count table with at most one row per partition
    and group. The partitioned rows are checkpointed, so a retry sees the same
    partitions. Adds ``rn`` and ``group_n``.
    """
    group = list(group)
    ensure_checkpoint_dir(df.sparkSession)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    b = (df.repartitionByRange(parts, *group, order_col).withColumn("_p", F.spark_partition_id()).checkpoint(eager=True))
    counts = b.groupBy(*group, "_p").agg(F.count(F.lit(1)).alias("_n"))
    wg = Window.partitionBy(*group)
    offs = counts.select(
        *group, "_p",
        F.coalesce(F.sum("_n").over(wg.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_off"),
        F.sum("_n").over(wg).alias("group_n"))
    local = b.withColumn("_rn", F.row_number().over(Window.partitionBy(*group, "_p").orderBy(order_col)))
    return (local.join(offs, [*group, "_p"])
            .withColumn("rn", (F.col("_off") + F.col("_rn")).cast("long"))
            .drop("_p", "_rn", "_off"))


def assign_batches(signatures: DataFrame, students: DataFrame, lo: int = BATCH_MIN, hi: int = BATCH_MAX) -> DataFrame:
    """Split students of equal (program, year, semester, signature) into batches of lo..hi.

    Signature groups smaller than ``lo`` go to the program's pool '*'. A pool
    of n students gets k = ceil(n / hi) batches and the student at position
    rn (by id) gets batch (rn-1)*k div n, so sizes differ by at most one and
    stay within lo..hi for every n >= lo. Pools under ``lo`` are flagged.
    """
    # the input feeds two branches (group sizes, rows); a reliable checkpoint in
    # the shared folder computes it once and cuts the lineage back to the join
    ensure_checkpoint_dir(signatures.sparkSession)
    s = signatures.join(students.select("student_id", "program_id"), "student_id").checkpoint(eager=True)
    term = ["program_id", "academic_year", "semester"]
    key = [*term, "signature"]
    sizes = s.groupBy(*key).agg(F.count(F.lit(1)).alias("_sig_n"))
    # join, not a window count: a hot signature group is not gathered in one
    # task; AQE turns the join into a broadcast at run time when ``sizes`` is small
    pooled = (s.join(sizes, key)
              .withColumn("pool", F.when(F.col("_sig_n") >= lo, F.col("signature")).otherwise(F.lit("*")))
              .drop("_sig_n"))
    r = ordinal_in_group(pooled, [*term, "pool"], "student_id")
    batch = F.expr(f"cast((rn - 1) * ((group_n + {hi - 1}) div {hi}) div group_n as int)")
    return r.select(
        "student_id", *term, "signature", "pool", F.col("group_n").alias("pool_size"), batch.alias("batch_no"),
        (F.col("group_n") < lo).alias("undersized"))


def batch_rollup(assigned: DataFrame, duration_years: int = 4) -> DataFrame:
    """Per batch its size and start/end year (the batches table's totals)."""
    return (assigned.groupBy("program_id", "academic_year", "semester", "pool", "batch_no")
            .agg(F.count(F.lit(1)).alias("total_students"))
            .withColumn("start_year", F.col("academic_year").cast("int"))
            .withColumn("end_year", F.col("start_year") + duration_years))


def batch_analysis(assigned: DataFrame, lo: int = BATCH_MIN) -> DataFrame:
    """Per program, year and semester: students, distinct signatures, students in full-size
    signature groups and their share, and the number of batches."""
    return (assigned.groupBy("program_id", "academic_year", "semester")
            .agg(F.count(F.lit(1)).alias("students"),
                 F.count_distinct("signature").alias("signatures"),
                 F.count_if(F.col("pool") != "*").alias("full_group_students"),
                 F.count_distinct("pool", "batch_no").alias("batches"))
            .withColumn("full_group_share",
                        (F.col("full_group_students") / F.col("students")).cast("decimal(5,4)")))

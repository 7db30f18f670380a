"""Timetable and enrolment invariants (golden seed slots, E2 = C5 ids, batch sizes, diff of equal snapshots)."""

import pytest
from pyspark.sql import functions as F

from acadspark.operators import enrolment as en
from acadspark.operators import timetable as tt
from acadspark.operators.quality import diff
from acadspark.plans import fixtures as fx
from acadspark.sources.tables import Tables

from conftest import SF_SMALL


def seed_slot_entries(spark):
    rows = [(f"s{i}", 1, 1, 1, 1, 1, "A", s, e, t, 30) for i, (_, s, e, t) in enumerate(tt.STANDARD_SLOTS)]
    return spark.createDataFrame(
        rows, "entry_id string, timetable_id long, dow int, room_id long, faculty_id long, course_id long, "
              "section string, start_sec int, end_sec int, entry_type string, max_students int")


def test_seed_slots_have_six_overlaps(spark):
    # Lab 1 x Periods 1-3 and Lab 2 x Periods 4-6; lunch only touches its neighbours
    pairs = tt.clash_pairs(seed_slot_entries(spark), kinds=("room",)).collect()
    assert len(pairs) == 6
    names = {"s7", "s8"}   # the two lab sessions
    assert all(p.entry_a in names or p.entry_b in names for p in pairs)


def test_flags_equal_pair_ids(spark):
    e = fx.timetable_entries(Tables(spark, SF_SMALL))
    for bin_sec in (900, 3600, 86400):
        pairs = tt.clash_pairs(e, bin_sec=bin_sec)
        ids = (pairs.select("kind", F.col("entry_a").alias("entry_id"))
               .union(pairs.select("kind", F.col("entry_b").alias("entry_id"))).distinct())
        flags = tt.clash_flags(e, bin_sec=bin_sec).select("kind", "entry_id")
        assert ids.exceptAll(flags).count() == 0 and flags.exceptAll(ids).count() == 0


def test_pairs_independent_of_bin_width(spark):
    e = fx.timetable_entries(Tables(spark, SF_SMALL))
    a = tt.clash_pairs(e, bin_sec=600)
    b = tt.clash_pairs(e, bin_sec=7200)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_batch_sizes_within_bounds(spark):
    t = Tables(spark, SF_SMALL)
    sigs = en.course_signatures(fx.enrollments(t), fx.courses(t), "kind")
    assigned = en.assign_batches(sigs, fx.students(t))
    sizes = (assigned.where(~F.col("undersized")).groupBy("program_id", "academic_year", "pool", "batch_no")
             .count().agg(F.min("count"), F.max("count")).first())
    if sizes[0] is not None:
        assert 20 <= sizes[0] and sizes[1] <= 60
    assert assigned.count() == sigs.count()


def test_ordinal_in_group_matches_row_number(spark):
    from pyspark.sql import Window
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5000).alias("k"))
    got = en.ordinal_in_group(df, ["g"], "k", parts=37)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k")).cast("long"))
    assert got.select("g", "k", "rn").exceptAll(ref.select("g", "k", "rn")).count() == 0


def test_diff_of_equal_snapshots_is_empty(spark):
    s = Tables(spark, SF_SMALL).supplier
    assert diff(s, s, ["s_suppkey"]).count() == 0


def test_free_slot_never_overlaps_entry(spark):
    t = Tables(spark, SF_SMALL)
    e = fx.timetable_entries(t)
    free = tt.free_slots(e, fx.classrooms(t))
    clash = free.join(e, ["timetable_id", "room_id", "dow"]).where(
        (F.col("slot_start") < F.col("end_sec")) & (F.col("start_sec") < F.col("slot_end")))
    assert clash.count() == 0


def test_integrity_report_over_record_schema(spark):
    from acadspark.operators.quality import integrity_report
    departments = spark.createDataFrame([(1, "CSE", None), (2, "ECE", 5), (3, "CSE", None)],
                                        "id long, code string, head_of_department long")
    users = spark.createDataFrame([(5, "a@u.edu"), (6, "a@u.edu")], "id long, email string")
    programs = spark.createDataFrame([(1, "P1", 1), (2, "P2", 9), (3, "P3", None)],
                                     "id long, code string, department_id long")
    rep = {(r.check, r.table_name, r.columns, r.value, r.n_rows)
           for r in integrity_report({"departments": departments, "users": users, "programs": programs}).collect()}
    assert rep == {("foreign_key", "programs", "department_id", "9", 1),
                   ("unique", "departments", "code", "CSE", 2), ("unique", "users", "email", "a@u.edu", 2)}


def test_integrity_report_reads_every_table_once(spark, tmp_path):
    from acadspark.operators.quality import integrity_report
    made = {
        "courses": ([(1, "a,b"), (2, "a"), (None, None), (None, None)], "id int, course_code string"),
        # parts with commas are different keys; a NULL part is no key; NULL and repeated references
        "course_prerequisites": ([(1, 2), (1, 2), (2, 7), (None, 7), (7, None), (None, None)],
                                 "course_id long, prerequisite_id long"),
        "course_assignments": ([(1, None, 1, "x,y", "z"), (1, None, 1, "x", "y,z"), (9, 3, 1, "x", "z"), (9, 3, 1, "x", "z")],
                               "course_id long, faculty_id long, semester int, academic_year string, section string"),
        "faculty": ([], "id long, user_id long, employee_id string"),
    }
    tables = {}
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
        tables[name] = spark.read.parquet(f"{tmp_path}/{name}")
    report = integrity_report(tables)
    assert sorted(tuple(r) for r in report.collect()) == [
        ("foreign_key", "course_assignments", "course_id", "9", 2),
        ("foreign_key", "course_assignments", "faculty_id", "3", 2),
        ("foreign_key", "course_prerequisites", "course_id", "7", 1),
        ("foreign_key", "course_prerequisites", "prerequisite_id", "7", 2),
        ("unique", "course_assignments", "course_id,faculty_id,semester,academic_year,section", "9,3,1,x,z", 2),
        ("unique", "course_prerequisites", "course_id,prerequisite_id", "1,2", 2)]
    plan = report._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == len(made) and "Join" not in plan
    with pytest.raises(ValueError):
        integrity_report({"classrooms_of_others": tables["faculty"]})


def test_reversed_interval_never_clashes(spark):
    e = spark.createDataFrame(
        [("a", 1, 1, 1, 1, 1, "A", 36000, 18000), ("b", 1, 1, 1, 1, 1, "A", 0, 72000)],
        "entry_id string, timetable_id long, dow int, room_id long, faculty_id long, course_id long, "
        "section string, start_sec int, end_sec int")
    assert tt.clash_pairs(e).count() == 0 and tt.clash_flags(e).count() == 0


def test_clash_counts_equal_pair_counts(spark):
    e = fx.timetable_entries(Tables(spark, SF_SMALL))
    counts = tt.clash_counts(e).where(F.col("pairs") > 0)
    ref = tt.clash_pairs(e).groupBy("kind", "timetable_id", "dow", "resource").agg(F.count(F.lit(1)).alias("pairs"))
    assert counts.exceptAll(ref).count() == 0 and ref.exceptAll(counts).count() == 0
    assert tt.quality(e).exceptAll(tt.quality(e, tt.clash_pairs(e))).count() == 0


def test_free_slots_and_suggestions_on_own_slots(spark):
    """Idle rooms, an inactive slot, a three-hour lab, an entry without a teacher; against all combinations."""
    h = 3600
    slots = [("S1", 8 * h, 9 * h, "lecture", True), ("S2", 9 * h, 10 * h, "lecture", True), ("S3", 10 * h, 11 * h, "lecture", False),
             ("L1", 8 * h, 11 * h, "lab", True), ("L2", 13 * h, 16 * h, "lab", True), ("Break", 11 * h, 12 * h, "lunch", True)]
    rooms = [(1, 30, "class", True), (2, 60, "lab", True), (3, 90, "class", False), (4, 10, "lab", True)]
    entries = [("a", 1, 1, 1, 7, 8 * h, 9 * h, 20, "lecture"), ("b", 1, 1, 1, None, 8 * h, 9 * h, 20, "lecture"),
               ("c", 1, 1, 2, 8, 13 * h, 16 * h, 50, "lab"), ("d", 1, 2, 2, 8, 8 * h, 11 * h, 50, "lab"),
               ("e", 1, 1, 2, 9, 13 * h, 16 * h, 5, "lab"), ("f", 1, 1, 1, 7, 9 * h, 10 * h, 20, "lecture")]
    e = spark.createDataFrame([(*x[:5], f"c{x[0]}", "A", *x[5:]) for x in entries],
                              "entry_id string, timetable_id long, dow int, room_id long, faculty_id long, course_id string, section string, "
                              "start_sec int, end_sec int, max_students int, entry_type string")
    r = spark.createDataFrame(rooms, "room_id long, capacity int, type string, is_available boolean")
    s = spark.createDataFrame(slots, "slot_name string, start_sec int, end_sec int, slot_type string, is_active boolean")
    cells = [(d, n, a, b) for d in range(1, 8) for n, a, b, kind, on in slots if on and kind in ("lecture", "lab")]
    free = {(room, d, n) for room, _, _, ok in rooms if ok for d, n, a, b in cells
            if not any(x[3] == room and x[2] == d and a < x[6] and x[5] < b for x in entries)}
    found = tt.free_slots(e, r, s)
    assert {(x.room_id, x.dow, x.slot_name) for x in found.collect()} == free and {x[0] for x in free} == {1, 2, 4}
    clashing = tt.clash_flags(e, kinds=("room",)).select("entry_id").distinct()
    got = {}
    for x in tt.suggest_slots(e, clashing, r, found, k=3, slots=s).collect():
        got.setdefault(x.entry_id, []).append((x["rank"], x.dow, x.slot_name, x.room_id))
    want = {}
    for i, _, day, _, teacher, a0, b0, size, kind in entries:
        if i not in ("a", "b", "c", "e"):
            continue
        best = sorted(((d != day), d, a, -cap, room, n) for d, n, a, b in cells for room, cap, typ, _ in rooms
                      if (room, d, n) in free and cap >= size and (kind != "lab" or typ == "lab") and b - a >= b0 - a0
                      and not any(y[0] != i and teacher is not None and y[4] == teacher and y[2] == d and a < y[6] and y[5] < b
                                  for y in entries))[:3]
        want[i] = [(k + 1, x[1], x[5], x[4]) for k, x in enumerate(best)]
    assert {i: sorted(x) for i, x in got.items()} == want


def test_runs_hold_all_pairs(spark):
    e = fx.timetable_entries(Tables(spark, SF_SMALL))
    runs, pairs = tt.overlap_runs(e), tt.clash_pairs(e)
    key = ["kind", "timetable_id", "dow", "resource"]
    a = runs.groupBy(*key).agg(F.sum("pairs").alias("pairs"))
    b = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("pairs"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    got = [tuple(r) for r in tt.overlap_runs(seed_slot_entries(spark), kinds=("room",)).select(
        "start_sec", "end_sec", "entries", "pairs", "deepest").collect()]
    h = 3600
    # Lab 1 with periods 1 to 3, which ends after it; Lab 2 with periods 4 to 6; lunch touches both and overlaps none
    assert sorted(got) == [(9 * h, 12 * h + 1800, 4, 3, 2), (13 * h + 1800, 17 * h, 4, 3, 2)]


def test_students_sit_in_one_section_of_each_course(spark):
    enrol = spark.createDataFrame([(s, c, 1, "2024", 1) for s in range(6) for c in (10, 11)] + [(0, 12, 1, "2024", 1), (0, 10, 1, "2024", 1)],
                                  "student_id long, course_id long, timetable_id long, academic_year string, semester int")
    asg = spark.createDataFrame([(10, "A", 1), (10, "B", 2), (10, "B", 3), (10, "C", 3), (11, "A", 1)],
                                "course_id long, section string, faculty_id long").selectExpr("*", "'2024' academic_year", "1 semester")
    entries = spark.createDataFrame([(1, c, sec, d) for c in (10, 11) for sec in "ABC" for d in (1, 2)] + [(2, 10, "A", 5)],
                                    "timetable_id long, course_id long, section string, dow int")
    got = sorted((r.student_id, r.course_id, r.section, r.dow) for r in tt.student_entries(enrol, asg, entries).collect())
    assert got == sorted([(s, 10, "ABC"[s % 3], d) for s in range(6) for d in (1, 2)] + [(s, 11, "A", d) for s in range(6) for d in (1, 2)])

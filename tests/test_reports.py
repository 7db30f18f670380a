"""Reports on the seed rows of the record schema (setup check, statistics, seed time slots)."""

import os

from pyspark.sql import functions as F

from acadspark.operators import timetable as tt
from acadspark.operators.contract import apply_contract
from acadspark.operators.report import entity_stats, recent, setup_check
from acadspark.sources.csv import scan_csv

def clock(sec):
    return f"{sec // 3600:02}:{sec % 3600 // 60:02}:00"


# fixed value: the upload's header line; the rows are the standard slots
SEED_SLOTS = "Slot Name,Start Time,End Time,Duration Minutes,Slot Type,Is Active\n" + "".join(
    f"{name},{clock(a)},{clock(b)},{(b - a) // 60},{kind},true\n" for name, a, b, kind in tt.STANDARD_SLOTS)


def seed_tables(spark):
    n = lambda k: spark.range(k).withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    return {"users": n(1), "departments": n(5), "programs": n(5), "academic_terms": n(3), "time_slots": n(9),
            "students": n(0), "faculty": n(0), "courses": n(0), "classrooms": n(0)}


def test_setup_check_on_seeds(spark):
    got = [tuple(r) for r in setup_check(seed_tables(spark)).collect()]
    assert got == [("users", 1), ("departments", 5), ("programs", 5), ("academic_terms", 3), ("time_slots", 9),
                   ("students", 0), ("faculty", 0), ("courses", 0), ("classrooms", 0)]


def test_entity_stats_skip_soft_deleted(spark):
    t = seed_tables(spark)
    students = spark.range(4).withColumn(
        "deleted_at", F.when(F.col("id") == 0, F.lit("2024-01-01").cast("timestamp_ntz")))
    row = entity_stats(t["departments"], t["courses"], students, t["faculty"], t["classrooms"]).first()
    assert tuple(row) == (5, 0, 3, 0, 0)
    assert row.asDict()["subjects"] == 0     # courses are reported as 'subjects'


def test_seed_time_slots_load_and_clash(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "slots.csv"), "w") as f:
        f.write(SEED_SLOTS)
    rows = apply_contract(scan_csv(spark, tmp_dir), "time_slots")
    assert rows.where(F.size("reasons") > 0).count() == 0
    e = rows.select(F.col("slot_name").alias("entry_id"), F.lit(1).cast("long").alias("timetable_id"),
                    F.lit(1).alias("dow"), F.lit(1).cast("long").alias("room_id"), "start_sec", "end_sec")
    pairs = {tuple(sorted((r.entry_a, r.entry_b))) for r in tt.clash_pairs(e, kinds=("room",)).collect()}
    assert pairs == {tuple(sorted((x[0], y[0]))) for x in tt.STANDARD_SLOTS for y in tt.STANDARD_SLOTS
                     if x[0] < y[0] and x[1] < y[2] and y[1] < x[2]}
    assert len(pairs) == 6


def test_recent_keeps_five_newest(spark):
    log = spark.createDataFrame([(i, f"2024-01-0{i % 9 + 1} 00:00:00", f"t{i}") for i in range(20)],
                                "run_id int, ts string, type string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [r.run_id for r in recent(log, "ts", "run_id", 5).collect()]
    assert got == [8, 17, 7, 16, 6]

"""Operators stay exact when one key holds a third of all rows (hot room, hot group, hot key)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from acadspark.operators import enrolment as en
from acadspark.operators import timetable as tt
from acadspark.operators.upsert import last_wins


def skewed_entries(spark, n=3000):
    # a third of all entries sit in room 0 on the same day; the rest spread over 50 rooms
    df = spark.range(n).select(
        F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("entry_id"),
        F.lit(0).cast("long").alias("timetable_id"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise((F.col("id") % 7 + 1)).cast("int").alias("dow"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50 + 1).cast("long").alias("room_id"),
        (F.col("id") % 40).alias("faculty_id"), (F.col("id") % 90).alias("course_id"), F.lit("A").alias("section"),
        ((F.lit(480) + (F.col("id") * 7919 % 600)) * 60).cast("int").alias("start_sec"))
    return df.withColumn("end_sec", (F.col("start_sec") + F.lit(3600) + (F.col("entry_id").substr(5, 1).cast("int") * 300))
                         .cast("int"))


def brute_pairs(e):
    a, b = e.alias("a"), e.alias("b")
    return (a.join(b, (F.col("a.timetable_id") == F.col("b.timetable_id")) & (F.col("a.dow") == F.col("b.dow"))
                   & (F.col("a.room_id") == F.col("b.room_id")) & (F.col("a.entry_id") < F.col("b.entry_id"))
                   & (F.col("a.start_sec") < F.col("b.end_sec")) & (F.col("b.start_sec") < F.col("a.end_sec")))
            .select(F.col("a.entry_id").alias("entry_a"), F.col("b.entry_id").alias("entry_b")))


def test_clash_pairs_exact_under_hot_room(spark):
    e = skewed_entries(spark)
    got = tt.clash_pairs(e, kinds=("room",), bin_sec=1800).select("entry_a", "entry_b")
    ref = brute_pairs(e)
    assert got.count() == ref.count() > 0 and got.exceptAll(ref).count() == 0


def test_clash_flags_exact_under_hot_room(spark):
    e = skewed_entries(spark)
    flags = tt.clash_flags(e, kinds=("room",), bin_sec=1800).select("entry_id")
    ref = brute_pairs(e)
    ids = ref.select(F.col("entry_a").alias("entry_id")).union(ref.select("entry_b")).distinct()
    assert flags.count() == ids.count() and flags.exceptAll(ids).count() == 0


def test_ordinal_in_hot_group(spark):
    # sparse, hashed text ids: their values say nothing about how many lie between
    df = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97 + 1).alias("g"), F.md5(F.col("id").cast("string")).alias("k"))
    got = en.ordinal_in_group(df, ["g"], "k", parts=16).select("g", "k", "rn", "group_n")
    w = Window.partitionBy("g")
    ref = df.select("g", "k", F.row_number().over(w.orderBy("k")).cast("long").alias("rn"),
                    F.count(F.lit(1)).over(w).alias("group_n"))
    assert got.exceptAll(ref).count() == 0 and got.count() == 30000


def test_counts_beyond_53_bits(spark):
    # n starts and n ends at one time: n (n - 1) / 2 pairs, exactly
    n = 300_000_001
    row = spark.createDataFrame([(n,)], "n long")
    got = row.selectExpr("n * n as _sc", "n as _n").select(
        F.expr("cast(_sc - cast(_n as decimal(20,0)) * (_n + 1) div 2 as bigint)")).first()[0]
    assert got == n * (n - 1) // 2


def test_last_wins_hot_key(spark):
    df = spark.range(0, 20000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id").alias("ord"), (F.col("id") * 2).alias("v"))
    got = {r.k: r.v for r in last_wins(df, ["k"], ["ord"]).where("k = 'hot'").collect()}
    assert got == {"hot": 2 * 19998}

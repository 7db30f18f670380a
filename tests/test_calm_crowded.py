"""Clash operators deal calm resources by key and crowded ones by time: same results, and fewer rows exchanged."""

from collections import Counter

from pyspark.sql import functions as F

from acadspark.operators import timetable as tt

from test_skew import brute_pairs, skewed_entries

KEY = ["kind", "timetable_id", "dow", "resource"]


def odd_entries(spark):
    # a crowded room, NULL keys, resources and times, an id that comes twice, reversed and long intervals
    e = skewed_entries(spark, 600)
    odd = spark.createDataFrame(
        [("x1", None, 1, 0, 1, 1, "A", 36000, 40000), ("x2", None, 1, 0, 1, 1, "A", 36000, 40000), ("x3", 0, None, 0, 1, 1, "A", 36000, 40000),
         ("x4", 0, 1, None, None, None, "A", 36000, 40000), ("x5", 0, 1, 0, 1, 1, None, 40000, 36000), ("x6", 0, 1, 0, 1, 1, "A", None, 40000),
         ("x7", 0, 2, 5, 1, 1, "A", 0, 86400), ("x7", 0, 2, 5, 1, 1, "A", 100, 86400), ("x8", 0, 2, 5, 1, 1, "A", 100, 200)],
        "entry_id string, timetable_id long, dow int, room_id long, faculty_id long, course_id long, section string, "
        "start_sec int, end_sec int")
    return e.unionByName(odd).localCheckpoint()


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_calm_and_crowded_give_the_same(spark, monkeypatch):
    e = odd_entries(spark)
    twice = e.unionByName(e.where("entry_id < 'e00020' or entry_id = 'x1'")).localCheckpoint()
    made = []
    for limit in (20_000, 40):   # all calm; the busy room crowded
        monkeypatch.setattr(tt, "CROWDED_ROWS", limit)
        calm, crowded = (x.select(*KEY).distinct() for x in tt.split_crowded(tt.resource_rows(e, ("room", "faculty", "section"))))
        assert not set(rows_of(calm)) & set(rows_of(crowded)) and calm.count() > 0 and (crowded.count() > 0) == (limit == 40)
        made.append([rows_of(f(x)) for x in (e, twice) for f in (tt.clash_pairs, tt.clash_flags, tt.clash_counts, tt.overlap_runs)])
    assert made[0] == made[1]
    pairs, flags, counts, runs = made[0][:4]
    rooms = Counter((r[4], r[5]) for r in pairs.elements() if r[0] == "room" and r[4] != r[5])
    assert rooms == rows_of(brute_pairs(e.where("start_sec < end_sec"))) and len(rooms) > 1000
    n = Counter(r[:4] for r in pairs.elements())
    assert n == {r[:4]: r[4] for r in counts if r[4] and None not in r[:4]}
    of_runs, of_flags = Counter(), Counter(r[:4] for r in flags.elements())
    pairs_of_runs = Counter()
    for kind, table, day, resource, _, _, entries, met, _ in runs:
        if table is not None and day is not None:
            of_runs[kind, table, day, resource] += entries
            pairs_of_runs[kind, table, day, resource] += met
    assert of_runs == of_flags and pairs_of_runs == n


def test_calm_pairs_share_one_exchange_without_bins(spark):
    plan = final_plan(tt.clash_pairs(odd_entries(spark)))
    assert "ReusedExchange" in plan and "_bin" not in plan


def test_calm_flags_meet_no_summary(spark):
    assert "Join" not in final_plan(tt.clash_flags(odd_entries(spark)))


def test_calm_runs_and_counts_are_one_exchange(spark):
    for df in (tt.overlap_runs(odd_entries(spark)), tt.clash_counts(odd_entries(spark))):
        assert final_plan(df).count("Exchange ") == 1


def test_grid_is_one_exchange(spark):
    e = spark.createDataFrame([(1, 1, 0, 60, "b"), (1, 1, 0, 60, "a"), (1, 1, 0, 60, "a"), (1, 3, 0, 60, None), (2, None, 0, 60, "c"),
                               (3, 9, 0, 60, "d"), (None, 7, 0, 60, "z"), (1, 7, 0, 120, "q")],
                              "owner long, dow int, start_sec int, end_sec int, l string")
    df = tt.weekly_grid(e, ["owner"], F.col("l"))
    assert final_plan(df).count("Exchange ") == 1
    got = {(r.owner, r.time): tuple(r)[3:] for r in df.collect()}
    assert got == {(1, "00:00-00:01"): ("a / b", "", "", "", "", "", ""), (2, "00:00-00:01"): ("",) * 7, (3, "00:00-00:01"): ("",) * 7,
                   (None, "00:00-00:01"): ("",) * 6 + ("z",), (1, "00:00-00:02"): ("",) * 6 + ("q",)}


def test_suggestions_look_up_class_sizes_once(spark):
    rows = [(f"e{i}", 1, d, 1, None, f"c{i}", "A", 36000, 39600, size, "lecture") for i, (d, size) in enumerate(
        [(1, 20), (1, 20), (1, 50), (7, 20), (7, None), (9, 20), (9, 20), (1, 500)])]
    e = spark.createDataFrame(rows, "entry_id string, timetable_id long, dow int, room_id long, faculty_id long, course_id string, "
                                    "section string, start_sec int, end_sec int, max_students int, entry_type string")
    rooms = spark.createDataFrame([(1, 30, "class", True), (2, 60, "lab", True)], "room_id long, capacity int, type string, is_available boolean")
    slots = [("S1", 28800, 32400, "lecture"), ("S2", 36000, 39600, "lecture")]
    df = tt.suggest_slots(e, e.select("entry_id"), rooms, tt.free_slots(e, rooms, slots), k=3, slots=slots)
    assert final_plan(df).count("fits#") == 1   # a column of the saved table, not searched for an entry
    got = {}
    for x in df.collect():
        got.setdefault(x.entry_id, []).append((x["rank"], x.dow, x.slot_name, x.room_id))
    monday = [(1, 1, "S1", 2), (2, 1, "S1", 1), (3, 1, "S2", 2)]
    assert {i: sorted(x) for i, x in got.items()} == {
        "e0": monday, "e1": monday, "e2": [(1, 1, "S1", 2), (2, 1, "S2", 2), (3, 2, "S1", 2)],
        "e3": [(1, 7, "S1", 2), (2, 7, "S1", 1), (3, 7, "S2", 2)], "e5": monday, "e6": monday}


def test_student_grid_keeps_the_shuffles_of_one_step(spark):
    enrol = spark.createDataFrame([(1, 10, 0, "2024", 1), (1, 10, 0, "2024", 1), (2, 10, 0, "2024", 1), (3, 11, 0, "2024", 1)],
                                  "student_id long, course_id long, timetable_id long, academic_year string, semester int")
    asg = spark.createDataFrame([(10, "A", "2024", 1), (10, "B", "2024", 1), (10, "B", "2024", 1), (12, "A", "2024", 1)],
                                "course_id long, section string, academic_year string, semester int")
    entries = spark.createDataFrame([(0, 10, s, d, 60, 120) for s, d in [("A", 1), ("B", 2), ("B", 7), ("B", 7)]],
                                    "timetable_id long, course_id long, section string, dow int, start_sec int, end_sec int")
    df = tt.weekly_grid(tt.student_entries(enrol, asg, entries), ["student_id"], F.concat(F.lit("P"), F.col("section")))
    plan = final_plan(df)
    assert plan.count("Exchange ") <= 3  # seats, entries and the grid; enrolments and sections are done by then
    assert "_sections" not in plan
    assert sorted(tuple(r)[3:] for r in df.collect()) == [("", "PB", "", "", "", "", "PB"), ("PA",) + ("",) * 6]


def test_last_row_is_shuffled_once(spark):
    from acadspark.operators.upsert import last_wins
    df = spark.createDataFrame([(1, 5, "a", None), (1, 7, "b", 2), (1, 7, "b", 1), (None, None, "c", 3), (None, 1, None, None)],
                               "k long, at int, v string, w int")
    got = last_wins(df, ["k"], ["at"])
    assert "max_by" not in final_plan(got)
    assert got.columns == ["k", "at", "v", "w"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == ["(1, 7, 'b', 2)", "(None, 1, None, None)"]

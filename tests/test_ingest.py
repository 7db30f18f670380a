"""Ingest pipeline tests: CSV source + row numbers, contract, rejects, last row wins, upsert, report, stream."""

import datetime as dt
import os
import time

from pyspark.sql import functions as F

from acadspark.operators.contract import apply_contract, split_valid
from acadspark.operators.ingest import load
from acadspark.operators.report import import_report
from acadspark.operators.upsert import assign_ids, last_wins, upsert
from acadspark.sources.csv import scan_csv
from acadspark.sources.sinks import read_current
from acadspark.streaming.ingest import ingest_stream

DEPARTMENTS_TEMPLATE = (
    "Code,Name,Description,Head of Department Email\n"  # fixed value: the upload's header line
    "GEO,Geology,Rocks and soils,geo@uni.example\n"
    "MUS,Music and Sound,,\n"
    "ZOO,Zoology,Animals,zoo@uni.example\n")

EDGE_DEPARTMENTS = (
    "Code,Name,Department,Description\n"
    ",,Physics,\n"                                   # row 2: name from the Department alias, code derived
    ",Computer Science and Engineering,,\n"          # row 3: COMPUT
    ",Electrical,,first\n"                           # row 4: ELECTR ...
    ",Electronics,,second\n"                         # row 5: ... overwritten by Electronics
    ",123,,\n"                                       # row 6: code not derivable
    "ABCDEFGHIJK,Too Long,,\n"                       # row 7: 11 characters
    " CIV\t,  Civil  ,,\"a, quoted\"\n"         # row 8: NBSP/tab stripped, quoted comma
    ",,,\n")                                         # row 9: missing name

TERMS = (
    "Name,Start Date,End Date,Academic Year,Status\n"
    "Fall 2024,1-2-2024,20-12-2024,2024-25,\n"       # status default
    "Spring 2025,01/02/2024,15-05-2025,2024-25,  \n" # blank status -> '' -> domain failure
    "Summer 2025,2024-2-1,31-07-2025,2024-25,done\n" # bad status
    "Winter,31-02-2024,01-03-2024,2024-25,active\n"  # impossible date
    "Bad,n/a,01-03-2024,2024-25,active\n")           # unknown format


def write(dir_, name, text):
    os.makedirs(dir_, exist_ok=True)
    with open(os.path.join(dir_, name), "w", encoding="utf-8") as f:
        f.write(text)


def test_template_departments_load(spark, tmp_dir):
    write(tmp_dir, "departments.csv", DEPARTMENTS_TEMPLATE)
    res = load(scan_csv(spark, tmp_dir), "departments", None, "2025-01-01 00:00:00")
    rows = sorted((r.id, r.code, r.name) for r in res.table.collect())
    assert rows == [(1, "GEO", "Geology"), (2, "MUS", "Music and Sound"), (3, "ZOO", "Zoology")]
    rep = res.report.first()
    assert (rep.total_rows, rep.success_count, rep.error_count, rep.errors, rep.has_more_errors) == (3, 3, 0, "", False)


def test_edge_departments(spark, tmp_dir):
    write(tmp_dir, "edge.csv", EDGE_DEPARTMENTS)
    rows = apply_contract(scan_csv(spark, tmp_dir, multiline=True), "departments")
    got = {r.row_no: (r.code, r.name, r.description, list(r.reasons)) for r in rows.collect()}
    assert got[2] == ("PHYSIC", "Physics", "", [])
    assert got[3][0] == "COMPUT"
    assert got[4][:2] == ("ELECTR", "Electrical") and got[5][:2] == ("ELECTR", "Electronics")
    assert got[6][3] == ["code_not_derivable"]
    assert got[7][3] == ["too_long_code"]
    assert got[8] == ("CIV", "Civil", "a, quoted", [])
    assert got[9][3] == ["missing_name"]
    res = load(scan_csv(spark, tmp_dir, multiline=True), "departments", None, "2025-01-01 00:00:00")
    table = {r.code: (r.name, r.description) for r in res.table.collect()}
    assert table["ELECTR"] == ("Electronics", "second")      # later row wins
    assert set(table) == {"PHYSIC", "COMPUT", "ELECTR", "CIV"}
    rep = res.report.first()
    assert (rep.total_rows, rep.success_count, rep.error_count) == (8, 5, 3)   # both ELECTR rows count
    assert rep.overwritten_rows == 1                                         # ... and one lost to the other
    assert rep.errors.split("\n") == ["Row 6: code_not_derivable", "Row 7: too_long_code", "Row 9: missing_name"]


def test_atomic_mode_refuses_load(spark, tmp_dir):
    write(tmp_dir, "edge.csv", EDGE_DEPARTMENTS)
    res = load(scan_csv(spark, tmp_dir), "departments", None, "2025-01-01 00:00:00", mode="atomic")
    assert res.poisoned and res.table.count() == 0 and res.report.first().success_count == 0


def test_terms_dates_and_status(spark, tmp_dir):
    write(tmp_dir, "terms.csv", TERMS)
    rows = {r.row_no: r for r in apply_contract(scan_csv(spark, tmp_dir), "academic_terms").collect()}
    assert rows[2].start_date == dt.date(2024, 2, 1) and rows[2].status == "upcoming" and list(rows[2].reasons) == []
    assert rows[3].start_date == dt.date(2024, 2, 1) and list(rows[3].reasons) == ["bad_status"]
    assert rows[4].start_date == dt.date(2024, 2, 1) and list(rows[4].reasons) == ["bad_status"]
    assert list(rows[5].reasons) == ["bad_date_start_date"]
    assert list(rows[6].reasons) == ["bad_format_start_date"]


def test_import_report_lists_ten_errors(spark, tmp_dir):
    body = "Code,Name\n" + "".join(",\n" for _ in range(11)) + "OK,Fine\n"
    write(tmp_dir, "many.csv", body)
    rep = import_report(apply_contract(scan_csv(spark, tmp_dir), "departments")).first()
    assert (rep.total_rows, rep.success_count, rep.error_count, rep.has_more_errors) == (12, 1, 11, True)
    errs = rep.errors.split("\n")
    assert len(errs) == 10 and errs[0] == "Row 2: missing_name" and errs[-1] == "Row 11: missing_name"


def test_row_numbers_across_split_files(spark, tmp_dir):
    # three files, one split into many blocks: row_no must equal the record position
    for f, n in (("a.csv", 30000), ("b.csv", 7), ("c.csv", 12000)):
        write(tmp_dir, f, "Code,Name,Expect\n" + "".join(f"C{i},N{i},{i + 2}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        from acadspark.sources.csv import read_raw
        assert read_raw(spark, tmp_dir, 3, multiline=False).rdd.getNumPartitions() > 5     # the files really are split
        # any contract; only row_no vs Expect matters
        rows = apply_contract(scan_csv(spark, tmp_dir, multiline=False), "courses")
        chk = scan_csv(spark, tmp_dir, multiline=False).select(
            "row_no", F.element_at("_vals", 3).cast("long").alias("expect"))
        bad = chk.where(F.col("row_no") != F.col("expect")).count()
        assert bad == 0 and chk.count() == 42007 and rows.count() == 42007
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_per_file_header_order(spark, tmp_dir):
    write(tmp_dir, "a.csv", "Code,Name\nA1,Alpha\n")
    write(tmp_dir, "b.csv", "Name,Description,Code\nBeta,desc,B1\n")
    write(tmp_dir, "c.CSV", "Code,Name\nX,Ignored\n")      # suffix is case-sensitive
    got = {r.code: (r.name, r.description) for r in apply_contract(scan_csv(spark, tmp_dir), "departments").collect()}
    assert got == {"A1": ("Alpha", ""), "B1": ("Beta", "desc")}


def test_last_wins_and_upsert_idempotent(spark):
    src = spark.createDataFrame([("K1", 1, "a"), ("K1", 2, "b"), ("K2", 1, "c")], "k string, ord int, v string")
    lw = {r.k: r.v for r in last_wins(src, ["k"], ["ord"]).collect()}
    assert lw == {"K1": "b", "K2": "c"}
    target = spark.createDataFrame([(7, "K1", "old", "keep", None, None), (9, "K9", "x", "y", None, None)],
                                   "id long, k string, v string, other string, created_at timestamp_ntz, "
                                   "updated_at timestamp_ntz")
    s = spark.createDataFrame([("K1", "new"), ("K3", "ins"), ("K0", "ins0")], "k string, v string")
    once = upsert(target, s, ["k"], ["v"], "2025-01-01 00:00:00")
    got = {r.k: (r.id, r.v, r.other, r.updated_at is not None) for r in once.collect()}
    assert got == {"K1": (7, "new", "keep", True), "K9": (9, "x", "y", False),
                   "K0": (10, "ins0", None, True), "K3": (11, "ins", None, True)}
    twice = upsert(once, s, ["k"], ["v"], "2025-01-01 00:00:00")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_assign_ids_dense_in_key_order(spark):
    keys = spark.range(0, 1500).select((F.col("id") * 7 % 1500).alias("k")).repartition(6)
    ids = assign_ids(keys, ["k"], "id").orderBy("k").collect()
    assert [r.id for r in ids] == list(range(1, 1501))


def test_stream_equals_batch(spark, tmp_dir):
    inbox = os.path.join(tmp_dir, "in")
    write(inbox, "d1.csv", DEPARTMENTS_TEMPLATE)
    write(inbox, "d2.csv", EDGE_DEPARTMENTS.replace("\"a, quoted\"", "plain"))
    out = os.path.join(tmp_dir, "out")
    q = ingest_stream(spark, inbox, "departments", out, os.path.join(tmp_dir, "ckpt"), available_now=True)
    q.awaitTermination(300)
    streamed = read_current(spark, os.path.join(out, "table"))
    batch = load(scan_csv(spark, inbox), "departments", None, "2025-01-01 00:00:00").table
    cols = ["code", "name", "description"]
    assert sorted(map(tuple, streamed.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))
    rejects = spark.read.parquet(os.path.join(out, "rejects"))
    assert rejects.count() == 3


def test_repeated_header_keeps_last(spark, tmp_dir):
    write(tmp_dir, "dup.csv", "Code,Name,Name\nX1,first,second\n")
    got = apply_contract(scan_csv(spark, tmp_dir), "departments").select("code", "name").collect()
    assert [tuple(r) for r in got] == [("X1", "second")]


# fixed values: the header lines of both uploads
COURSES_TEMPLATE = (
    "Course Code,Title,Department Code,Semester,Credits,Hours Per Week,Course Type,Prerequisites,Is Elective,Description\n"
    "GEO11,Minerals,GEO,1,3,3,theory,,false,\"hardness, streak\"\n"
    "GEO12L,Thin sections,GEO,2,1.5,4,lab,GEO11,true,\n"
    "MUS10,Harmony,MUS,1,2,2,theory,,false,voices\n"
    "ART1,Clay,ART,1,x,3,Theory,,maybe,\n")

PREREQ_TEMPLATE = ("Course Code,Prerequisite Course Code,Is Mandatory\n"
                   "GEO12L,GEO11,false\nGEO30,GEO11,true\nGEO12L,GEO31,true\n")


def test_courses_contract_with_lookups(spark, tmp_dir):
    from acadspark.operators.contract import apply_lookups
    write(os.path.join(tmp_dir, "c"), "courses.csv", COURSES_TEMPLATE)
    departments = spark.createDataFrame([(1, "GEO"), (2, "MUS")], "id long, code string")
    rows = apply_lookups(apply_contract(scan_csv(spark, os.path.join(tmp_dir, "c")), "courses"), "courses",
                         {"departments": departments})
    got = {r.course_code: r for r in rows.collect()}
    assert got["GEO11"].department_id == 1 and str(got["GEO11"].credits) == "3.0" and got["GEO11"].is_elective is False
    assert list(got["GEO12L"].reasons) == [] and got["GEO12L"].course_type == "lab"
    assert sorted(got["ART1"].reasons) == sorted(["bad_credits", "bad_course_type", "bad_is_elective",
                                                   "unknown_department_id"])

    write(os.path.join(tmp_dir, "p"), "prereq.csv", PREREQ_TEMPLATE)
    courses = rows.where(F.size("reasons") == 0).select(
        F.monotonically_increasing_id().alias("id"), "course_code")
    pre = apply_lookups(apply_contract(scan_csv(spark, os.path.join(tmp_dir, "p")), "course_prerequisites"),
                        "course_prerequisites", {"courses": courses})
    bad = {r.row_no: list(r.reasons) for r in pre.collect()}
    assert bad == {2: [], 3: ["unknown_course_id"], 4: ["unknown_prerequisite_id"]}   # GEO30 and GEO31 are not loaded


def test_upsert_keeps_source_ids_when_given(spark):
    target = spark.createDataFrame([(1, "A", "x")], "id long, k string, v string")
    src = spark.createDataFrame([(7, "A", "y"), (9, "B", "z")], "id long, k string, v string")
    got = {r.k: (r.id, r.v) for r in upsert(target, src, ["k"], ["v"], "2025-01-01 00:00:00", created_col=None,
                                            updated_col=None).collect()}
    assert got == {"A": (1, "y"), "B": (9, "z")}


def test_good_plus_rejects_is_input(spark, tmp_dir):
    write(tmp_dir, "edge.csv", EDGE_DEPARTMENTS)
    write(tmp_dir, "terms.csv", TERMS)
    for contract in ("departments", "academic_terms"):
        rows = apply_contract(scan_csv(spark, tmp_dir, glob="edge.csv" if contract == "departments" else "terms.csv"),
                              contract)
        good, bad = split_valid(rows)
        assert good.count() + bad.count() == rows.count()
        assert good.select("row_no").intersect(bad.select("row_no")).count() == 0


def test_upsert_buckets_rewrites_touched_buckets_only(spark, tmp_dir):
    import glob
    from acadspark.sources.sinks import key_bucket, upsert_buckets
    path = os.path.join(tmp_dir, "table")
    first = spark.range(0, 2000).select(F.concat(F.lit("K"), F.col("id").cast("string")).alias("k"),
                                        F.lit("v0").alias("v"))
    upsert_buckets(spark, path, first, ["k"], ["v"], "2025-01-01 00:00:00", n_buckets=16)
    files_before = {f: os.path.getmtime(f) for f in glob.glob(os.path.join(path, "bucket=*", "*.parquet"))}
    second = spark.createDataFrame([("K5", "v1"), ("NEW1", "n"), ("NEW2", "n")], "k string, v string")
    touched = {r[0] for r in second.select(key_bucket(["k"], 16)).distinct().collect()}
    time.sleep(1.1)
    upsert_buckets(spark, path, second, ["k"], ["v"], "2025-02-01 00:00:00", n_buckets=16)
    table = spark.read.parquet(path)
    rows = {r.k: (r.id, r.v) for r in table.collect()}
    assert len(rows) == 2002 and rows["K5"][1] == "v1" and rows["K6"][1] == "v0"
    assert sorted(r.id for r in table.collect()) == list(range(1, 2003))      # dense over the whole table
    assert {rows["NEW1"][0], rows["NEW2"][0]} == {2001, 2002}
    for f, m in files_before.items():
        b = int(f.split("bucket=")[1].split("/")[0])
        if b not in touched:
            assert os.path.exists(f) and os.path.getmtime(f) == m               # untouched bucket kept its file


def test_file_size_cap_and_glob(spark, tmp_dir):
    write(tmp_dir, "small.csv", "Code,Name\nS1,Small\n")
    write(tmp_dir, "big.csv", "Code,Name\n" + "".join(f"B{i},Big {i}\n" for i in range(2000)))
    write(tmp_dir, "notes.txt", "Code,Name\nT1,Text\n")
    rows = apply_contract(scan_csv(spark, tmp_dir, max_file_bytes=1000), "departments").collect()
    assert {r.code for r in rows if not r.reasons} == {"S1"}
    assert [(r.source_file.rsplit("/", 1)[1], r.row_no, r.reasons) for r in rows if r.reasons] == [
        ("big.csv", 1, ["file_too_large"])]     # a refused file is told, once


def test_quotes_line_breaks_and_wide_files(spark, tmp_dir):
    wide = [f"X{i}" for i in range(90)]
    write(tmp_dir, "wide.csv", ",".join([*wide, "Code", "Name", "Description"]) + "\n"
          + ",".join(["x"] * 90 + ["W1", '"He said ""hi"", then left"', '"two\nlines, and a comma"']) + "\n"
          + ",".join(["x"] * 90 + ["W2", '"B ""x"" C"']) + "\n")
    write(tmp_dir, "long.csv", 'Code,"Na""me",Name\nL1,n,One\nL2,n,Two,extra\nL3,n,Three,,""\n' + "L4,n,Four" + "," * 100 + "z\n")
    write(tmp_dir, "one.csv", 'Name\n"a, ""b"""\n')
    got = {(r.source_file.rsplit("/", 1)[1], r.row_no): r for r in
           apply_contract(scan_csv(spark, tmp_dir), "departments").collect()}
    assert [(k[0], k[1]) for k in sorted(got)] == [("long.csv", 2), ("long.csv", 3), ("long.csv", 4), ("long.csv", 5),
                                                   ("one.csv", 2), ("wide.csv", 2), ("wide.csv", 3)]
    w1, w2 = got["wide.csv", 2], got["wide.csv", 3]
    assert (w1.code, w1.name, w1.description) == ("W1", 'He said "hi", then left', "two\nlines, and a comma")
    assert (w2.code, w2.name, w2.description) == ("W2", 'B "x" C', "")
    assert [got["long.csv", k].reasons for k in (2, 3, 4, 5)] == [[], ["too_many_fields"], [], ["too_many_fields"]]
    assert got["one.csv", 2].name == 'a, "b"'


def test_rows_are_not_sorted(spark, tmp_dir):
    from acadspark.plans.explain import plan_text
    write(tmp_dir, "a.csv", "Code,Name\nA,x\n")
    assert "SortAggregate" not in plan_text(scan_csv(spark, tmp_dir))

"""Quoted line breaks in files that are split anywhere, against Python's csv reader; long fields; quotes as text."""

import csv
import io
import os
import random

import pytest

from acadspark.sources.csv import fields, read_lines, scan_csv, text_beyond

WORDS = ["a", "b,c", 'say "hi"', "two\nlines", "x\n\n\ny", '"', "", " pad ", "é\n\"q\",\n", "cr\r\nlf", '""', "plain text"]


def quoted_file(seed, n, dense):
    """A file of n records; and its records, by Python's reader."""
    rng = random.Random(seed)
    out = io.StringIO()
    w = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
    w.writerow(["Code", "Name\nof it", "Note"])
    for i in range(n):
        w.writerow([f"C{i}", *(rng.choice(WORDS if rng.random() < dense else ["plain", "text"]) for _ in range(2))])
        if rng.random() < 0.1:
            out.write(w.dialect.lineterminator)  # an empty line is no record
    text = out.getvalue()
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    return text, rows


def write(dir_, name, text):
    os.makedirs(dir_, exist_ok=True)
    with open(os.path.join(dir_, name), "w", encoding="utf-8", newline="") as f:
        f.write(text)


def read(spark, path, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        rows = scan_csv(spark, path).collect()
        return {(os.path.basename(r.source_file), r.row_no): (list(r._hdr), [x or "" for x in r._vals], r._csv_error) for r in rows}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("size", [61, 500, 1 << 20])
def test_every_split_size_gives_the_same_records(spark, tmp_dir, size):
    want = {}
    for name, n, dense in (("dense.csv", 40, 0.9), ("sparse.csv", 60, 0.05), ("clean.csv", 30, 0), ("head.csv", 0, 0)):
        text, rows = quoted_file(name, n, dense)
        write(tmp_dir, name, text)
        want |= {(name, i + 2): (rows[0], r, None) for i, r in enumerate(rows[1:])}
    # a field over many splits, and a record after it
    write(tmp_dir, "long.csv", 'A,B\n1,"' + "line\n" * 200 + '"\n2,x\n')
    want |= {("long.csv", 2): (["A", "B"], ["1", "line\n" * 200], None), ("long.csv", 3): (["A", "B"], ["2", "x"], None)}
    got = read(spark, tmp_dir, size)
    width = max(len(h) for h, _, _ in want.values())
    assert got == {k: (h, v + [""] * (width - len(v)), e) for k, (h, v, e) in want.items()}


def test_one_file_is_read_by_many_tasks(spark, tmp_dir):
    text, _ = quoted_file(7, 3000, 0.5)
    write(tmp_dir, "one.csv", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        assert read_lines(spark, tmp_dir).rdd.getNumPartitions() >= 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("multiline", [True, False])
def test_long_quoted_fields_in_short_and_long_records(spark, tmp_dir, multiline):
    long = 'say ""hi"", ' * 10_000
    write(tmp_dir, "f.csv", f'A,B,C\n1,"{long}"\n2,"{long}",x,"{long}"\n3,"{long}",x\n4,a,b,,"",\n5,a,b,,,z\n6\n')
    got = {r.row_no: (list(r._vals), r._csv_error) for r in scan_csv(spark, tmp_dir, multiline=multiline).collect()}
    text = long.replace('""', '"')
    assert got[2] == (["1", text, None], None) and got[4] == (["3", text, "x"], None)
    assert got[3][1] == "too_many_fields" and got[6][1] == "too_many_fields"
    assert got[5] == (["4", "a", "b"], None) and got[7] == (["6", None, None], None)


def test_quotes_inside_unquoted_fields_are_text(spark, tmp_dir):
    write(tmp_dir, "f.csv", 'A,B\n5" pipe,6" pipe\nx"y,"two\nlines"\nlast,row\n')
    got = read(spark, tmp_dir, 1 << 20)
    assert {k[1]: v[1] for k, v in got.items()} == {2: ['5" pipe', '6" pipe'], 3: ['x"y', "two\nlines"], 4: ["last", "row"]}


def test_fields_of_a_record(spark):
    rng = random.Random(1)
    rows = [[rng.choice(WORDS) for _ in range(rng.randint(1, 6))] for _ in range(200)]
    texts = []
    for r in rows:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(r)
        texts.append(out.getvalue())
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: list(r.f) for r in df.select("i", fields("t").alias("f")).collect()}
    assert got == dict(enumerate(rows))
    for n in range(4):
        got = {r.i: r.f for r in df.select("i", text_beyond("t", str(n)).alias("f")).collect()}
        assert got == {i: any(r[n:]) for i, r in enumerate(rows)}

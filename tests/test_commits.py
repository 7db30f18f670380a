"""Commits by manifest, replays, order across batches, digests, and change logs folded backwards."""

import os
import time

import pytest
from pyspark.sql import functions as F

from acadspark.operators.quality import audit, diff
from acadspark.sources import commits as cm
from acadspark.streaming.ingest import ingest_batch


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k string, v string")


def content(df):
    return sorted((r.id, r.k, r.v) for r in df.collect())


def test_a_killed_load_changes_nothing_and_a_replay_gives_the_same(spark, tmp_dir, monkeypatch):
    path = os.path.join(tmp_dir, "table")
    assert cm.read_commit(spark, path) is None
    cm.upsert_commit(spark, path, rows(spark, [(f"K{i}", "v0") for i in range(200)]), ["k"], ["v"], "2025-01-01 00:00:00", 8, 1)
    before = content(cm.read_commit(spark, path))
    assert [x[0] for x in before] == list(range(1, 201))
    second = rows(spark, [("K5", "v1"), ("K150", "v1"), ("NEW", "n"), ("NEW2", "n")])
    publish = cm.publish

    def killed(*a):
        raise OSError("killed")
    monkeypatch.setattr(cm, "publish", killed)
    with pytest.raises(OSError):
        cm.upsert_commit(spark, path, second, ["k"], ["v"], "2025-02-01 00:00:00", 8, 2)
    assert content(cm.read_commit(spark, path)) == before and len(cm.manifests(spark, path)) == 1
    monkeypatch.setattr(cm, "publish", publish)
    # killed between buckets: the folder of the attempt is there in part, and nobody refers to it
    m = cm.upsert_commit(spark, path, second, ["k"], ["v"], "2025-02-01 00:00:00", 8, 2)
    after = content(cm.read_commit(spark, path))
    assert len(after) == 202 and {x[0] for x in after} == set(range(1, 203))
    assert {(x[1], x[2]) for x in after} >= {("K5", "v1"), ("NEW", "n"), ("K6", "v0")}
    assert cm.upsert_commit(spark, path, second, ["k"], ["v"], "2025-02-01 00:00:00", 8, 2) == m  # replayed
    assert content(cm.read_commit(spark, path)) == after and content(cm.read_commit(spark, path, 1)) == before
    with pytest.raises(cm.Conflict):  # two loads from one version
        cm.publish(spark, path, m)
    with pytest.raises(ValueError):
        cm.commit(spark, path, cm.read_commit(spark, path), ["k"], 16)


def test_only_changed_buckets_are_compared(spark, tmp_dir):
    path = os.path.join(tmp_dir, "table")
    cm.upsert_commit(spark, path, rows(spark, [(f"K{i}", "v0") for i in range(400)]), ["k"], ["v"], "2025-01-01 00:00:00", 32)
    cm.upsert_commit(spark, path, rows(spark, [("K7", "x"), ("NEW", "n"), ("K8", "v0")]), ["k"], ["v"], "2025-01-01 00:00:00", 32)
    a, b = cm.read_commit(spark, path, 1), cm.read_commit(spark, path, 2)
    got = cm.diff_commits(spark, path, 1, 2)
    want = diff(a, b, ["k"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() >= 2
    read = {f.split("bucket=")[1].split("/")[0] for f in got.select("*").inputFiles()}
    assert len(read) <= 3
    assert cm.diff_commits(spark, path, 1, 1).count() == 0


def test_an_older_file_in_a_later_batch_does_not_win(spark, tmp_dir):
    inbox, out = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "table")
    os.makedirs(inbox)
    now = time.time()
    for name, text, t in (("new.csv", "Code,Name\nA,new a\nB,new b\n", now), ("old.csv", "Code,Name\nA,old a\nC,old c\n", now - 1000)):
        with open(os.path.join(inbox, name), "w") as f:
            f.write(text)
        os.utime(os.path.join(inbox, name), (t, t))

    def load(batch, name):
        ingest_batch(spark, [os.path.join(inbox, name)], batch, "departments", out, os.path.join(tmp_dir, "rejects"), n_buckets=4,
                     committed=True)
        return {r.code: r.name for r in cm.read_commit(spark, out).collect()}
    assert load(0, "new.csv") == {"A": "new a", "B": "new b"}
    assert load(1, "old.csv") == {"A": "new a", "B": "new b", "C": "old c"}
    assert load(1, "old.csv") == {"A": "new a", "B": "new b", "C": "old c"}
    assert sorted(r.id for r in cm.read_commit(spark, out).collect()) == [1, 2, 3]


def test_the_log_gives_back_every_earlier_table(spark, tmp_dir):
    log = os.path.join(tmp_dir, "log")
    schema = "id long, v string, d decimal(8,2)"
    states = [[(1, "a", 1), (2, "b", 2), (3, None, 3)], [(1, "a2", 1), (3, "c", None), (4, "d", 4)], [(2, "b again", 2), (1, "a", 1), (4, "d", 4)],
              [(2, "b again", 2), (1, "a", 1), (4, "d", 4)], []]
    frames = [spark.createDataFrame([(i, v, d and __import__("decimal").Decimal(d)) for i, v, d in s], schema) for s in states]
    for n in range(1, len(frames)):
        changes = audit(diff(frames[n - 1], frames[n], ["id"]), "t", "id", "2025-01-01 00:00:00")
        for _ in range(2):  # a retry replaces its batch
            cm.write_log(changes, log, n)
    whole = cm.read_log(spark, log)
    assert whole.groupBy("batch").count().count() == 3 and whole.where(F.col("batch") == 1).count() == 4
    for n, want in enumerate(frames):
        got = cm.rewind(frames[-1], whole, ["id"], n)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

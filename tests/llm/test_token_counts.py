import re
from collections import Counter

import pytest
from helpers import SCHEMA, documents, frame

from acadspark.llm import token_counts as tc


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_bytes) for r in rollup.totals().collect()}


def test_whole_table(spark):
    from tokenizers import Tokenizer
    import public_tokenizers
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = documents(1) + [(300, "a<|endoftext|>b <|endoftext|>")]
    want = Counter()
    for i, x in rows:
        n = len((x or "").encode())
        want.update({("s", "en", tc.BPE, 0): 1, ("s", "en", tc.BPE, 1): len(t.encode(x or "", add_special_tokens=False).ids),
                     ("s", "en", tc.BPE, 2): n, ("s", "en", tc.WORDS, 0): 1, ("s", "en", tc.WORDS, 2): n,
                     ("s", "en", tc.WORDS, 1): len(re.findall(r"[^\x20\x09-\x0D]+", x or ""))})
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_bytes) for r in tc.count(frame(spark, rows)).collect()}
    assert got == {("s", "en", v): tuple(want["s", "en", v, k] for k in range(3)) for v in (tc.BPE, tc.WORDS)}


def test_deltas_and_replays(spark, tmp_dir):
    def counts(rows):
        return tc.counted(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), (tc.WORDS,))

    old = [(1, "a b c", "x", "en"), (2, "d e", "x", None), (3, None, None, "en")]
    new = [(1, "a b c d e", "y", "en"), (2, "d", "x", None)]
    r = tc.Rollup(spark, tmp_dir + "/r")
    assert totals(r) == {}
    r.commit("1", tc.inserts(counts(old)))
    once = totals(r)
    assert once == {("x", "en", tc.WORDS): (1, 3, 5), ("x", None, tc.WORDS): (1, 2, 3), (None, "en", tc.WORDS): (1, 0, 0)}
    r.commit("1", tc.inserts(counts(old)))  # the same batch again
    assert totals(r) == once
    r.commit("2", tc.revisions(counts(old[:2]), counts(new)))
    assert totals(r) == {("y", "en", tc.WORDS): (1, 5, 9), ("x", None, tc.WORDS): (1, 1, 1), (None, "en", tc.WORDS): (1, 0, 0)}
    r.commit("3", tc.deletes(counts(new + old[2:])))
    assert totals(r) == {}
    r.commit("2", tc.revisions(counts(old[:2]), counts(new)))  # a late replay
    assert totals(r) == {}
    r.commit("4", tc.inserts(counts([])))
    assert r.batches() == ["1", "2", "3", "4"] and totals(r) == {}
    with pytest.raises(ValueError):
        r.commit("../5", tc.inserts(counts([])))


def test_an_unfinished_commit_does_not_count(spark, tmp_dir):
    import os
    r = tc.Rollup(spark, tmp_dir + "/r")
    docs = spark.createDataFrame([(1, "a b", "x", "en")], "doc_id long, text string, source string, lang string")
    r.commit("1", tc.inserts(tc.counted(docs, (tc.WORDS,))))
    os.remove(tmp_dir + "/r/batch=1/_SUCCESS")
    assert totals(r) == {}


@pytest.mark.parametrize("stops_at", ["never", "totals", "sealed", "delete"])
def test_compaction_keeps_the_totals(spark, tmp_dir, stops_at, monkeypatch):
    """Folding batches changes no total, wherever it stops; sealed batches can be replayed without effect."""
    import os

    def counts(*rows):
        return tc.counted(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), (tc.WORDS,))

    path = tmp_dir + "/r"
    r = tc.Rollup(spark, path)
    r.compact()
    assert totals(r) == {}  # nothing to fold yet
    r.commit("1", tc.inserts(counts((1, "a b c", "x", "en"), (2, "d e", "x", None))))
    r.commit("2", tc.inserts(counts((3, "f", None, "en"))))
    r.compact()
    assert r.batches() == [] and not os.path.exists(path + "/batch=1")
    r.commit("3", tc.deletes(counts((2, "d e", "x", None))))
    r.commit("4", tc.inserts(counts((4, "g h", "x", "en"))))
    want = {("x", "en", tc.WORDS): (2, 5, 8), (None, "en", tc.WORDS): (1, 1, 1)}
    assert totals(r) == want
    if stops_at == "delete":
        monkeypatch.setattr(tc.Rollup, "_forget", lambda self: None)
    r.compact()
    monkeypatch.undo()
    if stops_at in ("totals", "sealed"):  # as a job leaves it that dies while it writes this table
        assert not os.path.exists(path + "/batch=3")
        r.commit("5", tc.inserts(counts((5, "i", "y", "en"))))
        want[("y", "en", tc.WORDS)] = (1, 1, 1)
        monkeypatch.setattr(tc.Rollup, "_forget", lambda self: None)
        r.compact()
        monkeypatch.undo()
        os.remove(f"{path}/base=3/sealed/_SUCCESS")
        if stops_at == "totals":
            os.remove(f"{path}/base=3/totals/_SUCCESS")
        assert r.batches() == ["5"] and totals(r) == want
    assert totals(r) == want
    r.commit("1", tc.inserts(counts((1, "a b c", "x", "en"))))  # late replays of sealed batches
    r.commit("3", tc.deletes(counts((2, "d e", "x", None))))
    assert totals(r) == want
    r.compact()
    assert totals(r) == want and r.batches() == []
    assert sorted(n for n in os.listdir(path) if n.startswith("batch=")) == []


def test_empty_table(spark):
    assert tc.count(spark.createDataFrame([], SCHEMA), (tc.WORDS,)).count() == 0


def test_query_goes_through_all_kinds_of_changes(spark, tmp_dir):
    docs = frame(spark, documents(4))
    want = sorted(map(tuple, tc.count(docs, path=f"{tmp_dir}/plain").collect()), key=str)
    got = tc.maintained(docs, path=f"{tmp_dir}/changes")
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert tc.Rollup(spark, f"{tmp_dir}/changes").batches() == ["delete", "load", "revise"]
    for batch in ("delete", "load", "revise"):  # each one counts
        part = spark.read.parquet(f"{tmp_dir}/changes/batch={batch}")
        assert part.where("n_tokens <> 0").count() > 0
        assert sorted(map(tuple, part.select(*tc.KEYS, *tc.SUMS).collect()), key=str) != want


def test_registered_query_keeps_deletes_and_revisions(spark, monkeypatch):
    from acadspark.llm import catalog
    used = []
    for name in ("deletes", "revisions"):
        monkeypatch.setattr(tc, name, lambda *a, f=getattr(tc, name), n=name: (used.append(n), f(*a))[1])
    got = catalog.op5_token_counts(spark, "/root/testdata/sf0.001")
    want = tc.count(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {"deletes", "revisions"} <= set(used)

import hashlib
import random
from collections import Counter

import pytest
from helpers import SCHEMA, documents, frame, twins
from hypothesis import given, settings
from hypothesis import strategies as st

from acadspark.llm import suffix_array as sa
from acadspark.llm.common import slices


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40))
def test_sort(x):
    x = [*x, 0]
    order = sa.suffix_array(x)
    assert order == sorted(range(len(x)), key=lambda i: x[i:])
    common = sa.common_prefixes(x, order)
    for k in range(1, len(x)):
        a, b = x[order[k - 1]:], x[order[k]:]
        assert common[k] == next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(97 + x % 2 for x in b)), max_size=5), st.integers(1, 8))
def test_repeated_starts(texts, length):
    c = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    assert sa.repeated_starts(texts, length) == [[i for i in range(len(t) - length + 1) if c[t[i:i + length]] > 1] for t in texts]


def brute(rows, length):
    every = set(rows)
    c = Counter(b[i:i + length] for _, t in every for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if c[b[s:s + length]] > 1:
                gone[s:s + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("length", [24, 50, 200])
def test_against_brute_force(spark, length):
    rows = [r for r in documents(length, 30) + twins() if len(r[1] or "") < 20_000]
    got = [tuple(r) for r in sa.digest(frame(spark, rows), length).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, length), key=str)


def test_periodic_and_shifted_text(spark):
    p = "".join(chr(97 + (i * i) % 23) for i in range(500))
    rows = [(1, "ab" * 400), (2, p), (3, "q" * 77 + p[40:420] + "z" * 300), (4, p[:199]), (5, p[100:300] + "!"), (6, "é" * 300)]
    got = [tuple(r) for r in sa.digest(frame(spark, rows), 200).collect()]
    assert sorted(got) == sorted(brute(rows, 200))


def hot(n=400):
    """A passage that every document holds, with different bytes before and behind it; some ends are alike."""
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = []
    for i in range(n):
        before, behind = ("".join(rng.choice("ijkl") for _ in range(260)) for _ in range(2))
        if i % 3 == 0:  # shares some bytes beyond the passage with its like
            before, behind = before[:-30] + f"{i % 7:030d}", f"{i % 5:040d}" + behind[40:]
        rows.append((i, before + passage + behind))
    rows += [rows[1], rows[1], (None, rows[2][1]), (n, passage[:230]), (n + 1, passage[300:499])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows_of_a_key", [1, 20, 10 ** 6])
def test_hot_keys_are_split(spark, monkeypatch, rows_of_a_key):
    rows = hot()
    monkeypatch.setattr(sa, "KEY_ROWS", rows_of_a_key)
    monkeypatch.setattr(sa, "slices", lambda b, c: slices(b, c, 40_000))  # several slices
    got = [tuple(r) for r in sa.digest(frame(spark, rows).repartition(3), 200).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 200), key=str)


def test_no_large_block_of_one_key(spark):
    """Every end of the passage has its own segment under one key: their number bounds no block."""
    docs = sa.keyed(frame(spark, hot(1500)).select("doc_id", "text"))
    marks = sa.judged(docs, 200)
    held = sa.F.sum(sa.F.expr("size(filter(marks, x -> (x & 2) != 0 and (x & 4) = 0))"))
    split = sa.F.sum(sa.F.expr("size(filter(marks, x -> (x & 4) != 0))"))
    one = marks.agg(held.alias("held"), split.alias("split")).first()
    assert one.split > 1500 and one.held < 1500


@pytest.mark.parametrize("length", [24, 200])
def test_all_keys_split_against_brute_force(spark, monkeypatch, length):
    monkeypatch.setattr(sa, "KEY_ROWS", 1)
    rows = [r for r in documents(length, 30) + twins() if len(r[1] or "") < 20_000]
    got = [tuple(r) for r in sa.digest(frame(spark, rows), length).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, length), key=str)


def test_empty_table(spark):
    assert sa.digest(spark.createDataFrame([], SCHEMA)).count() == 0

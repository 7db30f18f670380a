"""Spelling variants against a plain reading of the definition."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import documents, frame

from acadspark.llm import spelling


def words_of(rows, shortest, least, slips):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if slips and h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= shortest and n >= least}


def edits(w, letters):
    out = {w[:i] + w[i + 1:] for i in range(len(w))}
    out |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
    out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    return out - {w}


def expected(rows, shortest=7, least=2, times=10, slips=False):
    n = words_of(rows, shortest, least, slips)
    letters = set("".join(n))
    near = {w: edits(w, letters) & n.keys() if len(w) < 200 else
            {v for v in n if len(v) > 198 and v != w and one_edit(v, w)} for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda v: (-n[v], v), default=None)
        if top is not None and n[top] >= times * n[w]:
            form[w] = top
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i + 1:] == b[i:] or a[i:] == b[i + 1:]


def variants_of(seed):
    """Frequent words, rarer variants of them, variants of those, and a crowd of words that differ in one letter."""
    rng = random.Random(seed)
    alphabet = "abcdeéßÿ"
    rows = []
    for i in range(25):
        base = "".join(rng.choice(alphabet) for _ in range(rng.randint(4, 11)))
        words = [base] * rng.choice([5, 40, 300])
        for _ in range(6):
            w = rng.choice(words)
            at = rng.randrange(len(w))
            words += [rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice(alphabet) + w[at + 1:], w[:at] + "x" + w[at:]])] \
                * rng.choice([1, 2, 3, 20])
        rng.shuffle(words)
        rows.append((i, rng.choice([" ", ", ", "1", "\n", "→"]).join(w if rng.random() < 0.7 else w.upper() for w in words)))
    rows.append((90, " ".join("crowd" + a + b for a in "abcdefghij" for b in "abcdefgh" for _ in range(2))))
    rows.append((91, " ".join(["y" * 5000] * 2 + ["y" * 4999] * 40 + ["y" * 2000 + "z" + "y" * 2999] * 3)))
    rows.append((92, "×÷×÷×÷× ×÷×÷×÷× Ŀ×÷×÷×÷×ŀ abcdefĀabcdef"))
    return rows


@pytest.mark.parametrize("most", [spelling.PAIRS, 30, 0])
def test_against_definition(spark, most):
    rows = variants_of(3) + documents()
    got = spelling.variants(frame(spark, rows), shortest=3, slips=False, most=most).collect()
    assert sorted(tuple(r) for r in got) == expected(rows, shortest=3)


def test_slips_chains_and_empty(spark):
    rows = variants_of(4) + documents(1) + [(None, "repeated words repeated words"), (None, "repeated words")]
    got = sorted(tuple(r) for r in spelling.variants(frame(spark, rows), slips=True).collect())
    assert got == expected(rows, slips=True)
    rows = [(1, " ".join(["alphabet"] * 1000 + ["alphabets"] * 100 + ["alphabetsy"] * 10 + ["alphabetsyz"]))]
    got = {r.word: r for r in spelling.variants(frame(spark, rows), least=1).collect()}
    assert {w: r.root for w, r in got.items()} == dict.fromkeys(got, "alphabet")
    assert got["alphabetsyz"].form == "alphabetsy" and got["alphabet"].form is None
    assert spelling.variants(frame(spark, [])).collect() == []
    assert spelling.variants(frame(spark, [(1, None), (2, ""), (3, "short words")])).collect() == []


def test_checksums_go_on_from_a_prefix():
    rng = random.Random(5)
    words = [bytes(rng.randrange(256) for _ in range(n)) for n in [1, 7, 8, 255, 256, 257, 3000, 20, 1]]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    begun = np.array([zlib.crc32(b"%d:" % i) for i in range(len(words))], np.uint32)
    got = spelling.crcs(data, start, end, begun)
    assert got.tolist() == [zlib.crc32(b"%d:" % i + w) for i, w in enumerate(words)]
    assert spelling.crcs(data, start[:0], end[:0], begun[:0]).tolist() == []


def test_neighbourhoods_meet():
    """Reduced words one edit apart reach one another from one side."""
    rng = random.Random(6)
    for _ in range(300):
        a = [rng.randint(1, 4) for _ in range(rng.randint(1, 8))]
        b = list(a)
        at = rng.randrange(len(a) + 1)
        if rng.random() < 0.5 or at == len(a):
            b.insert(at, rng.randint(1, 4))
        else:
            b[at] = rng.randint(1, 4)
        own, other = (spelling.hashes(np.array([x], np.uint64), 4) for x in (a, b))
        assert own[0, 0] in other[0] or other[0, 0] in own[0]

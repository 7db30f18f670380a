import random
import re

import numpy as np
import pytest
from helpers import SCHEMA, documents, frame, twins

from acadspark.llm import minhash
from acadspark.llm.components import components


def sets(text, k):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    """component of each row, by comparing all pairs."""
    order = lambda i: (0, 0) if i is None else (1, i)
    s = [sets(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                root[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(rows[i][0])
    return [(rows[i][0], len(s[i]), min(out[find(i)], key=order)) for i in range(len(rows))]


@pytest.mark.parametrize("k", [2, 5])
def test_groups_are_those_of_all_pairs(spark, k):
    rows = documents(k) + twins()
    got = minhash.groups(frame(spark, rows), k=k).collect()
    want = brute(rows, k)
    key = lambda r: str(tuple(r))
    assert sorted([tuple(r)[:3] for r in got], key=key) == sorted(want, key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_chain_of_near_copies_is_one_group(spark):
    # neighbours are alike, ends are not: the links between differing texts must all be there
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i:3 * i + 100])) for i in range(100)]
    got = {r.doc_id: r.component_id for r in minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert got == {r[0]: r[2] for r in brute(rows, 2)}
    assert set(got.values()) == {0}


def test_many_near_copies_of_one_text(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:i % 190] + [f"new{i}"] + words[i % 190:])) for i in range(600)]
    got = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    assert {r.component_id for r in got} == {0}


def test_one_document_of_each_group_stays(spark):
    rows = documents(3) + twins()
    docs = frame(spark, rows)
    got = minhash.deduplicate(docs)
    assert got.columns == docs.columns
    left = got.collect()
    want = brute(rows, 5)
    heads = {(i if i is not None else "null") for i, n, c in want if n and i == c}
    assert sorted(str(r.doc_id if r.doc_id is not None else "null") for r in left if sets(r.text, 5)) == sorted(map(str, heads))
    assert sum(not sets(r.text, 5) for r in left) == sum(n == 0 for _, n, _ in want)
    assert all(r.h == "odd" and r.node == "odd" for r in left)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert minhash.groups(none).count() == 0 and minhash.deduplicate(none).count() == 0


def test_signatures_find_every_pair_within_the_radius(spark):
    """Pigeonhole: 18 differing slots, however they lie, leave a key in common; one row is given for it."""
    from pyspark.sql import functions as F
    rng = np.random.default_rng(0)
    base = rng.integers(0, 256, minhash.SLOTS)
    rows = []
    for i in range(300):
        other = base.copy()
        at = rng.choice(minhash.SLOTS, minhash.RADIUS if i else 0, replace=False)
        other[at] = (other[at] + 1) % 256
        longs, at = [], 0
        for n, _ in minhash.CHUNKS:
            longs.append(sum(int(v) << 8 * j for j, v in enumerate(other[at:at + n])))
            at += n
        rows.append((i, 9, *longs))
    sig = spark.createDataFrame(rows, "node long, n long, " + ", ".join(f"{c} long" for c in minhash.INDEX))
    sig = sig.withColumns({c: F.lit(0).cast("long") for c in minhash.CHECKS})
    k = minhash.keys(sig)
    assert k.count() == 85 * 300
    x = k.join(sig.drop("n"), "node").alias("x")
    y = k.join(sig.drop("n"), "node").alias("y")
    met = x.where("node = 0").join(y, F.expr("x.key = y.key") & minhash.near("x", "y") & minhash.first_common("x", "y", "x.plan"))
    assert sorted(r[0] for r in met.select("y.node").collect()) == list(range(300))
    far = F.expr("bit_count(" + minhash.differing_nibbles("a", "b") + ")")
    (r,) = spark.range(1).select(F.lit(0x0123456789ABCDEF).alias("a"), F.lit(0x0123406789AB0DE0).alias("b")).select(far).collect()
    assert r[0] == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(40)}, 200: 200, 201: 200}


def test_similarities_that_the_radii_do_not_cover_are_refused(spark):
    from acadspark.llm import decontaminate
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    for low in (0.7, 0.79, float("nan")):
        for f in (lambda: minhash.groups(docs, similarity=low), lambda: minhash.deduplicate(docs, similarity=low),
                  lambda: decontaminate.contaminated(docs, bench, low), lambda: decontaminate.clean(docs, bench, low)):
            with pytest.raises(ValueError):
                f()
    assert {r.component_id for r in minhash.groups(docs, k=2, similarity=0.9).collect()} == {1}


def just_below(n, seed=0):
    """Texts of which almost all pairs are just below 0.8 of each other."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        words = list(base)
        for j in rng.sample(range(200), 7):
            words[j] = f"x{i}-{j}"
        rows.append((i, " ".join(words)))
    return rows


def test_texts_just_below_the_threshold_make_no_pairs(spark, monkeypatch):
    """Rows out of the joins grow with the group, not with its square; the few links are all there."""
    made = []
    confirmed = minhash.confirmed

    def counted(pairs, *rest):
        made[-1] += pairs.count()
        return confirmed(pairs, *rest)
    monkeypatch.setattr(minhash, "confirmed", counted)
    monkeypatch.setattr(minhash, "BLOCK", 100)
    for n in (300, 600, 1200):
        made.append(0)
        rows = just_below(n)
        got = {r.doc_id: r.component_id for r in minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
        assert got == {i: c for i, _, c in brute(rows, 2)}
        assert len(set(got.values())) > 20  # they are not one group
    assert all(m <= 5 * n for m, n in zip(made, (300, 600, 1200))), made


def test_links_of_two_blocks():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(40)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets[20:]] for a in sets[:20]])
    for step in (7, 1 << 14):
        assert (minhash.intersections(sets[:20], sets[20:], step) == want).all()
    same = [sets[0]] * 3
    assert minhash.block_links(([1, 2, 3], [1, 2, 2], same), ([4, 5], [4, 1], same[:2]), 80) == [(1, 4), (2, 4)]

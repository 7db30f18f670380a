import math
import random

from pyspark.sql import functions as F

from acadspark.llm import topk


def brute(rows, every, k):
    v = {}
    good = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows
            if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    for q, a in dict(good).items():
        if q % every == 0:
            s = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a)))[:k]
            v[q] = [(r + 1, i, -n) for r, (n, i) in enumerate(s)]
    return v


def run(spark, vectors, every, k=10, **options):
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in vectors], "vec_id long, embedding array<float>, label int, d string")
    out = {}
    for r in topk.top_k(df, F.col("id") % every == 0, k, **options).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


def test_against_all_pairs(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(-20, 20) / 16 for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(500, None), (501, []), (502, [1.0, None] * 4), (503, [math.nan] * 8), (504, [math.inf] * 8), (None, rows[0][1]),
             (505, [0.0] * 8), (506, [1.0] * 3), (507, [2.0] * 3), (506, [1.0] * 3)]
    assert run(spark, rows, 5, rows=64, query_rows=16, step=8, pivots=6) == {
        q: x for q, x in brute(rows, 5, 10).items() if x}


def test_clustered_vectors_and_few_candidates(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 3) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.01) for c in centres[i % 4]]) for i in range(200)]
    rows = [(i, [float(x) for x in __import__("numpy").array(e, "float32")]) for i, e in rows]
    assert run(spark, rows, 10, rows=50, step=4) == brute(rows, 10, 10)
    assert run(spark, rows[:4], 1) == brute(rows[:4], 1, 10)


def test_large_values_are_exact(spark):
    rows = [(i, [float(2 ** 20 + i), 3.0 * i, -1.0]) for i in range(50)]
    assert run(spark, rows, 7) == brute(rows, 7, 10)


def test_empty_table(spark):
    assert run(spark, [], 1) == {}


def test_any_number_of_partitions(spark, monkeypatch):
    """A cluster, or the check, may deal rows to other numbers of partitions than asked."""
    kind = type(spark.range(0))
    dealt = kind.repartition
    rng = random.Random(4)
    rows = [(i, [rng.randint(-20, 20) / 16 for _ in range(8)]) for i in range(300)]
    want = brute(rows, 5, 10)
    for change in (lambda n: 23 * n, lambda n: 1):
        monkeypatch.setattr(kind, "repartition", lambda self, n, *c: dealt(self, change(n), *c))  # noqa: B023
        assert run(spark, rows, 5, rows=32, query_rows=16, step=8, pivots=6) == want


def test_large_values_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-2 ** 24, 2 ** 24)) for _ in range(8)]) for i in range(80)]
    rows += [(100, [2.0 ** 24] * 8), (101, [2.0 ** 24] * 7 + [2.0 ** 24 - 2]), (102, [-2.0 ** 24] * 8), (105, [2.0 ** 43] * 8),
             (110, [-2.0 ** 43] * 8)]
    out = run(spark, [*rows, (103, [1e30] * 8), (104, [-1e30] * 8)], 5, rows=16, query_rows=16, step=4)
    clamp = lambda x: max(-2 ** 63, min(2 ** 63 - 1, x))
    assert out == {q: [(r, i, clamp(s)) for r, i, s in x] for q, x in brute(rows, 5, 10).items()}
    middle = [(i, [float(rng.randint(-2 ** 17, 2 ** 17)) for _ in range(8)]) for i in range(80)]  # between 53 and 62 bits
    assert run(spark, middle, 5, rows=16, query_rows=16, step=4) == brute(middle, 5, 10)

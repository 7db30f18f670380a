import random
import re
from collections import Counter

from helpers import SCHEMA, documents, frame, word

from acadspark.llm import decontaminate as dc


def cut(text):
    return [w for w in re.split(r"[\x00-/:-@\[-`{-\x7F]+", (text or "").lower()) if w]


def grams(w, size):
    return Counter(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def brute(docs, items, least=0.8):
    out = {}
    for d, t in set(docs):
        w = cut(t)
        for i, x in set(items):
            y = cut(x)
            size = min(5, len(y))
            if not y:
                continue
            g, best = grams(y, size), None
            for s in range(len(w) - len(y) + 1):
                c = grams(w[s:s + len(y)], size)
                both = sum((c & g).values())
                sim = both / (2 * sum(g.values()) - both)
                if sim >= least - 1e-12 and (best is None or sim > best[0]):
                    best = (sim, s, len(y))
            if best:
                out.setdefault((d, i), []).append((best[1], best[2], round(best[0], 9)))
    return {k: sorted(v) for k, v in out.items()}


def cases():
    rng = random.Random(9)
    items = [(i, " ".join(word(rng) for _ in range(rng.choice([1, 2, 4, 5, 6, 15, 40, 60])))) for i in range(30)]
    items += [(50, None), (51, ""), (52, " .,;"), (1, items[1][1]), (53, "rep " * 20), (54, items[2][1])]
    docs = documents(5, 20)
    for k, (i, x) in enumerate(items):
        w = (x or "").split()
        near = list(w)
        for _ in range(len(w) // 25):
            near[rng.randrange(len(near))] = "changed"
        pad = lambda: " ".join(word(rng) for _ in range(rng.randrange(40)))
        docs += [(200 + k, f"{pad()} {'; '.join(w).upper()} {pad()}"), (300 + k, f"{pad()} {' '.join(near)} {pad()}"),
                 (400 + k, f"{pad()} {' '.join(w[:len(w) * 2 // 3])} {pad()}")]
    docs += [docs[-5], docs[-5]]
    return [d for d in docs if len(d[1] or "") < 20_000], items


def test_against_brute_force(spark):
    docs, items = cases()
    bench = spark.createDataFrame([(i, t, "odd", 1) for i, t in items], "item_id long, text string, words string, n int")
    got = {}
    for r in dc.contaminated(frame(spark, docs), bench).collect():
        got.setdefault((r.doc_id, r.item_id), []).append((r.start, r.n_words, round(r.similarity, 9)))
    assert {k: sorted(v) for k, v in got.items()} == brute(docs, items)
    left = dc.clean(frame(spark, docs), bench)
    assert left.columns == frame(spark, docs).columns
    bad = {k for k, _ in brute(docs, items)}
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == sorted(str(r) for r in docs if r[0] not in bad)


def test_plans_are_native(spark):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    plan = dc.matches(dc.keyed(frame(spark, docs)), bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def test_hamming_blocks_meet_within_the_radius(spark):
    rng = random.Random(1)
    a = rng.getrandbits(64)
    values = set(dc.masks())
    for _ in range(500):
        b = a
        for bit in rng.sample(range(64), dc.RADIUS):
            b ^= 1 << bit
        assert any((a >> 8 * k & 255) ^ (b >> 8 * k & 255) in values for k in range(8))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    empty = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(none, bench).count() == 0
    docs = frame(spark, documents(1, 5))
    assert dc.contaminated(docs, empty).count() == 0
    assert dc.clean(docs, empty).count() == docs.count()


def test_items_of_the_same_words_are_one_text(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g"), (2, "A b, c d e f g"), (None, "a b c d e f g"), (2, "h i"), (2, "h i"), (3, " ")],
                                  "item_id long, text string")
    items, ids = dc.items_of(bench)
    assert sorted(r.n for r in items.collect()) == [2, 7]
    assert sorted(str(r.item_id) for r in ids.collect()) == ["1", "2", "2", "None"]
    got = dc.contaminated(frame(spark, [(7, "x h i a b c d e f g"), (8, "h i")]), bench).collect()
    assert sorted((r.doc_id, str(r.item_id), r.start, r.n_words) for r in got) == [
        (7, "1", 3, 7), (7, "2", 1, 2), (7, "None", 3, 7), (8, "2", 0, 2)]


def test_nothing_beyond_the_bound_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(dc, "SMALL", 0)  # the saved tables' files are far below Spark's own bound
    docs, items = cases()
    df = dc.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in df.collect()} == set(brute(docs, items))
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()

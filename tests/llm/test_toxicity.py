import random
import zlib

import numpy as np
import pytest
from helpers import SCHEMA, documents, frame

from acadspark.llm import toxicity as tx


def corpus(n=1500):
    rng = random.Random(0)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.choice([20, 100, 400]))
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "moron", "Scum,"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic), "odd"))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    y = {i: t for i, _, t, _ in labels}
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = tx.classify(frame(spark, rows), lab).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([r.predicted == y[r.doc_id] for r in out]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_pairs_of_terms_that_linear_weights_miss():
    """Toxic only if exactly both of two terms are there: the factors must say so."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(4000):
        a, b = rng.random(2) < 0.5
        noise = rng.choice(np.arange(10, 60), 5, replace=False)
        places = np.array(sorted({*([1] if a else []), *([2] if b else []), *noise}))
        rows.append((i, int(a == b), places))
    model = tx.fit(rows, bits=6, l1=0.0, epochs=30, rate=0.2, toxic_weight=1.0)
    place = np.concatenate([r[2] for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    right = (model.scores(place, doc, len(rows)) > 0.5) == np.array([r[1] for r in rows])
    assert right.mean() > 0.95  # without factors it would be about 0.5


def test_training_does_not_depend_on_the_order_of_rows():
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 3 == 0), np.unique(rng.integers(0, 256, 20))) for i in range(200)]
    a, b = tx.fit(rows, bits=8), tx.fit(rows[::-1], bits=8)
    assert a.bias == b.bias and (a.w == b.w).all() and (a.v == b.v).all()


@pytest.mark.parametrize("labels, share", [([], 0.0), ([(1, 0)], 0.0), ([(1, 1), (2, 1), (3, 1)], 1.0), ([(1, None), (None, 1)], 0.0)])
def test_labels_without_two_classes(spark, labels, share):
    rows = documents(4, 10)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = tx.classify(frame(spark, rows), lab).collect()
    assert len(got) == len(rows)
    assert all(abs(r.score - share) < 1e-6 for r in got)


def test_rejected_documents_go_and_columns_stay(spark):
    rows, labels = corpus(600)
    docs = frame(spark, rows + [(None, None), (9000, "")])
    left = tx.drop_toxic(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"))
    assert left.columns == docs.columns
    ids = {r.doc_id for r in left.collect()}
    assert {None, 9000} <= ids
    toxic = {i for i, _, t, _ in labels if t}
    assert len(toxic & ids) < 0.1 * len(toxic) and len(ids - toxic) > 0.97 * (602 - len(toxic))


def test_empty_table(spark):
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.classify(spark.createDataFrame([], SCHEMA), lab).count() == 0

"""Toxicity scores from a factorization machine over hashed terms (operator 10).

A document is the set of its terms: its words (runs of ASCII letters, digits
and non-ASCII bytes, A-Z in lower case) and, of words longer than five bytes,
the first five, so that an inflected insult meets its stem. Each term is
hashed to one of ``2 ** bits`` places. The score is

    sigmoid(w0 + sum_i w_i + 1/2 * sum_f ((sum_i v_if)^2 - sum_i v_if^2))

so besides the linear weights w every pair of terms adds the product of
their factors v_i . v_j: an insult beside a group mention can weigh more than
both alone. Linear weights are learned by FTRL with an L1 term (most terms of
a long text then weigh exactly nothing); factors exist only for terms with a
linear weight, and are learned by AdaGrad.

Learning uses a bounded sample: of each class the ``per_class`` labelled rows
with the smallest hash of their id. The model has a fixed size
(2 ** bits * (1 + factors) floats), so it may be broadcast. Scoring reads
every whole text.

Defined cases: null and empty texts have no terms and get sigmoid(w0); rows
with a null doc_id are scored and are not held out; several labels of one id
count as toxic if any is; labels without a toxic value or a document are not
used; without both classes among the labels every score is the share of toxic
labels (0 without labels). Repeated rows are scored each. Further columns are
kept by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import ALNUM, BYTE_VALUE, U64, Rolling, mix, slices, utf8, words

THRESHOLD = 0.7
STEM = 5


@dataclass
class Model:
    bias: float
    w: np.ndarray  # (2 ** bits,)
    v: np.ndarray  # (2 ** bits, factors)

    @property
    def bits(self) -> int:
        return len(self.w).bit_length() - 1

    def scores(self, place: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Scores of n documents from their distinct (doc, place) rows."""
        z = self.bias + np.bincount(doc, self.w[place], n)
        on = np.flatnonzero(self.w[place])  # factors of other terms are zero
        place, doc = place[on], doc[on]
        for f in range(self.v.shape[1]):
            x = self.v[place, f]
            z += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def terms(col: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document, place) rows of a slice of texts, by document."""
    w = words(*utf8(col), of=ALNUM, lower=True)
    long = np.flatnonzero(w.end - w.start > STEM)
    stem = mix(Rolling(BYTE_VALUE[w.data])(w.start[long], w.start[long] + STEM) + U64(1))
    doc = w.doc().astype(np.int64)
    key = (np.concatenate([doc, doc[long]]) << bits) | (
        np.concatenate([w.hash, stem]) >> U64(64 - bits)).astype(np.int64)
    key = np.unique(key)
    return key >> bits, key & ((1 << bits) - 1)


def is_held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1 (null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, bits: int = 18, per_class: int = 12_000) -> DataFrame:
    """(doc_id, toxic, places: packed 32-bit numbers) of the bounded sample of labelled rows that are not held out."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    order = F.xxhash64("doc_id")
    sample = [known.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    sample = sample[0].unionAll(sample[1])  # at most 2 * per_class rows of 12 bytes: a proven bound
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            doc, place = terms(b.column(1), bits)
            offs = np.searchsorted(doc, np.arange(b.num_rows + 1))
            packed = [place[x:y].astype(np.int32).tobytes() for x, y in zip(offs, offs[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(packed, pa.binary())],
                                             ["doc_id", "toxic", "places"])

    return joined.select("doc_id", "text", "toxic").mapInArrow(rows, "doc_id long, toxic int, places binary")


def fit(rows: list, bits: int = 18, factors: int = 4, epochs: int = 8, batch: int = 64,
        alpha: float = 1.5, l1: float = 8.0, l2: float = 0.02, rate: float = 0.05, toxic_weight: float = 2.0,
        seed: int = 7) -> Model:
    """Train on (doc_id, toxic, places) rows; they are ordered first, so the result does not depend on their order."""
    size = 1 << bits
    model = Model(-30.0, np.zeros(size), np.zeros((size, factors)))
    rows = sorted(rows, key=lambda r: (r[0], r[1], len(r[2])))
    y = np.array([r[1] for r in rows], float)
    if not len(rows) or y.min() == y.max():
        share = y.mean() if len(rows) else 0.0
        model.bias = float(np.log((share + 1e-13) / (1 - share + 1e-13)))
        return model
    places = [np.asarray(r[2]) for r in rows]
    rng = np.random.default_rng(seed)
    start = rng.normal(0, 0.05, (size, factors))
    z, n, g2 = np.zeros(size), np.zeros(size), np.full((size, factors), 1.0)
    model.bias, bias_g2 = float(np.log(y.mean() / (1 - y.mean()))), 1.0

    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at:at + batch]
            place = np.concatenate([places[i] for i in some])
            doc = np.repeat(np.arange(len(some)), [len(places[i]) for i in some])
            err = (model.scores(place, doc, len(some)) - y[some]) * np.where(y[some] > 0, toxic_weight, 1.0)
            # factors
            on = np.flatnonzero(model.w[place])
            p, d = place[on], doc[on]
            own, back = np.unique(p, return_inverse=True)
            x = model.v[p]
            for f in range(factors if len(own) else 0):
                s = np.bincount(d, x[:, f], len(some))
                g = np.bincount(back, err[d] * (s[d] - x[:, f]), len(own)) + 0.001 * model.v[own, f]
                g2[own, f] += g * g
                model.v[own, f] -= rate * g / np.sqrt(g2[own, f])
            # linear weights
            own, back = np.unique(place, return_inverse=True)
            g = np.bincount(back, err[doc], len(own))
            s = (np.sqrt(n[own] + g * g) - np.sqrt(n[own])) / alpha
            z[own] += g - s * model.w[own]
            n[own] += g * g
            was = model.w[own]
            model.w[own] = np.where(np.abs(z[own]) <= l1, 0.0,
                                    -(z[own] - np.sign(z[own]) * l1) / (np.sqrt(n[own]) / alpha + l2))
            fresh = own[(was == 0) & (model.w[own] != 0) & ~model.v[own].any(axis=1)]
            model.v[fresh] = start[fresh]
            g = err.sum()
            bias_g2 += g * g
            model.bias -= alpha * g / np.sqrt(bias_g2)
    model.v[model.w == 0] = 0
    return model


def train(docs: DataFrame, labels: DataFrame, bits: int = 18, per_class: int = 12_000, **options) -> Model:
    """Fit the model on the driver, on at most ``2 * per_class`` labelled documents."""
    rows = [(r.doc_id, r.toxic, np.frombuffer(r.places, np.int32))
            for r in training_rows(docs, labels, bits, per_class).collect()]
    return fit(rows, bits, **options)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column of scores in 0..1."""
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*held.value)
        for b in slices(batches, text):
            doc, place = terms(b.column(b.schema.get_field_index(text)), m.bits)
            s = m.scores(place, doc, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, name])

    return docs.mapInArrow(rows, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return (score(docs.select("doc_id", "text"), train(docs, labels, **options))
            .select("doc_id", is_held_out().alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that are not predicted toxic, with their columns."""
    model = train(docs, labels, **options)
    mark = "_toxicity"
    while mark in docs.columns:
        mark += "_"
    return score(docs, model, name=mark).where(F.col(mark) < threshold).drop(mark)

"""Exact top-k inner products by pivot-table elimination (operator 7).

Vectors become integers, floor(scale * x). Every candidate x is lifted to
(x, sqrt(R^2 - |x|^2)), with R the largest norm, and every query q to (q, 0):
all candidates then have length R, and a larger inner product is a smaller
distance, |q - x|^2 = |q|^2 + R^2 - 2 q.x.

* The pivot table: the distances of every candidate to ``pivots`` candidates
  (those with the smallest hash of their id: a bounded, fixed choice). By the
  triangle inequality max_p |d(q, p) - d(x, p)| is a lower bound of d(q, x).
* Candidates are evaluated in the order of their bounds, a block of
  ``step`` at a time; a query stops exactly when the next bound exceeds the
  distance of the k-th best found. The best scores among the pivots give
  every block a first threshold.
* Scores are exact integers; distances only decide what is evaluated, and
  bounds are lowered by more than the rounding error first. Ties go to the
  smaller id.

Queries and candidates meet in blocks: a candidate's group, of about ``rows``,
is a hash of its id and a column of its row, so it does not depend on how Spark
deals rows; queries are packed in blocks of ``query_rows`` and each block is
sent once to every group. The join's rows are (query block, candidate block)
pairs, each with bounded memory; each gives at most k rows a query, and the k
best of those are kept. Both sides are dealt by group to a stated number of
partitions, as the work of a pair is not seen from its bytes.

Defined cases: vectors that are null, or hold a null or non-finite component,
take no part; neither do those with a component whose scaled value is beyond
2^53, where doubles no longer tell integers apart, nor rows with a null id;
vectors of different lengths are not compared; repeated candidates are
candidates each, and a query's own id is never its candidate; repeated query
rows count as one; sums that could leave 62 bits are taken in integers of any
size, ranked exactly, and reported as the nearest long if they are none; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: a score is high * 2^62 + low
RESULT = "query_id long, vec_id long, high long, low long"
LOW_BITS = 62
NONE = np.iinfo(np.int64).min


def integers(vectors: DataFrame, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v array<long>) of the rows that take part."""
    v = F.col(embedding)
    # NaN and infinities fail the comparison; null components make forall null
    fine = F.coalesce(F.forall(v, lambda x: F.abs(x.cast("double") * scale) <= F.lit(float(2 ** 53))) & (F.size(v) > 0),
                      F.lit(False))
    return (vectors.where(F.col(vec_id).isNotNull() & fine)
            .select(F.col(vec_id).cast("long").alias("id"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0), np.int64)


def _top(a: np.ndarray, b: np.ndarray) -> float:
    """No sum of products of rows of a and b is larger."""
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T, of sums that fit 62 bits; by floats if they fit 53."""
    if _top(a, b) < 2 ** 53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def search_block(q: np.ndarray, q_id: np.ndarray, q_far: np.ndarray, floor: np.ndarray, x: np.ndarray, x_id: np.ndarray,
                 x_far: np.ndarray, radius: float, k: int, step: int) -> list[np.ndarray]:
    """The k best candidates of a block for each query of a block: query ids, candidate ids, scores (high and low).

    q_far, x_far: distances to the pivots; floor: a score that k other candidates reach, per query.
    """
    if _top(q, x) >= 2 ** LOW_BITS:
        return large_block(q, q_id, x, x_id, k)
    bound = np.zeros((len(q), len(x)))
    for p in range(q_far.shape[1]):
        np.maximum(bound, np.abs(q_far[:, p, None] - x_far[None, :, p]), out=bound)
    q2 = (q.astype(float) ** 2).sum(1)
    # the largest score a bound allows, raised by more than the rounding error
    cap = (q2[:, None] + radius ** 2 - bound ** 2) / 2
    cap += 1e-6 * (q2[:, None] + radius ** 2) + 1
    order = np.argsort(-cap, axis=1, kind="stable")
    best = np.full((len(q), k), NONE)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max)
    threshold = floor.copy()
    live = np.arange(len(q))
    for at in range(0, len(x), step):
        some = order[live, at:at + step]
        going = np.take_along_axis(cap[live], some[:, :1], 1)[:, 0] >= threshold[live]
        live, some = live[going], some[going]
        if not len(live):
            break
        # candidates wanted by any live query, evaluated together
        want, place = np.unique(some, return_inverse=True)
        place = place.reshape(some.shape)
        s = np.take_along_axis(_products(q[live], x[want]), place, 1)
        own = x_id[some]
        s = np.where(own == q_id[live, None], NONE, s)
        own = np.where(own == q_id[live, None], np.iinfo(np.int64).max, own)
        s, own = np.concatenate([best[live], s], 1), np.concatenate([best_id[live], own], 1)
        rank = np.lexsort((own, ~s), axis=1)[:, :k]
        best[live], best_id[live] = np.take_along_axis(s, rank, 1), np.take_along_axis(own, rank, 1)
        threshold[live] = np.maximum(threshold[live], best[live, k - 1])
    found = best > NONE
    best = best[found]
    return [np.broadcast_to(q_id[:, None], found.shape)[found], best_id[found], best >> LOW_BITS, best & ((1 << LOW_BITS) - 1)]


def large_block(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> list[np.ndarray]:
    """The same for sums that 62 bits may not hold: floats choose, with more than their error to spare; integers decide."""
    a, b = q.astype(float), x.astype(float)
    about = a @ b.T
    error = 1e-12 * np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1).max(initial=0)) * max(1, q.shape[1] / 1000)
    out = []
    for i in range(len(q)):
        others = np.flatnonzero(x_id != q_id[i])
        if len(others) > k:
            least = np.partition(about[i, others], -k)[-k] - 2 * error[i]
            others = others[about[i, others] >= least]
        mine = [int(v) for v in q[i]]
        scored = sorted((-sum(v * int(w) for v, w in zip(mine, x[j])), int(x_id[j])) for j in others)[:k]
        out += [(q_id[i], c, -s >> LOW_BITS, -s & ((1 << LOW_BITS) - 1)) for s, c in scored]
    return [np.array(c, np.int64) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4




def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, pivots: int = 32, rows: int = 4096,
          query_rows: int = 256, step: int = 512, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query row.

    ``is_query`` is a condition on the column ``id``.
    """
    spark = vectors.sparkSession
    every = save(integers(vectors, scale, vec_id, embedding).withColumn("d", F.size("v")), "topk-integers")
    sizes = every.groupBy("d").agg(F.count("*").alias("n"),
                                   F.max(F.expr("aggregate(v, 0D, (s, x) -> s + double(x) * x)")).alias("r2"))
    out = None
    for size in sizes.orderBy("d").collect():  # one row for each vector length in use
        some = every.where(F.col("d") == size["d"])
        found = _search(some, is_query, k, pivots, size["d"], size["n"], float(np.sqrt(size["r2"])) * (1 + 1e-9), rows,
                        query_rows, step)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    score = (F.when(F.col("high").between(-2, 1), F.shiftleft("high", LOW_BITS) + F.col("low"))
             .otherwise(F.when(F.col("high") > 0, F.lit(2 ** 63 - 1)).otherwise(F.lit(-2 ** 63))))
    return (out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", score.alias("score")))


def _search(every: DataFrame, is_query: Column, k: int, pivots: int, d: int, n: int, radius: float, rows: int,
            query_rows: int, step: int) -> DataFrame:
    spark = every.sparkSession
    chosen = every.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()  # `pivots` rows
    pv = np.array([r["v"] for r in chosen], np.int64).reshape(len(chosen), d)
    pid = np.array([r["id"] for r in chosen], np.int64)
    held = spark.sparkContext.broadcast((pv, pid))

    def far(v: np.ndarray, lifted: bool) -> np.ndarray:
        """Distances to the pivots in the lifted space."""
        p = held.value[0].astype(float)
        v = v.astype(float)
        lift = lambda a: np.sqrt(np.maximum(radius ** 2 - (a * a).sum(1), 0))
        last = lift(v) if lifted else np.zeros(len(v))
        d2 = (v * v).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * v @ p.T + (last[:, None] - lift(p)[None, :]) ** 2
        return np.sqrt(np.maximum(d2, 0))

    def blob(b: pa.RecordBatch, query: bool) -> list[pa.Array]:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        v = _matrix(b.column(1))
        dist = far(v, not query)
        extra = np.zeros(0, np.int64)
        if query:  # a score that k candidates reach, from the pivots that are not the query itself
            p, p_id = held.value
            extra = np.full(len(v), NONE)
            if p.shape[0] >= k and _top(v, p) < 2 ** LOW_BITS:
                extra = np.sort(np.where(p_id[None, :] == ids[:, None], NONE, _products(v, p)), 1)[:, -k]
        return [pa.array([x.tobytes()]) for x in (ids, v, dist, extra)]

    def asked_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, query_rows):
                yield pa.RecordBatch.from_arrays(blob(b.slice(at, query_rows), True), ["ids", "v", "far", "floor"])

    def group_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a block is of one group and holds ``rows`` at most."""
        waiting: list[pa.RecordBatch] = []

        def flushed():
            some = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting.clear()
            return pa.RecordBatch.from_arrays([*blob(some, False)[:3], some.column(2).slice(0, 1)], ["x_ids", "x_v", "x_far", "g"])
        for b in batches:
            g = b.column(2).to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(g)) + 1, len(g)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                while lo < hi:
                    if waiting and (waiting[0].column(2)[0].as_py() != g[lo] or sum(w.num_rows for w in waiting) >= rows):
                        yield flushed()
                    take = min(hi - lo, rows - sum(w.num_rows for w in waiting))
                    waiting.append(b.slice(lo, take))
                    lo += take
        if waiting:
            yield flushed()

    groups = max(1, -(-n // rows))
    tasks = 4 * groups  # so that few groups share a task; the count is fixed, as AQE would join tasks by their bytes
    candidates = (every.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"))
                  .repartition(tasks, "g").sortWithinPartitions("g")
                  .mapInArrow(group_blocks, "x_ids binary, x_v binary, x_far binary, g int").repartition(tasks, "g"))
    asked = every.where(is_query).dropDuplicates(["id"]).select("id", "v")
    blocks = (asked.mapInArrow(asked_blocks, "ids binary, v binary, far binary, floor binary")
              .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(tasks, "g"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(held.value[0])
        for b in batches:
            for r in range(b.num_rows):
                get = lambda c, kind: np.frombuffer(b.column(c)[r].as_py(), kind)  # noqa: B023, E731
                q_id, x_id = get("ids", np.int64), get("x_ids", np.int64)
                q, x = get("v", np.int64).reshape(len(q_id), d), get("x_v", np.int64).reshape(len(x_id), d)
                q_far, x_far = get("far", float).reshape(len(q_id), p), get("x_far", float).reshape(len(x_id), p)
                out = search_block(q, q_id, q_far, get("floor", np.int64), x, x_id, x_far, radius, k, step)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "high", "low"])

    return candidates.join(blocks, "g").drop("g").mapInArrow(meet, RESULT)

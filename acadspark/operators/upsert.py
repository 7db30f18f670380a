"""Keyed loads: D3 last-row-wins, A8 dense surrogate ids, A4/C4 upsert, B15 touch.

Spark has no MERGE for plain Parquet, so an upsert is a full outer join on the
key that produces the next version of the table; callers write it to a new
version folder (see ``sources.sinks.write_version``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """D3: one row per key, the one with the greatest ``order`` tuple.

    A hash aggregate with map-side partial aggregation: a hot key collapses to
    one row per map task before the shuffle, so skew costs nothing. ``order``
    must be unique inside a key for a deterministic answer; remaining columns
    are appended as tie-breakers so equal orders still give one fixed row.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    tie = [c for c in rest if c not in order]
    # the order and the tie-breakers hold every column, so the greatest of them is the row: no column is shuffled twice
    winner = F.max(F.struct(*[F.col(c) for c in dict.fromkeys([*order, *tie])])).alias("_w")
    return df.groupBy(*keys).agg(winner).select(*keys, *[F.col(f"_w.{c}").alias(c) for c in rest])


def _base_id(target: DataFrame | None, id_col: str) -> Column:
    if target is None:
        return F.lit(0).cast("long")
    return target.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).scalar()


def assign_ids(new_keys: DataFrame, keys: Sequence[str], id_col: str = "id",
               target: DataFrame | None = None) -> DataFrame:
    """Dense ids ``max(target.id)+1 ..`` for ``new_keys`` (unique), in key order.

    No single-partition sort: range-partition on the key, number rows inside
    each sorted partition, and add the running count of earlier partitions.
    The partition-count table has one row per partition, the only global
    window runs over it. The ranged data is checkpointed to the shared folder
    so both passes see the same partitioning even after executor loss.
    """
    keys = list(keys)
    ensure_checkpoint_dir(new_keys.sparkSession)
    ranged = (new_keys.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_ord", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33))
              .checkpoint(eager=True))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .select(*keys, (_base_id(target, id_col) + F.col("_off") + F.col("_ord") + 1).alias(id_col)))


def upsert(target: DataFrame, src: DataFrame, keys: Sequence[str], set_cols: Sequence[str],
           run_ts, id_col: str | None = "id", created_col: str | None = "created_at",
           updated_col: str | None = "updated_at", touch: bool = True,
           ids_after: DataFrame | None = None) -> DataFrame:
    """INSERT .. ON CONFLICT (keys) DO UPDATE SET set_cols.

    * matched key: ``set_cols`` come from ``src`` (even when NULL: the new
      value wins), every other column is kept; ``updated_col`` is touched.
    * new key: inserted with a fresh dense id and ``run_ts`` timestamps.
    * target-only key: unchanged.
    ``src`` must be unique on ``keys`` (use ``last_wins`` first). ``run_ts`` is a
    literal per run, so a retried run writes identical output. New ids start
    after ``max(id)`` of ``ids_after`` (default: ``target``), so a caller that
    passes only part of a table still gets ids unique in the whole table.
    """
    keys = list(keys)
    ts = F.lit(run_ts).cast("timestamp_ntz") if not isinstance(run_ts, Column) else run_ts
    s = src
    new_id = f"_s_{id_col}"            # inserts keep an id the source brings ...
    if id_col is not None and id_col not in src.columns:
        new_id = "_s__new_id"          # ... or get a fresh dense one
        new_keys = src.select(*keys).join(target.select(*keys), keys, "left_anti")
        base = target if ids_after is None else ids_after
        s = src.join(assign_ids(new_keys, keys, "_new_id", target=base.select(F.col(id_col).alias("_new_id"))),
                     keys, "left")
    # prefix the non-key columns of both sides, so the join never has to tell
    # two same-named (or same-lineage) attributes apart
    s = s.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in s.columns if c not in keys],
                 F.lit(True).alias("_in_s"))
    t = target.select(*keys, *[F.col(c).alias(f"_t_{c}") for c in target.columns if c not in keys],
                      F.lit(True).alias("_in_t"))
    j = t.join(s, keys, "full_outer")
    in_s, in_t = F.col("_in_s").isNotNull(), F.col("_in_t").isNotNull()
    src_cols = set(src.columns)

    out = []
    for c in target.columns:
        tc = F.col(f"_t_{c}")
        if c in keys:
            out.append(F.col(c))
        elif c == id_col:
            out.append(F.when(in_t, tc).otherwise(F.col(new_id)).alias(c))
        elif c == created_col:
            out.append(F.when(in_t, tc).otherwise(ts).alias(c))
        elif c == updated_col:
            expr = F.when(in_t & in_s & F.lit(touch), ts).when(in_t, tc).otherwise(ts)
            out.append(expr.alias(c))
        elif c in set_cols and c in src_cols and c != id_col:
            out.append(F.when(in_s, F.col(f"_s_{c}")).otherwise(tc).alias(c))
        elif c in src_cols:
            # not updated on conflict, but supplied for inserts
            out.append(F.when(in_t, tc).otherwise(F.col(f"_s_{c}")).alias(c))
        else:
            out.append(tc.alias(c))
    return j.select(*out)

"""C4: tables stored bucketed by key, so that an upsert shuffles only the load.

``write_bucketed`` stores a table by Spark's bucketing: the hash that a join on
the key would deal rows by decides the bucket, one file a bucket. A join on the
key then reads the stored side as it lies, a task a bucket, and exchanges the
other side only: an upsert of a day's load into a table of any size moves the
load. The next version is written under another name, from the join's own
partitions, so it is not shuffled either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import upsert
from ..session import shared_path


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], n_buckets: int, path: str | None = None,
                   dealt: bool = False) -> DataFrame:
    """Stores ``df`` as the table ``name``, bucketed by ``keys``; returns it as read back.

    dealt: the rows are dealt by the keys to as many partitions already. ``path`` defaults to the shared folder.
    """
    spark = df.sparkSession
    rows = df if dealt else df.repartition(n_buckets, *keys)
    (rows.write.bucketBy(n_buckets, *keys).sortBy(*keys).mode("overwrite").format("parquet")
     .option("path", path or shared_path(spark, "bucketed", name)).saveAsTable(name))
    return spark.table(name)


def merged(spark: SparkSession, name: str, src: DataFrame, keys: Sequence[str], set_cols: Sequence[str], run_ts,
           n_buckets: int, id_col: str | None = None, **upsert_args) -> DataFrame:
    """The next version of the bucketed table ``name``: ``src`` (unique on ``keys``, with ids if the table has them) merged in.

    The load is dealt to the table's buckets once; the plan has no exchange on the table's side. The hint keeps Spark
    from sending the load to all tasks or the table to few.
    """
    target = spark.table(name)
    load = src.repartition(n_buckets, *keys).hint("merge")
    return upsert(target, load, keys, set_cols, run_ts, id_col=id_col, **upsert_args)


def upsert_table(spark: SparkSession, name: str, src: DataFrame, keys: Sequence[str], set_cols: Sequence[str], run_ts,
                 n_buckets: int, to: str, **args) -> DataFrame:
    """Writes ``merged`` as the table ``to``, bucketed alike, without another shuffle; returns it."""
    if to == name:
        raise ValueError("a table can't be overwritten while it is read; give the next version a name of its own")
    rows = merged(spark, name, src, keys, set_cols, run_ts, n_buckets, **args)
    # a full outer join gives its key as coalesce(left, right), which Spark does not know to be dealt by; rows of a bucket
    # are still in one task, and the writer puts each row into the file of its own bucket
    return write_bucketed(rows.select(*(F.col(c) for c in spark.table(name).columns)), to, keys, n_buckets, dealt=True)

"""Sinks: versioned table writes (the upsert target), reject files and change logs.

A table is a folder of versions ``<path>/v=<n>``. Writing version n
overwrites only that partition (dynamic partition overwrite), so a retried
or replayed load rewrites the same version and readers of older versions are
never disturbed. The current table is the highest version below the one
being written, selected by a scalar subquery that prunes partitions at run
time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

VERSION_COL = "v"


def write_version(df: DataFrame, path: str, version: int) -> None:
    (df.withColumn(VERSION_COL, F.lit(int(version)).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(VERSION_COL).parquet(path))


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table; None when its folder is not there yet. Any other failure is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version (optionally the newest below ``before``); None when there is none yet."""
    t = read_table(spark, path)
    if t is None:
        return None
    older = t if before is None else t.where(F.col(VERSION_COL) < before)
    latest = older.agg(F.max(VERSION_COL)).scalar()
    return older.where(F.col(VERSION_COL) == latest).drop(VERSION_COL)


def write_rejects(rejects: DataFrame, path: str, batch_id: int) -> None:
    """Reject rows of one load under ``<path>/batch_id=<n>``; rewriting a batch replaces it."""
    out = rejects.select(
        *[c for c in ("source_file", "row_no") if c in rejects.columns],
        F.array_join("reasons", ",").alias("reasons"))
    target = f"{path.rstrip('/')}/batch_id={int(batch_id)}"
    out.write.mode("overwrite").parquet(target)


def append_log(df: DataFrame, path: str) -> None:
    """Append change-log rows."""
    df.write.mode("append").parquet(path)


BUCKET_COL = "bucket"


def key_bucket(keys, n_buckets: int):
    """Stable bucket of a key: pmod(xxhash64(keys), n)."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(n_buckets)).cast("int")


def upsert_buckets(spark: SparkSession, path: str, src: DataFrame, keys, set_cols, run_ts,
                   n_buckets: int = 256, **upsert_args) -> DataFrame:
    """A4 for large tables: only the key buckets a load touches are read and rewritten.

    The table lives at ``<path>/bucket=<b>``. The touched bucket numbers (at
    most ``n_buckets`` integers, a bounded list) become a static partition
    filter, so the scan lists and reads only those folders; ids continue after
    the maximum of the *whole* table (a one-column aggregate). The new bucket contents are checkpointed (the job reads
    and then overwrites the same folder) and written by dynamic partition
    overwrite, so untouched buckets keep their files and a retry rewrites
    the same buckets with the same rows. Returns the rewritten rows.
    """
    from ..operators.ingest import empty_target
    from ..operators.upsert import upsert

    keys = list(keys)
    s = src.withColumn(BUCKET_COL, key_bucket(keys, n_buckets))
    touched = sorted(r[0] for r in s.select(BUCKET_COL).distinct().collect())   # <= n_buckets ints
    table = read_table(spark, path)
    if table is None:
        target, whole = empty_target(src), None
    else:
        target = table.where(F.col(BUCKET_COL).isin(touched)).drop(BUCKET_COL)
        whole = table.select(*[c for c in table.columns if c != BUCKET_COL])
    new = upsert(target, s.drop(BUCKET_COL), keys, set_cols, run_ts, ids_after=whole, **upsert_args)
    new = new.withColumn(BUCKET_COL, key_bucket(keys, n_buckets)).checkpoint(eager=True)
    (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET_COL).parquet(path))
    return new

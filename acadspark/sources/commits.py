"""Keyed tables whose commits become visible at once, by a pointer file.

A table is a folder with
  data/<commit>/bucket=<b>/   rows of the key buckets that a commit rewrote
  manifests/v<n>.json         version n: for each bucket its commit folder, row count and digest

A commit writes its buckets to a folder of its own and then publishes the next
manifest by renaming a finished file. Readers take the newest manifest and list
only the folders in it: a load killed at any point before the rename changes
nothing for them (what it wrote is never referred to), and one that is killed
after it is complete. A manifest has at most one entry a bucket, so it is small
whatever the table's size; older versions stay readable.

* Replays: a manifest holds the highest batch number applied. A batch that is
  not higher is skipped, so a replayed load gives the same table.
* Order across batches: with ``order`` columns (file time, file, row number) kept
  in the table, a row of an older file that arrives in a later batch does not
  overwrite a newer one.
* Digests: a bucket's digest is the sum of its rows' hashes, whatever their
  order. Two versions are compared by their manifests first; only buckets
  whose digests differ are read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quality import diff
from ..operators.upsert import upsert
from .sinks import BUCKET_COL, key_bucket


class Conflict(RuntimeError):
    """Another load published the same version first."""


def _fs(spark: SparkSession, path: str):
    """(file system, function to a path of it) by Hadoop's own classes, as tables may lie in any store."""
    jvm = spark.sparkContext._jvm
    made = jvm.org.apache.hadoop.fs.Path
    return made(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


def manifests(spark: SparkSession, path: str) -> list[int]:
    """The version numbers of a table, oldest first."""
    fs, made = _fs(spark, path)
    folder = made(f"{path}/manifests")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The manifest of a version (default: the newest); None if there is none."""
    known = manifests(spark, path)
    if not known or version is not None and version not in known:
        return None
    fs, made = _fs(spark, path)
    stream = fs.open(made(f"{path}/manifests/v{version if version is not None else known[-1]}.json"))
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def publish(spark: SparkSession, path: str, content: dict) -> None:
    """Makes a version visible: its manifest is finished under another name, then renamed."""
    fs, made = _fs(spark, path)
    target = made(f"{path}/manifests/v{content['version']}.json")
    if fs.exists(target):
        raise Conflict(f"version {content['version']} is there already")
    draft = made(f"{path}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if not fs.rename(draft, target):
        raise Conflict(f"version {content['version']} was published by another load")


def read_commit(spark: SparkSession, path: str, version: int | None = None,
                buckets: Sequence[int] | None = None) -> DataFrame | None:
    """The rows of a version (default: the newest), of some buckets or all; only their folders are listed and read."""
    m = manifest(spark, path, version)
    if m is None:
        return None
    schema = T.StructType.fromJson(m["schema"])
    some = m["buckets"] if buckets is None else {str(b): m["buckets"][str(b)] for b in buckets if str(b) in m["buckets"]}
    paths = [f"{path}/data/{x['folder']}/{BUCKET_COL}={b}" for b, x in some.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def row_digest(columns: Sequence[str]):
    """The hash of a row, as a number whose sums can't overflow (of 10^19 rows at most)."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")


def write_buckets(rows: DataFrame, path: str, folder: str, keys: Sequence[str], n_buckets: int) -> dict[str, dict]:
    """Writes the rows by key bucket; returns each bucket's manifest entry."""
    spark = rows.sparkSession
    columns = rows.columns
    # AQE puts a bucket's rows together and splits a bucket that is too large for a task
    (rows.withColumn(BUCKET_COL, key_bucket(keys, n_buckets)).hint("rebalance", BUCKET_COL)
     .write.partitionBy(BUCKET_COL).parquet(f"{path}/data/{folder}"))
    written = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField(BUCKET_COL, T.IntegerType())])).parquet(
        f"{path}/data/{folder}")
    digests = written.groupBy(BUCKET_COL).agg(F.count(F.lit(1)).alias("rows"), row_digest(columns).alias("digest"))
    return {str(r[BUCKET_COL]): {"folder": folder, "rows": r["rows"], "digest": r["digest"]}
            for r in digests.collect()}  # a row a bucket


def commit(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], n_buckets: int = 256,
           batch_id: int | None = None, before: dict | None = None, facts: dict | None = None) -> dict:
    """Publishes the next version: the buckets of ``rows`` as they are given, all others as in ``before`` (default: the
    newest version)."""
    before = before if before is not None else manifest(spark, path)
    if before is not None and before["n_buckets"] != n_buckets:
        raise ValueError(f"the table has {before['n_buckets']} buckets, not {n_buckets}")
    entries = write_buckets(rows, path, uuid.uuid4().hex, keys, n_buckets)
    last = None if before is None else before["batch"]
    content = {"version": 1 if before is None else before["version"] + 1, "n_buckets": n_buckets, "keys": list(keys),
               "batch": batch_id if batch_id is not None else last, "schema": json.loads(rows.schema.json()),
               "buckets": {**(before["buckets"] if before else {}), **entries}, **(facts or {})}
    publish(spark, path, content)
    return content


def upsert_commit(spark: SparkSession, path: str, src: DataFrame, keys: Sequence[str], set_cols: Sequence[str], run_ts,
                  n_buckets: int = 256, batch_id: int | None = None, order: Sequence[str] = (), id_col: str = "id",
                  touch: bool = True) -> dict:
    """A4 as one commit: the buckets that ``src`` (unique on ``keys``) touches are read, merged and published at once.

    With ``order``, columns of ``src`` that are stored too, only rows whose order is higher than that of the stored row
    are merged. New ids go on from the highest id ever given, which the manifest holds. Returns the manifest in force.
    """
    from ..operators.ingest import empty_target
    keys, order = list(keys), list(order)
    now = manifest(spark, path)
    if now is not None and batch_id is not None and now["batch"] is not None and batch_id <= now["batch"]:
        return now
    s = src.withColumn(BUCKET_COL, key_bucket(keys, n_buckets))
    touched = sorted(r[0] for r in s.select(BUCKET_COL).distinct().collect())  # n_buckets numbers at most
    if now is not None and not touched:
        return now
    target = empty_target(src) if now is None else read_commit(spark, path, now["version"], touched)
    new = s.drop(BUCKET_COL)
    if order and now is not None:
        stored = target.select(*keys, F.struct(*order).alias("_stored"))
        new = new.join(stored, keys, "left").where(F.col("_stored").isNull() | (F.struct(*order) > F.col("_stored"))).drop("_stored")
    top = 0 if now is None else now["top_id"]
    merged = upsert(target, new, keys, [*set_cols, *(c for c in order if c not in set_cols)], run_ts, id_col=id_col, touch=touch,
                    ids_after=spark.createDataFrame([(top,)], f"{id_col} long"))
    merged = merged.checkpoint(eager=True)  # read twice, and ids must not be given anew
    top = max(top, merged.agg(F.max(id_col)).first()[0] or 0)
    return commit(spark, path, merged, keys, n_buckets, batch_id, now, {"top_id": top})


def diff_commits(spark: SparkSession, path: str, old: int, new: int, other: str | None = None) -> DataFrame:
    """C6 between two versions (of one table, or of ``path`` and ``other``): only buckets whose digests differ are read
    and joined, as a static list of folders."""
    a, b = manifest(spark, path, old), manifest(spark, other or path, new)
    if a is None or b is None:
        raise ValueError("no such version")
    if (a["n_buckets"], a["keys"]) != (b["n_buckets"], b["keys"]):
        raise ValueError("versions with other buckets can't be compared bucket by bucket")
    same_columns = a["schema"] == b["schema"]
    mark = lambda m, k: tuple(m["buckets"].get(k, {}).get(x) for x in ("rows", "digest"))
    changed = [int(k) for k in sorted({*a["buckets"], *b["buckets"]}) if not same_columns or mark(a, k) != mark(b, k)]
    return diff(read_commit(spark, path, old, changed), read_commit(spark, other or path, new, changed), a["keys"])


# --- A11: a change log that survives retries ------------------------------------------------------------------------

def write_log(changes: DataFrame, path: str, batch_id: int) -> None:
    """The change-log rows of a batch, in a folder of its own: writing the batch again replaces it."""
    changes.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={int(batch_id)}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All change-log rows with their ``batch``."""
    return spark.read.option("basePath", path).parquet(path).withColumn("batch", F.col("batch").cast("long"))


def rewind(current: DataFrame, log: DataFrame, keys: Sequence[str], after: int) -> DataFrame:
    """The table as it was when batch ``after`` had been applied: the log folded backwards from ``current``.

    log: ``batch``, ``action``, ``old_values``, ``new_values`` (JSON images) with at most one row a key and batch. Of
    each key's later changes only the first matters, an aggregate with map-side combine: its old image stands if it
    has one, and if it was an insert, the key was not there. Keys without later changes keep their row.
    """
    keys = list(keys)
    schema = current.schema
    later = log.where(F.col("batch") > after)
    image = F.from_json(F.coalesce("old_values", "new_values"), schema)
    first = (later.select("batch", "old_values", image.alias("_i"))
             .groupBy(*(F.col(f"_i.{k}").alias(k) for k in keys))
             .agg(F.min_by(F.struct("old_values", "_i"), "batch").alias("_f")))
    kept = current.join(first.select(*keys), keys, "left_anti").select(*current.columns)
    back = first.where(F.col("_f.old_values").isNotNull()).select(*(F.col(f"_f._i.{c}").alias(c) for c in current.columns))
    return kept.unionByName(back)

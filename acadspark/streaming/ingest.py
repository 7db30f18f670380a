"""A10: continuous ingest -- new CSV files in a folder are loaded as they arrive.

Structured Streaming's file source tracks which files were processed (in
the checkpoint); ``foreachBatch`` gets the new files' paths and loads them
with the batch reader, so a stream reads exactly what a batch does. One
micro-batch may hold several files: rows are ordered by (file modification
time, file, row number) for last-row-wins. Each batch writes table version
``v=<batch_id>`` by dynamic partition overwrite and its rejects under
``batch_id=<id>``, so a replayed batch rewrites exactly the same output
(idempotent sink).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import CONTRACTS, TOUCHED_TABLES
from ..operators.contract import split_valid
from ..operators.ingest import NOT_STORED, SET_COLUMNS, load
from ..operators.upsert import last_wins
from ..sources.commits import upsert_commit
from ..sources.csv import literal_path, scan_csv
from ..sources.sinks import read_current, upsert_buckets, write_rejects, write_version


def ingest_batch(spark: SparkSession, paths: Sequence[str], batch_id: int, contract: str, table_path: str,
                 rejects_path: str, report_path: str | None = None, mode: str = "quarantine",
                 n_buckets: int | None = None, multiline: bool = True, max_file_bytes: int | None = None,
                 committed: bool = False) -> None:
    """Load the CSV files of one micro-batch.

    Table layout: versions ``v=<batch_id>`` (default; every batch writes the
    whole next version, older versions stay readable), or with ``n_buckets``
    key buckets rewritten in place (``sinks.upsert_buckets``: a batch touches
    only the buckets of its keys -- the layout for large tables). With
    ``committed`` as well, a batch becomes visible at once by a manifest
    (``sources.commits``), a replayed batch is skipped, and a row of an older
    file does not overwrite one of a newer file that came in an earlier batch.
    """
    rows = scan_csv(spark, [literal_path(p) for p in paths], "*", multiline, max_file_bytes)
    # the run timestamp is a property of the batch's files, so a replay reproduces it
    run_ts = rows.agg(F.max("source_mtime")).scalar()
    c = CONTRACTS[contract]
    if n_buckets:
        res = load(rows, c, None, run_ts, mode, persist=True, build_table=False)
    else:
        res = load(rows, c, read_current(spark, table_path, before=batch_id), run_ts, mode, persist=True)
    try:
        if n_buckets and not res.poisoned:
            good, _ = split_valid(res.rows)
            order = [x for x in ("source_mtime", "source_file", "row_no") if x in good.columns]
            keep = [x for x in good.columns if x not in NOT_STORED.get(c.name, ()) and x not in order
                    and x != "reasons"]
            src = last_wins(good.select(*keep, *order), list(c.keys), order)
            set_cols = SET_COLUMNS.get(c.name, [x for x in keep if x not in c.keys])
            if committed:
                upsert_commit(spark, table_path, src, list(c.keys), set_cols, run_ts, n_buckets, batch_id, order,
                              touch=c.table in TOUCHED_TABLES)
            else:
                upsert_buckets(spark, table_path, src.drop(*order), list(c.keys), set_cols, run_ts, n_buckets=n_buckets,
                               touch=c.table in TOUCHED_TABLES)
        elif not n_buckets:
            write_version(res.table, table_path, batch_id)
        write_rejects(res.rejects, rejects_path, batch_id)
        if report_path is not None:
            res.report.write.mode("overwrite").parquet(f"{report_path.rstrip('/')}/batch_id={int(batch_id)}")
    finally:
        res.rows.unpersist()


def ingest_stream(spark: SparkSession, in_dir: str, contract: str, out_dir: str, checkpoint: str,
                  glob: str = "*.csv", mode: str = "quarantine", available_now: bool = True,
                  max_files_per_trigger: int | None = None, n_buckets: int | None = None,
                  multiline: bool = True, max_file_bytes: int | None = None, committed: bool = False):
    """Start the ingest stream; returns the ``StreamingQuery``.

    ``out_dir`` receives ``table/``, ``rejects/`` and ``reports/``. With
    ``available_now`` the query processes what is there and stops (batch-like
    scheduling with streaming bookkeeping). ``max_files_per_trigger`` bounds
    the paths of one micro-batch.
    """
    reader = (spark.readStream.format("binaryFile").option("pathGlobFilter", glob)
              .schema("path string, modificationTime timestamp, length long, content binary"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.load(in_dir).select("path")  # file contents are not read here
    base = out_dir.rstrip("/")

    def run(batch: DataFrame, batch_id: int) -> None:
        paths = sorted(r["path"] for r in batch.collect())  # one path per new file
        if paths:
            ingest_batch(spark, paths, batch_id, contract, f"{base}/table", f"{base}/rejects", f"{base}/reports",
                         mode, n_buckets, multiline, max_file_bytes, committed)

    writer = src.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


__all__ = ["ingest_batch", "ingest_stream"]

"""Catalogue: real CSV files (A1-A3) and the continuous file-stream ingest (A10).

The departments upload derived from ``customer`` is written as CSV files to
the shared folder named by ``spark.checkpoint.dir`` and read back through the
CSV source; the stream query loads the same files with Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.contract import apply_contract, split_valid
from ..operators.upsert import last_wins
from ..session import shared_path
from ..sources.csv import scan_csv
from ..sources.sinks import BUCKET_COL, key_bucket, read_current, upsert_buckets
from ..streaming.ingest import ingest_stream
from . import fixtures as fx
from . import sql_fixtures as sq
from .catalog import query
from .q_ingest import DEPARTMENTS_UPSERTED as _UPSERTED


def stage_departments_csv(spark, t) -> str:
    """Write the derived departments upload as header CSV files; returns the folder."""
    path = shared_path(spark, "staged-csv")
    raw = fx.raw_departments(t).drop("row_no")
    prev = spark.conf.get("spark.sql.caseSensitive", "false")
    spark.conf.set("spark.sql.caseSensitive", "true")   # 'Code' and 'code' are different headers
    try:
        (raw.write.option("header", True).option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).mode("overwrite").csv(path))
    finally:
        spark.conf.set("spark.sql.caseSensitive", prev)
    return path


@query("csv_roundtrip", sq.with_(sq.RAW_DEPARTMENTS, sq.DEPARTMENT_ROWS) + """
SELECT code, name, description, hod_email, reason FROM dep_rows""")
def csv_roundtrip(spark, t):
    """A1-A3 + A7: the upload as CSV files -> per-file headers -> contract, same rows as in memory."""
    rows = apply_contract(scan_csv(spark, stage_departments_csv(spark, t)), "departments")
    return rows.select("code", "name", "description", "hod_email",
                       F.try_element_at("reasons", F.lit(1)).alias("reason"))


WIDE = 70


@query("csv_quoted", f"""
SELECT 'C' || CAST(c_custkey AS VARCHAR) AS code, 'He said "' || c_name || '", then left' AS name,
  c_mktsegment || chr(10) || '"' || CAST(c_acctbal AS VARCHAR) || '", ,"' AS description, c_custkey % 2 AS file
FROM customer""")
def csv_quoted(spark, t):
    """A1 beyond plain fields: doubled quotes, commas and line breaks, over 64 columns, column orders by file."""
    k = F.col("c_custkey").cast("string")
    c = t.customer.select(
        (F.col("c_custkey") % 2).alias("file"), F.concat(F.lit("C"), k).alias("Code"),
        F.concat(F.lit('He said "'), "c_name", F.lit('", then left')).alias("Name"),
        F.concat("c_mktsegment", F.lit('\n"'), F.col("c_acctbal").cast("string"), F.lit('", ,"')).alias("Description"),
        *(k.alias(f"X{i}") for i in range(WIDE)))
    path = shared_path(spark, "staged-quoted")
    fill = [f"X{i}" for i in range(WIDE)]
    for file, cols in ((0, [*fill, "Code", "Name", "Description"]), (1, ["Description", *fill[:9], "Name", "Code"])):
        (c.where(F.col("file") == file).select(*cols).write.option("header", True).option("escape", '"')
         .csv(f"{path}/file={file}"))
    rows = apply_contract(scan_csv(spark, path), "departments").where(F.size("reasons") == 0)
    return rows.select("code", "name", "description",
                       F.regexp_extract("source_file", r"file=(\d)", 1).cast("long").alias("file"))


@query("ingest_stream", sq.with_(sq.RAW_DEPARTMENTS, sq.DEPARTMENT_ROWS) + """
SELECT CAST(row_number() OVER (ORDER BY code) AS BIGINT) AS id, code, name, description
FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY row_no DESC) AS rn FROM dep_rows WHERE reason IS NULL)
WHERE rn = 1""")
def ingest_stream_q(spark, t):
    """A10: stream the staged files into an empty departments table (availableNow trigger);
    returns the new table (dense ids in code order)."""
    src = stage_departments_csv(spark, t)
    out = shared_path(spark, "stream-out")
    q = ingest_stream(spark, src, "departments", out, shared_path(spark, "stream-ckpt"), available_now=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return read_current(spark, f"{out}/table").select("id", "code", "name", "description")


@query("ingest_rejects", sq.with_(sq.RAW_DEPARTMENTS, sq.DEPARTMENT_ROWS) + """
SELECT hod_email, reason AS reasons FROM dep_rows WHERE reason IS NOT NULL""")
def ingest_rejects(spark, t):
    """A9 through the CSV source: every rejected record with its reason."""
    rows = apply_contract(scan_csv(spark, stage_departments_csv(spark, t)), "departments")
    return split_valid(rows)[1].select("hod_email", F.array_join("reasons", ",").alias("reasons"))


@query("upsert_bucketed", _UPSERTED)
def upsert_bucketed(spark, t):
    """A4 by key buckets: seeds stored in buckets, the upload merged into the buckets it touches."""
    path, n = shared_path(spark, "bucketed"), 16
    seeds = fx.seed_departments(t)
    seeds.withColumn(BUCKET_COL, key_bucket(["code"], n)).write.partitionBy(BUCKET_COL).parquet(path)
    good, _ = split_valid(apply_contract(fx.raw_departments(t), "departments"))
    src = last_wins(good.select("row_no", "code", "name", "description"), ["code"], ["row_no"]).drop("row_no")
    upsert_buckets(spark, path, src, ["code"], ["name", "description"], fx.RUN_TS, n_buckets=n)
    return spark.read.parquet(path).select(*seeds.columns)


ROWS_PER_FILE_KEY = 500


@query("row_numbers", f"""
SELECT CAST(c_custkey // {ROWS_PER_FILE_KEY} AS INTEGER) AS file_id, c_custkey AS key,
  row_number() OVER (PARTITION BY c_custkey // {ROWS_PER_FILE_KEY} ORDER BY c_custkey) + 1 AS row_no
FROM customer""")
def row_numbers(spark, t):
    """A3: customers written as CSV files (one folder per key range, each file sorted by key),
    read back: the source row number of every record must be its position + 1."""
    path = shared_path(spark, "staged-rows")
    c = t.customer.select(F.col("c_custkey").alias("Key"), F.col("c_name").alias("Name"),
                          F.floor(F.col("c_custkey") / ROWS_PER_FILE_KEY).cast("int").alias("file_id"))
    (c.repartition("file_id").sortWithinPartitions("file_id", "Key")
     .write.partitionBy("file_id").option("header", True).mode("overwrite").csv(path))
    rows = scan_csv(spark, path)
    return rows.select(F.regexp_extract("source_file", r"file_id=(\d+)", 1).cast("int").alias("file_id"),
                       F.element_at("_vals", 1).cast("long").alias("key"), "row_no")


@query("upsert_committed", sq.with_(sq.RAW_DEPARTMENTS, sq.DEPARTMENT_ROWS, sq.SEED_DEPARTMENTS) + """,
won AS (SELECT code, name, description, row_no FROM (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY row_no DESC) AS rn FROM dep_rows WHERE reason IS NULL) WHERE rn = 1)
SELECT coalesce(w.code, s.code) AS code, CASE WHEN w.code IS NULL THEN s.name ELSE w.name END AS name,
  CASE WHEN w.code IS NULL THEN s.description ELSE w.description END AS description, s.code IS NOT NULL AS seeded, w.row_no
FROM seed_departments s FULL OUTER JOIN won w ON s.code = w.code""")
def upsert_committed(spark, t):
    """A4 + A10 by commits: the upload's later rows arrive in the first batch, its earlier ones in the second, which is
    replayed; the result is that of the upload in order."""
    from ..sources import commits as cm
    path, n = shared_path(spark, "committed"), 16
    seeds = fx.seed_departments(t).withColumn("row_no", F.lit(None).cast("long"))
    cm.commit(spark, path, seeds, ["code"], n, facts={"top_id": t.nation.count()})
    good, _ = split_valid(apply_contract(fx.raw_departments(t), "departments"))
    good = good.select("row_no", "code", "name", "description")
    later = F.col("row_no") % 3 == 0
    for batch, some in ((1, good.where(later)), (2, good.where(~later)), (2, good.where(~later))):
        cm.upsert_commit(spark, path, last_wins(some, ["code"], ["row_no"]), ["code"], ["name", "description"], fx.RUN_TS, n,
                         batch, ["row_no"])
    return cm.read_commit(spark, path).select("code", "name", "description",
                                              (F.col("id") <= t.nation.agg(F.count("*")).scalar()).alias("seeded"), "row_no")


def _customer_states(t):
    """The customers and two later states: some renamed, some gone, some new."""
    k = F.col("c_custkey")
    base = t.customer.select(k.alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("nation"))
    k = F.col("id")
    one = base.where(k % 211 != 0).select("id", F.when(k % 197 == 0, F.concat("name", F.lit(" v1"))).otherwise(F.col("name")).alias("name"),
                                          "nation")
    one = one.unionByName(base.where(k % 223 == 0).select((k + 10000000).alias("id"), "name", "nation"))
    two = one.where(k % 197 != 1).select("id", "name", F.when(k % 199 == 0, k % 25).otherwise(F.col("nation")).alias("nation"))
    return base, one, two.unionByName(base.where(k % 211 == 0).select("id", F.lower("name").alias("name"), "nation"))


_STATES = """
WITH s0 AS (SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation FROM customer),
s1 AS (SELECT id, CASE WHEN id % 197 = 0 THEN name || ' v1' ELSE name END AS name, nation FROM s0 WHERE id % 211 <> 0
       UNION ALL SELECT id + 10000000, name, nation FROM s0 WHERE id % 223 = 0),
s2 AS (SELECT id, name, CASE WHEN id % 199 = 0 THEN id % 25 ELSE nation END AS nation FROM s1 WHERE id % 197 <> 1
       UNION ALL SELECT id, lower(name), nation FROM s0 WHERE id % 211 = 0)"""


@query("log_rewind", _STATES + " SELECT 0 AS batch, * FROM s0 UNION ALL SELECT 1, * FROM s1")
def log_rewind(spark, t):
    """Two batches of changes logged (the second written twice), and both earlier tables rebuilt from the last one."""
    from ..operators.quality import audit, diff
    from ..sources import commits as cm
    states, log = _customer_states(t), shared_path(spark, "change-log")
    for batch in (1, 2, 2):
        changes = diff(states[batch - 1], states[batch], ["id"])
        cm.write_log(audit(changes, "customers", "id", fx.RUN_TS), log, batch)
    back = [cm.rewind(states[2], cm.read_log(spark, log), ["id"], n).select(F.lit(n).alias("batch"), "id", "name", "nation")
            for n in (0, 1)]
    return back[0].unionByName(back[1])


@query("snapshot_diff_buckets", _STATES + """
SELECT coalesce(a.id, b.id) AS id,
  CASE WHEN b.id IS NULL THEN 'DELETE' WHEN a.id IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS action,
  CASE WHEN a.id IS NOT NULL THEN to_json(struct_pack(id := a.id, name := a.name, nation := a.nation)) END AS old_values,
  CASE WHEN b.id IS NOT NULL THEN to_json(struct_pack(id := b.id, name := b.name, nation := b.nation)) END AS new_values
FROM s0 a FULL OUTER JOIN s1 b ON a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR a.name IS DISTINCT FROM b.name OR a.nation IS DISTINCT FROM b.nation""")
def snapshot_diff_buckets(spark, t):
    """C6 by digests: two snapshots stored in key buckets; only the buckets whose digests differ are read and joined."""
    from ..sources import commits as cm
    old, new, _ = _customer_states(t)
    paths = shared_path(spark, "old"), shared_path(spark, "new")
    for path, df in zip(paths, (old, new)):
        cm.commit(spark, path, df, ["id"], 64)
    return cm.diff_commits(spark, paths[0], 1, 1, paths[1])


@query("ingest_history", sq.with_(sq.RAW_DEPARTMENTS, sq.DEPARTMENT_ROWS) + """
SELECT CAST((row_no - 2) % 4 AS BIGINT) AS batch_id, count(*) AS total_rows, count(*) FILTER (WHERE reason IS NULL) AS success_count,
  count(*) FILTER (WHERE reason IS NOT NULL) AS error_count FROM dep_rows GROUP BY 1 ORDER BY 1 DESC LIMIT 3""")
def ingest_history_q(spark, t):
    """The newest three of four loads, by the reports that they wrote (one load replayed)."""
    from ..operators.report import ingest_history
    from ..streaming.ingest import ingest_batch
    base, raw = shared_path(spark, "history"), fx.raw_departments(t)
    prev = spark.conf.get("spark.sql.caseSensitive", "false")
    for batch in (0, 1, 2, 1, 3):
        staged = f"{base}/in-{batch}"
        spark.conf.set("spark.sql.caseSensitive", "true")  # 'Code' and 'code' are different headers
        try:
            (raw.where((F.col("row_no") - 2) % 4 == batch).drop("row_no").write.mode("overwrite").option("header", True)
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(staged))
        finally:
            spark.conf.set("spark.sql.caseSensitive", prev)
        ingest_batch(spark, [staged], batch, "departments", f"{base}/table", f"{base}/rejects", f"{base}/reports", n_buckets=8,
                     committed=True)
    return ingest_history(spark, f"{base}/reports", 3).select("batch_id", "total_rows", "success_count", "error_count")


@query("upsert_storage_partitioned", """
WITH s AS (SELECT o_custkey AS id, count(*) AS orders, max(o_orderdate) AS last FROM orders GROUP BY 1
           UNION ALL SELECT o_custkey + 10000000, count(*), max(o_orderdate) FROM orders WHERE o_custkey % 50 = 0 GROUP BY 1)
SELECT coalesce(c.c_custkey, s.id) AS id, c.c_name AS name, s.orders, CAST(s.last AS DATE) AS last
FROM customer c FULL OUTER JOIN s ON c.c_custkey = s.id""")
def upsert_storage_partitioned(spark, t):
    """C4: the customers' order counts merged into a table that is stored by key, which is not shuffled."""
    import uuid

    from ..sources.bucketed import upsert_table, write_bucketed
    base = f"customers_{uuid.uuid4().hex}"
    none = F.lit(None)
    write_bucketed(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), none.cast("long").alias("orders"),
                                     none.cast("date").alias("last")), f"{base}_1", ["id"], 8)
    found = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_orderdate").cast("date").alias("last"))
    src = found.select(F.col("o_custkey").alias("id"), "orders", "last").unionByName(
        found.where("o_custkey % 50 = 0").select((F.col("o_custkey") + 10000000).alias("id"), "orders", "last"))
    return upsert_table(spark, f"{base}_1", src, ["id"], ["orders", "last"], fx.RUN_TS, 8, f"{base}_2",
                        created_col=None, updated_col=None)

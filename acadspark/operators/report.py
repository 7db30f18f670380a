"""D5 import report, F1 first errors, A12/F2 recent ingests, D1/D2 counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import SETUP_CHECK_TABLES, SOFT_DELETE_TABLES


def _order_cols(df: DataFrame) -> list[str]:
    return [c for c in ("source_file", "row_no") if c in df.columns]


def error_messages(rows: DataFrame) -> DataFrame:
    """One message per rejected row: ``Row <n>: <reasons>``."""
    from .contract import with_valid_flag
    return with_valid_flag(rows).where(~F.col("_valid")).select(
        *_order_cols(rows),
        F.concat(F.lit("Row "), F.col("row_no").cast("string"), F.lit(": "),
                 F.array_join("reasons", ", ")).alias("msg"))


def first_errors(rows: DataFrame, n: int = 10) -> DataFrame:
    """the first ``n`` error messages in row order (a top-k, not a sort of all rejects)."""
    order = _order_cols(rows)
    return error_messages(rows).orderBy(*order).limit(n)


def import_report(rows: DataFrame, n: int = 10, extra: Mapping[str, object] | None = None) -> DataFrame:
    """One row with total_rows, success_count, error_count, errors, has_more_errors.

    ``rows`` is the contract output (``reasons`` array, ``row_no``). The counts
    are one aggregate pass; the error text is a scalar subquery over the top-n
    rejects, so no unbounded list is ever collected.
    """
    order = _order_cols(rows)
    top = first_errors(rows, n)
    text = top.agg(F.coalesce(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(*order, "msg"))), lambda x: x["msg"]), "\n"),
        F.lit("")).alias("errors"))
    stats = rows.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.size("reasons") == 0).alias("success_count"),
        F.count_if(F.size("reasons") > 0).alias("error_count"))
    out = stats.select(
        "total_rows", "success_count", "error_count",
        text.scalar().alias("errors"),
        (F.col("error_count") > n).alias("has_more_errors"))
    for k, v in (extra or {}).items():
        out = out.withColumn(k, v)
    return out


def recent(log: DataFrame, ts_col: str, tie_col: str, n: int = 5) -> DataFrame:
    """Newest ``n`` log rows; plans as TakeOrderedAndProject (per-task top-n, then merge)."""
    return log.orderBy(F.col(ts_col).desc(), F.col(tie_col).asc()).limit(n)


def ingest_history(spark: SparkSession, reports_path: str, n: int = 5) -> DataFrame:
    """The newest ``n`` loads of a stream, newest first, from the reports that its batches wrote: batch_id, total_rows,
    success_count, error_count, errors, has_more_errors. A replayed batch replaced its report, so a load counts once."""
    folder = reports_path.rstrip("/")
    log = spark.read.option("basePath", folder).parquet(f"{folder}/batch_id=*")
    return recent(log.withColumn("batch_id", F.col("batch_id").cast("long")), "batch_id", "batch_id", n)


def entity_stats(departments: DataFrame, courses: DataFrame, students: DataFrame,
                 faculty: DataFrame, classrooms: DataFrame) -> DataFrame:
    """One row of counts; students and faculty count live rows only.

    Each count is a scalar subquery: five independent scans that prune to at
    most one column, no join between them.
    """
    def n(table: str, df: DataFrame):
        src = df.where(F.col("deleted_at").isNull()) if table in SOFT_DELETE_TABLES else df
        return src.agg(F.count(F.lit(1))).scalar()

    return departments.sparkSession.range(1).select(
        n("departments", departments).alias("departments"), n("courses", courses).alias("subjects"),
        n("students", students).alias("students"), n("faculty", faculty).alias("faculty"),
        n("classrooms", classrooms).alias("classrooms"))


def setup_check(tables: Mapping[str, DataFrame], names: Sequence[str] = SETUP_CHECK_TABLES) -> DataFrame:
    """``(table_name, record_count)`` as a UNION ALL of counts; soft-deleted rows included."""
    parts = [tables[t].agg(F.count(F.lit(1)).alias("record_count"))
             .select(F.lit(t).alias("table_name"), "record_count") for t in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

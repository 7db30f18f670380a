"""The ingest pipeline: contract -> rejects -> last row wins -> upsert -> report.

``load`` is the set-based form of the upload routes: one contract
projection, one shuffle on the key for last-row-wins + upsert, a top-10 for
the report. In ``quarantine`` mode (default) a bad row is rejected alone; in
``atomic`` mode any row the database itself would refuse (length, domain,
impossible date) aborts the whole load, as one transaction would.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import CONTRACTS, TOUCHED_TABLES, Contract
from .contract import apply_contract, split_valid, with_flag
from .report import import_report
from .upsert import last_wins, upsert

# Which stored columns an upload overwrites on a key conflict.
SET_COLUMNS = {
    "departments": ("name", "description"),
    "academic_terms": ("start_date", "end_date", "academic_year", "status"),
}
NOT_STORED = {"departments": ("hod_email", "code_derived")}


@dataclass
class LoadResult:
    table: DataFrame        # next version of the target table
    rejects: DataFrame      # rejected rows with reasons
    report: DataFrame       # one-row import report
    poisoned: bool = False  # atomic mode: the load was refused
    rows: DataFrame | None = None  # contract output (persisted when asked)


def database_class(contract: Contract):
    """Predicate on a reason: would the database (not the route's own checks) refuse the row?"""
    domains = {f"bad_{f.name}" for f in contract.fields if f.domain is not None}

    def pred(r):
        return r.startswith("too_long_") | r.startswith("bad_date") | r.isin(*domains) if domains else \
            r.startswith("too_long_") | r.startswith("bad_date")
    return pred


def empty_target(src: DataFrame) -> DataFrame:
    return src.select(F.lit(None).cast("long").alias("id"), *src.columns,
                      F.lit(None).cast("timestamp_ntz").alias("created_at"),
                      F.lit(None).cast("timestamp_ntz").alias("updated_at")).where(F.lit(False))


def load(raw: DataFrame, contract: Contract | str, target: DataFrame | None, run_ts,
         mode: str = "quarantine", persist: bool = False, build_table: bool = True) -> LoadResult:
    """Load raw upload rows (``scan_csv`` output or header-named columns) into ``target``.

    With ``persist`` the contract output is kept (memory, spilling to disk)
    while the table, rejects and report are written from it; the caller
    unpersists ``result.rows``. Lost blocks are recomputed from the files.
    """
    contract = CONTRACTS[contract] if isinstance(contract, str) else contract
    rows = apply_contract(raw, contract)
    if persist:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    good, rejects = split_valid(rows)
    order = [c for c in ("source_mtime", "source_file", "row_no") if c in good.columns]
    keep = [c for c in good.columns if c not in NOT_STORED.get(contract.name, ()) and c not in order]
    src = last_wins(good.select(*keep, *order), list(contract.keys), order).drop(*order)
    base = target if target is not None else empty_target(src)
    table = upsert(base, src, list(contract.keys), SET_COLUMNS.get(contract.name, [
        c for c in src.columns if c not in contract.keys]), run_ts,
        touch=contract.table in TOUCHED_TABLES) if build_table else None   # B15: trigger tables only
    # rows that passed but lost to a later row with the same key (e.g. two names
    # deriving the same code): they count as successes, as in the upload route
    keys = list(contract.keys)
    overwritten = good.agg((F.count(F.lit(1)) - F.count_distinct(*keys)).alias("n")).scalar()
    report = import_report(rows, extra={"overwritten_rows": overwritten})
    poisoned = False
    if mode == "atomic":
        bad = database_class(contract)
        poisoned = with_flag(rows, F.exists("reasons", bad), "_db").where("_db").limit(1).count() > 0
        if poisoned:
            table = base
            report = report.withColumn("success_count", F.lit(0).cast("long"))
    elif mode != "quarantine":
        raise ValueError(f"unknown mode {mode}")
    return LoadResult(table, rejects, report, poisoned, rows)

"""Catalogue: integrity and statistics operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..contracts import AUDIT_ACTIONS, TIMETABLE_STATUS, USER_ROLES
from ..functions import checks as C
from ..functions.text import weekday_name
from ..operators.joins import blockers, cascade, orphans
from ..operators.quality import audit, diff, duplicate_keys
from ..operators.report import entity_stats, setup_check
from ..session import shared_path
from ..sources.sinks import append_log
from . import fixtures as fx
from .catalog import query


def _damaged_lineitem(t):
    k = F.col("l_orderkey")
    return t.lineitem.withColumn(
        "l_orderkey", F.when(k % 97 == 0, k + F.lit(100_000_000_000)).when(k % 89 == 0, F.lit(None)).otherwise(k))


def _fk_edges(t):
    return [
        ("lineitem.l_orderkey->orders", _damaged_lineitem(t), "l_orderkey", t.orders, "o_orderkey"),
        ("lineitem.l_partkey->part", t.lineitem, "l_partkey", t.part, "p_partkey"),
        ("lineitem.l_suppkey->supplier", t.lineitem, "l_suppkey", t.supplier, "s_suppkey"),
        ("orders.o_custkey->customer", t.orders, "o_custkey", t.customer, "c_custkey"),
        ("customer.c_nationkey->nation", t.customer, "c_nationkey", t.nation, "n_nationkey"),
        ("supplier.s_nationkey->nation", t.supplier, "s_nationkey", t.nation, "n_nationkey"),
        ("nation.n_regionkey->region", t.nation, "n_regionkey", t.region, "r_regionkey"),
    ]


_DAMAGED = """CASE WHEN l_orderkey % 97 = 0 THEN l_orderkey + 100000000000 WHEN l_orderkey % 89 = 0 THEN NULL
  ELSE l_orderkey END"""


@query("fk_orphans", f"""
WITH li AS (SELECT {_DAMAGED} AS l_orderkey FROM lineitem),
o AS (
  SELECT 'lineitem.l_orderkey->orders' AS edge, CAST(l_orderkey AS BIGINT) AS fk_value FROM li
    WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'lineitem.l_partkey->part', l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
  UNION ALL SELECT 'lineitem.l_suppkey->supplier', l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
  UNION ALL SELECT 'orders.o_custkey->customer', o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'customer.c_nationkey->nation', c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
  UNION ALL SELECT 'supplier.s_nationkey->nation', s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)
  UNION ALL SELECT 'nation.n_regionkey->region', n_regionkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)
)
SELECT edge, fk_value, count(*) AS n_rows FROM o GROUP BY edge, fk_value""")
def fk_orphans(spark, t):
    """Orphans on seven foreign-key edges (one damaged on purpose), grouped by missing key."""
    parts = []
    for name, child, fk, parent, pk in _fk_edges(t):
        parts.append(orphans(child.select(fk), fk, parent, pk)
                     .select(F.lit(name).alias("edge"), F.col(fk).cast("long").alias("fk_value")))
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("edge", "fk_value").agg(
        F.count(F.lit(1)).alias("n_rows"))


def _deleted_regions(t):
    return t.region.where(F.col("r_name").startswith("A")).select("r_regionkey")


@query("cascade_delete", """
WITH r AS (SELECT r_regionkey FROM region WHERE starts_with(r_name, 'A')),
n AS (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM r)),
c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)),
o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
l AS (SELECT l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
SELECT 'region' AS table_name, count(*) AS deleted_rows FROM r
UNION ALL SELECT 'nation', count(*) FROM n
UNION ALL SELECT 'customer', count(*) FROM c
UNION ALL SELECT 'orders', count(*) FROM o
UNION ALL SELECT 'lineitem', count(*) FROM l""")
def cascade_delete(spark, t):
    """C3 cascade: deleting the 'A*' regions removes their nations, customers, orders and lines."""
    regions = _deleted_regions(t)
    levels = cascade(regions, [(t.nation, "n_regionkey", "n_nationkey"),
                               (t.customer, "c_nationkey", "c_custkey"),
                               (t.orders, "o_custkey", "o_orderkey"),
                               (t.lineitem, "l_orderkey", "l_orderkey")], "r_regionkey")
    names = ["region", "nation", "customer", "orders", "lineitem"]
    counts = [df.agg(F.count(F.lit(1)).alias("deleted_rows")).select(F.lit(n).alias("table_name"), "deleted_rows")
              for n, df in zip(names, [regions, *levels])]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("restrict_report", """
SELECT s_suppkey, s_nationkey FROM supplier
WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN
                      (SELECT r_regionkey FROM region WHERE starts_with(r_name, 'A')))""")
def restrict_report(spark, t):
    """C3 restrict: suppliers that block deleting the 'A*' regions' nations."""
    nations = cascade(_deleted_regions(t), [(t.nation, "n_regionkey", "n_nationkey")], "r_regionkey")[0]
    return blockers(t.supplier.select("s_suppkey", "s_nationkey"), "s_nationkey", nations, "n_nationkey") \
        .select("s_suppkey", "s_nationkey")


@query("unique_violations", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def unique_violations(spark, t):
    """(l_orderkey, l_linenumber) pairs stored more than once."""
    return duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


def _soft_deleted(df, key):
    return df.withColumn("deleted_at", F.when(F.col(key) % 10 == 0, F.lit(fx.SEED_TS).cast("timestamp_ntz")))


@query("entity_stats", """
SELECT (SELECT count(*) FROM nation) AS departments, (SELECT count(*) FROM part) AS subjects,
  (SELECT count(*) FROM customer WHERE c_custkey % 10 <> 0) AS students,
  (SELECT count(*) FROM supplier WHERE s_suppkey % 10 <> 0) AS faculty,
  (SELECT count(*) FROM supplier) AS classrooms""")
def entity_stats_q(spark, t):
    """D1 + B11: live students / faculty exclude soft-deleted rows."""
    return entity_stats(t.nation, t.part, _soft_deleted(t.customer, "c_custkey"),
                        _soft_deleted(t.supplier, "s_suppkey"), t.supplier)


@query("setup_check", """
SELECT 'users' AS table_name, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS record_count
UNION ALL SELECT 'departments', count(*) FROM nation
UNION ALL SELECT 'programs', count(*) FROM region
UNION ALL SELECT 'academic_terms', count(DISTINCT year(o_orderdate)) FROM orders
UNION ALL SELECT 'time_slots', count(DISTINCT l_partkey % 24) FROM lineitem
UNION ALL SELECT 'students', count(*) FROM customer
UNION ALL SELECT 'faculty', count(*) FROM supplier
UNION ALL SELECT 'courses', count(*) FROM part
UNION ALL SELECT 'classrooms', count(*) FROM supplier""")
def setup_check_q(spark, t):
    """Per-table counts including soft-deleted rows."""
    people = t.customer.select(F.col("c_custkey").alias("k")).unionByName(t.supplier.select(F.col("s_suppkey").alias("k")))
    tables = {
        "users": people, "departments": t.nation, "programs": t.region,
        "academic_terms": t.orders.select(F.year("o_orderdate").alias("y")).distinct(),
        "time_slots": t.lineitem.select((F.col("l_partkey") % 24).alias("s")).distinct(),
        "students": _soft_deleted(t.customer, "c_custkey"), "faculty": _soft_deleted(t.supplier, "s_suppkey"),
        "courses": t.part, "classrooms": t.supplier,
    }
    return setup_check(tables)


def _supplier_snapshot(df):
    return df.select("s_suppkey", "s_name", "s_nationkey",
                     F.col("s_acctbal").cast("decimal(12,2)").cast("string").alias("s_acctbal"))


def _supplier_next(t):
    k = F.col("s_suppkey")
    s = t.supplier
    kept = s.where(k % 11 != 0).select(
        "s_suppkey",
        F.when(k % 7 == 0, F.concat("s_name", F.lit(" v2"))).otherwise(F.col("s_name")).alias("s_name"),
        "s_nationkey",
        F.when(k % 5 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")).alias("s_acctbal"))
    added = s.where(k % 13 == 0).select((k + 100000).alias("s_suppkey"), "s_name", "s_nationkey", "s_acctbal")
    return kept.unionByName(added)


@query("snapshot_diff", """
WITH o AS (SELECT s_suppkey, s_name, s_nationkey, CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS s_acctbal FROM supplier),
nw AS (
  SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN s_name || ' v2' ELSE s_name END AS s_name, s_nationkey,
    CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal
  FROM supplier WHERE s_suppkey % 11 <> 0
  UNION ALL SELECT s_suppkey + 100000, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 13 = 0
),
n AS (SELECT s_suppkey, s_name, s_nationkey, CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS s_acctbal FROM nw),
j AS (
  SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey,
    CASE WHEN n.s_suppkey IS NULL THEN 'DELETE' WHEN o.s_suppkey IS NULL THEN 'INSERT'
         WHEN o.s_name IS DISTINCT FROM n.s_name OR o.s_nationkey IS DISTINCT FROM n.s_nationkey
              OR o.s_acctbal IS DISTINCT FROM n.s_acctbal THEN 'UPDATE' END AS action,
    CASE WHEN o.s_suppkey IS NOT NULL THEN to_json(struct_pack(s_suppkey := o.s_suppkey, s_name := o.s_name,
         s_nationkey := o.s_nationkey, s_acctbal := o.s_acctbal)) END AS old_values,
    CASE WHEN n.s_suppkey IS NOT NULL THEN to_json(struct_pack(s_suppkey := n.s_suppkey, s_name := n.s_name,
         s_nationkey := n.s_nationkey, s_acctbal := n.s_acctbal)) END AS new_values
  FROM o FULL OUTER JOIN n ON o.s_suppkey = n.s_suppkey
)
SELECT 'suppliers' AS table_name, s_suppkey AS record_id, action, old_values, new_values,
  CAST(NULL AS BIGINT) AS changed_by, TIMESTAMP '2025-01-01 00:00:00' AS changed_at
FROM j WHERE action IS NOT NULL""")
def snapshot_diff(spark, t):
    """C6 + A11: supplier snapshot vs its next version -> change-log rows with JSON images."""
    changes = diff(_supplier_snapshot(t.supplier), _supplier_snapshot(_supplier_next(t)), ["s_suppkey"])
    log = shared_path(spark, "change-log")
    append_log(audit(changes, "suppliers", "s_suppkey", fx.RUN_TS), log)
    return spark.read.parquet(log)


@query("domain_checks", """
WITH raw AS (
  SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'archived' ELSE 'Draft' END AS status,
    CASE o_orderkey % 4 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'UPDATE' WHEN 2 THEN NULL ELSE 'MERGE' END AS action,
    CASE o_custkey % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'guest' ELSE 'student' END AS role,
    CAST(o_custkey % 9 AS INTEGER) AS dow FROM orders)
SELECT o_orderkey, CASE dow WHEN 1 THEN 'Monday' WHEN 2 THEN 'Tuesday' WHEN 3 THEN 'Wednesday' WHEN 4 THEN 'Thursday'
    WHEN 5 THEN 'Friday' WHEN 6 THEN 'Saturday' WHEN 7 THEN 'Sunday' END AS weekday,
  concat_ws(',', CASE WHEN status NOT IN ('draft', 'active', 'archived') THEN 'bad_status' END,
    CASE WHEN action IS NULL THEN 'missing_action' END,
    CASE WHEN action NOT IN ('INSERT', 'UPDATE', 'DELETE') THEN 'bad_action' END,
    CASE WHEN role NOT IN ('admin', 'faculty', 'student') THEN 'bad_role' END) AS reasons
FROM raw""")
def domain_checks(spark, t):
    """B7 domains of timetable status, audit action and user role, B9 not-null, B17 weekday names."""
    k = F.col("o_orderkey") % 4
    raw = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "archived")
        .otherwise("Draft").alias("status"),
        F.when(k == 0, "INSERT").when(k == 1, "UPDATE").when(k == 2, F.lit(None)).otherwise("MERGE").alias("action"),
        F.when(F.col("o_custkey") % 5 == 0, "admin").when(F.col("o_custkey") % 5 == 1, "guest").otherwise("student").alias("role"),
        (F.col("o_custkey") % 9).cast("int").alias("dow"))
    rules = C.reasons(C.in_domain("status", TIMETABLE_STATUS, "bad_status"), C.not_null("action", "missing_action"),
                      C.in_domain("action", AUDIT_ACTIONS, "bad_action"), C.in_domain("role", USER_ROLES, "bad_role"))
    return raw.select("o_orderkey", weekday_name("dow").alias("weekday"), F.array_join(rules, ",").alias("reasons"))


# The record schema over the harness tables, with some broken and repeated keys: table -> (source, columns). The
# expressions mean the same in Spark SQL and in DuckDB.
RECORDS = {
    "users": ("customer", {"id": "c_custkey + 1", "email": "concat('u', cast(c_custkey % 1400 as varchar(20)))"}),
    "departments": ("nation", {"id": "n_nationkey + 1", "code": "concat('D', cast(n_nationkey % 24 as varchar(20)))",
                               "head_of_department": "case when n_nationkey % 5 = 0 then null when n_nationkey % 7 = 0 "
                                                     "then -1 else n_nationkey + 1 end"}),
    "academic_terms": ("nation", {"id": "n_nationkey + 1", "name": "concat('T', cast(n_nationkey % 20 as varchar(20)))"}),
    "programs": ("region", {"id": "r_regionkey + 1", "code": "concat('P', cast(r_regionkey % 4 as varchar(20)))",
                            "department_id": "r_regionkey * 6 + 2"}),
    "faculty": ("supplier", {"id": "s_suppkey + 1", "employee_id": "concat('F', cast(s_suppkey % 90 as varchar(20)))",
                             "user_id": "s_suppkey * 20", "department_id": "s_nationkey + 2"}),
    "batches": ("nation", {"id": "n_nationkey + 1", "name": "concat('B', cast(n_nationkey % 23 as varchar(20)))",
                           "program_id": "n_regionkey + 2"}),
    "students": ("customer", {"id": "c_custkey + 1", "student_id": "concat('S', cast(c_custkey % 1450 as varchar(20)))",
                              "user_id": "case when c_custkey % 50 = 0 then c_custkey + 1000000 else c_custkey + 1 end",
                              "program_id": "c_nationkey % 6 + 1", "batch_id": "case when c_custkey % 3 = 0 then null "
                                                                               "else c_nationkey + 3 end"}),
    "courses": ("part", {"id": "p_partkey + 1", "course_code": "concat('C', cast(p_partkey % 1900 as varchar(20)))",
                         "department_id": "p_partkey % 27 + 1"}),
    "classrooms": ("supplier", {"id": "s_suppkey + 1", "room_code": "concat('R', cast(s_suppkey % 95 as varchar(20)))"}),
    "course_prerequisites": ("part", {"course_id": "p_partkey % 700 + 1", "prerequisite_id": "p_partkey % 300 * 9 + 1"}),
    "course_assignments": ("lineitem", {
        "course_id": "l_partkey + 1", "faculty_id": "l_suppkey + 4", "semester": "l_linenumber % 2 + 1",
        "academic_year": "concat('Y', cast(l_orderkey % 4 as varchar(20)))",
        "section": "case when l_linenumber % 3 = 0 then 'A' else 'B' end"}),
    "enrollments": ("lineitem", {"student_id": "l_orderkey % 1600 + 1", "course_id": "l_partkey + 2",
                                 "academic_year": "concat('Y', cast(l_linenumber % 3 as varchar(20)))"}),
    "timetables": ("orders", {"id": "o_orderkey", "program_id": "o_custkey % 7 + 1", "batch_id": "o_custkey % 27 + 1",
                              "created_by": "o_custkey + 2"}),
    "timetable_entries": ("lineitem", {"timetable_id": "case when l_orderkey % 97 = 0 then -l_orderkey else l_orderkey end",
                                       "course_id": "l_partkey + 1", "faculty_id": "case when l_linenumber = 7 then null "
                                                                                   "else l_suppkey + 3 end",
                                       "classroom_id": "l_suppkey + 2"}),
    "audit_logs": ("orders", {"changed_by": "case when o_orderkey % 2 = 0 then null else o_custkey * 2 end"}),
}


def record_tables(t):
    """The record tables that declared keys and references are about."""
    return {name: getattr(t, source).selectExpr(*(f"{e} as {c}" for c, e in cols.items()))
            for name, (source, cols) in RECORDS.items()}


def _integrity_sql() -> str:
    from ..contracts import FOREIGN_KEYS, UNIQUE_KEYS
    ctes = ",\n".join(f"{name} as (select {', '.join(f'{e} as {c}' for c, e in cols.items())} from {source})"
                      for name, (source, cols) in RECORDS.items())
    checks = [f"""select 'foreign_key' as "check", '{child}' as table_name, '{col}' as columns, cast({col} as varchar) as value,
  count(*) as n_rows from {child} where {col} is not null and {col} not in (select id from {parent}) group by {col}"""
              for child, col, parent, _ in FOREIGN_KEYS]
    checks += [f"""select 'unique', '{name}', '{",".join(keys)}', concat_ws(',', {", ".join(f"cast({k} as varchar)" for k in keys)}),
  count(*) from {name} group by {", ".join(keys)} having count(*) > 1""" for name, keys in UNIQUE_KEYS.items()]
    return f"with {ctes}\n" + "\nunion all ".join(checks)


@query("integrity_report", _integrity_sql())
def integrity_report_q(spark, t):
    """C1 + D4: all declared foreign keys (23) and unique keys (12) of the record schema."""
    from ..operators.quality import integrity_report
    return integrity_report(record_tables(t))


# Rows whose delete is asked for: a few users (their accounts go with them) and timetables (with their entries).
DELETED = {"users": "id % 37 = 0", "timetables": "id % 101 = 0"}


def _delete_sql() -> str:
    from ..contracts import FOREIGN_KEYS
    from ..operators.joins import delete_order
    ctes = [f"{name} as (select {', '.join(f'{e} as {c}' for c, e in cols.items())} from {source})"
            for name, (source, cols) in RECORDS.items()]
    known = {name for group in delete_order(FOREIGN_KEYS) for name in group} | set(DELETED)
    gone = {}
    for name in [n for g in delete_order(FOREIGN_KEYS) for n in g]:
        tests = [f"({DELETED[name]})"] if name in DELETED else []
        tests += [f"coalesce({col} in (select id from gone_{p}), false)" for c, col, p, action in FOREIGN_KEYS
                  if c == name and action == "cascade"]
        gone[name] = " or ".join(tests) or "false"
        if "id" in RECORDS[name][1]:
            ctes.append(f"gone_{name} as (select id from {name} where {gone[name]})")
    parts = [f"select 'deleted' as outcome, '{n}' as table_name, cast(null as varchar) as columns, cast(null as varchar) as value, "
             f"count(*) as n_rows from {n} where {g} having count(*) > 0" for n, g in gone.items() if g != "false"]
    parts += [f"select 'blocked', '{c}', '{col}', cast({col} as varchar), count(*) from {c} "
              f"where {col} in (select id from gone_{p}) and not ({gone.get(c, 'false')}) group by {col}"
              for c, col, p, action in FOREIGN_KEYS if action != "cascade" and p in known and "id" in RECORDS[p][1]]
    return f"with {', '.join(ctes)}\n" + "\nunion all ".join(parts)


@query("delete_consequences", _delete_sql())
def delete_consequences(spark, t):
    """C3 over all 23 foreign keys: what a delete of users and timetables takes along, and the rows that forbid it."""
    from ..operators.joins import delete_report
    tables = record_tables(t)
    return delete_report(tables, {name: tables[name].where(cond).select("id") for name, cond in DELETED.items()})

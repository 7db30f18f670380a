"""Catalogue: ingestion operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.contract import apply_contract, split_valid
from ..operators.report import import_report
from ..operators.upsert import last_wins, upsert
from . import fixtures as fx
from . import sql_fixtures as sq
from .catalog import query


def departments_load(t):
    """B1 B2 B4 B6 B9 over the derived departments upload."""
    return apply_contract(fx.raw_departments(t), "departments")


@query("alias_trim_required", sq.with_(sq.RAW_DEPARTMENTS, sq.DEPARTMENT_ROWS) + """
SELECT row_no, code, name, description, hod_email, coalesce(reason = 'missing_name', false) AS missing_name
FROM dep_rows""")
def alias_trim_required(spark, t):
    """B1 alias pick, B2 Unicode trim, B6 required name."""
    rows = departments_load(t)
    return rows.select("row_no", "code", "name", "description", "hod_email",
                       F.coalesce(F.array_contains("reasons", "missing_name"), F.lit(False)).alias("missing_name"))


@query("derive_code", sq.with_(sq.RAW_DEPARTMENTS, sq.DEPARTMENT_ROWS) + """
SELECT row_no, code, code_derived, reason FROM dep_rows""")
def derive_code(spark, t):
    """B4 code derivation with the first failing rule as reason."""
    rows = departments_load(t)
    return rows.select("row_no", "code", "code_derived", F.try_element_at("reasons", F.lit(1)).alias("reason"))


DEPARTMENTS_UPSERTED = (sq.with_(sq.RAW_DEPARTMENTS, sq.DEPARTMENT_ROWS, sq.SEED_DEPARTMENTS) + """,
good AS (SELECT * FROM dep_rows WHERE reason IS NULL),
src AS (
  SELECT code, name, description FROM (
    SELECT *, row_number() OVER (PARTITION BY code ORDER BY row_no DESC) AS rn FROM good) WHERE rn = 1
),
new_keys AS (
  SELECT s.code, (SELECT max(id) FROM seed_departments)
         + CAST(row_number() OVER (ORDER BY s.code) AS BIGINT) AS new_id
  FROM src s ANTI JOIN seed_departments t ON s.code = t.code
)
SELECT coalesce(t.id, n.new_id) AS id, coalesce(t.code, s.code) AS code,
  CASE WHEN s.code IS NOT NULL THEN s.name ELSE t.name END AS name,
  CASE WHEN s.code IS NOT NULL THEN s.description ELSE t.description END AS description,
  t.head_of_department,
  coalesce(t.created_at, TIMESTAMP '2025-01-01 00:00:00') AS created_at,
  CASE WHEN s.code IS NOT NULL THEN TIMESTAMP '2025-01-01 00:00:00' ELSE t.updated_at END AS updated_at
FROM seed_departments t
FULL OUTER JOIN src s ON t.code = s.code
LEFT JOIN new_keys n ON n.code = s.code""")


@query("departments_upsert", DEPARTMENTS_UPSERTED)
def departments_upsert(spark, t):
    """A9 split, D3 last row wins per code, A8 ids for new codes, A4 upsert with B15 touch."""
    good, _ = split_valid(departments_load(t))
    src = last_wins(good.select("row_no", "code", "name", "description"), ["code"], ["row_no"]).drop("row_no")
    return upsert(fx.seed_departments(t), src, ["code"], ["name", "description"], fx.RUN_TS)


@query("import_report", sq.with_(sq.RAW_DEPARTMENTS, sq.DEPARTMENT_ROWS) + """,
errs AS (SELECT row_no, 'Row ' || CAST(row_no AS VARCHAR) || ': ' || reason AS msg
         FROM dep_rows WHERE reason IS NOT NULL ORDER BY row_no LIMIT 10),
good AS (SELECT code FROM dep_rows WHERE reason IS NULL)
SELECT count(*) AS total_rows,
  count(*) FILTER (WHERE reason IS NULL) AS success_count,
  count(*) FILTER (WHERE reason IS NOT NULL) AS error_count,
  (SELECT coalesce(string_agg(msg, chr(10) ORDER BY row_no), '') FROM errs) AS errors,
  count(*) FILTER (WHERE reason IS NOT NULL) > 10 AS has_more_errors,
  (SELECT count(*) - count(DISTINCT code) FROM good) AS overwritten_rows
FROM dep_rows""")
def import_report_q(spark, t):
    """D5 import report with F1 first-10 errors; overwritten_rows counts D3 losers (code collisions)."""
    rows = departments_load(t)
    good, _ = split_valid(rows)
    overwritten = good.agg((F.count(F.lit(1)) - F.count_distinct("code")).alias("n")).scalar()
    return import_report(rows, 10, extra={"overwritten_rows": overwritten})


_D, _DR = sq.norm_date("raw")


@query("normalize_dates", sq.with_(sq.RAW_DATES) + f"""
SELECT o_orderkey, raw, {_D} AS norm_date, {_DR} AS reason FROM raw_dates""")
def normalize_dates(spark, t):
    """Shapes tried in order, shape before value, two reject reasons."""
    from ..functions.dates import with_date
    return with_date(fx.raw_dates(t), "raw", "norm_date", "reason").select("o_orderkey", "raw", "norm_date", "reason")


def _t(x):
    return sq.utrim(f"coalesce({x}, '')")


@query("typed_rejects", sq.with_(sq.RAW_COURSES) + f""",
c AS (
  SELECT row_no, {_t('course_code_raw')} AS cc, {_t('title_raw')} AS ti, {_t('semester_raw')} AS se,
    {_t('credits_raw')} AS cr, {_t('hours_raw')} AS hw, {_t('type_raw')} AS ty,
    {_t('elective_raw')} AS el, {_t('desc_raw')} AS de
  FROM raw_courses
),
typed AS (
  SELECT row_no, cc, ti, se, cr, hw, ty, el,
    nullif(cc, '') AS course_code, nullif(ti, '') AS title,
    CASE WHEN se <> '' THEN try_cast(se AS INTEGER) END AS semester,
    CASE WHEN cr = '' THEN CAST('3.0' AS DECIMAL(3,1)) ELSE try_cast(cr AS DECIMAL(3,1)) END AS credits,
    CASE WHEN hw = '' THEN 3 ELSE try_cast(hw AS INTEGER) END AS hours_per_week,
    CASE WHEN ty = '' THEN 'theory' ELSE ty END AS course_type,
    CASE WHEN el = '' THEN false WHEN lower(el) = 'true' THEN true WHEN lower(el) = 'false' THEN false END AS is_elective,
    nullif(de, '') AS description
  FROM c
)
SELECT row_no, course_code, title, semester, credits, hours_per_week, course_type, is_elective, description,
  concat_ws(',',
    CASE WHEN cc = '' THEN 'missing_course_code' END,
    CASE WHEN length(course_code) > 20 THEN 'too_long_course_code' END,
    CASE WHEN ti = '' THEN 'missing_title' END,
    CASE WHEN length(title) > 255 THEN 'too_long_title' END,
    CASE WHEN se <> '' AND semester IS NULL THEN 'bad_semester' END,
    CASE WHEN cr <> '' AND credits IS NULL THEN 'bad_credits' END,
    CASE WHEN hw <> '' AND hours_per_week IS NULL THEN 'bad_hours_per_week' END,
    CASE WHEN length(course_type) > 20 THEN 'too_long_course_type' END,
    CASE WHEN course_type NOT IN ('theory', 'lab', 'project') THEN 'bad_course_type' END,
    CASE WHEN el <> '' AND is_elective IS NULL THEN 'bad_is_elective' END) AS reasons
FROM typed""")
def typed_rejects(spark, t):
    """A7 generic contract (courses): B3 defaults, B6 required, B7 domain, B9 length, B10 casts, A9 reasons."""
    rows = apply_contract(fx.raw_courses(t), "courses")
    return rows.select("row_no", "course_code", "title", "semester", "credits", "hours_per_week", "course_type",
                       "is_elective", "description", F.array_join("reasons", ",").alias("reasons"))


_TP = r"^(\d{1,2}):(\d{2})(:(\d{2}))?$"


def _sec(x):
    g = lambda i: f"try_cast(regexp_extract({x}, '{_TP}', {i}) AS INTEGER)"
    s = f"coalesce(try_cast(nullif(regexp_extract({x}, '{_TP}', 4), '') AS INTEGER), 0)"
    return (f"CASE WHEN {x} <> '' AND regexp_matches({x}, '{_TP}') AND {g(1)} <= 23 AND {g(2)} <= 59 AND {s} <= 59 "
            f"THEN {g(1)} * 3600 + {g(2)} * 60 + {s} END")


@query("time_slot_rejects", sq.with_(sq.RAW_SLOTS) + f""",
c AS (
  SELECT row_no, {_t('name_raw')} AS na, {_t('start_raw')} AS st, {_t('end_raw')} AS en,
    {_t('duration_raw')} AS du, {_t('type_raw')} AS ty, {_t('active_raw')} AS ac
  FROM raw_slots
),
typed AS (
  SELECT *, nullif(na, '') AS slot_name, {_sec('st')} AS start_sec, {_sec('en')} AS end_sec,
    CASE WHEN du <> '' THEN try_cast(du AS INTEGER) END AS duration_minutes,
    CASE WHEN ty = '' THEN 'lecture' ELSE ty END AS slot_type,
    CASE WHEN ac = '' THEN true WHEN lower(ac) = 'true' THEN true WHEN lower(ac) = 'false' THEN false END AS is_active
  FROM c
)
SELECT row_no, slot_name, start_sec, end_sec, duration_minutes, slot_type, is_active,
  concat_ws(',',
    CASE WHEN na = '' THEN 'missing_slot_name' END,
    CASE WHEN length(slot_name) > 50 THEN 'too_long_slot_name' END,
    CASE WHEN st = '' THEN 'missing_start_sec' END,
    CASE WHEN st <> '' AND start_sec IS NULL THEN 'bad_start_sec' END,
    CASE WHEN en = '' THEN 'missing_end_sec' END,
    CASE WHEN en <> '' AND end_sec IS NULL THEN 'bad_end_sec' END,
    CASE WHEN du = '' THEN 'missing_duration_minutes' END,
    CASE WHEN du <> '' AND duration_minutes IS NULL THEN 'bad_duration_minutes' END,
    CASE WHEN length(slot_type) > 20 THEN 'too_long_slot_type' END,
    CASE WHEN slot_type NOT IN ('lecture', 'lab', 'break', 'lunch') THEN 'bad_slot_type' END,
    CASE WHEN ac <> '' AND is_active IS NULL THEN 'bad_is_active' END,
    CASE WHEN NOT (start_sec < end_sec) THEN 'bad_time_range' END) AS reasons
FROM typed""")
def time_slot_rejects(spark, t):
    """B10 time-of-day and boolean casts, B7 slot-type domain, B8 start < end."""
    from ..functions.checks import check
    rows = apply_contract(fx.raw_slots(t), "time_slots")
    rows = rows.withColumn("reasons", F.filter(
        F.concat("reasons", F.array(check(F.col("start_sec") < F.col("end_sec"), "bad_time_range"))),
        lambda r: r.isNotNull()))
    return rows.select("row_no", "slot_name", "start_sec", "end_sec", "duration_minutes", "slot_type", "is_active",
                       F.array_join("reasons", ",").alias("reasons"))


@query("last_row_wins", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC,
    l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC, l_returnflag DESC,
    l_linestatus DESC) AS rn
  FROM lineitem) WHERE rn = 1""")
def last_row_wins(spark, t):
    """D3 over lineitem keyed by (l_orderkey, l_linenumber): 1 row per key, the latest ship date wins."""
    return last_wins(t.lineitem, ["l_orderkey", "l_linenumber"],
                     ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])


def _customer_target(t):
    return t.customer.select(
        (F.col("c_custkey") + 1).alias("id"), "c_custkey", F.col("c_name").alias("name"),
        F.col("c_acctbal").cast("decimal(12,2)").alias("balance"), F.col("c_mktsegment").alias("segment"),
        F.lit(fx.SEED_TS).cast("timestamp_ntz").alias("created_at"),
        F.lit(fx.SEED_TS).cast("timestamp_ntz").alias("updated_at"))


def _customer_source(t):
    k = F.col("o_custkey")
    rows = t.orders.select(
        F.when(k % 50 == 0, -k - 1).otherwise(k).alias("c_custkey"),
        F.concat(F.lit("Customer#new"), k.cast("string")).alias("name"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("balance"),
        F.col("o_orderpriority").alias("segment"), "o_orderdate", "o_orderkey")
    return last_wins(rows, ["c_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate", "o_orderkey")


@query("upsert", """
WITH tgt AS (
  SELECT c_custkey + 1 AS id, c_custkey, c_name AS name, CAST(c_acctbal AS DECIMAL(12,2)) AS balance,
    c_mktsegment AS segment, TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at
  FROM customer
),
src AS (
  SELECT c_custkey, name, balance, segment FROM (
    SELECT CASE WHEN o_custkey % 50 = 0 THEN -o_custkey - 1 ELSE o_custkey END AS c_custkey,
      'Customer#new' || CAST(o_custkey AS VARCHAR) AS name, CAST(o_totalprice AS DECIMAL(12,2)) AS balance,
      o_orderpriority AS segment,
      row_number() OVER (PARTITION BY CASE WHEN o_custkey % 50 = 0 THEN -o_custkey - 1 ELSE o_custkey END
                         ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders) WHERE rn = 1
),
new_keys AS (
  SELECT s.c_custkey, (SELECT max(id) FROM tgt) + row_number() OVER (ORDER BY s.c_custkey) AS new_id
  FROM src s ANTI JOIN tgt t ON s.c_custkey = t.c_custkey
)
SELECT CAST(coalesce(t.id, n.new_id) AS BIGINT) AS id, coalesce(t.c_custkey, s.c_custkey) AS c_custkey,
  coalesce(t.name, s.name) AS name,
  CASE WHEN s.c_custkey IS NOT NULL THEN s.balance ELSE t.balance END AS balance,
  CASE WHEN s.c_custkey IS NOT NULL THEN s.segment ELSE t.segment END AS segment,
  coalesce(t.created_at, TIMESTAMP '2025-01-01 00:00:00') AS created_at,
  CASE WHEN s.c_custkey IS NOT NULL THEN TIMESTAMP '2025-01-01 00:00:00' ELSE t.updated_at END AS updated_at
FROM tgt t FULL OUTER JOIN src s ON t.c_custkey = s.c_custkey
LEFT JOIN new_keys n ON n.c_custkey = s.c_custkey""")
def upsert_q(spark, t):
    """Customer balances updated from each customer's latest order; every
    50th customer arrives under a new key and is inserted with a dense new id."""
    return upsert(_customer_target(t), _customer_source(t), ["c_custkey"], ["balance", "segment"], fx.RUN_TS)


@query("code_lookup", """
WITH c AS (
  SELECT c_custkey,
    CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN 'nation_' || CAST(c_nationkey AS VARCHAR)
         ELSE 'NATION_' || CAST(c_nationkey AS VARCHAR) END AS nation_code
  FROM customer
)
SELECT c.c_custkey, c.nation_code, n.n_nationkey AS nation_id,
  CASE WHEN c.nation_code <> '' AND n.n_nationkey IS NULL THEN 'unknown_nation_id' ELSE '' END AS reasons
FROM c LEFT JOIN nation n ON c.nation_code = n.n_name""")
def code_lookup(spark, t):
    """Nation code text -> id, case-sensitive; a miss becomes a reject reason."""
    from ..operators.contract import resolve
    k = F.col("c_custkey")
    code = (F.when(k % 17 == 0, F.lit("")).when(k % 13 == 0, F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")))
            .otherwise(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))))
    c = t.customer.select("c_custkey", code.alias("nation_code"))
    out = resolve(c, "nation_code", t.nation, "n_name", "n_nationkey", "nation_id", "unknown_nation_id")
    return out.select("c_custkey", "nation_code", "nation_id", F.array_join("reasons", ",").alias("reasons"))


@query("code_lookup_ambiguous", """
WITH d AS (SELECT 'S' || CAST(s_suppkey % 90 AS VARCHAR) AS code, min(s_suppkey) AS id, count(DISTINCT s_suppkey) AS n FROM supplier GROUP BY 1),
c AS (SELECT c_custkey, 'S' || CAST(c_custkey % 95 AS VARCHAR) AS code FROM customer)
SELECT c_custkey, c.code, CASE WHEN n = 1 THEN id END AS supplier_id,
  CASE WHEN n IS NULL THEN 'unknown_supplier_id' WHEN n > 1 THEN 'ambiguous_supplier_id' ELSE '' END AS reasons
FROM c LEFT JOIN d ON c.code = d.code""")
def code_lookup_ambiguous(spark, t):
    """C2 against a dimension in which some codes stand for several ids: a reason, and no fan-out."""
    from ..operators.contract import resolve
    text = lambda k, n: F.concat(F.lit("S"), (F.col(k) % n).cast("string")).alias("code")
    out = resolve(t.customer.select("c_custkey", text("c_custkey", 95)), "code", t.supplier.select("s_suppkey", text("s_suppkey", 90)),
                  "code", "s_suppkey", "supplier_id", "unknown_supplier_id")
    return out.select("c_custkey", "code", "supplier_id", F.array_join("reasons", ",").alias("reasons"))


@query("list_explode", f"""
WITH l AS (
  SELECT p_partkey, list_filter(list_transform(string_split(
      concat_ws(';', ' ' || p_brand, '', p_type || ' ', replace(p_name, ' ', ';')), ';'),
      lambda x: {sq.utrim('x')}), lambda x: x <> '') AS items
  FROM part
)
SELECT p_partkey, CAST(generate_subscripts(items, 1) - 1 AS INTEGER) AS pos, unnest(items) AS item FROM l""")
def list_explode(spark, t):
    """B12: ';' list -> trimmed non-empty items, exploded with their position."""
    from ..functions.text import split_list
    raw = F.concat_ws(";", F.concat(F.lit(" "), F.col("p_brand")), F.lit(""), F.concat(F.col("p_type"), F.lit(" ")),
                      F.regexp_replace("p_name", " ", ";"))
    return t.part.select("p_partkey", F.posexplode(split_list(raw)).alias("pos", "item"))


@query("json_props", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  to_json(struct_pack(event_type := event_type, k := CAST(json_extract_string(props, '$.k') AS INTEGER),
                      user_id := user_id)) AS doc
FROM events""")
def json_props(spark, t):
    """Read a JSON field, build a JSON document."""
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select("event_id", k.alias("k"),
                           F.to_json(F.struct("event_type", k.alias("k"), "user_id")).alias("doc"))


@query("account_projection", r"""
WITH a AS (
  SELECT c_custkey, CASE WHEN c_custkey % 3 = 0
      THEN 'faculty.' || lower(c_mktsegment) || '.' || CAST(c_custkey AS VARCHAR) || '@univ.edu'
      ELSE lower(replace(c_name, '#', '.')) || '@univ.edu' END AS email
  FROM customer
)
SELECT c_custkey, email, CASE WHEN contains(email, 'faculty') THEN 'faculty' ELSE 'student' END AS role,
  regexp_replace(split_part(email, '@', 1), '^([^.]*)\.', '\1 ') AS display_name
FROM a""")
def account_projection(spark, t):
    """Role from the address, display name from its local part."""
    from ..functions.text import account_role, display_name
    k = F.col("c_custkey")
    email = F.when(k % 3 == 0, F.concat(F.lit("faculty."), F.lower("c_mktsegment"), F.lit("."), k.cast("string"),
                                         F.lit("@univ.edu"))) \
        .otherwise(F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@univ.edu")))
    a = t.customer.select("c_custkey", email.alias("email"))
    return a.select("c_custkey", "email", account_role("email").alias("role"), display_name("email").alias("display_name"))


@query("recent_ingests", """
SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 5""")
def recent_ingests(spark, t):
    """Newest five log entries (a top-k is the feature)."""
    from ..operators.report import recent
    return recent(t.events.select("event_id", "ts", "event_type"), "ts", "event_id", 5)


@query("classrooms_load", f"""
WITH r AS (
  SELECT s_suppkey + 2 AS row_no,
    CASE WHEN s_suppkey % 23 = 0 THEN '' ELSE 'R' || CAST(s_suppkey AS VARCHAR) END AS rc,
    'Block ' || CAST(s_nationkey % 5 AS VARCHAR) AS bu,
    CASE WHEN s_suppkey % 19 = 0 THEN 'G' ELSE CAST(s_suppkey % 6 AS VARCHAR) END AS fl,
    CAST(20 + s_suppkey % 60 AS VARCHAR) AS ca,
    CASE WHEN s_suppkey % 5 = 0 THEN 'Lab' ELSE 'Class' END AS ty,
    CASE s_suppkey % 4 WHEN 0 THEN 'Projector;Whiteboard;AC' WHEN 1 THEN ' Computers ; Projector;;AC'
      WHEN 2 THEN '' ELSE 'Audio System' END AS eq,
    CASE s_suppkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '' END AS av
  FROM supplier
),
typed AS (
  SELECT row_no, rc, fl, ca, ty, av, nullif(rc, '') AS room_code, nullif(bu, '') AS building,
    CASE WHEN fl <> '' THEN try_cast(fl AS INTEGER) END AS floor,
    CASE WHEN ca <> '' THEN try_cast(ca AS INTEGER) END AS capacity, nullif(ty, '') AS type,
    CASE WHEN eq <> '' THEN list_filter(list_transform(string_split(eq, ';'), lambda x: {sq.utrim('x')}),
                                        lambda x: x <> '') END AS equipment,
    CASE WHEN av = '' THEN true WHEN lower(av) = 'true' THEN true WHEN lower(av) = 'false' THEN false END AS is_available
  FROM r
)
SELECT row_no, room_code, building, floor, capacity, type, to_json(equipment) AS equipment_json, is_available,
  concat_ws(',',
    CASE WHEN rc = '' THEN 'missing_room_code' END,
    CASE WHEN length(room_code) > 50 THEN 'too_long_room_code' END,
    CASE WHEN length(building) > 100 THEN 'too_long_building' END,
    CASE WHEN fl <> '' AND floor IS NULL THEN 'bad_floor' END,
    CASE WHEN ca = '' THEN 'missing_capacity' END,
    CASE WHEN ca <> '' AND capacity IS NULL THEN 'bad_capacity' END,
    CASE WHEN ty = '' THEN 'missing_type' END,
    CASE WHEN length(type) > 50 THEN 'too_long_type' END,
    CASE WHEN av <> '' AND is_available IS NULL THEN 'bad_is_available' END) AS reasons
FROM typed""")
def classrooms_load(spark, t):
    """A7 classrooms contract: B12 ';' lists stored as JSON (B13), booleans with default, typed ints."""
    rows = apply_contract(fx.raw_classrooms(t), "classrooms")
    return rows.select("row_no", "room_code", "building", "floor", "capacity", "type",
                       F.to_json("equipment").alias("equipment_json"), "is_available",
                       F.array_join("reasons", ",").alias("reasons"))


@query("enrollments_load", """
WITH r AS (
  SELECT CASE WHEN o_custkey % 41 = 0 THEN 'X' ELSE 'S' END || CAST(o_custkey AS VARCHAR) AS sid,
    CASE WHEN l_partkey % 53 = 0 THEN 'c' ELSE 'C' END || CAST(l_partkey AS VARCHAR) AS cc,
    CAST(year(o_orderdate) AS VARCHAR) || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') AS ay,
    CASE WHEN month(o_orderdate) <= 6 THEN '2' ELSE '1' END AS se,
    strftime(o_orderdate, '%Y-%m-%d') AS ed,
    CASE WHEN l_returnflag = 'R' THEN 'dropped' WHEN l_returnflag = 'A' THEN 'completed' ELSE '' END AS st
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
),
typed AS (
  SELECT r.*, s.id AS student_id, c.id AS course_id, nullif(ay, '') AS academic_year,
    try_cast(se AS INTEGER) AS semester, try_cast(ed AS TIMESTAMP) AS enrollment_date,
    CASE WHEN st = '' THEN 'enrolled' ELSE st END AS status
  FROM r
  LEFT JOIN (SELECT c_custkey + 1 AS id, 'S' || CAST(c_custkey AS VARCHAR) AS code FROM customer) s ON s.code = r.sid
  LEFT JOIN (SELECT p_partkey + 1 AS id, 'C' || CAST(p_partkey AS VARCHAR) AS code FROM part) c ON c.code = r.cc
)
SELECT student_id, course_id, academic_year, semester, enrollment_date, status,
  concat_ws(',',
    CASE WHEN ay = '' THEN 'missing_academic_year' END,
    CASE WHEN length(academic_year) > 10 THEN 'too_long_academic_year' END,
    CASE WHEN se = '' THEN 'missing_semester' END,
    CASE WHEN se <> '' AND semester IS NULL THEN 'bad_semester' END,
    CASE WHEN ed <> '' AND enrollment_date IS NULL THEN 'bad_enrollment_date' END,
    CASE WHEN length(status) > 20 THEN 'too_long_status' END,
    CASE WHEN status NOT IN ('enrolled', 'dropped', 'completed') THEN 'bad_status' END,
    CASE WHEN sid <> '' AND student_id IS NULL THEN 'unknown_student_id' END,
    CASE WHEN cc <> '' AND course_id IS NULL THEN 'unknown_course_id' END) AS reasons
FROM typed""")
def enrollments_load(spark, t):
    """A7 + C2: enrolment upload with student / course codes resolved to ids (case-sensitive)."""
    from ..operators.contract import apply_lookups
    rows = apply_contract(fx.raw_enrollments(t), "student_enrollments")
    rows = apply_lookups(rows, "student_enrollments",
                         {"students": fx.student_codes(t), "courses": fx.course_codes(t)})
    return rows.select("student_id", "course_id", "academic_year", "semester", "enrollment_date", "status",
                       F.array_join("reasons", ",").alias("reasons"))


_SD, _SR = sq.norm_date("sd")
_ED, _ER = sq.norm_date("ed")
_TERM_ROWS = sq.with_(sq.RAW_TERMS) + f""",
c AS (SELECT row_no, {_t('na')} AS na, {_t('sd')} AS sd, {_t('ed')} AS ed, {_t('ay')} AS ay,
        {sq.utrim("coalesce(nullif(st, ''), 'upcoming')")} AS status FROM raw_terms),
term_rows AS (
  SELECT row_no, nullif(na, '') AS name, {_SD} AS start_date, {_ED} AS end_date, nullif(ay, '') AS academic_year,
    status,
    concat_ws(',',
      CASE WHEN na = '' THEN 'missing_name' END,
      CASE WHEN length(na) > 50 THEN 'too_long_name' END,
      CASE WHEN sd = '' THEN 'missing_start_date' END,
      ({_SR}) || '_start_date',
      CASE WHEN ed = '' THEN 'missing_end_date' END,
      ({_ER}) || '_end_date',
      CASE WHEN ay = '' THEN 'missing_academic_year' END,
      CASE WHEN length(ay) > 10 THEN 'too_long_academic_year' END,
      CASE WHEN length(status) > 20 THEN 'too_long_status' END,
      CASE WHEN status NOT IN ('upcoming', 'active', 'completed') THEN 'bad_status' END) AS reasons
  FROM c
)"""


@query("terms_rows", _TERM_ROWS + """
SELECT * FROM term_rows""")
def terms_rows(spark, t):
    """The academic-terms route: B1 aliases, B5 dates, B3 status default picked before trim, B6, B7, B9."""
    rows = apply_contract(fx.raw_terms(t), "academic_terms")
    return rows.select("row_no", "name", "start_date", "end_date", "academic_year", "status",
                       F.array_join("reasons", ",").alias("reasons"))


@query("terms_upsert", _TERM_ROWS + """,
src AS (
  SELECT name, start_date, end_date, academic_year, status FROM (
    SELECT *, row_number() OVER (PARTITION BY name ORDER BY row_no DESC) AS rn FROM term_rows WHERE reasons = '')
  WHERE rn = 1
)
SELECT CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS id, name, start_date, end_date, academic_year, status,
  TIMESTAMP '2025-01-01 00:00:00' AS created_at, TIMESTAMP '2025-01-01 00:00:00' AS updated_at
FROM src""")
def terms_upsert(spark, t):
    """The academic-terms route end to end (quarantine mode) into an empty table: D3 + A8 + A4."""
    from ..operators.ingest import load
    return load(fx.raw_terms(t), "academic_terms", None, fx.RUN_TS).table

"""The fixture derivations of ``plans.fixtures`` as SQL common table expressions (DuckDB dialect)."""

RAW_DEPARTMENTS = r"""
raw_departments AS (
  SELECT c_custkey + 2 AS row_no,
    CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '   '
      WHEN 3 THEN chr(160) || 'D' || CAST(c_nationkey AS VARCHAR) || chr(9)
      WHEN 4 THEN 'DEPT' || CAST(c_custkey % 40 AS VARCHAR)
      ELSE 'CODE_TOO_LONG_' || CAST(c_custkey AS VARCHAR) END AS code_a,
    CASE WHEN c_custkey % 4 = 0 THEN 'alt' || CAST(c_nationkey AS VARCHAR) END AS code_b,
    CASE c_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN NULL
      WHEN 2 THEN ' ' || c_mktsegment || ' Engineering' || chr(12288)
      WHEN 3 THEN '123 456'
      ELSE c_mktsegment || ' ' || c_name END AS name_a,
    CASE WHEN c_custkey % 9 = 0 AND c_custkey % 2 = 0 THEN 'Lower ' || c_mktsegment END AS name_b,
    CASE WHEN c_custkey % 9 = 1 THEN 'Dept of ' || c_mktsegment END AS name_c,
    CASE WHEN c_custkey % 5 <> 0 THEN 'Segment ' || c_mktsegment || ' of nation ' || CAST(c_nationkey AS VARCHAR) END AS desc_a,
    'hod' || CAST(c_custkey AS VARCHAR) || '@university.edu' AS email_a
  FROM customer
)"""

# B2: the whitespace class of functions.text.TRIM_PATTERN
WS = r"[\t\n\x{000B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def utrim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def pick(*cols: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({c}, '')" for c in cols) + ", '')"


DEPARTMENT_ROWS = f"""
dep_picked AS (
  SELECT row_no,
    {utrim(pick('code_a', 'code_b'))} AS code0,
    {utrim(pick('name_a', 'name_b', 'name_c'))} AS name,
    {utrim(pick('desc_a'))} AS description,
    {utrim(pick('email_a'))} AS hod_email
  FROM raw_departments
),
dep_coded AS (
  SELECT *, CASE WHEN code0 = '' THEN upper(substring(regexp_replace(name, '[^A-Za-z]', '', 'g'), 1, 6))
                 ELSE code0 END AS code
  FROM dep_picked
),
dep_rows AS (
  SELECT row_no, code, name, description, hod_email, code0 = '' AS code_derived,
    CASE WHEN name = '' THEN 'missing_name'
         WHEN code = '' THEN 'code_not_derivable'
         WHEN length(code) > 10 THEN 'too_long_code'
         WHEN length(name) > 255 THEN 'too_long_name' END AS reason
  FROM dep_coded
)"""

SEED_DEPARTMENTS = """
seed_departments AS (
  SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, 'D' || CAST(n_nationkey AS VARCHAR) AS code,
    n_name AS name, 'Region ' || CAST(n_regionkey AS VARCHAR) AS description,
    CAST(NULL AS BIGINT) AS head_of_department,
    TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at
  FROM nation
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)

# B5 in SQL: the shapes of functions.dates, tried in the same order.
D_DASH = r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
D_SLASH = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
D_YMD = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
D_ISO = r"^(\d{4})-(\d{2})-(\d{2})[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?Z?$"
D_MON = r"^([A-Za-z]{3})[A-Za-z]*\.? (\d{1,2}),? (\d{4})$"
D_YMD_SLASH = r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
D_DAY_MON = r"^(\d{1,2}) ([A-Za-z]{3})[A-Za-z]*\.?,? (\d{4})$"
D_OFFSET = r"^\d{4}-\d{2}-\d{2}T(\d{2}):(\d{2})(?::\d{2}(?:\.\d{1,9})?)?([+-])(\d{2}):?(\d{2})$"
MONTHS = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"


def _ymd(y: str, m: str, d: str) -> str:
    return (f"CASE WHEN {y} <> '0000' THEN try_cast({y} || '-' || lpad({m}, 2, '0') || '-' || "
            f"lpad({d}, 2, '0') AS DATE) END")


def norm_date(x: str) -> tuple[str, str]:
    """(date expr, reason expr) for the text expression ``x``."""
    g = lambda p, i: f"regexp_extract({x}, '{p}', {i})"
    mon = f"coalesce(list_position({MONTHS}, lower({g(D_MON, 1)})), 0)"
    mon2 = f"coalesce(list_position({MONTHS}, lower({g(D_DAY_MON, 2)})), 0)"
    h, m, oh, om = (f"try_cast({g(D_OFFSET, i)} AS INTEGER)" for i in (1, 2, 4, 5))
    utc = (f"CASE WHEN {h} <= 23 AND {m} <= 59 AND {oh} <= 23 AND {om} <= 59 AND substr({x}, 1, 4) <> '0000' THEN "
           f"try_cast(substr({x}, 1, 10) AS DATE) + CAST(floor(({h} * 60 + {m} - CASE {g(D_OFFSET, 3)} WHEN '-' THEN -1 ELSE 1 END "
           f"* ({oh} * 60 + {om})) / 1440.0) AS INTEGER) END")
    shapes = [
        (f"regexp_matches({x}, '{D_DASH}')", _ymd(g(D_DASH, 3), g(D_DASH, 2), g(D_DASH, 1))),
        (f"regexp_matches({x}, '{D_SLASH}')", _ymd(g(D_SLASH, 3), g(D_SLASH, 2), g(D_SLASH, 1))),
        (f"regexp_matches({x}, '{D_YMD}')", _ymd(g(D_YMD, 1), g(D_YMD, 2), g(D_YMD, 3))),
        (f"regexp_matches({x}, '{D_ISO}')", _ymd(g(D_ISO, 1), g(D_ISO, 2), g(D_ISO, 3))),
        (f"regexp_matches({x}, '{D_MON}') AND {mon} > 0", _ymd(g(D_MON, 3), f'CAST({mon} AS VARCHAR)', g(D_MON, 2))),
        (f"regexp_matches({x}, '{D_YMD_SLASH}')", _ymd(g(D_YMD_SLASH, 1), g(D_YMD_SLASH, 2), g(D_YMD_SLASH, 3))),
        (f"regexp_matches({x}, '{D_DAY_MON}') AND {mon2} > 0",
         _ymd(g(D_DAY_MON, 3), f'CAST({mon2} AS VARCHAR)', g(D_DAY_MON, 1))),
        (f"regexp_matches({x}, '{D_OFFSET}')", utc)]
    date = "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in shapes) + " END"
    shaped = "(" + " OR ".join(f"({test})" for test, _ in shapes) + ")"
    reason = (f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL WHEN NOT {shaped} THEN 'bad_format' "
              f"WHEN ({date}) IS NULL THEN 'bad_date' END")
    return date, reason


def date_text(d: str, k: str) -> str:
    """SQL twin of ``fixtures.date_text``."""
    day, mon, yr = (f"CAST(day({d}) AS VARCHAR)", f"CAST(month({d}) AS VARCHAR)", f"CAST(year({d}) AS VARCHAR)")
    return f"""CASE {k} % 14
      WHEN 0 THEN {day} || '-' || {mon} || '-' || {yr}
      WHEN 1 THEN lpad({day}, 2, '0') || '/' || lpad({mon}, 2, '0') || '/' || {yr}
      WHEN 2 THEN {yr} || '-' || {mon} || '-' || {day}
      WHEN 3 THEN 'n/a'
      WHEN 4 THEN '31-02-' || {yr}
      WHEN 5 THEN lpad({mon}, 2, '0') || '/' || lpad({day}, 2, '0') || '/' || {yr}
      WHEN 6 THEN strftime({d}, '%Y-%m-%d') || 'T10:30:00Z'
      WHEN 8 THEN {yr} || '/' || {mon} || '/' || {day}
      WHEN 9 THEN {day} || ' ' || strftime({d}, '%b') || ' ' || {yr}
      WHEN 10 THEN strftime({d}, '%b') || ' ' || {day} || ' ' || {yr}
      WHEN 11 THEN strftime({d}, '%Y-%m-%d') || 'T02:30:00+05:30'
      WHEN 12 THEN strftime({d}, '%Y-%m-%d') || 'T23:30-0100'
      WHEN 13 THEN strftime({d}, '%Y-%m-%d') || ' 23:59:59'
      ELSE strftime({d}, '%b') || ' ' || {day} || ', ' || {yr}
    END"""


RAW_DATES = f"""
raw_dates AS (SELECT o_orderkey, {date_text('o_orderdate', 'o_orderkey')} AS raw FROM orders)"""

RAW_TERMS = f"""
raw_terms AS (
  SELECT o_orderkey + 2 AS row_no, 'Term ' || CAST(o_orderkey % 400 AS VARCHAR) AS na,
    {date_text('o_orderdate', 'o_orderkey')} AS sd,
    strftime(o_orderdate + INTERVAL 120 DAY, '%d-%m-%Y') AS ed,
    CAST(year(o_orderdate) AS VARCHAR) || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') AS ay,
    CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'active' WHEN 2 THEN 'completed' WHEN 3 THEN '  '
      ELSE 'done' END AS st
  FROM orders
)"""

RAW_COURSES = """
raw_courses AS (
  SELECT p_partkey + 2 AS row_no,
    CASE WHEN p_partkey % 97 = 0 THEN '' ELSE 'C' || CAST(p_partkey AS VARCHAR) END AS course_code_raw,
    p_name AS title_raw,
    CASE WHEN p_partkey % 13 = 0 THEN 'x' ELSE CAST(p_size % 8 + 1 AS VARCHAR) END AS semester_raw,
    CASE p_partkey % 5 WHEN 0 THEN '4' WHEN 1 THEN '3.5' WHEN 2 THEN '2.25' WHEN 3 THEN '100' ELSE '' END AS credits_raw,
    CAST(p_size % 6 + 1 AS VARCHAR) AS hours_raw,
    CASE p_partkey % 7 WHEN 0 THEN 'lab' WHEN 1 THEN 'project' WHEN 2 THEN 'Theory' WHEN 3 THEN '' ELSE 'theory' END AS type_raw,
    CASE p_partkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'TRUE' ELSE 'yes' END AS elective_raw,
    p_type AS desc_raw
  FROM part
)"""

RAW_SLOTS = """
raw_slots AS (
  SELECT o_orderkey + 2 AS row_no,
    'Slot ' || CAST(o_orderkey AS VARCHAR) AS name_raw,
    CAST((o_orderkey % 1500) // 60 AS VARCHAR) || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS start_raw,
    CASE WHEN o_orderkey % 11 = 0 THEN '12:3' ELSE lpad(CAST(((o_orderkey % 1500) // 60 + 1) % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || ':00' END AS end_raw,
    '60' AS duration_raw,
    CASE o_orderkey % 5 WHEN 0 THEN 'lecture' WHEN 1 THEN 'lab' WHEN 2 THEN 'lunch' WHEN 3 THEN 'Break' ELSE '' END AS type_raw,
    CASE o_orderkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN '' ELSE 'no' END AS active_raw
  FROM orders
)"""

ENTRIES = """
entries AS (
  SELECT CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR)
           || ':' || CAST(l_suppkey AS VARCHAR) AS entry_id,
    CAST((l_orderkey // 20) % 4 AS BIGINT) AS timetable_id,
    CAST(l_orderkey % 7 + 1 AS INTEGER) AS dow,
    l_suppkey AS room_id, CAST(l_partkey // 10 AS BIGINT) AS faculty_id, l_partkey AS course_id,
    CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END AS section,
    CAST((480 + (l_partkey % 24) * 30) * 60 AS INTEGER) AS start_sec,
    CAST((480 + (l_partkey % 24) * 30) * 60 + CASE WHEN l_linenumber % 3 = 0 THEN 10800 ELSE 3600 END AS INTEGER) AS end_sec,
    CASE WHEN l_linenumber % 3 = 0 THEN 'lab' ELSE 'lecture' END AS entry_type,
    CAST(20 + l_partkey % 41 AS INTEGER) AS max_students
  FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem)
)"""

ROOMS = """
rooms AS (
  SELECT s_suppkey AS room_id, 'R' || CAST(s_suppkey AS VARCHAR) AS room_code,
    CAST(20 + s_suppkey % 60 AS INTEGER) AS capacity,
    CASE WHEN s_suppkey % 5 = 0 THEN 'lab' ELSE 'class' END AS type,
    s_suppkey % 17 <> 0 AS is_available
  FROM supplier
)"""

# The standard teaching slots (operators.timetable.STANDARD_SLOTS without lunch) x 7 weekdays.
SLOTS = """
slots AS (
  SELECT * FROM (VALUES ('Period 1', 32400, 36000, 'lecture'), ('Period 2', 36900, 40500, 'lecture'),
    ('Period 3', 41400, 45000, 'lecture'), ('Period 4', 48600, 52200, 'lecture'),
    ('Period 5', 53100, 56700, 'lecture'), ('Period 6', 57600, 61200, 'lecture'),
    ('Lab Session 1', 32400, 43200, 'lab'), ('Lab Session 2', 48600, 59400, 'lab'))
    AS v(slot_name, slot_start, slot_end, slot_type)
),
grid AS (SELECT CAST(d AS INTEGER) AS dow, s.* FROM range(1, 8) r(d), slots s)"""

PAIRS_SQL = """
pairs AS (
  SELECT 'room' AS kind, a.timetable_id, a.dow, CAST(a.room_id AS VARCHAR) AS resource, a.entry_id AS entry_a, b.entry_id AS entry_b
  FROM entries a JOIN entries b ON a.timetable_id = b.timetable_id AND a.dow = b.dow AND a.room_id = b.room_id
    AND a.entry_id < b.entry_id AND a.start_sec < b.end_sec AND b.start_sec < a.end_sec
  UNION ALL
  SELECT 'faculty', a.timetable_id, a.dow, CAST(a.faculty_id AS VARCHAR), a.entry_id, b.entry_id
  FROM entries a JOIN entries b ON a.timetable_id = b.timetable_id AND a.dow = b.dow AND a.faculty_id = b.faculty_id
    AND a.entry_id < b.entry_id AND a.start_sec < b.end_sec AND b.start_sec < a.end_sec
  UNION ALL
  SELECT 'section', a.timetable_id, a.dow, CAST(a.course_id AS VARCHAR) || '/' || a.section, a.entry_id, b.entry_id
  FROM entries a JOIN entries b ON a.timetable_id = b.timetable_id AND a.dow = b.dow AND a.course_id = b.course_id
    AND a.section = b.section AND a.entry_id < b.entry_id AND a.start_sec < b.end_sec AND b.start_sec < a.end_sec
)"""

ENROLMENTS = """
enrolment_rows AS (
  SELECT o_custkey AS student_id, l_partkey AS course_id, CAST(year(o_orderdate) AS VARCHAR) AS academic_year,
    CASE WHEN month(o_orderdate) <= 6 THEN 2 ELSE 1 END AS semester,
    CASE WHEN l_returnflag = 'R' THEN 'dropped' WHEN l_returnflag = 'A' THEN 'completed' ELSE 'enrolled' END AS status,
    o_orderdate AS enrollment_date, o_orderkey, l_linenumber, l_suppkey
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
),
enrollments AS (
  SELECT student_id, course_id, academic_year, semester, status, enrollment_date FROM (
    SELECT *, row_number() OVER (PARTITION BY student_id, course_id, academic_year
      ORDER BY enrollment_date DESC, o_orderkey DESC, l_linenumber DESC, l_suppkey DESC, semester DESC, status DESC) AS rn
    FROM enrolment_rows) WHERE rn = 1
),
live AS (SELECT * FROM enrollments WHERE status <> 'dropped'),
courses AS (
  SELECT p_partkey AS course_id, p_type AS kind, CAST(p_size % 5 + 1 AS DECIMAL(3,1)) AS credits,
    CAST(p_size % 4 + 2 AS INTEGER) AS hours_per_week
  FROM part
),
assignments AS (
  SELECT DISTINCT l_partkey AS course_id, l_suppkey AS faculty_id,
    CASE WHEN month(o_orderdate) <= 6 THEN 2 ELSE 1 END AS semester, CAST(year(o_orderdate) AS VARCHAR) AS academic_year,
    CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END AS section
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
)"""

SIGNATURES = """,
sigs AS (
  SELECT student_id, academic_year, semester, string_agg(kind, '|' ORDER BY kind) AS signature, count(*) AS kinds
  FROM (SELECT DISTINCT l.student_id, l.academic_year, l.semester, c.kind FROM live l JOIN courses c USING (course_id))
  GROUP BY student_id, academic_year, semester
),
s2 AS (
  SELECT s.*, CAST(c.c_nationkey AS BIGINT) AS program_id,
    count(*) OVER (PARTITION BY c.c_nationkey, s.academic_year, s.semester, s.signature) AS sig_n
  FROM sigs s JOIN customer c ON c.c_custkey = s.student_id
),
pooled AS (SELECT *, CASE WHEN sig_n >= 20 THEN signature ELSE '*' END AS pool FROM s2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY program_id, academic_year, semester, pool ORDER BY student_id) AS rn,
    count(*) OVER (PARTITION BY program_id, academic_year, semester, pool) AS n
  FROM pooled
),
assigned AS (
  SELECT student_id, program_id, academic_year, semester, signature, pool, n AS pool_size,
    CAST(((rn - 1) * ((n + 59) // 60)) // n AS INTEGER) AS batch_no, n < 20 AS undersized
  FROM ranked
)"""

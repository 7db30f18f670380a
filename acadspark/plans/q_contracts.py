"""Catalogue: the upload contracts that have no query elsewhere (A7, B7, B10, C2), and people's accounts.

An upload is given by header -> expression over a harness table, in words that mean the same in Spark SQL and DuckDB.
The oracle types each column and checks each rule in SQL of its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..contracts import CONTRACTS, LOOKUP_CODES, USER_ROLES
from ..operators.contract import apply_contract, apply_lookups, people
from .catalog import query


def _text(expr: str) -> str:
    return f"cast({expr} as varchar(30))"


#: contract -> (table, {header: text})
UPLOADS = {
    "programs": ("part", {
        "Code": f"case when p_partkey % 31 = 0 then '' when p_partkey % 29 = 0 then concat('PROGRAMME-CODE-TOO-LONG-', {_text('p_partkey')}) "
                f"else concat(' PR', {_text('p_partkey')}) end",
        "Name": "case when p_partkey % 37 = 0 then ' ' else concat(p_name, ' ') end",
        "Department Code": f"case when p_partkey % 9 = 0 then '' else concat('D', {_text('p_partkey % 27')}) end",
        "Duration Years": f"case when p_partkey % 11 = 0 then '' when p_partkey % 13 = 0 then 'four' else {_text('p_size % 5 + 1')} end",
        "Description": "p_type"}),
    "students": ("customer", {
        "Name": "c_name",
        "Student ID": f"case when c_custkey % 43 = 0 then '' else concat('S', {_text('c_custkey')}) end",
        "Email": f"concat('s', {_text('c_custkey')}, '@uni.example')",
        "Program Code": f"concat('P', {_text('c_nationkey % 6')})",
        "Batch Name": f"case when c_custkey % 3 = 0 then '' else concat('B', {_text('c_nationkey + 2')}) end",
        "Enrollment Year": f"case when c_custkey % 17 = 0 then '' when c_custkey % 19 = 0 then '20x1' else {_text('2019 + c_custkey % 6')} end",
        "Current Semester": f"case when c_custkey % 5 = 0 then '' else {_text('c_custkey % 8 + 1')} end",
        "Phone": f"case when c_custkey % 53 = 0 then '+00 0000 0000 0000 0000' else {_text('c_custkey * 7')} end",
        "Address": "c_mktsegment",
        "Status": "case when c_custkey % 7 = 0 then '' when c_custkey % 23 = 0 then 'Active' when c_custkey % 2 = 0 then 'active' "
                  "else 'graduated' end"}),
    "faculty": ("supplier", {
        "Name": f"concat('Dr ', {_text('s_suppkey')})",
        "Employee ID": f"case when s_suppkey % 21 = 0 then '' else concat('F', {_text('s_suppkey')}) end",
        "Email": f"concat('faculty.', {_text('s_suppkey')}, '@uni.example')",
        "Department Code": f"concat('D', {_text('s_nationkey + 1')})",
        "Designation": "case when s_suppkey % 2 = 0 then 'Lecturer' else '' end",
        "Experience Years": f"case when s_suppkey % 10 = 0 then 'many' else {_text('s_suppkey % 30')} end",
        "Specialization": "case when s_suppkey % 3 = 0 then '' else ' Maps ;; Caves;' end",
        "Working Hours Per Week": f"case when s_suppkey % 4 = 0 then '' else {_text('10 + s_suppkey % 20')} end",
        "Time Preferences": "'Noon;Evening'"}),
    "course_prerequisites": ("part", {
        "Course Code": f"concat('C', {_text('p_partkey')})",
        "Prerequisite Course Code": f"concat('C', {_text('p_partkey * 2')})",
        "Is Mandatory": "case when p_partkey % 3 = 0 then '' when p_partkey % 5 = 0 then 'FALSE' when p_partkey % 7 = 0 then 'yes' else 'true' end"}),
    "course_assignments": ("lineitem", {
        "Course Code": f"concat('C', {_text('l_partkey')})",
        "Faculty Employee ID": f"concat('F', {_text('l_suppkey + 5')})",
        "Academic Year": "case when l_linenumber = 6 then '' else '2031-32' end",
        "Semester": f"case when l_linenumber = 5 then 'one' when l_linenumber = 4 then '' else {_text('l_linenumber')} end",
        "Section": "case when l_linenumber % 2 = 0 then '' when l_quantity > 45 then 'SECTION-ELEVEN' else 'B' end",
        "Max Students": f"case when l_linenumber = 3 then '' else {_text('l_linenumber * 20')} end"}),
}
#: lookup -> (table, id, code)
DIMENSIONS = {
    "departments": ("nation", "n_nationkey + 1", f"concat('D', {_text('n_nationkey')})"),
    "programs": ("region", "r_regionkey + 1", f"concat('P', {_text('r_regionkey')})"),
    "batches": ("nation", "n_nationkey + 1", f"concat('B', {_text('n_nationkey')})"),
    "courses": ("part", "p_partkey + 1", f"concat('C', {_text('p_partkey')})"),
    "faculty": ("supplier", "s_suppkey + 1", f"concat('F', {_text('s_suppkey')})"),
}


def upload(t, name: str):
    source, cols = UPLOADS[name]
    return getattr(t, source).selectExpr(*(f"{e} as `{h}`" for h, e in cols.items()))


def dimension(t, name: str):
    source, key, code = DIMENSIONS[name]
    return getattr(t, source).selectExpr(f"cast({key} as bigint) as id", f"{code} as {LOOKUP_CODES[name]}")


def loaded(t, name: str):
    c = CONTRACTS[name]
    dims = {f.lookup: dimension(t, f.lookup) for f in c.fields if f.kind == "lookup"}
    return apply_lookups(apply_contract(upload(t, name), name), name, dims)


def _load_sql(name: str, more: str = "") -> str:
    source, cols = UPLOADS[name]
    c = CONTRACTS[name]
    raw = ", ".join(f"coalesce(trim({cols[f.headers[0]]}), '') as r_{f.name}" if f.headers[0] in cols else f"'' as r_{f.name}"
                    for f in c.fields)
    typed, rules, unknown, joins = [], [], [], []
    for f in c.fields:
        r, default = f"r_{f.name}", "null" if f.default is None else repr(f.default)
        if f.required:
            rules.append(f"case when {r} = '' then 'missing_{f.name}' end")
        if f.kind == "int":
            typed.append(f"case when {r} = '' then {default} else try_cast({r} as integer) end as {f.name}")
            rules.append(f"case when {r} <> '' and try_cast({r} as integer) is null then 'bad_{f.name}' end")
        elif f.kind == "bool":
            default = "null" if f.default is None else str(f.default).lower()
            typed.append(f"case when {r} = '' then {default} when lower({r}) = 'true' then true when lower({r}) = 'false' then false end as {f.name}")
            rules.append(f"case when {r} <> '' and lower({r}) not in ('true', 'false') then 'bad_{f.name}' end")
        elif f.kind == "list":
            typed.append(f"case when {r} <> '' then array_to_string(list_filter(list_transform(string_split({r}, ';'), lambda x: trim(x)), "
                         f"lambda x: x <> ''), '|') end as {f.name}")
        elif f.kind == "lookup":
            joins.append(f"left join (select cast({DIMENSIONS[f.lookup][1]} as bigint) as id, {DIMENSIONS[f.lookup][2]} as code "
                         f"from {DIMENSIONS[f.lookup][0]}) d_{f.name} on d_{f.name}.code = r_{f.name}")
            typed.append(f"d_{f.name}.id as {f.name}")
            unknown.append(f"case when {r} <> '' and d_{f.name}.id is null then 'unknown_{f.name}' end")
        else:
            typed.append(f"coalesce(nullif({r}, ''), {default}) as {f.name}")
        if f.max_len is not None:
            rules.append(f"case when length({r}) > {f.max_len} then 'too_long_{f.name}' end")
        if f.domain is not None:
            rules.append(f"case when {r} <> '' and {r} not in {f.domain!r} then 'bad_{f.name}' end")
    return (f"with raw as (select {raw} from {source}),\nloaded as (select {', '.join(typed)}, "
            f"concat_ws(',', {', '.join(rules + unknown)}) as reasons from raw {' '.join(joins)})" + (more or " select * from loaded"))


def _register(name: str) -> None:
    c = CONTRACTS[name]
    lists = {f.name for f in c.fields if f.kind == "list"}

    def run(spark, t):
        return loaded(t, name).select(
            *(F.array_join(f.name, "|").alias(f.name) if f.name in lists else f.name for f in c.fields),
            F.array_join("reasons", ",").alias("reasons"))

    run.__name__ = f"{name}_upload"
    run.__doc__ = f"A7 + C2: the {name} upload through its contract, every column and reason."
    query(run.__name__, _load_sql(name))(run)


for _name in UPLOADS:
    _register(_name)


def _account_sql(name: str, role: str, cte: str) -> str:
    return (f"{cte} as ({_load_sql(name, ' select email, name as full_name, phone from loaded')} "
            f"where reasons = '' and email is not null)")


@query("people_accounts", f"""
with {_account_sql('students', 'student', 's')}, {_account_sql('faculty', 'faculty', 'f')}
select email, full_name, phone, 'student' as role from s union all select email, full_name, phone, 'faculty' from f""")
def people_accounts(spark, t):
    """The user accounts that the students and faculty uploads carry; their role is in its domain."""
    students, _ = people(loaded(t, "students").where(F.size("reasons") == 0), "student")
    faculty, _ = people(loaded(t, "faculty").where(F.size("reasons") == 0), "faculty")
    return students.unionByName(faculty).where(F.col("role").isin(*USER_ROLES))

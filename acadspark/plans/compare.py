"""Side-by-side check of a catalogue query against its DuckDB oracle (development tool).

    python -m acadspark.plans.compare /root/testdata/sf0.01 [name ...]

Column order is ignored (columns are sorted by name) and rows are compared
as sorted multisets of normalised tuples.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

HARNESS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
           "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v == v.to_integral_value() else str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in HARNESS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]


def rows_of_duck(con, sql: str):
    rel = con.sql(sql)
    names = rel.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    data = rel.fetchall()
    return [names[i] for i in order], [tuple(_norm(r[i]) for i in order) for r in data]


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> dict:
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_cols, s_rows = rows_of_spark(df)
    t1 = time.time()
    out = {"name": name, "rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    d_cols, d_rows = rows_of_duck(con, sql)
    out["oracle_rows"] = len(d_rows)
    if s_cols != d_cols:
        out["status"] = f"COLUMNS {s_cols} != {d_cols}"
        return out
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    try:
        s_sorted, d_sorted = sorted(s_rows, key=key), sorted(d_rows, key=key)
    except TypeError:
        s_sorted, d_sorted = sorted(s_rows, key=repr), sorted(d_rows, key=repr)
    if s_sorted == d_sorted:
        out["status"] = "equal"
    else:
        diff_s = [r for r in s_sorted if r not in set(d_sorted)][:3]
        diff_d = [r for r in d_sorted if r not in set(s_sorted)][:3]
        out["status"] = "DIFF"
        out["spark_only"] = diff_s
        out["oracle_only"] = diff_d
    return out


def main(argv: list[str]) -> int:
    from ..session import local_session
    from .catalog import oracle_sql, queries

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(queries())
    spark = local_session(8)
    con = duck_connect(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, sf_dir, n, qs[n], sqls.get(n))
        except Exception as e:  # report and continue with the next query
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        bad += r["status"] not in ("equal", "rows-only")
        print(r, flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

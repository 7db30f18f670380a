"""C3 over a key graph: several parents, circles, self references, restricting keys, against a plain closure."""

import random

import pytest

from acadspark.contracts import FOREIGN_KEYS
from acadspark.operators.joins import delete_order, delete_report, delete_rows

EDGES = (("b", "a_id", "a", "cascade"), ("c", "a_id", "a", "cascade"), ("c", "b_id", "b", "cascade"),
         ("c", "boss", "c", "cascade"), ("d", "c_id", "c", "cascade"), ("e", "d_id", "d", "cascade"), ("d", "e_id", "e", "cascade"),
         ("log", "c_id", "c", "restrict"), ("c", "e_id", "e", "restrict"), ("leaf", "d_id", "d", "cascade"), ("leaf", "b_id", "b", "restrict"))
COLUMNS = {"a": [], "b": ["a_id"], "c": ["a_id", "b_id", "boss", "e_id"], "d": ["c_id", "e_id"], "e": ["d_id"],
           "log": ["c_id"], "leaf": ["d_id", "b_id"]}


def closure(rows, start):
    gone = {t: {r["id"] for r in rows[t] if r["id"] in start.get(t, ())} for t in rows}
    lost = {t: [r["id"] in gone[t] for r in rows[t]] for t in rows}
    while True:
        more = False
        for child, col, parent, action in EDGES:
            if action != "cascade":
                continue
            for i, r in enumerate(rows[child]):
                if not lost[child][i] and r[col] is not None and r[col] in gone[parent]:
                    lost[child][i] = more = True
                    gone[child].add(r["id"])
        if not more:
            return gone, lost


def tables_of(spark, seed):
    rng = random.Random(seed)
    rows = {t: [{"id": i} | {c: rng.choice([None, rng.randrange(40)]) for c in cols} for i in range(40)] for t, cols in COLUMNS.items()}
    for i in range(1, 40):  # a long chain of self references
        rows["c"][i]["boss"] = i - 1 if i % 4 else None
    made = {t: spark.createDataFrame([tuple(r.values()) for r in x], ", ".join(f"{c} long" for c in ["id", *COLUMNS[t]])) for t, x in rows.items()}
    made["leaf"] = made["leaf"].drop("id")  # a table without a key of its own
    return rows, made


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_and_blockers(spark, seed):
    rows, made = tables_of(spark, seed)
    start = {"a": {3, 5}, "e": {7}}
    gone, lost = closure(rows, start)
    want = {("deleted", t, None, None): sum(lost[t]) for t in rows if sum(lost[t])}
    for child, col, parent, action in EDGES:
        if action == "restrict":
            for i, r in enumerate(rows[child]):
                if not lost[child][i] and r[col] is not None and r[col] in gone[parent]:
                    want["blocked", child, col, str(r[col])] = want.get(("blocked", child, col, str(r[col])), 0) + 1
    asked = {t: spark.createDataFrame([(i,) for i in ids], "id long") for t, ids in start.items()}
    got = {(r.outcome, r.table_name, r.columns, r.value): r.n_rows for r in delete_report(made, asked, EDGES).collect()}
    assert got == want
    with pytest.raises(ValueError, match="still refers"):
        delete_rows(made, asked, EDGES)
    free = tuple(e for e in EDGES if e[3] == "cascade")
    left = delete_rows(made, asked, free)
    assert {t: df.count() for t, df in left.items()} == {t: 40 - sum(lost[t]) for t in rows}


def test_order_and_nothing_to_delete(spark):
    order = delete_order(EDGES)
    place = {t: i for i, g in enumerate(order) for t in g}
    assert ["d", "e"] in order and place["a"] < place["b"] < place["c"] < place["d"] < place["leaf"]
    flat = [t for g in delete_order(FOREIGN_KEYS) for t in g]
    assert flat.index("users") < flat.index("students") and flat.index("timetables") < flat.index("timetable_entries")
    _, made = tables_of(spark, 3)
    assert delete_report(made, {"a": spark.createDataFrame([], "id long")}, EDGES).collect() == []

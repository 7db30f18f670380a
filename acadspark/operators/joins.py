"""The foreign-key joins (C1, C3). Broadcasts are left to Spark, which decides them by bytes (AQE: at run time)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, fk: str | Sequence[str], parent: DataFrame,
            pk: str | Sequence[str] | None = None) -> DataFrame:
    """Child rows whose non-NULL foreign key has no parent row.

    A left-anti join on the key; NULL keys pass (SQL foreign-key rule).
    Only the parent's key column is read, so the scan prunes to one column.
    """
    fks = [fk] if isinstance(fk, str) else list(fk)
    pks = fks if pk is None else ([pk] if isinstance(pk, str) else list(pk))
    keys = parent.select(*[F.col(p).alias(f"_pk{i}") for i, p in enumerate(pks)]).distinct()
    cond = [F.col(f) == F.col(f"_pk{i}") for i, f in enumerate(fks)]
    all_set = F.col(fks[0]).isNotNull()
    for f in fks[1:]:
        all_set = all_set & F.col(f).isNotNull()
    nonnull = child.where(all_set)   # MATCH SIMPLE: any NULL column passes
    return nonnull.join(keys, cond, "left_anti")


def cascade(deleted_keys: DataFrame, edges: Sequence[tuple[DataFrame, str, str]], parent_key: str) -> list[DataFrame]:
    """C3 cascade: walk ``edges`` in FK order; each edge is (child, fk_col, child_key).

    ``deleted_keys`` holds the deleted parent keys in ``parent_key``. Each step
    is a left-semi join of the child on the previous level's deleted keys, so
    only key columns travel through the shuffles. Returns the deleted rows of
    every child level, in order.
    """
    out = []
    prev, prev_key = deleted_keys, parent_key
    for child, fk, child_key in edges:
        keys = prev.select(F.col(prev_key).alias("_del")).distinct()
        gone = child.join(keys, F.col(fk) == F.col("_del"), "left_semi")
        out.append(gone)
        prev, prev_key = gone, child_key
    return out


def blockers(child: DataFrame, fk: str, deleted_keys: DataFrame, parent_key: str) -> DataFrame:
    """C3 restrict: child rows that reference a deleted parent and so block the delete."""
    keys = deleted_keys.select(F.col(parent_key).alias("_del")).distinct()
    return child.join(keys, F.col(fk) == F.col("_del"), "left_semi")


# --- C3 over the whole key graph -----------------------------------------------------------------------------------

CASCADE = "cascade"
#: how often a group of tables that refer to one another in a circle is gone through at most
MOST_ROUNDS = 1000


def delete_order(edges: Sequence[tuple[str, str, str, str]]) -> list[list[str]]:
    """The tables of the cascading edges, parents first; tables that refer to one another in a circle (or to
    themselves) as one group, which is gone through until nothing is left."""
    parents: dict[str, set[str]] = {}
    for child, _, parent, action in edges:
        if action == CASCADE:
            parents.setdefault(child, set()).add(parent)
            parents.setdefault(parent, set())

    def reach(t: str) -> set[str]:
        seen, todo = set(), [t]
        while todo:
            for p in parents[todo.pop()] - seen:
                seen.add(p)
                todo.append(p)
        return seen
    above = {t: reach(t) for t in parents}
    groups: list[list[str]] = []
    for t in sorted(parents, key=lambda t: (len(above[t] - {t}), t)):
        if not any(t in g for g in groups):
            groups.append([t, *sorted(x for x in parents if x != t and x in above[t] and t in above[x])])
    return sorted(groups, key=lambda g: (len(above[g[0]] - set(g)), g))


def _keys(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("_key")).where("_key is not null").distinct()


def _flagged(child: DataFrame, columns: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """``child`` with a boolean for each name: whether the row's column is one of the parent's deleted keys."""
    out = child
    for name, (column, keys) in columns.items():
        hit = keys.select(F.col("_key").alias(f"_k{name}"), F.lit(True).alias(name))
        out = out.join(hit, F.col(column) == F.col(f"_k{name}"), "left").drop(f"_k{name}").withColumn(
            name, F.coalesce(name, F.lit(False)))
    return out


def deleted_keys(tables: dict[str, DataFrame], start: dict[str, DataFrame], edges: Sequence[tuple[str, str, str, str]],
                 id_col: str = "id") -> dict[str, DataFrame]:
    """Per table the keys (``_key``) that a delete of the keys in ``start`` (a column ``id_col`` each) takes away.

    Tables are gone through parents first, so the keys of several parents are united before their children are looked
    at, and every table is joined once. Tables in a circle are taken round by round: only keys found in the last round
    are joined, until there are none. Key tables are checkpointed: they are read by every child, and a lost executor
    costs one step.
    """
    found = {t: _keys(df, id_col) for t, df in start.items()}
    for group in delete_order(edges):
        inner = [(c, col, p) for c, col, p, action in edges if action == CASCADE and c in group and c in tables
                 and id_col in tables[c].columns]
        outer = {}
        for c, col, p in inner:
            if p not in group and p in found:
                outer.setdefault(c, []).append((col, found[p]))
        for c, parts in outer.items():
            hits = _flagged(tables[c].select(id_col, *{col for col, _ in parts}), {f"_h{i}": x for i, x in enumerate(parts)})
            some = hits.where(reduce(lambda a, b: a | b, [F.col(f"_h{i}") for i in range(len(parts))]))
            found[c] = _keys(some, id_col).union(found[c]).distinct() if c in found else _keys(some, id_col)
        for t in group:
            if t in found:
                found[t] = found[t].checkpoint(eager=True)
        circle = [(c, col, p) for c, col, p in inner if p in group]
        new = {t: found[t] for t in group if t in found} if circle else {}
        for _ in range(MOST_ROUNDS):
            step: dict[str, DataFrame] = {}
            for c, col, p in circle:
                if p in new:
                    keys = new[p].select(F.col("_key").alias("_del"))
                    more = _keys(tables[c].join(keys, F.col(col) == F.col("_del"), "left_semi"), id_col)
                    step[c] = step[c].union(more) if c in step else more
            new = {}
            for c, more in step.items():
                fresh = more.distinct()
                if c in found:
                    fresh = fresh.join(found[c], "_key", "left_anti")
                fresh = fresh.checkpoint(eager=True)
                if not fresh.isEmpty():
                    new[c] = fresh
                    found[c] = found[c].union(fresh) if c in found else fresh
            if not new:
                break
        else:
            raise RuntimeError("deletes did not come to an end")
    return found


def delete_report(tables: dict[str, DataFrame], start: dict[str, DataFrame],
                  edges: Sequence[tuple[str, str, str, str]] | None = None, id_col: str = "id") -> DataFrame:
    """What a delete does: outcome, table_name, columns, value, n_rows.

    ``deleted``: rows that go, per table. ``blocked``: rows that stay and refer by a restricting key to a row that would
    go, per column and key; if there are any, the database refuses the delete. As the reference's keys are checked at the
    end of the statement, rows that go themselves block nothing. Every table is read once, with all its keys tested
    in one pass by joins with the (distinct) deleted keys; rows are counted with map-side combine.
    """
    if edges is None:
        from ..contracts import FOREIGN_KEYS
        edges = FOREIGN_KEYS
    found = deleted_keys(tables, start, edges, id_col)
    parts = []
    for t, df in tables.items():
        own = {f"_e{i}": (col, action, found[p]) for i, (c, col, p, action) in enumerate(edges)
               if c == t and p in found and col in df.columns}
        gone = [F.col(n) for n, (_, action, _) in own.items() if action == CASCADE]
        columns = {n: (col, keys) for n, (col, _, keys) in own.items()}
        if t in found and id_col in df.columns:
            columns["_self"] = (id_col, found[t])
            gone = [F.col("_self")]
        if not columns:
            continue
        rows = _flagged(df.select(*dict.fromkeys(col for col, _ in columns.values())), columns)
        lost = reduce(lambda a, b: a | b, gone, F.lit(False))
        text = lambda x: F.lit(x).cast("string")
        outcome = [F.when(lost, F.struct(text("deleted").alias("outcome"), text(None).alias("columns"), text(None).alias("value")))]
        outcome += [F.when(~lost & F.col(n), F.struct(text("blocked").alias("outcome"), text(col).alias("columns"),
                                                      F.col(col).cast("string").alias("value")))
                    for n, (col, action, _) in own.items() if action != CASCADE]
        hits = F.filter(F.array(*outcome), lambda x: x.isNotNull())
        parts.append(rows.select(F.explode(hits).alias("o")).groupBy("o.outcome", "o.columns", "o.value").agg(
            F.count(F.lit(1)).alias("n_rows")).select("outcome", F.lit(t).alias("table_name"), "columns", "value", "n_rows"))
    if not parts:
        raise ValueError("no key applies to the given tables")
    return reduce(lambda a, b: a.unionByName(b), parts)


def delete_rows(tables: dict[str, DataFrame], start: dict[str, DataFrame],
                edges: Sequence[tuple[str, str, str, str]] | None = None, id_col: str = "id") -> dict[str, DataFrame]:
    """The tables after the delete; refused (ValueError) if rows that stay refer to rows that would go."""
    if edges is None:
        from ..contracts import FOREIGN_KEYS
        edges = FOREIGN_KEYS
    blocked = delete_report(tables, start, edges, id_col).where("outcome = 'blocked'").limit(1).collect()
    if blocked:
        b = blocked[0]
        raise ValueError(f"{b.table_name}.{b.columns} = {b.value} still refers to a deleted row")
    found = deleted_keys(tables, start, edges, id_col)
    out = {}
    for t, df in tables.items():
        if t in found and id_col in df.columns:
            df = df.join(found[t], F.col(id_col) == F.col("_key"), "left_anti")
        for c, col, p, action in edges:
            if c == t and action == CASCADE and p in found and col in df.columns:
                df = df.join(found[p], F.col(col) == F.col("_key"), "left_anti")
        out[t] = df
    return out

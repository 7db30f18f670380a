"""Integrity and change operators: D4 duplicate keys, C6 snapshot diff, A11 change log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys seen more than once (rows with a NULL key part are ignored, as UNIQUE does).

    A partial+final count aggregate: a hot key is one row per map task.
    """
    keys = list(keys)
    cond = F.col(keys[0]).isNotNull()
    for k in keys[1:]:
        cond = cond & F.col(k).isNotNull()
    return (df.where(cond).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def _image(df_alias: str, cols: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"{df_alias}.{c}").alias(c) for c in cols]))


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """Full outer join on the key, NULL-safe compare -> INSERT / UPDATE / DELETE rows.

    Output: keys, ``action``, ``old_values``, ``new_values`` (JSON images, NULL
    when absent). Unchanged keys produce no row.
    """
    keys = list(keys)
    cols = [c for c in (cols or old.columns) if c not in keys]
    o = old.select(*keys, *cols, F.lit(True).alias("_o")).alias("o")
    n = new.select(*keys, *cols, F.lit(True).alias("_n")).alias("n")
    j = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    changed = F.lit(False)
    for c in cols:
        changed = changed | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    in_o, in_n = F.col("o._o").isNotNull(), F.col("n._n").isNotNull()
    action = (F.when(in_o & ~in_n, F.lit("DELETE")).when(~in_o & in_n, F.lit("INSERT"))
              .when(changed, F.lit("UPDATE")))
    all_cols = keys + cols
    return (j.select(*[F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys],
                     action.alias("action"),
                     F.when(in_o, _image("o", all_cols)).alias("old_values"),
                     F.when(in_n, _image("n", all_cols)).alias("new_values"))
            .where(F.col("action").isNotNull()))


def audit(changes: DataFrame, table_name: str, record_id: str, changed_at, changed_by=None) -> DataFrame:
    """Change-log rows in the audit table's shape, ready to append."""
    return changes.select(
        F.lit(table_name).alias("table_name"), F.col(record_id).cast("long").alias("record_id"),
        "action", "old_values", "new_values",
        F.lit(changed_by).cast("long").alias("changed_by"),
        F.lit(changed_at).cast("timestamp_ntz").alias("changed_at"))


def integrity_report(tables: dict[str, DataFrame], id_col: str = "id") -> DataFrame:
    """C1 + D4 over the record schema: every declared foreign key and unique key whose
    tables are present in ``tables``.

    Output: check ('foreign_key' / 'unique'), table_name, columns, value (text),
    n_rows. Foreign keys reference the parent's ``id``; a NULL reference passes, and a unique
    key with a NULL part too.

    Every table is read once: a row is laid out as the keys that it holds (its references, its own id, its unique keys).
    One aggregate by (what the key is of, key) then counts the references of each kind and sees whether a parent has
    that id, so a hot reference is one row per map task, and no join or second read follows. Keys are compared by
    their text: a reference needs the parent's kind of type (any two integer types do).
    """
    from functools import reduce

    from ..contracts import FOREIGN_KEYS, UNIQUE_KEYS

    labels: list[list[tuple[str, str, str]]] = []   # of a target: the checks that count its keys
    held: dict[str, list[tuple[int, int, tuple[str, ...]]]] = {}   # of a table: target, check, columns
    own = -1                                        # in place of a check: the key is a parent's id
    target_of: dict[str, int] = {}
    for child, col, parent, _ in FOREIGN_KEYS:
        if child in tables and parent in tables and col in tables[child].columns:
            if parent not in target_of:
                target_of[parent] = len(labels)
                labels.append([])
                held.setdefault(parent, []).append((target_of[parent], own, (id_col,)))
            target = target_of[parent]
            held.setdefault(child, []).append((target, len(labels[target]), (col,)))
            labels[target].append(("foreign_key", child, col))
    n_parents = len(labels)
    for table, keys in UNIQUE_KEYS.items():
        if table in tables and all(k in tables[table].columns for k in keys):
            held.setdefault(table, []).append((len(labels), 0, tuple(keys)))
            labels.append([("unique", table, ",".join(keys))])
    if not labels:
        raise ValueError("no declared key applies to the given tables")

    def laid_out(table: str) -> DataFrame:
        rows = [F.when(reduce(Column.__and__, [F.col(c).isNotNull() for c in cols]),
                       F.struct(F.lit(target).alias("target"), F.lit(check).alias("check_no"),
                                F.array(*[F.col(c).cast("string") for c in cols]).alias("key")))
                for target, check, cols in held[table]]
        return tables[table].select(F.explode(F.array(*rows)).alias("r")).where("r is not null").select("r.*")

    most = max(len(x) for x in labels)
    found = (reduce(DataFrame.unionAll, [laid_out(t) for t in held]).groupBy("target", "key")
             .agg(F.max(F.col("check_no") == own).alias("has_parent"),
                  F.array(*[F.count_if(F.col("check_no") == k) for k in range(most)]).alias("counts")))
    bad = found.where(F.when(F.col("target") < n_parents, ~F.col("has_parent")).otherwise(F.col("counts")[0] > 1))
    named = F.array(*[F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("check", "table_name", "columns"), x)])
                                for x in checks]) for checks in labels])
    return (bad.select("target", F.concat_ws(",", "key").alias("value"), F.posexplode("counts").alias("no", "n_rows"))
            .where("n_rows > 0").withColumn("of", F.get(F.get(named, F.col("target")), F.col("no")))
            .select("of.check", "of.table_name", "of.columns", "value", "n_rows"))

"""A7 contract projection, A9 valid/reject split, C2 code lookups.

``apply_contract`` is one ``select``: for every field, alias pick (B1), trim
(B2), default (B3), typed cast (B10) and the rule reasons (B6, B7, B9) -- all
Catalyst expressions, so the whole projection stays in one codegen stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import CONTRACTS, Contract, Field
from ..functions import checks as C
from ..functions.dates import date_reason, date_shape, norm_date, parse_shaped
from ..functions.text import derive_code, header_map, pick, split_list, utrim
from ..sources.csv import CsvHeaders

PASSTHROUGH = ("source_file", "source_mtime", "row_no")


def _headers(df: DataFrame):
    """(frame, header -> Column mapping, passthrough exprs, passthrough names).

    Frames from ``sources.csv.scan_csv`` carry per-file header/value arrays;
    any other frame has one column per header and is addressed by position.
    """
    if "_vals" in df.columns and "_hdr" in df.columns:
        names = [c for c in PASSTHROUGH if c in df.columns]
        return df, CsvHeaders(), [F.col(c) for c in names], names
    pos, cols = header_map(df)
    names = [c for c in PASSTHROUGH if c in df.columns]
    return pos, cols, [cols[c].alias(c) for c in names], names


CSV_ERROR = "_csv_error"


def _source_error(df: DataFrame) -> list[str]:
    """The column in which the CSV source tells why a record can't be read, if there is one."""
    return [CSV_ERROR] if CSV_ERROR in df.columns and "_vals" in df.columns else []


def _typed(f: Field, v: Column) -> tuple[Column, Column | None]:
    """(typed value, cast reason) for one trimmed text value ``v`` ('' = missing)."""
    missing = v == F.lit("")
    kind = f.kind
    if kind in ("string", "lookup"):
        # a picked default means the route passes '' on to the table (and its CHECK)
        return (v if f.pick_default else F.when(~missing, v)), None
    if kind == "int":
        t = C.to_int(v)
    elif kind.startswith("decimal"):
        p, s = kind[kind.index("(") + 1:-1].split(",")
        t = C.to_decimal(v, int(p), int(s))
    elif kind == "bool":
        t = C.to_bool(v)
    elif kind == "time":
        t = C.to_seconds(v)
    elif kind == "timestamp":
        d, _ = norm_date(v)
        t = F.coalesce(v.try_cast("timestamp_ntz"), d.cast("timestamp_ntz"))
    elif kind == "date":
        d, r = norm_date(v)
        return d, F.when(r.isNotNull(), F.concat(F.lit(r), F.lit(f"_{f.name}")))
    elif kind == "list":
        return F.when(~missing, split_list(v)), None
    else:
        raise ValueError(f"unknown field kind {kind}")
    return F.when(~missing, t), C.cast_reason(v, t, f"bad_{f.name}")


def _raw(cols, f: Field) -> Column:
    if f.pick_default:
        return utrim(pick(cols, *f.headers, default=str(f.default)))
    return utrim(pick(cols, *f.headers))


def _typed_with_default(f: Field, raw: Column) -> tuple[Column, Column | None]:
    typed, cast_rule = _typed(f, raw)
    if f.default is not None and not f.pick_default:
        # the default applies to a missing value, not to one that failed its cast
        dflt = F.lit(f.default)
        if f.kind.startswith("decimal"):
            dflt = dflt.cast(f.kind)
        typed = F.when(raw == F.lit(""), dflt).otherwise(typed)
    return typed, cast_rule


def _rules(f: Field, raw: Column, typed: Column, cast_rule: Column | None) -> list[Column]:
    rules = []
    if f.required:
        rules.append(C.required(raw, f"missing_{f.name}"))
    if cast_rule is not None:
        rules.append(cast_rule)
    if f.max_len is not None:
        rules.append(C.max_len(typed, f.max_len, f"too_long_{f.name}"))
    if f.domain is not None:
        rules.append(C.in_domain(typed, f.domain, f"bad_{f.name}"))
    return rules


def apply_contract(df: DataFrame, contract: Contract | str) -> DataFrame:
    """Raw string rows -> canonical typed rows + ``reasons`` (empty = valid).

    Three narrow selects (trimmed text, typed values, reasons). Catalyst does
    not merge a projection into the next one when that would copy a costly
    expression (regex, cast) into several places, so every value is computed
    once per row; there is still no shuffle and one codegen stage.
    """
    contract = CONTRACTS[contract] if isinstance(contract, str) else contract
    if contract.name == "departments":
        return departments_rows(df)
    pos, cols, keep_exprs, keep = _headers(df)
    error = _source_error(df)
    raw = pos.select(*keep_exprs, *error,
                     *[_raw(cols, f).alias(f"_r_{f.name}") for f in contract.fields])
    dates = [f for f in contract.fields if f.kind == "date"]
    if dates:   # stage B5: each shape regex runs once per row, then parse and reason from the shape
        raw = raw.select("*", *[date_shape(F.col(f"_r_{f.name}")).alias(f"_s_{f.name}") for f in dates])
        raw = raw.select("*", *[parse_shaped(F.col(f"_r_{f.name}"), F.col(f"_s_{f.name}")).alias(f"_d_{f.name}")
                                for f in dates])
    typed_cols, rule_inputs = [], []
    for f in contract.fields:
        if f.kind == "date":
            typed_cols.append(F.col(f"_d_{f.name}").alias(f.name))
            rule_inputs.append((f, True))
            continue
        typed, cast_rule = _typed_with_default(f, F.col(f"_r_{f.name}"))
        typed_cols.append(typed.alias(f.name))
        rule_inputs.append((f, cast_rule))
    typed = raw.select(*keep, *error, *[F.col(f"_r_{f.name}") for f in contract.fields],
                       *[F.col(f"_s_{f.name}") for f in dates], *typed_cols)
    rules = []
    for f, cast_rule in rule_inputs:
        cast_rule = None if cast_rule is None else _cast_rule_on(f)
        rules.extend(_rules(f, F.col(f"_r_{f.name}"), F.col(f.name), cast_rule))
    reasons = C.reasons(*rules)
    if error:  # a record that can't be read has no other reason
        reasons = F.when(F.col(CSV_ERROR).isNotNull(), F.array(F.col(CSV_ERROR))).otherwise(reasons)
    return typed.select(*keep, *[f.name for f in contract.fields], reasons.alias("reasons"))


def _cast_rule_on(f: Field) -> Column:
    """Cast reason from the staged columns: text given but typed value NULL."""
    raw, typed = F.col(f"_r_{f.name}"), F.col(f.name)
    if f.kind == "date":
        r = date_reason(raw, F.col(f"_s_{f.name}"), typed)
        return F.when(r.isNotNull(), F.concat(r, F.lit(f"_{f.name}")))
    given = raw.isNotNull() & (raw != F.lit(""))
    return F.when(given & typed.isNull(), F.lit(f"bad_{f.name}"))


def departments_rows(df: DataFrame) -> DataFrame:
    """Departments keep the upload route's own rule order: name required, then a
    code derived from the name when none is given (B4), then column limits."""
    pos, cols, keep, _ = _headers(df)
    code = utrim(pick(cols, "Code", "code"))
    name = utrim(pick(cols, "Name", "name", "Department"))
    final_code = F.when(code == F.lit(""), derive_code(name)).otherwise(code)
    rules = [
        *map(F.col, _source_error(df)),
        C.required(name, "missing_name"),
        F.when((name != F.lit("")) & (final_code == F.lit("")), F.lit("code_not_derivable")),
        C.max_len(final_code, 10, "too_long_code"),
        C.max_len(name, 255, "too_long_name"),
    ]
    first_rule = F.coalesce(*rules)
    return pos.select(
        *keep,
        final_code.alias("code"), name.alias("name"),
        utrim(pick(cols, "Description", "description")).alias("description"),
        utrim(pick(cols, "Head of Department Email", "hod_email")).alias("hod_email"),
        (code == F.lit("")).alias("code_derived"),
        # a rejected row reports only its first failure, like the upload route
        F.filter(F.array(first_rule), lambda r: r.isNotNull()).alias("reasons"))


def with_flag(df: DataFrame, cond: Column, name: str) -> DataFrame:
    """Add boolean ``name`` = ``cond`` as the output of a one-element generator (see ``with_valid_flag``)."""
    return df.select("*", F.explode(F.array(cond)).alias(name))


def with_valid_flag(df: DataFrame, reasons_col: str = "reasons") -> DataFrame:
    """Add ``_valid`` (no reasons) as the output of a one-element generator.

    A filter on a projected column is pushed below the projection with the
    column's expression inlined, so a filter on ``size(reasons)`` would re-run
    every rule (regexes, date parsing) inside the filter, outside the staged
    projections. A filter on a generator's output stays above the generator,
    and the rules are computed once.
    """
    return with_flag(df, F.size(F.col(reasons_col)) == 0, "_valid")


def split_valid(df: DataFrame, reasons_col: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects). Two filters on the same plan, no shuffle."""
    flagged = with_valid_flag(df, reasons_col)
    return (flagged.where(F.col("_valid")).drop("_valid", reasons_col),
            flagged.where(~F.col("_valid")).drop("_valid"))


def resolve(df: DataFrame, code_col: str, dim: DataFrame, dim_code: str, dim_id: str,
            out_col: str, reason: str) -> DataFrame:
    """Code -> id by a left join on the dimension's unique code.

    A miss on a non-empty code appends ``reason`` to ``reasons``; so does, as
    ``ambiguous_...``, a code that the dimension has with several ids, which
    gives no id. A row never fans out: the dimension is one row a code before
    the join. Codes are case-sensitive. Spark decides by bytes whether the
    dimension is broadcast.
    """
    d = (dim.where(F.col(dim_code).isNotNull()).groupBy(F.col(dim_code).alias("_code"))
         .agg(F.min(dim_id).alias(out_col), (F.min(dim_id) != F.max(dim_id)).alias("_several"))
         .withColumn(out_col, F.when(~F.coalesce("_several", F.lit(False)), F.col(out_col))))
    j = df.join(d, F.col(code_col) == F.col("_code"), "left")
    miss = F.col(code_col).isNotNull() & (F.col(code_col) != F.lit("")) & F.col(out_col).isNull()
    several = reason.replace("unknown", "ambiguous", 1) if reason.startswith("unknown") else f"ambiguous_{out_col}"
    why = F.when(F.coalesce("_several", F.lit(False)), F.lit(several)).otherwise(F.lit(reason))
    rs = F.col("reasons") if "reasons" in df.columns else F.array().cast("array<string>")
    return j.withColumn("reasons", F.when(miss, F.concat(rs, F.array(why))).otherwise(rs)).drop("_code", "_several")


def apply_lookups(df: DataFrame, contract: Contract | str, dims: dict[str, DataFrame]) -> DataFrame:
    """C2 for every lookup field of ``contract``: ``dims`` maps dimension name -> DataFrame(code, id)."""
    from ..contracts import LOOKUP_CODES

    contract = CONTRACTS[contract] if isinstance(contract, str) else contract
    out = df
    for f in contract.fields:
        if f.kind != "lookup" or f.lookup not in dims:
            continue
        code_tmp = f"_{f.name}_code"
        out = out.withColumnRenamed(f.name, code_tmp)
        out = resolve(out, code_tmp, dims[f.lookup], LOOKUP_CODES[f.lookup], "id", f.name,
                      f"unknown_{f.name}").drop(code_tmp)
    return out


def people(rows: DataFrame, role: str) -> tuple[DataFrame, DataFrame]:
    """The two tables that a students or faculty upload is about: user accounts (email, full_name, phone, role) of the
    rows with an address, and the person rows without these columns but the address, by which they find their user."""
    accounts = rows.where(F.col("email").isNotNull()).select(
        "email", F.col("name").alias("full_name"), "phone", F.lit(role).alias("role"))
    return accounts, rows.drop("name", "phone")

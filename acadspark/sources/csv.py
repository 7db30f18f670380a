"""A1-A3: header CSV uploads -> string rows with their source file and row number.

* Quoting follows RFC 4180: a field in double quotes may hold commas, line
  breaks and doubled quotes; a quote inside an unquoted field is text. Files are
  split even so. Each line maps the two states it may begin in, outside or
  inside a quoted field, to the state it ends in; most lines change nothing. The
  lines that do are composed to a map for each split, and the maps of a file's
  splits from its beginning on (a table of a row a split) tell in which state
  every split begins, and how many records begin before it. Splits without
  such lines are parsed where they are read; the lines of the others are put
  in order within their split, and lines of one record are joined, also over
  the ends of splits. ``multiline=False`` skips all this, for files known to
  have no line breaks in fields.
* Lines end with a line feed, or a carriage return and a line feed; empty lines outside quotes are no records.
* Every file carries its own header, matched case-sensitively by name, so
  files of one contract may order (or omit) columns differently. The number of
  columns read is that of the widest header and one more; nothing is cut. A
  record with values past its header's last column, and a file over
  ``max_file_bytes``, become rows with a reason in ``_csv_error``, which the
  contract rejects.
* Row numbers count records, not physical lines: label = 0-based data-record
  index + 2, the header being line 1. They come from the split table, without a
  global sort.

No regular expression runs over records: Java's recur for each character of a
repeated group, and a long field would end the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

RECORD = "_record"
#: reasons in ``_csv_error``
TOO_MANY_FIELDS, FILE_TOO_LARGE = "too_many_fields", "file_too_large"
#: columns that Spark's CSV parser makes room for
MAX_COLUMNS = 200_000


class CsvHeaders:
    """Header -> value lookup over ``_hdr`` / ``_vals`` arrays; any header name is accepted
    and an absent one reads as NULL (the pick then skips it)."""

    def __contains__(self, name: str) -> bool:
        return True

    def __getitem__(self, name: str) -> Column:
        # a header repeated in one file keeps its last column, as a key assigned
        # twice in a JS object does
        back = F.array_position(F.reverse(F.col("_hdr")), F.lit(name))
        pos = F.size(F.col("_hdr")) - back + 1
        return F.when(back > 0, F.try_element_at(F.col("_vals"), pos.cast("int")))


# states of a reader of quotes
OUT, IN, CLOSED = 0, 1, 2


def after_quote(state: str, piece: str, first: str) -> str:
    """SQL: the state after a quote, given the state before it and the text between it and the quote (or line) before.

    A quote opens a field after a comma, at the line's start, or right after a closing one, with which it makes one quote
    of the text; within a field it closes it; elsewhere it is text.
    """
    return (f"case when {state} = {IN} then {CLOSED} "
            f"when {piece} = '' and ({first} or {state} = {CLOSED}) or endswith({piece}, ',') then {IN} else {OUT} end")


def ends_inside(line: str, state: int) -> Column:
    """1 if a line that begins in ``state`` (OUT or IN) ends inside a quoted field, else 0."""
    return F.expr(f"""if(contains({line}, '"'), aggregate(
        slice(split({line}, '"'), 1, size(split({line}, '"')) - 1), named_struct('s', {state}, 'first', true),
        (a, x) -> named_struct('s', {after_quote('a.s', 'x', 'a.first')}, 'first', false), a -> if(a.s = {IN}, 1, 0)), {state})""")


def walked(record: str, start: str, step: str, end: str) -> Column:
    """An aggregate over the pieces of the text in a column between its quotes, cut once.

    ``step`` gives the further fields of the next _a, which begins as ``start`` and _a.s = OUT, from _x: ``text``, ``first``,
    ``last``. In it, {state} stands for the state behind the piece's quote, {parts} for the piece cut at commas outside of
    quotes, {quote} for whether its quote is text: the second of a pair, or one that neither opens nor closes.
    """
    state = f"if(_x.last, _a.s, {after_quote('_a.s', '_x.text', '_x.first')})"
    parts = f"if(_a.s = {IN}, array(_x.text), split(_x.text, ','))"
    quote = f"(not _x.last and (_a.s = {CLOSED} and _x.text = '' or _a.s <> {IN} and {state} = {OUT}))"
    return F.expr(f"""transform(array(split({record}, '"')), _p -> aggregate(
        transform(_p, (_t, _i) -> named_struct('text', _t, 'first', _i = 0, 'last', _i = size(_p) - 1)),
        named_struct('s', {OUT}, {start}),
        (_a, _x) -> named_struct('s', {state}, {step.format(state=state, parts=parts, quote=quote)}), _a -> {end}))[0]""")


def fields(record: str) -> Column:
    """The fields of the text in a column, without quotes; for header records."""
    return walked(record, "'done', cast(array() as array<string>), 'now', ''", """
        'done', if(size({parts}) = 1, _a.done,
                   concat(_a.done, array(concat(_a.now, ({parts})[0])), slice({parts}, 2, size({parts}) - 2))),
        'now', concat(if(size({parts}) = 1, _a.now, ''), element_at({parts}, -1), if({quote}, '"', ''))""",
                  "concat(_a.done, array(_a.now))")


def text_beyond(record: str, n: str) -> Column:
    """Whether a field of the text in a column, from number ``n`` (from 0) on, is not empty; in one walk."""
    return walked(record, "'at', 0, 'found', false", f"""
        'at', _a.at + size({{parts}}) - 1,
        'found', _a.found or {{quote}} and _a.at + size({{parts}}) - 1 >= {n} or _a.at + size({{parts}}) > {n} and
                 exists(slice({{parts}}, greatest(1, {n} - _a.at + 1), size({{parts}})), _f -> _f <> '')""", "_a.found")


FILE = ["source_file", "source_mtime", "_size"]


def read_raw(spark: SparkSession, path: str | Sequence[str], width: int, glob: str = "*.csv",
             multiline: bool = True) -> DataFrame:
    """A1/A2: all-string records of the ``glob`` files under ``path`` by Spark's CSV reader: ``_c0``.., their file columns,
    and in ``_record`` the whole text of a record that has more or fewer than ``width`` fields. ``multiline`` reads a
    file as one split."""
    schema = T.StructType([*(T.StructField(f"_c{i}", T.StringType()) for i in range(width)),
                           T.StructField(RECORD, T.StringType())])
    df = (spark.read.schema(schema).option("header", False).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", RECORD).option("columnPruning", False).option("maxColumns", MAX_COLUMNS)
          .option("quote", '"').option("escape", '"').option("multiLine", multiline)
          .option("pathGlobFilter", glob).csv(path if isinstance(path, str) else list(path)))
    return df.select("*", *_file_columns())


def _file_columns() -> list[Column]:
    return [F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_blk"),
            F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_modification_time").alias("source_mtime"),
            F.monotonically_increasing_id().alias("_mid")]


def read_lines(spark: SparkSession, path: str | Sequence[str], glob: str = "*.csv") -> DataFrame:
    """The lines of the files, split wherever Spark likes: ``line``, the file columns, ``_out`` and ``_in`` (1 if the line
    ends inside a quoted field, beginning outside / inside of one)."""
    df = (spark.read.option("lineSep", "\n").option("pathGlobFilter", glob)
          .text(path if isinstance(path, str) else list(path)).select(F.col("value").alias("line"), *_file_columns()))
    return df.select("*", ends_inside("line", OUT).alias("_out"), ends_inside("line", IN).alias("_in"),
                     F.col("line").isin("", "\r").alias("_blank"))


def split_table(raw: DataFrame) -> DataFrame:
    """One row per split: its first record's id and the number of records of its file's earlier splits.

    A scan partition holds whole splits, so a split's ids are consecutive.
    """
    blocks = raw.groupBy("source_file", "_blk").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("source_file").orderBy("_blk")
    return blocks.select("source_file", "_blk", "_first", F.coalesce(
        F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))


def with_state(df: DataFrame, order: str, by: Sequence[str], start: dict[str, Column], out: str = "_out",
               inside: str = "_in") -> DataFrame:
    """Adds, for each name in ``start``, the state in which a row begins if the first row of its group begins in that state."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    flip = F.when((F.col(out) == 1) & (F.col(inside) == 0), 1).otherwise(0)
    df = df.withColumn("_flips", F.coalesce(F.sum(flip).over(before), F.lit(0)))
    # the last row before that maps both states to one, and the flips up to it
    df = df.withColumn("_fixed", F.last(F.when(F.col(out) == F.col(inside), F.struct(F.col(out).alias("v"), F.col("_flips").alias("n"))),
                                        ignorenulls=True).over(before))
    known = F.col("_fixed").isNotNull()
    return df.withColumns({name: F.when(known, (F.col("_fixed.v") + F.col("_flips") - F.col("_fixed.n")) % 2)
                           .otherwise((s + F.col("_flips")) % 2).cast("int") for name, s in start.items()}).drop("_flips", "_fixed")


def quote_splits(lines: DataFrame) -> DataFrame:
    """E4 for quoted line breaks: a row a split: ``_first`` line id, ``_state`` in which it begins, ``_off`` (records that
    begin in the file before it) and ``_marked`` (whether a line of it changes the state, or is no record).

    Only marks, the lines that do, are ordered, within their split; the lines between two marks are counted.
    """
    split = ["source_file", "_blk"]
    sizes = lines.groupBy(*split).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    marks = lines.where((F.col("_out") != 0) | (F.col("_in") != 1) | F.col("_blank")).select(*split, "_mid", "_out", "_in", "_blank")
    marks = with_state(marks, "_mid", split, {"_s0": F.lit(0), "_s1": F.lit(1)}).withColumn(
        "_next", F.lead("_mid").over(Window.partitionBy(*split).orderBy("_mid")))
    marks = marks.join(sizes, split)
    gap = F.coalesce("_next", F.col("_first") + F.col("_n")) - F.col("_mid") - 1

    def counted(s: str) -> list[Column]:
        after = F.when(F.col(s) == 0, F.col("_out")).otherwise(F.col("_in"))
        starts = F.when((F.col(s) == 0) & ~F.col("_blank"), 1).otherwise(0) + F.when(after == 0, gap).otherwise(0)
        return [F.sum(starts).alias(f"{s}_n"), F.max_by(after, "_mid").alias(f"{s}_end")]
    maps = marks.groupBy(*split).agg(F.min("_mid").alias("_mark"), *counted("_s0"), *counted("_s1"))
    head = F.col("_mark") - F.col("_first")  # lines before the first mark
    splits = sizes.join(maps, split, "left").select(
        *split, "_first", F.col("_mark").isNotNull().alias("_marked"),
        F.coalesce("_s0_end", F.lit(0)).alias("_out"), F.coalesce("_s1_end", F.lit(1)).alias("_in"),
        F.coalesce(head + F.col("_s0_n"), "_n").alias("_n0"), F.coalesce("_s1_n", F.lit(0)).alias("_n1"))
    splits = with_state(splits, "_blk", ["source_file"], {"_state": F.lit(0)})
    before = Window.partitionBy("source_file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.when(F.col("_state") == 0, F.col("_n0")).otherwise(F.col("_n1"))
    return splits.select(*split, "_first", "_marked", "_state", F.coalesce(F.sum(begun).over(before), F.lit(0)).alias("_off"))


def quoted_records(lines: DataFrame, splits: DataFrame, mixed: bool) -> DataFrame:
    """The file columns, ``_rec`` (0-based in its file) and ``text`` of every record.

    ``mixed``: some split has marks. Their lines, and those of splits that begin inside a field, are ordered by split
    and joined by record; a record's lines are one group, however many splits they lie in.
    """
    split = ["source_file", "_blk"]
    rows = lines.join(splits, split)
    plain = rows.where(~F.col("_marked") & (F.col("_state") == 0)).select(
        *FILE, (F.col("_off") + F.col("_mid") - F.col("_first")).alias("_rec"), F.col("line").alias("text"))
    if mixed:
        some = with_state(rows.where(F.col("_marked") | (F.col("_state") == 1)), "_mid", split, {"_begins": F.col("_state")})
        begins = F.when((F.col("_begins") == 0) & ~F.col("_blank"), 1).otherwise(0)
        upto = Window.partitionBy(*split).orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
        some = (some.withColumn("_rec", F.col("_off") + F.sum(begins).over(upto) - 1)
                .where((F.col("_begins") == 1) | ~F.col("_blank")))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_blk", "_mid", "line"))), lambda x: x["line"]), "\n")
        plain = plain.unionByName(some.groupBy(*FILE, "_rec").agg(joined.alias("text")))
    cr = F.col("text").endswith("\r")
    return plain.withColumn("text", F.when(cr, F.substr("text", F.lit(1), F.length("text") - 1)).otherwise(F.col("text")))


def by_quotes(spark: SparkSession, path: str | Sequence[str], glob: str) -> tuple[DataFrame, DataFrame]:
    """(header records: the file columns and text; all records: those, ``_rec``) of files split anywhere."""
    ensure_checkpoint_dir(spark)
    lines = read_lines(spark, path, glob)
    splits = quote_splits(lines).checkpoint(eager=True)  # a row a split, read by the three scans below
    mixed = bool(splits.agg(F.max("_marked")).first()[0])
    first = splits.where("_off <= 1")  # where a file's first record begins, or goes on
    heads = quoted_records(lines, first, mixed).where("_rec = 0")
    return heads, quoted_records(lines, splits, mixed)


def scan_csv(spark: SparkSession, path: str | Sequence[str], glob: str = "*.csv", multiline: bool = True,
             max_file_bytes: int | None = None) -> DataFrame:
    """A1-A3: data records of header CSV files with ``source_file``, ``row_no``, ``source_mtime``, ``_csv_error``
    and the header/value arrays ``_hdr``/``_vals`` (read them through ``CsvHeaders``)."""
    if multiline:
        heads, records = by_quotes(spark, path, glob)
    else:
        narrow = read_raw(spark, path, 1, glob, False)
        splits = split_table(narrow)
        begins = splits.where("_off = 0").select("source_file", "_blk", F.col("_first").alias("_mid"))
        one = F.concat(F.lit('"'), F.replace("_c0", F.lit('"'), F.lit('""')), F.lit('"'))
        heads = narrow.join(begins, ["source_file", "_blk", "_mid"]).select(
            *FILE, F.coalesce(RECORD, one, F.lit("")).alias("text"))  # a record of one field has no raw text
    heads = heads.select(*FILE, fields("text").alias("_hdr"))
    # the widest header; one row
    width = heads.agg(F.max(F.size("_hdr")).alias("w")).first()["w"] or 1

    allowed = F.lit(True) if max_file_bytes is None else F.col("_size") <= max_file_bytes
    names = [f"_c{i}" for i in range(width + 1)]  # one more shows that a record is too long
    if multiline:
        schema = ", ".join(f"{c} string" for c in [*names, RECORD])
        options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RECORD, "multiLine": "true",
                   "lineSep": "\n", "maxColumns": str(MAX_COLUMNS)}
        rows = records.where(allowed & (F.col("_rec") > 0)).select(*FILE, "_rec", F.from_csv("text", F.lit(schema), options).alias("_r"))
        rows = rows.select(*FILE, "_rec", "_r.*")
    else:
        raw = read_raw(spark, path, width + 1, glob, False).where(allowed)
        rows = raw.join(splits, ["source_file", "_blk"]).withColumn(
            "_rec", F.col("_mid") - F.col("_first") + F.col("_off")).where("_rec > 0")
    rows = rows.join(heads.select("source_file", "_hdr"), "source_file")
    # more fields than were read: only empty ones are let pass
    beyond = (F.size(F.split(RECORD, ",")) > width + 1) & text_beyond(RECORD, "size(_hdr)")
    vals = F.array(*names[:width])
    past = F.exists(F.filter(F.array(*names), lambda x, i: i >= F.size("_hdr")), lambda x: x.isNotNull() & (x != ""))
    out = rows.select("source_file", "source_mtime", (F.col("_rec") + 1).alias("row_no"), "_hdr", vals.alias("_vals"),
                      F.when(past | F.coalesce(beyond, F.lit(False)), F.lit(TOO_MANY_FIELDS)).alias("_csv_error"))
    if max_file_bytes is None:
        return out
    refused = heads.where(~allowed).select(
        "source_file", "source_mtime", F.lit(1).cast("long").alias("row_no"), "_hdr",
        F.array().cast("array<string>").alias("_vals"), F.lit(FILE_TOO_LARGE).alias("_csv_error"))
    return out.unionByName(refused)


def literal_path(path: str) -> str:
    """A file's path that no character of is taken as a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)

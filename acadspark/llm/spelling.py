"""Groups of spelling variants by reduced alphabets and one-edit neighbourhoods (operator 13).

Words are maximal runs of letters (A-Z, a-z and U+00C0 to U+00FF, A-Z in lower
case) of at least ``shortest`` code points that occur at least ``least`` times
in the corpus. Two words are near if they differ by one inserted, deleted or
replaced code point. A word's form is its near word that occurs most often, if
that is at least ``times`` as often as the word itself, and its root the last
of the forms that follow one another.

* Reduced alphabet. Letters are hashed to ``SYMBOLS`` symbols. Words of one
  reduced word are a class. If two words are near, their reduced words are equal
  or one edit apart.
* Neighbourhoods. Every class generates its reduced word with each symbol left
  out and each symbol replaced, as 64-bit hashes, and meets the classes of
  these hashes by an equi join. Of two reduced words that are one edit apart, one
  reaches the other by leaving a symbol out (the longer) or replacing one by a
  larger symbol, so insertions and the other replacements of the full
  neighbourhood would find the same pairs again and are not sent. Hashes that
  collide add candidates and lose none.
* Verification. The words of two classes that met are compared as they stand, by
  their edit distance with a bound of 1. A pair of classes with more than
  ``PAIRS`` pairs of words is not expanded: its words are taken by the words that
  leave one letter out, of the whole alphabet, which meet likewise. A word with a
  letter left out is shared by no more words than its length times the alphabet,
  so this holds for any vocabulary and loses nothing.
* Forms are followed by pointer jumping: each step doubles the length of the
  chain, and a chain grows by a factor of ``times`` in each link, so five steps
  do for any 64-bit counts.

The corpus is read once, counted inside each slice of texts and by Spark's
partial sums before a word is shuffled, so a frequent word is a row a task.

A planted slip: where 31 divides the CRC-32 of "<doc_id>:<run>", the run loses
its code point number crc % length (``slips``, for the registered query).

Defined cases: null and empty texts have no words; a null doc_id is written
"null" in the slip's hash; repeated rows count as often as they occur; words of
any length are words; a word without near words has n_near 0, no form, and is
its own root; ties between forms go to the smaller word in code-point order;
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, mix, save, slices, utf8

SHORTEST, LEAST, TIMES = 7, 2, 10
SYMBOLS = 6
#: pairs of words that a pair of classes may be expanded to
PAIRS = 4096
SLIP = 31
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(int(BASE), -1, 2 ** 64))

#: the first byte of U+00C0 to U+00FF in UTF-8
LEAD = 0xC3
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def crc_table() -> np.ndarray:
    """CRC-32 of each byte, by its polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


def crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges, each carried on from the CRC-32 ``begun``."""
    table = crc_table()
    length = end - start
    order = np.argsort(-length, kind="stable")
    s, n = start[order], length[order]
    state = ~begun[order].astype(np.uint32)
    long = int(np.searchsorted(-n, -256, side="left"))  # longer ones one by one
    for i in range(long):
        own = zlib.crc32(data[s[i]:s[i] + n[i]].tobytes(), int(~state[i] & np.uint32(0xFFFFFFFF)))
        state[i] = ~np.uint32(own)
    for at in range(int(n[long]) if long < len(n) else 0):
        live = slice(long, int(np.searchsorted(-n, -at, side="left")))  # those of more than `at` bytes
        state[live] = table[(state[live] ^ data[s[live] + at]) & np.uint32(255)] ^ (state[live] >> np.uint32(8))
    out = np.empty(len(n), np.uint32)
    out[order] = ~state
    return out


def ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """Byte ranges as strings."""
    n = end - start
    offs = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=offs[1:])
    body = data[np.arange(offs[-1]) + np.repeat(start - offs[:-1], n)]
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(body))


def runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and code points of the maximal runs of letters; no run crosses a document's end."""
    n = len(data)
    lead = data == LEAD
    inside = LETTER[data] | lead
    inside[1:] |= lead[:-1]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1] | cut[1:n]
        ends[:-1] &= ~inside[1:] | cut[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    return s, e, e - s - (leads[e] - leads[s])


def counted(docs: DataFrame, shortest: int, slips: bool) -> DataFrame:
    """word, n: the long words of every text, counted by slice."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            data, offs = utf8(b.column(1))
            data = LOWER[data]
            s, e, points = runs(data, offs)
            long = points >= shortest
            s, e, points = s[long], e[long], points[long]
            changed = []
            if slips and len(s):
                doc = np.searchsorted(offs, s, side="right") - 1
                begun = np.array([zlib.crc32(f"{x}:".encode()) for x in b.column(0).to_pylist()], np.uint32)
                h = crcs(data, s, e, begun[doc])
                slip = h % SLIP == 0
                for i in np.flatnonzero(slip & (points > shortest)):
                    w = data[s[i]:e[i]].tobytes().decode()
                    at = int(h[i]) % len(w)
                    changed.append(w[:at] + w[at + 1:])
                s, e = s[~slip], e[~slip]
            every = pa.concat_arrays([ranges(data, s, e), pa.array(changed, pa.string())])
            found = pc.value_counts(every)
            yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "n"])

    some = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return some.mapInArrow(rows, "word string, n long")


def symbols_of(alphabet: int | None) -> np.ndarray:
    """The symbol (from 1) of each code point below 256; None: its own."""
    if alphabet is None:
        return np.arange(1, 257, dtype=U64)
    return mix(np.arange(7, 263, dtype=U64) * U64(0xA24BAED4963EE407)) % U64(alphabet) + U64(1)


def by_length(words: pa.Array, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and code points (a matrix) of words of one length, about ``most`` code points at a time."""
    data, offs = utf8(words)
    lead = np.concatenate([[False], data[:-1] == LEAD])
    point = np.where(lead, data + np.uint8(0x40), data)
    kept = data != LEAD
    at = np.concatenate([[0], np.cumsum(kept)])[offs]
    point = point[kept]
    n = np.diff(at)
    order = np.argsort(n, kind="stable")
    i = 0
    while i < len(order):
        size = n[order[i]]
        j = min(int(np.searchsorted(n[order], size, side="right")), i + max(1, most // max(int(size), 1)))
        some = order[i:j]
        yield some, point[at[some][:, None] + np.arange(size)]
        i = j


def hashes(x: np.ndarray, edits: int) -> np.ndarray:
    """Hashes of rows of symbols; and, with ``edits`` symbols, of what one edit makes of each, in further columns.

    edits 0: the words only; 1: with each symbol left out; more: with each symbol replaced by the larger ones too.
    """
    rows, size = x.shape
    power = np.cumprod(np.concatenate([[U64(1)], np.full(size, BASE)]).astype(U64))
    terms = x * power[:size]
    before = np.concatenate([np.zeros((rows, 1), U64), np.cumsum(terms, axis=1, dtype=U64)], axis=1)
    whole = before[:, -1:]
    out = [mix(whole)]
    if edits:
        out.append(mix(before[:, :-1] + (whole - before[:, 1:]) * INVERSE))
    for step in range(1, edits):
        # a symbol that has no larger one at this distance is left as it is: the word itself once more
        out.append(mix(whole + np.where(x + U64(step) <= U64(edits), U64(step), U64(0)) * power[:size]))
    return np.concatenate(out, axis=1)


def hashed(frame: DataFrame, columns: list[str], alphabet: int | None, edits: bool, name: str) -> DataFrame:
    """The columns and, as ``name``, the reduced hash of ``word``; with edits, a row for each hash of its neighbourhood."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = symbols_of(alphabet)
        for b in batches:
            place = b.schema.get_field_index("word")
            for some, points in by_length(b.column(place)):
                found = hashes(symbol[points], (alphabet or 1) if edits else 0)
                if edits:
                    found.sort(axis=1)
                    new = np.ones(found.shape, bool)
                    new[:, 1:] = found[:, 1:] != found[:, :-1]
                    line, _ = np.nonzero(new)
                    found = found[new]
                else:
                    line, found = np.arange(len(some)), found[:, 0]
                own = b.take(pa.array(some[line])).select(columns)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(found.view(np.int64))], [*columns, name])

    kinds = dict(frame.dtypes)
    return frame.mapInArrow(rows, ", ".join(f"{c} {kinds[c]}" for c in columns) + f", {name} long")


def near(vocabulary: DataFrame, most: int = PAIRS) -> DataFrame:
    """a, na, b, nb: every pair of near words of a saved table (word, n), once."""
    words = save(hashed(vocabulary, ["word", "n"], SYMBOLS, False, "class"), "spelling-reduced")
    classes = save(words.groupBy("class").agg(F.count("*").alias("size"), F.min("word").alias("word")), "spelling-classes")
    around = hashed(classes, ["class"], SYMBOLS, True, "key")
    met = (around.join(classes.select(F.col("class").alias("key")), "key")  # only classes that exist
           .select(F.col("class").alias("x"), F.col("key").alias("y")).distinct())
    sizes = classes.select("class", "size")
    met = save(met.join(sizes.select(F.col("class").alias("x"), F.col("size").alias("nx")), "x")
               .join(sizes.select(F.col("class").alias("y"), F.col("size").alias("ny")), "y"), "spelling-classes-met")
    one_edit = F.levenshtein("a", "b", 1) == 1

    left = words.select(F.col("class").alias("x"), F.col("word").alias("a"), F.col("n").alias("na"))
    right = words.select(F.col("class").alias("y"), F.col("word").alias("b"), F.col("n").alias("nb"))
    few = met.where((F.col("x") != F.col("y")) & (F.col("nx") * F.col("ny") <= most)
                    | (F.col("x") == F.col("y")) & (F.col("nx") > 1) & (F.col("nx") * F.col("ny") <= most))
    links = (few.select("x", "y").join(left, "x").join(right, "y")
             .where(((F.col("x") != F.col("y")) | (F.col("a") < F.col("b"))) & one_edit).select("a", "na", "b", "nb"))

    many = met.where(F.col("nx") * F.col("ny") > most)
    crowded = many.select(F.col("x").alias("class")).unionAll(many.select(F.col("y").alias("class"))).distinct()
    left_out = save(hashed(words.join(crowded, "class", "left_semi"), ["word", "n"], None, True, "key"), "spelling-left-out")
    u = left_out.select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    v = left_out.select("key", F.col("word").alias("b"), F.col("n").alias("nb"))
    more = u.join(v, "key").where((F.col("a") < F.col("b")) & one_edit).select("a", "na", "b", "nb")
    ordered = links.select(F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"),
                           F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"))
    # both ways may find a pair, and colliding hashes may too
    return save(ordered.unionAll(more).distinct(), "spelling-near")


def followed(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow each word of (word, form)."""
    now = save(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(7):
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = save(now.join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")
    raise RuntimeError("forms did not end")


def variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, times: int = TIMES, slips: bool = False,
             most: int = PAIRS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus.

    ``most``: pairs of words to which a pair of classes is expanded at most; others take the way by left-out letters.
    """
    words = counted(docs, shortest, slips).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = save(words, "spelling-words")
    links = near(words, most)
    sides = links.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("other_n")).unionAll(
        links.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("other_n")))
    # at most as many rows a word as it has places and the alphabet letters
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"),
                                     F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("top"))
    high = -F.col("top.m") >= F.lit(times) * F.col("n")
    known = save(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(high, F.col("top.other")).alias("form"), F.when(high, -F.col("top.m")).alias("form_n")), "spelling-forms")
    roots = followed(known.where("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = r"""
with recursive crc(t) as (select list(y order by i) from (
  select i, list_reduce(list_prepend(i, generate_series(1, 8)), lambda c, j: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as y
  from generate_series(0, 255) s(i))),
run as (select doc_id, unnest(regexp_extract_all(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[A-Za-z\x{C0}-\x{FF}]+')) as w from documents),
own as (select doc_id, w, count(*) as n from run where length(w) >= 7 group by 1, 2),
bytes as (select doc_id, w, n, list_concat(
            list_transform(string_split(coalesce(cast(doc_id as varchar), 'null') || ':', ''), lambda c: cast(unicode(c) as bigint)),
            flatten(list_transform(string_split(w, ''), lambda c:
              case when unicode(c) < 128 then [cast(unicode(c) as bigint)] else [195, cast(unicode(c) as bigint) - 64] end))) as b
          from own),
hash as (select w, n, xor(list_reduce(list_prepend(4294967295, b),
           lambda c, x: xor(c // 256, t[(xor(c, x) % 256) + 1])), 4294967295) as h from bytes, crc),
slipped as (select case when h % 31 = 0 then substr(w, 1, cast(h % length(w) as int)) || substr(w, cast(h % length(w) as int) + 2)
                   else w end as word, n from hash),
v as (select word, cast(sum(n) as bigint) as n from slipped where length(word) >= 7 group by word having sum(n) >= 2),
cut as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as x
        from (select word, n, unnest(generate_series(1, length(word))) as i from v)),
pair as (
  select distinct c.word as a, v.word as b from cut c join v on v.word = c.x
  union select a.word, b.word from cut a join cut b on a.i = b.i and a.x = b.x and a.word <> b.word),
near as (select a, b from pair union select b, a from pair),
best as (select a as word, count(*) as n_near, arg_min(b, (-n, b)) as top, max(n) as top_n
         from near join v on v.word = b group by a),
form as (select v.word, n, coalesce(n_near, 0) as n_near, case when top_n >= 10 * n then top end as form,
           case when top_n >= 10 * n then top_n end as form_n from v left join best using (word)),
chain(word, tail, d) as (select word, word, 0 from form
                       union all select chain.word, form.form, d + 1 from chain join form on form.word = tail
                       where form.form is not null),
root as (select word, arg_max(tail, d) as root from chain group by word)
select word, form, root, n, cast(n_near as bigint) as n_near, cast(form_n as bigint) as form_n from form join root using (word)"""

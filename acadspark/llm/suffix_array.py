"""Exact substring deduplication over bytes, with suffix arrays (operator 9).

Every byte that is covered by a string of ``length`` bytes that also starts
anywhere else is removed, all its occurrences alike. Strings are judged on the
input and never cross documents.

The corpus has no suffix array of its own; equal strings are first brought
together, then sorted in blocks.

1. Segments. A string's minimizer is the smallest hash of the ``gram``-byte
   strings that begin in its first ``length / 2`` bytes. Strings at
   consecutive starts with the same minimizer are a segment, about a quarter
   of ``length`` starts long. The bytes from the minimizer on that all
   strings of a segment hold are its key: two equal strings always lie in
   segments of one key, at the same distance from its minimizer.
2. Segments meet by key. A key that occurs once ends here. Segments that are
   equal as a whole are repeated as a whole; they are told by hashes, inside a
   slice of documents before anything is shuffled. A key with different
   segments sends one of each to the next step.
3. Suffix arrays. The different segments of a key are cut to what two of them
   can share, equal ones are collapsed, and the rest are concatenated, with
   separators, in blocks of whole keys. ``suffix_array`` sorts a block by the
   linear grouping construction: suffixes are grouped by their first symbol;
   from the highest group down, the previous smaller suffix of every member
   is found by following pointers, and suffixes that as many members point to
   move on into a group of their own behind the one they were in, which leaves
   the suffixes grouped by their longest Lyndon prefix; then one pass upward
   emits every group's suffixes in order along the same pointers. No symbol
   is renamed and nothing recurs. Neighbours with a common prefix of
   ``length`` bytes mark the strings that are repeated.
4. A key of more than ``KEY_ROWS`` rows (the ends of a passage that very many
   documents hold) is no block: its segments are taken apart into their
   strings, which meet by two 64-bit hashes, one row a string and slice of
   documents. So no block holds more than ``KEY_ROWS`` segments of a key.

So Python's work a byte (the sort) is for the few segments at the ends of
repeated passages; the inside of a passage is settled by equal segments, and
everything else by keys that nothing shares.

Defined cases: null text is empty; documents are (doc_id, text) pairs, so
repeated rows are one document and come back as often as they came, all alike
(their bytes are repeated only if they are so elsewhere); a null id is an id;
texts shorter than ``length`` lose nothing; an empty table gives no rows;
``digest`` ignores further columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTE_VALUE, U64, Rolling, hashed, id_of, mix, save, slices, utf8
from .substring import groups, keyed, number, places, version

LENGTH = 200
GRAM = 16
BLOCK = 1 << 16
#: a key of more rows is not sorted in one block: its strings meet one by one
KEY_ROWS = 1000
REPEATED, SENT, SPLIT = 1, 2, 4  # bits of a segment's status
STATUS_BITS = 3


# --- the sort --------------------------------------------------------------

def suffix_array(text: list[int]) -> list[int]:
    """The suffixes of ``text`` in order; its last symbol must be unique and the smallest."""
    n = len(text)
    if n < 2:
        return list(range(n))
    order = sorted(range(n), key=text.__getitem__)
    # group[i]: where the group of suffix i begins in `order`; last[g]: where the group at g ends
    group, place, last = [0] * n, [0] * n, [0] * (n + 1)
    at = 0
    for k in range(n):
        i = order[k]
        if text[i] != text[order[at]]:
            last[at], at = k, k
        group[i], place[i] = at, k
    last[at] = n
    previous = [-1] * n
    end = n
    while end:
        begin = group[order[end - 1]]
        members = order[begin:end]
        if end - begin > 1:
            members.sort()
        pointers: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= begin:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                pointers[p] = pointers.get(p, 0) + 1
        end = begin
        if not pointers:
            continue
        if len(pointers) == 1:
            moves = [list(pointers)]
        else:
            by_count: dict[int, list[int]] = {}
            for p, c in pointers.items():
                by_count.setdefault(c, []).append(p)
            moves = [by_count[c] for c in sorted(by_count, reverse=True)]
        for some in moves:
            old: dict[int, int] = {}  # old group -> where the new one begins so far
            for p in some:  # to the back of its group
                g = group[p]
                to = old.get(g, last[g]) - 1
                old[g] = to
                q, k = order[to], place[p]
                order[k], order[to] = q, p
                place[q], place[p] = k, to
            for g, to in old.items():
                if to > g:
                    for k in range(to, last[g]):
                        group[order[k]] = to
                    last[to], last[g] = last[g], to
    # upward: the smallest suffix not yet placed of a group is the one whose chain is met first
    out, placed, free = [0] * n, bytearray(n), list(range(n))
    out[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return out


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """The common prefix of each suffix in order with the one before it."""
    n = len(text)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    out, h = [0] * n, 0
    for i in range(n):
        if not rank[i]:
            h = 0
            continue
        j = order[rank[i] - 1]
        while text[i + h] == text[j + h]:
            h += 1
        out[rank[i]] = h
        h = max(0, h - 1)
    return out


def repeated_starts(texts: list[bytes], length: int) -> list[list[int]]:
    """Per text, the starts of the strings of ``length`` bytes that start anywhere else in the texts as well."""
    m = len(texts)
    joined: list[int] = []
    owner: list[int] = []
    begin = []
    for k, t in enumerate(texts):  # the separators are unique, below every byte, and the last is the smallest
        begin.append(len(joined))
        joined.extend(b + m for b in t)
        joined.append(m - 1 - k)
        owner.extend([k] * (len(t) + 1))
    order = suffix_array(joined)
    found: list[set[int]] = [set() for _ in texts]
    for k, h in enumerate(common_prefixes(joined, order)):
        if h >= length:
            for i in (order[k - 1], order[k]):
                found[owner[i]].add(i - begin[owner[i]])
    return [sorted(s) for s in found]


def shared_parts(texts: list[bytes], middle: list[int]) -> list[tuple[int, int]]:
    """Per text the range around its ``middle`` that some other text with the same bytes there may share."""
    def reach(parts: list[bytes]) -> list[int]:
        best = [0] * len(parts)
        ranked = sorted(range(len(parts)), key=parts.__getitem__)
        for a, b in zip(ranked, ranked[1:]):
            x, y = parts[a], parts[b]
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                lo, hi = 0, n - 1  # bisection: x[:lo] == y[:lo]
                while lo < hi:
                    mid = (lo + hi + 1) // 2
                    if x[:mid] == y[:mid]:
                        lo = mid
                    else:
                        hi = mid - 1
                n = lo
            best[a], best[b] = max(best[a], n), max(best[b], n)
        return best

    right = reach([t[m:] for t, m in zip(texts, middle)])
    left = reach([t[:m][::-1] for t, m in zip(texts, middle)])
    return [(m - a, m + b) for m, a, b in zip(middle, left, right)]


def repeated_in_group(texts: list[bytes], middle: list[int], length: int) -> tuple[list[tuple[int, int]], list[int], list[bytes]]:
    """(parts, number of the different part of each text or -1, different parts): what is left of a key to be sorted."""
    parts = shared_parts(texts, middle)
    numbers: dict[bytes, int] = {}
    of = [numbers.setdefault(t[a:b], len(numbers)) if b - a >= length else -1 for t, (a, b) in zip(texts, parts)]
    return parts, of, list(numbers)


# --- segments --------------------------------------------------------------

class Segments:
    """Segments of a slice of documents: first start, how many starts, minimizer, hashes of key and whole."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, length: int):
        half = length // 2
        gram = min(GRAM, length - half + 1)
        n = len(data)
        starts = n - length + 1
        self.doc = self.start = self.count = self.middle = np.zeros(0, np.int64)
        self.key = self.whole = np.zeros(0, U64)
        if starts < 1:
            return
        rolling = Rolling(BYTE_VALUE[data])
        p = np.arange(n - gram + 1)
        low = (rolling(p, p + gram) & U64(0xFFFFFFFF00000000)) | p.astype(U64)
        width = 1
        while 2 * width <= half:  # minima over `width` places
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < half:
            low = np.minimum(low[:len(low) - (half - width)], low[half - width:])
        middle = (low[:starts] & U64(0xFFFFFFFF)).astype(np.int64)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:starts]
        fits = np.arange(starts) + length <= offs[doc + 1]
        new = fits.copy()
        new[1:] &= (middle[1:] != middle[:-1]) | ~fits[:-1]
        self.start = np.flatnonzero(new)
        run = np.cumsum(new)[fits] - 1
        self.count = np.bincount(run, minlength=len(self.start))
        self.middle, self.doc = middle[self.start], doc[self.start]
        self.key = rolling(self.middle, self.middle + length - half + 1)
        end = self.start + self.count - 1 + length
        self.whole = mix(hashed(data, self.start, end) ^ (self.middle - self.start).astype(U64))
        self.end = end


def segments(docs: DataFrame, length: int) -> DataFrame:
    """_id, at, key, whole, n: the segments of every document.

    n holds the number of starts, doubled, and one more if the slice holds the segment twice. Only the first of those
    keeps its key; the others get a key of their own and count below zero: they are repeated.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, offs = utf8(b.column(2))
            s = Segments(data, offs, length)
            ids = b.column(0).to_numpy()[s.doc]
            at = places(b.column(1).to_numpy()[s.doc], s.start - offs[s.doc])
            first, _ = groups(s.key, s.whole)
            other = (first != np.arange(len(first))) & ((ids != ids[first]) | (at != at[first]))
            twice = np.zeros(len(first), bool)
            twice[first[other]] = True
            key = np.where(other, mix(ids.view(U64) ^ mix(at.view(U64))), s.key)
            n = np.where(other, -s.count, 2 * s.count + twice)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(at), pa.array(key.view(np.int64)), pa.array(s.whole.view(np.int64)),
                 pa.array(n.astype(np.int32))], ["_id", "at", "key", "whole", "n"])

    return docs.select("_id", "_version", "text").mapInArrow(rows, "_id long, at long, key long, whole long, n int")


def judged(docs: DataFrame, length: int) -> DataFrame:
    """_id, _version, marks: of each document with segments that meet others, start << 32 | starts << 3 | status."""
    by_key = Window.partitionBy("key").orderBy("whole", "_id", "at")
    every = Window.partitionBy("key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct("whole", "_id", "at")
    before, after = F.lag(me).over(by_key), F.lead(me).over(by_key)

    def equal(x):
        """Another occurrence (a repeated row is the same one) of the same segment."""
        return F.coalesce((x["whole"] == F.col("whole")) & ~((x["_id"] == F.col("_id")) & (x["at"] == F.col("at"))),
                          F.lit(False))

    seen = segments(docs, length).withColumns(
        {"before": before, "after": after, "low": F.min("whole").over(every), "high": F.max("whole").over(every),
         "rows": F.count(F.lit(1)).over(every)})
    several = F.col("low") != F.col("high")
    begins = F.col("before").isNull() | (F.col("before.whole") != F.col("whole"))
    whole = (F.col("n") < 0) | (F.col("n") % 2 == 1) | equal(F.col("before")) | equal(F.col("after"))
    sent = F.when(F.col("rows") > KEY_ROWS, SENT + SPLIT).otherwise(SENT)
    status = F.when(whole, REPEATED).otherwise(0) + F.when(several & begins, sent).otherwise(0)
    starts = F.when(F.col("n") < 0, -F.col("n")).otherwise(F.shiftright("n", 1))
    mark = (F.shiftleft(number().cast("long"), 32).bitwiseOR(F.shiftleft(starts.cast("long"), STATUS_BITS))
            .bitwiseOR(F.col("status").cast("long")))
    found = seen.withColumn("status", status).where("status > 0")
    return save(found.groupBy("_id", version()).agg(F.collect_set(mark).alias("marks")), "suffix-marks")


def strings_of(s: Segments, of: np.ndarray, data: np.ndarray, offs: np.ndarray, ids: np.ndarray, versions: np.ndarray,
               length: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The strings of the segments ``of``, told by two hashes (key, part), with middle = -1.

    Strings that the slice holds in several places are repeated: they come as runs, with a key of their own and
    middle = -1 - their number, and one of each comes as a string that others can meet. So a string has a row a slice,
    whatever the number of its occurrences.
    """
    n = s.count[of]
    start = np.repeat(s.start[of] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    doc = np.repeat(s.doc[of], n)
    one, two = (hashed(data, start, start + length, seed) for seed in (1, 2))
    at, _id = places(versions[doc], start - offs[doc]), ids[doc]
    own, _ = groups(_id, at)
    once = own == np.arange(len(own))  # a repeated row's string is the same one
    start, one, two, at, _id = start[once], one[once], two[once], at[once], _id[once]
    first, count = groups(one, two)
    lone = first == np.arange(len(first))
    yield pa.RecordBatch.from_arrays(
        [pa.array(_id[lone]), pa.array(at[lone]), pa.array(one[lone].view(np.int64)),
         pa.array(np.full(lone.sum(), -1, np.int32)),
         pa.array([x.tobytes() for x in two[lone]], pa.binary())], names)
    some = np.flatnonzero(count > 1)
    some = some[np.argsort(start[some])]
    if len(some):
        begins = np.flatnonzero(np.r_[True, (np.diff(at[some]) != 1) | (_id[some][1:] != _id[some][:-1])])
        runs = np.diff(np.r_[begins, len(some)])
        i = some[begins]
        yield pa.RecordBatch.from_arrays(
            [pa.array(_id[i]), pa.array(at[i]), pa.array(mix(_id[i].view(U64) ^ mix(at[i].view(U64))).view(np.int64)),
             pa.array((-1 - runs).astype(np.int32)), pa.nulls(len(i), pa.binary())], names)


def met(rows: pa.RecordBatch) -> pa.RecordBatch:
    """_id, at, n of the strings that occur in several places, and of the runs that are known to; by key and part."""
    middle = rows.column(3).to_numpy()
    key = rows.column(2).to_numpy()
    _id, at = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    two = np.frombuffer(b"".join(x or bytes(8) for x in rows.column(4).to_pylist()), np.int64)
    run = middle < -1
    kind = run.astype(np.int64)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (two[1:] != two[:-1]) | (kind[1:] != kind[:-1])
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(key)] - 1
    # places are in order inside a group
    several = (_id[begin] != _id[end]) | (at[begin] != at[end])
    keep = run | np.repeat(several, end - begin + 1) if len(key) else run
    return pa.RecordBatch.from_arrays(
        [pa.array(_id[keep]), pa.array(at[keep]), pa.array(np.where(run, -1 - middle, 1)[keep].astype(np.int32))],
        ["_id", "at", "n"])


def sorted_segments(docs: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """_id, at, n: runs of n repeated starts, found by sorting the segments that share a key but differ."""
    sent = marks.withColumn("marks", F.filter("marks", lambda x: x.bitwiseAND(F.lit(SENT)) != 0)).where("size(marks) > 0")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, offs = utf8(b.column(2))
            s = Segments(data, offs, length)
            n = pc.list_value_length(b.column(3)).to_numpy()
            marked = b.column(3).flatten().to_numpy()
            want = (marked >> 32) + np.repeat(offs[:-1], n)
            # a repeated row's marks come once for each of its rows, all alike
            order = np.argsort(want, kind="stable")
            k = np.searchsorted(s.start, want[order])
            split = (marked[order] & SPLIT) != 0
            raw = data.tobytes()
            k, many = k[~split], k[split]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(s.doc[k])),
                 pa.array(places(b.column(1).to_numpy()[s.doc[k]], s.start[k] - offs[s.doc[k]])),
                 pa.array(s.key[k].view(np.int64)), pa.array((s.middle[k] - s.start[k]).astype(np.int32)),
                 pa.array([raw[x:y] for x, y in zip(s.start[k].tolist(), s.end[k].tolist())], pa.binary())], names)
            if len(many):
                yield from strings_of(s, many, data, offs, b.column(0).to_numpy(), b.column(1).to_numpy(), length, names)

    names = ["_id", "at", "key", "middle", "part"]
    parts = (docs.join(sent, ["_id", "_version"]).select("_id", "_version", "text", "marks")
             .mapInArrow(texts, "_id long, at long, key long, middle int, part binary"))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list = []  # (rows, parts, number of each row's different part, place of the first in `strings`)
        strings: list[bytes] = []
        size = 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, strings, size
            found = repeated_starts(strings, length) if strings else []
            out: list[tuple[int, int, int]] = []
            for rows, cuts, of, base in block:
                many = np.bincount([k for k in of if k >= 0], minlength=1)
                for (_, i, at, middle, part), (a, b), k in zip(rows, cuts, of):
                    if k < 0:
                        continue
                    starts = list(range(b - a - length + 1)) if many[k] > 1 else found[base + k] if base >= 0 else []
                    for x, y in zip(*_runs(starts)):
                        out.append((i, at + a + x, y - x))
            block, strings, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in
                                               enumerate((pa.int64(), pa.int64(), pa.int32()))], ["_id", "at", "n"])

        def group() -> None:
            """The rows of a key are complete."""
            nonlocal size
            # a repeated row's segment is the same one
            rows = list({r[1:3]: r for r in held}.values())
            held.clear()
            if len(rows) < 2:
                return
            cuts, of, different = repeated_in_group([r[4] for r in rows], [r[3] for r in rows], length)
            alone = len(different) < 2  # nothing to sort: several rows have it, or it is repeated nowhere
            block.append((rows, cuts, of, -1 if alone else len(strings)))
            if not alone:
                strings.extend(different)
                size += sum(map(len, different))

        kept: pa.RecordBatch | None = None  # strings of the last key, which may go on
        for b in batches:
            of_split = pc.less(b.column(3), 0)
            strange = b.filter(of_split)
            b = b.filter(pc.invert(of_split))
            if strange.num_rows:
                if kept is not None:
                    strange = pa.concat_batches([kept, strange])
                keys = strange.column(2).to_numpy()
                whole = int(np.searchsorted(keys, keys[-1]))
                kept = strange.slice(whole)
                if whole:
                    yield met(strange.slice(0, whole))
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "_id", "at", "middle", "part"))):
                if held and held[0][0] != row[0]:
                    group()
                    if size >= BLOCK or len(block) > 5000:
                        yield flush()
                held.append(row)
        if kept is not None:
            yield met(kept)
        if held:
            group()
        if block:
            yield flush()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartition(n, "key").sortWithinPartitions("key", "part", "_id", "at")
    return dealt.select(*names).mapInArrow(sort, "_id long, at long, n int")


def _runs(starts: list[int]) -> tuple[list[int], list[int]]:
    """Sorted numbers as runs: where each begins, and one past its end."""
    if not starts:
        return [], []
    a = np.array(starts)
    cut = np.flatnonzero(np.diff(a) != 1)
    return a[np.r_[0, cut + 1]].tolist(), (a[np.r_[cut, len(a) - 1]] + 1).tolist()


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """_id, _version, starts: start << 32 | how many starts on end, of the repeated strings of each document."""
    marks = judged(docs, length)
    some = sorted_segments(docs, marks, length).groupBy("_id", version()).agg(
        F.collect_list(F.shiftleft(number().cast("long"), 32).bitwiseOR(F.col("n").cast("long"))).alias("more"))
    plain = F.transform(F.filter("marks", lambda x: x.bitwiseAND(F.lit(REPEATED)) != 0),
                        lambda x: F.shiftleft(F.shiftright(x, 32), 32).bitwiseOR(
                            F.shiftright(x.bitwiseAND(F.lit(0xFFFFFFFF)), STATUS_BITS)))
    both = marks.select("_id", "_version", plain.alias("plain")).join(some, ["_id", "_version"], "left")
    return save(both.select("_id", "_version", F.concat("plain", F.coalesce("more", F.array().cast("array<bigint>")))
                            .alias("starts")), "suffix-repeated")


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    own = keyed(docs.select("doc_id", F.col("text").cast("string")))
    found = repeated(own, length)
    marked = own.join(found, ["_id", "_version"], "left").select("_id", "text", "starts")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, offs = utf8(b.column(1))
            gone = covered(offs, b.column(2), length)
            n, removed, spans, sha = np.diff(offs), [], [], []
            for i in range(b.num_rows):
                mine = gone[offs[i]:offs[i + 1]]
                removed.append(int(mine.sum()))
                spans.append(int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()))
                sha.append(hashlib.sha256(data[offs[i]:offs[i + 1]][~mine].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())],
                ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = marked.mapInArrow(rows, "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(id_of("_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def covered(offs: np.ndarray, starts: pa.ListArray, length: int) -> np.ndarray:
    """Which bytes a repeated string covers."""
    flat = starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = pc.fill_null(pc.list_value_length(starts), 0).to_numpy()
    a = (flat >> 32) + np.repeat(offs[:-1], n)
    size = int(offs[-1]) + 1
    mark = np.bincount(a, minlength=size) - np.bincount(a + (flat & 0xFFFFFFFF) - 1 + length, minlength=size)
    return np.cumsum(mark[:-1]) > 0

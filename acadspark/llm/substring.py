"""Exact substring deduplication over words, by difference-cover anchors (operator 2).

Every word that is covered by a window of ``window`` consecutive words whose
sequence also starts earlier (in a smaller document, or earlier in the same
one) is removed. Windows are judged on the input.

* Anchors. The cover {0, 1, 3, 9} modulo 13 holds every difference modulo 13
  once: whatever the places of two equal windows, some shift below 13 puts
  both at cover positions. So hashes of the ``window - 12`` words at cover
  positions alone, 4 of 13, meet for every pair of equal windows. They are
  counted by an aggregate; anchors that occur once end here. (Windows below 20
  words take the cover {0, 1} modulo 3 or, below 3 words, all positions.)
* Extension. Only windows that hold a shared anchor at a cover position are
  looked at: their 96-bit hashes find the first start of each sequence. Of
  equal windows inside one slice of documents only the first is sent on, with
  a mark for the others, so a passage that a third of all documents share
  arrives once a slice, not once a row.
* Covered words are put together per document as intervals.

Texts move twice, to the anchors found in them and to their removed
intervals; both times dealt by document, so no group is larger than one text.

Defined cases: null text has no words; documents are (doc_id, text) pairs, so
repeated rows are one document and come back as often as they came, all alike;
different texts of one id are ordered by a hash; a null id comes before all
others; an empty table gives no rows; ``digest`` ignores further columns,
``deduplicate`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import U64, Words, grams, id_of, key_of, mix, save, slices, utf8, words

WINDOW = 20


def cover(window: int) -> tuple[int, tuple[int, ...]]:
    """(period, cover positions): a difference cover that leaves an anchor of at least window - period + 1 words."""
    if window >= 20:
        return 13, (0, 1, 3, 9)
    return (3, (0, 1)) if window >= 3 else (1, (0,))


def keyed(docs: DataFrame) -> DataFrame:
    """A column pair that names a document: _id, _version (a hash of its text)."""
    return docs.withColumns({"_id": key_of("doc_id"), "_version": F.hash(F.coalesce("text", F.lit("")))})


def places(version: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Version and word number in one long that sorts like the pair."""
    return (version.astype(np.int64) << 32) | pos


def version() -> Column:
    """The version of a place."""
    return F.shiftright("at", 32).cast("int").alias("_version")


def number() -> Column:
    """The number in a place."""
    return F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def groups(*hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first row with the same hashes, and how many there are."""
    order = np.lexsort(hashes)  # stable
    new = np.ones(len(order), bool)
    for h in hashes:
        new[1:] &= h[order[1:]] == h[order[:-1]]
    new[1:] = ~new[1:]
    group = np.cumsum(new) - 1
    first, count = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(new)][group]
    count[order] = np.bincount(group, minlength=1)[group] if len(order) else 0
    return first, count


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """_id, at, h, shared: the hashed anchors of every document.

    An anchor that its slice holds twice is shared already; only one of them keeps the hash that others can meet.
    """
    period, at = cover(window)
    size = window - period + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            w = words(*utf8(b.column(2)))
            doc = w.doc()
            pos = np.arange(len(doc)) - w.first[doc]
            take = np.flatnonzero(np.isin(pos % period, at) & (w.left() >= size) & (np.diff(w.first)[doc] >= window))
            h = grams(w.hash, take, size)
            doc, pos = doc[take], pos[take]
            ids, where = b.column(0).to_numpy()[doc], places(b.column(1).to_numpy()[doc], pos)
            first, count = groups(h)
            other = first != np.arange(len(h))
            h[other] = mix(ids[other].view(U64) ^ mix(where[other].view(U64)))  # meets nothing, and spreads
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(where), pa.array(h.view(np.int64)), pa.array(count > 1)],
                                             ["_id", "at", "h", "shared"])

    return docs.select("_id", "_version", "text").mapInArrow(rows, "_id long, at long, h long, shared boolean")


def candidates(w: Words, live: np.ndarray, window: int) -> np.ndarray:
    """Starts (word numbers) of the windows that hold one of the ``live`` anchors (word numbers)."""
    period, _ = cover(window)
    first = w.first[np.searchsorted(w.first, live, side="right") - 1]
    mark = (np.bincount(np.maximum(live - period + 1, first), minlength=len(w.start) + 1)
            - np.bincount(live + 1, minlength=len(w.start) + 1))
    return np.flatnonzero((np.cumsum(mark[:-1]) > 0) & (w.left() >= window))


def windows(docs: DataFrame, window: int) -> DataFrame:
    """(_id, at, h1, h2, n) of the candidate windows of documents with their ``live`` anchors.

    n = 0: a window that is the first of its sequence in its slice. n > 0: n windows on end that are not.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            # in order of documents, so the first of equal windows is the earliest
            b = b.take(pa.array(np.lexsort((b.column(1).to_numpy(), b.column(0).to_numpy()))))
            ids, version = b.column(0).to_numpy(), b.column(1).to_numpy()
            w = words(*utf8(b.column(2)))
            live = b.column(3).flatten().to_numpy().astype(np.int64)
            live += np.repeat(w.first[:-1], pc.list_value_length(b.column(3)).to_numpy())
            start = candidates(w, live, window)
            doc = np.searchsorted(w.first, start, side="right") - 1
            ids, at = ids[doc], places(version[doc], start - w.first[doc])
            h1 = grams(w.hash, start, window)
            h2 = (grams(w.other_hash(), start, window, 0xA0761D6478BD642F) >> U64(32)).astype(np.uint32)
            first, _ = groups(h1, h2)
            known = (ids != ids[first]) | (at != at[first])  # a repeated row's windows are the same windows
            new = np.flatnonzero(~known)
            # windows on end, as one row
            k = np.flatnonzero(known)
            head = np.ones(len(k), bool)
            head[1:] = (np.diff(start[k]) != 1) | (np.diff(doc[k]) != 0)
            length = np.diff(np.append(np.flatnonzero(head), len(k)))
            k = k[head]
            spread = mix(ids[k].view(U64) ^ mix(at[k].view(U64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(x[new], y)) for x, y in (
                    (ids, ids[k]), (at, at[k]), (h1.view(np.int64), spread.view(np.int64)),
                    (h2.view(np.int32), np.zeros(len(k), np.int32)))]
                + [pa.array(np.append(np.zeros(len(new), np.int32), length.astype(np.int32)))],
                ["_id", "at", "h1", "h2", "n"])

    return docs.mapInArrow(rows, "_id long, at long, h1 long, h2 int, n int")


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """_id, _version, starts: of each document with repeated windows, (start << 32 | how many on end) of them."""
    same = Window.partitionBy("h").orderBy("h")
    met = F.col("shared") | F.lag("h").over(same).isNotNull() | F.lead("h").over(same).isNotNull()
    live = (anchors(docs, window).withColumn("met", met).where("met").groupBy("_id", version())
            .agg(F.collect_set(number()).alias("live")))  # at most the words of one text
    live = save(live, "substring-anchors")
    rows = windows(docs.join(live, ["_id", "_version"]).select("_id", "_version", "text", "live"), window)
    order = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("_id", "at"))
    first = F.first(F.struct("_id", "at")).over(Window.partitionBy("h1", "h2").orderBy("_id", "at"))
    again = rows.withColumns({"k": order, "first": first}).where(
        "n > 0 or (k > 1 and not (_id = first._id and at = first.at))")
    return save(again.groupBy("_id", version()).agg(
        F.collect_list(F.shiftleft(number().cast("long"), 32).bitwiseOR(F.greatest("n", F.lit(1)).cast("long")))
        .alias("starts")), "substring-repeated")


def _covered(w: Words, starts: pa.ListArray, window: int) -> np.ndarray:
    """Which words a repeated window covers."""
    flat = starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = pc.fill_null(pc.list_value_length(starts), 0).to_numpy()
    a = (flat >> 32) + np.repeat(w.first[:-1], n)
    size = len(w.start) + 1
    mark = np.bincount(a, minlength=size) - np.bincount(a + (flat & 0xFFFFFFFF) - 1 + window, minlength=size)
    return np.cumsum(mark[:-1]) > 0


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    own = keyed(docs.select("doc_id", F.col("text").cast("string")))
    found = repeated(own, window)
    marked = own.join(found, ["_id", "_version"], "left").select("_id", "text", "starts")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words(*utf8(b.column(1)))
            kept = ~_covered(w, b.column(2), window)
            n = np.diff(w.first)
            raw = w.data.tobytes()
            sha = []
            for i in range(b.num_rows):
                mine = np.arange(w.first[i], w.first[i + 1])[kept[w.first[i]:w.first[i + 1]]]
                sha.append(hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(w.start[mine].tolist(), w.end[mine].tolist())]))
                           .hexdigest())
            left = np.add.reduceat(np.append(kept, False), w.first[:-1]) * (n > 0) if b.num_rows else n
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(n - left), pa.array(sha)],
                                             ["_id", "n_words", "n_removed", "kept_sha256"])

    out = marked.mapInArrow(rows, "_id long, n_words long, n_removed long, kept_sha256 string")
    return out.select(id_of("_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without their repeated words (nor the white space after them), with all their columns."""
    rest = [c for c in docs.columns if c != "text"]
    # the other columns travel in a struct, so their names clash with nothing
    own = keyed(docs.select("doc_id", F.col("text").cast("string"), F.struct(*rest).alias("_row")))
    found = repeated(own, window)
    marked = own.join(found, ["_id", "_version"], "left").select("_row", "text", "starts")
    schema = StructType([marked.schema["_row"], StructField("text", StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            text, starts = b.column(1), b.column(2)
            hit = np.flatnonzero(pc.fill_null(pc.list_value_length(starts), 0).to_numpy())
            if len(hit):
                texts = text.to_pylist()
                some = b.take(pa.array(hit))
                _, offs = utf8(some.column(1))
                w = words(*utf8(some.column(1)))
                gone = _covered(w, some.column(2), window)
                raw = w.data.tobytes()
                for j, i in enumerate(hit.tolist()):
                    own = slice(w.first[j], w.first[j + 1])
                    end = np.append(w.start[own][1:], offs[j + 1])  # a word goes with the white space behind it
                    parts = [raw[offs[j]:w.start[own][0]]]
                    parts += [raw[s:e] for s, e, g in zip(w.start[own].tolist(), end.tolist(), gone[own].tolist()) if not g]
                    texts[i] = b"".join(parts).decode()
                text = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text], ["_row", "text"])

    out = marked.mapInArrow(rows, schema)
    return out.select(*(F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))

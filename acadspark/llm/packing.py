"""Best-fit packing of tokenized documents into fixed-length sequences (operator 6).

A document's tokens are its byte-level BPE ids and one end id. A document of
more than ``capacity`` tokens is cut into pieces of ``capacity``; only its
first piece may be shorter. Every full piece is a sequence of its own; the
others are packed by bulk-synchronous best fit.

* Pieces are range-sorted by (length, id, piece) over the cluster and ranked
  within their length by per-partition offsets; a length that holds a third
  of all pieces is spread over many partitions.
* A round sweeps lengths and gaps in ascending order. Pieces wait on a stack;
  a gap takes the largest waiting piece, so every piece goes to its successor,
  the smallest gap that fits and that no larger piece claims. Conflicts (more
  pieces than gaps of a size, or the reverse) are resolved by rank: the lowest
  ranks win. Then gaps are updated and the next round begins. When no piece
  fits a gap, new sequences are opened for the largest pieces left.
* Pieces of one length, and gaps of one size, are interchangeable, so a round
  handles ranges of ranks, not rows: its state has at most ``capacity``
  lengths and as many gap sizes, whatever the number of rows. The matched
  ranges (length, ranks from..to -> sequences from.., offset) are joined back
  to the ranked pieces.

Defined cases: null and empty texts have the end id only (one token); repeated
rows are packed each; a null id stays null; an empty table gives no rows;
further columns of the input are not returned.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k"
END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """The ids of a public byte-level BPE vocabulary.

    ``vocabulary`` names a file pair of public_tokenizers or gives a path
    without its ending. The .tiktoken file holds the same vocabulary as the
    .json file of the tokenizers library; ids are equal and come about five
    times faster. Texts with the literal of an added token (<|endoftext|>), for
    which the library has an id of its own, and texts that the fast way refuses
    go to the library, as it is by default.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        self.place = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary + ".json")[:-len(".json")]
        with open(self.place + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={})
        with open(self.place + ".json", encoding="utf-8") as f:
            self.added = [x["content"] for x in json.load(f)["added_tokens"]]
        self.slow = None

    def __call__(self, text: str) -> list[int]:
        if not any(x in text for x in self.added):
            try:
                return self.fast.encode_ordinary(text)
            except Exception:  # its regular expression gives up on some very long runs
                pass
        if self.slow is None:
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_file(self.place + ".json")
        return self.slow.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n - (n - 1) // capacity * capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 (and the ids themselves)."""
    schema = PIECES + (", ids array<int>" if ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary)
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                tokens = np.array(encode(text.as_py() or "") + [END], "<u4")
                for k, (s, n) in enumerate(cut(len(tokens), capacity)):
                    part = tokens[s:s + n]
                    out.append((doc_id, k, s, n, zlib.crc32(part.tobytes())) + ((part.tolist(),) if ids else ()))
                if len(out) >= 5000:
                    yield _batch(out, names, ids)
                    out = []
            if out:
                yield _batch(out, names, ids)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, schema)


def _batch(rows: list[tuple], names: list[str], ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * ids
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def ranked(short: DataFrame) -> DataFrame:
    """``rank``: the place (from 0) of a piece among those of its length, by id and piece."""
    order = ["length", "doc_id", "piece", "ids_crc32"]
    n = max(int(short.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = save(short.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "packing-sorted")
    # one row per partition and length: the lengths, and one more per partition, at most
    counts = dealt.groupBy("_part", "length").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", "length", F.coalesce(before, F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy("_part", "length").orderBy(*order[1:]))
    return (dealt.withColumn("_here", here).join(offsets, ["_part", "length"])
            .withColumn("rank", F.col("_before") + F.col("_here") - 1).drop("_part", "_here", "_before"))


Ranges = list[list[int]]
#: length, first rank, rank after the last, first sequence, pieces to each sequence, offset of the first of them
Run = tuple[int, int, int, int, int, int]


def _size(ranges: Ranges) -> int:
    return sum(b - a for a, b in ranges)


def _take(ranges: Ranges, n: int) -> Ranges:
    """Take the first n numbers off a list of [from, to) ranges."""
    out = []
    while n:
        a, b = ranges[0]
        k = min(n, b - a)
        out.append([a, a + k])
        n -= k
        if a + k == b:
            ranges.pop(0)
        else:
            ranges[0][0] += k
    return out


def _joined(ranges: Ranges) -> Ranges:
    """Adjacent ranges as one."""
    out: Ranges = []
    for a, b in sorted(ranges):
        if out and out[-1][1] == a:
            out[-1][1] = b
        else:
            out.append([a, b])
    return out


def match(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Rounds of successor sweeps over lengths and gaps."""
    left = {n: c for n, c in counts.items() if c}  # the pieces with the highest ranks wait
    gaps: dict[int, Ranges] = {}
    runs: list[Run] = []
    opened = 0

    def place(n: int, bins: Ranges, each: int, offset: int) -> None:
        for x, y in bins:
            rank = counts[n] - left[n]
            runs.append((n, rank, rank + (y - x) * each, x, each, offset))
            left[n] -= (y - x) * each
        if not left[n]:
            del left[n]

    while left:
        # open sequences: as many as the pieces left need at least, for the largest of them
        total = sum(n * c for n, c in left.items())
        need = max(-(-total // capacity), sum(c for n, c in left.items() if 2 * n > capacity))
        for n in sorted(left, reverse=True):
            k = min(need, left[n])
            if not k:
                break
            place(n, [[opened, opened + k]], 1, 0)
            if n < capacity:
                gaps.setdefault(capacity - n, []).append([opened, opened + k])
            opened, need = opened + k, need - k
        moved = True
        while moved:  # a round
            stack: list[int] = []
            moved = []
            for v in sorted(left.keys() | gaps.keys()):
                if v in left:
                    stack.append(v)
                while stack and v in gaps:
                    n = stack[-1]
                    bins = _take(gaps[v], min(left[n], _size(gaps[v])))
                    # what the next rounds would give these gaps: more of the same length
                    each = min(v // n, left[n] // _size(bins))
                    place(n, bins, each, capacity - v)
                    if v > n * each:
                        moved.append((v - n * each, bins))
                    if n not in left:
                        stack.pop()
                    if not gaps[v]:
                        del gaps[v]
            for v, bins in moved:
                gaps.setdefault(v, []).extend(bins)
            gaps = {v: _joined(r) for v, r in gaps.items()}
    return runs


def placed(rows: DataFrame, runs: list[Run]) -> DataFrame:
    """Each ranked piece with its sequence and offset."""
    runs = sorted(runs)
    # bounded by the lengths and the rounds, not by the pieces
    held = rows.sparkSession.sparkContext.broadcast([np.array(c, np.int64) for c in zip(*runs)] if runs else None)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = held.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted((plan[0] << 44) + plan[1], (length << 44) + rank, side="right") - 1
            n, first, _, sequence, each, offset = (c[i] for c in plan)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(sequence + (rank - first) // each),
                 pa.array(offset + (rank - first) % each * n)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        look_up, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of ``docs`` with their sequence_id and offset."""
    spark = docs.sparkSession
    cutted = save(pieces(docs, capacity, vocabulary), "packing-pieces")
    short = save(ranked(cutted.where(F.col("length") < capacity)), "packing-ranked")
    # at most capacity - 1 rows
    counts = {r["length"]: r["count"] for r in short.groupBy("length").count().collect()}
    runs = match(counts, capacity)
    opened = max((x + (b - a) // each for _, a, b, x, each, _ in runs), default=0)
    full = cutted.where(F.col("length") >= capacity).select(
        "*", (F.monotonically_increasing_id() + F.lit(opened)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return placed(short, runs).unionAll(full.select(*names))


def sequences(packed: DataFrame, docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """The packed sequences: sequence_id, input_ids (at most ``capacity``), doc_ids, offsets.

    ``packed`` is a saved result of ``pack`` over ``docs``. Pieces that are alike in all columns hold the same ids,
    so each is joined to one row of ids.
    """
    of = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ids = pieces(docs, capacity, vocabulary, ids=True).dropDuplicates(of).alias("i")
    on = F.lit(True)
    for c in of:
        on = on & packed[c].eqNullSafe(F.col("i." + c))
    rows = packed.join(ids, on).select("sequence_id", "offset", packed["doc_id"], F.col("i.ids").alias("ids"))
    return (rows.groupBy("sequence_id")  # at most capacity tokens each
            .agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("_p"))
            .select("sequence_id", F.flatten(F.col("_p.ids")).alias("input_ids"), F.col("_p.doc_id").alias("doc_ids"),
                    F.col("_p.offset").alias("offsets")))

"""Shared helpers: tables, saved steps, and Arrow/numpy text kernels.

The kernels work on the raw UTF-8 buffers of an Arrow string column, a slice
of about a megabyte at a time, so a Python worker's memory does not depend on
the batch size Spark chose.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path, tidy

U64 = np.uint64
NULL_ID = -(2 ** 63)  # stands for a null id inside an operator; sorts before every other id
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder (spark.checkpoint.dir) and read it back.

    Cuts the lineage: later steps survive lost executors without recomputing
    the steps before, every later reader sees the same rows, and the step's
    shuffle files go.
    """
    spark = df.sparkSession
    path = shared_path(spark, "llm", tag)
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def key_of(col: Column | str) -> Column:
    """An id as a non-null long (null becomes NULL_ID)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("long"), F.lit(NULL_ID))


def id_of(col: Column | str) -> Column:
    """The inverse of ``key_of``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c != F.lit(NULL_ID), c)


# --- Arrow buffers ---------------------------------------------------------

def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        kind = np.int32
    elif pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        raise TypeError(f"text column expected, got {col.type}")
    if col.null_count:
        col = col.fill_null("" if "string" in str(col.type) else b"")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, kind)[col.offset:col.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offs[0]:offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column`` (a longer text makes its own)."""
    for b in batches:
        _, offs = utf8(b.column(b.schema.get_field_index(column)))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
            yield b.slice(i, j - i)
            i = j


# --- hashing ---------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: longer byte ranges are hashed one by one
LONG = 1024


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges, mixed eight bytes at a time; other seeds give independent hashes.

    Ranges of at most eight bytes and one length never collide.
    """
    n = (end - start).astype(np.int64)
    out = np.empty(len(n), U64)
    body = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(max(len(body) - 7, 0), "<u8", body, strides=(1,))  # the eight bytes from each place on
    order = np.argsort(-n, kind="stable")
    n, at = n[order], start[order].astype(np.int64)
    many = int(np.searchsorted(-n, -LONG, side="left"))
    key = int(seed).to_bytes(8, "little")
    for i in range(many):
        digest = hashlib.blake2b(data[at[i]:at[i] + n[i]].tobytes(), digest_size=8, key=key).digest()
        out[order[i]] = int.from_bytes(digest, "little")
    order, n, at = order[many:], n[many:], at[many:]
    state = mix(n.astype(U64) * U64(0xD6E8FEB86659FD93) + U64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % 2 ** 64))
    for step in range(0, int(n[0]) if len(n) else 0, 8):
        live = int(np.searchsorted(-n, -step, side="left"))  # those of more than `step` bytes
        some = eight[at[:live] + step]
        short = np.minimum(n[:live] - step, 8).astype(U64) * U64(8)
        some = np.where(short < 64, some & ((U64(1) << (short & U64(63))) - U64(1)), some)
        state[:live] = mix(state[:live] ^ some) + U64(0x632BE59BD9B4E019)
    out[order] = state
    return out


class Rolling:
    """Hashes of substrings of a sequence from prefix sums of a polynomial modulo 2^64.

    For values that are hashes themselves, or to bring together what is compared as it stands: two different strings
    of a thousand bytes can be built that collide whatever the base is.
    """

    _pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        n = len(values)
        power, self.inverse = self.powers(base, n + 1)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(values * power[:n], out=self.prefix[1:])

    @classmethod
    def powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in cls._pow or len(cls._pow[base][0]) < n:
            size = 1 << max(16, (n - 1).bit_length())
            out = []
            for b in (base, pow(base, -1, 2 ** 64)):
                a = np.full(size, b, U64)
                a[0] = 1
                out.append(np.cumprod(a, dtype=U64))
            if size > 1 << 22:  # for one huge text only: not kept
                return out[0], out[1]
            cls._pow[base] = (out[0], out[1])
        return cls._pow[base]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), mixed with their lengths."""
        h = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        return mix(h ^ ((end - start).astype(U64) * U64(0xD6E8FEB86659FD93)))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: ASCII letters and digits, and every byte of a non-ASCII character
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


@dataclass
class Words:
    """Words of a slice of documents: byte ranges, 64-bit hashes, and where each document's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # per document, and one past the last
    hash: np.ndarray

    def doc(self) -> np.ndarray:
        """The document (its place in the slice) of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def other_hash(self) -> np.ndarray:
        """A second hash of each word, from its bytes on independent of the first."""
        return hashed(self.data, self.start, self.end, 1)

    def left(self) -> np.ndarray:
        """How many words its document has from each word on, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.start))


def words(data: np.ndarray, offs: np.ndarray, of: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    """Maximal runs of the bytes in ``of``; a run never crosses a document's end."""
    n = len(data)
    if lower:
        data = LOWER[data]
    inside = of[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1] | cut[1:n]
        ends[:-1] &= ~inside[1:] | cut[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, s, e, np.searchsorted(s, offs), hashed(data, s, e))


def grams(h: np.ndarray, start: np.ndarray, k: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hashes of the k words from each of ``start`` on."""
    return Rolling(h, base)(start, start + k)

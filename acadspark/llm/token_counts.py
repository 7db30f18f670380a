"""Token counts as delta-maintained rollups (operator 5).

Totals by (source, lang, tokenizer) are kept as a table of signed deltas, one
folder per batch:

    batch=<id>/part-*.parquet   source, lang, tokenizer, n_docs, n_tokens, n_bytes

A commit pre-aggregates its changes (insert: +1, delete: -1, revise: -1 of the
old count and +1 of the new) and replaces its own batch folder only. Sums are
additive, so totals are one aggregate over the folders whatever the order of
commits, and a batch that is committed again, after a failed driver or a
retried task, overwrites itself instead of counting twice. A folder counts
once its commit is complete (Spark's success mark).

``compact`` folds the complete batches into one table of totals, so what a
reader reads does not grow with the number of batches:

    base=<n>/totals             the sums of all batches folded so far
    base=<n>/sealed             their ids

A base counts once both are complete, the newest does. Its batches are sealed:
their folders no longer count, whether they are still there or not, and a
commit of one of them changes nothing. So a compaction that dies anywhere
leaves the same totals.

Defined cases: null text has no tokens and counts as a document; null source
and lang are groups of their own; repeated rows count each; an empty batch is
a commit without rows; a group whose totals are all zero again is no row of
``totals``; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from .common import save, slices, utf8, words
from .packing import VOCABULARY, Encoder

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]
STATE = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long"
#: tokenizer versions: byte-level BPE by its vocabulary, and runs of [^\x20\x09-\x0D]
BPE, WORDS = VOCABULARY, "words-1"


def counted(docs: DataFrame, tokenizers: tuple[str, ...] = (BPE, WORDS)) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens, n_bytes: a row per document and tokenizer version."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {t: Encoder(t) for t in tokenizers if t != WORDS}
        for b in slices(batches, "text"):
            data, offs = utf8(b.column(3))
            for t in tokenizers:
                if t == WORDS:
                    n = np.diff(words(data, offs).first)
                else:
                    n = [len(encoders[t](x.as_py() or "")) for x in b.column(3)]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:3], pa.array([t] * b.num_rows), pa.array(n, pa.int64()), pa.array(np.diff(offs))],
                    ["doc_id", "source", "lang", "tokenizer", "n_tokens", "n_bytes"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"),
                        F.col("text").cast("string"))
            .mapInArrow(rows, "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_bytes long"))


def inserts(counts: DataFrame) -> DataFrame:
    """Signed changes that add counted documents."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_bytes")


def deletes(counts: DataFrame) -> DataFrame:
    """Signed changes that take counted documents away."""
    return counts.select(*KEYS, *((-F.col(c)).alias(c) for c in ("n_tokens", "n_bytes")),
                         F.lit(-1).cast("long").alias("n_docs")).select(*KEYS, *SUMS)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed changes from the old counts of documents to their new ones (source and lang may change too)."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """The totals kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_path(spark, "llm", "token-rollup")

    def _folders(self, kind: str, mark: str) -> list[str]:
        """The names behind ``kind=`` of the folders that hold the success mark ``mark``."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(self.path)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(n.removeprefix(f"{kind}=") for n in names
                      if n.startswith(f"{kind}=") and fs.exists(hadoop.Path(path, f"{n}/{mark}")))

    def _base(self) -> int:
        """The number of the newest complete base; 0: none."""
        return max(map(int, self._folders("base", "sealed/_SUCCESS")), default=0)

    def _sealed(self, base: int, batches: list[str]) -> set[str]:
        """Which of ``batches`` the base holds."""
        if not base or not batches:
            return set()
        rows = self.spark.read.schema("batch string").parquet(f"{self.path}/base={base}/sealed")
        return {r["batch"] for r in rows.where(F.col("batch").isin(batches)).collect()}

    def batches(self) -> list[str]:
        """The ids of the batches whose commit is complete and that no base holds."""
        found = self._folders("batch", "_SUCCESS")
        sealed = self._sealed(self._base(), found)
        return [b for b in found if b not in sealed]

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Add a batch of signed changes; the same batch again replaces itself, or does nothing if it is sealed."""
        if not batch or set(batch) - set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_."):
            raise ValueError(f"not a batch id: {batch!r}")
        if self._sealed(self._base(), [batch]):
            return
        (changes.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).select(*KEYS, *SUMS)
         .write.mode("overwrite").parquet(f"{self.path}/batch={batch}"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_bytes of all committed batches."""
        return self._totals(self._base(), self.batches())

    def _totals(self, base: int, batches: list[str]) -> DataFrame:
        folders = [f"{self.path}/batch={b}" for b in batches] + ([f"{self.path}/base={base}/totals"] if base else [])
        if not folders:
            return self.spark.createDataFrame([], STATE)
        rows = self.spark.read.schema(STATE).parquet(*folders)
        some: Column = F.lit(False)
        for c in SUMS:
            some = some | (F.col(c) != 0)
        return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).where(some)

    def compact(self) -> None:
        """Fold all complete batches into a new base and seal them. One writer at a time."""
        base, batches = self._base(), self.batches()
        if batches:
            new = f"{self.path}/base={base + 1}"
            self._totals(base, batches).write.mode("overwrite").parquet(f"{new}/totals")
            sealed = self.spark.createDataFrame([(b,) for b in batches], "batch string")
            if base:
                sealed = sealed.unionByName(self.spark.read.schema("batch string").parquet(f"{self.path}/base={base}/sealed"))
            sealed.coalesce(1).write.mode("overwrite").parquet(f"{new}/sealed")  # publishes the base
        self._forget()

    def _forget(self) -> None:
        """Delete the folders of sealed batches, and all bases but the newest two, which late readers may still read."""
        base = self._base()
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        gone = [f"batch={b}" for b in self._sealed(base, self._folders("batch", "_SUCCESS"))]
        gone += [f"base={n}" for n in self._folders("base", "sealed/_SUCCESS") if int(n) < base - 1]
        for name in gone:
            fs.delete(hadoop.Path(self.path, name), True)


def count(docs: DataFrame, tokenizers: tuple[str, ...] = (BPE, WORDS), path: str | None = None) -> DataFrame:
    """Totals of ``docs``, through a rollup: a batch for each tokenizer version."""
    rollup = Rollup(docs.sparkSession, path)
    for t in tokenizers:
        rollup.commit(f"load-{t}", inserts(counted(docs, (t,))))
    return rollup.totals()



def maintained(docs: DataFrame, tokenizers: tuple[str, ...] = (BPE, WORDS), path: str | None = None) -> DataFrame:
    """Totals of ``docs``, through every kind of change: they equal those of ``count``.

    A seventh of the documents is loaded as an empty first version and revised later, another seventh is loaded twice
    and deleted once, and the load is committed again. The documents are tokenized once.
    """
    rollup = Rollup(docs.sparkSession, path)
    counts = save(counted(docs, tokenizers), "token-counts")
    share = F.pmod(F.xxhash64("doc_id", "source", "lang", "n_bytes"), F.lit(7))
    revised, twice = counts.where(share == 0), counts.where(share == 1)
    empty = revised.withColumns({c: F.lit(0).cast("long") for c in ("n_tokens", "n_bytes")})
    load = inserts(counts.where(share != 0).unionByName(empty).unionByName(twice))
    rollup.commit("load", load)
    rollup.commit("revise", revisions(empty, revised))
    rollup.commit("delete", deletes(twice))
    rollup.commit("load", load)
    return rollup.totals()

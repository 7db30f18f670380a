"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only (operator 4).

A document holds a benchmark item if some window of as many words as the item
has a weighted Jaccard similarity of at least ``similarity`` with it, over
five-word shingles weighted by how often they occur (words are runs of letters
and digits in lower case; an item of fewer than five words is one shingle).

* Windows. With as many words, item and window have m shingles each, so
  a similarity s needs 2 m s / (1 + s) of them in common (89 % at 0.8).
  Shingles of the whole corpus therefore meet the benchmark's shingles once,
  without a shuffle while those are few, and only windows with enough of them
  go on; no window that could be similar is lost.
* Fingerprints. Every such window gets a 64-bit SimHash of its shingles. Two
  multisets of similarity 0.8 differ in about 10 bits; the radius is 23.
* Multi-index Hamming blocks. Of 8 blocks of 8 bits, one differs in at most
  two bits if 23 at most differ in all. Items are listed under all 37 values
  within two bits of each of their blocks, windows under their blocks, so
  every pair within the radius meets; the join checks the radius.
* Pairs that meet are verified by the exact weighted similarity.

Items of the same words are one text in all of this; their ids are joined to
the texts found at the end.

Broadcasts are hinted only for saved tables whose measured size is below a
bound; beyond it the same joins are told to shuffle, as Spark's own choice goes
by the files, and a gigabyte of listed blocks is a few megabytes of them.

Defined cases: null and empty texts hold nothing; null, empty and word-less
items are held by nothing; repeated items count as one; documents are
(doc_id, text) pairs, so repeated rows are one document in ``matches`` and all
go in ``clean``; of equally similar windows the first is reported; empty
tables give no matches; further columns are ignored by ``matches`` and kept by
``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_of, key_of, save

SHINGLE = 5
BITS, BLOCK, RADIUS = 64, 8, 23
#: a saved table of at most so many bytes may be broadcast
SMALL = 16 << 20
#: ASCII but letters and digits
SEPARATORS = r"[\x00-/:-@\[-`{-\x7F]+"


def tokens(text: Column | str) -> Column:
    """The words of a text as an array."""
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda x: x != "")


def shingle(words: str, at: str, size: int) -> str:
    """SQL: the hash of ``size`` words from ``at`` (0-based) on."""
    return "xxhash64(" + ", ".join(f"get({words}, {at} + {i})" for i in range(size)) + ")"


def shingles(words: str, start: str, n: str, size: int) -> Column:
    """The hashed shingles of n words from ``start`` on."""
    return F.expr(f"transform(sequence(cast({start} as int), cast({start} + {n} - {size} as int)), "
                  f"i -> {shingle(words, 'i', size)})")


def simhash(grams: str) -> Column:
    """The 64-bit SimHash of an array of hashes: the majority of each bit."""
    ones = f"aggregate({grams}, 0, (s, h) -> s + cast(shiftright(h, b) & 1 as int))"
    return F.expr(f"aggregate(sequence(0, {BITS - 1}), 0L, "
                  f"(f, b) -> f | if(2 * {ones} > size({grams}), shiftleft(1L, b), 0L))")


def weighted_common(x: str, y: str) -> Column:
    """The summed smaller counts of the elements of two arrays."""
    return F.expr(f"aggregate(array_distinct({y}), 0, (s, h) -> s + least("
                  f"size(filter({x}, e -> e = h)), size(filter({y}, e -> e = h))))")


def small(df: DataFrame, row_bytes: Column) -> DataFrame:
    """A saved table, to be broadcast if its measured size is small, and joined by shuffling if not."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= SMALL else df.hint("merge")


def items_of(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """item, size (of a shingle), n (words), grams, fp of every text of an item; and item, item_id: who has it."""
    own = save(benchmark.select("item_id", tokens(F.col("text").cast("string")).alias("words")).where("size(words) > 0")
               .dropDuplicates(), "decontaminate-texts")
    texts = save(own.select("words").distinct().withColumn("item", F.monotonically_increasing_id()), "decontaminate-words")
    sized = texts.withColumns({"n": F.size("words"), "size": F.least(F.size("words"), F.lit(SHINGLE))})
    grams = F.when(F.col("size") == SHINGLE, shingles("words", "0", "n", SHINGLE))
    for k in range(1, SHINGLE):
        grams = grams.when(F.col("size") == k, shingles("words", "0", "n", k))
    items = save(sized.withColumn("grams", grams).select("item", "size", "n", "grams", simhash("grams").alias("fp")),
                 "decontaminate-items")
    return items, save(own.join(texts.hint("merge"), "words").select("item", "item_id"), "decontaminate-ids")


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(key_of("doc_id").alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_version"),
                       text.alias("text"), *more)


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """_id, _version, item, last, at: the places (sorted) in a document of an item's shingles; last: its last place."""
    listed = save(items.select("item", "size", "n", F.explode(F.array_distinct("grams")).alias("gram")),
                  "decontaminate-grams")
    sizes = [r["size"] for r in listed.select("size").distinct().collect()]  # five at most
    # cut into words once; the explode below reads the array's words and the places after them
    own = docs.select("_id", "_version", tokens("text").alias("words"))
    found = None
    for k in sorted(sizes):
        grams = small(listed.where(F.col("size") == k), F.lit(40)).drop("size")
        places = own.select("_id", "_version", "words", F.posexplode("words").alias("at", "word")).select(
            "_id", "_version", "at", (F.size("words") - k).alias("last"), F.expr(shingle("words", "at", k)).alias("gram"))
        met = places.where("at <= last").join(grams, "gram").select(
            "_id", "_version", "item", "n", F.lit(k).alias("size"), "last", "at")
        found = met if found is None else found.unionAll(met)
    if found is None:
        return None
    return found.groupBy("_id", "_version", "item", "n", "size").agg(
        F.max(F.col("last") + F.col("size")).alias("words"), F.array_sort(F.collect_set("at")).alias("at"))


def windows(found: DataFrame, similarity: float) -> DataFrame:
    """_id, _version, size, n, start of the windows that hold enough of an item's shingles."""
    m = F.col("n") - F.col("size") + 1
    need = F.ceil(F.lit(2 * similarity / (1 + similarity) - 1e-9) * m).cast("int")
    rows = found.withColumns({"m": m, "need": need}).where("size(at) >= need")
    # `need` hits in at most m places on end, and every start that takes them all in
    starts = F.expr("""array_distinct(flatten(transform(
        filter(sequence(0, size(at) - need), i -> get(at, i + need - 1) - get(at, i) < m),
        i -> if(greatest(0, get(at, i + need - 1) - m + 1) <= least(get(at, i), words - n),
                sequence(greatest(0, get(at, i + need - 1) - m + 1), least(get(at, i), words - n)),
                cast(array() as array<int>)))))""")
    return rows.select("_id", "_version", "size", "n", F.explode(starts).alias("start")).distinct()


def blocks_of(fp: str) -> Column:
    """(block, value) of a fingerprint."""
    return F.expr(f"transform(sequence(0, {BITS // BLOCK - 1}), b -> struct(b as block, "
                  f"cast(shiftrightunsigned({fp}, b * {BLOCK}) & {2 ** BLOCK - 1} as int) as value))")


def masks() -> list[int]:
    """All changes of a block that a pair within the radius may have in its best block."""
    errors = RADIUS // (BITS // BLOCK)
    return [x for x in range(2 ** BLOCK) if bin(x).count("1") <= errors]


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """_id, _version, item_id, start, n_words, similarity: the best window of each document for each item it holds."""
    if not similarity >= 0.8:
        raise ValueError(f"similarity {similarity} is below 0.8, for which RADIUS is made")
    spark = docs.sparkSession
    items, ids = items_of(benchmark)
    found = hits(docs, items)
    if found is None:
        return spark.createDataFrame([], "_id long, _version long, item_id long, start int, n_words int, similarity double")
    places = save(windows(found, similarity).groupBy("_id", "_version")
                  .agg(F.collect_list(F.struct("size", "n", "start")).alias("places")), "decontaminate-windows")
    # few documents are left; a row of `places` has about ten windows of an item
    some = docs.join(small(places, 40 + 40 * F.size("places")), ["_id", "_version"]).select(
        "_id", "_version", "text", "places").dropDuplicates(["_id", "_version"])
    # cut into words after the exchange, once a document: an array of words takes several times the memory of its text
    some = some.select("_id", "_version", tokens("text").alias("words"), "places")
    each = some.select("_id", "_version", "words", F.explode("places").alias("p")).select(
        "_id", "_version", "words", "p.size", "p.n", "p.start")
    grams = F.when(F.col("size") == SHINGLE, shingles("words", "start", "n", SHINGLE))
    for k in range(1, SHINGLE):
        grams = grams.when(F.col("size") == k, shingles("words", "start", "n", k))
    printed = save(each.withColumn("grams", grams).drop("words").withColumn("fp", simhash("grams")),
                   "decontaminate-fingerprints")
    values = F.transform(F.array(*(F.lit(x) for x in masks())), lambda x: F.col("b.value").bitwiseXOR(x))
    index = save(items.select("item", "size", "n", "fp", F.explode(blocks_of("fp")).alias("b"))
                 .select("item", "size", "n", F.col("fp").alias("item_fp"), "b.block",
                         F.explode(values).alias("value")), "decontaminate-index")
    asked = printed.select("_id", "_version", "size", "n", "start", "fp", F.explode(blocks_of("fp")).alias("b")).select(
        "_id", "_version", "size", "n", "start", "fp", "b.block", "b.value")
    met = (asked.join(small(index, F.lit(64)), ["size", "n", "block", "value"])
           .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
           .select("_id", "_version", "size", "n", "start", "item").distinct())
    pairs = (met.join(printed.select("_id", "_version", "size", "n", "start", "grams").hint("merge"),
                      ["_id", "_version", "size", "n", "start"])
             .join(small(items.select("item", F.col("grams").alias("item_grams")), 40 + 8 * F.size("item_grams")), "item"))
    common = weighted_common("grams", "item_grams")
    scored = pairs.withColumn("common", common).withColumn(
        "similarity", F.col("common") / (F.size("grams") + F.size("item_grams") - F.col("common")))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"), "n"))
    # the best window of a text, then of an id, which may have several texts
    held = scored.where(F.col("similarity") >= F.lit(similarity - 1e-12)).groupBy("_id", "_version", "item").agg(best.alias("w"))
    return (held.join(small(ids, F.lit(32)), "item").groupBy("_id", "_version", "item_id").agg(F.max("w").alias("w"))
            .select("_id", "_version", "item_id", (-F.col("w.before")).alias("start"),
                    F.col("w.n").alias("n_words"), "w.similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity."""
    return matches(keyed(docs), benchmark, similarity).select(
        id_of("_id").alias("doc_id"), "item_id", "start", "n_words", "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    rest = [c for c in docs.columns if c != "text"]
    own = keyed(docs, F.struct(*rest).alias("_row"))
    bad = save(matches(own, benchmark, similarity).select("_id", "_version").distinct(), "decontaminate-found")
    left = own.join(small(bad, F.lit(32)), ["_id", "_version"], "left_anti")
    return left.select(*(F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))

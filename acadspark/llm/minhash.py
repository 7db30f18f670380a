"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures (operator 1).

A document is its set of distinct ``k``-word shingles (words of non-space
bytes, A-Z in lower case; fewer than ``k`` words are one shingle). Documents
are linked if 100 * |intersection| >= 100 * similarity * |union|, and the
connected components of the links are the groups.

* Equal sets are collapsed first: one class for all copies of a set.
* Signatures are minima of independent hashes over the set, of which a few
  bits each are kept: 40 of 8 bits for the index and 1,024 of 4 bits for the
  check. At the similarity 0.8 a slot differs with probability 0.2 (0.1875 of
  4 bits), so more than ``RADIUS`` = 18 of 40 differ for less than 1 pair in
  11,000 at exactly 0.8 and 1 in 850,000 at 0.85, and more than ``CHECK`` = 242
  of 1,024 for less than 1 in 15,000 at exactly 0.8.
* Multi-index join. The 40 slots are cut into 7 chunks of 6 or 5. By the
  pigeonhole principle a pair within the radius differs in at most 2 slots of
  one of the five chunks of 6, or 1 of one of the two of 5 (18 < 5 * 3 + 2 *
  2). All ways to leave 2 (or 1) slots of a chunk out are enumerated: 85 keys
  of 4 slots each, and every pair within the radius shares one at least.
* A key that many documents share does not emit their pairs. Every document
  is paired with its key's hub, the one that meets most others over all its
  keys (in a group of copies, what they were copied from); pairs within both
  radii are confirmed on the full sets, and their components found. Then only
  pairs of different components of a key remain.
* Crowds. Documents whose largest hub is the same are a crowd. The pairs inside a
  crowd of more than ``CROWD`` never become rows: its members are cut into
  blocks of a bounded size with their full sets, blocks meet blocks by an equi
  join, and each task counts all intersections of two blocks exactly and gives
  only links that join two components, fewer than it has documents. So a group
  of texts that are all just below the similarity costs work, but no rows, and
  there no signature decides.
* The other pairs of a key are tested by both radii inside the join, give one row
  in the first of their common keys only, and are confirmed likewise.

Defined cases: null and empty texts, and texts of white space only, have no
shingles and are linked with nothing; repeated rows are equal sets; a null
doc_id counts as smaller than all others; documents of one id with different
texts are documents each; an empty table gives no rows; ``groups`` ignores
further columns, ``deduplicate`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, grams, id_of, key_of, mix, save, slices, utf8, words
from .components import components

RADIUS = 18
#: (slots of a chunk, how many of them may differ): the sum of (errors + 1) is RADIUS + 1
CHUNKS = ((6, 2),) * 5 + ((5, 1),) * 2
SLOTS = sum(n for n, _ in CHUNKS)
CHECK_SLOTS, CHECK = 1024, 242
#: the signature's columns: a long for each chunk, a byte for each of its slots; and 16 check slots in each other long
INDEX = [f"i{c}" for c in range(len(CHUNKS))]
CHECKS = [f"q{c}" for c in range(CHECK_SLOTS // 16)]
SIG = INDEX + CHECKS
SEED = 20
#: a table of at most so many bytes may be broadcast
SMALL = 16 << 20
#: documents of a common hub that are compared in blocks, if more; and of a block: documents, and shingles, about
CROWD, BLOCK, BLOCK_ITEMS = 32, 256, 1 << 17


def plans() -> list[tuple[int, tuple[int, ...]]]:
    """(chunk, slots of it that make the key) of every key."""
    return [(c, slots) for c, (n, errors) in enumerate(CHUNKS) for slots in combinations(range(n), n - errors)]


def shingle_sets(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of a slice of texts, and where each document's begin (n + 1)."""
    w = words(*utf8(col), lower=True)
    n = np.diff(w.first)
    start = np.flatnonzero(w.left() >= k)
    h = grams(w.hash, start, k)
    at = np.searchsorted(start, w.first)
    short = np.flatnonzero((n > 0) & (n < k))
    whole = {int(i): grams_of(w.hash[w.first[i]:w.first[i + 1]]) for i in short}
    sets = [whole[i] if i in whole else np.unique(h[at[i]:at[i + 1]]) for i in range(len(n))]
    size = np.cumsum([0] + [len(s) for s in sets])
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), size


def grams_of(h: np.ndarray) -> np.ndarray:
    """A whole sequence as one shingle."""
    return grams(h, np.zeros(1, np.int64), len(h))


def totals(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 of each document's values."""
    p = np.concatenate([np.zeros(1, U64), np.cumsum(x, dtype=U64)])
    return p[size[1:]] - p[size[:-1]]


def signatures(x: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The signature's longs of each document (zero without shingles)."""
    some = np.flatnonzero(np.diff(size))
    out = [np.zeros(len(size) - 1, U64) for _ in SIG]
    if not len(some):
        return out
    rng = np.random.default_rng(SEED)
    flip, times = rng.integers(0, 2 ** 63, (2, SLOTS)).astype(U64)
    begin = size[:-1][some]
    at = 0
    for c, (n, _) in enumerate(CHUNKS):
        for j in range(n):
            low = np.minimum.reduceat((x ^ flip[at]) * (U64(2) * times[at] + U64(1)), begin)
            out[c][some] |= (mix(low) & U64(255)) << U64(8 * j)
            at += 1
    # the check needs less: half as wide hashes do
    half = (x >> U64(32)).astype(np.uint32)
    flip, times = rng.integers(0, 2 ** 31, (2, CHECK_SLOTS)).astype(np.uint32)
    for j in range(CHECK_SLOTS):
        low = np.minimum.reduceat((half ^ flip[j]) * (np.uint32(2) * times[j] + np.uint32(1)), begin)
        out[len(INDEX) + j // 16][some] |= (mix(low.astype(U64)) & U64(15)) << U64(4 * (j % 16))
    return out


def described(docs: DataFrame, k: int) -> DataFrame:
    """_id, _version, n, s1, s2 and the signature of every document: size and 128-bit hash of its set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x, size = shingle_sets(b.column(2), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.diff(size)), pa.array(totals(mix(x), size).view(np.int64)),
                 pa.array(totals(mix(x ^ U64(0x5851F42D4C957F2D)), size).view(np.int64)),
                 *(pa.array(v.view(np.int64)) for v in signatures(x, size))], ["_id", "_version", "n", "s1", "s2", *SIG])

    return docs.select("_id", "_version", "text").mapInArrow(
        rows, "_id long, _version long, n long, s1 long, s2 long, " + ", ".join(f"{c} long" for c in SIG))


def keys(classes: DataFrame) -> DataFrame:
    """key, plan, node, n: the keys of every class."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = plans()
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                chunks = [part.column(2 + c).to_numpy().view(U64) for c in range(len(CHUNKS))]
                out = []
                for number, (c, slots) in enumerate(every):
                    v = np.full(part.num_rows, number, U64)
                    for j in slots:
                        v = (v << U64(8)) | ((chunks[c] >> U64(8 * j)) & U64(255))
                    out.append(mix(v))
                n = len(every)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out).view(np.int64)),
                     pa.array(np.repeat(np.arange(n, dtype=np.int32), part.num_rows)),
                     pa.array(np.tile(part.column(0).to_numpy(), n)), pa.array(np.tile(part.column(1).to_numpy(), n))],
                    ["key", "plan", "node", "n"])

    return classes.select("node", "n", *INDEX).mapInArrow(rows, "key long, plan int, node long, n long")


def differing(a: str, b: str) -> str:
    """SQL: a long with the lowest bit of each byte in which two longs differ."""
    x = f"({a} ^ {b})"
    x = f"({x} | (shiftrightunsigned({x}, 4) & {0x0F0F0F0F0F0F0F0F}L))"
    x = f"({x} | shiftrightunsigned({x}, 2))"
    return f"(({x} | shiftrightunsigned({x}, 1)) & {0x0101010101010101}L)"


def differing_nibbles(a: str, b: str) -> str:
    x = f"({a} ^ {b})"
    x = f"({x} | (shiftrightunsigned({x}, 2) & {0x3333333333333333}L))"
    return f"(({x} | shiftrightunsigned({x}, 1)) & {0x1111111111111111}L)"


def near(x: str, y: str) -> Column:
    """Signatures (of two aliases) within both radii."""
    index = " + ".join(f"bit_count({differing(f'{x}.{c}', f'{y}.{c}')})" for c in INDEX)
    check = " + ".join(f"bit_count({differing_nibbles(f'{x}.{c}', f'{y}.{c}')})" for c in CHECKS)
    return F.expr(f"{index} <= {RADIUS} and {check} <= {CHECK}")


def first_common(x: str, y: str, plan: str) -> Column:
    """The pair has no earlier key in common than that of ``plan``.

    No earlier chunk is within its errors, and the key's slots are the first of their chunk that agree.
    """
    every = plans()
    chunk = F.element_at(F.array(*(F.lit(c) for c, _ in every)), F.col(plan) + 1)
    left_out = [sum(1 << 8 * j for j in range(max(slots)) if j not in slots) for _, slots in every]
    mask = F.element_at(F.array(*(F.lit(m).cast("long") for m in left_out)), F.col(plan) + 1)
    out, earlier = None, F.lit(True)
    for c, (_, errors) in enumerate(CHUNKS):
        off = F.expr(differing(f"{x}.{INDEX[c]}", f"{y}.{INDEX[c]}"))
        case = earlier & (off.bitwiseAND(mask) == mask)
        out = F.when(chunk == c, case) if out is None else out.when(chunk == c, case)
        earlier = earlier & (F.bit_count(off) > errors)
    return out


def alike(a: str, b: str, percent: int) -> Column:
    """Sizes that sets of the wanted similarity may have."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A saved table, to be broadcast if its counted rows are few; otherwise Spark joins it by shuffling."""
    return F.broadcast(df) if df.count() * row_bytes <= SMALL else df


def sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """node, items: the full sets of the nodes; saved."""
    wanted = save(classes.join(nodes, "node").select("node", F.col("first").alias("_id"), "n", "s1"), "minhash-wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x, size = shingle_sets(b.column(0), k)
            # of several texts of an id, the one that is meant
            mine = np.flatnonzero((np.diff(size) == b.column(2).to_numpy())
                                  & (totals(mix(x), size).view(np.int64) == b.column(3).to_numpy()))
            yield pa.RecordBatch.from_arrays(
                [b.column(1).take(pa.array(mine)), pa.array([x[size[i]:size[i + 1]].tobytes() for i in mine], pa.binary())],
                ["node", "items"])

    return save(docs.join(small(wanted, 40), "_id").select("text", "node", "n", "s1")
                .mapInArrow(sets, "node long, items binary").dropDuplicates(["node"]), "minhash-sets")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""
    pairs = save(pairs, "minhash-pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    held = sets_of(nodes, classes, docs, k)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "x"):
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = (pairs.join(held.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
            .join(held.select(F.col("node").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y"))
    return save(both.mapInArrow(check, "a long, b long"), "minhash-links")


def intersections(x: list[np.ndarray], y: list[np.ndarray], step: int = 1 << 14) -> np.ndarray:
    """The sizes of the intersections of each of x with each of y, by products of their incidence matrices."""
    items, place = np.unique(np.concatenate(x + y), return_inverse=True)
    line = np.repeat(np.arange(len(x) + len(y)), [len(v) for v in x + y])
    order = np.argsort(place, kind="stable")
    place, line = place[order], line[order]
    out = np.zeros((len(x), len(y)))
    for low in range(0, len(items), step):
        part = slice(*np.searchsorted(place, [low, low + step]))
        held = np.zeros((len(x) + len(y), min(step, len(items) - low)), np.float32)  # counts below 2^24 are exact
        held[line[part], place[part] - low] = 1
        out += held[:len(x)] @ held[len(x):].T
    return out.astype(np.int64)


def block_links(x: tuple, y: tuple, percent: int) -> list[tuple[int, int]]:
    """Links of two blocks (nodes, roots, sets), no more than it takes to join the roots that they join."""
    nx, ny = (np.array([len(v) for v in b[2]], np.int64) for b in (x, y))
    both = intersections(x[2], y[2])
    near = 100 * both >= percent * (nx[:, None] + ny[None, :] - both)
    root: dict[int, int] = {}

    def find(r: int) -> int:
        while r in root:
            r = root[r]
        return r

    out = []
    for i, j in np.argwhere(near & (np.array(x[1])[:, None] != np.array(y[1])[None, :])):
        a, b = find(x[1][i]), find(y[1][j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((x[0][i], y[0][j]))
    return out


def crowd_links(members: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components of each crowd; members: saved, with node, hub, root and n."""
    held = sets_of(members.select("node"), classes, docs, k)
    sizes = members.groupBy("hub").agg(F.count("*").alias("rows"), F.sum("n").alias("items"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("items") / BLOCK_ITEMS)).cast("int")
    dealt = (members.join(sizes.select("hub", blocks.alias("blocks")), "hub")
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(held, "node"))
    packed = save(dealt.groupBy("hub", "blocks", "block").agg(F.collect_list(F.struct("node", "root", "items")).alias("rows")),
                  "minhash-blocks")
    x = packed.select("hub", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"), F.col("rows").alias("x"))
    y = packed.select("hub", F.col("block").alias("other"), F.col("rows").alias("y"))

    def unpacked(rows: pa.ListArray, i: int) -> tuple:
        flat = rows.slice(i, 1).flatten()
        return (flat.field("node").to_pylist(), flat.field("root").to_pylist(),
                [np.frombuffer(v.as_buffer(), U64) for v in flat.field("items")])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = block_links(unpacked(b.column(0), i), unpacked(b.column(1), i), percent)
                a, c = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    met = x.join(y, ["hub", "other"])
    # a pair's work is not seen from its bytes: it is dealt over all tasks
    tasks = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return save(met.select("x", "y").repartition(tasks).mapInArrow(links, "a long, b long"), "minhash-crowd-links")


def linked(classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """node, root of all nodes that are linked with another."""
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62  # smaller sets are alike only if equal
    own = Window.partitionBy("key")
    met = save(keys(classes.where(F.col("n") >= least)).withColumn("size", F.count("*").over(own)).where("size > 1"),
               "minhash-met")  # only documents that share a key with another
    crowd = met.groupBy("node").agg(F.sum("size").alias("crowd"))
    ordered = own.orderBy(F.desc("crowd"), "node")
    met = save(met.join(crowd, "node").withColumns({"rep": F.first("node").over(ordered), "rep_n": F.first("n").over(ordered),
                                                    "rep_crowd": F.first("crowd").over(ordered)})
               .drop("crowd"), "minhash-hubs")
    sig = classes.select("node", *SIG)

    spokes = (met.where(F.col("node") != F.col("rep")).where(alike("n", "rep_n", percent))
              .select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct())
    stars = (spokes.join(sig.alias("x"), F.col("a") == F.col("x.node"))
             .join(sig.alias("y"), (F.col("b") == F.col("y.node")) & near("x", "y")).select("a", "b"))
    first = confirmed(stars, classes, docs, k, percent)
    root = save(components(first), "minhash-roots")

    # crowds: the members of a hub that lie in several components
    hubs = met.groupBy("node").agg(F.min(F.struct((-F.col("rep_crowd")).alias("c"), F.col("rep").alias("hub"))).alias("h"),
                                   F.min("n").alias("n"))
    hubs = save(hubs.join(root, "node", "left").select("node", "h.hub", "n", F.coalesce("root", "node").alias("root")), "minhash-crowds")
    large = hubs.groupBy("hub").agg(F.count("*").alias("rows"), F.min("root").alias("low"), F.max("root").alias("high"))
    large = large.where((F.col("rows") > CROWD) & (F.col("low") != F.col("high"))).select("hub")
    members = save(hubs.join(large, "hub"), "minhash-members")
    inside = crowd_links(members, classes, docs, k, percent)

    # keys of more than two documents that hold several components, of which not all are of one crowd; alone, a document
    # is its own crowd, below zero
    others = (met.where(F.col("node") != F.col("rep")).select("key", "plan", "node", "n")
              .join(hubs.select("node", "root"), "node")
              .join(members.select("node", "hub"), "node", "left")
              .select("key", "plan", "node", "n", "root", F.coalesce("hub", -F.col("node") - 1).alias("hub")))
    mixed = (others.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("hub").alias("one"),
                                       F.max("hub").alias("other"))
             .where("low <> high and one <> other").select("key"))
    rest = save(others.join(mixed, "key").join(sig, "node"), "minhash-rest")
    # columns that can't be null make the join's condition short enough to be compiled
    sure = rest.select("key", "plan", "node", "n", "root", "hub", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in SIG))
    x, y = sure.alias("x"), sure.alias("y")
    cross = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node"))
                   & (F.col("x.root") != F.col("y.root")) & (F.col("x.hub") != F.col("y.hub")) & alike("x.n", "y.n", percent)
                   & near("x", "y") & first_common("x", "y", "x.plan"))
    more = cross.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    second = confirmed(more, classes, docs, k, percent)
    return components(first.unionAll(inside).unionAll(second))


def grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """_id, _version, n, component: of every document with its group's smallest id (null without shingles)."""
    every = save(described(docs, k), "minhash-described")
    classes = save(every.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("_id").alias("first"), *(F.min(c).alias(c) for c in SIG))
                   .withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    joined = classes.join(linked(classes, docs, k, percent), "node", "left").select(
        "n", "s1", "s2", "first", F.coalesce("root", "node").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component"))
    named = joined.join(smallest, "root").select("n", "s1", "s2", "component")
    return every.join(named, ["n", "s1", "s2"], "left").select("_id", "_version", "n", "component")


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(key_of("doc_id").alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_version"),
                       text.alias("text"), *more)


def per_cent(similarity: float) -> int:
    """The similarity in per cent; the radii of the signatures are made for 0.8 and would lose links below it."""
    if not round(100 * similarity) >= 80:
        raise ValueError(f"similarity {similarity} is below 0.8, for which RADIUS and CHECK are made")
    return round(100 * similarity)


def groups(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    found = grouped(keyed(docs), k, per_cent(similarity))
    component = F.coalesce("component", "_id")
    return found.select(id_of("_id").alias("doc_id"), F.col("n").alias("n_shingles"),
                        id_of(component).alias("component_id"), (F.col("_id") == component).alias("kept"))


def deduplicate(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group, that with the smallest doc_id, with all columns of ``docs``.

    Documents without shingles all stay. Of several documents that tie for the smallest id of a group (repeated rows,
    or different texts of one id), one stays.
    """
    rest = [c for c in docs.columns if c != "text"]
    own = keyed(docs, F.struct(*rest).alias("_row"))  # in a struct, other columns clash with nothing
    found = grouped(own, k, per_cent(similarity))
    kept = (found.where("_id = component").groupBy(F.col("component").alias("_id")).agg(F.min("_version").alias("_version"))
            .unionAll(found.where("n = 0").select("_id", "_version").distinct())
            .groupBy("_id", "_version").count().select("_id", "_version"))
    kept = save(kept, "minhash-kept")
    number = F.row_number().over(Window.partitionBy("_id", "_version").orderBy("_version"))
    blank = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    left = (own.join(kept, ["_id", "_version"]).withColumn("_number", number).where((F.col("_number") == 1) | blank))
    return left.select(*(F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))

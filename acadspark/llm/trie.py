"""The prefix trie of conversations, with subtree totals by time-forward processing (operator 11).

A conversation is a sequence of turns (role, text). Each distinct sequence of
the first d turns of one is a node of depth d, under the textless root; the
conversations that start with it are its members.

* Nodes without texts. Texts are hashed where they are read (128 bits of role
  and text); only hashes and lengths are shuffled. Turns are range-sorted by
  conversation and turn, numbered and combined to prefix hashes inside each
  range, and carried over to the next ranges by a table of one row for each
  range and conversation, so one conversation of any length lies in many tasks.
  A node is (depth, prefix hash); members are counted by an aggregate with
  partial sums, so a first turn that all share is a row a task.
* Time-forward processing. Nodes are sorted in reverse level order, by Spark's
  external sort. Every node takes its children's messages from a priority queue,
  adds its own values, and sends the totals forward in time, to its parent's
  place in the order.
* Shards. ``weight`` of a node is the number of turns of its members below it;
  it never grows down a path. A shard is what is below the highest node of a
  path whose weight is at most ``shard``: no shard has more nodes or waiting
  messages than that, so its queue needs no spilling: what would overflow it,
  the upper part of a heavy tree, is left to the next round. A shard's root
  sends its message out of the shard; these are summed by target and saved. In
  round r the nodes of a weight up to shard^r that are left run in the same way,
  and so on to the root. A chain of single turns needs one message at a time,
  however long it is. The number of rounds grows with the logarithm of the turns.
* Lists of conversations that end at a node are hashed as a stream: ids are
  range-sorted by node and id, joined to blocks of text inside each range, and a
  node's blocks then fed in order to one SHA-256, which can't be divided.

``rebuild`` makes the registered query's conversations: the first h turns of
conversation c - c % 5, then c's own turns after its first h; h = crc32(c) % 9.

Defined cases: turns are ordered by ``turn``, null first, ties by the hash of
role and text; null role or text is empty; rows with a null conv_id take no
part; repeated rows are turns each; conversations without turns (after
``rebuild``) end at the root; an empty table gives no rows; further columns are
ignored; c - c % 5 takes the remainder with c's sign, so -7 goes to -5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: nodes of a shard at most
SHARD = 20_000
#: rows of a range, about
RANGE = 200_000
#: bytes of a block of ids
BLOCK = 1 << 16
KEY = ["depth", "x1", "x2"]


def ranges(rows: DataFrame, *order: str) -> DataFrame:
    """The rows range-sorted, with the range's number as ``part``; saved."""
    n = max(1, -(-rows.count() // RANGE))
    return save(rows.repartitionByRange(max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *order)
                .withColumn("part", F.spark_partition_id()), "trie-ranges")


def carried(rows: DataFrame, order: list[str], columns: dict[str, tuple]) -> DataFrame:
    """Running values within each conversation over range-sorted rows.

    columns: name -> (aggregate expression, how two of its values combine). A window never holds more than a range;
    ranges of one conversation are put together by a table of a row each.
    """
    local = Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy("conv_id", "part").agg(*(F.expr(e).alias(c) for c, (e, _) in columns.items()))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    again = {"count": "sum"}
    ends = ends.select("conv_id", "part", *(
        F.coalesce(F.expr(f"{again.get(e.split('(')[0], e.split('(')[0])}({c})").over(before), F.lit(0).cast("long")).alias(f"{c}_0")
        for c, (e, _) in columns.items()))
    return (rows.withColumns({c: F.expr(e).over(local) for c, (e, _) in columns.items()}).join(ends, ["conv_id", "part"])
            .withColumns({c: join(F.col(c), F.col(f"{c}_0")) for c, (_, join) in columns.items()})
            .drop("part", *(f"{c}_0" for c in columns)))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), m1, m2 (a 128-bit hash of role and text), bytes (of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    both = F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text))
    half = lambda at: F.conv(F.substring(both, at, 16), 16, -10).cast("long")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        half(1).alias("m1"), half(17).alias("m2"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["turn", "m1", "m2"]  # nulls first
    rows = ranges(rows, "conv_id", *order)
    return carried(rows, order, {"pos": ("count(1)", lambda a, b: a + b)}).select("conv_id", "pos", "m1", "m2", "bytes")


def rebuild(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, m1, m2, bytes) of the rebuilt conversations; and conv_id, length of each of them."""
    turns = save(turns, "trie-turns")
    length = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % every
    convs = length.select("conv_id", "own", base.alias("base"),
                          (F.crc32(F.col("conv_id").cast("string")) % most).cast("long").alias("h"))
    of_base = length.where(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = save(convs.join(of_base, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_own", F.lit(0))).alias("taken"), "own"), "trie-conversations")
    heads = turns.where((base == F.col("conv_id")) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    first = convs.select("conv_id", "base", "h").join(heads, "base").where("pos <= h")
    rest = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos > h")
    columns = ["conv_id", "m1", "m2", "bytes"]
    rows = first.select("pos", *columns).unionAll(rest.select((F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), *columns))
    return rows, convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))


def paths(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, length, depth, x1, x2, p1, p2, bytes: the node of each conversation's every depth, and its parent."""
    seeded = turns.select("conv_id", "pos", "bytes", F.xxhash64("pos", "m1", "m2").alias("a"),
                          F.xxhash64("m2", "pos", "m1").alias("b"))
    xor = lambda a, b: a.bitwiseXOR(b)
    run = carried(ranges(seeded, "conv_id", "pos"), ["pos"], {"x1": ("bit_xor(a)", xor), "x2": ("bit_xor(b)", xor)})
    below = run.select("conv_id", F.col("pos").alias("depth"), "x1", "x2", F.col("x1").bitwiseXOR(F.col("a")).alias("p1"),
                       F.col("x2").bitwiseXOR(F.col("b")).alias("p2"), "bytes").join(lengths, "conv_id")
    zero = F.lit(0).cast("long")
    root = lengths.select("conv_id", *(zero.alias(c) for c in ("depth", "x1", "x2")),
                          *(F.lit(None).cast("long").alias(c) for c in ("p1", "p2")), zero.alias("bytes"), "length")
    return save(below.unionByName(root), "trie-paths")


def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of nodes that come sorted by (shard, depth descending, key), and messages to parents outside the shard.

    Columns in: shard, depth, x1, x2, p1, p2, saved, children, leaves, below: the last three are what came from
    shards before. Rows out have ``node`` true for totals; else they are what the node is still to receive.
    """
    shard, queue = None, []  # of (-depth, x1, x2, children, leaves, saved)

    def emptied(out):
        while queue:
            d, a, b, children, leaves, saved = heappop(queue)
            out.append((-d, a, b, children, leaves, saved, False))

    kinds = [("depth", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("children", pa.int64()),
             ("leaves", pa.int64()), ("below", pa.int64()), ("node", pa.bool_())]

    def batch(out):
        columns = zip(*out, strict=True) if out else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])

    for b in batches:
        out = []
        for own, depth, x1, x2, p1, p2, saved, children, leaves, below in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if own != shard:
                emptied(out)
                shard = own
            here = (-depth, x1, x2)
            while queue and queue[0][:3] == here:
                message = heappop(queue)
                children += message[3]
                leaves += message[4]
                below += message[5]
            if not children:
                leaves = 1
            below += saved
            out.append((depth, x1, x2, children, leaves, below, True))
            if depth:
                heappush(queue, (1 - depth, p1, p2, 1, leaves, below))
        yield batch(out)
    out = []
    emptied(out)
    yield batch(out)


def totals(nodes: DataFrame, walks: DataFrame, shard: int) -> DataFrame:
    """depth, x1, x2, children, leaves, below (saved tokens of the subtree) of every node.

    nodes: saved, with conv_id, weight and saved; walks: saved, conv_id with its nodes' keys and weights.
    """
    top = nodes.agg(F.max("weight")).first()[0]
    done, waiting, low, high = None, None, -1, shard
    while low < (top or 0):  # once for an empty table
        # the highest node of a conversation's path that is light enough is the shard of what is below
        roots = walks.where(F.col("weight") <= high).groupBy("conv_id").agg(F.min(F.struct(*KEY)).alias("shard"))
        some = nodes.where((F.col("weight") > low) & (F.col("weight") <= high)).join(roots, "conv_id").select(
            F.xxhash64("shard.depth", "shard.x1", "shard.x2").alias("shard"), *KEY, "p1", "p2", "saved")
        zero = F.lit(0).cast("long")
        if waiting is None:
            some = some.withColumns({c: zero for c in ("children", "leaves", "below")})
        else:
            some = some.join(waiting, KEY, "left").na.fill(0, ["children", "leaves", "below"])
        some = some.select("shard", *KEY, "p1", "p2", "saved", "children", "leaves", "below")
        ran = save(some.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "x1", "x2").mapInArrow(
            forward, "depth long, x1 long, x2 long, children long, leaves long, below long, node boolean"), "trie-totals")
        sent = ran.where("not node").groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in ("children", "leaves", "below")))
        if waiting is not None:  # for nodes of later rounds
            sent = sent.unionAll(waiting.join(ran.where("node").select(*KEY), KEY, "left_anti")).groupBy(*KEY).agg(
                *(F.sum(c).alias(c) for c in ("children", "leaves", "below")))
        waiting = save(sent, "trie-messages")
        found = ran.where("node").drop("node")
        done = found if done is None else done.unionAll(found)
        low, high = high, high * shard
    return done


def ends(walks: DataFrame) -> DataFrame:
    """depth, x1, x2, ends_sha256: of the ids, ascending and joined by commas, that end at each node."""
    own = walks.where("depth = length").select(*KEY, "conv_id")
    count = own.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    alone = count.where("n = 1").select(*KEY, F.sha2(F.col("conv_id").cast("string"), 256).alias("ends_sha256"))
    shared = ranges(own.join(count.where("n > 1").select(*KEY), KEY), *KEY, "conv_id")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, size = None, [], 0

        def flushed():
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in (*key, ids[0])), pa.array([",".join(map(str, ids))])],
                                              [*KEY, "first", "ids"])
        for b in batches:
            for *now, i in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ids and (now != key or size > BLOCK):
                    yield flushed()
                    ids, size = [], 0
                key = now
                ids.append(i)
                size += 20
        if ids:
            yield flushed()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None

        def flushed():
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([sha.hexdigest()])],
                                              [*KEY, "ends_sha256"])
        for b in batches:
            for *now, ids in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in (*KEY, "ids")), strict=True):
                if now != key:
                    if sha is not None:
                        yield flushed()
                    key, sha = now, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if sha is not None:
            yield flushed()

    keys = "depth long, x1 long, x2 long"
    cut = (shared.repartition("part").sortWithinPartitions("part", *KEY, "conv_id").select(*KEY, "conv_id")
           .mapInArrow(blocks, keys + ", first long, ids string"))
    many = cut.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, keys + ", ends_sha256 string")
    return alone.unionAll(many)


def trie(turns: DataFrame, lengths: DataFrame, shard: int = SHARD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    turns: conv_id, pos (from 1 on, no gaps), m1, m2 (the turn's hash), bytes; lengths: conv_id, length of every
    conversation, those without turns included.
    """
    every = paths(turns, lengths)
    nodes = save(every.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("length") - F.col("depth")).alias("weight"),
        F.min("bytes").alias("bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")), "trie-nodes")
    walks = save(every.select("conv_id", *KEY, "length").join(nodes.select(*KEY, "weight"), KEY), "trie-walks")
    summed = totals(nodes, walks, shard)
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"),
                          F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(summed, KEY).join(parent, ["depth", "p1", "p2"], "left").join(ends(walks), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("below").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))


def plain(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = save(turns_of(conversations), "trie-turns")
    return trie(turns, turns.groupBy("conv_id").agg(F.max("pos").alias("length")), shard)


def rebuilt(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(*rebuild(turns_of(conversations)), shard)


ORACLE_SQL = r"""
with own as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
               row_number() over (partition by conv_id order by turn nulls first) as pos from conversations where conv_id is not null),
crc(t) as (select list(y order by i) from (
  select i, list_reduce(list_prepend(i, generate_series(1, 8)), lambda c, j: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as y
  from generate_series(0, 255) s(i))),
conv as (select conv_id, max(pos) as own from own group by 1),
h as (select conv_id, conv.own, conv_id - conv_id % 5 as base,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda c: cast(unicode(c) as bigint))),
            lambda c, x: xor(c // 256, t[(xor(c, x) % 256) + 1])), 4294967295) % 9 as h from conv, crc),
k as (select h.*, least(h.h, coalesce(b.own, 0)) as taken from h left join conv b on b.conv_id = h.base),
turn as (
  select k.conv_id, pos, role, text from k join own on own.conv_id = k.base where pos <= h
  union all select k.conv_id, taken + pos - h, role, text from k join own using (conv_id) where pos > h),
list as (select k.conv_id, coalesce(list(md5(length(role) || ':' || role || ':' || text) order by pos) filter (pos is not null), []) as w,
           coalesce(list(octet_length(encode(text)) order by pos) filter (pos is not null), []) as b
         from k left join turn using (conv_id) group by 1),
walk as (select conv_id, d, md5(array_to_string(w[1:d], '/')) as x, case when d > 0 then md5(array_to_string(w[1:d - 1], '/')) end as p,
           case when d > 0 then b[d] else 0 end as bytes, d = len(w) as ends
         from (select *, unnest(generate_series(0, len(w))) as d from list)),
node as (select d, x, min(conv_id) as conv_id, any_value(p) as p, count(*) as n, any_value(bytes) as bytes,
           sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '')) as sha
         from walk group by d, x),
child as (select d - 1 as d, p as x, count(*) as n from node where d > 0 group by 1, 2),
full_node as (select node.*, coalesce(child.n, 0) as children from node left join child using (d, x)),
up as (select w.d, w.x, sum((n.n - 1) * n.bytes) as saved, count(*) filter (n.children = 0) as leaves
       from full_node n join walk w on w.conv_id = n.conv_id and w.d <= n.d group by 1, 2)
select n.conv_id, n.d as depth, q.conv_id as parent_conv_id, n.n as n_convs, n.children as n_children, leaves as n_leaves,
  cast(saved as bigint) as saved_tokens, n.sha as ends_sha256
from full_node n join up using (d, x) left join node q on q.d = n.d - 1 and q.x = n.p"""

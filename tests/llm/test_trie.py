"""The conversation trie against a plain reading of the definition."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from helpers import word

from acadspark.llm import trie

ODD = ["depth", "x1", "part", "weight", "length", "pos", "shard"]
SCHEMA = "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in ODD)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *("odd" for _ in ODD)) for r in rows], SCHEMA)


def conversations(seed, n=60):
    """Conversations that share beginnings, with copies, long ones, gaps, ties and nulls."""
    rng = random.Random(seed)
    known, rows = [[]], []
    for c in range(n):
        turns = list(rng.choice(known)[:rng.randint(0, 12)])
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            turns.append((rng.choice(["user", "assistant", None]), rng.choice(["", "ä€😀", word(rng), word(rng) * 30, None])))
        known.append(turns)
        c = c if c % 7 else -c
        rows += [(c, 2 * i + 5, *t) for i, t in enumerate(turns)]
    long = [("user", f"turn {i % 3}") for i in range(300)]
    rows += [(1000, i, *t) for i, t in enumerate(long)] + [(1001, i, *t) for i, t in enumerate(long[:120])]
    rows += [(2000, None, "user", "first"), (2000, None, "user", "second"), (2000, 1, "user", "x"), (2000, 1, "user", "x"),
             (2001, 0, "a", "b:c"), (2002, 0, "a:b", "c"), (None, 0, "user", "nobody"), (2 ** 62, 0, "user", "far")]
    rows += [(3000 + i, 0, "user", "hello") for i in range(300)]
    rng.shuffle(rows)
    return rows


def half(x):
    v = int(x, 16)
    return v - 2 ** 64 if v >= 2 ** 63 else v


def ordered(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            m = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, half(m[:16]), half(m[16:]), role, text))
    return {c: [t[4:] for t in sorted(ts)] for c, ts in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def expected(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[x] for x in children[node])
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node],
                    saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shard", [trie.SHARD, 40, 2])
def test_rebuilt(spark, shard):
    rows = conversations(1)
    assert rows_of(trie.rebuilt(frame(spark, rows), shard)) == expected(rebuilt(ordered(rows)))


def test_plain_in_small_ranges_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "RANGE", 50)
    monkeypatch.setattr(trie, "BLOCK", 100)
    rows = conversations(2)
    assert rows_of(trie.plain(frame(spark, rows), 7)) == expected(ordered(rows))


def test_empty(spark):
    assert trie.rebuilt(frame(spark, [])).collect() == []
    assert trie.plain(frame(spark, [(None, 1, "user", "x")])).collect() == []
    rows = [(5, 0, None, None)]  # one textless turn, which its own base takes or leaves
    assert rows_of(trie.rebuilt(frame(spark, rows))) == expected(rebuilt(ordered(rows)))


def test_turnless_conversations_end_at_the_root(spark):
    # 7 takes h turns of 5, which is absent, and drops as many of its own
    absent = [c for c in range(6, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2][:6]
    rows = [(c, 0, "user", "x") for c in absent]
    got = rows_of(trie.rebuilt(frame(spark, rows)))
    assert got == expected(rebuilt(ordered(rows))) and len(got) == 1 and got[0][3] == 6

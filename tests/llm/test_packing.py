import zlib

import numpy as np
import pytest
from helpers import SCHEMA, documents, frame

from acadspark.llm import packing


def ids_of(rows):
    """By the tokenizers library."""
    from tokenizers import Tokenizer
    import public_tokenizers
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [0]) for i, x in rows]


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pieces_fill_sequences(spark, capacity):
    rows = documents(2) + [(300, "<|endoftext|> it's 12   x"), (301, "a" * 3000 + " " * 500 + "é" * 700)]
    got = packing.pack(frame(spark, rows), capacity).collect()
    want = []
    for i, ids in ids_of(rows):
        n = len(ids)
        cuts = [(0, n)] if n <= capacity else [(0, (n - 1) % capacity + 1)] + [
            (s, capacity) for s in range((n - 1) % capacity + 1, n, capacity)]
        want += [(i, k, s, m, zlib.crc32(np.array(ids[s:s + m], "<u4").tobytes())) for k, (s, m) in enumerate(cuts)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted((str(w[0]), *w[1:]) for w in want)
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    total = sum(r.length for r in got)
    alone = sum(2 * r.length > capacity for r in got)
    assert len(fill) <= max(-(-total // capacity), alone) * 1.05 + 1


def test_sequences_hold_the_tokens(spark):
    rows = documents(3)
    docs = frame(spark, rows)
    packed = packing.save(packing.pack(docs, 64), "test")
    ids = {}
    for i, x in ids_of(rows):
        ids.setdefault(str(i), []).append(x)
    for r in packing.sequences(packed, docs, 64).collect():
        assert len(r.input_ids) <= 64 and len(r.doc_ids) == len(r.offsets)
        for d, a, b in zip(r.doc_ids, r.offsets, [*r.offsets[1:], len(r.input_ids)]):
            part = r.input_ids[a:b]
            assert any(x[s:s + len(part)] == part for x in ids[str(d)] for s in range(len(x)))


@pytest.mark.parametrize("lengths", [[1] * 5000, [1000] * 700 + [1048] * 300, list(range(1, 2048)) * 3, [1025] * 50, [683] * 300 + [1] * 9,
                                     [2047] * 10 + [1] * 11, []])
def test_matching(lengths):
    u, c = np.unique(np.array(lengths, int), return_counts=True)
    counts = dict(zip(u.tolist(), c.tolist()))
    runs = packing.match(counts)
    bins, seen = {}, set()
    for n, a, b, x, each, offset in runs:
        assert (b - a) % each == 0
        for k in range(b - a):
            assert (n, a + k) not in seen
            seen.add((n, a + k))
            bins.setdefault(x + k // each, []).append((offset + k % each * n, n))
    assert len(seen) == len(lengths)
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    # no worse than first-fit decreasing
    gaps = []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, g in enumerate(gaps) if g >= n), None)
        if k is None:
            gaps.append(2048 - n)
        else:
            gaps[k] -= n
    assert len(bins) <= len(gaps) * 1.02 + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0

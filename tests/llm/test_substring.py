import hashlib
import re

import pytest
from helpers import SCHEMA, documents, frame, twins

from acadspark.llm import substring


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, window):
    """(doc_id, n_words, n_removed, sha) of every row; equal rows are one document."""
    rows = list(rows)
    seen = set()
    out = {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        w = split(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            x = tuple(w[s:s + window])
            if x in seen:
                gone[s:s + window] = [True] * window
            seen.add(x)
        kept = [x for x, g in zip(w, gone) if not g]
        out[i, t] = (i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return [out[r] for r in rows]


@pytest.mark.parametrize("window", [1, 2, 5, 20, 33])
def test_against_brute_force(spark, window):
    rows = documents(window, 30) + twins()
    got = [tuple(r) for r in substring.digest(frame(spark, rows), window).collect()]
    key = str
    assert sorted(got, key=key) == sorted(brute(rows, window), key=key)


def test_cover_holds_every_difference():
    for window in (1, 2, 3, 19, 20, 50):
        period, at = substring.cover(window)
        assert {(a - b) % period for a in at for b in at} == set(range(period))
        assert window - period + 1 >= 1


def test_kept_text_has_all_columns_and_its_white_space(spark):
    p = " ".join(f"p{i}" for i in range(25))
    rows = [(1, "a  b\n" + p + "\tc"), (2, "x " + p + "  y\n"), (3, None), (4, "clean\n\ntext ")]
    docs = frame(spark, rows)
    got = substring.deduplicate(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: rows[0][1], 2: "x y\n", 3: None, 4: "clean\n\ntext "}


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substring.digest(none).count() == 0 and substring.deduplicate(none).count() == 0

import base64
import hashlib
import random

import pytest

from acadspark.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, n long, first long, segment long"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "odd", 1, 2, 3) for i, u, h in rows], SCHEMA)


def pages():
    rng = random.Random(4)
    long = "".join(rng.choice("aé漢🙂<>\r\n &") for _ in range(3000))
    return [(1, "http://a/b?c=d%20e", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://x/\r\nEvil: 1", long), (4, "u", long),
            (5, "u", None), (6, "u", ""), (7, "ü ñ", "WARC/1.1\r\n\r\n\r\n\r\n0\r\n\r\n"), (None, "n", "<p>x</p>"), (None, "n", "alone"),
            (8, "u", long + "!"), (8, "u", long + "!"), (9, "", "\x00\x01 odd")]


def want(rows, least=0):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == b and j is not None]
        first = (min(same) if same else None) if len(b) >= least else i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first == i else "revisit",
                    None if first == i else first, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"segment_bytes": 60, "chunk_bytes": 7}, {"min_bytes": 5, "segment_bytes": 200}])
def test_round_trip(spark, options):
    rows = pages()
    got = [tuple(r) for r in warc.round_trip(frame(spark, rows), **options).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error").collect()]
    assert sorted(got, key=str) == want(rows, options.get("min_bytes", 0))


def test_payloads_and_urls_come_back(spark, tmp_dir):
    rows = pages()
    warc.write(frame(spark, rows), tmp_dir + "/w", segment_bytes=100, chunk_bytes=30, records_per_file=3)
    got = warc.read(spark, tmp_dir + "/w").where("record_type = 'response'").collect()
    whole = {(i, u, (h or "").encode()) for i, u, h in rows}
    assert {(r.page_id, r.url, bytes(r.payload)) for r in got} <= whole
    assert {bytes(r.payload) for r in got} == {p for _, _, p in whole}


def test_broken_segments_are_told(spark, tmp_dir):
    digest, html = "D" * 32, "0123456789" * 30
    records = warc.records(1, "u", html, digest, 1, "d", 80, 50)
    assert len(records) > 3
    cases = {"whole": records, "gap": records[:1] + records[2:], "no end": records[:-1],
             "short": [*records[:-1], records[-1].replace("Total-Length: ", "Total-Length: 9")],
             "no start": records[1:], "shuffled": records[::-1]}
    for name, some in cases.items():
        path = f"{tmp_dir}/{name}"
        spark.createDataFrame([(x,) for x in some], "value string").coalesce(1).write.option("lineSep", warc.END).text(path)
        (r,) = warc.read(spark, path).collect()
        if name in ("whole", "shuffled"):
            assert bytes(r.payload).decode() == html and r.error is None and r.page_id == 1
        else:
            assert r.payload is None and r.error


def test_chunked_framing():
    for most in (4, 5, 100):
        for text in ("", "a", "é漢🙂" * 50):
            assert warc.unchunked(warc.chunked(text.encode(), most)).decode() == text
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"3\r\nab", b"z\r\n", b"", b"3\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_empty_table(spark):
    assert warc.round_trip(frame(spark, [])).count() == 0

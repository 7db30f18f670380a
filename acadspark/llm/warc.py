"""WARC archives: writing pages, and reading records back with segment reassembly (operator 3).

Writing. A page becomes a ``response`` record: an HTTP response whose body is
the UTF-8 html in chunked transfer framing. Of pages with equal payloads (by
SHA-1 and length) of at least ``min_bytes`` bytes, the one with the smallest
page_id is the response; the others are ``revisit`` records that refer to it
and carry no body. A block longer than ``segment_bytes`` is written in
segments: the first in the record itself, the rest in ``continuation`` records
with the origin's id, a segment number and, on the last, the total length.
Files are plain text to Spark's writer (the end of a record, CR LF CR LF, is
its line end), compressed as a whole, with a bounded number of records of
bounded size each.

Reading. Every file is parsed by Content-Length. Records in one piece are
decoded on the spot; segments, which may lie in any file, are grouped by their
origin's id, ordered by segment number, checked for gaps and against the total
length, and joined; then the chunked framing is removed. A record that fails
keeps its row, with the reason in ``error`` and a null payload.

A group of segments holds one payload. Finding the response of a payload is a
map-side combined minimum; joining it back is an equi join, where Spark splits
skewed digests.

Defined cases: null html is an empty payload; a null url is written as no
target URI and read as null; a null page_id never is the smallest (pages with
only null ids are all responses); repeated rows of one page_id that has the
smallest id are each a response, with one record id; an empty table writes an
empty archive and reads as no rows; further columns are not written.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from .common import save, tidy

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: RFC 4648
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
PARSED = ("record_id string, page_id long, url string, record_type string, refers_to_id string, digest string, "
          "origin_id string, segment long, total long, block binary, payload binary, error string")


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a binary column in upper-case base32: every five hex digits are four base-32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _edge(data: bytes, at: int) -> int:
    """The last character boundary at or before ``at``."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _parts(data: bytes, most: int) -> list[bytes]:
    """``data`` in parts of at most ``most`` (at least 4) bytes that split no character."""
    out, at = [], 0
    while at < len(data):
        to = _edge(data, min(at + most, len(data)))
        out.append(data[at:to])
        at = to
    return out


def chunked(payload: bytes, most: int) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in _parts(payload, most)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Removes chunked framing (extensions and trailers are skipped)."""
    out, at = [], 0
    while True:
        to = body.index(b"\r\n", at)
        size = int(body[at:to].partition(b";")[0], 16)
        if size < 0:
            raise ValueError("chunk of negative size")
        if not size:
            return b"".join(out)
        part, after = body[to + 2:to + 2 + size], body[to + 2 + size:to + 4 + size]
        if len(part) < size or after != b"\r\n":
            raise ValueError("chunk of wrong size")
        out.append(part)
        at = to + 4 + size


def _record(fields: dict[str, object], block: bytes) -> str:
    head = "".join(f"\r\n{k}: {v}" for k, v in (fields | {"Content-Length": len(block)}).items() if v is not None)
    return VERSION + head + END + block.decode()


def _id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def records(page_id: int | None, url: str | None, html: str | None, digest: str, first: int | None, date: str,
            segment_bytes: int, chunk_bytes: int) -> list[str]:
    """The records of a page; ``first``: the page_id of the response with its payload."""
    own = _id(page_id, digest)
    fields = {"WARC-Record-ID": own, "WARC-Date": date, "WARC-Payload-Digest": "sha1:" + digest, "Page-ID": page_id,
              # every byte that a header can't hold is escaped, and the escape sign itself
              "WARC-Target-URI": None if url is None else quote(url, safe="/:?#[]@!$&'()*+,;=~")}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if first != page_id:
        return [_record({"WARC-Type": "revisit", **fields, "WARC-Profile": PROFILE, "WARC-Refers-To": _id(first, digest),
                         "Refers-To-Page-ID": first, "Content-Type": "application/http;msgtype=response"}, http + b"\r\n")]
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked((html or "").encode(), chunk_bytes)
    parts = _parts(block, segment_bytes)
    kind = {"Content-Type": "application/http;msgtype=response"}
    if len(parts) == 1:
        return [_record({"WARC-Type": "response", **fields, **kind}, block)]
    out = [_record({"WARC-Type": "response", **fields, **kind, "WARC-Segment-Number": 1}, parts[0])]
    for i, part in enumerate(parts[1:], 2):
        out.append(_record({"WARC-Type": "continuation", "WARC-Record-ID": _id(i, own), "WARC-Date": date,
                            "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": i,
                            "WARC-Segment-Total-Length": len(block) if i == len(parts) else None}, part))
    return out


def write(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = 32_768, chunk_bytes: int = 8_192,
          records_per_file: int = 2_000, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Write a WARC archive of (page_id, url, html) rows to the folder ``path``."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"),
                        base32_sha1(html).alias("digest"), F.length(html).alias("n"))
    first = rows.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.min("page_id").alias("first"))
    known = rows.join(first, ["digest", "n"], "left")
    # below min_bytes every page is its own response
    known = known.withColumn("first", F.when(F.col("n") >= min_bytes, F.col("first")).otherwise(F.col("page_id")))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for row in zip(*(c.to_pylist() for c in b.columns)):
                for r in records(*row, date, segment_bytes, chunk_bytes):
                    out.append(r)
                    size += len(r)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    with tidy(pages.sparkSession):
        (known.select("page_id", "url", "html", "digest", "first").mapInArrow(lines, "value string")
         .write.option("lineSep", END).option("maxRecordsPerFile", records_per_file)
         .option("compression", compression).text(path))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a file."""
    at = 0
    while at < len(data):
        to = data.find(b"\r\n\r\n", at)
        if to < 0 or data[at:at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        lines = data[at:to].decode().split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(head["content-length"])
        block = data[to + 4:to + 4 + n]
        if len(block) < n:
            raise ValueError(f"record at byte {at} ends early")
        yield head, block
        at = to + 4 + n
        if data[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"record has no end at byte {at}")
        at += 4


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response, its transfer framing removed."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("HTTP header without end")
    framing = [x.partition(b":")[2].strip().lower() for x in head.split(b"\r\n")
               if x.lower().startswith(b"transfer-encoding:")]
    return unchunked(body) if framing == [b"chunked"] else body


def _decoded(block: bytes) -> tuple[bytes | None, str | None]:
    try:
        return payload_of(block), None
    except ValueError as e:
        return None, str(e) or "bad framing"


def read(spark: SparkSession, path: str) -> DataFrame:
    """record_id, page_id, url, record_type, refers_to_id, digest, payload, error of every response and revisit."""
    names = [c.split()[0] for c in PARSED.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [kinds[c.split()[1]] for c in PARSED.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell in b.column(0):
                out = []
                data = cell.as_py()
                for head, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    kind, segment = head["warc-type"], head.get("warc-segment-number")
                    if kind not in ("response", "revisit", "continuation"):
                        continue  # warcinfo, metadata and others hold no page
                    payload = error = None
                    if kind == "response" and segment is None:
                        payload, error = _decoded(block)
                    url = head.get("warc-target-uri")
                    out.append((head["warc-record-id"], int(head["page-id"]) if "page-id" in head else None,
                                None if url is None else unquote(url), kind, head.get("warc-refers-to"),
                                head.get("warc-payload-digest", "").removeprefix("sha1:"),
                                head.get("warc-segment-origin-id", head["warc-record-id"]),
                                None if segment is None else int(segment),
                                int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None,
                                None if segment is None else block, payload, error))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = files.mapInArrow(rows, PARSED)
    result = ["record_id", "page_id", "url", "record_type", "refers_to_id", "digest", "payload", "error"]
    whole = parsed.where(F.col("segment").isNull()).select(*result)
    of = ["page_id", "url", "record_type", "digest"]
    first = [F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in of]
    # repeated rows share a record id: equal segments are taken once, and their first ones counted
    grouped = (parsed.where(F.col("segment").isNotNull()).groupBy("origin_id")
               .agg(*first, F.sum(F.when(F.col("segment") == 1, 1).otherwise(0)).alias("copies"),
                    F.array_sort(F.collect_set(F.struct("segment", "total", "block"))).alias("parts")))
    last = F.element_at("parts", -1)
    gap = F.col("parts.segment") != F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + F.length(p["block"]))
    why = (F.when(gap, "missing segment").when(last["total"].isNull(), "no last segment")
           .when(length != last["total"], "total length differs"))
    joined = grouped.withColumn("error", why)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payload, error = [], []
            for parts, why in zip(b.column("parts"), b.column("error").to_pylist()):
                got = (None, why) if why else _decoded(b"".join(p["block"] for p in parts.as_py()))
                payload.append(got[0])
                error.append(got[1])
            keep = ["origin_id", *of, "copies"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(payload, pa.binary()), pa.array(error, pa.string())],
                [*keep, "payload", "error"])

    whole_again = joined.select("origin_id", *of, "copies", "parts", "error").mapInArrow(
        assemble, "origin_id string, page_id long, url string, record_type string, digest string, copies long, "
                  "payload binary, error string")
    # a group without its first segment is one broken record
    whole_again = whole_again.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("copies", F.lit(1)))))
    return whole.unionByName(whole_again.select(
        F.col("origin_id").alias("record_id"), "page_id", "url", "record_type", F.lit(None).cast("string").alias("refers_to_id"),
        "digest", "payload", "error"))


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages``, read the archive back: page_id, payload_bytes, payload_digest, record_type, refers_to, error."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "llm", "warc")
    write(pages, path, **options)
    got = save(read(spark, path).select(
        "record_id", "page_id", "record_type", "refers_to_id", F.length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"), "error"), "warc-read")
    found = (got.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id"))
             .agg(F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("_n"),
                  F.first("payload_digest").alias("_d")))
    response = got.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "error")
    revisit = got.where("record_type = 'revisit'").join(found, "refers_to_id", "left").select(
        "page_id", F.col("_n").alias("payload_bytes"), F.col("_d").alias("payload_digest"), "record_type", "refers_to",
        F.when(F.col("_n").isNull(), "no response").alias("error"))
    return response.unionByName(revisit)

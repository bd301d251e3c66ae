"""WARC archives: write pages as records, read them back, reassemble segments.

*Writing.* Of pages with equal payloads that with the largest id is written as a ``response``; the
others are ``revisit`` records that refer to it. A response carries an HTTP message with chunked
transfer framing. A message longer than ``segment`` bytes is cut into a first record and
``continuation`` records, which name their origin and their number; the last one states the total
length. Records go to gzip files in the shared folder. Spark writes them as lines that end in the
blank line that ends a record, so any file system that Spark knows will do.

*Reading.* A gzip file is read by one task in order, and a record's own length says where it ends,
whatever its payload holds. Continuations may lie in other files: segments are grouped by the
identifier of their origin, ordered by number, joined, held against the stated total length, and
the chunked framing is taken off the whole. A record is the most a task holds.

The payload moves between machines once, for the choice of responses, and by digest and id together,
so equal payloads do not gather in one task. Rules: a null payload is empty; null ids are smaller than any other;
rows repeated with equal id and payload are all responses if their id is the largest; a record whose
segments are missing or do not add up is read with ``intact`` false and a null payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.common import bound_batches, parts_for, utf8
from tradeloom.storage import materialize, work_folder

BLANK = b"\r\n\r\n"
SEGMENT = 64 << 10
CHUNK = 16 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + BLANK
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

RECORD = (
    "record_id string, type string, page_id bigint, uri string, digest string, refers_to string, "
    "origin string, number int, total bigint, block binary"
)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """A body in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts.append(b"%x\r\n%s\r\n" % (len(part), part))
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The body without its chunked framing; raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it says")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes | None) -> bytes | None:
    """The payload of an HTTP message; None where it cannot be had."""
    if block is None:
        return None
    head, _, body = block.partition(BLANK)
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    try:
        return unchunked(body)
    except ValueError:
        return None


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record without the blank line that ends it."""
    clean = "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + clean.encode() + b"Content-Length: %d" % len(block) + BLANK + block


def record_id(sha: str, page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{sha}/{page_id}')}>"


def response_records(page_id: int | None, uri: str | None, payload: bytes, segment: int) -> Iterator[bytes]:
    origin = record_id(hashlib.sha1(payload).hexdigest(), page_id)
    block = HTTP + chunked(payload)
    pieces = [block[at : at + segment] for at in range(0, len(block), segment)]
    several = len(pieces) > 1
    for n, piece in enumerate(pieces, 1):
        first = n == 1
        yield _record(
            [
                ("WARC-Type", "response" if first else "continuation"),
                ("WARC-Record-ID", origin if first else record_id(origin, n)),
                ("WARC-Date", DATE),
                ("WARC-Target-URI", uri),
                ("WARC-Payload-Digest", f"sha1:{digest32(payload)}" if first else None),
                ("WARC-Page-ID", None if page_id is None else str(page_id)),
                ("WARC-Segment-Origin-ID", None if first else origin),
                ("WARC-Segment-Number", str(n) if several else None),
                ("WARC-Segment-Total-Length", str(len(block)) if several and n == len(pieces) else None),
                ("Content-Type", "application/http; msgtype=response" if first else None),
            ],
            piece,
        )


def revisit_record(page_id: int | None, uri: str | None, sha: str, response_id: int | None, row: str) -> bytes:
    return _record(
        [
            ("WARC-Type", "revisit"),
            ("WARC-Record-ID", record_id(f"revisit {row} {sha}", page_id)),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(sha)).decode()}"),
            ("WARC-Page-ID", None if page_id is None else str(page_id)),
            ("WARC-Refers-To", record_id(sha, response_id)),
            ("WARC-Profile", PROFILE),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        HTTP,
    )


def _rank(ids: str) -> Column:
    """Orders ids with nulls before any other, and compares equal for equal nulls."""
    c = F.col(ids)
    return F.struct(c.isNotNull().alias("has"), F.coalesce(c, F.lit(0)).alias("id"))


def write(pages: DataFrame, path: str, segment: int = SEGMENT, least: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) as records to gzip files under ``path``.

    Payloads of fewer than ``least`` bytes are always responses.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string").alias("uri"), utf8("html").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("rank", _rank("page_id"))
    small = F.octet_length("payload") < least
    best = rows.filter(~small).groupBy("sha").agg(F.max("rank").alias("rank"))
    slim = rows.filter(~small).select("page_id", "uri", "sha", F.col("rank").alias("own"))

    def responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for page_id, uri, payload in zip(*(c for c in batch.columns)):
                for record in response_records(page_id.as_py(), uri.as_py(), payload.as_py(), segment):
                    held.append(record)
                    size += len(record)
                if size > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    def revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [revisit_record(*values) for values in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    first = rows.join(best, ["sha", "rank"], "left_semi")
    if least > 0:
        first = first.select(rows.columns).union(rows.filter(small))
    other = slim.join(best, "sha").filter(F.col("own") != F.col("rank"))
    response = F.when(F.col("rank.has"), F.col("rank.id"))
    other = other.select("page_id", "uri", "sha", response.alias("of"), F.monotonically_increasing_id().cast("string").alias("row"))
    records = first.select("page_id", "uri", "payload").mapInArrow(responses, "value binary")
    records = records.union(other.mapInArrow(revisits, "value binary"))
    text = records.select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", BLANK.decode()).option("compression", "gzip").text(path)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        out[key.strip().lower()] = value.strip()
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in file order to records. What was cut at blank lines is put together again by length."""
    held = bytearray()
    fields: dict[str, str] | None = None
    rows: list[tuple] = []
    size = 0

    def number(name: str) -> int | None:
        return int(fields[name]) if name in fields else None

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 10
        kinds = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4, pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in RECORD.split(", ")])

    for batch in batches:
        for line in batch.column(0):
            held += line.as_py() + BLANK
            while True:
                if fields is None:
                    while held[:2] == b"\r\n":
                        del held[:2]
                    end = held.find(BLANK)
                    if end < 0:
                        break
                    fields = _fields(bytes(held[:end]))
                    del held[: end + 4]
                length = int(fields["content-length"])
                if len(held) < length:
                    break
                block = bytes(held[:length])
                del held[:length]
                rows.append(
                    (
                        fields.get("warc-record-id"), fields.get("warc-type"), number("warc-page-id"), fields.get("warc-target-uri"),
                        fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, fields.get("warc-refers-to"),
                        fields.get("warc-segment-origin-id"), number("warc-segment-number"), number("warc-segment-total-length"), block,
                    )
                )
                fields = None
                size += length
                if size > 8 << 20:
                    yield out()
                    rows, size = [], 0
    if rows:
        yield out()
    if fields is not None:
        raise ValueError("an archive ends inside a record")


def records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``, segments apart."""
    bound_batches(spark)
    lines = spark.read.option("lineSep", BLANK.decode()).text(path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(_parse, RECORD)


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by origin and number to whole records; equal copies of a record go side by side."""
    names = ["record_id", "type", "page_id", "uri", "digest", "refers_to", "block", "intact"]
    kinds = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * 3, pa.binary(), pa.bool_()]
    origin, copies, last, seen = None, [], 0, 0

    def out() -> Iterator[pa.RecordBatch]:
        for head, parts, total in copies:
            block = b"".join(parts)
            intact = total == len(block) and head is not None
            row = [*(head or (origin, "response", None, None, None, None)), block if intact else None, intact]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    for batch in batches:
        for row in range(batch.num_rows):
            group, number, total, *head, block = (c[row].as_py() for c in batch.columns)
            if group != origin:
                yield from out()
                origin, copies, last, seen = group, [], 0, 0
            seen = seen + 1 if number == last else 0
            if number not in (last, last + 1) or (number > 1 and seen >= len(copies)):
                copies = [(None, [], -1)] if not copies else [(h, p, -1) for h, p, _ in copies]  # a gap
            last = number
            if number == 1:
                copies.append((tuple(head), [block], None))
            elif seen < len(copies):
                first, parts, known = copies[seen]
                parts.append(block)
                copies[seen] = (first, parts, known if known == -1 else total)
    yield from out()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Whole records: record_id, type, page_id, uri, digest, refers_to, payload (of responses), intact."""
    found = records(spark, path)
    whole = found.filter("number is null").select("record_id", "type", "page_id", "uri", "digest", "refers_to", "block", F.lit(True).alias("intact"))
    group = F.coalesce("origin", "record_id").alias("origin")
    parts = found.filter("number is not null").select(group, "number", "total", "record_id", "type", "page_id", "uri", "digest", "refers_to", "block")
    parts = parts.repartition(parts_for(found), "origin").sortWithinPartitions("origin", "number")
    schema = "record_id string, type string, page_id bigint, uri string, digest string, refers_to string, block binary, intact boolean"
    both = whole.union(parts.mapInArrow(_join_segments, schema))

    @F.arrow_udf("binary")
    def payload(blocks: pa.Array) -> pa.Array:
        return pa.array([payload_of(x.as_py()) for x in blocks], pa.binary())

    return both.withColumn("payload", F.when(F.col("type") == "response", payload(F.col("block")))).drop("block")


def op10(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The contract of query 10: write all pages, read the archives back, one row for each page."""
    path = f"{work_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)

    @F.arrow_udf("string")
    def digest(payloads: pa.Array) -> pa.Array:
        return pa.array([None if not x.is_valid else digest32(x.as_py()) for x in payloads], pa.string())

    found = read(spark, path)
    # the digest of a response is taken from the decoded payload, never from its header
    slim = found.select(
        "record_id", "type", "page_id", "digest", "refers_to", F.octet_length("payload").cast("bigint").alias("bytes"),
        F.when(F.col("type") == "response", digest(F.col("payload"))).alias("own_digest"),
    )
    slim = materialize(slim, "warc-read")
    response = slim.filter("type = 'response'")
    first = response.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("of"), F.col("bytes").alias("of_bytes"))
    visits = slim.filter("type = 'revisit'").join(first.dropDuplicates(["refers_to"]), "refers_to", "left")
    out = response.select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"),
    )
    return out.union(visits.select("page_id", "of_bytes", "digest", "type", "of"))

"""WARC archives: writing segmented, chunked records and putting them together again.

A response is an HTTP message whose body has chunked framing. A message longer than the
segment limit is spread over a first record and continuation records, which name the first
record as their origin, count segments from 1, and may stand in other files. Equal payloads
are stored once; later ones are revisit records that refer to the stored one.

Each record is a gzip member of its own, so that readers can seek to it. A task packs records
into files of bounded size, a row each, which Spark's text writer puts down as they are: it
doesn't look at the bytes of a string. So files reach any storage that Spark reaches. What the
writer adds behind a row is an empty gzip member."""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh_path, settle

BREAK = b"\r\n\r\n"
#: Bytes of a record's block, records and compressed bytes of a file, bytes of a chunk.
SEGMENT, FILE_RECORDS, FILE_BYTES, CHUNK = 1 << 15, 1000, 1 << 23, 1 << 12
#: A gzip member without content.
EMPTY = bytes.fromhex("1f8b080000000000000303000000000000000000")
#: Shorter payloads are always stored.
LEAST_SHARED = 100

_READ = "file string, record_id string, record_type string, page_id long, segment int, origin string, total_length long, digest string, refers_to long, block binary"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload with chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The payload of chunked framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        line = data.index(b"\r\n", at)
        n = int(data[at:line].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        part, at = data[line + 2 : line + 2 + n], line + 4 + n
        if len(part) < n or data[at - 2 : at] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(part)


def record(fields: dict[str, object], block: bytes) -> bytes:
    """A record without the blank lines after it."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"%b%b: %d\r\n\r\n%b" % (head.encode(), b"Content-Length", len(block), block)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields, by lower-case name, and block of each record of an archive."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(BREAK, at)
        lines = data[at:end].decode().split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        n = int(fields["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n:
            raise ValueError("a record is cut short")
        yield fields, block
        at = end + 8 + n


def write_warc(pages: DataFrame, out: str, key: str = "page_id", url: str = "url", html: str = "html", segment: int = SEGMENT, file_records: int = FILE_RECORDS, date: str | None = None) -> None:
    """Write a record for each row under out (a gzip member each); date: that of the records,
    now unless given.

    A null payload is empty; a null url is left out. Of equal payloads of at least
    LEAST_SHARED bytes the row with the smallest key is the response and rows with other keys
    revisit it; rows that repeat its key are responses as well. Rows without a key are
    responses, and nothing refers to them. Other columns are not read."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.filter((F.length("payload") >= LEAST_SHARED) & F.col("page_id").isNotNull()).groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("_n"))
    first = first.filter("_n > 1").select("_digest", "first")
    rows = rows.join(first, F.col("digest") == F.col("_digest"), "left").withColumn("refers_to", F.when(F.col("first") < F.col("page_id"), F.col("first")))

    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for made in messages(batch):
                held.append(gzip.compress(made + BREAK, 6, mtime=0))
                size += len(held[-1])
                if len(held) >= file_records or size >= FILE_BYTES:
                    yield pa.RecordBatch.from_pydict({"file": pa.array([b"".join(held)], pa.binary())})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"file": pa.array([b"".join(held)], pa.binary())})

    def messages(batch: pa.RecordBatch) -> Iterator[bytes]:
        """The records of the rows of a batch."""
        for page_id, url, payload, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            name = f"<urn:page:{'none' if page_id is None else page_id}>"
            # header fields end at a line end
            where = None if url is None else re.sub(r"[\r\n]+", " ", url)
            fields = {"WARC-Type": "response", "WARC-Record-ID": name, "WARC-Date": date, "X-Page-Key": page_id, "WARC-Target-URI": where, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response"}
            head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
            if refers is not None:
                fields |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers}>"}
                yield record(fields, head)
                continue
            block = head + chunked(payload)
            parts = [block[i : i + segment] for i in range(0, len(block), segment)]
            if len(parts) == 1:
                yield record(fields, block)
                continue
            yield record(fields | {"WARC-Segment-Number": 1}, parts[0])
            for n, part in enumerate(parts[1:], 2):
                last = {"WARC-Segment-Total-Length": len(block)} if n == len(parts) else {}
                same = {k: fields[k] for k in ("WARC-Date", "X-Page-Key", "WARC-Target-URI", "WARC-Payload-Digest")}
                yield record({"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:page:{page_id}:{n}>", "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": n, **same, **last}, part)

    made = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, "file binary")
    # in Latin-1 the line end is just these bytes
    made.select(F.col("file").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).option("maxRecordsPerFile", 1).text(out)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives, a row each; gzip-compressed files are unpacked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                rows = []
                for fields, block in records(data):
                    number = lambda k: int(fields[k]) if fields.get(k, "").isdigit() or fields.get(k, "")[:1] == "-" else None  # noqa: B023, E731
                    refers = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("warc-refers-to", ""))
                    rows.append({
                        "file": file, "record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "page_id": number("x-page-key"), "segment": number("warc-segment-number"),
                        "origin": fields.get("warc-segment-origin-id"), "total_length": number("warc-segment-total-length"), "digest": fields.get("warc-payload-digest"),
                        "refers_to": refers and int(refers[1]), "block": block,
                    })
                for at in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 500], schema=_ARROW)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(read, _READ)


_ARROW = pa.schema([
    ("file", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("segment", pa.int32()), ("origin", pa.string()),
    ("total_length", pa.int64()), ("digest", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary()),
])


def reassemble(rows: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, digest, block: one row for each stored message.

    Records of one segment pass through. Others are grouped by the identifier of their origin
    record and their digest, put in order of segment number, and the length is compared with
    the total that the last segment states; a gap or another length is an error. Copies of
    one message (equal rows were written) come out as many times as they went in."""
    whole = rows.filter(F.col("segment").isNull()).select("page_id", "record_type", "refers_to", "digest", "block")
    return whole.unionByName(_joined(rows.filter(F.col("segment").isNotNull())))


def _joined(parts: DataFrame) -> DataFrame:
    """The messages of segments; a message is held whole by a task, so it may have 2 GB."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                origin, digest, page_id, total, copies, found = (c[0].as_py() for c in batch.slice(at, 1).columns)
                found = sorted((p["segment"], p["block"]) for p in found)
                block = b"".join(b for _, b in found)
                if not copies or [n for n, _ in found] != [*range(1, len(found) + 1)] or len(block) != total:
                    raise ValueError(f"segments don't make up {origin}")
                columns = ([page_id], ["response"], [None], [digest], [block], [copies])
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64()), strict=True)], ["page_id", "record_type", "refers_to", "digest", "block", "copies"])

    # of equal copies one is put together; the number of first segments counts them
    groups = parts.withColumn("origin", F.coalesce("origin", "record_id")).groupBy("origin", "digest").agg(
        F.max("page_id").alias("page_id"), F.max("total_length").alias("total"), F.count_if(F.col("segment") == 1).alias("copies"), F.collect_set(F.struct("segment", "block")).alias("parts"),
    )
    joined = groups.mapInArrow(join, "page_id long, record_type string, refers_to long, digest string, block binary, copies long")
    return joined.withColumn("_copy", F.explode(F.expr("sequence(1L, copies)"))).drop("copies", "_copy")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload, record_type, refers_to: the pages that write_warc() wrote.

    A revisit has the payload of the record that it refers to. Payloads are checked against
    the digests of their records."""

    return _decoded(reassemble(read_records(spark, path)))


def _payload(digest: str, block: bytes) -> bytes:
    head, _, body = block.partition(BREAK)
    body = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if digest != f"sha256:{hashlib.sha256(body).hexdigest()}":
        raise ValueError(f"a payload isn't the one of digest {digest}")
    return body


def _decoded(messages: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, digest, payload; a revisit has a null payload."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = zip(batch.column("record_type").to_pylist(), batch.column("digest").to_pylist(), batch.column("block"), strict=True)
            payload = [None if kind == "revisit" else _payload(digest, block.as_py()) for kind, digest, block in cells]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "record_type", "refers_to", "digest")), pa.array(payload, pa.binary())], ["page_id", "record_type", "refers_to", "digest", "payload"])

    return messages.mapInArrow(decode, "page_id long, record_type string, refers_to long, digest string, payload binary")


def with_payload(pages: DataFrame) -> DataFrame:
    """The rows of read_warc() with the payload of revisits filled in from their response."""
    shared = pages.filter(F.col("record_type") == "response").join(pages.filter(F.col("record_type") == "revisit").select(F.col("refers_to").alias("page_id")).distinct(), "page_id", "left_semi")
    shared = shared.dropDuplicates(["page_id", "digest"]).select(F.col("page_id").alias("_of"), F.col("digest").alias("_digest"), F.col("payload").alias("_payload"))
    out = pages.join(shared, (F.col("refers_to") == F.col("_of")) & (F.col("digest") == F.col("_digest")), "left")
    return out.select("page_id", "record_type", "refers_to", "digest", F.coalesce("payload", "_payload").alias("payload"))


def page_digests(pages: DataFrame, **kw) -> DataFrame:
    """Write all pages into the shared folder, read them back, and describe each.

    page_id, payload_bytes, payload_digest, record_type, refers_to; the first two and the
    digest are those of the full payload, for a revisit of the response's payload as read."""
    spark = pages.sparkSession
    out = fresh_path(spark, "warc")
    write_warc(pages, out, **kw)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole messages get the length and the digest of their payload instead of the block."""
        for batch in batches:
            lengths, digests, blocks = [], [], []
            for kind, digest, segment, block in zip(*(batch.column(c).to_pylist() for c in ("record_type", "digest", "segment", "block")), strict=True):
                body = None if kind == "revisit" or segment is not None else _payload(digest, block)
                lengths.append(None if body is None else len(body))
                digests.append(None if body is None else hashlib.sha256(body).hexdigest())
                blocks.append(None if segment is None else block)
            rest = [c for c in batch.schema.names if c != "block"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(blocks, pa.binary()), pa.array(lengths, pa.int64()), pa.array(digests, pa.string())], [*rest, "block", "payload_bytes", "payload_digest"])

    # the archives are read once: what is left of a record is short, but for segments
    rows = settle(read_records(spark, out).mapInArrow(describe, f"{_READ}, payload_bytes long, payload_digest string"))
    one = lambda df: df.select("page_id", "record_type", "refers_to", "digest", "payload_bytes", "payload_digest")
    joined = _decoded(_joined(rows.filter("segment is not null"))).select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    stored = settle(one(rows.filter("segment is null and record_type = 'response'")).unionByName(one(joined)))
    back = stored.groupBy(F.col("digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes"), F.max("payload_digest").alias("_sha"))
    again = rows.filter("record_type = 'revisit'").join(back, F.col("digest") == F.col("_digest"))
    again = again.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_sha").alias("payload_digest"), "record_type", "refers_to")
    return stored.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(again)

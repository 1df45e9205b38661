"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

Writing: pages are joined with the page that holds the response of their payload
(largest page_id of equal payloads), and each task writes its records to archives
of its own in the shared folder. Names are unique per attempt and only archives in
the manifest, which successful tasks return, are read: a lost executor leaves a
stray file at most.

Reading: one pass over each archive in small pieces: zlib inflates member by member,
``Content-Length`` frames the block, and block and payload digests are verified.
Memory is one record and one piece.

Defined cases: NULL html is the empty payload, NULL url the empty address. NULL page
ids are smaller than all others; of payloads whose ids are all NULL every record is a
response. Rows that repeat the largest id are responses all. Extra columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haberdash.llm.tables import new_folder, stored, table

# Payloads from this size on are written once; 0: all.
MIN_REVISIT_BYTES = 0
# Bytes of one archive, before it is closed and another begun.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 16

_VERSION = b"WARC/1.1"
_DATE = "1970-01-01T00:00:00Z"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks the format or a digest."""


@dataclass
class Record:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


def digest(data: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_record(headers: dict[str, str], block: bytes, level: int = 6) -> bytes:
    """One record as one gzip member."""
    headers = headers | {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}
    head = b"".join(f"{k}: {_one_line(v)}\r\n".encode() for k, v in headers.items())
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    whole = _VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"
    return pack.compress(whole) + pack.flush()


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def read_members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The inflated members of a gzip file that comes in pieces."""
    inflate, out, begun = zlib.decompressobj(31), [], False
    for piece in pieces:
        while piece:
            begun = True
            try:
                out.append(inflate.decompress(piece))
            except zlib.error as error:
                raise WarcError(f"broken gzip member: {error}") from error
            piece = b""
            if inflate.eof:
                yield b"".join(out)
                piece = inflate.unused_data
                inflate, out, begun = zlib.decompressobj(31), [], False
    if begun:
        raise WarcError("the last gzip member is cut off")


def parse_record(member: bytes) -> Record:
    """The one record of a member, framed by its length and verified."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or not version.startswith(b"WARC/"):
        raise WarcError("no WARC header")
    headers = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise WarcError(f"broken header line: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    if not headers.get("content-length", "").isdigit():
        raise WarcError("no Content-Length")
    length = int(headers["content-length"])
    block = rest[:length]
    if len(block) < length or rest[length:] != b"\r\n\r\n":
        raise WarcError("the block is not as long as Content-Length says")
    if headers.get("warc-block-digest") not in (None, f"sha1:{digest(block)}"):
        raise WarcError("the block digest is wrong")
    return Record(headers, block)


def http_payload(record: Record) -> bytes:
    """What follows the HTTP header of a response block."""
    return record.block.partition(b"\r\n\r\n")[2]


def _page_record(page_id, url, payload: bytes, refers_to, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": _DATE,
        "WARC-Target-URI": url or "",
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "X-Page-ID": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    if revisit:
        headers |= {"WARC-Profile": _REVISIT_PROFILE, "X-Refers-To-Page-ID": str(refers_to)}
    return write_record(headers, http if revisit else http + payload)


def _writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, records, done = None, "", 0, []
        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out, path, records = store.open_output_stream(f"{root}/{name}", compression=None), name, 0
                out.write(_page_record(page_id, url, (html or "").encode(), refers_to, revisit))
                records += 1
                if out.tell() >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{path}", records))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{path}", records))
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())],
            names=["path", "records"],
        )

    return write


def _with_scheme(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Archives of all pages under ``folder``; the manifest: path and number of records."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", "html", F.sha1(payload).alias("sum"))
    large = pages.select("page_id", F.sha1(payload).alias("sum")).where(F.octet_length(payload) >= min_bytes)
    newest = large.groupBy("sum").agg(F.max("page_id").alias("newest"))
    revisit = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    rows = keyed.join(newest, "sum", "left").select(
        "page_id",
        "url",
        "html",
        F.when(revisit, F.col("newest")).alias("refers_to"),
        revisit.alias("revisit"),
    )
    return stored(rows.mapInArrow(_writer(_with_scheme(folder), archive_bytes), "path string, records long"), "manifest")


_RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def _pieces(path: str) -> Iterator[bytes]:
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(name, compression=None) as stream:
        while piece := stream.read(READ_BYTES):
            yield piece


def read_pages(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """Rows of the page records of one archive, digests verified."""
    for member in read_members(pieces):
        record = parse_record(member)
        kind = record.headers.get("warc-type")
        if kind not in ("response", "revisit"):
            continue
        said = record.headers.get("warc-payload-digest", "").removeprefix("sha1:")
        payload = http_payload(record) if kind == "response" else None
        if payload is not None and said != digest(payload):
            raise WarcError("the payload digest is wrong")
        page, refers = record.headers.get("x-page-id"), record.headers.get("x-refers-to-page-id")
        yield (
            int(page) if page else None,
            record.headers.get("warc-target-uri"),
            len(payload) if payload is not None else int(record.headers["x-payload-length"]),
            said,
            kind,
            int(refers) if refers else None,
            payload,
        )


def _reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held, seen = [], 0, 0
                for row in read_pages(_pieces(path)):
                    seen += 1
                    held += len(row[-1] or b"")
                    rows.append(row if with_payload else (*row[:-1], None))
                    if len(rows) >= 1000 or (with_payload and held > 8 << 20):
                        yield _rows(rows)
                        rows, held = [], 0
                if seen != expected:
                    raise WarcError(f"{path} has {seen} records, the manifest {expected}")
                yield _rows(rows)

    return read


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(_RECORD)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RECORD)], schema=_RECORD)


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The page records of all archives of a manifest, each archive read by one task in order."""
    # One archive per task: their number follows the input.
    archives = max(1, manifest.count())
    spread = manifest.repartition(archives)
    return spread.mapInArrow(
        _reader(with_payload),
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary",
    )


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    manifest = write_archives(table(spark, folder, "pages"), new_folder(spark, "warc"))
    return read_archives(manifest, with_payload=False).drop("payload", "url")


# Base32 from a hex SHA-1, 5 bits at a time.
OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    sha1(coalesce(html, '')) AS hex
  FROM pages
),
bits AS (
  SELECT hex, string_agg(right('000' || bin(instr('0123456789abcdef', substr(hex, i, 1)) - 1), 4), '' ORDER BY i) AS b
  FROM (SELECT DISTINCT hex FROM p), range(1, 41) AS t(i) GROUP BY hex
),
five AS (SELECT hex, j, substr(b, 5 * j - 4, 5) AS s FROM bits, range(1, 33) AS t(j)),
base32 AS (
  SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(s, 1, 1) AS INT) + 8 * CAST(substr(s, 2, 1) AS INT) + 4 * CAST(substr(s, 3, 1) AS INT)
    + 2 * CAST(substr(s, 4, 1) AS INT) + CAST(substr(s, 5, 1) AS INT), 1), '' ORDER BY j) AS payload_digest
  FROM five GROUP BY hex
),
newest AS (SELECT hex, max(page_id) AS newest FROM p GROUP BY hex)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = newest THEN NULL ELSE newest END AS refers_to
FROM p JOIN newest USING (hex) JOIN base32 USING (hex)
"""

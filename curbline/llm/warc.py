"""WARC archives: one gzip member a record, written and read back sequentially.

An archive is a row ``(path, content)``, the schema of Spark's ``binaryFile`` source, so the reader
takes the table that :func:`write_archives` makes and ``*.warc.gz`` files alike.  Archives are closed at
``archive_bytes``, so a lost executor costs one archive and no task holds more than one besides
its batch.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

GZIP = 31  # zlib's window bits for one gzip member
SLICE = 1 << 16
RECORD_URN = "urn:curbline:page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = "path string, content binary, n_records long"
RECORDS = (
    "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, "
    "payload_bytes long, payload_digest string, digest_ok boolean, error string"
)


def _clean(value: str) -> str:
    """A header value has no control characters; they are written percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(page_id, url, payload: bytes, digest: str, refers_to, date: str, level: int) -> bytes:
    """The gzip member of one page: a response with its payload, or a revisit that has only the HTTP head."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Date", date)]
    if page_id is not None:
        headers.append(("WARC-Record-ID", f"<{RECORD_URN}{page_id}>"))
    if url is not None:
        headers.append(("WARC-Target-URI", _clean(url)))
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{RECORD_URN}{refers_to}>")]
    return _member([*headers, ("Content-Type", "application/http; msgtype=response")], block, level)


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_revisit_bytes: int = 100, archive_bytes: int = 2 << 20, date: str = "1970-01-01T00:00:00Z", level: int = 4,
) -> DataFrame:
    """Pack pages into archives: rows (path, content, n_records).

    Of pages with equal payloads of at least ``min_revisit_bytes`` the smallest id is the response and the
    others are revisits; shorter payloads are all responses.  A null payload is empty.  Pages
    with a null id never serve as the response of others, and rows that repeat the smallest id are all
    responses.  An empty table gives no archive.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    shared = (
        p.filter(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null").select("digest", "first")
    )
    # Staged, so that the join has plain exchanges on both sides and a hot payload's pages are split over tasks.
    joined = p.join(stage(shared, "warc-shared"), "digest", "left").withColumn("refers_to", F.when(F.coalesce(F.col("id") != F.col("first"), F.lit(True)), F.col("first")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, n = [], 0, 0

        def closed() -> pa.RecordBatch:
            content = b"".join(out)
            return pa.RecordBatch.from_pydict({"path": [f"pages-{hashlib.sha256(content).hexdigest()[:20]}.warc.gz"], "content": [content], "n_records": pa.array([n], pa.int64())})

        for batch in batches:
            for page_id, url, body, digest, refers in zip(*[batch.column(k) for k in range(5)]):
                if not out:
                    info = b"software: curbline\r\nformat: WARC File Format 1.1\r\n"
                    out.append(_member([("WARC-Type", "warcinfo"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], info, level))
                    size, n = len(out[0]), 0
                out.append(page_record(page_id.as_py(), url.as_py(), body.as_py(), digest.as_py(), refers.as_py(), date, level))
                size, n = size + len(out[-1]), n + 1
                if size >= archive_bytes:
                    yield closed()
                    out = []
        if out:
            yield closed()

    return joined.select("id", "url", "payload", "digest", "refers_to").mapInArrow(pack, ARCHIVES)


class MemberReader:
    """Walks the gzip members of an archive, decompressing at most a slice at a time ahead of what is asked for."""

    def __init__(self, data: bytes):
        self.data, self.at = memoryview(data), 0

    def members(self) -> Iterator[tuple[int, Iterator[bytes]]]:
        while self.at < len(self.data):
            start = self.at
            yield start, self._chunks()

    def _chunks(self) -> Iterator[bytes]:
        z = zlib.decompressobj(GZIP)
        while not z.eof:
            if self.at >= len(self.data):
                raise EOFError("archive ends within a gzip member")
            piece = self.data[self.at : self.at + SLICE]
            got = z.decompress(piece)
            self.at += len(piece) - len(z.unused_data)
            if got:
                yield got


def read_record(chunks: Iterator[bytes]) -> tuple[dict[str, str], Iterator[bytes]]:
    """Header fields (names in lower case) and the block, framed by its content length."""
    head = b""
    while (end := head.find(b"\r\n\r\n")) < 0:
        piece = next(chunks, None)
        if piece is None:
            raise ValueError("no end of the record's header")
        head += piece
    lines = head[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:20]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def block(left: int, rest: bytes) -> Iterator[bytes]:
        while left:
            piece, rest = rest[:left], rest[left:]
            if piece:
                left -= len(piece)
                yield piece
            else:
                rest = next(chunks, None)
                if rest is None:
                    raise EOFError("block is shorter than its content length")
        tail = rest + b"".join(chunks)
        if tail != b"\r\n\r\n":
            raise ValueError("content length does not meet the record's end")

    return fields, block(int(fields["content-length"]), head[end + 4 :])


def _digest_of(value: str | None) -> str | None:
    return value.partition(":")[2].lower() if value and value.lower().startswith("sha256:") else None


def parse_archive(path: str, data: bytes) -> Iterator[tuple]:
    """Rows of RECORDS for every response, revisit or broken record; reading stops where framing is lost."""
    reader = MemberReader(data)
    for start, chunks in reader.members():
        try:
            fields, block = read_record(chunks)
            kind, whole, body = fields.get("warc-type"), hashlib.sha256(), hashlib.sha256()
            http, length, promised = (b"" if fields.get("content-type", "").startswith("application/http") else None), 0, None
            for piece in block:
                whole.update(piece)
                if http is not None:
                    http += piece
                    if (cut := http.find(b"\r\n\r\n")) < 0:
                        continue
                    promised = re.search(rb"(?im)^content-length:\s*(\d+)", http[:cut])
                    piece, http = http[cut + 4 :], None
                body.update(piece)
                length += len(piece)
        except (EOFError, ValueError, KeyError, zlib.error) as e:
            yield path, start, None, None, None, None, None, None, False, f"{type(e).__name__}: {e}"
            return
        if kind not in ("response", "revisit"):
            continue
        claimed, refers = _digest_of(fields.get("warc-payload-digest")), fields.get("warc-refers-to")
        digest, n = (body.hexdigest(), length) if kind == "response" else (claimed, int(promised[1]) if promised else None)
        ok = _digest_of(fields.get("warc-block-digest")) in (None, whole.hexdigest()) and claimed in (None, digest)
        yield path, start, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), refers, n, digest, ok, None


def read_archives(archives: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Read archives (path, content) into records.

    A record whose digests do not match has ``digest_ok`` false; where framing or compression breaks, one
    row with ``error`` stands for the rest of that archive.  Null content has no records.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.bool_(), pa.string()]
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                if rows := list(parse_archive(path.as_py(), content.as_py() or b"")):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return archives.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).mapInArrow(read, RECORDS)

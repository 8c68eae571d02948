"""WARC archives: writing, normalising a monolithic gzip stream to a member per record, and reading by offset index.

Archives that were compressed as one gzip stream cannot be read from the middle. The normaliser inflates such a file once, as
a stream, rewrites each record as a gzip member of its own, and writes a sidecar index with the offset and length of every
member, by which any record can be read alone. A file is one task's work; memory holds one record at a time. Files are made
under names that no other attempt of a task uses, and the tables of file names that later steps read list only those of
tasks that ended well, so lost executors leave at most files that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gainsieve.llm.files import created, resolve
from gainsieve.sources.workspace import Workspace

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 20
#: Compression of the single stream, which is read once, and of the members.
STREAM_LEVEL, MEMBER_LEVEL = 1, 4
OUT_ROWS = 512
DATE = "2020-01-01T00:00:00Z"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def dump(self) -> bytes:
        lines = [VERSION, *(f"{k}: {v}".encode() for k, v in self.headers.items()), f"Content-Length: {len(self.block)}".encode(), b"", b""]
        return b"\r\n".join(lines) + self.block + b"\r\n\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?[0-9]+)>", urn or "")
    return int(found[1]) if found else None


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, response: bool, refers_to: int | None) -> Record:
    """A response with its payload, or a revisit whose block is the HTTP header alone."""
    headers = {"WARC-Type": "response" if response else "revisit", "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE}
    if url is not None:
        headers["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    headers["WARC-Payload-Digest"] = f"sha1:{digest}"
    if not response:
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to)}
    headers["Content-Type"] = "application/http; msgtype=response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return Record(headers, http + payload if response else http)


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Pieces of bounded size of a gzip file of one or several members."""
    inflate = zlib.decompressobj(31)
    for data in chunks:
        while data:
            yield inflate.decompress(data, READ_BYTES)
            data = inflate.unconsumed_tail
            if inflate.eof:
                data, inflate = inflate.unused_data, zlib.decompressobj(31)
    if tail := inflate.flush():
        yield tail


def records(pieces: Iterator[bytes]) -> Iterator[Record]:
    """Records of an inflated stream, one at a time; a stream that is cut short or malformed is an error."""
    buffer = bytearray()
    ended = False

    def more() -> None:
        nonlocal ended
        piece = next(pieces, None)
        if piece is None:
            ended = True
        else:
            buffer.extend(piece)

    while True:
        while not ended and len(buffer) < 4:
            more()
        if not buffer:
            return
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            if ended:
                raise ValueError("a WARC header is cut short")
            seen = len(buffer)
            more()
        first, *lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:60]!r}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        length = int(headers.pop("Content-Length"))
        upto = end + 4 + length + 4
        while len(buffer) < upto:
            if ended:
                raise ValueError("a WARC record is cut short")
            more()
        yield Record(headers, bytes(buffer[end + 4 : upto - 4]))
        del buffer[:upto]


def file_chunks(uri: str) -> Iterator[bytes]:
    system, path = resolve(uri)
    with system.open_input_stream(path, compression=None) as source:
        while data := source.read(READ_BYTES):
            yield data


def payload_of(record: Record) -> tuple[int, str]:
    """Length and digest of the full payload; a response's are those of its bytes, and must be what its header says."""
    head, _, body = record.block.partition(b"\r\n\r\n")
    digest = record.headers["WARC-Payload-Digest"].removeprefix("sha1:")
    length = int(re.search(rb"\r\nContent-Length: ([0-9]+)", head)[1])
    if record.headers["WARC-Type"] == "response" and (len(body), digest_of(body)) != (length, digest):
        raise ValueError(f"{record.headers['WARC-Record-ID']}: the payload does not match its digest")
    return length, digest


def write_streams(pages: DataFrame, ws: Workspace) -> DataFrame:
    """path: one archive for each partition that has rows, each a single gzip stream.

    pages has page_id, url, payload (binary), response (boolean) and refers_to.
    """
    folder = ws.new_path("streams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() if i != 2 else c for i, c in enumerate(batch.columns))))
        first = next(rows, None)
        if first is None:
            return
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        deflate = zlib.compressobj(STREAM_LEVEL, zlib.DEFLATED, 31)
        with created(path) as out:
            row = first
            while row is not None:
                page_id, url, payload, response, refers_to = row
                payload = payload.as_py() or b""
                out.write(deflate.compress(page_record(page_id, url, payload, digest_of(payload), response, refers_to).dump()))
                row = next(rows, None)
            out.write(deflate.flush())
        yield pa.RecordBatch.from_pydict({"path": [path]})

    return ws.table(pages.select("page_id", "url", "payload", "response", "refers_to").mapInArrow(run, "path string"), "stream-names")


def _each_file(paths: DataFrame, run: Callable[[str], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run for every file of a table (path), each in a task of its own."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from run(path)

    return paths.select("path").repartition(max(1, paths.count())).mapInArrow(tasks, schema)


def normalise(streams: DataFrame, ws: Workspace) -> DataFrame:
    """path (of an archive with a gzip member for each record), n_records, n_bytes, for each file of a table (path).

    Beside each archive stands ``path + ".idx"``: a JSON line with offset, length, type and id of every record.
    """
    folder = ws.new_path("archives")

    def run(stream: str) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/{stream.rsplit('/', 1)[-1].split('.')[0]}-{uuid.uuid4().hex[:8]}.warc.gz"
        n = at = 0
        with created(path) as out, created(f"{path}.idx") as index:
            for record in records(inflated(file_chunks(stream))):
                member = zlib.compress(record.dump(), MEMBER_LEVEL, wbits=31)
                out.write(member)
                entry = {"offset": at, "length": len(member), "type": record.headers.get("WARC-Type"), "id": record.headers.get("WARC-Record-ID")}
                index.write(json.dumps(entry).encode() + b"\n")
                n, at = n + 1, at + len(member)
        yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([at], pa.int64())})

    return ws.table(_each_file(streams, run, "path string, n_records long, n_bytes long"), "archive-names")


def index_lines(path: str) -> Iterator[dict]:
    rest = b""
    for data in file_chunks(f"{path}.idx"):
        *lines, rest = (rest + data).split(b"\n")
        yield from map(json.loads, lines)


def read_record(source, offset: int, length: int) -> Record:
    """The record of one member, read by its place in an open archive."""
    source.seek(offset)
    return next(records(iter([zlib.decompress(source.read(length), wbits=31)])))


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, read by its index entry."""

    def run(path: str) -> Iterator[pa.RecordBatch]:
        system, name = resolve(path)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        with system.open_input_file(name) as source:
            for entry in index_lines(path):
                record = read_record(source, entry["offset"], entry["length"])
                h = record.headers
                rows.append((page_of(h["WARC-Record-ID"]), *payload_of(record), h["WARC-Type"], page_of(h.get("WARC-Refers-To"))))
                if len(rows) == OUT_ROWS:
                    yield batch()
                    rows.clear()
        yield batch()

    return _each_file(archives, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, response, refers_to: of the records with equal payloads of min_bytes or more, all but those with
    the smallest page_id are revisits of it.

    A null text is an empty payload. Rows that repeat the smallest id are responses too; a null id is never the smallest,
    and is a response where its payload has no other id.
    """
    payload = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    digest = F.sha1("payload")
    same = rows.where(F.octet_length("payload") >= min_bytes).select("page_id", digest.alias("digest")).groupBy("digest")
    shared = same.agg(F.min("page_id").alias("smallest"), F.count("*").alias("n")).where("n > 1").select("digest", "smallest")
    revisit = F.col("smallest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("smallest"))
    return rows.withColumn("digest", digest).join(shared, "digest", "left").select(
        "page_id", "url", "payload", (~revisit).alias("response"), F.when(revisit, F.col("smallest")).alias("refers_to")
    )


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write a record for each page to single-stream archives, normalise them, and read them back by their index.

    One row for each input row: page_id, payload_bytes, payload_digest, record_type, refers_to. An empty table gives no
    archive and no row; columns other than page_id, url and html are ignored.
    """
    ws = Workspace(pages.sparkSession)
    return read_archives(normalise(write_streams(mark_revisits(pages, min_bytes=min_bytes), ws), ws))


ROUND_TRIP_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS smallest FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::INT >> ((3 - i % 4) * 5)::INT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = smallest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> smallest THEN smallest END AS refers_to
FROM f
"""

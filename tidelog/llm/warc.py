"""WARC archives with a compression dictionary.

Each task writes archives of bounded size. An archive (``.warc.zst``) begins with a
skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built from the
archive's own records; then each record is a frame of its own, compressed with it, so
that any record can be read alone. Records with equal payloads are written once: that
of the largest page id is a ``response``, the others are ``revisit`` records without a
body that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import materialize, work_dir
from tidelog.sources.arrow_files import open_fs

#: Payloads from this size on are written once.
LEAST_BYTES = 0
#: Uncompressed bytes after which an archive is closed.
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL = 65_536, 4 << 20, 6
# Fixed values of the format.
SKIPPABLE = 0x184D2A5D
SKIPPABLE_FIRST = 0x184D2A50
FRAME = 0xFD2FB528
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(page_id, url: str | None, payload: bytes, sha1: str, refers_to, revisit: bool) -> bytes:
    """One WARC record. A null page id or URL has no header."""
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{sha1}/{url}')}>"),
        ("WARC-Date", DATE),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    if page_id is not None:
        head.append(("WARC-Page-ID", str(page_id)))
    head.append(("WARC-Payload-Digest", f"sha1:{sha1}"))
    if revisit:
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        if refers_to is not None:
            head.append(("WARC-Refers-To-Page-ID", str(refers_to)))
        head.append(("WARC-Payload-Length", str(len(payload))))
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = status + (b"" if revisit else payload)
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut off")
    return headers, block.partition(b"\r\n\r\n")[2]


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary from records spread over the archive, at most ``SAMPLE_BYTES`` of them.

    Where there is too little to learn from, the dictionary is plain content of the records.
    """
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    samples = [r[:65_536] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def write_archive(records: list[bytes]) -> bytes:
    """The bytes of an archive."""
    raw = dictionary(records)
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(raw)
    shared = zstandard.ZstdCompressionDict(raw)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(packed)), packed, *map(compressor.compress, records)])


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, in order."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("the archive has no dictionary")
    raw = data[8 : 8 + size]
    if raw[:4] == struct.pack("<I", FRAME):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    rest = memoryview(data)[8 + size :]
    while len(rest):
        magic, size = struct.unpack_from("<II", rest) if len(rest) >= 8 else (FRAME, 0)
        if magic & 0xFFFFFFF0 == SKIPPABLE_FIRST:
            rest = rest[8 + size :]
            continue
        frame = opener.decompressobj()
        yield frame.decompress(rest)
        if not frame.eof:
            raise ValueError("the archive is cut off")
        rest = rest[len(rest) - len(frame.unused_data) :]


def responses(pages: DataFrame, *, least: int = LEAST_BYTES, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Pages with ``payload``, its ``sha1`` (hex) and ``first``, the page id that holds an equal payload."""
    payload = F.coalesce(F.col(html).cast("string").cast("binary"), F.lit(b""))
    slim = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    )
    slim = slim.withColumn("sha1", F.sha1("payload"))
    groups = slim.filter(F.length("payload") >= least).groupBy("sha1").agg(F.max("page_id").alias("first"))
    # Written, so that the join deals both sides anew and can split a payload of many pages.
    groups = materialize(groups, "payloads")
    return slim.join(groups, "sha1", "left")


def write(pages: DataFrame, folder: str, *, least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives below ``folder`` and returns ``path``, ``records`` and ``bytes`` of each.

    Equal payloads of at least ``least`` bytes are written once: in the record of the
    largest page id (of every row with this id, should the id repeat); other rows are
    revisits of it. Where no row of a payload has an id, all are responses. A null
    html is an empty payload. A task names its files by its attempt, and only files of
    attempts that succeeded are in the result; no row, no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, target = open_fs(folder)
        files.create_dir(target, recursive=True)
        context = TaskContext.get()
        stem = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        held: list[bytes] = []
        size, count = 0, 0

        def close() -> pa.RecordBatch:
            name = f"{target}/{stem}-{count:04d}.warc.zst"
            data = write_archive(held)
            with files.open_output_stream(name, compression=None) as out:
                out.write(data)
            return pa.record_batch(
                [pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"]), pa.array([len(held)]), pa.array([len(data)])],
                names=["path", "records", "bytes"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                payload, first, ident = row["payload"], row["first"], row["page_id"]
                revisit = first is not None and ident != first
                held.append(record(ident, row["url"], payload, digest(payload), first if revisit else None, revisit))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size, count = [], 0, count + 1
        if held:
            yield close()

    written = responses(pages, least=least).select("page_id", "url", "payload", "first")
    return materialize(written.mapInArrow(run, "path string, records long, bytes long"), "archives")


def read_back(archives: DataFrame) -> DataFrame:
    """One row for each record of the archives at ``path``.

    Columns ``page_id``, ``url``, ``payload_bytes`` and ``payload_digest`` (of the full
    payload, for a response checked against its body), ``record_type``, ``refers_to``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                files, name = open_fs(path)
                with files.open_input_stream(name, compression=None) as source:
                    data = source.read()
                rows = [_row(*parse(r)) for r in read_archive(data)]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    # A path is small, but its archive is not: the paths are dealt out to many tasks.
    tasks = 16 * archives.sparkSession.sparkContext.defaultParallelism
    spread = archives.select("path").repartition(max(1, min(archives.count(), tasks)))
    return spread.mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def _row(headers: dict[str, str], payload: bytes) -> tuple:
    sha1 = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = headers["WARC-Type"]
    size = int(headers["WARC-Payload-Length"]) if kind == "revisit" else len(payload)
    if kind == "response" and digest(payload) != sha1:
        raise ValueError("a payload differs from its digest")
    number = lambda name: int(headers[name]) if name in headers else None
    return number("WARC-Page-ID"), headers.get("WARC-Target-URI"), size, sha1, kind, number("WARC-Refers-To-Page-ID")


def round_trip(pages: DataFrame, *, least: int = LEAST_BYTES) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads the archives back.

    Columns ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.
    """
    folder = work_dir(pages.sparkSession, "warc")
    rows = read_back(write(pages, folder, least=least))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

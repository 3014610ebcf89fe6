"""WARC archives: exact round trips, the format, roles of the records."""

import base64
import hashlib
import random
import struct
from collections import Counter

import pytest
import zstandard

from tidelog.llm import warc


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(pages, least=0):
    rows = []
    for ident, _, html in pages:
        size = len((html or "").encode())
        same = [i for i, _, other in pages if (other or "") == (html or "") and i is not None]
        first = max(same) if same and size >= least else None
        revisit = first is not None and ident != first
        rows.append((ident, size, sha1(html), "revisit" if revisit else "response", first if revisit else None))
    return Counter(rows)


PAGES = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "u", ""), (None, "u", "")]
PAGES += [(5, "u", "x" * 300_000), (None, "u", "lone"), (None, "u", "lone"), (7, "u", "WARC/1.1\r\n\r\n\0"), (2, "http://b", "<p>é</p>")]
PAGES += [(k, f"http://{k}", f"<html>{'page ' * (k % 50)}{k % 40}</html>") for k in range(100, 300)]


@pytest.mark.parametrize("least", [0, 10, 1000])
def test_round_trip(spark, least):
    frame = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, sha1 string")
    assert Counter(map(tuple, warc.round_trip(frame, least=least).collect())) == expected(PAGES, least)


def test_archives_are_cut_and_complete(spark, tmp_path):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    written = warc.write(frame, f"file://{tmp_path}/w", archive_bytes=5000)
    rows = written.collect()
    assert len(rows) > 3 and sum(r.records for r in rows) == len(PAGES)
    back = warc.read_back(written).collect()
    assert Counter(r.page_id for r in back) == Counter(p[0] for p in PAGES)
    assert {r.url for r in back if r.page_id == 1} == {"http://a/ X: y"}


def test_empty(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(frame).count() == 0


@pytest.mark.parametrize("count", [1, 3, 400])
def test_archive_format(count):
    rng = random.Random(count)
    payloads = [f"<html><body>{'shared words ' * 20}{rng.random()}</body></html>".encode() * rng.randint(0, 3) for _ in range(count)]
    records = [warc.record(k, f"http://{k}", p, warc.digest(p), None, False) for k, p in enumerate(payloads)]
    data = warc.write_archive(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and list(warc.read_archive(data)) == records
    assert [warc.parse(r)[1] for r in warc.read_archive(data)] == payloads
    # The first frame alone, read as any reader would.
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    assert opener.decompressobj().decompress(data[8 + size :]) == records[0]
    if count > 100:
        plain = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in records)
        assert len(data) < plain
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.read_archive(data[:-3]))

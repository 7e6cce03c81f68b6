import hashlib
import io
import struct
import zipfile

import pytest

from corvane.llm import warc

SCHEMA = "page_id long, url string, html string"


def plain(rows):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == body and j is not None]
        first = min(same, default=None)
        revisit = len(body) >= 100 and first is not None and i != first
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(map(str, out))


def back(spark, rows, archive_bytes=warc.ARCHIVE_BYTES):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", digest string")
    archives = warc.write_archives(warc.with_revisits(df), warc.new_folder(spark), archive_bytes)
    return archives, warc.read_archives(archives, payloads=True)


def test_round_trip(spark):
    page = "<p>é" + "x" * 120
    rows = [(5, "http://a", page), (3, None, page), (9, "u\r\nv", page), (1, "http://b", "tiny"), (2, "http://b", "tiny"), (4, "c", None), (6, "c", ""), (None, "n", page), (None, "n", "y" * 200), (7, "d", "z" * 300_000), (5, "http://a", page)]
    for limit in (warc.ARCHIVE_BYTES, 1):
        archives, read = back(spark, rows, limit)
        got = read.collect()
        assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == plain(rows)
        bodies = {r.page_id: bytes(r.payload) for r in got if r.payload is not None and r.page_id is not None}
        assert bodies == {3: page.encode(), 1: b"tiny", 2: b"tiny", 4: b"", 6: b"", 7: b"z" * 300_000}
        assert archives.count() == len(rows) if limit == 1 else True


def test_empty_table(spark):
    archives, read = back(spark, [])
    assert archives.count() == 0 and read.collect() == []


def test_members_are_stored_and_readable_by_others(spark):
    archive = warc.Archive()
    archive.add("1", "http://x", b"body" * 50, None)
    raw = archive.packed()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {0}
    members = {m.name: m for m in warc.directory(io.BytesIO(raw), len(raw))}
    start = warc.data_start(io.BytesIO(raw), members[warc.DATA])
    assert raw[start : start + members[warc.DATA].size] == bytes(archive.data)


def zip64(raw):
    """The same archive with all sizes and offsets in ZIP64 fields."""
    members = warc.directory(io.BytesIO(raw), len(raw))
    end = raw.rfind(b"PK\x05\x06")
    start = struct.unpack_from("<I", raw, end + 16)[0]
    out = raw[:start]
    full = 0xFFFFFFFF
    for m in members:
        name, extra = m.name.encode(), struct.pack("<HHQQQ", 1, 24, m.size, m.packed, m.header)
        out += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, full, full, len(name), len(extra), 0, 0, 0, 0, full) + name + extra
    size, far = len(out) - start, len(out)
    out += struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, len(members), len(members), size, start)
    out += struct.pack("<4sIQI", b"PK\x06\x07", 0, far, 1)
    return out + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, full, full, 7) + b"comment"


def test_zip64_directory():
    archive = warc.Archive()
    for i in range(20):
        archive.add(str(i), None, b"p" * i, "0" if i % 3 == 1 else None)
    raw = archive.packed()
    wide = zip64(raw)
    assert warc.directory(io.BytesIO(wide), len(wide)) == warc.directory(io.BytesIO(raw), len(raw))
    assert list(warc.records(io.BytesIO(wide), len(wide))) == list(warc.records(io.BytesIO(raw), len(raw)))


def test_broken_archives_are_told():
    archive = warc.Archive()
    archive.add("1", None, b"x" * 200, None)
    raw = archive.packed()
    for bad in (b"", raw[:-30], raw[:40] + b"\x00" * 50 + raw[90:]):
        with pytest.raises(Exception):  # noqa: B017
            list(warc.records(io.BytesIO(bad), len(bad)))

"""WARC records in ZIP-packaged archives, written and read by ranges.

An archive is a ZIP file with stored (uncompressed) members: a WARC file whose
records are compressed one by one, an index line for each record with its range
in that file, and a short description. The reader takes nothing out of the ZIP:
it finds the end-of-directory record (the ZIP64 one if there is one), parses the
central directory, locates the members' data behind their local headers, reads
the index, and then reads each record by its byte range.

Files lie in a folder that all executors share, reached through pyarrow's file
systems. An archive is built in memory (one record, or about ARCHIVE_BYTES),
written under a name of its own and listed in the result of the writing task, so
that what a lost or repeated task has left behind is never read.

Payloads are HTML in UTF-8; null HTML is an empty payload. Among records with
equal payloads of at least MIN_REVISIT bytes those with the smallest id are
responses and the others revisits of it. A null id is larger than all; if all are
null, all are responses, and so are rows that repeat the smallest id. A very long
payload is one record. Only the three named columns are read, so that other names
can't clash. An empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path, scratch, text_chunks

ARCHIVE_BYTES = 16 << 20
MIN_REVISIT = 100
DATA, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
DATE = "2024-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The end-of-directory record with the longest comment, and the ZIP64 locator before it.
TAIL = 22 + 0xFFFF + 20


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if re.match(r"file:|/", uri):
        return pyarrow.fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return pyarrow.fs.FileSystem.from_uri(uri)


# --- records ---


def _urn(page_id: str | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> str | None:
    return (urn or "").removeprefix("<urn:x-page:").removesuffix(">") or None


def make_record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, digest: str) -> bytes:
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\r\n]+", " ", url or "") or f"urn:x-page:{'' if page_id is None else page_id}"
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _urn(page_id),
        "WARC-Target-URI": target,
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha256:{digest}",
        **({"WARC-Profile": IDENTICAL, "WARC-Refers-To": _urn(refers_to)} if revisit else {}),
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class Record(NamedTuple):
    page_id: str | None
    url: str | None
    record_type: str
    refers_to: str | None
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


def parse_record(raw: bytes) -> Record:
    if not raw.startswith(b"WARC/"):
        raise ValueError("no WARC record here")
    cut = raw.index(b"\r\n\r\n")
    head = _headers(raw[:cut])
    block = raw[cut + 4 : cut + 4 + int(head["content-length"])]
    end = block.index(b"\r\n\r\n")
    stated = head["warc-payload-digest"].removeprefix("sha256:")
    if head["warc-type"] == "revisit":
        size, payload, digest = int(_headers(block[:end])["content-length"]), None, stated
    else:
        payload = block[end + 4 :]
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if digest != stated:
            raise ValueError(f"the payload of {head['warc-record-id']} differs from its digest")
    return Record(_page(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], _page(head.get("warc-refers-to")), size, digest, payload)


# --- archives ---


class Archive:
    """One archive that is being built in memory."""

    def __init__(self) -> None:
        self.data, self.lines = bytearray(), []

    def add(self, page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> None:
        digest = hashlib.sha256(payload).hexdigest()
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(make_record(page_id, url, payload, refers_to, digest)) + packer.flush()
        place = {"offset": len(self.data), "length": len(packed), "digest": f"sha256:{digest}", "mime": "warc/revisit" if refers_to is not None else "text/html", "filename": DATA}
        self.lines.append(f"{_urn(page_id)} {re.sub(r'[^0-9]', '', DATE)} {json.dumps(place)}\n")
        self.data += packed

    def packed(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, body in ((DATA, bytes(self.data)), (INDEX, "".join(sorted(self.lines)).encode()), (ABOUT, json.dumps({"profile": "data-package", "created": DATE}).encode())):
                z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), body)
        return out.getvalue()


class Member(NamedTuple):
    name: str
    method: int
    packed: int
    size: int
    header: int


def _at(f: BinaryIO, offset: int, size: int) -> bytes:
    f.seek(offset)
    got = f.read(size)
    if len(got) != size:
        raise ValueError("the archive is cut short")
    return got


def directory(f: BinaryIO, size: int) -> list[Member]:
    """The members in the central directory of a ZIP or ZIP64 file of `size` bytes."""
    tail_at = max(0, size - TAIL)
    tail = _at(f, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of a ZIP directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        far = _at(f, struct.unpack_from("<Q", tail, end - 12)[0], 56)
        if far[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of directory where its locator points")
        count, length, start = struct.unpack_from("<QQQ", far, 32)
    entries, at, out = _at(f, start, length), 0, []
    for _ in range(count):
        if entries[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken ZIP directory")
        flags, method = struct.unpack_from("<HH", entries, at + 8)
        packed, plain, name_size, extra_size, note_size = struct.unpack_from("<IIHHH", entries, at + 20)
        header = struct.unpack_from("<I", entries, at + 42)[0]
        name = entries[at + 46 : at + 46 + name_size].decode("utf-8" if flags & 0x800 else "cp437")
        extra = entries[at + 46 + name_size : at + 46 + name_size + extra_size]
        where = 0
        while where + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, where)
            if kind == 1:  # 64-bit values, only of the fields that are full
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, where + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            where += 4 + n
        out.append(Member(name, method, packed, plain, header))
        at += 46 + name_size + extra_size + note_size
    return out


def data_start(f: BinaryIO, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; ranges need a stored member")
    local = _at(f, member.header, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))


def records(f: BinaryIO, size: int) -> Iterator[Record]:
    """All records of an archive, each by its range, in the order of the data."""
    members = {m.name: m for m in directory(f, size)}
    starts = {name: data_start(f, m) for name, m in members.items() if m.name.startswith("archive/")}
    places = []
    for name, m in members.items():
        if name.startswith("indexes/") and name.endswith(".cdxj"):
            for line in _at(f, data_start(f, m), m.size).decode().splitlines():
                place = json.loads(line.split(" ", 2)[2])
                if place["offset"] + place["length"] > members[place["filename"]].size:
                    raise ValueError("an index entry lies outside its member")
                places.append((place["filename"], place["offset"], place["length"]))
    for name, offset, length in sorted(places):
        yield parse_record(zlib.decompress(_at(f, starts[name] + offset, length), 31))


# --- tables ---


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, refers_to) of each row; refers_to is null for responses."""
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= MIN_REVISIT, F.sha2("html", 256)))
    # Only ids and digests meet by digest, so that a popular payload goes to no single task; texts meet what is known of them by id.
    with scratch(pages.sparkSession) as stay:
        digests = materialize(rows.where("digest is not null").select("page_id", "digest"), "digests")
        firsts = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
        firsts = materialize(firsts, "firsts")
        late = digests.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("late_id"), F.col("digest").alias("late_digest"), F.col("first").alias("refers_to"))
        late = materialize(late.distinct(), "revisits")
        stay.append(late)
    joined = rows.join(late, F.col("page_id").eqNullSafe(F.col("late_id")) & (F.col("digest") == F.col("late_digest")), "left")
    return joined.select("page_id", "url", "html", "refers_to")


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows(page_id, url, html, refers_to) to archives below folder; (path, size, records) of each."""
    source = rows.select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(folder)
        fs.create_dir(top, recursive=True)

        def close(archive: Archive) -> pa.RecordBatch:
            body, name = archive.packed(), f"pages-{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(f"{top}/{name}") as f:
                f.write(body)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "size": [len(body)], "records": [len(archive.lines)]})

        archive = Archive()
        for part in text_chunks(batches, "html"):
            for row in part.to_pylist():
                archive.add(row["page_id"], row["url"], row["html"].encode("utf-8", "surrogatepass"), row["refers_to"])
                if len(archive.data) >= archive_bytes:
                    yield close(archive)
                    archive = Archive()
        if archive.lines:
            yield close(archive)

    return materialize(source.mapInArrow(run, "path string, size long, records long"), "archives")


def read_archives(archives: DataFrame, id_type: str = "long", payloads: bool = False) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of each record in archives(path, size).

    payload is null unless payloads is set, and for revisits.
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def batch(found: list[Record]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([getattr(r, n) if n != "payload" or payloads else None for r in found], k) for n, k in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for row in part.to_pylist():
                fs, path = file_system(row["path"])
                held, found = 0, []
                with fs.open_input_file(path) as f:
                    for record in records(f, row["size"]):
                        found.append(record)
                        held += record.payload_bytes if payloads else 100
                        if held > 4 << 20:
                            yield batch(found)
                            held, found = 0, []
                if found:
                    yield batch(found)

    spread = archives.select("path", "size").repartition(max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")
    read = spread.mapInArrow(run, "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")
    return read.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def new_folder(spark, name: str = "warc") -> str:
    return new_path(spark, name)

"""ZIP and tar archives as a source: members are read where they lie, by ranges, in many tasks.

`spark.read.format("members").load(uri)` gives (name, size, content). Of a ZIP the planner reads the central
directory (with its ZIP64 records) and cuts it into slices of about SLICE_BYTES of members; a task reads its slice of the
directory again and then its members, stored or deflated. Of a plain tar the planner hops from header to header.
What it plans has a size for each slice, not for each member. A compressed tar can't be entered in the middle: one
task reads it as a stream. Nothing is written to disk.

Every name is looked at before any slice is planned: one that leads out of the archive's folder refuses the whole archive, as
do encrypted members and unknown ways of compression when they are read. Names ending in / are folders, with null content.
"""

from __future__ import annotations

import io
import struct
import tarfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane.sources.runs import archive_kind
from corvane.sources.walk import file_system

SCHEMA = "name string, size long, content binary"
ARROW = pa.schema([("name", pa.string()), ("size", pa.int64()), ("content", pa.binary())])
#: Bytes of members, as they are stored, that a task reads; a member is never cut.
SLICE_BYTES = 64 << 20
#: Bytes of content that a task hands on at a time.
HELD = 8 << 20
_END, _END64, _PLACE64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


class OutsideArchive(ValueError):
    """A member's name leads out of the archive's folder."""


def checked(name: str) -> str:
    steps = 0
    for part in name.replace("\\", "/").split("/"):
        steps += -1 if part == ".." else part not in ("", ".")
        if steps < 0:
            break
    if steps < 0 or name.startswith(("/", "\\")) or name[1:2] == ":":
        raise OutsideArchive(f"{name} lies outside the archive's folder")
    return name


@dataclass(frozen=True)
class Member:
    name: str
    size: int
    stored: int
    method: int
    flags: int
    offset: int


@dataclass(frozen=True)
class Slice(InputPartition):
    start: int
    length: int
    first: int = 0


def zip_directory(f: BinaryIO, size: int) -> tuple[int, int]:
    """Where the central directory lies, and how long it is."""
    f.seek(max(0, size - 22 - 0xFFFF))
    tail_at, tail = f.tell(), f.read()
    at = tail.rfind(_END)
    if at < 0:
        raise ValueError("no ZIP archive: its end record is missing")
    length, start = struct.unpack("<II", tail[at + 12 : at + 20])
    if tail[max(0, at - 20) : at][:4] == _PLACE64:
        f.seek(struct.unpack("<Q", tail[at - 12 : at - 4])[0])
        end64 = f.read(56)
        if end64[:4] != _END64:
            raise ValueError("no ZIP archive: its ZIP64 end record is missing")
        length, start = struct.unpack("<QQ", end64[40:56])
    elif start + length > tail_at + at:
        raise ValueError("no ZIP archive: its directory is cut")
    return start, length


def zip_members(f: BinaryIO, start: int, length: int) -> Iterator[tuple[int, Member]]:
    """(place in the directory, member) of a stretch of the central directory, which begins with a member."""
    at, end, buffer, base = start, start + length, b"", start
    while at < end:
        if len(buffer) - (at - base) < 46 + 3 * 0xFFFF:
            f.seek(at)
            base, buffer = at, f.read(min(end - at, 1 << 20))
        entry = buffer[at - base :]
        if entry[:4] != _ENTRY:
            raise ValueError("a ZIP directory entry is broken")
        flags, method = struct.unpack("<HH", entry[8:12])
        stored, size, n, extra, comment = struct.unpack("<IIHHH", entry[20:34])
        offset = struct.unpack("<I", entry[42:46])[0]
        fields, more = entry[46 + n : 46 + n + extra], 0
        while more + 4 <= len(fields):
            kind, long = struct.unpack("<HH", fields[more : more + 4])
            if kind == 1:
                values = iter(struct.unpack(f"<{long // 8}Q", fields[more + 4 : more + 4 + long // 8 * 8]))
                size, stored, offset = (next(values) if x == 0xFFFFFFFF else x for x in (size, stored, offset))
            more += 4 + long
        raw = entry[46 : 46 + n]
        yield at, Member(raw.decode("utf-8" if flags & 0x800 else "cp437", "replace"), size, stored, method, flags, offset)
        at += 46 + n + extra + comment


def zip_content(f: BinaryIO, m: Member) -> bytes:
    if m.flags & 1:
        raise ValueError(f"{m.name} is encrypted")
    f.seek(m.offset)
    head = f.read(30)
    if head[:4] != _LOCAL:
        raise ValueError(f"{m.name}: its header is missing")
    f.seek(m.offset + 30 + sum(struct.unpack("<HH", head[26:30])))
    raw = f.read(m.stored)
    if m.method == 0:
        return raw
    if m.method == 8:
        return zlib.decompress(raw, -15)
    raise ValueError(f"{m.name}: way {m.method} of compression isn't known")


def _tar_members(f: BinaryIO, limit: int | None = None) -> Iterator[tuple[int, tarfile.TarInfo, BinaryIO]]:
    """(place of the header, member, its content) of a tar from where the file stands, by hops."""
    with tarfile.open(fileobj=f, mode="r:") as t:
        while (member := t.next()) is not None and (limit is None or member.offset < limit):
            t.members = []  # else tarfile remembers all of them
            yield member.offset, member, t


class MembersReader(DataSourceReader):
    def __init__(self, uri: str, slice_bytes: int) -> None:
        self.uri, self.slice_bytes, self.kind = uri, slice_bytes, archive_kind(uri)
        if self.kind == "7z":
            raise ValueError("7z archives can't be read by ranges")
        self.plain = self.kind == "zip" or uri.lower().endswith(".tar")

    def _open(self) -> tuple[BinaryIO, int]:
        fs, path = file_system(self.uri)
        return fs.open_input_file(path), fs.get_file_info(path).size

    def partitions(self) -> list[Slice]:
        f, size = self._open()
        with f:
            if self.kind == "zip":
                start, length = zip_directory(f, size)
                places = ((at, checked(m.name) and m.stored) for at, m in zip_members(f, start, length))
                return self._sliced(places, start + length)
            if self.plain:
                return self._sliced(((at, checked(m.name) and m.size) for at, m, _ in _tar_members(f)), size)
        with self._stream() as t:
            for m in t:
                checked(m.name)
        return [Slice(0, size)]

    def _sliced(self, places: Iterator[tuple[int, int]], end: int) -> list[Slice]:
        out, begin, held = [], None, 0
        for at, size in places:
            if begin is None:
                begin = at
            elif held + size > self.slice_bytes:
                out.append(Slice(begin, at - begin))
                begin, held = at, 0
            held += size + 512
        return out + ([Slice(begin, end - begin)] if begin is not None else [])

    def _stream(self) -> tarfile.TarFile:
        fs, path = file_system(self.uri)
        return tarfile.open(fileobj=fs.open_input_stream(path, compression=None), mode="r|*")

    def read(self, part: Slice | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # an empty archive
            return
        rows, size = [], 0
        for name, content in self._contents(part):
            rows.append({"name": checked(name), "size": len(content or b""), "content": content})
            size += len(content or b"") + 200
            if size > HELD:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def _contents(self, part: Slice) -> Iterator[tuple[str, bytes | None]]:
        if not self.plain:
            with self._stream() as t:
                for m in t:
                    yield from self._of_tar(m, t)
            return
        f, _ = self._open()
        with f:
            if self.kind == "zip":
                for _, m in zip_members(f, part.start, part.length):
                    yield m.name, None if m.name.endswith("/") else zip_content(f, m)
                return
            for _, m, t in _tar_members(_From(f, part.start), part.length):
                yield from self._of_tar(m, t)

    @staticmethod
    def _of_tar(m: tarfile.TarInfo, t: tarfile.TarFile) -> Iterator[tuple[str, bytes | None]]:
        if m.isdir():
            yield m.name.rstrip("/") + "/", None
        elif m.isfile():
            yield m.name, t.extractfile(m).read()


class _From(io.RawIOBase):
    """A file as it looks from a place on."""

    def __init__(self, f: BinaryIO, start: int) -> None:
        self.f, self.start = f, start
        f.seek(start)

    def read(self, n: int = -1) -> bytes:
        return self.f.read(n)

    def seek(self, to: int, whence: int = 0) -> int:
        self.f.seek(to + self.start if whence == 0 else to, whence)
        return self.tell()

    def tell(self) -> int:
        return self.f.tell() - self.start


class Members(DataSource):
    """Options: slice_bytes."""

    @classmethod
    def name(cls) -> str:
        return "members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MembersReader:
        return MembersReader(self.options["path"], int(self.options.get("slice_bytes", SLICE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Members)

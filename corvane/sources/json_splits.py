"""JSON files of any size, read by many tasks at once.

Spark reads a file as text cut at commas, so that its splits go to tasks of their own, on any
file system. What a split's bytes mean depends on what comes before, so three passes read it:

1. Each split is summed up for either way it may begin, outside or inside a string: how many quotes
   it has and what it adds to the depth. From that follows how each split really begins.
2. Each split tells the text before its first cut and after its last one, and the containers and keys
   that are open at its end. Cuts are commas, brackets and colons down to a level of nesting. From that
   follow the containers and keys around each split, and the pieces that lie across splits.
3. Each split gives the pieces between its cuts.

A task holds a batch of text and a piece. The driver gets some hundred bytes for each split, of MAX_SPLITS at
most; the pieces across splits of one file meet in one task, one for each split.

Defined cases: a byte order mark is left out and told; blank files have root `empty`, while Spark lists no file without a byte. A file that ends
inside its root, or has more after it, has an error; its complete pieces are given all the same.
Bytes that aren't UTF-8 become U+FFFD where text is read. A piece is not checked to be JSON, and nothing between
two commas is no piece.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import exprs as X
from corvane.session import stored

#: More splits than this in one read is an error; larger splits (spark.sql.files.maxPartitionBytes) are the way out.
MAX_SPLITS = 100_000
#: Bytes of pieces that a task hands on at a time.
HELD = 4 << 20

_OPEN, _CLOSE, _COLON, _QUOTE = b"[{", b"]}", ord(":"), ord('"')
_MARKS = np.zeros(256, bool)
_MARKS[list(b"[]{},:")] = True
_STEP = np.zeros(256, np.int8)
_STEP[list(_OPEN)], _STEP[list(_CLOSE)] = 1, -1
_BLANK = b" \t\r\n"

PIECES = "file long, number long, pos long, depth int, container string, key_numbers array<long>, keys array<string>, text binary"


@dataclass
class JsonFiles:
    """files(file, path, name, size, root, bom, error) and pieces, each with the number of its cut in the file.

    A piece has the keys around it, the key's own included; a key gives a piece without text of its own.
    Values have pos, their place among the values of the file.
    """

    files: DataFrame  # no more than MAX_SPLITS, so that they can be broadcast
    pieces: DataFrame
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    """(file, block, text) of rows that stand together, their commas put back."""
    for batch in batches:
        file, block = (batch.column(c).to_numpy() for c in ("file", "block"))
        ends = np.flatnonzero(np.append((file[1:] != file[:-1]) | (block[1:] != block[:-1]), True)) + 1
        texts, start = batch.column("value").to_pylist(), 0
        for end in ends.tolist():
            yield int(file[start]), int(block[start]), b",".join(texts[start:end]) + b","
            start = end


def _plain(data: bytes) -> bytes:
    """The same without escapes, character by character, so that each quote that is left begins or ends a string."""
    return data.replace(b"\\\\", b"  ").replace(b'\\"', b"  ") if b"\\" in data else data


class _Reader:
    """Where a text's brackets, commas and colons stand outside strings, and how deep."""

    def __init__(self, inside: bool, depth: int) -> None:
        self.inside, self.depth = inside, depth

    def marks(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(_plain(data), np.uint8)
        within = (np.cumsum(raw == _QUOTE, dtype=np.int32) + self.inside) & 1
        at = np.flatnonzero(_MARKS[raw] & (within == 0))
        steps = _STEP[raw[at]]
        after = self.depth + np.cumsum(steps, dtype=np.int64)
        if len(within):
            self.inside = bool(within[-1])
        if len(after):
            self.depth = int(after[-1])
        return at, raw[at], after + (steps < 0)


class _Cutter:
    """Cuts of a split: (text before it, its character, depth of the container that it belongs to)."""

    def __init__(self, inside: bool, depth: int, level: int) -> None:
        self.reader, self.level = _Reader(inside, depth), level
        self.parts: list[bytes] = []

    def cuts(self, data: bytes) -> Iterator[tuple[bytes, int, int]]:
        at, char, depth = self.reader.marks(data)
        keep = (depth <= self.level) & ((char != _COLON) | (depth < self.level))
        last = 0
        for p, c, d in zip(at[keep].tolist(), char[keep].tolist(), depth[keep].tolist(), strict=True):
            self.parts.append(data[last:p])
            yield b"".join(self.parts), c, d
            self.parts, last = [], p + 1
        self.parts.append(data[last:])

    @property
    def open(self) -> bytes:
        """What stands after the last cut."""
        return b"".join(self.parts)


class _Stack:
    """For each depth the container that is open, the last key in it and the number of the key's cut."""

    def __init__(self, level: int, state: str | None = None) -> None:
        self.at: list[list] = json.loads(state) if state else [[None, None, None] for _ in range(level + 1)]

    def dump(self) -> str:
        return json.dumps(self.at)

    def apply(self, text: bytes, char: int, depth: int, number: int) -> None:
        if char in _OPEN:
            self.at[depth] = [chr(char), None, None]
        elif char == _COLON:
            self.at[depth][1:] = [_key(text), number]

    def merge(self, later: _Stack) -> None:
        for own, new in zip(self.at, later.at, strict=True):
            if new[0]:
                own[:] = new
            elif new[2] is not None:
                own[1:] = new[1:]

    def row(self, text: bytes, char: int, depth: int, number: int, pos: int) -> tuple | None:
        """The piece that a cut ends, once apply() has seen it; None if there is none."""
        if char == _COLON:
            return (number, None, depth, *self._around(depth), None)
        if char in _OPEN or not text.strip(_BLANK):
            return None
        return (number, pos, depth, *self._around(depth), text)

    def _around(self, depth: int) -> tuple[str | None, list, list]:
        """The container at a depth, and the keys above what it holds; at the last level a key is part of the text."""
        kind = self.at[depth][0] if depth < len(self.at) else None
        above = self.at[1 : depth + (kind == "{" and depth < len(self.at) - 1)]
        return kind, [x[2] for x in above], [x[1] for x in above]


def _key(text: bytes) -> str:
    text = text.strip(_BLANK)
    try:
        return str(json.loads(text))
    except ValueError:
        return text.decode("utf-8", "replace")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 1: (file, block, quotes, outside, inside, size, head): what a split adds to the depth if it begins outside or inside a string."""
    found: dict[tuple[int, int], list] = {}
    for file, block, data in _runs(batches):
        raw = np.frombuffer(_plain(data), np.uint8)
        within = np.cumsum(raw == _QUOTE, dtype=np.int32) & 1
        steps = _STEP[raw]
        net = int(steps[within == 0].sum(dtype=np.int64)), int(steps[within == 1].sum(dtype=np.int64))
        s = found.setdefault((file, block), [0, 0, 0, 0, b""])
        odd = s[0] & 1
        s[1] += net[odd]
        s[2] += net[1 - odd]
        s[0] += int(within[-1])
        s[3] += len(data)
        if block == 0 and not s[4]:
            s[4] = data.lstrip(_BLANK)[:1]
    rows = list(zip(*[(*k, v[0] & 1, *v[1:]) for k, v in found.items()], strict=True)) or [[]] * 7
    yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in rows[:6]], pa.array(rows[6], pa.binary())], ["file", "block", "quotes", "outside", "inside", "size", "head"])


def _edges(states, level: int):
    """Pass 2: (file, block, cuts, values, first, char, depth, stack, open, closed, loose) of each split."""
    names = "file block cuts values first char depth stack open closed loose".split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], dict] = {}
        for file, block, data in _runs(batches):
            s = found.get((file, block))
            if s is None:
                inside, depth = states.value[file, block]
                s = found[file, block] = dict(zip(names, (file, block, 0, 0, None, None, None, _Stack(level), b"", 0, 0), strict=True)) | {"cutter": _Cutter(inside, depth, level)}
            for text, char, depth in s["cutter"].cuts(data):
                if s["cuts"] == 0:
                    s["first"], s["char"], s["depth"] = text, char, depth
                else:
                    s["stack"].apply(text, char, depth, s["cuts"])
                    s["values"] += char != _COLON and char not in _OPEN and bool(text.strip(_BLANK))
                s["loose"] += depth == 0 and bool(text.strip(_BLANK))
                s["closed"] += depth == 1 and char in _CLOSE
                s["cuts"] += 1
        rows = [s | {"stack": s["stack"].dump(), "open": s["cutter"].open} for s in found.values()]
        yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], EDGE_ARROW)

    return run


EDGE_ARROW = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("cuts", pa.int64()), ("values", pa.int64()), ("first", pa.binary()), ("char", pa.int32()), ("depth", pa.int32()), ("stack", pa.string()), ("open", pa.binary()), ("closed", pa.int64()), ("loose", pa.int64())])
EDGES = "file long, block long, cuts long, values long, first binary, char int, depth int, stack string, open binary, closed long, loose long"
JOINED = "file long, block long, stack string, first_number long, first_pos long, number long, pos long, depth int, container string, key_numbers array<long>, keys array<string>, text binary, closed long, loose long"


def _composed(level: int):
    """Of a file's edges: how each split begins, and the piece that its first cut ends."""

    def run(edges: pd.DataFrame) -> pd.DataFrame:
        stack, carried, number, pos, out = _Stack(level), b"", 0, 0, []
        for e in edges.sort_values("block").itertuples(index=False):
            row = dict.fromkeys(x.split()[0] for x in JOINED.split(", ")) | {"file": e.file, "block": e.block, "closed": e.closed, "loose": e.loose}
            if e.cuts == 0:
                carried += e.open
                out.append(row | {"stack": stack.dump(), "first_number": number, "first_pos": pos})
                continue
            text, char, depth = carried + e.first, int(e.char), int(e.depth)
            stack.apply(text, char, depth, number)
            piece = stack.row(text, char, depth, number, pos)
            if piece:
                row |= dict(zip("number pos depth container key_numbers keys text".split(), piece, strict=True))
                pos += piece[1] is not None
            out.append(row | {"stack": stack.dump(), "first_number": number + 1, "first_pos": pos})
            later = _Stack(level, e.stack)
            for x in later.at:  # numbers within the split become numbers within the file
                x[2] = None if x[2] is None else x[2] + number
            stack.merge(later)
            number, pos, carried = number + e.cuts, pos + e.values, e.open
        return pd.DataFrame(out).astype({c: "Int64" for c in ("first_number", "first_pos", "number", "pos", "depth")})

    return run


def _given(states, level: int):
    """Pass 3: the pieces of each split but the one that its first cut ends."""
    types = T._parse_datatype_string(PIECES)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], types.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, size = None, [], 0
        for file, block, data in _runs(batches):
            if now != (file, block):
                now = file, block
                inside, depth, state, number, pos = states.value[now]
                cutter, stack, begun = _Cutter(inside, depth, level), _Stack(level, state), False
            for text, char, depth in cutter.cuts(data):
                if not begun:
                    begun = True
                    continue
                stack.apply(text, char, depth, number)
                piece = stack.row(text, char, depth, number, pos)
                number += 1
                if piece:
                    pos += piece[1] is not None
                    rows.append((file, *piece))
                    size += len(text) + 100
            if size > HELD:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    return run


def _begins(summary: list) -> tuple[dict, dict]:
    """How each split begins, and for each file whether it ends within a string or container, its first character and how much was read."""
    states, ends = {}, {}
    inside, depth, last = 0, 0, None
    for s in sorted(summary, key=lambda s: (s["file"], s["block"])):
        if s["file"] != last:
            inside, depth, last = 0, 0, s["file"]
            ends[last] = [0, 0, b"", 0]
        states[s["file"], s["block"]] = bool(inside), depth
        depth += s["inside"] if inside else s["outside"]
        inside ^= s["quotes"]
        end = ends[last]
        ends[last] = [inside, depth, end[2] or bytes(s["head"]), end[3] + s["size"]]
    return states, ends


def read(spark: SparkSession, paths: list[str], level: int, name_filter: str = "*") -> JsonFiles:
    """The pieces of JSON files down to a level of nesting: 1 for the elements of an array, 3 for what maps in maps hold."""
    path = F.col("_metadata.file_path")
    files = spark.read.format("binaryFile").option("pathGlobFilter", name_filter).load(paths).select(F.xxhash64(path).alias("file"), path.alias("path"), X.base_name(X.decoded(path)).alias("name"), F.col("length").alias("size"))
    text = spark.read.text(paths, lineSep=",", pathGlobFilter=name_filter)
    parts = text.select(F.xxhash64(path).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    return read_parts(spark, files, parts, level)


def read_parts(spark: SparkSession, files: DataFrame, parts: DataFrame, level: int) -> JsonFiles:
    """The same of parts(file, block, value binary): what lies between commas, in order within a block, a partition for each block at least."""
    summary = parts.mapInArrow(_summed, "file long, block long, quotes long, outside long, inside long, size long, head binary").limit(MAX_SPLITS + 1).collect()
    if len(summary) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits; raise spark.sql.files.maxPartitionBytes")
    states, ends = _begins(summary)
    sent = spark.sparkContext.broadcast(states)
    joined = parts.mapInArrow(_edges(sent, level), EDGES).groupBy("file").applyInPandas(_composed(level), JOINED).persist()
    rows = joined.select("file", "block", "stack", "first_number", "first_pos", "closed", "loose").collect()
    full = {(r["file"], r["block"]): (*states[r["file"], r["block"]], r["stack"], r["first_number"], r["first_pos"]) for r in rows}
    across = joined.where("number is not null").select(*[x.split()[0] for x in PIECES.split(", ")])
    pieces = parts.mapInArrow(_given(spark.sparkContext.broadcast(full), level), PIECES).unionByName(across)

    told, of_file = [], {}
    for r in rows:
        of_file.setdefault(r["file"], []).append(r)
    for file, (inside, depth, head, size) in ends.items():
        root = {b"[": "array", b"{": "object", b"": "empty", b",": "empty"}.get(head, "scalar")
        closed, loose = (sum(r[c] for r in of_file[file]) for c in ("closed", "loose"))
        broken = "truncated" if inside or depth > 0 else "malformed" if depth < 0 or root in ("array", "object") and (closed != 1 or loose) or root == "scalar" and closed else None
        told.append((file, root, size, broken))
    known = spark.createDataFrame(told, "file long, root string, got long, error string")
    listed = files.join(F.broadcast(known), "file", "left").withColumn("root", F.coalesce("root", F.lit("empty")))
    # Spark's reader leaves a byte order mark out: three bytes are missing then, one comma at the end may be too many.
    listed = listed.withColumn("bom", F.coalesce((F.col("size") - F.col("got")).isin(2, 3), F.lit(False))).drop("got")
    return JsonFiles(listed, pieces, [joined])


def elements(found: JsonFiles) -> DataFrame:
    """(file, pos, text) of the elements of files whose root is an array, read at level 1; pos is the element's place in it."""
    arrays = found.files.where("root = 'array'").select("file")
    rows = found.pieces.where("depth = 1 and container = '['").join(F.broadcast(arrays), "file", "left_semi")
    return rows.select("file", "pos", F.col("text").cast("string").alias("text"))


def entries(found: JsonFiles, last_wins: bool = True) -> DataFrame:
    """(file, number, first, second, depth, container, text): what files of maps in maps hold, read at level 3.

    A row with a text is an entry (or an item, if `container` is a list) below the keys first and second; one
    without tells a key. Of a key that repeats in its map the last counts, with all that is below it, unless last_wins is false.
    """
    key = lambda i: F.get("keys", F.lit(i))
    at = lambda i: F.get("key_numbers", F.lit(i))
    rows = found.pieces.where("depth > 0").select("file", "number", key(0).alias("first"), key(1).alias("second"), at(0).alias("at1"), at(1).alias("at2"), "depth", "container", F.col("text").cast("string").alias("text"))
    if last_wins:
        rows = stored(rows.withColumn("told", F.isnull("text")), "entries")  # files are read once for all that follows
        keys = rows.where("told")
        firsts = keys.where("at1 is not null and at2 is null").groupBy("file", "first").agg(F.max("at1").alias("at1"), F.count("*").alias("n"))
        seconds = keys.where("at2 is not null").groupBy("file", "at1", "second").agg(F.max("at2").alias("at2"), F.count("*").alias("n"))
        # Texts are shuffled only if a key does repeat.
        if not firsts.where("n > 1").isEmpty():
            rows = rows.where("at1 is null").unionByName(rows.join(firsts, ["file", "first", "at1"], "left_semi"))
        if not seconds.where("n > 1").isEmpty():
            rows = rows.where("at2 is null").unionByName(rows.join(seconds, ["file", "at1", "second", "at2"], "left_semi"))
    return rows.drop("at1", "at2", "told")

"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Text is cut into words (a run of word-start marks and what follows up to the
next mark; no piece has a mark after another character). The distinct words of
a chunk lie in one flat array of symbols. Each round looks up the rank of every
adjacent pair, takes the minimum per segment, merges the leftmost pairs of that
rank in all segments at once and compacts the array, until no pair is left.

A word is one segment if it isn't longer than the longest piece by more than two
symbols. Longer words are blocks of that size, and a segment is a block with its
two neighbours. What merges outside a segment can't reach its inner block before
the segment's own minimum does: no piece is that long, and what grows into the
segment from its ends is one piece at either end. So a block's merges don't wait
for lower ranks far away, and a long word needs about as many rounds as a short one.

Several merges in one segment and round are the same as one after the other only
if no piece that a merge makes possible ranks before it. Pieces for which this
doesn't hold (they are found when the model is read) merge once a round in two
neighbouring blocks; long runs of one symbol, where each would wait for the one
before, merge by groups. A run of overlapping pairs of one rank waits until its
first pair may merge, since that decides which of them do.

Nulls count as empty text, and empty text has no ids. Rows are independent:
ties and repeated rows each get their own result, an empty table gives an empty
one. Input columns besides the named ones are not read, so their names can't
clash. Very long texts, and words without a space in them, take the same rounds.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_chunks

MARK = "▁"
#: Characters of the words that a task remembers with their ids; beyond that it starts afresh.
CACHE_CHARS = 2_000_000
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_NONE = np.int64(1 << 40)


def _fields(blob: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(blob):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            size = varint()
            value, at = blob[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = blob[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} in the model file")
        yield tag >> 3, value


class PieceModel:
    """The pieces, merge ranks and byte pieces of a SentencePiece BPE model."""

    def __init__(self, blob: bytes) -> None:
        pieces, scores, kinds = [], [], []
        normal = {"charsmap": b"", "dummy": 1, "squeeze": 1, "escape": 1}
        trainer = {"type": 1, "fallback": 0, "suffix": 0}
        for number, value in _fields(blob):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece.get(1, b"").decode("utf-8"))
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                trainer = {"type": spec.get(3, 1), "fallback": spec.get(35, 0), "suffix": spec.get(24, 0)}
            elif number == 3:
                spec = dict(_fields(value))
                normal = {"charsmap": spec.get(2, b""), "dummy": spec.get(3, 1), "squeeze": spec.get(4, 1), "escape": spec.get(5, 1)}
        if trainer["type"] != 2 or not trainer["fallback"] or trainer["suffix"]:
            raise ValueError("only BPE models with byte fallback and word-start marks are supported")
        if normal["charsmap"] or normal["squeeze"] or not normal["escape"]:
            raise ValueError("only models without text normalisation are supported")
        if {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.pieces, self.kinds, self.dummy = pieces, kinds, bool(normal["dummy"])
        self.base = len(pieces)
        self.span = self.base + 0x110000
        ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a piece has a word-start mark after another character")
        self.symbol = np.arange(self.base, self.span, dtype=np.int64)  # of each code point
        for p, i in ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.byte = np.zeros(256, np.int32)
        self.byte_value = np.full(self.base, -1, np.int32)
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == BYTE:
                self.byte[int(p[3:5], 16)] = i
                self.byte_value[i] = int(p[3:5], 16)
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        rank = {i: order[scores[i]] for i in ids.values()}
        known = lambda s: ids.get(s, self.base + ord(s) if len(s) == 1 else None)
        keys, merged = [], []
        unsafe = np.zeros(self.base, bool)
        for p, i in ids.items():
            for cut in range(1, len(p)):
                left, right = known(p[:cut]), known(p[cut:])
                if left is None or right is None:
                    continue
                keys.append(left * self.span + right)
                merged.append(i)
                for part, size in ((left, cut), (right, len(p) - cut)):
                    if size > 1 and rank[i] <= rank[part]:
                        unsafe[part] = True
        self.keys = np.array([*keys, -1], np.int64)
        self.merged = np.array([*merged, 0], np.int64)
        self.ranks = np.array([rank[i] for i in merged] + [_NONE], np.int64)
        self.unsafe = unsafe
        # Hash table of pairs: a slot has the place of a pair in keys; the last place is of none.
        self.block = max(map(len, pieces), default=1) + 2
        self.groups: dict[tuple[int, int], tuple[int, int]] = {}
        self.bits = max(4, len(keys).bit_length() + 3)
        self.slots, self.probes = np.full(1 << self.bits, len(keys), np.int32), 1
        rest, place = np.arange(len(keys)), self.slot(self.keys[:-1])
        while len(rest):
            free = self.slots[place] == len(keys)
            self.slots[place[free]] = rest[free]
            lost = self.slots[place] != rest
            rest, place = rest[lost], (place[lost] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(rest))
        alphabet = set("".join(ids))
        # A character of no piece can't merge; line ends are common, so words end there too.
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if "\n" not in alphabet else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.shown = [p.replace(MARK, " ") if k == NORMAL else "" for p, k in zip(pieces, kinds, strict=True)]
        for i, k in enumerate(kinds):
            if k == UNKNOWN:
                self.shown[i] = " ⁇ "
            if 0 <= self.byte_value[i] < 128:
                self.shown[i] = chr(self.byte_value[i])

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) and merged piece of each pair."""
        key = left * self.span + right
        place = self.slot(key)
        at = self.slots[place]
        none = len(self.keys) - 1
        wrong = np.flatnonzero((self.keys[at] != key) & (at != none))
        for _ in range(1, self.probes):
            if not len(wrong):
                break
            place[wrong] = (place[wrong] + 1) & ((1 << self.bits) - 1)
            at[wrong] = self.slots[place[wrong]]
            wrong = wrong[(self.keys[at[wrong]] != key[wrong]) & (at[wrong] != none)]
        at[wrong] = none
        return self.ranks[at], self.merged[at]

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words and the number of ids of each."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        symbols = self.symbol[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), _NONE)
            piece = np.zeros(len(symbols), np.int64)
            rank[:-1], piece[:-1] = self.pairs(symbols[:-1], symbols[1:])
            rank[:-1][word[:-1] != word[1:]] = _NONE
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(symbols)))
            if (over := np.minimum.reduceat(rank, starts) == _NONE).any():
                gone = np.repeat(over, sizes)
                done.append((word[gone], symbols[gone]))
                symbols, word, rank, piece = symbols[~gone], word[~gone], rank[~gone], piece[~gone]
                if not len(symbols):
                    break
                sizes = sizes[~over]
                starts = np.append(0, np.cumsum(sizes)[:-1])
            if sizes.max() > 8 * self.block and (cut := self.run_cuts(symbols, word, rank, piece)):
                for i, k, gone, new in reversed(cut):
                    symbols[i : i + k] = new
                    symbols, word = np.delete(symbols, np.s_[i + k : i + gone]), np.delete(word, np.s_[i + k : i + gone])
                continue
            take = self.merges(rank, piece, starts, sizes)
            symbols = np.where(take, piece, symbols)
            keep = np.append(True, ~take[:-1])
            symbols, word = symbols[keep], word[keep]
        word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return self.to_ids(word[order], symbols[order], len(words))

    def merges(self, rank: np.ndarray, piece: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which pairs, named by the place of their left symbol, merge in this round."""
        at = np.arange(len(rank))
        within = at - np.repeat(starts, sizes)
        blocks = np.flatnonzero(within % self.block == 0)
        count = np.diff(np.append(blocks, len(rank)))
        opens = within[blocks] == 0
        ends = np.append(opens[1:], True)
        own = np.minimum.reduceat(rank, blocks)
        least = np.minimum(own, np.where(opens, _NONE, np.roll(own, 1)))
        least = np.minimum(least, np.where(ends, _NONE, np.roll(own, -1)))
        best = (rank == np.repeat(least, count)) & (rank != _NONE)
        # In a run of overlapping pairs of the same rank every other one merges, from the left, if the run begins where it seems to.
        run = np.maximum.accumulate(np.where(best, -1, at))
        true_start = np.append(True, rank[:-1] != np.where(best, rank, -1)[1:])
        take = best & ((at - run) % 2 == 1) & true_start[np.minimum(run + 1, len(rank) - 1)]
        # At most one merge of an unsafe piece in a block, and none where the block before has one to come.
        if (risky := take & self.unsafe[piece]).any():
            first = np.minimum.reduceat(np.where(best, at, len(rank)), blocks)
            has = first < len(rank)
            waits = np.where(opens, False, np.roll(has, 1))
            take &= ~risky | ((at == np.repeat(first, count)) & ~np.repeat(waits, count))
        return take

    def run_cuts(self, symbols: np.ndarray, word: np.ndarray, rank: np.ndarray, piece: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(start, pieces, symbols, piece) of long runs of one symbol whose next merges repeat what the ones before have made.

        Merges of an unsafe piece go from left to right, one a round. In a run of
        one symbol each group of them gives the same piece, as soon as what is on
        the left is such pieces alone; so all groups but the last are done at once.
        """
        risky = np.append(False, (rank != _NONE) & self.unsafe[piece] & (symbols == np.append(symbols[1:], -1)))
        edges = np.flatnonzero(np.diff(np.append(risky, False).astype(np.int8)))
        found = []
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            n = j - i + 1
            if n < 6 * self.block:
                continue
            new, size = self.grown(int(symbols[i]), int(rank[i]))
            if not size:
                continue
            back = -(-self.block // len(self.pieces[new]))
            left = np.s_[i - back : i]
            k = (n - 3 * self.block) // size
            if i >= back and (symbols[left] == new).all() and (word[left] == word[i]).all() and (rank[left] > rank[i]).all() and k > 0:
                found.append((i, k, k * size, new))
        return found

    def grown(self, symbol: int, most: int) -> tuple[int, int]:
        """The piece that merges up to a rank make of each group of symbols in a long run of one symbol, and the group's size; size 0 if groups differ."""
        if (known := self.groups.get((symbol, most))) is None:
            s, size = np.full(8 * self.block, symbol), np.ones(8 * self.block, np.int64)
            while len(s) > 1:
                rank, piece = self.pairs(s[:-1], s[1:])
                i = int(rank.argmin())
                if rank[i] > most:
                    break
                s[i] = piece[i]
                size[i] += size[i + 1]
                s, size = np.delete(s, i + 1), np.delete(size, i + 1)
            same = int(np.append(s != s[0], True).argmax())
            known = self.groups[symbol, most] = (int(s[0]), int(size[0])) if size[0] > 1 and size[:same].sum() >= 6 * self.block else (0, 0)
        return known

    def to_ids(self, word: np.ndarray, symbols: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols: characters outside the vocabulary become their UTF-8 bytes."""
        odd = symbols >= self.base
        if odd.any():
            points, back = np.unique(symbols[odd] - self.base, return_inverse=True)
            coded = [chr(c).encode("utf-8", "surrogatepass") for c in points.tolist()]
            width = np.ones(len(symbols), np.int64)
            width[odd] = np.array([len(x) for x in coded])[back]
            out = np.repeat(symbols, width)
            flat = np.frombuffer(b"".join(coded), np.uint8)
            start = np.append(0, np.cumsum([len(x) for x in coded])[:-1])[back]
            size = width[odd]
            within = np.arange(size.sum()) - np.repeat(np.append(0, np.cumsum(size)[:-1]), size)
            out[np.repeat(odd, width)] = self.byte[flat[np.repeat(start, size) + within]]
            symbols, word = out, np.repeat(word, width)
        return symbols.astype(np.int32), np.bincount(word, minlength=n_words)

    def marked(self, text: str) -> str:
        text = text.replace(" ", MARK)
        return MARK + text if text and self.dummy else text

    def decode(self, ids: list[int]) -> str:
        """What the library's decode gives for ids."""
        shown = self.shown
        out = list(map(shown.__getitem__, ids))
        values = self.byte_value[np.asarray(ids, np.int64)] if len(ids) else np.zeros(0, np.int32)
        high = np.flatnonzero(values >= 128)
        if len(high):
            runs = np.split(high, np.flatnonzero(np.diff(high) > 1) + 1)
            for run in runs:
                out[run[0]] = _decode_bytes(bytes(values[run].tolist()))
        text = "".join(out)
        if self.dummy and len(ids):
            lead = next((i for i in ids if self.kinds[i] != CONTROL), None)
            if lead is not None and self.pieces[lead].startswith(MARK) and self.kinds[lead] == NORMAL:
                text = text[1:]
        return text


def _decode_bytes(raw: bytes) -> str:
    """UTF-8 with one replacement character for each byte that is no part of a character."""
    out, at = [], 0
    while at < len(raw):
        size = 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
        try:
            out.append(raw[at : at + size].decode("utf-8"))
            at += size
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


class _Words(dict):
    """Numbers words in the order in which they are first asked for."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes texts, remembering the ids of words across chunks."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known = _Words()
        self.chars = 0
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each."""
        if self.chars > CACHE_CHARS:
            self.clear()
        cut, number = self.model.cut, self.known.__getitem__
        code: list[int] = []
        counts = []
        for text in texts:
            before = len(code)
            if text:
                code += map(number, cut.findall(self.model.marked(text)))
            counts.append(len(code) - before)
        if fresh := self.known.fresh:
            ids, n = self.model.encode_words(fresh)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(n) - n])
            self.size = np.concatenate([self.size, n])
            self.flat = np.concatenate([self.flat, ids])
            self.chars += sum(map(len, fresh))
            self.known.fresh = []
        at = np.array(code, np.int64)
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        picked = self.flat[np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        text_of = np.repeat(np.arange(len(texts)), counts)
        return picked, np.bincount(text_of, weights=sizes, minlength=len(texts)).astype(np.int64)


_MODELS: dict[int, PieceModel] = {}


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>, decoded string) of each row of docs.

    model_path is read once, on the driver; the model (well under 10 MB, which
    is checked) goes to the tasks with the code. Memory in a task is bounded by
    one chunk of texts, or one text, and the remembered words.
    """
    with open(model_path, "rb") as f:
        blob = f.read()
    if len(blob) > 10_000_000:
        raise ValueError("the model file is larger than 10 MB")
    PieceModel(blob)  # fails here, not in a task, if it isn't supported
    sent = docs.sparkSession.sparkContext.broadcast(blob)
    source = docs.select(docs[id_col], docs[text_col].alias("text"))
    schema = T.StructType([T.StructField(id_col, source.schema[0].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = sent.value
        if (model := _MODELS.get(hash(raw))) is None:
            model = _MODELS[hash(raw)] = PieceModel(raw)
        encoder = Encoder(model)
        for part in text_chunks(batches, "text"):
            flat, sizes = encoder.encode(part.column("text").to_pylist())
            ends = np.cumsum(sizes)
            listed = flat.tolist()
            decoded = [model.decode(listed[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(decoded, pa.string())], names=[id_col, "ids", "decoded"])

    return source.mapInArrow(run, schema)

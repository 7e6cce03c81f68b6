"""Phrases of two to four words that stand together more often than their parts suggest.

Texts are lower-cased (A-Z), cut at .,;:!? and line ends into pieces and at space
and tab into words. n-grams are counted by language in count-min sketches: each
task fills one, whose cells stop at `least`, and sketches are merged cell by cell. What
is left of a sketch is a bit for each cell: whether its sum reaches `least`. A cell
never holds less than one of its n-grams has, so that an n-gram with a cell without a
bit is surely rare. The first sketch has words and pairs, the second has
longer n-grams whose pairs all survive the first. A last pass counts the survivors,
and only them, exactly by their text. So a sketch that is too narrow costs time,
never a phrase: cells should outnumber the n-grams of the corpus over `least`. Their
number grows with the text, up to MOST_CELLS.

Scores, and what a longer phrase subsumes, are exact (decimals of 38 digits).

Defined cases: a null text is empty; a null language is `und`, one class with texts that
say so. Repeated rows count each time; the id isn't read. Long texts go in blocks
that share their last words, so that memory doesn't grow with them. Other columns are not
read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_shuffles, materialize, named, release
from .shingles import odd_numbers

LONGEST = 4
LEAST = 30
SUBSUMED_PERCENT = 80
TOP = 2000
#: Cells of a sketch row (a power of two) at least and at most, bytes of text for each between, and rows of a sketch. A task fills a byte
#: for each cell and row; bits, of which all tasks get a copy, take an eighth of that.
CELLS, MOST_CELLS, CELL_BYTES, ROWS = 1 << 23, 1 << 27, 24, 2
#: Cells that travel in one row when sketches are merged.
SEGMENT = 4096
#: Tasks for each core that fill a sketch or count survivors.
WAVES = 2
#: Bytes of text that are cut into words at a time.
BLOCK = 4 << 20
#: Phrases that a task counts before it hands them on.
HELD = 700_000

_CUTS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
_BREAK = b"."
_FACTORS = odd_numbers(LONGEST + ROWS, 23)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[bytes], int]]:
    """(language, words with breaks, number of them that the last block of this text had already)."""
    held: dict[str, list[bytes]] = {}
    sizes: Counter[str] = Counter()
    for batch in batches:
        for text, lang in zip(*(batch.column(c) for c in ("text", "lang")), strict=True):
            lang, raw = lang.as_py() or "", (text.as_py() or "").encode("utf-8", "surrogatepass").lower().translate(_CUTS)
            if len(raw) > size:
                yield from ((lang, *block) for block in _long(raw, size))
                continue
            held.setdefault(lang, []).append(raw)
            sizes[lang] += len(raw) + 1
            if sizes[lang] > size:
                yield lang, _words(_BREAK.join(held.pop(lang))), 0
                del sizes[lang]
        if sizes.total() > 4 * size:
            for lang, raws in held.items():
                yield lang, _words(_BREAK.join(raws)), 0
            held.clear()
            sizes.clear()
    for lang, raws in held.items():
        yield lang, _words(_BREAK.join(raws)), 0


def _words(raw: bytes) -> list[bytes]:
    return raw.replace(_BREAK, b" . ").split()


def _long(raw: bytes, size: int) -> Iterator[tuple[list[bytes], int]]:
    carried: list[bytes] = []
    start = 0
    while start < len(raw):
        end = start + size
        if end < len(raw):  # on to the end of the word
            ends = [x for x in (raw.find(c, end) for c in (b" ", b"\t", _BREAK)) if x >= 0]
            end = min(ends, default=len(raw))
        words = carried + _words(raw[start:end])
        yield words, len(carried)
        carried, start = words[1 - LONGEST :], end


class _Vocabulary(dict):
    """Numbers for words from 1 on in the order of their coming; the break has 0."""

    def __init__(self) -> None:
        super().__init__({_BREAK: 0})
        self.hashes = [0]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n


class _Grams:
    """The n-grams of a block: word numbers, and for each n where n-grams start and their hashes."""

    def __init__(self, lang: str, words: list[bytes], carried: int) -> None:
        vocabulary = _Vocabulary()
        self.words, self.carried = words, carried
        self.ids = np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
        self.size = len(vocabulary)
        self.hashes = np.array(vocabulary.hashes, np.uint64)[self.ids]
        self.seed = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 5))

    def starts(self, n: int) -> np.ndarray:
        """Where n-grams lie within a piece."""
        if len(self.ids) < n:
            return np.zeros(0, np.int64)
        whole = self.ids != 0
        inside = whole[: len(whole) - n + 1].copy()
        for i in range(1, n):
            inside &= whole[i : len(whole) - n + 1 + i]
        return np.flatnonzero(inside)

    def new(self, at: np.ndarray, n: int) -> np.ndarray:
        """Starts of n-grams that don't end within what the last block had."""
        return at[at > self.carried - n]

    def keys(self, at: np.ndarray, n: int) -> np.ndarray:
        mixed = np.full(len(at), self.seed + np.uint64(n))
        for i in range(n):
            mixed += self.hashes[at + i] * _FACTORS[i]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        return mixed


def _cells(keys: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (keys * _FACTORS[LONGEST + row]) >> np.uint64(64 - cells.bit_length() + 1)


class _Frequent:
    """The bits of a merged sketch."""

    def __init__(self, bits: np.ndarray, cells: int) -> None:
        self.bits, self.cells = bits, cells

    def holds(self, keys: np.ndarray) -> np.ndarray:
        kept = np.ones(len(keys), bool)
        for row in range(len(self.bits) * 8 // self.cells):
            at = _cells(keys, row, self.cells) + np.uint64(row * self.cells)
            kept &= (self.bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1
        return kept


def _survivors(grams: _Grams, short: _Frequent, long: _Frequent | None) -> Iterator[tuple[int, np.ndarray]]:
    """(n, starts) of n-grams that may be frequent, as both n-grams of one word less within are. Without `long`, all of 3 words and more count as frequent."""
    alive = np.ones(len(grams.ids) + LONGEST, bool)
    for n in range(1, LONGEST + 1):
        at = grams.starts(n)
        at = at[alive[at] & alive[at + 1]] if n > 1 else at
        of = short if n <= 2 else long
        if of is not None:
            at = at[of.holds(grams.keys(at, n))]
        alive[:] = False
        alive[at] = True
        yield n, at


def _sketch(grams_of, least: int, cells: int, rows: int, block: int):
    """A function for mapInArrow: one sketch of a task's n-grams, in segments."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(rows * cells, np.min_scalar_type(2 * least))
        for lang, words, carried in _blocks(batches, block):
            for keys in grams_of(_Grams(lang, words, carried)):
                for row in range(rows):
                    at, times = np.unique(_cells(keys, row, cells), return_counts=True)
                    at += np.uint64(row * cells)
                    sketch[at] = np.minimum(sketch[at] + np.minimum(times, least), least)
        for start in range(0, len(sketch), 256 * SEGMENT):
            part = sketch[start : start + 256 * SEGMENT].reshape(-1, min(SEGMENT, cells))
            used = [i for i in range(len(part)) if part[i].any()]
            yield pa.RecordBatch.from_arrays([pa.array([start // part.shape[1] + i for i in used], pa.int32()), pa.array([pa.compress(part[i].tobytes(), "zstd", asbytes=True) for i in used], pa.binary())], ["segment", "cells"])

    return fill


def _merge(least: int, cells: int):
    width = min(SEGMENT, cells)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, sums = np.min_scalar_type(2 * least), {}
        for batch in batches:
            for segment, packed in zip(batch.column("segment").to_pylist(), batch.column("cells"), strict=True):
                part = np.frombuffer(pa.decompress(packed.as_buffer(), width * np.dtype(kind).itemsize, "zstd"), kind)
                sums[segment] = part if segment not in sums else np.minimum(sums[segment] + part, kind.type(least))
        found = {k: np.packbits(v >= least).tobytes() for k, v in sums.items()}
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array(found.values(), pa.binary())], ["segment", "bits"])

    return merge


def _few(texts: DataFrame) -> DataFrame:
    """As many partitions as there are tasks in WAVES waves at most: each hands on a sketch, or a count of every survivor that it has."""
    return texts.coalesce(WAVES * texts.sparkSession.sparkContext.defaultParallelism)


def _frequent(texts: DataFrame, grams_of, least: int, cells: int, rows: int, block: int):
    """The merged sketch, as a broadcast of its bits: a size that is set by cells and rows."""
    spark = texts.sparkSession
    filled = _few(texts).mapInArrow(_sketch(grams_of, least, cells, rows, block), "segment int, cells binary")
    merged = filled.repartition("segment").mapInArrow(_merge(least, cells), "segment int, bits binary")
    bits, width = np.zeros(rows * cells // 8, np.uint8), min(SEGMENT, cells) // 8
    for segment, part in merged.collect():
        bits[segment * width : (segment + 1) * width] = np.frombuffer(part, np.uint8)
    free_shuffles(spark)
    return spark.sparkContext.broadcast(bits)


def _count(short, long, cells: int, block: int):
    """A function for mapInArrow: exact counts of surviving n-grams, and of all words under n = 0."""

    def rows(counts: dict[str, Counter[bytes]]) -> pa.RecordBatch:
        langs = [lang for lang, of in counts.items() for _ in of]
        phrases = [p for of in counts.values() for p in of]
        sizes = [p.count(b" ") + 1 if p else 0 for p in phrases]
        return pa.RecordBatch.from_arrays([pa.array(langs), pa.array(sizes, pa.int32()), pa.array(phrases, pa.binary()), pa.array([n for of in counts.values() for n in of.values()], pa.int64())], ["lang", "size", "phrase", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _Frequent(short.value, cells), _Frequent(long.value, cells)
        counts: dict[str, Counter[bytes]] = defaultdict(Counter)
        for lang, words, carried in _blocks(batches, block):
            grams, of = _Grams(lang, words, carried), counts[lang]
            of[b""] += len(grams.new(grams.starts(1), 1))
            order = np.zeros(len(words), np.int64)
            for n, at in _survivors(grams, first, second):
                # n-grams are numbered by the number of their start and the next word, so that equal numbers mean equal words
                number = grams.ids[at] if n == 1 else order[at] * grams.size + grams.ids[at + n - 1]
                _, where, same = np.unique(number, return_index=True, return_inverse=True)
                order[at] = same
                times = np.bincount(same[len(at) - len(grams.new(at, n)) :], minlength=len(where))
                for start, c in zip(at[where].tolist(), times.tolist(), strict=True):
                    if c:
                        of[b" ".join(words[start : start + n])] += c
            if sum(map(len, counts.values())) > HELD:
                yield rows(counts)
                counts.clear()
        if counts:
            yield rows(counts)

    return count


def cells_for(size: int) -> int:
    """Cells of a sketch row for texts of so many bytes."""
    return min(MOST_CELLS, max(CELLS, 1 << (size // CELL_BYTES).bit_length()))


def ngram_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, cells: int | None = None, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(lang, size, phrase, n) of the n-grams of 1 to LONGEST words with n >= least, and of all words of a language under size 0."""
    if cells is not None and (cells & (cells - 1) or cells < 8):
        raise ValueError("cells must be a power of two, 8 at least")
    texts = docs.select(named(docs, text).cast("string").alias("text"), F.coalesce(named(docs, lang).cast("string"), F.lit("und")).alias("lang"))
    cells = cells or cells_for(texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0)

    short = _frequent(texts, lambda grams: (grams.keys(grams.new(grams.starts(n), n), n) for n in (1, 2)), least, cells, rows, block)

    def longer(grams: _Grams) -> Iterator[np.ndarray]:
        for n, at in _survivors(grams, _Frequent(short.value, cells), None):
            if n > 2:
                yield grams.keys(grams.new(at, n), n)

    long = _frequent(texts, longer, least, cells, rows, block)
    counted = _few(texts).mapInArrow(_count(short, long, cells, block), "lang string, size int, phrase binary, n long")
    total = counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("size") == 0))
    out = materialize(total.withColumn("phrase", F.col("phrase").cast("string")), "phrases")
    free_shuffles(docs.sparkSession)
    for used in (short, long):
        used.unpersist()
    return out


def _words_of(first: Column, last: Column) -> Column:
    """The words of `cut` from first on, up to and with last, counted from 1."""
    return F.array_join(F.slice("cut", first, last - first + 1), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score) of the phrases of ngram_counts(), by their lowest-scoring cut."""
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    parts = counts.where((F.col("size") > 0) & (F.col("size") < LONGEST))
    phrases = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("cut"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("lang", "phrase", "size", "a", "k", _words_of(F.lit(1), F.col("k")).alias("left"), _words_of(F.col("k") + 1, F.col("size")).alias("right"))
    for side in ("left", "right"):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(side[0])), ["lang", side])
    cuts = cuts.withColumn("score", F.expr("(CAST(a AS DECIMAL(28,0)) * 2000000) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    lowest = F.min_by(F.struct("score", "l", "r"), F.struct("score", "k"))
    best = cuts.groupBy("lang", "phrase", "size", "a").agg(lowest.alias("b"))
    words = counts.where("size = 0").select("lang", F.col("n"))
    return best.join(words, "lang").select("lang", "phrase", "size", "a", "b.l", "b.r", "n", "b.score")


def standing(phrases: DataFrame, percent: int = SUBSUMED_PERCENT) -> DataFrame:
    """Phrases that no longer phrase holds with a count of at least `percent` of their own."""
    inner = phrases.where("size > 2").select("lang", F.col("a").alias("longer"), F.split("phrase", " ").alias("cut"), F.col("size").alias("whole"))
    inner = inner.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("whole") - 1))).withColumn("first", F.explode(F.sequence(F.lit(1), F.col("whole") - F.col("size") + 1)))
    held = inner.select("lang", _words_of(F.col("first"), F.col("first") + F.col("size") - 1).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    product = lambda c, by: F.col(c).cast("decimal(28,0)") * F.lit(by)
    gone = held.join(phrases.select("lang", "phrase", "a"), ["lang", "phrase"]).where(product("longer", 100) >= product("a", percent))
    return phrases.join(gone.select("lang", "phrase"), ["lang", "phrase"], "left_anti")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, least: int = LEAST, cells: int | None = None, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language."""
    counts = ngram_counts(docs, text, lang, least, cells, rows, block)
    phrases = materialize(scored(counts), "scored")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = standing(phrases).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = materialize(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    release(counts, phrases)
    return out

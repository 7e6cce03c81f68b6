"""Shingle similarity of texts: pairs above a threshold, exact or by MinHash bands, and cluster rates."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import exprs as X
from corvane.session import dropped, stored

#: Bands of few rows: a pair at similarity 0.75 shares none of them with a probability of 5e-6, and agrees in fewer than
#: LEAST coordinates with one of 2e-7; at 0.8 both are below 1e-7.
PERMUTATIONS, BANDS, ROWS, LEAST = 128, 32, 4, 70


def shingled(df: DataFrame, id_col: str, text_col: str, cap: int | None = X.CAP) -> DataFrame:
    """(id, shingles) of the texts that have a word."""
    return df.select(F.col(id_col).alias("id"), X.shingles(F.col(text_col), cap).alias("shingles")).where(F.size("shingles") > 0)


#: Bits of each coordinate that go with a posting. Two unlike sets agree in a quarter of them by chance.
SKETCH_BITS = 2
#: Coordinates that must agree in these bits: at similarity 0.75 some 104 of 128 do, and fewer than 84 with a probability of 6e-6.
SKETCHED = 84
#: Bytes of text that a task takes at a time.
CHUNK_BYTES = 4 << 20


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(seed)).integers(0, 2**62, n, dtype=np.int64) * 2 + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= (x >> 29) & 0x7FFFFFFFF
    x *= np.int64(-0x40A7B892E31B1A47)
    x ^= (x >> 32) & 0xFFFFFFFF
    return x


class TextShingles:
    """Distinct five-word shingles of whole texts as hashes, and what is made of them. Words are [a-z0-9]+ of the text in lower case."""

    def __init__(self, size: int = 5) -> None:
        self.size, self.steps, self.factors = size, _odd(size, 2), _odd(PERMUTATIONS, 1)
        self.inside = np.zeros(256, bool)
        self.inside[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
        self.letters, self.places = _odd(256, 3), _odd(64, 4)

    def _words(self, text: str) -> np.ndarray:
        """A hash of each word: the sum of its letters' numbers, each times that of its place."""
        raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
        inside = self.inside[raw]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        sizes = edges[1::2] - edges[::2]
        if not len(sizes):
            return np.zeros(0, np.int64)
        if sizes.max() > len(self.places):
            self.places = _odd(2 * int(sizes.max()), 4)
        first = np.cumsum(sizes) - sizes
        letters = self.letters[raw[inside]]
        letters *= self.places[np.arange(len(letters)) - np.repeat(first, sizes)]
        return _mixed(np.add.reduceat(letters, first) + sizes)

    def of(self, text: str | None) -> np.ndarray:
        """Sorted; the whole text if it has fewer words, nothing if it has none."""
        h = self._words(text) if text else np.zeros(0, np.int64)
        if not len(h):
            return h
        n = max(1, len(h) - self.size + 1)
        mixed = np.full(n, min(len(h), self.size), np.int64)
        for i, f in enumerate(self.steps[: len(h)]):
            mixed += h[i : i + n] * f
        return np.unique(_mixed(mixed))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        out, buffer = np.empty(PERMUTATIONS, np.int64), np.empty_like(shingles)
        for i, f in enumerate(self.factors):
            out[i] = np.multiply(shingles, f, out=buffer).min()
        return (out ^ (out >> 32)) & 0xFFFFFFFF


def _bands(sigs: np.ndarray) -> np.ndarray:
    """A hash of each band of each signature."""
    parts = sigs.reshape(len(sigs), BANDS, ROWS)
    mixed = np.broadcast_to(np.arange(BANDS, dtype=np.int64) + 1, parts.shape[:2]).copy()
    for r in range(ROWS):
        mixed = (mixed ^ parts[:, :, r]) * np.int64(0x2545F4914F6CDD1D)
        mixed ^= (mixed >> 31) & 0x1FFFFFFFF
    return mixed


def _sketches(sigs: np.ndarray) -> np.ndarray:
    """SKETCH_BITS of each coordinate, packed into longs."""
    low = (sigs >> 7) & ((1 << SKETCH_BITS) - 1)
    each = 64 // SKETCH_BITS
    shifts = np.arange(each, dtype=np.int64) * SKETCH_BITS
    return np.bitwise_or.reduce(low.reshape(len(sigs), -1, each) << shifts, axis=2)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, list[str | None]]]:
    """(ids, hashes, texts) of some bytes of text at a time, one text at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        start = held = 0
        for i, n in enumerate([*sizes, CHUNK_BYTES]):
            if held and held + n > CHUNK_BYTES or i == len(sizes):
                part = batch.slice(start, i - start)
                yield part.column("id"), part.column("hash"), part.column("text").to_pylist()
                start, held = i, 0
            held += n


def signed_texts(texts: DataFrame) -> DataFrame:
    """(id, hash, key, bands, sketch) of texts(id, text) that have a word; hash is of the text, and equal sets have equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = TextShingles()
        for ids, hashes, some in _chunks(batches):
            sets = [shingler.of(t) for t in some]
            there = [i for i, x in enumerate(sets) if len(x)]
            if there:
                at = pa.array(there, pa.int64())
                sigs = np.stack([shingler.signature(sets[i]) for i in there])
                keys = [_key(sets[i]) for i in there]
                yield pa.RecordBatch.from_arrays([ids.take(at), hashes.take(at), pa.array(keys, pa.int64()), pa.array(list(_bands(sigs)), pa.list_(pa.int64())), pa.array(list(_sketches(sigs)), pa.list_(pa.int64()))], ["id", "hash", "key", "bands", "sketch"])

    return _hashed(texts.where("id IS NOT NULL")).mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, hash long, key long, bands array<long>, sketch array<long>")


def _hashed(texts: DataFrame) -> DataFrame:
    return texts.select("id", F.xxhash64("text").alias("hash"), "text")


def _key(shingles: np.ndarray) -> int:
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def text_pairs(texts: DataFrame, percent: int = 75) -> DataFrame:
    """(id_a, id_b, jaccard) of texts(id, text) by MinHash bands, confirmed on the full sets.

    Equal texts are one class with the smallest id: pairs are between classes, and each copy has one pair with its class.
    Sets are compared once for all texts that have them. A posting carries a sketch of its signature, so that pairs far below the threshold end in the join that finds them; only texts
    that are left in a pair are cut into shingles again. A null id takes no part; an id that repeats stands for each of its texts.
    """
    signed = stored(signed_texts(texts.select("id", "text")), "signed")
    classes = signed.groupBy("key").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    words = PERMUTATIONS * SKETCH_BITS // 64
    posted = classes.select("key", "sketch", F.explode("bands").alias("band"))
    # Both sides have the same shape, so that one shuffle serves both.
    side = lambda c: posted.select(F.col("band").alias(f"{c}_band"), F.col("key").alias(c), *[F.col("sketch")[i].alias(f"{c}{i}") for i in range(words)])
    odd = F.lit(0x5555555555555555).cast("long")

    def unlike(i: int) -> Column:
        x = F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))

    apart = reduce(lambda a, b: a + b, [unlike(i) for i in range(words)])
    met = side("a").join(side("b"), F.col("a_band") == F.col("b_band")).where((F.col("a") < F.col("b")) & (apart <= PERMUTATIONS - SKETCHED))
    likely = stored(met.select("a", "b").distinct(), "likely")
    _free_shuffles(texts)
    ids = signed.groupBy("key").agg(F.min("id").alias("id"))
    near = confirmed(texts, likely, ids, percent)
    out = stored(_of_texts(near, signed), "pairs")
    for df in (signed, likely, near):
        dropped(df)
    _free_shuffles(texts)
    return out


#: Bytes of text for each cell in which shingles are counted, and the most cells there are, as a power of two: tasks get half a byte
#: for each. Cells put shingles in order, and any order finds the same pairs; too few cells for a corpus cost time.
SURVEYED, CELL_BITS = 3, 27
#: Cells that travel in one row when counts are merged, and tasks for each core that count.
SEGMENT, WAVES = 1 << 16, 2
#: Counts of a cell from which each level but the first begins. At the first, one text at most has the cell's shingles.
LEVELS = np.array([2, 3, 4, 6, 8, 11, 16, 23, 32, 45, 64, 91, 128, 181, 250])
#: Pairs that are confirmed together, with the sets of their texts in memory.
TILE_PAIRS = 1 << 14
#: Times that the smallest key known to a pair's partners is handed on, so that most groups have one home.
HOME_ROUNDS = 2
#: Bits that tell tasks which texts are wanted; those wanted by mistake find no partner in a join.
WANTED_BITS = 1 << 25


def _cells(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _paired(x: np.ndarray) -> np.ndarray:
    """Two numbers below 16 in each byte."""
    return x[::2] | x[1::2] << np.uint8(4)


def _levels(texts: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, levels): how many texts have a shingle of each of 2 ** bits cells, as LEVELS, two in a byte.

    Each task counts all shingles of its texts in cells, up to 15; counts of a cell are summed, and only levels reach the driver.
    """
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = min(CELL_BITS, max(10, (size // SURVEYED).bit_length()))
    width = min(SEGMENT, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = TextShingles(), np.zeros(1 << bits, np.uint8)
        for _, _, part in _chunks(batches):
            at, times = np.unique(np.concatenate([_cells(shingler.of(t), bits) for t in part] or [np.zeros(0, np.int64)]), return_counts=True)
            counts[at] = np.minimum(counts[at] + np.minimum(times, 15), 15)
        for start in range(0, len(counts), 64 * width):
            parts = counts[start : start + 64 * width].reshape(-1, width)
            used = [i for i in range(len(parts)) if parts[i].any()]
            yield pa.RecordBatch.from_arrays([pa.array([start // width + i for i in used], pa.int32()), pa.array([zlib.compress(_paired(parts[i]).tobytes(), 1) for i in used], pa.binary())], ["segment", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, cells in zip(batch.column("segment").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(cells), np.uint8)
                both = np.stack([part & 15, part >> 4], axis=1).ravel().astype(np.uint16)
                sums[segment] = np.minimum(sums[segment] + both, 255) if segment in sums else both
        found = {k: _paired(np.searchsorted(LEVELS, v, side="right").astype(np.uint8)).tobytes() for k, v in sums.items()}
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array(found.values(), pa.binary())], ["segment", "levels"])

    few = _hashed(texts).coalesce(WAVES * texts.sparkSession.sparkContext.defaultParallelism)
    merged = few.mapInArrow(count, "segment int, cells binary").repartition("segment").mapInArrow(merge, "segment int, levels binary")
    levels = np.zeros(1 << bits - 1, np.uint8)
    for batch in merged.toArrow().to_batches():
        for segment, part in zip(batch.column("segment").to_pylist(), batch.column("levels"), strict=True):
            levels[segment * width // 2 : (segment + 1) * width // 2] = np.frombuffer(part.as_buffer(), np.uint8)
    return bits, levels


def prefixed_texts(texts: DataFrame, percent: int, known) -> DataFrame:
    """(id, hash, key, n, place, token) of texts(id, text) that have a word: the size of the set, and of its first n - ceil(percent * n / 100) + 1
    shingles those that other texts may have, with their places. Shingles of few texts are first; known: a broadcast of _levels()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, (bits, levels) = TextShingles(), known.value

        def prefix(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = _cells(x, bits)
            level = levels[at >> 1] >> ((at & 1) << 2).astype(np.uint8) & np.uint8(15)
            first = np.argsort(level, kind="stable")[: len(x) + percent * len(x) // -100 + 1]
            place = np.flatnonzero(level[first])
            return place, x[first[place]]

        for ids, hashes, some in _chunks(batches):
            sets = [shingler.of(t) for t in some]
            there = [i for i, x in enumerate(sets) if len(x)]
            if there:
                at, found = pa.array(there, pa.int64()), [prefix(sets[i]) for i in there]
                keys, sizes = [_key(sets[i]) for i in there], [len(sets[i]) for i in there]
                yield pa.RecordBatch.from_arrays([ids.take(at), hashes.take(at), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["id", "hash", "key", "n", "place", "token"])

    return _hashed(texts).mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, hash long, key long, n int, place array<int>, token array<long>")


def _wanted(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """texts(id, text) without most of those whose id isn't in ids(id), told by bits that all tasks get."""
    place = F.pmod(F.xxhash64("id"), F.lit(WANTED_BITS))
    rows = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    held = {r["bucket"]: bytes(r["bits"]) for r in rows}
    size = max(map(len, held.values()), default=1)
    sent = texts.sparkSession.sparkContext.broadcast((size, held))
    marked = texts.select("id", "text", F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, held = sent.value
        none = bytes(size)
        for batch in batches:
            there = [held.get(k, none)[i >> 3] >> (i & 7) & 1 == 1 for k, i in zip(batch.column("bucket").to_pylist(), batch.column("bit").to_pylist(), strict=True)]
            yield batch.select(["id", "text"]).filter(pa.array(there, pa.bool_()))

    return marked.mapInArrow(run, texts.select("id", "text").schema)


def confirmed(texts: DataFrame, pairs: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """(a, b, jaccard) of those pairs(a, b), once each, whose full sets are similar enough; a and b are keys, ids(key, id) names a text of each.

    A pair goes to the home of a, the smallest key some steps away, so that the texts of a group meet in one place and most go
    there once; they are not sent along with each of their pairs. A home of many pairs is cut into tiles of some TILE_PAIRS.
    """
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    homes = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("home"))
    for _ in range(HOME_ROUNDS):
        homes = ends.join(homes.select(F.col("a").alias("b"), "home"), "b").groupBy("a").agg(F.min("home").alias("home"))
    homes = stored(pairs.join(homes, "a"), "homes")
    sides = homes.groupBy("home").count().where(F.col("count") > TILE_PAIRS).select("home", F.ceil(F.sqrt(F.col("count") / TILE_PAIRS)).cast("long").alias("sides"))
    cut = lambda c: F.pmod(F.xxhash64(c), F.coalesce("sides", F.lit(1)))
    tiled = stored(homes.join(sides, "home", "left").select("a", "b", F.xxhash64("home", cut("a"), cut("b")).alias("tile")), "tiled")
    needed = tiled.select("tile", F.explode(F.array("a", "b")).alias("key")).distinct().join(ids, "key")
    needed = stored(needed.select("tile", "key", "id"), "needed")
    few = _wanted(texts, needed.select("id")).join(needed, "id").select("tile", F.col("key").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = few.unionByName(tiled.select("tile", "a", "b", F.lit(None).cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, now, sets = TextShingles(), None, {}
        for batch in batches:
            out = []
            for tile, a, b, text in zip(*(batch.column(c) for c in ("tile", "a", "b", "text")), strict=True):
                tile, a, b = tile.as_py(), a.as_py(), b.as_py()
                if tile != now:
                    now, sets = tile, {}
                if b is None:
                    x = shingler.of(text.as_py())
                    if _key(x) == a:  # an id may stand for several texts
                        sets[a] = x
                    continue
                x, y = sets[a], sets[b]
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    n = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * n >= percent * (len(x) + len(y) - n):
                        out.append((a, b, n / (len(x) + len(y) - n)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "jaccard"])

    out = stored(rows.repartition("tile").sortWithinPartitions("tile", F.asc_nulls_first("b")).mapInArrow(run, "a long, b long, jaccard double"), "confirmed")
    for df in (homes, tiled, needed):
        dropped(df)
    return out


def _of_texts(near: DataFrame, signed: DataFrame) -> DataFrame:
    """(id_a, id_b, jaccard) of all different texts of the sets of near(a, b, jaccard) or of one set, by their smallest ids, and each copy with its text; signed(id, hash, key)."""
    texts = signed.groupBy("key", "hash").agg(F.min("id").alias("id"))
    of = lambda c: texts.select(F.col("key").alias(c), F.col("id").alias(f"{c}_id"))
    named = near.join(of("a"), "a").join(of("b"), "b")
    several = texts.join(texts.groupBy("key").count().where("count > 1").select("key"), "key").select("key", "id")
    within = several.withColumnRenamed("id", "a_id").join(several.withColumnRenamed("id", "b_id"), "key").where("a_id < b_id").withColumn("jaccard", F.lit(1.0))
    apart = named.select("a_id", "b_id", "jaccard").unionByName(within.select("a_id", "b_id", "jaccard")).select(F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b"), "jaccard")
    copies = signed.select("id", "key", "hash").join(texts.withColumnRenamed("id", "id_a"), ["key", "hash"]).where("id > id_a")
    return apart.unionByName(copies.select("id_a", F.col("id").alias("id_b"), F.lit(1.0).alias("jaccard")))


def _of_sets(near: DataFrame, signed: DataFrame) -> DataFrame:
    """(id_a, id_b, jaccard) of near(a, b, jaccard) by the smallest ids of the sets, and each further id with its set; signed(id, hash, key)."""
    ids = signed.groupBy("key").agg(F.min("id").alias("id"))
    of = lambda c: ids.select(F.col("key").alias(c), F.col("id").alias(f"{c}_id"))
    named = near.join(of("a"), "a").join(of("b"), "b").select(F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b"), "jaccard")
    copies = signed.select("id", "key").join(ids.select("key", F.col("id").alias("id_a")), "key").where("id > id_a")
    return named.unionByName(copies.select("id_a", F.col("id").alias("id_b"), F.lit(1.0).alias("jaccard")))


def similar_pairs(texts: DataFrame, percent: int, of_sets: bool = False) -> DataFrame:
    """(id_a, id_b, jaccard) of texts(id, text) with 100 * intersection >= percent * union of their shingles, exactly.

    Prefix filtering: shingles are put in one order for all texts; two sets that are similar enough share one of the first
    n - ceil(percent * n / 100) + 1 of each. At the first one that they share, what is left of either must hold the
    whole intersection. Shingles of few texts are first, as told by counts in cells, and those that no other text has are left out, which changes no pair.
    Equal texts are one class with the smallest id: pairs are between classes, and each copy has one pair with its class,
    so copies aren't multiplied. Different texts with equal sets have a pair each, at 1; sets are compared once for all of them.
    of_sets: classes are of equal sets instead, which is enough to tell whether a text has a partner.
    Only what prefixes share is shuffled, and the texts that are left in a pair.
    """
    texts = texts.select("id", "text").where("id IS NOT NULL")
    known = texts.sparkSession.sparkContext.broadcast(_levels(texts))
    _free_shuffles(texts)
    prefixed = stored(prefixed_texts(texts, percent, known), "prefixed")
    known.unpersist()
    classes = prefixed.where(F.size("token") > 0).groupBy("key").agg(F.first("n").alias("n"), F.first("place").alias("place"), F.first("token").alias("token"))
    posted = classes.select("key", "n", F.inline(F.arrays_zip("place", "token")))
    # Both sides have the same shape, so that one shuffle serves both.
    side = lambda c: posted.select(F.col("token").alias(f"{c}_token"), F.col("key").alias(c), F.col("n").alias(f"{c}_n"), (F.col("n") - F.col("place")).alias(f"{c}_rest"))
    enough = (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & ((100 + percent) * F.least("a_rest", "b_rest").cast("long") >= percent * (F.col("a_n") + F.col("b_n")))
    met = side("a").join(side("b").hint("merge"), F.col("a_token") == F.col("b_token")).where((F.col("a") < F.col("b")) & enough)
    likely = stored(met.select("a", "b").distinct(), "likely")
    signed = stored(prefixed.select("id", "hash", "key"), "signed")
    dropped(prefixed)
    _free_shuffles(texts)
    near = confirmed(texts, likely, signed.groupBy("key").agg(F.min("id").alias("id")), percent)
    out = stored((_of_sets if of_sets else _of_texts)(near, signed).where("id_a < id_b"), "pairs")
    for df in (signed, likely, near):
        dropped(df)
    _free_shuffles(texts)
    return out


def _free_shuffles(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of finished jobs now."""
    df.sparkSession._jvm.System.gc()


def signatures(sets: DataFrame) -> DataFrame:
    """(id, hashes, sig): distinct hashes of the shingles and 32 bits of the least product with each of PERMUTATIONS odd multipliers, in numpy by Arrow batch."""
    hashed = sets.where("id is not null").select("id", F.array_sort(F.array_distinct(F.transform("shingles", lambda s: F.xxhash64(s)))).alias("hashes"))
    factors = np.random.Generator(np.random.Philox(1)).integers(0, 2**62, PERMUTATIONS, dtype=np.int64) * 2 + 1

    def least(x: np.ndarray) -> np.ndarray:
        out, buffer = np.empty(PERMUTATIONS, np.int64), np.empty_like(x)
        for i, f in enumerate(factors):
            out[i] = np.multiply(x, f, out=buffer).min()
        return (out ^ (out >> 32)).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [least(np.asarray(x.values)) for x in batch.column("hashes")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hashes"), pa.array(sigs, pa.list_(pa.int32()))], names=["id", "hashes", "sig"])

    return hashed.mapInArrow(run, f"id {sets.schema['id'].dataType.simpleString()}, hashes array<long>, sig array<int>")


def banded_pairs(sets: DataFrame, percent: int = 75) -> DataFrame:
    """(id_a, id_b, jaccard) of sets(id, shingles) that agree in a band of their MinHash signature, confirmed on the full sets.

    As in similar_pairs, equal sets are one class with the smallest id, and
    each copy has one pair with its class.
    """
    signed = signatures(sets).withColumn("key", F.xxhash64("hashes")).persist()  # texts are cut once
    classes = signed.groupBy("key").agg(F.min("id").alias("id"), F.first("sig").alias("sig")).persist()
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice(F.col("sig"), b * ROWS + 1, ROWS)))
    posted = classes.select("key", F.explode(bands).alias("band"))
    x, y = posted.alias("x"), posted.alias("y")
    met = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.key") < F.col("y.key"))).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    of = lambda c: classes.select(F.col("key").alias(c), F.col("sig").alias(f"{c}_sig"), F.col("id").alias(f"{c}_id"))
    agree = F.aggregate(F.zip_with("a_sig", "b_sig", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    likely = met.join(of("a"), "a").join(of("b"), "b").where(agree >= LEAST).select("a", "b", "a_id", "b_id").persist()
    wanted = likely.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    full = signed.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("hashes").alias("hashes"))
    side = lambda c: full.select(F.col("key").alias(c), F.col("hashes").alias(f"{c}_set"))
    both = likely.join(side("a"), "a").join(side("b"), "b").withColumn("n", F.size(F.array_intersect("a_set", "b_set")))
    union = F.size("a_set") + F.size("b_set") - F.col("n")
    near = both.where(100 * F.col("n") >= percent * union).select(F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b"), (F.col("n") / union).alias("jaccard"))
    copies = signed.select("id", "key").join(classes.select("key", F.col("id").alias("id_a")), "key").where("id > id_a")
    return near.unionByName(copies.select("id_a", F.col("id").alias("id_b"), F.lit(1.0).alias("jaccard")))


def cluster_rates(df: DataFrame, pairs: DataFrame, score: str, thresholds: tuple[float, ...] = (0.75, 0.85, 0.9)) -> DataFrame:
    """(threshold, clustered, total, rate): documents with a partner at each threshold.

    A document is in a cluster of two or more exactly if it has a pair, so
    that no components are needed.
    """
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id"), score).groupBy("id").agg(F.max(score).alias("best"))
    one = ends.agg(*[F.count_if(F.col("best") >= t).alias(f"c{i}") for i, t in enumerate(thresholds)]).join(df.agg(F.count("*").alias("total")))
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"c{i}").alias("clustered")) for i, t in enumerate(thresholds)])
    return one.select("total", F.inline(rows)).select("threshold", "clustered", "total", F.when(F.col("total") > 0, F.round(F.col("clustered") / F.col("total"), 6)).alias("rate"))

"""Mixing sources to target weights by blocks of words.

A source's documents, in a fixed pseudorandom order, are one stream of words that
is packed into blocks of `block_words`. The mix is a row of output shards with
shard_slots slots each. A shard draws how many of its slots each source fills
from a multinomial distribution (its own generator, seeded by its number); what
the draws of all shards exceed a source's number of slots by goes to the sources
that got too few. A source's j-th slot takes block P(j mod n) of its n blocks,
where P is a pseudorandom permutation for the source and epoch j div n, and slots
and blocks are joined by block number. The last slot of a source is cut so that
it takes exactly its target, rounded to words. A target of at most twice a
source's size means two epochs at most, so no document is taken more than twice.

Targets: sources by code point, null last, have the weights in turn and share
`share` of all words; none gets more than `limit` times its size, and what is
over is shared among the others by weight until none is above.

Only one number per source (at most MAX_SOURCES, else it fails) and no data of
documents reach the driver. Joins with a row for each document, block or draw ask for
merging, as the files of such tables are far smaller than a broadcast of their rows.
A hot source has many blocks and buckets and no task of its own. Each step's result depends on the rows and the seed alone.

Defined cases: null and empty texts have size 0 and are never taken; null is a
source of its own. Rows that repeat an id are separate documents. An empty
table gives an empty result. Ties in a source's order are broken by id, text and
size; rows that agree in all of them are taken one after the other. A very long
text fills as many blocks as it has words for. Columns besides id, text and
source aren't read, but mixed_documents() returns them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, free_shuffles, materialize, named, packed, release, scratch, unpacked, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
LIMIT = 2.0
BLOCK_WORDS = 64
SHARD_SLOTS = 256
#: Shards that one draw task numbers through.
GROUP = 256
#: Rows of a source for which offsets are summed together, about.
BUCKET_ROWS = 1000
MAX_SOURCES = 100_000
SEED = 20


def share_out(sizes: list[int], weights: list[float], total: float, limit: float = LIMIT) -> list[float]:
    """total by weight, but nowhere over limit times the size; what is over goes to the others by weight."""
    targets = [0.0] * len(sizes)
    free = {i for i, n in enumerate(sizes) if n > 0}
    left = total
    while free:
        unit = left / sum(weights[i] for i in free)
        full = {i for i in free if unit * weights[i] >= limit * sizes[i]}
        if not full:
            for i in free:
                targets[i] = unit * weights[i]
            break
        for i in full:
            targets[i] = limit * sizes[i]
            left -= targets[i]
        free -= full
    return targets


def _round(key: np.ndarray, half: np.ndarray, number: int) -> np.ndarray:
    x = (half + key + np.uint64(number)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _feistel(x: np.ndarray, key: np.ndarray, bits: np.ndarray, backward: bool) -> np.ndarray:
    """A bijection of the numbers below 4**bits."""
    mask = (np.uint64(1) << bits) - np.uint64(1)
    left, right = x >> bits, x & mask
    for number in (3, 2, 1, 0) if backward else range(4):
        if backward:
            left, right = right ^ (_round(key, left, number) & mask), left
        else:
            left, right = right, left ^ (_round(key, right, number) & mask)
    return (left << bits) | right


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray, backward: bool = False) -> np.ndarray:
    """Place of each x < n in the pseudorandom permutation of range(n) that key names."""
    n = n.astype(np.uint64)
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(n, np.uint64(2)).astype(float))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    bits += ((np.uint64(1) << (bits * np.uint64(2))) < n).astype(np.uint64)
    key = _round(key.astype(np.uint64), np.zeros(len(x), np.uint64), 9)
    out = _feistel(x.astype(np.uint64), key, bits, backward)
    while (over := out >= n).any():  # outside the range the walk goes on to the next number inside
        out[over] = _feistel(out[over], key[over], bits[over], backward)
    return out.astype(np.int64)


def permutation_key(seed: int, source: np.ndarray, epoch: np.ndarray) -> np.ndarray:
    return (np.uint64(seed) << np.uint64(48)) ^ (source.astype(np.uint64) << np.uint64(8)) ^ epoch.astype(np.uint64)


@dataclass
class Plan:
    """Per source, in order: size, target, words to take, blocks, slots, and words cut from the last slot."""

    sources: list[str | None]
    size: np.ndarray
    target: np.ndarray
    words: np.ndarray
    blocks: np.ndarray
    slots: np.ndarray
    trim: np.ndarray
    block_words: int
    seed: int

    def lengths(self, source: np.ndarray, block: np.ndarray) -> np.ndarray:
        last = block == self.blocks[source] - 1
        return np.where(last, self.size[source] - (self.blocks[source] - 1) * self.block_words, self.block_words)


def make_plan(sources: list[str | None], sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, block_words: int = BLOCK_WORDS, seed: int = SEED) -> Plan:
    order = sorted(range(len(sources)), key=lambda i: (sources[i] is None, sources[i] or ""))
    named, size = [sources[i] for i in order], np.array([sizes[i] for i in order], np.int64)
    target = np.array(share_out(size.tolist(), [weights[i % len(weights)] for i in range(len(size))], share * float(size.sum()), limit))
    words = np.minimum(np.round(target).astype(np.int64), np.floor(limit * size).astype(np.int64))
    blocks = -(-size // block_words)
    epochs, rest = np.divmod(words, np.maximum(size, 1))
    # In the last, partial epoch the short block may come early; then one more block may be needed.
    number = np.arange(len(size))
    short = size - (blocks - 1) * block_words
    place = np.where(blocks > 0, permute(np.maximum(blocks - 1, 0), np.maximum(blocks, 1), permutation_key(seed, number, epochs), backward=True), 0)
    had = lambda k: k * block_words - (block_words - short) * (place < k)
    partial = -(-rest // block_words)
    partial = partial + (had(partial) < rest)
    return Plan(named, size, target, words, blocks, epochs * blocks + partial, np.where(rest > 0, had(partial) - rest, 0), block_words, seed)


@dataclass
class Mix:
    """documents: (id, source, size, text_hash, copy, source_number, start), where start is the
    first word's place in its source's stream. spans: (source_number, start, size, first, words, epoch,
    shard, slot): what a slot takes of a document, from its word `first` on."""

    plan: Plan
    documents: DataFrame
    spans: DataFrame


def _located(docs: DataFrame, id_col: str, text_col: str, source_col: str, plan_of, seed: int) -> tuple[Plan, DataFrame]:
    sized = docs.select(named(docs, id_col).alias("id"), named(docs, source_col).cast("string").alias("source"), word_count(named(docs, text_col)).alias("size"), F.xxhash64(named(docs, text_col)).alias("text_hash"))
    sized = materialize(sized, "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plan = plan_of([r["source"] for r in totals], [r["size"] for r in totals])
    spark = docs.sparkSession
    if not totals:
        return plan, sized.select("*", F.lit(1).alias("copy"), F.lit(0).cast("long").alias("source_number"), F.lit(0).cast("long").alias("start"))
    rows = {r["source"]: r["n"] for r in totals}
    numbers = pd.DataFrame({"name": pd.Series(plan.sources, dtype=object), "source_number": np.arange(len(plan.sources), dtype=np.int64), "buckets": [-(-rows[s] // BUCKET_ROWS) for s in plan.sources]})
    numbers = F.broadcast(spark.createDataFrame(numbers, "name string, source_number long, buckets long"))
    known = sized.join(numbers, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    known = known.withColumn("bucket", F.pmod(F.xxhash64("id", "text_hash", F.lit(seed)), F.col("buckets")))
    inside = Window.partitionBy("source_number", "bucket").orderBy("id", "text_hash", "size")
    known = known.withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    again = Window.partitionBy("source_number", "bucket", "id", "text_hash").orderBy("size")
    known = known.withColumn("copy", F.row_number().over(again))
    filled = known.groupBy("source_number", "bucket").agg(F.sum("size").alias("filled"))
    through = Window.partitionBy("source_number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = filled.select("source_number", "bucket", F.coalesce(F.sum("filled").over(through), F.lit(0)).alias("base"))
    placed = known.join(base, ["source_number", "bucket"]).withColumn("start", F.col("base") + F.coalesce("before", F.lit(0)))
    places = materialize(placed.select("id", "source", "size", "text_hash", "copy", "source_number", "start"), "places")
    release(sized)
    return plan, places


def _slots(docs: DataFrame, plan: Plan, shard_slots: int) -> DataFrame:
    """(shard, slot, source_number, block, epoch, words) of the whole mix."""
    spark, total, seed = docs.sparkSession, int(plan.slots.sum()), plan.seed
    shards = -(-total // shard_slots)
    groups = -(-shards // GROUP)
    chance = plan.slots / max(total, 1)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for group in frame["id"]:
                first = group * GROUP
                shard = np.arange(first, min(first + GROUP, shards))
                slots = np.minimum(shard_slots, total - shard * shard_slots)
                counts = np.stack([np.random.Generator(np.random.Philox(key=[seed, s])).multinomial(n, chance) for s, n in zip(shard.tolist(), slots.tolist(), strict=True)])
                within = np.cumsum(counts, axis=0) - counts
                row, source = np.nonzero(counts)
                yield pd.DataFrame({"group": group, "shard": shard[row], "source_number": source, "count": counts[row, source], "within": within[row, source], "at": (np.cumsum(counts, axis=1) - counts)[row, source]})

    drawn = materialize(spark.range(0, groups, 1, max(1, min(groups, 1000))).mapInPandas(draw, "group long, shard long, source_number long, count long, within long, at long"), "draws")
    got = np.zeros(len(plan.slots), np.int64)
    for r in drawn.groupBy("source_number").agg(F.sum("count").alias("n")).collect():
        got[r["source_number"]] = r["n"]
    through = Window.partitionBy("source_number").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    before = drawn.groupBy("group", "source_number").agg(F.sum("count").alias("n"))
    before = before.select("group", "source_number", F.coalesce(F.sum("n").over(through), F.lit(0)).alias("before"))
    numbered = drawn.hint("merge").join(before, ["group", "source_number"]).select("shard", "source_number", "count", "at", (F.col("before") + F.col("within")).alias("first"))
    spare, short = np.maximum(got - plan.slots, 0), np.maximum(plan.slots - got, 0)
    spare_from, short_from = np.cumsum(spare) - spare, np.cumsum(short) - short

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for cut in range(0, len(frame), 2000):
                f = frame.iloc[cut : cut + 2000]
                n = f["count"].to_numpy()
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                source, j = np.repeat(f["source_number"].to_numpy(), n), np.repeat(f["first"].to_numpy(), n) + within
                slot, shard = np.repeat(f["at"].to_numpy(), n) + within, np.repeat(f["shard"].to_numpy(), n)
                over = np.flatnonzero(j >= plan.slots[source])
                if len(over):
                    turn = spare_from[source[over]] + j[over] - plan.slots[source[over]]
                    other = np.searchsorted(short_from + short, turn, side="right")
                    j[over] = got[other] + turn - short_from[other]
                    source[over] = other
                blocks = plan.blocks[source]
                epoch = j // blocks
                block = permute(j % blocks, blocks, permutation_key(seed, source, epoch))
                words = plan.lengths(source, block) - np.where(j == plan.slots[source] - 1, plan.trim[source], 0)
                yield pd.DataFrame({"shard": shard, "slot": slot, "source_number": source, "block": block, "epoch": epoch, "words": words})

    return numbered.mapInPandas(fill, "shard long, slot long, source_number long, block long, epoch long, words long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> Mix:
    plan, placed = _located(docs, id_col, text_col, source_col, lambda s, n: make_plan(s, n, weights, share, limit, block_words, seed), seed)
    slots = _slots(docs, plan, shard_slots)
    width = F.lit(block_words)
    pieces = placed.where("size > 0").select("source_number", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("size") - 1) / width))).alias("block"))
    both = slots.join(pieces.hint("merge"), ["source_number", "block"])
    low = F.greatest(F.col("start"), F.col("block") * width)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * width + F.col("words"))
    spans = both.where(high > low).select("source_number", "start", "size", (low - F.col("start")).alias("first"), (high - low).alias("words"), "epoch", "shard", "slot")
    return Mix(plan, placed, spans)


def per_document(mixed: Mix, id_col: str = "doc_id") -> DataFrame:
    """(id_col, size, source_size, target, taken, source) of each row that was mixed."""
    plan, spark = mixed.plan, mixed.documents.sparkSession
    taken = mixed.spans.groupBy("source_number", "start").agg(F.sum("words").alias("taken"))
    facts = pd.DataFrame({"source_number": np.arange(len(plan.sources), dtype=np.int64), "source_size": plan.size, "target": plan.target})
    sources = spark.createDataFrame(facts, "source_number long, source_size long, target double") if len(facts) else spark.createDataFrame([], "source_number long, source_size long, target double")
    found = mixed.documents.where("size > 0").join(taken.hint("merge"), ["source_number", "start"], "left").unionByName(mixed.documents.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return found.join(F.broadcast(sources), "source_number").select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mix as rows like docs: one for each document and epoch that takes words of it.

    A row whose epoch takes all words has the whole text. Otherwise its text has
    the words that the epoch takes, with the white space after each, in order.
    """
    spark = docs.sparkSession
    with scratch(spark) as stay:
        mixed = mix(docs, id_col, text_col, source_col, **settings)
        spans = mixed.spans.groupBy("source_number", "start", "epoch").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("first", "words"))).alias("spans"))
        epochs = spans.groupBy("source_number", "start").agg(F.sort_array(F.collect_list(F.struct("epoch", "taken", "spans"))).alias("epochs"))
        free_shuffles(spark)
        keys = materialize(mixed.documents.where("size > 0").join(epochs.hint("merge"), ["source_number", "start"]).select("id", "source", "text_hash", "copy", "size", "epochs"), "keys")
        again = materialize(keys.where("copy > 1").select("id", "source", "text_hash").distinct(), "again")
        stay += [keys, again]
    same = lambda x, y: x["id"].eqNullSafe(y["id"]) & (x["text_hash"] == y["text_hash"]) & x["source"].eqNullSafe(y["source"])
    rows = docs.select(packed(docs, (text_col,)).alias("row"), named(docs, text_col).alias("text"), named(docs, id_col).alias("id"), F.xxhash64(named(docs, text_col)).alias("text_hash"), named(docs, source_col).cast("string").alias("source"))
    took = ["row", "text", "size", "epochs"]
    if again.isEmpty():
        joined = rows.join(keys.hint("merge"), same(rows, keys)).select(*took)
    else:  # which of the rows that agree in id, text and source is which copy
        turn = F.row_number().over(Window.partitionBy("id", "text_hash", "source").orderBy(F.lit(1)))
        once, copies = rows.join(again.hint("merge"), same(rows, again), "left_anti"), rows.join(again.hint("merge"), same(rows, again), "left_semi").withColumn("turn", turn)
        joined = once.join(keys.hint("merge"), same(once, keys)).select(*took).unionByName(copies.join(keys.hint("merge"), same(copies, keys) & (copies["turn"] == keys["copy"])).select(*took))
    words = F.regexp_extract_all(F.col("text"), F.lit(rf"[^{SPACE_CLASS}]+[{SPACE_CLASS}]*"), F.lit(0))
    joined = joined.select("row", "text", "size", F.explode("epochs").alias("epoch"))
    held = F.struct(words.alias("words"), F.col("epoch.spans").alias("spans"))
    cut = F.transform(F.array(held), lambda h: F.array_join(F.transform(h["spans"], lambda s: F.array_join(F.slice(h["words"], (s["first"] + 1).cast("int"), s["words"].cast("int")), "")), ""))[0]
    text = F.when(F.col("epoch.taken") == F.col("size"), F.col("text")).otherwise(cut)
    return joined.withColumn("mixed", text).select(*unpacked("row", docs.columns, {text_col: F.col("mixed")}))

"""Near-duplicate groups from an inverted join on MinHash signature coordinates.

1. Documents with the same shingle set form one class; the rest works on classes.
2. A class is posted under each of its COORDINATES coordinate-value pairs. A pair
   of classes must collide in MATCHES coordinates. The postings of the first
   SCREEN coordinates come first: classes that don't collide in SCREEN_MATCHES of
   them with any other go. By the prefix principle it is then enough to merge, for
   each class, the postings of its COORDINATES - MATCHES + 1 rarest pairs; the most
   frequent ones are skipped, and a class with fewer than MATCHES pairs that
   another class has can't match anything and goes too.
3. In each of a few rounds every posting list that spans components has a head,
   and each member is set against the head that it shares most lists with. First
   the heads are the members with the most frequent pairs, which lie in the middle
   of their group, then they are drawn by hash. Links contract classes into
   components.
4. Lists that still span components hold members whose other ends are nearly
   similar enough. For these the rarest shingles of the full sets decide: a pair
   must share one among as many as an unlike pair could have apart (the prefix
   principle again, exact for sets). After a round with heads of these lists too,
   members are set against some others of different components, then against more
   and then all; those that collide in MATCHES coordinates stay.
5. Every link is confirmed on the full shingle sets.

With 64 coordinates and 32 matches, a pair at similarity 0.75 is missed with a
probability of 5e-6, and 4e-6 more in the screen; at 0.8 of 1e-7. Nothing is
capped; lists of any length are merged.

Defined cases: nulls and texts without a word have the empty set and are linked
with nothing, and so are rows without an id (component null, kept). Repeated rows
and ties (equal texts) fall into one class. Very long texts count with all their
shingles, one text at a time. Only the two named columns are read, so that other
names can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, materialize, release, scratch, text_chunks
from .components import components
from .shingles import Shingler, odd_numbers

COORDINATES = 64
MATCHES = 32
SHINGLE = 5
#: A class goes if it doesn't collide in SCREEN_MATCHES of the first SCREEN coordinates with any other.
SCREEN = 24
SCREEN_MATCHES = 8
#: Up to so many ids of wanted texts are broadcast (some 20 MB at most); more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Rounds of links with heads of posting lists, and heads that a member is set against in a round with lists of rare shingles.
ROUNDS = 3
OFFERS = 4
#: Before all pairs of what is left, members are set against about so many others of each list of rare shingles: most links that are left contract then.
PARTNERS = (32, 256)
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 75


def signature(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Least product of any hash with each factor; the low six bits are the coordinate's number."""
    out = np.empty(len(factors), np.uint64)
    buffer = np.empty_like(hashes)
    for i, f in enumerate(factors):
        out[i] = np.multiply(hashes, f, out=buffer).min()
    low = np.uint64(len(factors) - 1)
    return (out & ~low) | np.arange(len(factors), dtype=np.uint64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, node, sig) of each row; node names the shingle set and is null if it's empty."""
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, factors = Shingler(SHINGLE), odd_numbers(COORDINATES, 5)
        for part in text_chunks(batches, "text"):
            counts, nodes, sigs = [], [], []
            for text in part.column("text").to_pylist():
                hashes = shingler.sets(text)
                counts.append(len(hashes))
                nodes.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
                sigs.append(signature(hashes, factors).view(np.int64) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], names=["id", "n_shingles", "node", "sig"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_shingles long, node binary, sig array<long>")


def full_sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, sig, hashes) of the classes in members(node, id, sig), from the text of one document of each."""
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("id is not null")
    ids = members.select("id")
    source = source.join(F.broadcast(ids) if members.count() <= BROADCAST_IDS else ids, "id", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(SHINGLE)
        for part in text_chunks(batches, "text"):
            sets = [x for text in part.column("text").to_pylist() if len(x := shingler.sets(text))]
            nodes = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "hashes"])

    # An id may stand for several texts and rows: only wanted sets stay, once each.
    made = source.mapInArrow(run, "node binary, hashes array<long>").dropDuplicates(["node"])
    return made.join(members.select("node", "sig"), "node").select("node", "sig", "hashes")


def enough(both: Column, left: Column, right: Column) -> Column:
    return 100 * both >= PERCENT * (left + right - both)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(a, b) that collide in enough coordinates and whose full sets are similar enough."""
    of = lambda c: sets.select(F.col("node").alias(c), F.struct("sig", "hashes").alias(f"{c}_set"))
    joined = pairs.join(of("b"), "b").join(of("a"), "a")
    collide = F.size(F.array_intersect("a_set.sig", "b_set.sig")) >= MATCHES
    both = F.size(F.array_intersect("a_set.hashes", "b_set.hashes"))
    return joined.where(collide & enough(both, F.size("a_set.hashes"), F.size("b_set.hashes"))).select("a", "b")


def found_members(classes: DataFrame) -> DataFrame:
    """(node, id, sig, n, prefix, weight) of the classes that may have a link; weight is larger for pairs that more classes have."""
    first = classes.select("node", F.explode(F.slice("sig", 1, SCREEN)).alias("value"))
    shared = materialize(first.groupBy("value").count().where("count > 1").select("value"), "screen")
    likely = first.join(shared, "value").groupBy("node").count().where(F.col("count") >= SCREEN_MATCHES).select("node")
    likely = materialize(classes.join(likely, "node"), "likely")
    release(shared)
    free_shuffles(classes.sparkSession)
    posted = likely.select("node", F.explode("sig").alias("value"))
    shared = materialize(posted.groupBy("value").count().where("count > 1"), "shared")
    listed = posted.join(shared, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "value"))).alias("listed"))
    listed = listed.where(F.size("listed") >= MATCHES).select(
        "node", F.slice("listed", 1, F.size("listed") - MATCHES + 1).getField("value").alias("prefix"),
        F.aggregate("listed", F.lit(0).cast("long"), lambda total, x: total + x["count"]).alias("weight"),
    )
    members = materialize(likely.join(listed, "node"), "members")
    release(shared, likely)
    return members


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of each row of docs."""
    spark = docs.sparkSession
    with scratch(spark) as stay:
        signed = materialize(signatures(docs, id_col, text_col), "signatures")
        stay.append(signed)
        classes = signed.where("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("id"), F.any_value("sig").alias("sig"), F.any_value("n_shingles").alias("n"))
        classes = materialize(classes, "classes")
        free_shuffles(spark)
        members = found_members(classes)
        free_shuffles(spark)
        sets = materialize(full_sets(docs, members, id_col, text_col), "sets")
        free_shuffles(spark)
        posts = members.select("node", "n", "weight", F.explode("prefix").alias("value"))
        linked = Links(members, sets)
        for turn in range(ROUNDS):
            if not linked.add(offers(posts, linked.labels, turn)):
                break
        rare = materialize(rarest(posts, linked.labels, sets), "rare")
        linked.add(rare_offers(rare, linked.labels))
        for partners in (*PARTNERS, None):
            linked.add(expanded(rare, linked.labels, partners))
        groups = linked.groups
        grouped = classes.select("node", "id").join(groups, "node")
        least = materialize(grouped.groupBy("label").agg(F.min("id").alias("least")), "least")
        named = materialize(grouped.join(least, "label").select("node", F.col("least").alias("component_id")).unionByName(classes.join(groups, "node", "left_anti").select("node", F.col("id").alias("component_id"))), "named")
        stay.append(named)
    # Rows without a set or an id don't go through the join, where they would share one key.
    alone = signed.where("node is null or id is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = signed.where("node is not null and id is not null").select("id", "n_shingles", "node").join(named, "node").select("id", "n_shingles", "component_id")
    out = out.unionByName(alone).withColumnRenamed("id", id_col)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


class Links:
    """Links confirmed so far. groups: (node, label) of their ends; labels: of all members, those without a link as their own."""

    def __init__(self, members: DataFrame, sets: DataFrame) -> None:
        self.members, self.sets, self.found = members, sets, None
        self.labels = members.select("node", F.col("node").alias("label"))
        self.groups = self.labels.limit(0)

    def add(self, pairs: DataFrame) -> bool:
        """Confirm pairs(a, b); whether there was a link among them."""
        fresh = materialize(confirmed(pairs, self.sets), "found")
        free_shuffles(fresh.sparkSession)
        if fresh.isEmpty():
            return False
        self.found = fresh if self.found is None else self.found.unionByName(fresh)
        self.groups = components(self.found)
        labels = self.members.select("node").join(self.groups, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
        self.labels = materialize(labels, "labels")
        return True


def spanning(at: DataFrame, key: str) -> DataFrame:
    """The rows of at(key, label) whose list has more than one label."""
    spans = at.groupBy(key).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select(key)
    return at.join(spans, key, "left_semi")


def heads(at: DataFrame, key: str, order: Column) -> DataFrame:
    """(key, head, size) of the lists of at that span components; head is the member with the largest order."""
    made = at.groupBy(key).agg(F.max_by(F.struct("node", "n", "label"), order).alias("head"), F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
    return made.where("low <> high").select(key, "head", "size")


def drawn(turn: int) -> Column:
    return F.struct(F.xxhash64("node", F.lit(turn)), "node")


def offers(posts: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Pairs(a, b) of a head of lists, a, and a member of another component that shares more of them with it than with another head."""
    at = posts.join(labels, "node")
    met = at.join(heads(at, "value", drawn(turn) if turn else F.struct("weight", "node")), "value").where(F.col("label") != F.col("head.label"))
    met = met.where(enough(F.least("n", "head.n"), F.col("n"), F.col("head.n"))).groupBy("node", F.col("head.node").alias("head")).count()
    return met.groupBy("node").agg(F.max_by("head", F.struct("count", "head")).alias("a")).select("a", F.col("node").alias("b"))


def rarest(posts: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, n, hash, at) of the rarest shingles, at the places `at`, of members of lists that span components."""
    still = materialize(spanning(posts.select("node", "value").join(labels, "node"), "value").select("node").distinct(), "open")
    shingles = sets.join(still, "node").select("node", F.size("hashes").alias("n"), F.explode("hashes").alias("hash"))
    # A shingle that no other open member has can't be in an intersection; those come first in the order of rarity.
    counts = shingles.groupBy("hash").count().where("count > 1")
    listed = shingles.join(counts, "hash").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("count", "hash"))).alias("listed"))
    alone = F.col("n") - F.size("listed")
    longest = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - alone
    listed = listed.withColumn("alone", alone).withColumn("longest", longest.cast("int")).where("longest > 0")
    posted = listed.select("node", "n", "alone", F.posexplode(F.slice("listed", F.lit(1), F.col("longest")).getField("hash")).alias("at", "hash"))
    return posted.select("node", "n", "hash", (F.col("alone") + F.col("at")).alias("at"))


def rare_offers(rare: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs(a, b) of each open member, b, and the OFFERS heads of other components that it shares the rarest shingles with."""
    at = rare.join(labels, "node")
    met = at.join(heads(at, "hash", drawn(ROUNDS)), "hash").where(F.col("label") != F.col("head.label"))
    met = met.where(enough(F.least("n", "head.n"), F.col("n"), F.col("head.n"))).groupBy("node", F.col("head.node").alias("head")).agg(F.sum(1 / F.col("size")).alias("score"))
    best = met.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "head")), asc=False), 1, OFFERS).getField("head").alias("heads"))
    return best.select(F.explode("heads").alias("a"), F.col("node").alias("b"))


def expanded(rare: DataFrame, labels: DataFrame, partners: int | None) -> DataFrame:
    """Pairs(a, b) of different components whose rarest shingles don't rule a link out: of each member with about so many others in each list, drawn by hash, or with all."""
    at = rare.join(labels, "node")
    spans = at.groupBy("hash").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low <> high")
    side = materialize(at.join(spans.select("hash", "size"), "hash"), "sides")
    met = side if partners is None else side.where(F.pmod(F.xxhash64("node", F.lit("met")), F.lit(1 << 30)) * F.col("size") < partners << 30)
    x, y = side.alias("x"), met.alias("y")
    # A link of sets of n and m shingles has at least so many in common, and two sets share one among their first n - need + 1 and m - need + 1.
    need = F.ceil((F.col("x.n") + F.col("y.n")) * PERCENT / F.lit(100 + PERCENT))
    wanted = (F.col("x.hash") == F.col("y.hash")) & (F.col("x.label") != F.col("y.label")) & (F.col("x.at") <= F.col("x.n") - need) & (F.col("y.at") <= F.col("y.n") - need)
    if partners is None:
        wanted = wanted & (F.col("x.node") < F.col("y.node"))
    return materialize(x.join(y, wanted).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "pairs")

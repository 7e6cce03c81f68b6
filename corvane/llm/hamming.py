"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

A vector's code has a bit for each dimension, 1 if the number is above 0. Codes
are cut into segments and posted under each (segment, value). A round r sets
queries against all codes that have a segment at distance r from theirs: by the
pigeonhole principle all codes within s * (r + 1) - 1 of a query, with s
segments, have then been seen. A query is done when its k-th verified distance is
no larger; the others go on with r + 1. After the round r = segment width a query
has seen every code, so the loop ends with exact results always.

Vectors with the same code are one entry with the k + 1 smallest ids and how often, up
to k, each has this code, which is all that a result can hold, so that many equal vectors don't
multiply work. A query's own rows may be among those counted, so that its bound asks for as
many more as it has.
Pairs come from the first segment that finds them, and only if their distance
doesn't exceed the query's k-th so far.

Defined cases: null vectors, and vectors shorter or longer than `dimensions`,
are neither queries nor neighbours; null numbers give a 0 bit; rows without an id
are left out; of rows that repeat an id each is a neighbour of others and none of its own id,
and each query row among them has its neighbours, under one ranking. Ties go to the smaller id. Fewer than k others give fewer rows; an
empty table none. Only the two named columns are read, so that other names can't
clash.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch

WORD = 64
#: Bits of a segment, to be chosen by the number of codes: 8 up to some 10**5 of them, 16 to 32 beyond, so that a value has few
#: postings. Narrow segments have many postings, wide ones many probes in late rounds; results are the same.
WIDTH = 16


def code_words(vector: Column, dimensions: int) -> list[Column]:
    """The code as 64-bit words; the first dimension is the lowest bit."""
    out = []
    for start in range(0, dimensions, WORD):
        part = F.reverse(F.slice(vector, start + 1, min(WORD, dimensions - start)))
        out.append(F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))))
    return out


def distance(left: list[Column], right: list[Column]) -> Column:
    total = F.bit_count(left[0].bitwiseXOR(right[0]))
    for a, b in zip(left[1:], right[1:], strict=True):
        total = total + F.bit_count(a.bitwiseXOR(b))
    return total


def nearest(vectors: DataFrame, queries: Column, k: int, dimensions: int = 64, width: int = WIDTH, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest other rows of each row for which queries holds."""
    if WORD % width or (dimensions > WORD and dimensions % width):
        raise ValueError("the segment width must divide 64 and the dimensions")
    with scratch(vectors.sparkSession) as kept:
        kept.append(materialize(_nearest(vectors, queries, k, dimensions, width, id_col, vector_col), "neighbours"))
    return kept[0]


def _nearest(vectors: DataFrame, queries: Column, k: int, dimensions: int, width: int, id_col: str, vector_col: str) -> DataFrame:
    n_words = -(-dimensions // WORD)
    names = [f"w{i}" for i in range(n_words)]
    usable = vectors[id_col].isNotNull() & vectors[vector_col].isNotNull() & (F.size(vectors[vector_col]) == dimensions)
    coded = vectors.where(usable).select(vectors[id_col].alias("id"), queries.alias("asks"), *[c.alias(n) for n, c in zip(names, code_words(vectors[vector_col], dimensions), strict=True)])
    coded = materialize(coded, "codes")
    times = coded.groupBy(*names, "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"), F.bool_or("asks").alias("asks"))
    times = materialize(times, "times")
    turn = F.row_number().over(Window.partitionBy(*names).orderBy("id"))
    listed = times.withColumn("turn", turn).where(F.col("turn") <= k + 1)
    index = listed.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("id", "times"))).alias("ids"), F.sum("times").alias("n"))
    index = materialize(index, "index")
    qs = [f"q{n}" for n in names]
    # What a query must have met: its own rows, with any code, and k more.
    asking = times.join(times.where("asks").select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.sum("times").alias("own"))
    codes = times.where("asks").join(asking, "id").groupBy(*[F.col(n).alias(q) for n, q in zip(names, qs, strict=True)])
    asked = materialize(codes.agg((F.max("own") + k).alias("wanted")), "asked")
    places = [(i, s) for i in range(n_words) for s in range(0, min(WORD, dimensions - i * WORD), width)]
    mask = (1 << width) - 1
    low = lambda c, s: F.shiftrightunsigned(c, s).bitwiseAND(F.lit(mask).cast("long"))
    segments = lambda cs: F.array(*[low(cs[i], s) for i, s in places])
    q, w = [F.col(n) for n in qs], [F.col(n) for n in names]
    apart = [F.bit_count(low(a.bitwiseXOR(b), s)) for (i, s) in places for a, b in [(q[i], w[i])]]
    posted = index.select(*names, "n", F.posexplode(segments(w)).alias("segment", "value"))
    rounds, active = [], asked.withColumn("bound", F.lit(dimensions))
    for radius in range(width + 1):
        flips = [sum(1 << b for b in bits) for bits in combinations(range(width), radius)]
        probes = active.select("*", F.posexplode(segments(q)).alias("segment", "own"))
        probes = probes.select("*", F.explode(F.lit(flips).cast("array<long>")).alias("flip"))
        probes = probes.select(*qs, "bound", "segment", F.col("own").bitwiseXOR(F.col("flip")).alias("value"))
        first = F.lit(True)
        for j, d in enumerate(apart):
            first = first & (d >= radius) & ((F.col("segment") <= j) | (d > radius))
        near = distance(q, w)
        # Spark doesn't see how many probes explode makes, and would broadcast them.
        met = probes.hint("merge").join(posted, ["segment", "value"]).where(first & (near <= F.col("bound")))
        rounds.append(materialize(met.select(*qs, *names, "n", near.alias("distance")), "found"))
        found = reduce(DataFrame.unionByName, rounds)
        # Counts by distance are few for each query, whatever it has met.
        tally = found.groupBy(*qs, "distance").agg(F.sum("n").alias("n"))
        upward = Window.partitionBy(*qs).orderBy("distance").rowsBetween(Window.unboundedPreceding, 0)
        reached = tally.withColumn("through", F.sum("n").over(upward)).join(asked, qs).where(F.col("through") >= F.col("wanted"))
        bounds = reached.groupBy(*qs).agg(F.min("distance").alias("bound"))
        state = materialize(asked.join(bounds, qs, "left").withColumn("bound", F.coalesce("bound", F.lit(dimensions))), "state")
        covered = len(places) * (radius + 1) - 1
        active = state.where(F.col("bound") > covered)
        if active.isEmpty():
            break
    # All codes up to the bound stay: among those at the same distance ids decide.
    best = found.join(state, qs).where(F.col("distance") <= F.col("bound"))
    neighbours = best.join(index.select(*names, "ids"), names).select(*qs, "distance", F.inline("ids")).withColumnRenamed("id", "neighbor_id")
    askers = coded.where("asks").select(F.col("id").alias("query_id"), *[F.col(n).alias(q) for n, q in zip(names, qs, strict=True)])
    pairs = askers.join(neighbours, qs).where("neighbor_id <> query_id").withColumn("again", F.explode(F.sequence(F.lit(1), "times")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", F.col("distance").cast("int").alias("distance"))

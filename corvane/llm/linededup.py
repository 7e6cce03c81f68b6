"""Line deduplication with DataFrame operations only.

A line's key is the line without white space (space, tab, LF, VT, FF, CR) at
its ends and with A-Z as a-z. Keys of at least min_chars code points that are in
two or more documents stay in the document with the smallest id alone.

Key hashes (128 bits) are range-partitioned; in a partition the rows are sorted
by hash, document and position, and a window streams over them with the first
document of the hash. Keys that hold a large share of all lines would fill a
partition. They are found on a hash-drawn 64th of the lines (a share of
1/(HOT_SHARE * partitions) there, so their number is bounded by the partitions')
and take another way with the same result: the first document by an aggregate
that combines before its shuffle.

The result is one row per document with its lines' number and a bitmap of the
dropped ones: 64-bit words, of which only those that aren't 0 are kept.

Defined cases: null and empty texts have one empty line. Documents are told
apart by id, so rows that repeat an id keep each other's lines; a null id counts
as the largest. Each input row gives one output row. An empty table gives an
empty one. Very long texts are split whole; a bitmap has a bit for each line.
Columns besides id and text are not read by the operator; apply_bitmaps() hands
them on, but for any that have the name of one of its results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, materialize, named, packed, scratch, unpacked

MIN_CHARS = 10
HOT_SHARE = 4
HOT_SAMPLE = 64
#: Fewer lines than this in the sample make no key hot.
HOT_LEAST = 20


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, text_hash, pos, h1, h2) of the lines whose key is long enough."""
    lines = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("text_hash"), F.posexplode(split_lines(docs[text_col])).alias("pos", "line"))
    key = F.btrim("line", F.lit(SPACES))
    lines = lines.where(F.length("line") >= min_chars).select("id", "text_hash", "pos", ascii_lower(key).alias("key"))
    return lines.where(F.length("key") >= min_chars).select("id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def hot_keys(lines: DataFrame, parts: int) -> DataFrame:
    """(h1, h2) of the keys that hold a large share of a sample of lines: at most HOT_SHARE for each of the partitions."""
    drawn = lines.where(F.pmod(F.xxhash64("id", "pos", F.lit("hot")), F.lit(HOT_SAMPLE)) == 0)
    counted = drawn.groupBy("h1", "h2").count().where(F.col("count") >= HOT_LEAST)
    total = drawn.agg(F.count("*").alias("total"))
    return counted.join(F.broadcast(total), F.col("count") * HOT_SHARE * parts >= F.col("total")).select("h1", "h2")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, text_hash, words) of the documents that lose lines; words is array<struct<word int, bits long>>."""
    spark = docs.sparkSession
    with scratch(spark) as stay:
        # The range partitioner samples its input, and hot keys read it twice more: texts are split once.
        lines = materialize(keyed_lines(docs, id_col, text_col, min_chars), "lines")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        hot = materialize(hot_keys(lines, parts), "hot")
        out = materialize(_bitmaps(lines, None if hot.isEmpty() else hot, parts), "dropped")
        stay.append(out)
    return out


def _bitmaps(lines: DataFrame, hot: DataFrame | None, parts: int) -> DataFrame:
    cold = lines if hot is None else lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti")
    cold = cold.repartitionByRange(parts, "h1", "h2")
    streamed = Window.partitionBy("h1", "h2").orderBy(F.asc_nulls_last("id"), "pos")
    lost = cold.withColumn("first", F.first("id").over(streamed)).where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "text_hash", "pos")
    if hot is not None:
        shared = lines.join(F.broadcast(hot), ["h1", "h2"])
        firsts = shared.groupBy("h1", "h2").agg(F.min("id").alias("first")).where("first is not null")
        late = shared.join(F.broadcast(firsts), ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("first")))
        lost = lost.unionByName(late.select("id", "text_hash", "pos"))
    word, bit = F.floor(F.col("pos") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, pos % 64)")
    words = lost.groupBy("id", "text_hash", word).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


def kept_text(lines: Column, words: Column) -> Column:
    """The lines that a bitmap doesn't drop, joined again."""
    of = F.map_from_entries(words)
    every = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 64).cast("int")), lambda i: F.coalesce(of[i], F.lit(0).cast("long")))
    parts = F.struct(lines.alias("lines"), every.alias("every"))
    kept = F.transform(F.array(parts), lambda p: F.filter(p["lines"], lambda _, i: F.getbit(p["every"][F.floor(i / 64).cast("int")], i % 64) == 0))
    return F.array_join(kept[0], "\n")


def apply_bitmaps(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its columns, and _n_lines, _n_dropped and _kept, the text without the dropped lines."""
    results = ("_n_lines", "_n_dropped", "_kept")
    x = docs.select(packed(docs, (text_col, *results)).alias("row"), named(docs, text_col).alias("text"), named(docs, id_col).alias("id"), F.xxhash64(named(docs, text_col)).alias("hash")).alias("x")
    joined = x.join(dropped.alias("y"), F.col("x.id").eqNullSafe(F.col("y.id")) & (F.col("hash") == F.col("text_hash")), "left")
    lines = split_lines(F.col("text"))
    lost = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w["bits"]))
    return joined.select(
        *unpacked("row", [c for c in docs.columns if c not in results], {text_col: F.col("text")}),
        F.size(lines).cast("long").alias("_n_lines"), F.coalesce(lost, F.lit(0)).cast("long").alias("_n_dropped"),
        F.when(F.col("words").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept_text(lines, F.col("words"))).alias("_kept"),
    )

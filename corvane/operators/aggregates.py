"""Corpus aggregates: distributions, histograms, coverage, entropy, completeness, reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import exprs as X


def label_distribution(df: DataFrame, bucket: Column, buckets: list[str]) -> DataFrame:
    """One row: the total, a count for each bucket and the rest as `other`."""
    counts = [F.count_if(bucket == b).alias(b.replace(" ", "_")) for b in buckets]
    return df.agg(F.count("*").alias("total"), *counts, F.count_if(~F.coalesce(bucket.isin(buckets), F.lit(False))).alias("other"))


def breakdown(df: DataFrame, bucket: Column, accepted: Column, buckets: list[str]) -> DataFrame:
    """Accepted, disagreed and generated by bucket, the share accepted in percent, and a row `total`."""
    rows = df.select(bucket.alias("bucket"), accepted.alias("accepted")).where(F.col("bucket").isin(buckets))
    out = rows.rollup("bucket").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.coalesce("accepted", F.lit(False))).alias("disagreed"), F.count("*").alias("generated"))
    rate = F.when(F.col("generated") > 0, F.round(F.col("accepted") / F.col("generated") * 100, 6))
    return out.select(F.coalesce("bucket", F.lit("total")).alias("bucket"), "accepted", "disagreed", "generated", rate.alias("rate"))


def composition(df: DataFrame, dimensions: dict[str, Column], top: int | None = 8, order: Column | None = None) -> DataFrame:
    """(dimension, value, n, share, rank) for each dimension, the most frequent first.

    Ties go by `order` (the smaller first position), then by value. One pass over
    df: the dimensions become rows before the one aggregation.
    """
    position = F.lit(0) if order is None else order
    pairs = F.array(*[F.struct(F.lit(name).alias("dimension"), value.cast("string").alias("value")) for name, value in dimensions.items()])
    rows = df.select(position.alias("position"), F.explode(pairs).alias("pair")).select("position", "pair.*")
    counted = rows.groupBy("dimension", "value").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy("dimension")) * 100, 6)
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "first", "value"))
    out = counted.select("dimension", "value", "n", share.alias("share"), rank.alias("rank"))
    return out if top is None else out.where(F.col("rank") <= top)


def spread(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """(dimension, distinct, min_share, max_share, even_share): how even the values of each dimension are."""
    all_values = composition(df, dimensions, top=None)
    return all_values.groupBy("dimension").agg(F.count("*").alias("distinct"), F.min("share").alias("min_share"), F.max("share").alias("max_share"), F.round(100 / F.count("*"), 6).alias("even_share"))


def ordered_positions(df: DataFrame, value: str, places: list[Column]) -> DataFrame:
    """The values at places (from 0) of the sorted column, without sorting rows in one task.

    Rows are first counted by value; only one row per value is put in order.
    """
    counted = df.groupBy(value).agg(F.count("*").alias("n"))
    through = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("upto", F.sum("n").over(through))
    return placed.agg(*[F.min(F.when(F.col("upto") > p, F.col(value))).alias(f"p{i}") for i, p in enumerate(places)])


MAX_BINS = 28


def length_summary(df: DataFrame, length: Column) -> DataFrame:
    """One row about the positive lengths: total, shortest, median, longest, and the one at 99 % of the order."""
    rows = df.select(length.cast("long").alias("length")).where("length > 0")
    counted = rows.groupBy("length").agg(F.count("*").alias("n"))
    through = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = counted.select("length", F.sum("n").over(through).alias("upto"), F.sum("n").over(total).alias("total"))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("length")))
    half = F.floor(F.col("total") / 2)
    median = (at(half - F.when(F.col("total") % 2 == 0, 1).otherwise(0)) + at(half)) / 2
    p99 = at(F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(0.99))))
    out = placed.agg(F.max("total").alias("total"), F.min("length").alias("shortest"), median.alias("median"), F.max("length").alias("longest"), p99.alias("p99"))
    return out.where(F.col("total") > 0)


def length_histogram(df: DataFrame, length: Column) -> DataFrame:
    """(bin, upto, n): dense bins of a round width up to the 99 % point, and the overflow with upto null."""
    summary = length_summary(df, length)
    top = F.greatest(F.col("p99"), F.col("shortest") + 1)
    width = X.nice_width((top - F.col("shortest")).cast("double"), MAX_BINS)
    bounds = summary.select("shortest", top.alias("top"), width.alias("width"))
    bounds = bounds.select("width", (F.floor(F.col("shortest") / F.col("width")) * F.col("width")).alias("low"), (F.floor(F.col("top") / F.col("width")) * F.col("width")).alias("high"))
    rows = df.select(length.cast("long").alias("length")).where("length > 0").groupBy("length").agg(F.count("*").alias("n"))
    placed = rows.join(F.broadcast(bounds))  # one row
    over = F.col("length") > F.col("high") + F.col("width")
    binned = placed.select(F.when(over, F.col("high") + F.col("width")).otherwise(F.least(F.floor(F.col("length") / F.col("width")) * F.col("width"), F.col("high"))).alias("bin"), over.alias("over"), "n")
    binned = binned.groupBy("bin", "over").agg(F.sum("n").alias("n"))
    dense = bounds.select(F.explode(F.sequence("low", "high", "width")).alias("bin"), F.col("width"), F.lit(False).alias("over"))
    dense = dense.unionByName(bounds.select((F.col("high") + F.col("width")).alias("bin"), "width", F.lit(True).alias("over")))
    out = dense.join(binned, ["bin", "over"], "left")
    return out.select("bin", F.when(~F.col("over"), F.col("bin") + F.col("width")).alias("upto"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def dominant(df: DataFrame, value: Column, order: Column) -> DataFrame:
    """(value, n, total) of the most frequent value; of equals the one that comes first."""
    rows = df.select(value.alias("value"), order.alias("position")).where(F.col("value").isNotNull() & (F.trim("value") != ""))
    counted = rows.groupBy("value").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    best = F.max_by(F.struct("value", "n"), F.struct("n", (-F.col("first")).alias("early")))
    return counted.agg(best.alias("best"), F.sum("n").alias("total")).where("total > 0").select("best.value", "best.n", "total")


def coverage(df: DataFrame, item: str, flag: Column, group: str | None = None) -> DataFrame:
    """Items with any flagged row, of all items: (group,) detected, checked, percent."""
    keys = [item] if group is None else [group, item]
    items = df.groupBy(*keys).agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias("hit"))
    out = (items if group is None else items.groupBy(group)).agg(F.count_if("hit").alias("detected"), F.count("*").alias("checked"))
    return out.withColumn("percent", F.when(F.col("checked") > 0, F.round(F.col("detected") / F.col("checked") * 100, 6)))


def band_entropy(df: DataFrame, groups: list[str], band: Column) -> DataFrame:
    """(groups..., total, bands, entropy): Shannon entropy over the bands that occur, as a share of its most; 0 for one band."""
    counted = df.withColumn("_band", band).where("_band is not null").groupBy(*groups, "_band").agg(F.count("*").alias("c"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    share = counted.withColumn("p", F.col("c") / F.sum("c").over(whole))
    out = share.groupBy(*groups).agg(F.sum("c").alias("total"), F.count("*").alias("bands"), F.sum(-F.col("p") * F.log2("p")).alias("h"))
    return out.select(*groups, "total", "bands", F.when(F.col("bands") > 1, F.round(F.col("h") / F.log2("bands"), 6)).otherwise(F.lit(0.0)).alias("entropy"))


def field_completeness(df: DataFrame, empty: dict[str, Column]) -> DataFrame:
    """(field, total, n_empty), all fields in one aggregate."""
    one = df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(f"f{i}") for i, c in enumerate(empty.values())])
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), F.col(f"f{i}").alias("n_empty")) for i, name in enumerate(empty)])
    return one.select("total", F.inline(pairs)).select("field", "total", "n_empty")


def value_reuse(df: DataFrame, value: Column, groups: list[str]) -> DataFrame:
    """Values by normal form: (groups..., total, distinct, reused, diversity), where reused counts all but the first of a form."""
    forms = df.select(*groups, X.normal_name(value).alias("form")).where("form <> ''").groupBy(*groups, "form").agg(F.count("*").alias("n"))
    out = forms.groupBy(*groups) if groups else forms.groupBy()
    out = out.agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum(F.col("n") - 1).alias("reused"))
    return out.withColumn("diversity", F.round(1 - F.col("reused") / F.col("total"), 6))


def top_examples(df: DataFrame, groups: list[str], order: list[str], example: str, k: int) -> DataFrame:
    """(groups..., n, examples): exact counts, and the first k by order; no list longer than k is gathered."""
    turn = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    counts = df.groupBy(*groups).agg(F.count("*").alias("n"))
    first = df.withColumn("_turn", turn).where(F.col("_turn") <= k).groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("_turn", example))).alias("_found"))
    return counts.join(first, groups).select(*groups, "n", F.col("_found").getField(example).alias("examples"))


def field_distribution(lines: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n) of lines(v, bad): how often each value of the fields occurs, as lower-case text; nulls don't count.

    All fields in one pass; values are counted before the shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(X.strip(X.text_of(F.try_variant_get("v", f"$.{f}", "variant")))).alias("value")) for f in fields])
    said = lines.where(~F.col("bad") & X.is_object(F.col("v"))).select(F.inline(pairs)).where("value is not null")
    return said.groupBy("field", "value").agg(F.count("*").alias("n"))

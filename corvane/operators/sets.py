"""Set operations on keys: parity, overlap, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys on both sides, missing on the right, and without a partner on the left. One full join."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(True)), right.select(key).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count_if(F.expr("_l and _r")).alias("both"), F.count_if(F.expr("_l and _r is null")).alias("missing"), F.count_if(F.expr("_l is null and _r")).alias("orphan"))


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of the keys that only one side has."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(True)), right.select(key).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, key, "full_outer").where("_l is null or _r is null")
    return both.select(key, F.when(F.col("_l").isNotNull(), "missing").otherwise("orphan").alias("side"))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys that both sides have."""
    return left.select(key).intersect(right.select(key))


def orphans(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of left without a partner."""
    return left.join(right.select(F.col(right_key).alias(left_key)), left_key, "left_anti")


def wanted(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of left with a partner, each once."""
    return left.join(right.select(F.col(right_key).alias(left_key)), left_key, "left_semi")

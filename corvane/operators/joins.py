"""Lookups and reconciling joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last by order. Combines before its shuffle."""
    others = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*others), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*")


def field_mismatch(left: DataFrame, right: DataFrame, on: list[str], fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(field, checked, mismatched): fields of joined rows that differ, null-safe, all in one aggregate.

    The sides are aliased l and r, which the expressions may use.
    """
    both = left.alias("l").join(right.alias("r"), on)
    one = both.agg(F.count("*").alias("checked"), *[F.count_if(~a.eqNullSafe(b)).alias(f"m{i}") for i, (a, b) in enumerate(fields.values())])
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), F.col(f"m{i}").alias("mismatched")) for i, name in enumerate(fields)])
    return one.select("checked", F.inline(pairs)).select("field", "checked", "mismatched")


def best_match(names: DataFrame, others: DataFrame, name: str, other: str, score: Column, threshold: float, keys: Callable[[Column], Column] = lambda tokens: tokens) -> DataFrame:
    """For each name the other name with the highest score of at least the threshold; of equals the first by text.

    Names and others hold arrays `l_tokens` and `r_tokens`. Only pairs that
    share a token meet: both sides are exploded by token and joined on it.
    `keys` picks the tokens of which a pair that scores has one in common.
    """
    a = names.select(name, "l_tokens", F.explode(keys(F.col("l_tokens"))).alias("token"))
    b = others.select(other, "r_tokens", F.explode(keys(F.col("r_tokens"))).alias("token"))
    pairs = a.join(b, "token").drop("token").distinct().withColumn("score", score).where(F.col("score") >= threshold)
    rank = F.row_number().over(Window.partitionBy(name).orderBy(F.desc("score"), other))
    return pairs.withColumn("_rank", rank).where("_rank = 1").select(name, other, "score")

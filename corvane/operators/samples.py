"""Deterministic samples: even steps, round robin over strata, seeded."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str], to: str = "_index") -> DataFrame:
    """Rows numbered from 0 by order: rank inside range partitions plus the sizes of those before."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))  # one row for each partition
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn(to, F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")


def even_sample(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """The rows at places floor(i * rows / size) of the order; all if there are no more than size."""
    total = df.count()
    rows = numbered(df, order)
    if total <= size:
        return rows.drop("_index")
    first = F.ceil(F.col("_index") * size / F.lit(total))
    return rows.where(F.floor(first * (F.lit(total) / size)) == F.col("_index")).drop("_index")


def stratified_sample(df: DataFrame, stratum: str, order: list[str], size: int) -> DataFrame:
    """Round robin over the strata by name: the first of each by order, then the second, up to size rows."""
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    return df.withColumn("_turn", turn).where(F.col("_turn") <= size).orderBy("_turn", stratum).limit(size).drop("_turn")


def seeded_sample(df: DataFrame, order: list[str], size: int, seed: int = 42) -> DataFrame:
    """The rows at the places that random.Random(seed).sample draws; all if there are no more than size.

    The driver draws `size` numbers; rows are picked by a join.
    """
    total = df.count()
    rows = numbered(df, order)
    if total <= size:
        return rows.drop("_index")
    drawn = random.Random(seed).sample(range(total), size)
    return rows.join(F.broadcast(df.sparkSession.createDataFrame([(i,) for i in drawn], "_index long")), "_index", "left_semi").drop("_index")

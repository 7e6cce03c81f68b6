"""How many intervals of a key are open at each moment, by sweeping buckets of time apart.

Time is cut into equal buckets. A table of counts by start bucket and end bucket, one for
each key, is summed along both sides; at every border its sums give what is
open there: starts before the border less ends before it. So each bucket is swept from its own
snapshot, whatever came before, and no task holds more than one bucket's moments or one key's
table. Both have a bound that doesn't grow with the rows: a bucket has at most its
length in `step`s, the table BUCKETS * (BUCKETS + 1) cells.

The key `all_key`, if given, sums up all keys. It comes from the sums of the others, so that no row
is counted twice on the way.

Defined cases: an interval with a null start, or an end not after its start, takes no part;
a null end is open for ever. A null weight is 0. A null key is a key of its own.
Repeated rows count each time. A moment whose starts and ends cancel out in number and
weight gives no row. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_shuffles, materialize, release

BUCKETS = 128
STEP = 60


def seconds(time: Column) -> Column:
    """Seconds since 1970 of a time without a zone, rounded down to a minute."""
    return F.unix_date(time.cast("date")).cast("long") * 86_400 + F.hour(time) * 3_600 + F.minute(time) * 60


def _snapshots(cells: pd.DataFrame) -> pd.DataFrame:
    """For each bucket of a key the number and weight of what is open at its start, from the key's contingency table."""
    buckets = int(cells["buckets"].iloc[0])
    out = {"key": pd.Series([cells["key"].iloc[0]] * buckets, dtype=cells["key"].dtype), "bucket": np.arange(buckets)}
    for name in ("n", "weight"):
        table = np.zeros((buckets + 1, buckets + 2), np.int64)  # a row and a column of zeros before; the last column has what never ends
        np.add.at(table, (cells["first"].to_numpy() + 1, cells["last"].to_numpy() + 1), cells[name].to_numpy())
        summed = table.cumsum(axis=0).cumsum(axis=1)
        before = np.arange(buckets)
        out[f"open_{name}"] = summed[before, buckets + 1] - summed[before, before]
    return pd.DataFrame(out)


def sweep(intervals: DataFrame, all_key: int | None = None, buckets: int = BUCKETS, step: int = STEP) -> DataFrame:
    """(key, from_s, to_s, n_open, open_weight, high_open, is_peak) of intervals(key int, start_s, end_s, weight long).

    start_s and end_s are multiples of step; the end is excluded.
    """
    spark = intervals.sparkSession
    good = intervals.where("start_s IS NOT NULL AND (end_s IS NULL OR end_s > start_s)").select("key", "start_s", "end_s", F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))
    good = materialize(good, "intervals")
    begin, end = good.agg(F.min("start_s"), F.max(F.greatest("start_s", F.coalesce("end_s", "start_s")))).first()
    begin, end = (begin or 0), (end or 0)
    width = step * max(1, -(-(end - begin + step) // (step * buckets)))
    bucket = lambda c: F.floor((F.col(c) - begin) / width).cast("int")

    cells = good.groupBy("key", bucket("start_s").alias("first"), F.coalesce(bucket("end_s"), F.lit(buckets)).alias("last")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    steps = good.select("key", F.explode(F.array(F.struct(F.col("start_s").alias("at"), F.lit(1).alias("n"), F.col("weight")), F.struct(F.col("end_s").alias("at"), F.lit(-1).alias("n"), (-F.col("weight")).alias("weight")))).alias("s")).where("s.at IS NOT NULL")
    moments = steps.groupBy("key", F.col("s.at").alias("at")).agg(F.sum("s.n").alias("n"), F.sum("s.weight").alias("weight"))
    if all_key is not None:
        whole = lambda df, by: df.unionByName(df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).withColumn("key", F.lit(all_key)))
        cells, moments = whole(cells, ("first", "last")), whole(moments, ("at",))
    open_at = cells.withColumn("buckets", F.lit(buckets)).groupBy("key").applyInPandas(_snapshots, "key int, bucket int, open_n long, open_weight long").withColumnsRenamed({"key": "of", "bucket": "into"})

    moments = moments.where("n <> 0 OR weight <> 0").withColumn("bucket", bucket("at"))
    within = Window.partitionBy("bucket", "key").orderBy("at")
    same = [F.col("bucket") == F.col("into"), F.col("key").eqNullSafe(F.col("of"))]
    run = lambda c: (F.col(f"open_{c}") + F.sum(c).over(within)).alias(f"now_{c}")
    swept = moments.join(open_at, same).select("key", "bucket", "at", run("n"), run("weight"))
    swept = materialize(swept, "swept")

    tops = swept.groupBy("key", "bucket").agg(F.max("now_n").alias("top"), F.min("at").alias("first_at"))
    along = Window.partitionBy("key").orderBy("bucket")
    tops = tops.select(F.col("key").alias("of"), F.col("bucket").alias("into"), F.max("top").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.lead("first_at").over(along).alias("then"), F.max("top").over(Window.partitionBy("key")).alias("peak"))
    out = swept.join(tops, same).select(
        "key", F.col("at").alias("from_s"), F.coalesce(F.lead("at").over(within), F.col("then")).alias("to_s"), F.col("now_n").alias("n_open"), F.col("now_weight").alias("open_weight"),
        F.greatest(F.max("now_n").over(within), F.col("before")).alias("high_open"), (F.col("now_n") == F.col("peak")).alias("is_peak"),
    )
    out = materialize(out, "sweep")
    release(good, swept)
    free_shuffles(spark)
    return out

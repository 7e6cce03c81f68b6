"""Rules on documents of a run that is still arriving.

Each batch of new metadata files is judged by itself, and its counts are written under the batch's number: a batch that is
run again after a failure replaces what it wrote. What stands is the sum over the batches, so that it doesn't matter how files
were dealt to batches, or in which order they came. A file counts once; a run's state has a few hundred rows for each batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions import exprs as X
from corvane.plans import rules as R
from corvane.plans.fields import SCHEMA_AWARE
from corvane.sources.land import instances_of
from corvane.streaming.landing import stream_metadata

#: Rules of fields that count only if some instance, in whatever batch, has them.
WHERE_USED = [f"N{2 + i}" for i in range(len(SCHEMA_AWARE))]
ORDER = ("FAIL", "WARN", "INFO", "PASS")


def judged_batch(metadata: DataFrame) -> DataFrame:
    """Rows of the rules that tell of each document, or of each instance, by itself; of metadata(folder_set, polarity, name, v)."""
    inside = instances_of(metadata)
    return R.union([R.document_names(metadata.where(X.is_object(F.col("v")))), *R.instance_parts(inside), R.used_fields(inside, lambda f: None)]).select(*R.COLUMNS)


def merged(rows: DataFrame) -> DataFrame:
    """Rows of several batches as those of one: counts add up, the worst status stands, the least and the greatest examples stay."""
    worst = F.min(F.array_position(F.array(*map(F.lit, ORDER)), F.col("status")))
    both = F.array_distinct(F.array_compact(F.array(F.min(F.array_min("examples")), F.max(F.array_max("examples")))))
    one = rows.groupBy("rule", "category", "scope", "title").agg(worst.alias("worst"), F.sum("checked").alias("checked"), F.sum("bad").alias("bad"), both.alias("examples"))
    there = one.where(~F.col("rule").isin(WHERE_USED) | (F.col("bad") < F.col("checked")))
    return there.withColumn("status", F.element_at(F.array(*map(F.lit, ORDER)), F.col("worst").cast("int"))).select(*R.COLUMNS)


def judge_arrivals(spark: SparkSession, pattern: str, state: str, checkpoint: str) -> StreamingQuery:
    """Judge what has arrived since the last call and end."""
    new = stream_metadata(spark, pattern)
    sides = F.when(F.contains("path", F.lit("/Disagreements/")), "Disagreements").otherwise("Agreements"), F.nullif(F.regexp_extract("path", "/(Positive|Negative)/outputs/", 1), F.lit(""))
    metadata = new.select(sides[0].alias("folder_set"), sides[1].alias("polarity"), "name", "v")

    def write(batch: DataFrame, number: int) -> None:
        judged_batch(batch).write.mode("overwrite").parquet(f"{state}/batch={number}")

    return metadata.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standing(spark: SparkSession, state: str) -> DataFrame:
    """What the rules say of all that has been judged."""
    return merged(spark.read.parquet(state))

"""Incremental landing: new run files arrive as a stream and are appended as parsed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions import exprs as X
from corvane.functions.exprs import decoded
from corvane.sources.land import clean


def stream_metadata(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, name, v, error) of metadata files that match a path pattern, as they arrive."""
    raw = spark.readStream.option("wholetext", True).option("pathGlobFilter", "*.json").text(pattern)
    path = decoded(F.col("_metadata.file_path"))
    v = F.try_parse_json(clean(F.col("value")))
    return raw.select(path.alias("path"), X.base_name(path).alias("name"), v.alias("v"), F.when(v.isNull(), "malformed").alias("error"))


def append_metadata(spark: SparkSession, pattern: str, target: str, checkpoint: str) -> StreamingQuery:
    """Land what is there now and end; the next call goes on from there, each file once."""
    return stream_metadata(spark, pattern).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

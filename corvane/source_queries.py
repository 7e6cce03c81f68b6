"""The sources as named queries: files in the formats of a run, written from the driver's tables and read back."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.queries import table
from corvane.session import shared_folder
from corvane.sources import json_splits as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BATCH = 1000


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one array for each task."""
    start = "["
    for batch in batches:
        rows = batch.column("row").to_pylist()
        for i in range(0, len(rows), BATCH):
            part = rows[i : i + BATCH]
            yield pa.RecordBatch.from_arrays([pa.array([start + part[0], *("," + r for r in part[1:])])], ["value"])
            start = ","
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if start == "[" else "]"])], ["value"])


def _map_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one map of maps of maps for each task, from rows in the order of their keys."""
    last: tuple[str | None, str | None] = (None, None)
    for batch in batches:
        out = []
        for one, two, three, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if one != last[0]:
                out.append(("{" if last[0] is None else "}},") + json.dumps(one) + ": {" + json.dumps(two) + ": {")
            elif two != last[1]:
                out.append("}," + json.dumps(two) + ": {")
            else:
                out.append(",")
            last = one, two
            out.append(f"{json.dumps(three)}: [{row}]")
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["{}" if last[0] is None else "}}}"])], ["value"])


def written(spark: SparkSession, lines: DataFrame, name: str) -> str:
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    lines.write.text(folder)
    return folder


@query("SELECT doc_id, lang, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def json_array_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents as arrays of records, an array for each task that writes, read by splits."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text")
    folder = written(spark, docs.select(F.to_json(F.struct("*")).alias("row")).mapInArrow(_array_lines, "value string"), "arrays")
    v = S.elements(S.read(spark, [folder], 1, "part-*")).select(F.try_parse_json("text").alias("v"))
    of = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    return v.select(of("doc_id", "long").alias("doc_id"), of("lang", "string").alias("lang"), of("n_chars", "long").alias("n_chars"), F.sha2(F.coalesce(of("text", "string"), F.lit("")), 256).alias("text_sha256"))


@query("""SELECT coalesce(source, '') AS entity, coalesce(lang, '') AS "value", 'd' || doc_id || '.txt' AS filename, doc_id AS chunk_id, sha256(coalesce(text, '')) AS content_sha256 FROM documents WHERE doc_id IS NOT NULL""")
def nested_map_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents as an index of source, language and file, a map for each task that writes, read by splits."""
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL")
    keys = [F.coalesce("source", F.lit("")).alias("one"), F.coalesce("lang", F.lit("")).alias("two"), F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("three")]
    row = F.to_json(F.struct(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("chunk_content"))).alias("row")
    folder = written(spark, docs.select(*keys, row).sortWithinPartitions("one", "two").mapInArrow(_map_lines, "value string"), "maps")
    found = S.entries(S.read(spark, [folder], 3, "part-*")).where("text IS NOT NULL")
    entry = F.try_parse_json(F.concat(F.lit("{"), "text", F.lit("}")))
    rows = found.select(F.col("first").alias("entity"), F.col("second").alias("value"), entry.alias("entry"))
    inside = spark.tvf.variant_explode(F.col("entry").outer()).select(F.col("key").alias("filename"), F.try_variant_get("value", "$[0]", "variant").alias("chunk"))
    of = lambda name, kind: F.try_variant_get("chunk", f"$.{name}", kind)
    return rows.lateralJoin(inside).select("entity", "value", "filename", of("chunk_id", "long").alias("chunk_id"), F.sha2(of("chunk_content", "string"), 256).alias("content_sha256"))

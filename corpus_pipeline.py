"""A training-data pipeline over `documents`: five stages, each one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again before the next one. All but the last return the columns of
documents, for the rows that they keep, with their text as they leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, langid, linededup, mixing, neardup
from corvane.llm.common import free_shuffles, materialize, packed, release, scratch, table, unpacked
from corvane.llm.queries import held_out, model_path
from corvane.session import ship_package


def _apart(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): row has the other columns, so that no name clashes with one of an operator."""
    return docs.select("doc_id", "text", packed(docs, ("doc_id", "text")).alias("row"))


def _together(df: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of docs from (doc_id, text, row), with another text, if there is one, and its length in n_chars."""
    put = {"doc_id": F.col("doc_id"), "text": F.col("text") if text is None else text}
    if text is not None and "n_chars" in docs.columns:
        put["n_chars"] = F.length(text).cast("long")
    return df.select(*unpacked("row", docs.columns, put))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those that the classifier rejects go.

    Null, empty and letterless texts are rejected. Rows are judged one by one,
    so that ties, repeated rows and null ids don't matter. Without any label
    all rows are rejected; an empty table stays empty.
    """
    ship_package(spark)
    model = langid.fit(docs, ~held_out(docs))
    return _together(langid.predict(_apart(docs), model, carry=("doc_id", "text", "row")).where("not rejected"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document with a smaller id has.

    Every row stays, a null text as an empty one. Rows that repeat an id keep
    each other's lines; a null id counts as the largest. An empty table stays empty.
    """
    ship_package(spark)
    done = linededup.apply_bitmaps(_apart(docs), linededup.dropped_lines(docs))
    return _together(done, docs, F.col("_kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    A document is an id and a text: of rows that repeat both one stays, while
    another text of the same id is judged by itself. Rows without an id or
    without a word all stay. An empty table stays empty.
    """
    ship_package(spark)
    keyed = _apart(docs).withColumn("key", F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("hash"))))
    with scratch(spark) as stay:
        decided = neardup.near_duplicates(keyed, "key").where("key is not null and n_shingles > 0")
        gone = decided.groupBy("key").agg(F.every("kept").alias("kept"), F.count("*").alias("rows")).where("not kept or rows > 1")
        gone = materialize(gone, "gone")
        stay.append(gone)
    left = keyed.join(gone.select("key"), "key", "left_anti")
    again = gone.where("kept").select("key")
    if not again.isEmpty():
        left = left.unionByName(keyed.join(again, "key", "left_semi").dropDuplicates(["key"]))
    return _together(left, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: a row for each document and epoch, with the words that the mix takes.

    Texts without a word are never taken; null is a source of its own; rows
    that repeat are separate documents. An empty table stays empty.
    """
    ship_package(spark)
    mixed = mixing.mixed_documents(docs)
    return _together(_apart(mixed), docs, F.col("text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row of the mix, and digests of ids and decoded text.

    A null text counts as an empty one and has no ids; each row has its own
    result. An empty table stays empty.
    """
    ship_package(spark)
    coded = bpe.encode_documents(docs, model_path())
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: The classifier and the mix's draws can't be written in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        made = materialize(stage(spark, docs, sf_dir), name)
        if k:
            release(docs)
        free_shuffles(spark)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
